import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticework.llm import chroma, imatch, jaccard_join, language_id, license_scan, lm_scoring, packing, piece_codec, token_counts, toxicity
from latticework.llm.components import connected
from latticework.llm.queries import vocabulary
from latticework.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Texts that are odd in one way each: empty, null, blank, special strings, other scripts, unusual spaces.
ODD = [
    None, "", " ", "  a  b ", "\n\n x\t", "<|endoftext|> x <|startoftext|>", "it's ''s 'real we'll", "▁x ▁ <s></s><0x41>", "日本語 текст 😀", "é́ é ﬁ ½ ²",
    "a\x00b\x1cc\x85d\xa0e", "İstanbul ıſŸ", "x" * 5000, "word " * 3000, "!!! ... ---", "﻿a　b\r\nc", "12345 6.7",
]


def table(spark, texts, more="extra"):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    # A repeated row, a null id, and further columns whose names clash with those inside.
    rows += [*rows[:1], (None, "no id here", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("ids", "key", "class", "n", "bucket", "score", "h", more):
        df = df.withColumn(name, F.lit("clash"))
    return df


def by_key(df, key):
    return {r[key]: r for r in df.collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = token_counts.count_tokens(table(spark, ODD), vocabulary("byte_bpe_50k.json"), 512)
    assert got.count() == len(ODD) + 2
    rows = by_id(got)
    for i, t in enumerate(ODD):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_tokens"], rows[i]["n_bytes"], rows[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    assert token_counts.count_tokens(table(spark, ODD).limit(0), vocabulary("byte_bpe_50k.json")).collect() == []


def test_whole_tokens_are_proved(spark):
    own = token_counts.WholeTokenCounter(vocabulary("byte_bpe_50k.json"))
    some = random.Random(1).sample(sorted(own.memo.pinned), 300)
    assert own.merge(some) == [1] * 300 and len(own.memo.pinned) > 40_000


def test_memo_bound_changes_nothing():
    own = token_counts.WholeTokenCounter(vocabulary("byte_bpe_50k.json"))
    texts = [f"word{i} zq{i}x " * 3 for i in range(50)]
    before = own.counts(texts)
    own.memo.cap = 5
    assert [own.counts([t])[0] for t in texts] == before


def test_piece_codec_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rows = by_id(piece_codec.encode_pieces(table(spark, ODD), vocabulary("piece_bpe_32k.model")))
    digests = by_id(piece_codec.encode_digests(table(spark, ODD), vocabulary("piece_bpe_32k.model")))
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(rows[i]["ids"], "<u4").tolist() == ids
        assert rows[i]["decoded"] == library.decode(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_agenda_on_random_strings():
    own = piece_codec.PieceCodec(vocabulary("piece_bpe_32k.model"))
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice("abehinorst eth ing,.12é▁\n") for _ in range(r.randint(1, 40)))
        ids = np.frombuffer(own.encode([text])[0][0], "<u4").tolist()
        assert ids == own.library.encode(text, add_bos=True, add_eos=True)


@pytest.mark.parametrize("seed", range(30))
def test_pack_places_every_token_once(seed):
    r = random.Random(seed)
    cap = r.choice([8, 64, 4096])
    sizes = [r.randint(1, cap) for _ in range(r.randint(0, 60))]
    windows = packing.pack(sizes, cap)
    seen = {}
    for w in windows:
        assert 0 < sum(p[2] for p in w) <= cap
        for i, start, length in w:
            seen.setdefault(i, []).append((start, length))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at and length > 0
            at += length
        assert at == n
    lengths = [sum(p[2] for p in w) for w in windows]
    padding = sum(cap - n for n in lengths if n & (n - 1))
    assert padding <= 0.005 * sum(sizes) or padding < len(windows)


def test_differencing_is_near_equal():
    r = random.Random(2)
    sizes = [r.randint(1, 1000) for _ in range(2000)]
    bins = packing.differencing(sizes, 100)
    sums = [sum(sizes[i] for i in b) for b in bins]
    assert sorted(i for b in bins for i in b) == list(range(2000)) and max(sums) - min(sums) < 10


def test_packing_documents(spark):
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = packing.pack_documents(table(spark, ODD), vocabulary("word_bpe_49k.json"), capacity=256, with_ids=True).toPandas()
    assert packing.pack_documents(table(spark, ODD).limit(0), vocabulary("word_bpe_49k.json")).count() == 0
    for i, t in enumerate(ODD):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = got[got.doc_id == i].sort_values(["start", "sequence_id"])
        copies = 2 if i == 0 else 1
        assert own.length.sum() == copies * len(ids) and (own.doc_tokens == len(ids)).all()
        for p in own.itertuples():
            piece = ids[p.start : p.start + p.length].tobytes()
            assert p.ids == piece and p.ids_crc32 == zlib.crc32(piece)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1].tolist()] and s.length.sum() <= 256


def words_of(text):
    return (text or "").encode().lower().split()


def sets_of(texts, n):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    return out


def components(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(sets))]


def near_copies(r, n_words, n, changes):
    base = [f"w{r.randrange(400)}" for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(n):
        words = base[:]
        for _ in range(r.randint(0, changes)):
            k = r.randrange(len(words))
            words[k] = r.choice(["q%d" % r.randrange(99), words[k].upper()])
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(spark, n, percent):
    r = random.Random(n)
    texts = [t for size, count, changes in ((120, 40, 7), (30, 25, 3), (9, 25, 2), (300, 20, 15), (60, 60, 6)) for t in near_copies(r, size, count, changes)]
    texts += ["a b c", "A  b\nc", "a b c d", "a a a a", "a a a a a a", "one", "", None, " \t", "é É", "a\xa0b c d"] + ODD[2:]
    sets = sets_of(texts, n)
    expected = components(sets, percent)
    rows = by_id(jaccard_join.link_components(table(spark, texts), n, percent).filter("doc_id is not null"))
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [rows[i]["component_id"] for i in range(len(texts))] == expected
    kept = jaccard_join.one_per_component(table(spark, texts), n, percent)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(expected))
    assert kept.columns == table(spark, texts).columns


def test_jaccard_of_nothing(spark):
    assert jaccard_join.link_components(table(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("size", [1, 2, 4, 5, 20_000, 60_000])
def test_cuts_stay_few(size, percent):
    own, r = jaccard_join.bands(percent), np.random.default_rng(size)
    top = own.starts[next(i for i, s in enumerate(own.starts) if s > size)] - 1  # the fullest set of the band
    cuts = [own.keys(np.unique(r.integers(0, 2**63, top, dtype=np.uint64) * np.uint64(2))) for _ in range(5)]
    assert max(map(len, cuts)) <= 5 and sum(map(len, cuts)) <= 15


@pytest.mark.parametrize("size", [1, 2, 6, 7, 8, 13, 40, 200])
def test_linked_sets_share_a_key(size):
    """Any set within the allowed difference shares a key, whatever the blocks that are empty."""
    own, r = jaccard_join.bands(85), np.random.default_rng(size)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        drop = int(r.integers(0, size // 6 + 1))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 2**63, drop, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
            assert set(np.concatenate(own.keys(a)).tolist()) & set(np.concatenate(own.keys(b)).tolist())


def test_copies_send_the_keys_of_one(spark):
    """200 copies of a text of 5,000 words."""
    text = " ".join(f"v{i}" for i in range(5000))
    texts = [text] * 200 + ["another text of a few words"]
    plain = table(spark, texts).filter("doc_id is not null").select("doc_id", "text")
    reps = plain.groupBy("text").agg(F.min("doc_id").alias("class"))
    one = jaccard_join.keyed(reps.filter("length(text) > 100"), 5, 80).count()
    seen = []
    real = jaccard_join.shared_keys
    jaccard_join.shared_keys = lambda rows: (seen.append(rows.count()), real(rows))[1]
    try:
        found = jaccard_join.linked_texts(plain, 5, 80, "doc_id", "text").collect()
    finally:
        jaccard_join.shared_keys = real
    assert one < 5000 and seen[0] <= one + 20 and len(found) == 2


def test_half_alike_texts_are_not_verified(spark):
    """Texts of 5,000 words with 70 % in common share keys and are no links: the sketches say so."""
    r = random.Random(3)
    base = [f"b{i}" for i in range(3500)]
    texts = [" ".join(base + [f"t{k}x{r.randrange(10**9)}" for _ in range(1500)]) for k in range(60)]
    seen = []
    real = jaccard_join.verified
    jaccard_join.verified = lambda pairs, *more: (seen.append(pairs.count()), real(pairs, *more))[1]
    try:
        rows = by_id(jaccard_join.link_components(table(spark, texts), 4, 85))
    finally:
        jaccard_join.verified = real
    assert sum(seen) == 0 and [rows[i]["component_id"] for i in range(60)] == list(range(60))


def test_rows_of_one_id(spark):
    """An id's rows go by their own texts; of repeated rows one stays."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (3, None), (None, a), (None, a), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("row", F.lit(1))
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard_join.link_components(docs).filter("doc_id is not null").collect())
    assert got == [(1, 36, 1), (1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 0, 3), (4, 0, 4)]
    stays = jaccard_join.one_per_component(docs)
    assert stays.columns == docs.columns
    assert sorted(((x["doc_id"] or 0, x["text"] or "") for x in stays.collect())) == sorted([(1, a), (1, b), (3, ""), (0, a), (0, a), (4, " ")])


def test_shared_keys_of_long_and_hot_groups(spark):
    rows = [(5, c, -1) for c in range(25_000)] + [(6, c, -1) for c in range(3)] + [(7, c, -1) for c in range(3)] + [(8, 4, -1), (9, 1, -1), (9, 2, -1)]
    rows += [(10, 1, -2), (10, 3, -1), (10, 1, 1), (10, 2, 1), (10, 7, 1), (11, 4, -2), (11, 4, 4), (11, 5, 4)]
    got = jaccard_join.shared_keys(spark.createDataFrame(rows, "key long, class long, lead long")).collect()
    assert len(got) == len({tuple(x) for x in got})
    groups = {}
    for x in got:
        groups.setdefault(x["group"], set()).add((x["class"], x["first"]))
    assert groups.pop(None) == {(2, 1)}
    assert {c for c, _ in groups.pop(5)} == set(range(25_000))
    assert groups.pop(10) == {(1, 1), (3, 1), (2, 1), (7, 1)} and groups.pop(11) == {(4, 4), (5, 4)}
    assert list(groups.values()) == [{(0, 0), (1, 0), (2, 0)}]


@pytest.mark.parametrize("percent", [80, 85])
def test_sketches_bound_the_difference(percent):
    r = np.random.default_rng(percent)
    for size in (1, 30, 500, 4000, 20_000):
        a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        for share in (0.02, 0.1, 0.5):
            b = np.unique(np.concatenate([a[int(share * len(a)) :], r.integers(0, 2**63, int(share * size) + 1, dtype=np.uint64)]))
            apart = len(np.setxor1d(a, b))
            seen = jaccard_join.distances([jaccard_join.parity(a, percent).tobytes()], [jaccard_join.parity(b, percent).tobytes()])[0]
            assert seen <= apart
            if share == 0.5 and size > 100:
                assert seen * (100 + percent) > (len(a) + len(b)) * (100 - percent)


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(50)] + [(7, 7), (None, 3), (5000, 4999)]
    got = {r["node"]: r["comp"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[2000 + i] for i in range(50)} == {1000} and got[5000] == 4999


def test_imatch(spark):
    r = random.Random(4)
    texts = ODD + [" ".join(r.choice(["the", "of"]) if r.random() < 0.3 else f"t{int(r.paretovariate(0.5)) % 500}" for _ in range(r.randint(5, 200))) for _ in range(150)]
    texts[20] = texts[40]
    rows = by_id(imatch.fingerprint_edits(table(spark, texts).filter("doc_id is not null").dropDuplicates(["doc_id"])))
    plain = [t or "" for t in texts]
    near = []
    for i, t in enumerate(plain):
        half = len(t) // 2
        edited = t[: len(t) - half] + plain[(i + 1) % len(plain)][:half]
        row = rows[i]
        assert row["n_chars"] == len(t) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        near.append((row["near_edited"], row["near_next"]))
    assert rows[20]["fingerprint"] == rows[40]["fingerprint"] and rows[0]["fingerprint"] == rows[1]["fingerprint"]
    long = [x for x, t in zip(near, plain) if len(t.split()) > 20]
    assert np.mean([a for a, _ in long]) > np.mean([b for _, b in long])
    assert imatch.fingerprint_edits(table(spark, ODD)).count() == len(ODD) + 2
    assert imatch.fingerprint_edits(table(spark, []).limit(0)).collect() == []


def language_texts():
    r = random.Random(8)
    syllables = {"en": ["th", "ing", "er", "on", "an"], "fr": ["eau", "que", "ré", "ou", "ai"], "de": ["sch", "ein", "ung", "ü", "keit"]}
    return [(lang, " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(30))) for _ in range(40) for lang in syllables]


def test_language_id(spark):
    made = language_texts()
    rows = [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(made)] + [(900 + i, t, None, "s", 1) for i, t in enumerate(ODD)] + [(None, "the ing", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = by_id(language_id.identify_held_out(docs))
    assert all(got[i]["lang_pred"] == lang for i, (lang, _) in enumerate(made))
    for i, t in enumerate(ODD):
        assert (got[900 + i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= got[900 + i]["score"] <= 1
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    kept = {r["doc_id"] for r in language_id.keep_identified(docs).collect()}
    assert set(range(len(made))) <= kept and 900 not in kept
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify_held_out(bare).collect()} == {"und"}
    assert set(range(len(made))) <= {r["doc_id"] for r in language_id.keep_identified(bare).collect()}
    assert language_id.identify_held_out(docs.limit(0)).collect() == []


def plain_grams(text):
    """N-grams as (order, code points), 0 for a word end."""
    found = Counter()
    for word in "".join(c if c.isalpha() and ord(c) < 1 << 18 else " " for c in (text or "").lower()).split():
        marked = [0, *map(ord, word), 0]
        found.update((1, (c,)) for c in marked[1:-1])
        found.update((n, tuple(marked[i : i + n])) for n in (2, 3) for i in range(len(marked) - n + 1))
    return found


def plain_list(counts, top):
    return sorted(counts, key=lambda g: (-counts[g], g))[:top]


def test_languages_equal_a_plain_version(spark):
    """Profiles, out-of-place distances, ties and scores, for every text; extra columns clash, rows repeat."""
    made = language_texts()
    rows = [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(made)] + [(900 + i, t, None, "s", 1) for i, t in enumerate(ODD)]
    rows += [(950, "ab", "en", "s", 1), (951, "qqq zzz", None, "s", 1), (952, "th " * 20_000, "en", "s", 1), rows[1], rows[1], (None, "ein", "de", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("n", "code", "score", "lang_pred", "part", "held_out"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["held_out"], x["lang_pred"], round(x["score"], 9)) for x in language_id.identify_held_out(docs, top=60).collect())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    totals = {}
    for i, t, lang, *_ in rows:
        if lang and t is not None and not held(i):
            totals.setdefault(lang, Counter()).update(plain_grams(t))
    profiles = {lang: plain_list(c, 60) for lang, c in sorted(totals.items())}
    want = []
    for i, t, *_ in rows:
        own = plain_list(plain_grams(t), 60)
        apart = {lang: sum(abs(k - p.index(g)) if g in p else 60 for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        want.append((-1 if i is None else i, held(i), best if own else "und", round(1 - apart[best] / (60 * len(own)), 9) if own else 0.0))
    assert got == sorted(want)


def test_rank_distance_by_hand():
    codes = language_id.grams("ab").tolist()  # a b, _a ab b_, _ab ab_
    assert len(codes) == 7
    listed = sorted(codes)  # each occurs once, so ties go by code
    own = language_id.Profiles({"a": listed, "b": listed[::-1], "c": listed[:3]}, 7)
    assert own.nearest("ab") == ("a", 1.0)
    reverse = sum(abs(k - (6 - k)) for k in range(7))
    assert language_id.Profiles({"b": listed[::-1], "c": listed[:3]}, 7).nearest("ab") == ("b", 1 - reverse / 49)
    assert language_id.Profiles({"c": listed[:3]}, 7).nearest("ab") == ("c", 1 - 4 * 7 / 49)
    assert language_id.Profiles({"y": listed, "x": listed}, 7).nearest("ab")[0] == "y" and language_id.Profiles({"x": listed, "y": listed}, 7).nearest("ab")[0] == "x"
    assert own.nearest(None) == ("und", 0.0) and own.nearest("123") == ("und", 0.0)


def test_unlearned_languages_are_rejected(spark):
    """Floors follow the learned texts; short clean ones stay."""
    made = language_texts() * 5
    r = random.Random(4)
    strange = [" ".join("".join(r.choice("kwzyxjq") for _ in range(r.randint(3, 8))) for _ in range(30)) for _ in range(20)]
    brief = [t.split()[0] for _, t in made[:60]]
    rows = [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(made)] + [(2000 + i, t, None, "s", 1) for i, t in enumerate(strange)] + [(3000 + i, t, None, "s", 1) for i, t in enumerate(brief)]
    kept = {x["doc_id"] for x in language_id.keep_identified(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(range(len(made))) <= kept and not kept & set(range(2000, 2020)) and len(kept & set(range(3000, 3060))) >= 57


def test_toxicity(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "ble"]) for _ in range(3))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 8 == 0
        words = [word() for _ in range(40)]
        if toxic:
            words[5], words[20] = r.choice(["vileword", "nastyterm"]), "nastyterm"
        rows.append((i, " ".join(words), "en", "s", 1))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "en", "s", 1), (1001, "", "en", "s", 0), (None, "x", "en", "s", 1), rows[0]]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_held_out(docs, marks)
    assert got.count() == len(rows)
    rows = by_id(got)
    assert all(rows[i]["predicted"] == int(i % 8 == 0) for i in range(600))
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in rows.values())
    assert rows[1000]["predicted"] == 0 and rows[8]["held_out"] == (zlib.crc32(b"8") % 5 == 0)
    kept = {x["doc_id"] for x in toxicity.keep_clean(docs, marks).collect()}
    assert kept == {i for i in range(600) if i % 8} | {1000, 1001, None}
    none = marks.filter("toxic = 5")
    assert {x["predicted"] for x in toxicity.score_held_out(docs, none).collect()} == {0}
    assert toxicity.score_held_out(docs.limit(0), marks).collect() == []


def risk(w, positive, unlabelled, prior):
    """The non-negative risk by its definition, document by document; and whether the negatives' estimate is below zero."""
    loss = lambda z: np.log1p(np.exp(-z))
    g = lambda x: float(x @ w[:-1] + w[-1])
    plus, minus = np.mean([loss(g(x)) for x in positive]), np.mean([loss(-g(x)) for x in positive])
    negatives = np.mean([loss(-g(x)) for x in unlabelled]) - prior * minus
    return prior * plus + negatives, negatives < 0, negatives


def test_risk_gradient_is_that_of_its_definition():
    r = np.random.default_rng(1)
    flipped = 0
    for trial in range(20):
        positive, unlabelled = (r.random((n, 7)) < 0.4 for n in (9, 15))
        w, prior = r.normal(0, 3 if trial % 2 else 0.5, 8), 0.45 if trial % 2 else 0.2
        _, below, _ = risk(w, positive, unlabelled, prior)
        flipped += below
        step = toxicity.slope(w, positive.astype(np.float64), unlabelled.astype(np.float64), prior)
        for k in range(8):
            e = np.zeros(8)
            e[k] = 1e-5
            part = 2 if below else 0  # below zero, the negatives' estimate is what is raised
            numeric = (risk(w + e, positive, unlabelled, prior)[part] - risk(w - e, positive, unlabelled, prior)[part]) / 2e-5
            assert step[k] == pytest.approx(-numeric if below else numeric, abs=1e-5)
    assert 0 < flipped < 20


def test_toxicity_equals_a_plain_version(spark):
    """Units, training from all documents in one chunk, and scores, against plain Python."""
    r = random.Random(12)
    vocabulary_ = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(150)]
    texts = [" ".join(r.choice(vocabulary_) for _ in range(25)) + (" badword nastier" if i % 6 == 0 else "") for i in range(400)] + [None, "", "x" * 50_000]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("positive", "has", "unit", "n", "weight", "score", "toxic"):
        docs = docs.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(200)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    model = toxicity.learn(docs, labels, toxicity.outside_fold(5, 0))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    words = lambda t: {u for w in set(toxicity.WORDS((t or "").lower())) for u in [w + "$", *[w[:n] for n in range(4, 9) if n < len(w)]]}
    seen = [i for i in range(200) if not held(i)]
    confirmed = [i for i in seen if i % 6 == 0]
    share = len(confirmed) / len(seen)
    open_rows = [(i, t) for i, t, *_ in rows if not held(i)]
    pos, unl = Counter(), Counter()
    for i, t in open_rows:
        unl.update(words(t))
        if i in confirmed:
            pos.update(words(t))
    n_pos, n_unl = len(confirmed), len(open_rows)
    ranked = []
    for u, k in pos.items():
        p = k / n_pos
        neg = max((unl[u] / n_unl - share * p) / (1 - share), 0.5 / n_unl)
        z = (p - neg) / (neg / n_unl + p * (1 - p) / n_pos + 1 / n_pos**2) ** 0.5
        if k >= max(3, n_pos // 200) and p > 3 * neg and z >= 4:
            ranked.append((-z, u))
    assert model["units"] == [u for _, u in sorted(ranked)] and {"badword$", "nastier$", "badw"} <= set(model["units"])
    vector = lambda t: [int(u in words(t)) for u in model["units"]]
    w = np.array([*model["weights"], model["bias"]])
    found = toxicity.score_held_out(docs, labels).collect()
    assert len(found) == len(rows)
    for x in found:
        want = 1 / (1 + np.exp(-np.clip(np.dot(vector(texts[x["doc_id"]]), w[:-1]) + w[-1], -40, 40)))
        assert x["score"] == pytest.approx(want, abs=1e-9) and x["predicted"] == int(want >= 0.5) and x["held_out"] == held(x["doc_id"])
    positive, unlabelled = np.array([vector(texts[i]) for i in confirmed]), np.array([vector(t) for _, t in open_rows])
    start = np.append(np.zeros(len(model["units"])), np.log(share / (1 - share)))
    assert risk(w, positive, unlabelled, share)[0] < risk(start, positive, unlabelled, share)[0] - 0.05
    # A smaller start, and then all documents: a scorer as good.
    again = toxicity.learn(docs, labels, toxicity.outside_fold(5, 0), n_start=60)
    assert again["units"] == model["units"]
    scored = by_id(toxicity.score(docs, again))
    assert [i for i in range(400) if scored[i]["predicted"] != int(i % 6 == 0)] == [], (again, model["bias"], model["weights"])


def test_non_negative_risk_does_not_run_away():
    r = np.random.default_rng(0)
    x = (r.random((400, 50)) < 0.1).astype(np.float32)
    w, b = toxicity.fit(x[:20], x[20:], 0.3, steps=600)
    assert np.isfinite(w).all() and np.abs(w).max() < 50


def test_lm_scoring(spark):
    """Against the network and the counts, one token at a time."""
    r = random.Random(5)
    passage = " ".join(f"{r.choice(['red', 'blue', 'green'])} {r.choice(['fox', 'dog', 'house'])} number {i}" for i in range(60))
    texts = ODD + [t for _, t in language_texts()][:60] + [passage, "x " + passage, passage.upper(), "a " * 4000] + ["so it goes and so it ends here " * 9] * 40
    docs = table(spark, texts)
    rows = lm_scoring.tokenize(docs, "doc_id", "text").cache()
    classes = lm_scoring.Classes(dict(lm_scoring.count_tokens(rows).collect()))
    network = lm_scoring.train(rows, classes, batch=256)
    scored = lm_scoring.score_windows(rows, classes, network).cache()
    found = {x["row"]: x["gain"] for x in lm_scoring.remembered(scored, Scratch(spark, "test")).collect()}

    ids = {x["row"]: np.frombuffer(x["ids"], np.uint32) for x in rows.collect()}
    of_row = {x["row"]: x["doc_id"] for x in scored.collect()}
    assert sorted(map(str, of_row.values())) == sorted(map(str, [*range(len(texts)), 0, None]))
    counts = Counter(int(t) % 65536 for x in ids.values() for t in x)
    n = {t: max(counts[t], 0.5) for t in range(len(classes.of))}
    in_class = Counter()
    for t, k in n.items():
        in_class[int(classes.of[t])] += k
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    around = Counter()
    for x in ids.values():
        around.update((tuple(x[k - 2 : k].tolist() + x[k + 1 : k + 3].tolist()), int(x[k])) for k in range(2, len(x) - 2))
    at_context = {}
    for (c, t), k in around.items():
        at_context.setdefault(c, {})[t] = k
    for row in scored.collect():
        x = ids[row["row"]]
        doc = of_row[row["row"]]
        if doc is not None:
            plain = [w for run in (texts[doc] or "").lower().split() for w in re.findall("[^\\W\u2e80-\U0010ffff]+|.", run, re.S)]
            assert x.tolist() == [xxhash.xxh32_intdigest(w) for w in plain]
        assert row["n_tokens"] == len(x)
        if len(x) > 1500:
            continue
        total, gain, asked = 0.0, 0.0, 0
        for k, t in enumerate(x):
            hidden = network.bias.copy()
            for place, d in enumerate((-3, -2, -1, 1, 2, 3)):
                c = int(classes.of[x[k + d] % 65536]) if 0 <= k + d < len(x) else lm_scoring.BEYOND
                hidden += network.embed[c] * network.place[place]
            hidden, own = np.tanh(hidden), int(classes.of[t % 65536])
            p = softmax(hidden @ network.coarse + network.coarse_bias)[own // 32] * softmax(hidden @ network.fine[own // 32] + network.fine_bias[own // 32])[own % 32]
            log = np.log(p) + np.log(n[int(t) % 65536] / in_class[own])
            total += log
            if 2 <= k < len(x) - 2:
                key = lm_scoring.context_keys(x[k - 2 : k + 3])[0]
                if key % np.uint64(8) == 0:
                    asked += 1
                    here = at_context[tuple(x[k - 2 : k].tolist() + x[k + 1 : k + 3].tolist())]
                    if sum(here.values()) > 1:
                        gain += np.log((here[int(t)] - 1 + len(here) * np.exp(log)) / (sum(here.values()) - 1 + len(here))) - log
        assert row["network"] == pytest.approx(total, rel=1e-3, abs=1e-2)
        assert len(row["keys"]) == asked
        assert found.get(row["row"], 0.0) == pytest.approx(gain, rel=1e-2, abs=1e-2)
    out = by_id(lm_scoring.score_corpus(docs))
    assert out[0]["n_tokens"] == 0 and out[0]["log_prob"] == 0 and out[0]["mean_log_prob"] is None
    copies, alone = [out[len(ODD) + 60 + k]["mean_gain"] for k in range(3)], [out[i]["mean_gain"] for i in range(len(ODD), len(ODD) + 60)]
    assert min(copies) > 0.1 and min(copies) > max(alone) + 0.05
    assert lm_scoring.score_corpus(docs.limit(0)).collect() == []


def test_lm_memory_is_asked_at_every_context(spark):
    """A passage that recurs gains at all its tokens with two on either side, whatever their context's hash."""
    docs = table(spark, ["one two three four five", "one two three four five", "six seven eight nine ten", "six seven eight nine ten", *(f"a{i} b{i} c{i} d{i} e{i}" for pair in range(8) for i in (pair, pair))])
    gains = [r["gain"] for r in lm_scoring.score_corpus(docs).filter("n_tokens = 5").collect()]
    assert len(gains) >= 20 and all(x != 0 for x in gains)


def test_lm_gradient_and_training(spark):
    r = np.random.default_rng(3)
    network = lm_scoring.Network(hidden=8)
    contexts, targets = r.integers(0, lm_scoring.CLASSES + 1, (50, 6)).astype(np.int32), r.integers(0, lm_scoring.CLASSES, 50)
    slope = network.gradient(contexts, targets)
    loss = lambda flat: -float(lm_scoring.Network(flat, 8).log_prob(contexts, targets).mean(dtype=np.float64))
    for _ in range(10):
        way = r.normal(size=len(slope)).astype(np.float32)
        step = 1e-2 / np.linalg.norm(way)
        assert (loss(network.flat + step * way) - loss(network.flat - step * way)) / (2 * step) == pytest.approx(float(slope @ way), rel=0.05, abs=2e-2)
    # The softmaxes sum to one over all classes.
    every = np.arange(lm_scoring.CLASSES)
    assert np.exp(network.log_prob(np.repeat(contexts[:1], len(every), axis=0), every)).sum() == pytest.approx(1, abs=1e-3)
    # Training covers every token once, and lowers the loss.
    c = random.Random(2)
    docs = table(spark, [" ".join(f"the {c.choice(['red', 'old', 'big'])} {c.choice(['fox', 'dog', 'cow', 'owl'])} sees a {c.choice(['tree', 'house'])}." for _ in range(12)) for _ in range(300)])
    rows = lm_scoring.tokenize(docs, "doc_id", "text").cache()
    classes = lm_scoring.Classes(dict(lm_scoring.count_tokens(rows).collect()))
    real = lm_scoring.ROUNDS
    low = [rows.filter((F.col("slice") >= a) & (F.col("slice") < b)).count() for a, b in zip(real, [*real[1:], 16])]
    assert sum(low) == rows.count()
    trained = lm_scoring.train(rows, classes, batch=128)
    lists = [np.frombuffer(x["ids"], np.uint32) for x in rows.collect()]
    seen, target, _ = lm_scoring.windows(lists, classes)
    assert trained.log_prob(seen, target).mean() > lm_scoring.Network().log_prob(seen, target).mean() + 1


def test_license_scan(spark):
    files = [
        (1, "a/LICENSE", "MIT\nReleased under the MIT License."), (2, "a/b/x.py", "print"), (3, "a/b/c/y.py", "# Licensed under the Apache License, Version 2.0"),
        (4, "z/q", "nothing"), (5, None, None), (6, "a/b/COPYING", "GNU General Public License version 3"), (7, "a/k.c", "int"), (8, "a/b/c/d/e.txt", ""),
        (9, "https://host.example/LICENSE", "All rights reserved."), (10, "http://host.example/p/q.html?x=1#y", "<p>x</p>"), (10, "http://host.example/p/q.html?x=1#y", "<p>x</p>"),
        (None, "a/n.c", "<p>Licensed under CC BY-NC 4.0.</p>"),
    ]
    df = spark.createDataFrame(files, "id long, path string, body string").withColumn("license", F.lit("clash")).withColumn("directory", F.lit("clash"))
    got = license_scan.scan_licenses(df, "id", "path", "body").collect()
    assert len(got) == len(files)
    rows = {r["id"]: (r["own_license"], r["license"], r["origin"], r["from_directory"]) for r in got}
    assert rows[1][0] == "MIT" and rows[3][0] == "Apache-2.0" and rows[6][0] == "GPL-3.0" and rows[None][0] == "CC-BY-NC-4.0"
    assert rows[2] == (None, "GPL-3.0", "inherited", "a/b") and rows[7] == (None, "MIT", "inherited", "a") and rows[8] == (None, "GPL-3.0", "inherited", "a/b")
    assert rows[4][2] == rows[5][2] == "none" and rows[10] == (None, "Proprietary", "inherited", "host.example")
    assert license_scan.scan_licenses(df.limit(0), "id", "path", "body").collect() == []


def test_wide_directories_are_dealt(spark):
    upward = spark.createDataFrame([(f"host/d{i}", d, a) for i in range(50) for d, a in ((0, ""), (1, "host"), (2, f"host/d{i}"))], "directory string, depth int, above string")
    licensed = spark.createDataFrame([("host", "MIT"), ("host/d7", "ISC")], "above string, license string")
    got = sorted((x["directory"], x["above"], x["license"]) for x in license_scan.dealt_join(upward, licensed, "above", "directory", "inner", spread=8).collect())
    assert got == sorted([(f"host/d{i}", "host", "MIT") for i in range(50)] + [("host/d7", "host/d7", "ISC")])
    assert license_scan.dealt_join(upward, licensed, "above", "directory", "left", spread=8).count() == 150


def test_every_template_has_a_trigger_and_finds_itself(spark):
    texts = spark.createDataFrame([(i, "p", t) for i, (_, t) in enumerate(license_scan.TEMPLATES)], "id int, path string, body string")
    got = {r["id"]: r["own_license"] for r in license_scan.scan_licenses(texts, "id", "path", "body").collect()}
    assert got == {i: name for i, (name, _) in enumerate(license_scan.TEMPLATES)}


def test_chroma(spark):
    r = np.random.default_rng(3)
    vectors = r.normal(0, 0.125, (120, 64)).round(4).tolist()
    vectors[50] = vectors[7]
    rows = [(i, v, "clash") for i, v in enumerate(vectors)] + [(500, None, ""), (520, [], ""), (540, [0.1], ""), (None, vectors[3], "")]
    media = spark.createDataFrame(rows, "vec_id long, embedding array<float>, codes string")
    got = chroma.search_recordings(media).collect()
    assert len(got) == len(rows)
    by = {x["vec_id"]: x for x in got}
    queries = [x for x in got if x["is_query"]]
    assert {x["vec_id"] for x in queries} == {0, 20, 40, 60, 80, 100, 500, 520, 540}
    found = [x for x in queries if x["vec_id"] < 120]
    assert sum(x["match_id"] == x["vec_id"] for x in found) >= 0.9 * len(found)
    # Brute force over all recordings and offsets.
    prints = [chroma.codes(chroma.chroma(chroma.tones(np.float32(v).tolist()))) for v in vectors]
    for x in found:
        probe = chroma.codes(chroma.chroma(chroma.excerpt(np.float32(vectors[x["vec_id"]]).tolist())))
        errors = [(np.bitwise_count(p[o : o + len(probe)] ^ probe).mean() / 32, i, o) for i, p in enumerate(prints) for o in range(len(p) - len(probe) + 1)]
        best = min(errors)
        if x["match_id"] is not None:
            assert (x["match_id"], x["match_offset"]) == best[1:] and x["bit_error"] == pytest.approx(best[0])
    assert by[7]["fingerprint"] == by[50]["fingerprint"] and by[500]["match_id"] is None and by[540]["n_codes"] == 0
    assert chroma.search_recordings(media.limit(0)).collect() == []


def test_recordings_from_files_and_long_ones(spark):
    r = np.random.default_rng(2)
    made = {i: chroma.tones(r.normal(0, 0.125, 64)) for i in range(6)}
    made[6] = np.tile(made[0], 40)  # some five minutes

    def wav(samples, rate, channels=1):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(2)
            f.setframerate(rate)
            at = np.arange(int(len(samples) * rate / chroma.RATE)) * (chroma.RATE / rate)
            again = (np.interp(at, np.arange(len(samples)), samples) * 30000).astype("<i2")
            f.writeframes(np.repeat(again, channels).tobytes())
        return out.getvalue()

    files = [(i, wav(x, 4096)) for i, x in made.items()] + [(10, wav(made[1], 8192, 2)), (11, None), (12, b""), (13, wav(made[2][:100], 4096))]
    index = chroma.fingerprint_recordings(spark.createDataFrame(files, "id long, file binary"), "id", "file", chroma.wav_samples, "binary").cache()
    by = by_key(index, "id")
    for i, x in made.items():
        frames = chroma.chroma(np.round(x * 30000).astype(np.float32) / 32768)
        assert len(by[i]["codes"]) == len(frames) - 15
    assert np.allclose(chroma.chroma(made[6], 100), chroma.chroma(made[6], 10**6)) and [by[i]["class"] for i in (11, 12, 13)] == [None] * 3
    found = {(x["id"], x["match_id"]): x["bit_error"] for x in chroma.align_all(index.filter("id = 10"), index).collect()}
    assert found[(10, 1)] < 0.1
    assert {(x["id"], x["match_id"]) for x in chroma.align_all(index.filter("id = 0"), index).collect()} >= {(0, 0), (0, 6)}


def test_a_frequent_integer_is_spread(spark):
    """A steady tone in every recording: one integer everywhere, whose places travel in parts."""
    steady = chroma.codes(chroma.chroma(chroma.tones([0.1] * 40)))
    rows = [(i, steady.view(np.int32).tolist() + [i], str(i)) for i in range(300)]
    index = spark.createDataFrame(rows, "id long, codes array<int>, class string")
    reps = chroma.representatives(index)
    merged = chroma.merged(chroma.postings(reps, hot=10), 500)
    assert merged.agg(F.max(F.length("places"))).first()[0] <= 4 * 500 + 4 * 300 * len(steady)
    assert merged.agg(F.sum(F.length("places"))).first()[0] == 4 * 300 * (len(steady) + 1)
    got = chroma.align_all(index.filter("id < 3"), index, spread=20)
    assert {(x["id"], x["match_id"]) for x in got.collect()} == {(i, j) for i in range(3) for j in range(300)}


def test_chroma_probes_with_every_integer(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 32, 40, dtype=np.uint32)
    asked = base.copy()
    asked[2:] ^= np.uint32(1)  # noise in all integers but two, and these two are frequent
    index = {0: base}
    for i in range(1, 21):
        index[i] = base.copy()
        index[i][2:] ^= np.uint32(1 << 5 + i)
    for k in range(2, 40):  # what noise made is rare
        index[100 + k] = r.integers(0, 1 << 32, 40, dtype=np.uint32)
        index[100 + k][k // 2] = asked[k]
    of = lambda rows: spark.createDataFrame([(i, c.view(np.int32).tolist(), str(i)) for i, c in rows.items()], "id long, codes array<int>, class string")
    assert [x[:3] for x in chroma.align(of({7: asked}), of(index)).collect()] == [(7, 0, 0)]
    assert {x["match_id"] for x in chroma.align_all(of({7: asked}), of(index), spread=3).collect()} == set(range(21))


def test_chroma_recall_with_near_copies(spark):
    r = np.random.default_rng(11)
    vectors = r.normal(0, 0.125, (1500, 64)).round(4)
    for start in range(0, 600, 60):  # ten groups of near copies, each of a query and twenty others
        for k in range(1, 21):
            vectors[start + k] = vectors[start]
            vectors[start + k, r.integers(0, 64, 4)] = r.normal(0, 0.125, 4).round(4)
    media = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>")
    got = {x["vec_id"]: x for x in chroma.search_recordings(media).collect()}
    prints = np.stack([chroma.codes(chroma.chroma(chroma.tones(np.float32(v).tolist()))) for v in vectors])
    near_pairs, near_found, own = 0, 0, 0
    for i in range(0, 1500, 20):
        probe = chroma.codes(chroma.chroma(chroma.excerpt(np.float32(vectors[i]).tolist())))
        across = np.stack([prints[:, o : o + len(probe)] ^ probe for o in range(prints.shape[1] - len(probe) + 1)])
        errors, equal = np.bitwise_count(across).mean(axis=2) / 32, (across == 0).sum(axis=2)
        partners = {x["match_id"]: x for x in got[i]["partners"] or []}
        assert i not in partners
        # Every recording that any two integers of the excerpt point to is found, at its best such offset or a longer overlap.
        for j in np.flatnonzero(((equal >= 2) & (errors <= 0.35)).any(axis=0)):
            least = np.where(equal[:, j] >= 2, errors[:, j], 1).min()
            if j != i:
                assert partners[j]["bit_error"] <= least + 1e-9
        if i < 600 and i % 60 == 0:
            near = [j for j in range(i + 1, i + 21) if errors[:, j].min() <= 0.35]
            near_pairs += len(near)
            near_found += sum(j in partners for j in near)
        mine = got[i]["match_id"]  # queries without a match count against recall, too
        own += mine is not None and errors[:, mine].min() <= errors.min() + 1e-9
    print("recall", own / 75, near_found, near_pairs)
    assert own >= 0.98 * 75 and near_found >= 0.8 * near_pairs > 0


@pytest.mark.parametrize("sizes", [(400_000, 1 << 19, 64), (300, 200, 5), (50, 1 << 19, 2)])
def test_lm_places_travel_together(spark, monkeypatch, sizes):
    """A chunk sends a row for each bucket, not for each place, and gains are the same however places are cut."""
    for name, size in zip(("BUCKET", "CHUNK", "HOT"), sizes):
        monkeypatch.setattr(lm_scoring, name, size)
    r = random.Random(8)
    lists = [[r.randrange(4) for _ in range(r.choice([0, 3, 5, 400]))] for _ in range(30)] + [[7] * 300, [1, 2, 3, 4, 5]]
    logs = [[-1 - r.random() for _ in x] for x in lists]
    rows = [(np.array(x, np.uint32), np.array(y, np.float32)) for x, y in zip(lists, logs)]
    rounds = [[bytearray(b[0].as_py()) for b in lm_scoring.by_round(x, np.array([len(x)]), y)] for x, y in rows]
    scored = spark.createDataFrame([(i, len(x), bytearray(x.tobytes()), *rounds[i]) for i, (x, _) in enumerate(rows)], "row long, n_tokens long, ids binary, " + ", ".join(f"logs{i} binary" for i in range(len(rounds[0])))).repartition(3, "row").cache()
    n = Counter((tuple(x[k - 2 : k] + x[k + 1 : k + 3]), x[k]) for x in lists for k in range(2, len(x) - 2))
    at = {}
    for (c, t), k in n.items():
        at.setdefault(c, {})[t] = k
    expected = {}
    for i, (x, y) in enumerate(zip(lists, logs)):
        for k in range(2, len(x) - 2):
            here = at[tuple(x[k - 2 : k] + x[k + 1 : k + 3])]
            if sum(here.values()) > 1:
                expected[i] = expected.get(i, 0.0) + np.log((here[x[k]] - 1 + len(here) * np.exp(y[k])) / (sum(here.values()) - 1 + len(here))) - y[k]
    got = dict(lm_scoring.remembered_everywhere(scored, Scratch(spark, "test")).collect())
    assert {i: got.get(i, 0.0) for i in range(len(lists))} == pytest.approx({i: expected.get(i, 0.0) for i in range(len(lists))}, abs=1e-3)
    if sizes[1] > 10_000:
        assert lm_scoring.spread(scored, 4, 0).count() <= 3 * (1 + 2 * 4)


def test_pre_tokens_are_encoded_many_at_a_time(monkeypatch):
    """Equal to the library's ids one by one, also where a part isn't one pre-token, with a call for each part."""
    own = packing.WordIds(vocabulary("word_bpe_49k.json"))
    found = sorted({x for t in ("It's l'été; don't pay $3.50!! 'tis ½ ß ÿ", "a1b2 \u00ad -- '' s's ¿qué? naïve ſ") for x in own.find(t.lower())})
    alone = own.encode(found)
    monkeypatch.setattr(packing, "TOGETHER", 7)
    calls, encode = [], own.encode
    monkeypatch.setattr(own, "encode", lambda texts: calls.append(len(texts)) or encode(texts))
    assert own.encode_words(found) == alone
    assert calls == [1] * -(-len(found) // 7)
    odd = ["two words", *found[:9], "x"]
    assert own.encode_words(odd) == encode(odd)
    assert own.encode_words([]) == []


@pytest.mark.parametrize("most", [1, 5, 1 << 18])
def test_lm_tokens_are_hashed_together(most, monkeypatch):
    """Tokens and their hashes are those of the words one by one, wherever texts are cut; no call is made for a short word."""
    r = random.Random(4)
    signs = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(0x300), r.randrange(0x2E00, 0x3100), r.randrange(0x10000, 0x11000)]))
    texts = [None, "", " ", "Σας ΟΔΟΣ", "\x1c\x85a b_1 ½ ²", "日本語 text\u3000c", "😀 ok 😀😀", "İstanbul", "\x00a", *("".join(signs() for _ in range(r.randrange(60))) for _ in range(300))]
    words = [[xxhash.xxh32_intdigest(w) for w in lm_scoring.SPLIT((t or "").lower())] for t in texts]
    found, counts = lm_scoring.token_hashes(texts, most)
    assert found.tolist() == [x for w in words for x in w] and counts.tolist() == [len(w) for w in words]
    long = ["a" * n + "é" * (n % 3) for n in range(40)]
    assert lm_scoring.token_hashes(long, most)[0].tolist() == [xxhash.xxh32_intdigest(w) for w in long if w]
    monkeypatch.setattr(xxhash, "xxh32_intdigest", None)
    assert len(lm_scoring.token_hashes(["short words only, fifteen bytes"] * 3, most)[0]) == 18
