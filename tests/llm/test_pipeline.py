import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latticework.llm import packing
from latticework.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    w = text.encode().lower().split()
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents of two languages, toxic ones, exact and near copies, nulls and texts without letters."""
    r = random.Random(6)
    parts = {"en": ["th", "ing", "er", "on", "an"], "de": ["sch", "ein", "ung", "keit"]}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randint(2, 5)))
    rows, labels = [], []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        words = [word(lang) for _ in range(60)]
        if i % 10 == 9:
            words[7] = words[31] = "vileword"
        rows.append([i, " ".join(words), lang, f"src{i % 3}", 0])
        labels.append((i, 1, int(i % 10 == 9)))
    near = rows[1][1].split()
    near[3] = "changed"
    rows += [[300, rows[0][1], "de", "s", 0], [301, " ".join(near), "en", "s", 0], [302, None, "en", "s", 0], [303, "123 !!", "en", "s", 0], [304, "", None, None, 0]]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([tuple(x) for x in rows], DOCS).withColumn("key", F.lit("clash"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {x[0]: x[1] for x in rows}


def test_stages_follow_each_other(spark, corpus):
    folder, texts = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "ngram_jaccard", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        if name == "toxicity":
            expected = {i for i in expected if "vileword" not in texts[i]}
        if name == "ngram_jaccard":
            for i in sorted(expected):
                a = shingles(texts[i])
                for j in sorted(expected):
                    if j < i and len(a & shingles(texts[j])) * 100 >= 80 * len(a | shingles(texts[j])):
                        expected.discard(i)
            assert 300 not in expected and 301 not in expected
        assert sorted(r["doc_id"] for r in after.select("doc_id").collect()) == sorted(expected), name
        docs = after
    got = {tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "doc_tokens").distinct().collect()}
    alone = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))
    assert got == {tuple(r) for r in alone.select("doc_id", "doc_tokens").distinct().collect()}
    assert {i for i, _ in got} == expected


def test_empty_corpus(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeats_ties_one_id_and_long_texts(spark, corpus, tmp_path):
    """Repeated rows fall to one; an id's different texts both stay; of equal texts the least id stays; a long text is whole."""
    folder, texts = corpus
    r = random.Random(1)
    own = " ".join(f"{r.choice(['thing', 'eron', 'anth'])}{r.choice(['ing', 'on'])} {r.choice(['eran', 'thon'])}" for _ in range(60))
    long = " ".join("".join(r.choice(["th", "ing", "er", "on", "an"]) for _ in range(4)) for _ in range(30_000))
    more = [(1, texts[1], "en", "s", 0), (4, own, "en", "s", 0), (800, texts[5], "en", "s", 0), (700, texts[5], None, None, None), (900, long, "en", "s", 0), (None, own, "en", "s", 0)]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.unionByName(spark.createDataFrame(more, DOCS).withColumn("key", F.lit("clash"))).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {}
    for x in pieces:
        tokens.setdefault((x["doc_id"], x["doc_tokens"]), []).append((x["start"], x["length"]))
    for (_, n), parts in tokens.items():
        end = 0
        for start, length in sorted(parts):
            assert start == end
            end += length
        assert end == n
    ids = [i for i, _ in tokens]
    assert ids.count(1) == 1 and ids.count(4) == 2 and 5 in ids and 700 not in ids and 800 not in ids and ids.count(None) == 1
    assert max(n for i, n in tokens if i == 900) > 30_000
