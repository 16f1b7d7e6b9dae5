"""The DataFrame-only operators against plain Python versions."""

import math
import random
import re
import struct
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from latticework.llm import imatch, license_scan


def spark_hash(*values):
    """Spark's xxhash64 of strings, 64-bit and (as tuples) 32-bit integers."""
    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        h = xxhash.xxh64_intdigest(raw, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def term_hashes(text):
    return {spark_hash(w) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def test_fingerprints_equal_a_plain_version(spark):
    r = random.Random(12)
    words = [f"w{i}" for i in range(400)] + ["Été", "naïve", "ünder", "42"]
    texts = [" ".join(r.choice(words[: r.choice([30, 404])]) for _ in range(r.randint(0, 120))) + r.choice(["", "!", " – x"]) for _ in range(120)] + ["", "!!!"]
    docs = spark.createDataFrame([(i * 37, t) for i, t in enumerate(texts)], "doc_id long, text string")
    mask = (1 << imatch.LEAST_BITS) - 1
    counts = Counter(h for t in texts for h in term_hashes(t))
    inside = {h & mask for h, n in counts.items() if max(1, 0.001 * len(texts)) <= n <= max(1, 0.2 * len(texts))}
    lexicon = imatch.learn_lexicon(docs)
    assert {64 * i + b for i, word in enumerate(lexicon) for b in range(64) if word >> b & 1} == inside

    def value(subset):
        return format(spark_hash(*subset) % (1 << 64), "016X")[: imatch.WIDTH] if subset else imatch.NONE

    def plain(text):
        kept = sorted(h for h in term_hashes(text) if h & mask in inside)
        if not kept:
            return None
        out = [value(kept)]
        for seed in range(16):
            left = kept
            for level in range(6):
                left = [h for h in left if spark_hash(h, (seed,)) >> 2 * level & 3 == 0]
                out.append(value(left))
        return "".join(out)

    def alike(a, b):
        if a == b:
            return 1.0
        if a.startswith("=") or b.startswith("="):
            return 0.0
        piece = lambda s, i: s[i * imatch.WIDTH : (i + 1) * imatch.WIDTH]
        same = 0
        for f in range(16):
            used = [i for i in range(f * 6 + 1, f * 6 + 7) if piece(a, i) != imatch.NONE or piece(b, i) != imatch.NONE]
            i = max(used, default=0)
            same += piece(a, i) == piece(b, i)
        return same / 16

    rows = sorted(imatch.fingerprint_edits(docs).collect())
    assert len(rows) == len(texts)
    for i, row in enumerate(rows):
        after = texts[(i + 1) % len(texts)]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + after[:half]
        for text, got in ((texts[i], row["fingerprint"]), (edited, row["edited_fingerprint"])):
            assert got == plain(text) if plain(text) else got.startswith("=")
        assert row["near_edited"] == pytest.approx(alike(row["fingerprint"], row["edited_fingerprint"]))
        assert row["near_next"] == pytest.approx(alike(row["fingerprint"], rows[(i + 1) % len(rows)]["fingerprint"]))


@pytest.mark.parametrize("spread", [1, 1000, 2**44])
def test_successors_of_dense_and_sparse_ids(spark, spread):
    r = random.Random(spread)
    ids = sorted(r.sample(range(-500 * spread, 500 * spread), 300)) if spread > 1 else list(range(300))
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids] + [(None, "a"), (None, "b"), (ids[5], "again")], "doc_id long, text string")
    starts, n = imatch.successors(docs)
    assert n == starts.count() == len({i // 128 for i in ids})
    got = imatch.followed(imatch.bucketed(docs), ["text"]).collect()
    assert len(got) == 303
    after = {x["text"]: x["next_text"] for x in got if x["text"] not in ("again", f"t{ids[5]}")}
    assert after.pop("a") is None and after.pop("b") is None
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        if i != ids[5]:
            assert after[f"t{i}"] in ((f"t{j}", "again") if j == ids[5] else (f"t{j}",))


def test_licences_equal_a_plain_version(spark):
    r = random.Random(3)
    parts = ["a", "b", "c"]
    lines = [t for _, t in license_scan.TEMPLATES] + ["a licence of our own", "license unknown", "nothing at all", "See the License, version 2"]
    files = []
    for i in range(150):
        folder = "/".join(r.choice(parts) for _ in range(r.randint(0, 3)))
        name = r.choice(["LICENSE", "copying.txt", "x.py", "y.c", "z"])
        body = "\n".join(r.choice(lines) if r.random() < 0.4 else "code" for _ in range(3))
        files.append((i, f"{folder}/{name}" if folder else name, body))

    words = lambda line: re.findall(license_scan.WORD, line.lower())
    stated = {i: [x for x in body.split("\n") if re.search(license_scan.TRIGGER, x)] for i, _, body in files}
    every = [x for found in stated.values() for x in found]
    vocabulary = {w for _, t in license_scan.TEMPLATES for w in words(t)}
    seen = Counter(w for x in every for w in set(words(x)))
    idf = {w: math.log((2 + len(every)) / (1 + seen[w])) + 0.5 for w in vocabulary}
    other = math.log(2 + len(every)) + 0.5
    vector = lambda line: {w: n * idf.get(w, other) for w, n in Counter(words(line)).items()}

    def cosine(a, b):
        size = lambda v: math.sqrt(sum(x * x for x in v.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / (size(a) * size(b))

    own = {}
    for i, found in stated.items():
        scores = [(round(cosine(vector(x), vector(t)), 6), name) for x in found for name, t in license_scan.TEMPLATES]
        best = max(scores, key=lambda s: s[0], default=(0, None))
        own[i] = [name for score, name in scores if score == best[0]] if best[0] >= 0.5 else []
    got = {x["id"]: x for x in license_scan.scan_licenses(spark.createDataFrame(files, "id long, path string, body string"), "id", "path", "body").collect()}
    assert len(got) == len(files)
    licensed = {}
    for i, path, _ in files:
        assert (got[i]["own_license"] in own[i]) if own[i] else got[i]["own_license"] is None
        folder, _, name = path.rpartition("/")
        if re.match(license_scan.LICENSE_FILE, name) and own[i]:
            licensed.setdefault(folder, set()).add(got[i]["own_license"])
    for i, path, _ in files:
        if own[i]:
            assert got[i]["origin"] == "own"
            continue
        folder = path.rpartition("/")[0]
        while folder and folder not in licensed:
            folder = folder.rpartition("/")[0]
        if folder in licensed:
            assert got[i]["origin"] == "inherited" and got[i]["from_directory"] == folder and got[i]["license"] in licensed[folder]
        else:
            assert got[i]["origin"] == "none" and got[i]["license"] is None


def test_headers_and_licence_files_are_found(spark):
    full = {f.stem: f.read_text() for f in license_scan.FULL_TEXTS.glob("*.txt")}
    headers = [line.split("\t") for line in (license_scan.FULL_TEXTS / "headers.tsv").read_text().splitlines()]
    rows, want = [], {}

    def add(path, body, name):
        want[len(rows)] = name
        rows.append((len(rows), path, body))

    code = "\n".join(f"x{i} = compute(y{i})  # step {i}" for i in range(60))
    for name, text in full.items():
        add(f"{name}/LICENSE", "Copyright (c) 2019 A. Person. All rights reserved.\n\n" + text, name)
        add(f"{name}/src/a.py", code, None)
    for name, text in headers:
        lines = re.findall(r".{1,60}(?:\s|$)", text)
        add("h/a.c", "/*\n * Copyright 2020 A. Person\n" + "".join(f" * {x}\n" for x in lines) + " */\n" + code, name)
        add("h/a.xml", f"<!-- {text} -->\n<a>{code}</a>", name)
    add("s/a", "# SPDX-License-Identifier: MIT\n" + code, "MIT")
    add("s/b", "/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0")
    add("s/c", "// SPDX-License-Identifier: Apache-2.0 OR ISC\n", "Apache-2.0 OR ISC")
    add("s/d", "<p>This text was put together by many people over some years and is licensed under CC BY-SA 4.0 by all of them, whoever they may be.</p>", "CC-BY-SA-4.0")
    add("s/e", "\n".join("the license of a driver is subject to the terms of the state and permission is given by the office" for _ in range(40)), None)
    got = {r["id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "id long, path string, body string"), "id", "path", "body").collect()}
    assert {i: r["own_license"] for i, r in got.items()} == want
    for i, path, _ in rows:
        if path.endswith("/src/a.py"):
            assert (got[i]["license"], got[i]["origin"]) == (path.split("/")[0], "inherited")
    assert all(re.search(license_scan.BLOCK_TRIGGER, " ".join(w)) for _, _, w in license_scan.block_templates())


def test_ties_and_long_files(spark):
    """Of equal scores the smaller identifier counts, whatever the order; a long file is read to its end."""
    mit, bsd = "Released under the MIT License", "Licensed under the BSD 3-Clause License"
    long = "plain words of no meaning here\n" * 60_000
    rows = [(1, "a/x", f"{mit}\n{bsd}"), (2, "b/x", f"{bsd}\n{mit}"), (3, "c/x", long + mit), (4, "d/x", long), (5, "e/x", None), (6, None, mit), (6, None, mit), (None, "f/x", "")]
    files = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("license", "digest", "lines", "directory", "found", "_part"):
        files = files.withColumn(name, F.lit("clash"))
    got = [(x["page_id"], x["own_license"], x["own_score"]) for x in license_scan.scan_licenses(files, "page_id", "url", "html").collect()]
    by = {i: (name, score) for i, name, score in got}
    assert len(got) == len(rows) and by[1] == by[2] == ("BSD-3-Clause", pytest.approx(1.0)) and by[3][0] == "MIT" and by[4][0] is by[5][0] is by[None][0] is None and by[6][0] == "MIT"
    assert license_scan.scan_licenses(files.limit(0), "page_id", "url", "html").collect() == []
