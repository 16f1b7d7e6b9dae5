"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Whole texts and blocks of words are compared with full licence texts, standard headers and the
one-sentence templates: where a text has one of a template's phrases of three words, the block
that lies as the template does about that phrase is a piece, and so is the whole text for a full
licence. A tag ``SPDX-License-Identifier`` is read as it stands.

In addition, a file's candidate statements are its lines with one of the words that every template has at
least one of. Each is compared with each template by the cosine of their sparse TF-IDF vectors;
document frequencies are those of the corpus's own statements. The best statement at or above the
threshold licenses the file. A licence file, by its name, licenses its directory; a file without
a statement of its own inherits from the nearest directory above it that is licensed, which is
found by joining the directories' ancestors. Everything is DataFrame functions.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.scratch import kept

#: Template statements by licence identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution ShareAlike 4.0 International License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0"),
    ("Proprietary", "All rights reserved"),
]
#: Words of which every template has one; lines without any aren't compared.
TRIGGER = r"(?i)licen[cs]e|rights reserved|creative commons|permission is hereby"
#: Names of files that license their directory.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|copyright|notice)([.\-].*)?$"
WORD = "[a-z]+|[0-9]+(?:[.][0-9]+)*"
#: Full licence texts by identifier, and standard headers.
FULL_TEXTS = Path(__file__).parent / "licenses"
#: Every full text, header and template has one of these; texts without any have no piece.
BLOCK_TRIGGER = r"(?i)licen[cs]e|rights reserved|creative\s+commons|permission|redistribut"
TAG = r"</?[A-Za-z][^<>]*>"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()\- \t]*[A-Za-z0-9+)])"
RESERVED = "Proprietary"
#: What a piece was compared with; of a file's pieces at the threshold the greatest kind counts.
SENTENCE, BLOCK, WHOLE = "sentence", "block", "whole"


def statements(text: Column) -> Column:
    """Lines of a text that have a trigger word, whole. Markup and line ends separate lines."""
    lines = F.split(F.coalesce(text, F.lit("")), r"<[^>]*>|[\r\n]+")
    return F.filter(lines, lambda line: line.rlike(TRIGGER))


def words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(f"({WORD})"), F.lit(1))


def learn_idf(files: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' words over all statements, and that of any other word.

    files: a column ``lines``. What comes to the driver is as long as the templates' vocabulary.
    """
    vocabulary = sorted({w for _, t in TEMPLATES for w in re.findall(WORD, t.lower())})
    lines = files.select(F.explode("lines").alias("line"))
    n = lines.count()
    seen = lines.select(F.explode(F.array_distinct(words(F.col("line")))).alias("word")).filter(F.col("word").isin(vocabulary))
    df = dict(seen.groupBy("word").count().collect())
    idf = lambda k: math.log((2 + n) / (1 + k)) + 0.5
    return {w: idf(df.get(w, 0)) for w in vocabulary}, idf(0)


def best_template(line: Column, idf: dict[str, float], other: float) -> Column:
    """struct(score, license) of the template nearest to a line; ties by identifier."""
    table = F.create_map(*[F.lit(x) for w in sorted(idf) for x in (w, idf[w])])
    weight = lambda w: F.coalesce(F.try_element_at(table, w), F.lit(other))

    def of(found: Column) -> Column:
        distinct = F.array_distinct(found)
        weighed = F.transform(distinct, lambda w: F.struct(w.alias("w"), (F.size(F.filter(found, lambda x: x == w)) * weight(w)).alias("v")))
        norm = F.sqrt(F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))

        def scored(vector: Column) -> Column:
            scores = []
            for name, text in sorted(TEMPLATES, reverse=True):
                counts = Counter(re.findall(WORD, text.lower()))
                own = {w: k * idf[w] for w, k in counts.items()}
                size = math.sqrt(sum(v * v for v in own.values()))
                place = F.create_map(*[F.lit(x) for w in sorted(own) for x in (w, own[w] / size)])
                dot = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x["v"] * F.coalesce(F.try_element_at(place, x["w"]), F.lit(0.0)))
                scores.append(F.struct(F.round(dot, 9).alias("score"), F.lit(name).alias("license")))
            return F.aggregate(F.array(*scores[1:]), scores[0], lambda a, s: F.when(s["score"] >= a["score"], s).otherwise(a))

        best = F.transform(F.array(weighed), scored)[0]
        return F.struct(F.round(best["score"] / F.nullif(norm, F.lit(0.0)), 9).alias("score"), best["license"].alias("license"))

    return F.transform(F.array(words(line)), of)[0]


def block_templates() -> list[tuple[str, str, list[str]]]:
    """identifier, kind and words of every full text, header and sentence."""
    full = [(f.stem, WHOLE, f.read_text()) for f in sorted(FULL_TEXTS.glob("*.txt"))]
    headers = [(*line.split("\t"),) for line in (FULL_TEXTS / "headers.tsv").read_text().splitlines()]
    texts = full + [(name, BLOCK, text) for name, text in headers] + [(name, SENTENCE, text) for name, text in TEMPLATES]
    return [(name, kind, re.findall(WORD, re.sub(TAG, " ", text).lower())) for name, kind, text in texts]


def block_phrases(templates: list[tuple[str, str, list[str]]], zones: int = 6) -> list[tuple[str, int, int]]:
    """phrase, template's number and place in it: the rarest of three words in each zone, all of a sentence.

    Several zones are named so that a changed name or year loses one phrase and not the template.
    """
    cut = [[" ".join(w[i : i + 3]) for i in range(len(w) - 2)] for _, _, w in templates]
    seen = Counter(p for phrases in cut for p in phrases)
    out = []
    for t, phrases in enumerate(cut):
        n = len(phrases) if templates[t][1] == SENTENCE else zones
        for z in range(n):
            places = range(z * len(phrases) // n, (z + 1) * len(phrases) // n)
            at = min(places, key=lambda i: (seen[phrases[i]], i))
            out.append((phrases[at], t, at))
    return out


def listed(spark: SparkSession, rows: list[tuple], **types: str) -> DataFrame:
    """A table of a few thousand rows at most, made by the JVM from one literal, without Python workers."""
    text = json.dumps([dict(zip(types, r)) for r in rows])
    kind = ",".join(f"{name}:{t}" for name, t in types.items())
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{kind}>>")).alias("r")).select("r.*")


def match_blocks(files: DataFrame, threshold: float) -> DataFrame:
    """digest, block struct(kind, score, license) of the texts with a piece at the threshold.

    files: digest, text; equal digests are equal texts. Word counts are damped by their logarithm;
    document frequencies are those of the pieces and the templates. What comes to the driver is
    as long as the templates' vocabulary.
    """
    spark, templates = files.sparkSession, block_templates()
    phrases = block_phrases(templates)
    placed = listed(spark, [(p, t, at, len(templates[t][2]), templates[t][1]) for p, t, at in phrases], phrase="string", t="int", place="int", n="int", kind="string")
    names = sorted({p for p, _, _ in phrases})

    def cut(found: Column) -> Column:
        threes = F.transform(found, lambda w, i: F.struct(i.alias("at"), F.concat_ws(" ", w, F.get(found, i + 1), F.get(found, i + 2)).alias("phrase")))
        return F.struct(found.alias("words"), F.filter(threes, lambda x: x["phrase"].isin(names)).alias("hits"))

    texts = files.select("digest", F.transform(F.array(words(F.regexp_replace("text", TAG, " "))), cut)[0].alias("c"))
    hits = texts.select("digest", "c.words", F.explode("c.hits").alias("hit")).select("digest", "words", "hit.at", "hit.phrase").join(F.broadcast(placed), "phrase")
    start = F.col("at") - F.col("place")
    inside = (F.col("kind") != SENTENCE) | ((start >= 0) & (start + F.col("n") <= F.size("words")))
    blocks = hits.filter(inside).select("digest", "t", start.alias("start"), "n", "words")
    wholes = hits.filter(F.col("kind") == WHOLE).select("digest", "t", F.lit(0).alias("start"), F.size("words").alias("n"), "words")
    key = ["digest", "t", "start", "n"]
    piece = F.slice("words", F.greatest("start", F.lit(0)) + 1, F.col("n") + F.least("start", F.lit(0)))
    pieces = kept(blocks.union(wholes).select(*key, piece.alias("piece")).groupBy(*key).agg(F.first("piece").alias("piece")))

    counted = [Counter(w) for _, _, w in templates]
    own = Counter(w for c in counted for w in c)
    vocabulary = F.broadcast(listed(spark, [(w,) for w in sorted(own)], word="string"))
    df = Counter(dict(pieces.select(F.explode(F.array_distinct("piece")).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").count().collect()))
    n = pieces.count() + len(templates)
    idf = {w: math.log((1 + n) / (1 + df[w] + own[w])) + 0.1 for w in own}
    other = math.log(1 + n) + 0.1
    weights = []
    for t, c in enumerate(counted):
        vector = {w: (1 + math.log(k)) * idf[w] for w, k in c.items()}
        size = math.sqrt(sum(v * v for v in vector.values()))
        weights += [(t, w, v / size) for w, v in sorted(vector.items())]
    spread = pieces.select(*key, F.explode("piece").alias("word")).groupBy(*key, "word").agg(F.count(F.lit(1)).alias("k"))
    spread = spread.join(F.broadcast(listed(spark, sorted(idf.items()), word="string", idf="double")), "word", "left")
    spread = spread.join(F.broadcast(listed(spark, weights, t="int", word="string", weight="double")), ["t", "word"], "left")
    value = (1 + F.log("k")) * F.coalesce("idf", F.lit(other))
    scored = spread.groupBy(*key).agg((F.sum(value * F.coalesce("weight", F.lit(0.0))) / F.sqrt(F.sum(value * value))).alias("score"))
    kinds = [(t, name, 0 if name == RESERVED else 1 if kind == SENTENCE else 2) for t, (name, kind, _) in enumerate(templates)]
    scored = scored.join(F.broadcast(listed(spark, kinds, t="int", license="string", kind="int")), "t")
    enough = scored.filter(F.col("score") >= threshold)
    return enough.groupBy("digest").agg(F.max(F.struct("kind", F.round("score", 9).alias("score"), "license")).alias("block"))


def spdx(text: Column) -> Column:
    """The expression of a text's first SPDX tag; a lone identifier without -only, -or-later and +."""
    stated = F.regexp_replace(F.trim(F.regexp_extract(text, SPDX, 1)), r"\s+", " ")
    return F.nullif(F.regexp_replace(stated, r"(?i)^([^ ]+?)(-only|-or-later|\+)$", "$1"), F.lit(""))


def dealt_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str, spread: int = 100_000) -> DataFrame:
    """rows joined with ``table``, which has one row for each ``key`` at most.

    A key that more than ``spread`` rows have is dealt to as many parts as it needs, by ``by``.
    """
    wide = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / spread).cast("int").alias("_parts")).filter("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = table.join(wide, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    split = rows.join(wide, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    return split.join(dealt, [key, "_part"], how).drop("_part")


def url_path(url: Column) -> Column:
    """Host and path of a URL, without scheme, query and fragment; a plain path stays."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")


def scan_licenses(files: DataFrame, id_col: str, path_col: str, text_col: str, threshold: float = 0.5) -> DataFrame:
    """Licences of files: id, directory, own_license, own_score, license, origin, from_directory.

    own_license is, if there is one, the SPDX tag's expression (score 1); else the best full text
    or header at ``threshold``; else the best sentence, as a line or a block, at ``threshold``
    (ties by identifier); else null. That all rights are reserved counts after any block's other
    licence. origin is ``own``, ``inherited`` or ``none``; from_directory tells
    where an inherited licence comes from. A directory is licensed by its licence files, or by a
    file that is the directory itself (a path that ends in a slash); of several the best score
    counts, then the identifier. A null path or text counts as empty; a file at the root has the
    directory "". Texts of any length are read whole. Null ids and repeated rows stay as they are; an
    empty table gives an empty one; other columns are not read.
    """
    path, text = url_path(F.col(f"`{path_col}`")), F.col(f"`{text_col}`")
    name = F.element_at(F.split(path, "/"), -1)
    plain = files.select(
        F.col(f"`{id_col}`").alias("id"),
        F.regexp_replace(path, "/*[^/]*$", "").alias("directory"),
        (name.rlike(LICENSE_FILE) | (name == "")).alias("licenses"),
        statements(text).alias("lines"),
        # A text without any block has a value of its own, so that such rows don't meet in one task.
        F.when(text.rlike(BLOCK_TRIGGER), F.sha2(text, 256)).otherwise(F.hex(F.xxhash64(F.col(f"`{id_col}`"), path))).alias("digest"),
        spdx(text).alias("spdx"),
    )
    blocks = match_blocks(files.select(text.alias("text")).filter(text.rlike(BLOCK_TRIGGER)).select(F.sha2("text", 256).alias("digest"), "text"), threshold)
    idf, other = learn_idf(plain)
    empty = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("license"))
    found = F.aggregate(F.transform("lines", lambda line: best_template(line, idf, other)), empty, lambda a, s: F.when((s["score"] > a["score"]) | ((s["score"] == a["score"]) & (s["license"] < a["license"])), s).otherwise(a))
    scanned = plain.select("id", "directory", "licenses", "digest", "spdx", found.alias("found")).join(blocks, "digest", "left")
    enough = F.col("found.score") >= threshold
    later = F.col("found.license") == RESERVED
    block = F.col("block.score").isNotNull() & ((F.col("block.kind") == 2) | ~F.coalesce(enough, F.lit(False)) | (F.col("block.score") > F.col("found.score")) | (later & (F.col("block.score") >= F.col("found.score"))))
    pick = lambda name, tagged: F.when(F.col("spdx").isNotNull(), tagged).when(block, F.col(f"block.{name}")).when(enough, F.col(f"found.{name}"))
    scanned = kept(scanned.select("id", "directory", "licenses", pick("license", F.col("spdx")).alias("own_license"), pick("score", F.lit(1.0)).alias("own_score")))

    # A group's files are pre-added in each task, so a directory with a third of all files is a row.
    best = F.max(F.when(F.col("licenses") & F.col("own_license").isNotNull(), F.struct("own_score", "own_license")))
    directories = scanned.groupBy("directory").agg(best["own_license"].alias("license"))
    parts = F.split("directory", "/")
    # Depth 0 is the root "", which a first part "" (the root itself, or an absolute path) names too.
    ancestors = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.when(F.concat_ws("/", F.slice(parts, F.lit(1), k)) == "", F.lit(0)).otherwise(k).alias("depth"), F.concat_ws("/", F.slice(parts, F.lit(1), k)).alias("above"))))
    licensed = directories.filter("license is not null").select(F.col("directory").alias("above"), "license")
    upward = directories.select("directory", F.explode(ancestors).alias("a")).select("directory", "a.depth", "a.above")
    nearest = dealt_join(upward, licensed, "above", "directory", "inner").groupBy("directory").agg(F.max(F.struct("depth", "above", "license")).alias("n"))
    out = dealt_join(scanned, nearest, "directory", "id", "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "directory",
        "own_license",
        "own_score",
        F.coalesce("own_license", "n.license").alias("license"),
        F.when(own, "own").when(F.col("n.license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("n.above")).alias("from_directory"),
    )
