"""Document fingerprints by I-Match over several randomised lexicons, in DataFrame functions only.

Terms are lower-cased runs of letters and digits, as 64-bit hashes. A term whose share of documents
lies within a band of inverse document frequency is in the lexicon: neither the terms of nearly
every document nor those of a few. Shares don't depend on the number of documents, so the band
means the same at any size, and there are at most as many such terms as a document has on average,
divided by the least share. The lexicon is held as a bitmap of 64 places or more for each of them,
2 MB at most; a term outside that falls on a place of one inside, one in 64 or fewer, is taken for it.

A document's lexicon terms, distinct and sorted, are hashed as one value, and once more for each
randomised subset of the lexicon: ``families`` random orders, each cut to a quarter, a sixteenth
and so on for ``levels`` steps. Two texts agree on a subset exactly if their terms within it are
the same; dense subsets agree on copies, sparse ones as often as the texts have terms in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.llm.scratch import kept

#: Bits of a place's number: the lexicon's bitmap has 2**16 places at least, and 2**24 at most.
LEAST_BITS, MOST_BITS = 16, 24
WIDTH = 6  # hexadecimal digits of one value
NONE = "-" * WIDTH


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's terms."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(F.array_distinct(words), lambda w: w != ""), lambda w: F.xxhash64(w))


def place(term: Column, bits: int) -> Column:
    return term.bitwiseAND(F.lit((1 << bits) - 1))


def learn_lexicon(docs: DataFrame, least_share: float = 0.001, most_share: float = 0.2, text_col: str = "text") -> list[int]:
    """The lexicon as words of 64 bits, a power of two of them, from all documents.

    A term is in it if at least ``least_share`` and at most ``most_share`` of the documents have
    it (at least one document). Documents are counted by term, pre-added in each task.
    """
    counts = docs.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n = docs.count()
    chosen = kept(counts.filter((F.col("n") >= max(1, least_share * n)) & (F.col("n") <= max(1, most_share * n))).select("term"))
    bits = min(MOST_BITS, max(LEAST_BITS, (64 * chosen.count()).bit_length()))
    spot = place(F.col("term"), bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))
    words = chosen.groupBy(F.call_function("shiftright", spot, F.lit(6)).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits"))
    lexicon = [0] * (1 << bits - 6)
    for at, found in words.collect():  # at most 2**18 rows
        lexicon[at] = found
    return lexicon


def fingerprint(text: Column, lexicon: list[int], families: int = 16, levels: int = 6) -> Column:
    """The fingerprint of a text: a string of 1 + families * levels values.

    A text without a lexicon term has, in place of them, a hash of its whole self.
    """
    bitmap = F.split(F.lit(",".join(map(str, lexicon))), ",").cast("array<bigint>")
    bits = len(lexicon).bit_length() + 5

    def listed(t: Column) -> Column:
        at = place(t, bits)
        return F.call_function("shiftright", F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    kept = F.array_sort(F.filter(terms(text), listed))
    value = lambda subset: F.when(F.size(subset) == 0, F.lit(NONE)).otherwise(F.substring(F.lpad(F.hex(F.xxhash64(subset)), 16, "0"), 1, WIDTH))

    def family(own: Column, seed: int) -> Column:
        """Values of one random order's nested quarters."""
        start = F.struct(own.alias("left"), F.lit("").alias("out"))

        def quarter(state: Column, level: Column) -> Column:
            left = F.filter(state["left"], lambda t: F.call_function("shiftright", F.xxhash64(t, F.lit(seed)), level).bitwiseAND(F.lit(3)) == 0)
            return F.struct(left.alias("left"), state["out"].alias("out"))

        def named(state: Column, level: Column) -> Column:
            return F.transform(F.array(quarter(state, level)), lambda s: F.struct(s["left"].alias("left"), F.concat(s["out"], value(s["left"])).alias("out")))[0]

        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * levels - 2), F.lit(2)), start, named, lambda s: s["out"])

    def whole(own: Column) -> Column:
        return F.concat(value(own), *[family(own, seed) for seed in range(families)])

    found = F.element_at(F.transform(F.array(kept), whole), 1)  # the terms are computed once
    bare = F.concat(F.lit("="), F.sha2(F.coalesce(text, F.lit("")), 256))
    return F.transform(F.array(found), lambda x: F.when(x.startswith(NONE), bare).otherwise(x))[0]


def likeness(a: Column, b: Column, families: int = 16, levels: int = 6) -> Column:
    """Share of families whose sparsest subset with a term of either text is the same in both; 0 to 1.

    That subset holds the one or two terms of either text that its random order puts first, so
    the share follows the terms that the texts have in common. Equal fingerprints give 1, and a
    text without lexicon terms is like its equals only.
    """
    piece = lambda s, i: s.substr(i * WIDTH + 1, F.lit(WIDTH))
    deepest = lambda f: F.array_max(F.filter(F.sequence(f * levels + 1, f * levels + levels), lambda i: (piece(a, i) != NONE) | (piece(b, i) != NONE)))
    # Where all of a family's subsets are empty, the whole lists are compared.
    used = F.transform(F.sequence(F.lit(0), F.lit(families - 1)), lambda f: F.coalesce(deepest(f), F.lit(0)))
    share = F.size(F.filter(used, lambda i: piece(a, i) == piece(b, i))) / F.lit(families)
    return F.when(a == b, F.lit(1.0)).when(a.startswith("=") | b.startswith("=") | a.isNull() | b.isNull(), F.lit(0.0)).otherwise(share)


#: Rows of one id and one bucket number up to which the buckets' starts are broadcast (some 32 MB).
MOST_BROADCAST = 1_000_000
FAN_BITS = 9  # 512 buckets of one level make one of the next
BUCKET_BITS = 7  # a bucket is 128 consecutive ids


def successors(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, to: the first id of each bucket of ids, and the bucket before it that holds rows; and their number.

    The first bucket's goes to the last. Buckets are searched level by level: within 512
    neighbours a window of as many rows at most finds the one before; the first of them is looked
    for among the next level's. So no window grows with the table, however sparse the ids.
    """
    bucket = F.shiftright("doc_id", BUCKET_BITS)
    level = kept(docs.select("doc_id").filter("doc_id is not null").groupBy(bucket.alias("last")).agg(F.min("doc_id").alias("first")).withColumn("b", F.col("last") + (1 << 57)))  # never negative
    found, n = [], level.count()
    while True:
        w = W.partitionBy(F.shiftright("b", FAN_BITS)).orderBy("b")
        found.append(level.withColumn("to", F.lag("last").over(w)).filter("to is not null").select(F.col("first").alias("doc_id"), "to"))
        if level.limit(2).count() < 2:
            found.append(level.select(F.col("first").alias("doc_id"), F.col("last").alias("to")))
            break
        level = kept(level.groupBy(F.shiftright("b", FAN_BITS).alias("b")).agg(F.min("first").alias("first"), F.max("last").alias("last")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out, n


def bucketed(docs: DataFrame) -> DataFrame:
    """docs with ``bucket`` and ``guest``, so that each row's successor by id is in its bucket.

    Ids fall in buckets of 2**BUCKET_BITS consecutive values, so that no group grows with the
    table. The first row of each bucket goes to the bucket before it too, as a guest that only
    serves as a successor. The starts of buckets are broadcast if their count allows, and joined
    by id otherwise. Rows with a null id have no bucket.
    """
    before, n = successors(docs)
    guests = docs.join(F.broadcast(before) if n <= MOST_BROADCAST else before, "doc_id").select(*docs.columns, F.col("to").alias("bucket"), F.lit(1).alias("guest"))
    return docs.select("*", F.shiftright("doc_id", BUCKET_BITS).alias("bucket"), F.lit(0).alias("guest")).unionByName(guests)


def followed(both: DataFrame, carried: list[str]) -> DataFrame:
    """Bucketed rows without guests and, for each carried column c, ``next_c`` of the row with the next id.

    The last row's next is the first. Rows of one id follow each other by the hash of what they
    carry; a row with a null id has no next.
    """
    # Rows without a bucket are dealt out alone, each by what it carries.
    alone = F.when(F.col("bucket").isNull(), F.xxhash64(*carried))
    w = W.partitionBy("bucket", alone).orderBy("guest", "doc_id", F.xxhash64(*carried))
    after = lambda c: F.when(F.col("bucket").isNotNull(), F.lead(c).over(w)).alias(f"next_{c}")
    return both.select("*", *map(after, carried)).filter("guest = 0").drop("bucket", "guest")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    Edited: the last floor(n/2) code points give way to the first as many, or all, of the next
    document by id (after the last: the first). Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as empty, and a
    text of any length is read whole; equal texts have equal fingerprints; repeated rows follow
    each other, ties among them by their hash; a row with a null id has no next, so its edited
    text loses its end; an empty table gives an empty one; other columns are not read.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    lexicon = learn_lexicon(plain)
    rows = followed(bucketed(plain).withColumn("fingerprint", fingerprint(F.col("text"), lexicon)), ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), half))
    out = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), lexicon).alias("edited_fingerprint"), "next_fingerprint")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
