"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word shingles. Sketches of
parts merge into the sketch of the whole, and two sketches estimate resemblance, containment and distinct counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K, WORDS = 128, 5


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space. Null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def sketch_of_hashes(h: Column, k: int = K) -> Column:
    """Sketch of five-word shingles, from the column of word hashes. Fewer words make one shingle, none an empty sketch."""
    rest = lambda a, n: F.slice(a, n + 1, F.greatest(F.size(h), F.lit(1)))
    two = F.zip_with(h, rest(h, 1), lambda a, b: F.xxhash64(a, b))
    four = F.zip_with(two, rest(two, 2), lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(four, rest(h, 4), lambda a, b: F.xxhash64(a, b))
    whole = F.slice(five, 1, F.greatest(F.size(h) - (WORDS - 1), F.lit(0)))
    made = F.when(F.size(h) >= WORDS, whole).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.slice(h, 1, 0))
    return F.slice(F.sort_array(F.array_distinct(made)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return sketch_of_hashes(word_hashes(text), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1; 1 for two empty sketches."""
    both = merge(a, b, k)
    hits = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(hits / F.greatest(F.size(both), F.lit(1)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    span = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / span)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 0 where a is empty."""
    j = resemblance(a, b, k)
    n, m = distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), j * (n + m) / (1 + j) / F.greatest(n, F.lit(1.0))))


def printed(a: Column) -> Column:
    """The sketch as text: 16 hex digits for each hash."""
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def merge_parts(parts: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """Sketch of each key over any number of parts, without gathering a key's parts: its k smallest distinct hashes.

    The ranking filter is applied on the map side too, so that a key with many parts sends k hashes from each task.
    Keys whose parts are all empty or null have an empty sketch.
    """
    one = parts.select(key, F.explode_outer(sketch_col).alias("x")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("x").asc_nulls_last()))
    least = one.withColumn("r", rank).where(F.col("r") <= k)
    return least.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias(sketch_col))


def _in_buckets(docs: DataFrame, rows: int = 1000, most: int = 100_000) -> DataFrame:
    """docs with a column bucket that rises with id: about `rows` documents in each, at most `most` buckets in all."""
    n, low, high = docs.agg(F.count("*"), F.min("id"), F.max("id")).first()
    if not n or low == high:
        return docs.withColumn("bucket", F.lit(0).cast("long"))
    coarse = min(256, n // rows + 1)
    fine = max(1, min(most // coarse, -(-n // (coarse * rows))))
    cuts = docs.agg(F.percentile_approx("id", [(i + 1) / coarse for i in range(coarse - 1)] or [0.5], 10_000)).first()[0]
    cuts = sorted({low, *cuts})
    ends = [*cuts[1:], high + 1]
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("id")))
    lo, hi = F.element_at(F.array(*map(F.lit, cuts)), at), F.element_at(F.array(*map(F.lit, ends)), at)
    number = lambda c: c.cast("double")  # noqa: E731  differences of longs may be too large for one
    share = (number(F.col("id")) - number(lo)) / (number(hi) - number(lo))
    return docs.withColumn("bucket", (at * fine + F.least(F.floor(share * fine), F.lit(fine - 1))).cast("long"))


def fingerprint_with_neighbour(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likenesses to each other and the next document.

    The edited text has the last floor(n / 3) code points replaced by the first as many (or all) of the next document in
    descending doc_id; the last document is followed by the first. Documents lie in buckets of neighbouring ids; the first
    document of each bucket is also a guest at the end of the bucket above, so that one exchange of the texts brings every
    document and its successor together.

    Null text counts as empty, a null doc_id comes after all others, rows of one doc_id are ordered by their text's
    hash, a single document follows itself, an empty table gives no rows and extra columns are ignored.
    """
    first = F.lit(-(2**63) + 1)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = _in_buckets(base.withColumn("id", F.coalesce("doc_id", first))).withColumn("h", F.xxhash64("text"))
    heads = base.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("head"))
    # at most 100,000 rows, as many as there are buckets
    above = F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.min("bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = heads.select("bucket", F.col("head.id").alias("id"), F.col("head.h").alias("h"), above.alias("host"))
    seats = F.filter(F.array(F.struct(F.lit(0).alias("guest"), F.col("bucket")), F.struct(F.lit(1).alias("guest"), F.col("host").alias("bucket"))), lambda s: s["bucket"].isNotNull())
    # equal rows of a head document: each is a guest, and the first of them is as good as any
    seated = base.join(F.broadcast(guests), ["bucket", "id", "h"], "left").select("doc_id", "id", "h", "text", F.explode(seats).alias("seat")).select("doc_id", "id", "h", "text", "seat.guest", "seat.bucket")

    near = seated.repartition("bucket").withColumn("hashes", word_hashes(F.col("text"))).withColumn("sketch", sketch_of_hashes(F.col("hashes"), k)).drop("hashes")
    w = Window.partitionBy("bucket").orderBy("guest", F.desc("id"), F.desc("h"))
    near = near.withColumns({"next_text": F.lead("text").over(w), "next_sketch": F.lead("sketch").over(w)}).where("guest = 0")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    near = near.withColumn("edited", F.when(cut > 0, edited).otherwise(F.col("text")))
    near = near.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next_sketch", word_hashes(F.col("edited")).alias("hashes"))
    near = near.withColumn("edited_sketch", sketch_of_hashes(F.col("hashes"), k)).drop("hashes")
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_count(F.col("sketch"), k).alias("n_shingles_estimate"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
    )
