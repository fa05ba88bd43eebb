"""Op 5: document fingerprints as bottom-k sketches of word shingles, by DataFrame functions only.

A sketch is the ascending list of the k smallest distinct 64-bit hashes of a text's shingles. Sketches merge by taking
the k smallest of both; resemblance, containment and the number of distinct shingles are estimated from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WORDS = 128, 5
#: Rows of a bucket, and the most buckets, as their bounds are part of the plan; beyond 32 million rows buckets grow, and what does not fit memory spills.
BUCKET_ROWS, MOST_BUCKETS = 4_000, 8_192


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """array<bigint>: shingles of `words` words [^ \\t-\\r]+, fewer words being one shingle; null and blank texts have none."""
    w = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.transform(w, lambda x: F.xxhash64(x))
    return _bottom(
        F.transform(
            F.filter(F.array(h), lambda a: F.size(a) > 0),
            lambda a: F.transform(F.sequence(F.lit(1), F.greatest(F.size(a) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(a, i, words))),
        ),
        k,
    )


def _bottom(nested: Column, k: int) -> Column:
    return F.slice(F.array_distinct(F.sort_array(F.flatten(nested))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold; 1 for two empty sketches."""
    both = F.transform(F.array(merge(a, b, k)), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both[0])


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the hash range."""
    place = (F.element_at(a, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; 1 for an empty a."""
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct(a, k)))


def text_of(a: Column) -> Column:
    """A sketch as a string: its hashes in hexadecimal, 16 digits each, one after the other, in base 64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def with_next(docs: DataFrame, columns: list[str], bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Window]:
    """docs with `bucket` and `guest`, and the window in which lead() finds a row's successor by ascending doc_id, the last one's being the first.

    Buckets are ranges of (doc_id) between approximate quantiles, so rows meet in one shuffle and none is ordered as a
    whole. A bucket's first row also goes to the bucket before as its guest. Only cut points, one for each bucket_rows
    rows, reach the driver. Rows that repeat a doc_id share a bucket and are ordered by their text; a null doc_id is the
    smallest.
    """
    n = docs.count()
    id_ = F.coalesce(F.col("doc_id"), F.lit(-(2**63) + 1))
    parts = min(max(1, -(-n // bucket_rows)), MOST_BUCKETS)
    cuts = docs.select(F.percentile_approx(id_, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    bucket = _place(id_, sorted(set(cuts)))
    firsts = sorted((r.bucket, r.low) for r in docs.select(bucket.alias("bucket"), id_.alias("i")).groupBy("bucket").agg(F.min("i").alias("low")).collect())
    places = [b for b, _ in firsts]
    before = F.expr(f"map_from_arrays({_longs([low for _, low in firsts])}, {_longs([*places[-1:], *places[:-1]])})")
    d = docs.select("doc_id", *columns, id_.alias("__id"), bucket.alias("bucket"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("__tie"))
    d = d.withColumn("__to", F.explode(F.array_compact(F.array(F.lit(-1).cast("bigint"), F.try_element_at(before, F.col("__id"))))))
    d = d.withColumn("guest", F.col("__to") >= 0).withColumn("bucket", F.when(F.col("guest"), F.col("__to")).otherwise(F.col("bucket"))).drop("__to")
    return d, Window.partitionBy("bucket").orderBy("guest", "__id", "__tie")


def _longs(values: list[int]) -> str:
    return f"cast(array({','.join(f'{v}L' for v in values)}) as array<bigint>)"


def _place(x: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are below x, by a two-level search."""
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    table = f"cast(array({','.join(map(_longs, groups))}) as array<array<bigint>>)"
    g = F.size(F.filter(F.expr(_longs([g[-1] for g in groups])), lambda c: c < x))
    inside = F.size(F.filter(F.coalesce(F.try_element_at(F.expr(table), g + 1), F.expr(_longs([]))), lambda c: c < x))
    return (g * step + inside).cast("bigint")


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document's by ascending doc_id; the last one's next is the first, a lone document's is itself. Null texts are
    empty. Rows of one doc_id follow each other by their texts' hash; other columns are ignored.
    """
    d, order = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["text"], bucket_rows)
    d = d.withColumn("next", F.lead("text").over(order)).withColumn("a", sketch(F.col("text"), k, words))
    d = d.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next", F.lit(1), half))
    d = d.withColumn("edited", edited).select("doc_id", "bucket", "guest", "__id", "__tie", "n_chars", "a", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited"), k, words).alias("e"))
    d = d.withColumn("b", F.lead("a").over(order)).where(~F.col("guest"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("a")).alias("fingerprint"), text_of(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("e"), k).alias("near_edited"), resemblance(F.col("a"), F.col("b"), k).alias("near_next"),
    )
