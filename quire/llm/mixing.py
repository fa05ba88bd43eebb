"""Op 4: mixing sources to target weights by capped water-filling.

Each source's target is level * weight, clamped at max_epochs times its size, the level rising until the targets sum to
the budget. A source is taken in whole repetitions plus a seeded fraction of one: its documents in the order of a
seeded hash until the words are used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
SEED = "quire-mix-1"


def targets(sizes: DataFrame, budget: float = 1.5, max_epochs: int = 2, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With caps c = max_epochs * size and weights w, sources fill up in the order of c / w; the level is that of the first
    number of filled sources at which no other source is above its cap, the highest of those that fit. Only this table of one row a source, an
    aggregate, is ordered as a whole.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_epochs)
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(budget))).withColumn("all_w", F.sum("w").over(whole))
    s = s.withColumn("filled", F.coalesce(F.sum("cap").over(order), F.lit(0))).withColumn("gone", F.coalesce(F.sum("w").over(order), F.lit(0)))
    s = s.withColumn("level", (F.col("total") - F.col("filled")) / (F.col("all_w") - F.col("gone")))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(whole))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, budget: float = 1.5, max_epochs: int = 2, weights=WEIGHTS, seed: str = SEED, keep: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source); keep=True gives all its columns, __size and __taken.

    Size counts words [^ \\t-\\r]+; null or empty texts have size 0. taken is a document's words in the mix with
    repetitions; the document at the end of a source's share gives part of its words. A source's documents are
    first added up by 4,096 ranges of the hash, and ordered only inside the range that the end falls into, so no
    source is sorted in one task. Ties in the hash go by doc_id; a null source is a source of its own, the last;
    an empty table gives an empty result.
    """
    d = docs if keep else docs.select("doc_id", "text", "source")
    d = d.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))
    d = d if keep else d.drop("text")
    d = d.withColumn("__u", F.sha2(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"), 256))
    d = d.withColumn("__bin", F.substring("__u", 1, 3))
    bins = d.groupBy(F.col("source").alias("source"), F.col("__bin").alias("bin")).agg(F.sum("__size").alias("bin_size"))
    level = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), budget, max_epochs, weights)
    level = level.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    level = level.withColumn("rest", (F.round("target") - F.col("whole") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    info = bins.alias("b").join(level.alias("lv"), F.col("b.source").eqNullSafe(F.col("lv.source"))).select(*[F.col(c).alias(f"__{c.split('.')[-1]}_of") for c in ("b.source", "bin", "bin_size", "before", "source_size", "target", "whole", "rest")])
    d = d.join(info, d["source"].eqNullSafe(info["__source_of"]) & (d["__bin"] == info["__bin_of"]))
    start, share, size = F.col("__before_of"), F.col("__rest_of"), F.col("__size")
    full, none = start + F.col("__bin_size_of") <= share, start >= share
    clear = d.where(full | none).withColumn("__extra", F.when(full, size).otherwise(F.lit(0)))
    inside = Window.partitionBy("source", "__bin").orderBy("__u", F.col("doc_id").asc_nulls_first(), "__size").rowsBetween(Window.unboundedPreceding, -1)
    edge = d.where(~(full | none)).withColumn("__run", start + F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    edge = edge.withColumn("__extra", F.greatest(F.lit(0), F.least(size, share - F.col("__run")))).drop("__run")
    out = clear.unionByName(edge).withColumn("__taken", F.col("__whole_of") * size + F.col("__extra"))
    if keep:
        return out.select(*docs.columns, "__size", "__taken")
    return out.select("doc_id", size.alias("size"), F.col("__source_size_of").alias("source_size"), F.col("__target_of").alias("target"), F.col("__taken").alias("taken"))


#: DuckDB SQL for mix() with its standard parameters.
SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         sha256('{SEED}' || coalesce(':' || doc_id, '')) AS u FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w, 2 * source_size AS cap FROM s),
f AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER o, 0) AS filled, coalesce(sum(w) OVER o, 0) AS gone
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, max(CASE WHEN (total - filled) / (all_w - gone) <= cap / w THEN (total - filled) / (all_w - gone) END) OVER () AS level FROM f),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(level * w, CAST(cap AS DOUBLE))) AS target FROM l),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
x AS (
  SELECT d.*, r.source_size, r.target, r.whole, CAST(round(r.target) AS BIGINT) - r.whole * r.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id NULLS FIRST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - run)) AS BIGINT) AS taken FROM x
"""
