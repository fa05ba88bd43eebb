"""Op 9: SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits lie on a ring of three segments. Where two fingerprints differ in at most two bits, some
segment starts a chain whose first l segments differ in at most floor(2 l / 3) bits for every l: none in the first, one
at most in the first two. Candidates therefore share a segment and agree in the next but for one bit; they meet by
equality on both, and the full Hamming distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, resemblance

BITS = 2
#: (lowest bit, width) of the ring's segments.
RING = ((0, 22), (22, 21), (43, 21))
HEAVY = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit i is 1 where it is set in over half the XXH64 hashes (seed 42) of the word shingles, repeats included; 0 without words."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else (b" ".join(w),)
    n = max(1, len(w) - words + 1)
    a = np.fromiter((h(s, 42) for s in shingles), np.uint64, n).view(np.uint8).reshape(n, 8)
    total = sum((np.unpackbits(a[i : i + 65_536], axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, n, 65_536)), np.zeros(64, np.int64))
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp), fp being the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t if isinstance(t, str) else None, words) for t in pdf["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fps.view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(common.released(run), "doc_id long, fp long")


def _segment(fp: str, i: int) -> str:
    at, width = RING[i % 3]
    return f"(shiftrightunsigned({fp}, {at}) & {(1 << width) - 1}L)"


def linked(fps: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Pairs (a, b) that connect the distinct fingerprints (fp) exactly as all pairs at two differing bits or fewer would.

    A bucket holds the fingerprints that share two neighbouring segments. Where a bucket has more than `heavy` of them,
    pairs could grow with its square: the fingerprints with its first segment are then linked through hubs, the
    points one flipped bit away, as two fingerprints differ in at most two bits just when they share a hub; each hub
    has at most 65 fingerprints, linked to the smallest. No pair is lost and none is made of two that are not linked.
    """
    slots = ", ".join(f"named_struct('i', {i}, 'x', {_segment('fp', i)}, 'y', {_segment('fp', i + 1)})" for i in range(3))
    index = fps.select("fp", F.expr(f"inline(array({slots}))"))
    hot = index.groupBy("i", "x", "y").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("i", "x").distinct()
    index = index.join(hot.withColumn("hot", F.lit(True)), ["i", "x"], "left")
    light = index.where("hot is null").drop("hot")
    width = F.element_at(F.array(*[F.lit(RING[(i + 1) % 3][1]) for i in range(3)]), F.col("i") + 1)
    # The side whose differing bit is 0 asks for the other, so each pair is asked for once a chain.
    flips = F.filter(F.sequence(F.lit(0), width - 1), lambda b: F.expr("y").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) == 0)
    asked = F.concat(F.array(F.col("y")), F.transform(flips, lambda b: F.col("y").bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    probe = light.select(F.col("fp").alias("a"), "i", "x", F.posexplode(asked).alias("flip", "y"))
    # Estimates leave the rows that explode() makes out of account, so without a hint the larger side may be broadcast.
    pairs = light.join(probe.hint("merge"), ["i", "x", "y"]).where((F.col("flip") > 0) | (F.col("a") < F.col("fp")))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= BITS).select("a", F.col("fp").alias("b"))
    hubs = index.where("hot").select("fp").distinct()
    hubs = hubs.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("hub"))
    stars = hubs.groupBy("hub").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = 3, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over fingerprints that differ in two bits or fewer, itself included;
    texts without words, null ones too, have fingerprint zero and are linked like any other. Equal fingerprints are one
    class with one representative. A null doc_id is ignored as a representative, and its component_id is that of its
    class (null where it has no other); repeated rows appear each; other columns are ignored.
    """
    found = common.written(fingerprints(docs, words), "fingerprints")
    classes = common.written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = linked(classes.select("fp"), heavy)
    parts = common.components(edges)
    in_part = classes.join(parts, classes.fp == parts.node).select("fp", "least", "component")
    smallest = in_part.groupBy("component").agg(F.min("least").alias("component_id"))
    moved = in_part.join(smallest, "component").select("fp", "component_id")
    ids = classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    out = found.join(ids, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, words: int = 5, heavy: int = HEAVY, similarity: float = resemblance.SIMILARITY) -> DataFrame:
    """One row of docs for each component of near duplicates: that of its smallest doc_id, with all its columns as they are.

    Components join what near_duplicates() links and what resembles by `similarity` or more in word shingles; the
    fingerprints alone reach closer copies only. Null and empty texts are copies of each other. Rows that share a doc_id
    are judged by their texts: each may stay, of equal ones one, and of those in one component the one with the
    smallest hash of its text. Rows without a doc_id stay; an empty table gives an empty result.
    """
    there = docs.where("doc_id is not null")
    repeats = not there.groupBy("doc_id").count().where("count > 1").isEmpty()
    key = F.xxhash64("doc_id", "text") if repeats else F.col("doc_id")
    d = there.select(key.alias("doc_id"), "text")
    near = near_duplicates(d, words, heavy).select("doc_id", "component_id")
    member, pairs = resemblance.links(d, words, similarity)
    groups = common.written(near.join(member, "doc_id", "left").select("doc_id", "component_id", F.coalesce("rep", "doc_id").alias("rep")).distinct(), "groups")
    parts = common.components(groups.where("component_id <> rep").select(F.col("component_id").alias("a"), F.col("rep").alias("b")).unionByName(pairs))
    last = groups.join(parts, groups.rep == parts.node, "left").select("doc_id", F.coalesce("component", "rep").alias("least"))
    if repeats:  # keys are hashes, so the smallest doc_id of a component is looked up
        ids = there.select(key.alias("doc_id"), F.col("doc_id").alias("id")).distinct()
        last = last.join(ids, "doc_id")
        best = last.groupBy("least").agg(F.min(F.struct("id", "doc_id"))["doc_id"].alias("best"))
        last = last.join(best, "least").select("doc_id", F.col("best").alias("least"))
    gone = common.written(last.where("doc_id <> least").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    keyed = docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), key))
    left = keyed.join(gone, keyed["__key"] == gone["__gone"], "left_anti")
    if repeats:
        left = left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["__key"]))
    return left.select(*docs.columns)
