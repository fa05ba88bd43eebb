"""Links between documents whose sets of word shingles resemble each other by 0.8 or more.

SimHash at two bits of 64 reaches copies of a cosine of 0.995 only, so the corpus pipeline's near-dedup adds these links.
Documents that share a band of min-hashes are candidates; a 192-bit sketch of one bit a min-hash, then the exact
Jaccard similarity of their whole texts decide. Members of a band are first held against the one with most company, its hub. Those that it does
not resemble are then compared with others only where they can resemble one: two sets either share a shingle that the
hub lacks, where they meet by prefixes, or share no more than either shares with the hub.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SIMILARITY = 0.8
BANDS, ROWS = 24, 6
HASHES = 192
#: Differing bits of the sketch: a pair at 0.8 differs in 19 of 192 on average, with a deviation of 4.2.
SKETCH_BITS = 36
_FACTOR = np.array([xxhash.xxh64_intdigest(b"factor-%d" % i, 42) | 1 for i in range(HASHES)], np.uint64)
_SHIFT = np.array([xxhash.xxh64_intdigest(b"shift-%d" % i, 42) for i in range(HASHES)], np.uint64)
SIGNATURE = "doc_id long, whole long, n long, bands array<long>, s0 long, s1 long, s2 long"


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct XXH64 hashes of a text's word shingles, A-Z lower-cased; a text of fewer words is one shingle, one without words none."""
    w = text.encode().lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else (b" ".join(w),)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def signature(found: np.ndarray) -> tuple[int, list[int], list[int]]:
    """(hash of the whole set, a hash of each band of min-hashes, the sketch as three longs) of a set that is not empty."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        np.minimum(least, (np.multiply.outer(_FACTOR, found[i : i + 4096]) + _SHIFT[:, None]).min(1), out=least)
    bands = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(bands)]
    sketch = np.packbits(((least >> np.uint64(33)) & np.uint64(1)).astype(np.uint8)).view(np.int64)
    return xxhash.xxh64_intdigest(found.tobytes(), 42), np.array(keys, np.uint64).view(np.int64).tolist(), sketch.tolist()


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """SIGNATURE of each row of docs (doc_id, text) that has a doc_id and words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found = shingle_set(text if isinstance(text, str) else None, words)
                if len(found):
                    whole, bands, sketch = signature(found)
                    rows.append((i, int(np.uint64(whole).view(np.int64)), len(found), bands, *sketch))
            yield pd.DataFrame(rows, columns=["doc_id", "whole", "n", "bands", "s0", "s1", "s2"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(common.released(run), SIGNATURE)


def _alike(similarity: float) -> Column:
    """What pairs a, b must fulfil before their texts are compared: sizes and sketches that allow the similarity."""
    apart = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(3)), F.lit(0))
    return (apart <= SKETCH_BITS) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * similarity)


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b) with their texts x and y."""
    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")


def _sets(pdf: pd.DataFrame, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingle sets of x and y; an x that repeats is made once."""
    last, held = None, np.zeros(0, np.uint64)
    for x, y in zip(pdf["x"], pdf["y"], strict=True):
        if x != last:
            last, held = x, shingle_set(x, words)
        yield held, shingle_set(y, words)


def verified(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole texts have a Jaccard similarity of `similarity` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[jaccard(x, y) >= similarity for x, y in _sets(pdf, words)], ["a", "b"]]

    return common.written(_with_texts(pairs, docs).mapInPandas(common.released(run), "a long, b long"), "resembling", batch_rows=500).distinct()


def against_hubs(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b, ok, both, own) for pairs of a hub a and a member b: whether they resemble, how many shingles they share, and b's prefix.

    A set's shingles are ordered by their hashes, those that the hub lacks before those that it has; the prefix is the
    first n - ceil(similarity n) + 1 of them, of which `own` holds those that the hub lacks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for (x, y), a, b in zip(_sets(pdf, words), pdf["a"], pdf["b"], strict=True):
                own = np.setdiff1d(y, x, assume_unique=True)
                prefix = len(y) - int(np.ceil(similarity * len(y) - 1e-9)) + 1
                rows.append((a, b, jaccard(x, y) >= similarity, len(y) - len(own), own[:prefix].view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["a", "b", "ok", "both", "own"])

    return common.written(_with_texts(pairs, docs).mapInPandas(common.released(run), "a long, b long, ok boolean, both long, own array<long>"), "against-hubs", batch_rows=500)


def links(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): (doc_id, rep) of each document with words, and pairs (a, b) of representatives that connect what resembles.

    Documents with the same set of shingles are one class, its representative the smallest doc_id. Pairs at the
    similarity meet in some band with a chance of 0.9993 or more; of those that meet, pairs suffice to connect all that
    resemble, and none is between two that do not. Null doc_ids and texts without words take no part; of rows that
    share a doc_id any may stand for it; an empty table gives empty results.
    """
    sig = common.written(signatures(docs, words), "signatures")
    member = sig.join(sig.groupBy("whole").agg(F.min("doc_id").alias("rep")), "whole").select("doc_id", "rep")
    sketch = ["n", "s0", "s1", "s2"]
    reps = sig.groupBy("whole").agg(F.min(F.struct("doc_id", *sketch, "bands")).alias("r")).select(F.col("r.doc_id").alias("node"), *(f"r.{c}" for c in sketch), "r.bands")
    reps = common.written(reps.dropDuplicates(["node"]), "representatives")
    bands = reps.select(F.explode("bands").alias("key"), "node")
    shared = bands.groupBy("key").agg(F.count("*").alias("count")).where("count > 1")
    bands = common.written(bands.hint("merge").join(shared, "key"), "shared-bands")  # exploded rows are not to be broadcast
    # The member that shares most bands with others is the likeliest to resemble all: copies of one text differ from it by
    # less than from each other.
    weight = bands.groupBy("node").agg(F.sum("count").alias("weight"))
    ranked = bands.join(weight, "node").select("key", "node", F.struct("weight", F.bitwise_not("node").alias("last")).alias("r"))
    hubs = ranked.groupBy("key").agg(F.bitwise_not(F.max("r")["last"]).alias("hub"))
    bands = common.written(bands.select("key", "node").join(hubs, "key"), "bands")
    sketches = reps.drop("bands")

    first = bands.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    held = against_hubs(first, docs, words, similarity)
    found = held.where("ok").select("a", "b")
    parts = common.components(found)
    placed = held.select(F.col("a").alias("hub"), F.col("b").alias("node"), "both", "own").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    placed = placed.join(parts.select(F.col("node").alias("hub"), F.col("component").alias("hub_part")), "hub", "left").withColumn("out", F.col("part") != F.coalesce("hub_part", "hub")).drop("hub_part")
    loose = placed.where("out").select("hub").distinct()
    placed = common.written(placed.join(loose, "hub", "left_semi").join(sketches, "node"), "apart")
    # Two members that share no shingle which the hub lacks share as many at most as either shares with the hub.
    differ = (F.col("a.part") != F.col("b.part")) & (~F.col("b.out") | (F.col("a.node") < F.col("b.node")))
    enough = F.least("a.both", "b.both") * (1 + similarity) >= (F.col("a.n") + F.col("b.n")) * similarity - 1e-6
    slim = placed.drop("own")
    through = slim.where("out").alias("a").join(slim.alias("b"), (F.col("a.hub") == F.col("b.hub")) & differ & enough & _alike(similarity))
    # Others that resemble share one, and by the order also one of their prefixes.
    named = placed.select("hub", "node", "part", "out", F.explode("own").alias("shingle"))
    beside = named.where("out").alias("a").join(named.hint("merge").alias("b"), (F.col("a.hub") == F.col("b.hub")) & (F.col("a.shingle") == F.col("b.shingle")) & differ)
    pair = [F.col("a.node").alias("a"), F.col("b.node").alias("b")]
    rest = through.select(*pair).unionByName(beside.select(*pair)).distinct()
    return member, found.unionByName(verified(rest, docs, words, similarity))
