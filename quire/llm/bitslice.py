"""Op 3: exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers and laid out as bitmaps: slice b of attribute d holds bit b of that attribute for all
rows of a block. A query's scores are sums of shifted slices, made with carry-save adders over whole bitmaps; the top
rows are picked from the most significant score slice downward, and the rows that tie at the boundary are resolved
exactly (by vec_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK_ROWS, BLOCK_QUERIES = 32_768, 512


def quantise(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x as double; null where the vector is null or holds a null or non-finite one."""
    ok = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _pack(ids: np.ndarray, vectors: list[np.ndarray]) -> tuple[bytes, bytes, int]:
    dim = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(ids), dim), "<i4")
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return ids.astype("<i8").tobytes(), out.tobytes(), dim


class Block:
    """The bit-sliced index of a block of rows, ascending by id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order].astype(np.int64)
        self.n, self.dim = self.rows.shape
        self.low = self.rows.min(0, initial=0)
        up = (self.rows - self.low).astype(np.uint64)
        self.bits = int(up.max(initial=0)).bit_length()
        pad = -self.n % 64
        self.slices = np.empty((self.bits, self.dim, (self.n + pad) // 64), np.uint64)
        for b in range(self.bits):
            bit = np.pad(((up >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, ((0, 0), (0, pad)))
            self.slices[b] = np.ascontiguousarray(np.packbits(bit, axis=1, bitorder="little")).view(np.uint64)
        self.all = np.packbits(np.pad(np.ones(self.n, np.uint8), (0, pad)), bitorder="little").view(np.uint64)

    def scores(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of the rows' inner products with q up to a constant: a negative factor takes an attribute's complement."""
        columns: dict[int, list[np.ndarray]] = {}
        size = np.abs(q)
        for a in range(int(size.max(initial=0)).bit_length()):
            on = (size >> a) & 1 == 1
            plus, minus = np.flatnonzero(on & (q > 0)), np.flatnonzero(on & (q < 0))
            for b in range(self.bits):
                columns.setdefault(a + b, []).append(np.concatenate([self.slices[b, plus], ~self.slices[b, minus]]))
        out, weight = [], 0
        while columns:
            have = np.concatenate(columns.pop(weight, [])) if weight in columns else np.zeros((0, len(self.all)), np.uint64)
            while len(have) > 1:
                k = len(have) // 3
                if k:
                    x, y, z = have[:k], have[k : 2 * k], have[2 * k : 3 * k]
                    xy = x ^ y
                    carry, have = (x & y) | (xy & z), np.concatenate([xy ^ z, have[3 * k :]])
                else:
                    carry, have = (have[0] & have[1])[None], (have[0] ^ have[1])[None]
                columns.setdefault(weight + 1, []).append(carry)
            out.append(have[0] if len(have) else np.zeros_like(self.all))
            weight += 1
        return out

    def top(self, q: np.ndarray, k: int, skip: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those with id skip, best first, ties to the smaller id."""
        sure, maybe = np.zeros_like(self.all), self.all.copy()
        own = np.flatnonzero(self.ids == skip) if skip is not None else ()
        for i in own:
            maybe[i // 64] &= ~np.uint64(1 << (int(i) % 64))
        for s in reversed(self.scores(q)):
            with_one = maybe & s
            count = int(np.bitwise_count(sure | with_one).sum())
            if count > k:
                maybe = with_one
            else:
                sure, maybe = sure | with_one, maybe & ~s
                if count == k:
                    maybe = np.zeros_like(maybe)
                    break
        places = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        found = places(sure)
        found = np.concatenate([found, places(maybe)[: k - len(found)]])
        score = self.rows[found] @ q
        order = np.lexsort((self.ids[found], -score))
        return self.ids[found][order], score[order]


def search(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k best other rows, all if fewer.

    Rows are dealt by a hash into blocks of about block_rows, queries into blocks of about block_queries; each pair of
    blocks is one task's work with bounded memory, and k rows a query leave it. Ties go to the smaller vec_id. Null
    ids and vectors that are null or hold null or non-finite components take no part; shorter vectors count as
    padded with zeros; rows that repeat an id are candidates each, but never for their own id; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", quantise(F.col("embedding"), scale).alias("q")).where("vec_id is not null and q is not null")
    n, n_queries = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_queries // block_queries))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, data, dim = _pack(pdf["vec_id"].to_numpy(), list(pdf["q"]))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [ids], "data": [data], "dim": [dim]})

    def pack(df: DataFrame, count: int, seed: int) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count))).groupBy("block").applyInPandas(packed, "block long, ids binary, data binary, dim int")

    index = pack(rows, blocks, 1).withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = pack(rows.where(F.col("vec_id") % every == 0), query_blocks, 2).select(
        F.col("block").cast("int").alias("qblock"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), F.col("dim").alias("qdim"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block")
    )

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                dim = max(r.dim, r.qdim)
                wide = lambda b, d: np.pad(np.frombuffer(b, "<i4").reshape(-1, d) if d else np.zeros((0, 0), "<i4"), ((0, 0), (0, dim - d)))
                ids, qids = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.qids, "<i8")
                data = wide(r.data, r.dim) if r.dim else np.zeros((len(ids), dim), "<i4")
                asked = wide(r.qdata, r.qdim) if r.qdim else np.zeros((len(qids), dim), "<i4")
                block, out = Block(ids, data), []
                for qid, q in zip(qids, asked.astype(np.int64), strict=True):
                    found, score = block.top(q, k, int(qid))
                    out.append(pd.DataFrame({"query_id": np.full(len(found), qid), "vec_id": found, "score": score}))
                yield pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    pairs = index.join(asked, ["block", "qblock"])
    pairs = pairs.repartition(min(blocks * query_blocks, 100_000), "block", "qblock") if blocks * query_blocks > 1 else pairs
    best = pairs.mapInPandas(find, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for search() with its standard parameters.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
