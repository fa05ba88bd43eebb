"""Op 1: training-order materialisation.

Token streams are cut into sequences; a keyed Feistel permutation with cycle-walking gives each sequence a global slot;
range partitions of slots are written as shards whose records all have one length, so slot s lies at byte
(s % per_shard) * stride of shard s // per_shard and reading can resume anywhere.

Record (little-endian): slot i64, doc_id i64 (of the first token), start i64 (that token's place in its document),
length u32, then seq_len ids (u16) padded with zeros, then one newline byte.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

HEAD, HEAD_BYTES = "<qqqI", 28
NO_ID = -(2**63)
WIDTH, SIZE = "<u2", 2
ROUNDS = 6


def _round(x: np.ndarray, key: int, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64((key + 0x9E3779B97F4A7C15 * (i + 1)) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of [0, n): a balanced Feistel network over the next even number of bits, walked on until it is below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (_round(left, key, i) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, i) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _streams(batches: Iterator[pd.DataFrame], path: str, seq_len: int) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, start, ids) of the sequences of a partition's token stream, each document ended by END."""
    enc, end = tokens.encoder(path), np.array([tokens.END], WIDTH).tobytes()
    parts, have, first = [], 0, None
    for pdf in batches:
        for doc_id, ids in zip(pdf["doc_id"], enc.many(pdf["text"].tolist()), strict=True):
            ids = ids.astype(WIDTH).tobytes() + end
            doc_id, at, n = NO_ID if doc_id is None or doc_id != doc_id else int(doc_id), 0, len(ids) // SIZE
            while at < n:
                first = first or (doc_id, at)
                take = min(n - at, seq_len - have)
                parts.append(ids[SIZE * at : SIZE * (at + take)])
                at, have = at + take, have + take
                if have == seq_len:
                    yield *first, b"".join(parts)
                    parts, have, first = [], 0, None
    if have:
        yield *first, b"".join(parts)


def shard_records(total: int, least: int = 2048, most: int = 65_536, shards: int = 10_000) -> int:
    """Records of a shard: `least`, doubled while there would be more than so many shards, up to `most`, so a shard always fits in memory."""
    while least < most and total > least * shards:
        least *= 2
    return least


def materialise(docs: DataFrame, out: str, seq_len: int = 2048, per_shard: int | None = None, key: int = 20_240_607, path: str | None = None) -> DataFrame:
    """Writes the shards of docs (doc_id, text) to the folder `out` and returns what read() finds there.

    Sequences are cut once, in the order in which the input's partitions come, and written to the shared folder, which
    fixes their order; so another division into partitions gives other sequences and slots. Only their counts by partition
    come to the driver. per_shard: by default what shard_records() says. Null texts are empty (a lone END); very long texts
    run over as many sequences as they need; a null doc_id stays null; repeated rows are kept, each with its own
    tokens; other columns are ignored; an empty table gives no shard.
    """
    import zstandard

    spark, path = docs.sparkSession, path or tokens.default_path()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, squeeze, rows, n = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3), [], 0
        frame = lambda: pd.DataFrame(rows, columns=["part", "nth", "doc_id", "start", "ids"])
        for doc_id, start, ids in _streams(batches, path, seq_len):
            rows.append((part, n, doc_id, start, squeeze.compress(ids)))
            n += 1
            if len(rows) == 512:
                yield frame()
                rows = []
        if rows:
            yield frame()

    made = common.written(docs.select("doc_id", "text").mapInPandas(common.released(cut), "part int, nth long, doc_id long, start long, ids binary"), "sequences")
    counts = dict(sorted((r.part, r["count"]) for r in made.groupBy("part").count().collect()))
    base = dict(zip(counts, accumulate(counts.values(), initial=0), strict=False))
    total = sum(counts.values())
    if not total:
        common.discard(made)
        return spark.createDataFrame([], SCHEMA)
    per_shard = per_shard or shard_records(total)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            index = pdf["part"].map(base).to_numpy("int64") + pdf["nth"].to_numpy("int64")
            yield pdf[["doc_id", "start", "ids"]].assign(slot=permute(index, total, key))

    def record(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor()
        for pdf in batches:
            recs = []
            for slot, doc_id, start, ids in zip(pdf["slot"], pdf["doc_id"], pdf["start"], pdf["ids"], strict=True):
                ids = expand.decompress(ids)
                recs.append(struct.pack(HEAD, slot, doc_id, start, len(ids) // SIZE) + ids.ljust(seq_len * SIZE, b"\0"))
            yield pd.DataFrame({"rec": recs})

    shards = -(-total // per_shard)
    rows = made.mapInPandas(common.released(place), "doc_id long, start long, ids binary, slot long")
    rows = rows.repartitionById(shards, F.expr(f"cast(slot div {per_shard} as int)")).sortWithinPartitions("slot")
    with common.batches_of(spark, common.BATCH_ROWS):
        rows.mapInPandas(common.released(record), "rec binary").select(F.col("rec").cast("string").alias("value")).write.option("lineSep", "\n").text(out)
    common.discard(made)
    return read(spark, out, seq_len, per_shard)


SCHEMA = "slot long, shard long, offset long, doc_id long, start long, length long, ids_crc32 long"


def _shard_files(spark: SparkSession, out: str, least: int) -> list[str]:
    """The shards' files from number `least` on; one listing of the folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    names = [f.getPath().toString() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return [n for n in names if (m := re.search(r"/part-(\d+)[^/]*$", n)) and int(m[1]) >= least]


def read(spark: SparkSession, out: str, seq_len: int = 2048, per_shard: int = 2048, from_slot: int = 0) -> DataFrame:
    """A row for each record from slot from_slot on: its slot, shard, byte offset, first document, length and the CRC-32 of its ids as u32. Shards before from_slot's are not opened."""
    stride = HEAD_BYTES + seq_len * SIZE + 1
    wanted = _shard_files(spark, out, from_slot // per_shard) if from_slot else [out]
    if not wanted:
        return spark.createDataFrame([], SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(wanted)
    files = files.select(F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("shard"), "content")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, content in zip(pdf["shard"], pdf["content"], strict=True):
                rows = []
                for at in range(0, len(content), stride):
                    slot, doc_id, start, n = struct.unpack_from(HEAD, content, at)
                    ids = np.frombuffer(content, WIDTH, n, at + HEAD_BYTES).astype("<u4")
                    if slot != shard * per_shard + at // stride:
                        raise ValueError(f"shard {shard} holds slot {slot} at byte {at}")
                    rows.append((slot, shard, at, doc_id, start, n, zlib.crc32(ids.tobytes())))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    found = files.mapInPandas(common.released(look), SCHEMA).where(F.col("slot") >= from_slot)
    return found.withColumn("doc_id", F.expr(f"nullif(doc_id, {NO_ID + 1} - 1)"))
