"""Op 8: lexical retrieval packing.

Documents are dealt into shards of bounded size by their most telling token, so texts on one thing meet; each shard has
its own inverted index with BM25 weights from the document frequencies of the whole corpus. A seed document asks for
its unused neighbours, which fill its window greedily; the last one is cut where the window ends, and what is left of it
seeds the next window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

WINDOW, SHARD_TOKENS = 4096, 1_000_000
K1, B = 1.2, 0.75


def _terms(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and the distinct ones with their counts, the END left out."""
    import zstandard

    ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<u2")
    t, n = np.unique(ids[:-1], return_counts=True)
    return ids, t, n


def _idf(df: np.ndarray, docs: int) -> np.ndarray:
    return np.log1p((docs - df + 0.5) / (df + 0.5))


def _weights(t: np.ndarray, n: np.ndarray, length: int, idf: np.ndarray, mean: float) -> np.ndarray:
    return idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * length / mean))


def _topic(t: np.ndarray, w: np.ndarray, df: np.ndarray) -> int:
    """The token of most weight among those that other documents have too; -1 without any."""
    w = np.where(df[t] > 1, w, -1.0)
    return int(t[w.argmax()]) if len(t) and w.max() > 0 else -1


def _emit(pieces: list[tuple[int, int, int]], at: list[int], n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Rows (document, start, length, sequence, offset) of one window of n tokens; a window that is not full is cut into powers of two, which need no padding."""
    sizes = [n] if n == WINDOW else [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]
    left, offset = sizes.pop(0), 0
    for doc, start, length in pieces:
        while length:
            if not left:
                at[0], left, offset = at[0] + 1, sizes.pop(0), 0
            take = min(length, left)
            yield doc, start, take, at[0], offset
            start, length, left, offset = start + take, length - take, left - take, offset + take
    at[0] += 1


class Postings:
    """An inverted index of a shard's documents; those that are used go from it once they hold half of its postings."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray]) -> None:
        self.n = len(terms)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t in terms])
        term, weight = np.concatenate(terms), np.concatenate(weights)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order].astype(np.float32)
        names, local = np.unique(term, return_inverse=True)
        self.size = np.bincount(local, minlength=len(names))
        self.of = np.split(local, np.cumsum([len(t) for t in terms])[:-1])  # a document's terms by their numbers here
        self.live, self.gone = np.ones(self.n, bool), 0

    def use(self, docs: np.ndarray) -> None:
        self.live[docs] = False
        self.gone += sum(len(self.of[d]) for d in docs.tolist())
        if 2 * self.gone > len(self.doc):
            kept = self.live[self.doc]
            term = np.repeat(np.arange(len(self.size)), self.size)[kept]
            self.doc, self.weight, self.gone = self.doc[kept], self.weight[kept], 0
            self.size = np.bincount(term, minlength=len(self.size))

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a term with the seed, by the sum of their weights of all the seed's terms, ties to the first."""
        asked = self.of[seed]
        sizes = self.size[asked]
        at = tokens.runs((np.cumsum(self.size) - self.size)[asked], sizes)
        doc = self.doc[at]
        if 8 * len(at) < self.n:  # few of many documents
            found, place = np.unique(doc, return_inverse=True)
            score = np.bincount(place, self.weight[at], len(found))
        else:
            score = np.bincount(doc, self.weight[at], self.n)
            found = np.flatnonzero(score)
            score = score[found]
        live = self.live[found]
        found, score = found[live], score[live]
        return found[np.argsort(-score, kind="stable")]


def pack_shard(lengths: list[int], terms: list[np.ndarray], weights: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
    """Rows (document, start, length, sequence, offset): documents are numbered as given, sequences from 0.

    A seed's neighbours follow it in the order of their scores until one does not fit; that is cut, and its rest is the
    next window's seed. Where neighbours end before the window, the next unused document is a seed in the same window.
    """
    n, size = len(lengths), np.array(lengths)
    index = Postings(terms, weights)
    first, at, have = 0, [0], 0
    window: list[tuple[int, int, int]] = []
    rest: tuple[int, int] | None = None
    while True:
        if rest is None:
            while first < n and not index.live[first]:
                first += 1
            if first == n:
                break
            index.use(np.array([first]))
            rest = (first, 0)
        seed, start = rest
        take = min(lengths[seed] - start, WINDOW - have)
        window.append((seed, start, take))
        have, rest = have + take, (seed, start + take) if start + take < lengths[seed] else None
        if have < WINDOW and len(index.of[seed]):
            found = index.neighbours(seed)
            whole = int(np.searchsorted(np.cumsum(size[found]), WINDOW - have, "right"))
            window += [(d, 0, lengths[d]) for d in found[:whole].tolist()]
            have += int(size[found[:whole]].sum())
            if whole < len(found) and have < WINDOW:
                cut, take = int(found[whole]), WINDOW - have
                window.append((cut, 0, take))
                have, rest, whole = WINDOW, (cut, take), whole + 1
            index.use(found[:whole])
        if have == WINDOW:
            yield from _emit(window, at, have)
            window, have = [], 0
    if have:
        yield from _emit(window, at, have)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of docs (doc_id, text) in sequences of at most 4096 tokens.

    Null and empty texts are a lone END. A shard has shard_tokens tokens, or one document more; a frequent token's
    documents are dealt over as many shards by a hash, whatever their ids and texts. To the driver come sums by token,
    bounded by the vocabulary. Shards are full windows but for the last, so padding there is none: what is left is cut into
    powers of two. Rows that repeat a doc_id are documents of their own; a null doc_id stays null; other columns are
    ignored; an empty table gives an empty result.
    """
    import zstandard

    spark, path = docs.sparkSession, path or tokens.default_path()
    size = tokens.VOCABULARY_SIZE

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each document, and at a partition's end one with its document frequencies."""
        enc, squeeze, end, part, done, df = tokens.encoder(path), zstandard.ZstdCompressor(level=3), np.array([tokens.END], "<u2"), TaskContext.get().partitionId(), 0, np.zeros(size, "<i8")
        for pdf in batches:
            rows = []
            for ids in enc.many(pdf["text"].tolist()):
                df[np.unique(ids)] += 1
                ids = np.concatenate([ids, end])
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), squeeze.compress(ids.tobytes())))
            out = pd.DataFrame(rows, columns=["n", "crc", "ids"]).astype({"n": "Int64", "crc": "Int64"})
            out["nth"], done = (part << 40) + done + np.arange(len(rows)), done + len(rows)
            yield out.assign(doc_id=pdf["doc_id"].astype("Int64").to_numpy(), df=None).astype({"doc_id": "Int64"})[["doc_id", "n", "crc", "ids", "nth", "df"]]
        if done:
            yield pd.DataFrame({"doc_id": [None], "n": [None], "crc": [None], "ids": [None], "nth": [None], "df": [squeeze.compress(df.tobytes())]})

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size, np.int64)
        for pdf in batches:
            for blob in pdf["df"]:
                df += np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "<i8")
        at = np.flatnonzero(df)
        yield pd.DataFrame({"token": at, "df": df[at]})

    made = common.written(docs.select("doc_id", "text").mapInPandas(common.released(encode), "doc_id long, n long, crc long, ids binary, nth long, df binary"), "ids")
    total, count = made.agg(F.sum("n"), F.count("n")).first()
    if not count:
        common.discard(made)
        return spark.createDataFrame([], SCHEMA)
    df = np.zeros(size)
    for r in made.where("n is null").select("df").mapInPandas(common.released(frequencies), "token int, df long").groupBy("token").agg(F.sum("df").alias("df")).collect():
        df[r.token] = r.df
    mean, idf = max(total / count, 1.0), _idf(df, count)

    def topics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for blob in pdf["ids"]:
                ids, t, n = _terms(blob)
                found.append(_topic(t, _weights(t, n, len(ids), idf, mean), df))
            yield pdf.assign(topic=np.array(found, np.int32))

    kept = "doc_id long, n long, crc long, ids binary, nth long"
    told = common.written(made.where("n is not null").drop("df").mapInPandas(common.released(topics), f"{kept}, topic int"), "topics")
    common.discard(made)
    sums = told.groupBy("topic").agg(F.sum("n").alias("n")).collect()
    first, parts, shard, room = {}, {}, -1, 0
    for topic, n in sorted((r.topic, r.n) for r in sums):
        if n > shard_tokens:
            first[topic], parts[topic] = shard + 1, -(-n // shard_tokens)
            shard, room = shard + parts[topic], 0
        else:
            if n > room:
                shard, room = shard + 1, shard_tokens
            first[topic], parts[topic], room = shard, 1, room - n

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key = (pdf["nth"].to_numpy("int64").view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(7)
            lo, k = pdf["topic"].map(first).to_numpy("int64"), pdf["topic"].map(parts).to_numpy("uint64")
            yield pdf.drop(columns="topic").assign(shard=lo + (key % k).astype(np.int64))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "crc", "nth"], kind="stable").reset_index(drop=True)
        ids, terms, weights = [], [], []
        for blob in pdf["ids"]:
            i, t, n = _terms(blob)
            ids.append(i)
            terms.append(t)
            weights.append(_weights(t, n, len(i), idf, mean))
        rows = list(pack_shard([len(i) for i in ids], terms, weights))
        out = pd.DataFrame(rows, columns=["doc", "start", "length", "sequence_id", "offset"])
        out["ids_crc32"] = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(out["doc"], out["start"], out["length"], strict=True)]
        out["doc_id"], out["doc_tokens"] = pdf["doc_id"].astype("Int64").to_numpy()[out["doc"]], pdf["n"].to_numpy()[out["doc"]]
        out["sequence_id"] += int(pdf["shard"].iloc[0]) << 32
        return out[[x.split()[0] for x in SCHEMA.split(", ")]].astype({"doc_id": "Int64"})

    dealt = told.mapInPandas(common.released(deal), f"{kept}, shard long")
    return dealt.groupBy("shard").applyInPandas(run, SCHEMA)
