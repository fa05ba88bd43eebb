"""Op 6: quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the counts of
vote patterns (a bounded table, made from all documents) estimates each labeller's accuracy and each pattern's
posterior; the posteriors of a bounded, seeded sample train a linear scorer over hashed word shapes, which judges every
whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents that train the scorer; a fixed number, whatever the input's size.
SAMPLE = 3_000
BUCKETS = 1 << 12
LABELLERS = ("repeats", "runs", "variety", "symbols", "decorated", "plain", "capitals", "exclaims", "sentences")
_SYMBOLS, _UPPER, _LOWER = b"#$%&*|<>{}\\~^=_@", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Letters and digits of a word's shape: A, a and 9; other bytes stay.
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
_MARKS, _BARE = b"!#$%&*|<>~^=_", b"|#*<>~"
_PLAIN = re.compile(rb"[\"'(]?[Aa9]+(?:[-'][Aa]+)*[.,;:!?)\"']{0,2}")
_shapes: dict[bytes, tuple[int, int, int]] = {}
#: The cache of shapes: so many, of so many bytes at most; longer ones are worked out each time.
_SHAPES, _SHAPE_BYTES = 100_000, 64


def _sign(shape: bytes) -> tuple[int, int, int]:
    """(bucket, plain, decorated) of a shape; the bucket tells runs of one sign only as one or more, and lengths by steps of six."""
    squeezed = re.sub(rb"(.)\1+", rb"\1\1", shape, flags=re.S) + b"%d" % min(len(shape) // 6, 3)
    decorated = shape in _BARE if len(shape) == 1 else shape[-1] == shape[-2] and shape[-1] in _MARKS
    return zlib.crc32(squeezed) % (BUCKETS - 1), bool(_PLAIN.fullmatch(shape)), decorated


def _signs(raw: bytes) -> list[tuple[int, int, int]]:
    """_sign() of each word's shape."""
    shapes = raw.translate(_SHAPE).split()
    if len(_shapes) > _SHAPES:
        _shapes.clear()
    new, long = set(shapes).difference(_shapes), {}
    for shape in new:
        (_shapes if len(shape) <= _SHAPE_BYTES else long)[shape] = _sign(shape)
    return [_shapes[s] if s in _shapes else long[s] for s in shapes] if long else [_shapes[s] for s in shapes]


def votes(raw: bytes, words: list[bytes]) -> tuple[int, ...]:
    """A vote of each labeller: 1 good, -1 bad, 0 nothing. Several look for the same faults by different signs; texts without words are bad."""
    n = len(words)
    if not n:
        return (0, 0, -1, 0, 0, -1, 0, 0, 0)
    grade = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
    long = n >= 8
    same = sum(map(eq, words, words[1:]))
    run = max(len(list(g)) for equal, g in groupby(map(eq, words, words[1:])) if equal) if same else 0
    marked = len(raw) - len(raw.translate(None, _SYMBOLS))
    upper, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
    ends = raw.count(b". ") + raw.count(b".\n") + raw.count(b"? ") + raw.count(b"! ") + (words[-1][-1:] in (b".", b"?", b"!"))
    _, plain, decorated = map(sum, zip(*_signs(raw), strict=True))
    return (
        grade(same / n, 0.05, 0.2) if long else 0,
        grade(run / n**0.5, 0.2, 0.35) if long else 0,
        grade(max(Counter(words).values()) / n, 0.12, 0.3) if n >= 24 else 0,
        grade(marked / n, 0.05, 0.25),
        grade(decorated / n, 0.03, 0.15),
        -grade(plain / n, 0.7, 0.9),
        grade(upper / max(upper + lower, 1), 0.3, 0.6) if long else 0,
        grade(raw.count(b"!!") / n, 0.02, 0.2),
        (1 if 0.01 <= ends / n <= 0.4 else -1) if n >= 40 else 0,
    )


def pattern(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


def unpattern(p: int) -> list[int]:
    return [p // 3**i % 3 - 1 for i in range(len(LABELLERS))]


class LabelModel:
    """Two classes; given the class, those labellers that vote do so independently, and silence says nothing. Fitted by expectation-maximisation to counts of vote patterns.

    given[c, l] is the chance that labeller l, where it votes, votes bad in class c (0 bad, 1 good).
    """

    def __init__(self, counts: dict[int, int], rounds: int = 300) -> None:
        self.patterns = np.array(sorted(counts), np.int64)
        n = np.array([counts[p] for p in self.patterns.tolist()], float)
        v = np.array([unpattern(p) for p in self.patterns.tolist()]).reshape(-1, len(LABELLERS))
        bad, ok = (v < 0).astype(float), (v > 0).astype(float)
        good = np.where((v < 0).any(1), 0.1, 0.9)
        for _ in range(rounds if len(n) else 0):
            self.prior = float(np.clip((n @ good) / n.sum(), 1e-3, 1 - 1e-3))
            self.given = np.stack([((n * g) @ bad + 0.5) / ((n * g) @ (bad + ok) + 1) for g in (1 - good, good)])
            self.given[1] = np.minimum(*self.given)  # a bad vote never speaks for good
            as_bad, as_good = (bad @ np.log(q) + ok @ np.log1p(-q) for q in self.given)
            new = 1 / (1 + np.exp(np.clip(as_bad + np.log(1 - self.prior) - as_good - np.log(self.prior), -50, 50)))
            if np.abs(new - good).max() < 1e-7:
                break
            good = new
        self.posterior = dict(zip(self.patterns.tolist(), good.tolist(), strict=True))

    def accuracies(self) -> dict[str, float]:
        """The chance that a labeller's vote, where it votes, is right."""
        right = (1 - self.prior) * self.given[0] + self.prior * (1 - self.given[1])
        return dict(zip(LABELLERS, right.tolist(), strict=True))


def features(raw: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: roots of the shares of hashed word shapes and, in the last bucket, of words that repeat the one before."""
    if not words:
        return np.zeros(1, np.int64), np.zeros(1)
    n = Counter(b for b, _, _ in _signs(raw))
    at = np.array([*n, BUCKETS - 1], np.int64)
    return at, np.sqrt(np.array([*n.values(), sum(map(eq, words, words[1:])) if len(words) >= 8 else 0]) / len(words))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights and bias (last) of a logistic scorer fitted to soft labels y by Adam on full batches."""
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, x = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    w, m, s = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, x * w[at], len(rows)) + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(rows)
        g = np.append(np.bincount(at, x * e[row], BUCKETS), e.sum()) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


def _raw(text: object) -> bytes:
    return text.encode() if isinstance(text, str) else b""


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, np.ndarray]:
    """The label model over all of docs (doc_id, text) and the scorer's weights from `sample` of them, those first by a seeded hash."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, int] = {}
        for pdf in batches:
            for raw in map(_raw, pdf["text"]):
                p = pattern(votes(raw, raw.split()))
                found[p] = found.get(p, 0) + 1
        yield pd.DataFrame({"pattern": list(found), "n": list(found.values())}, dtype="int64")

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for o, raw in zip(pdf["o"], map(_raw, pdf["text"]), strict=True):
                words = raw.split()
                at, x = features(raw, words)
                rows.append((o, pattern(votes(raw, words)), at.tolist(), x.tolist()))
            yield pd.DataFrame(rows, columns=["o", "pattern", "at", "x"])

    spark = docs.sparkSession
    with common.batches_of(spark, common.BATCH_ROWS):
        counts = docs.select("text").mapInPandas(common.released(count), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
        model = LabelModel({r.pattern: r.n for r in counts})
        # Whole texts stay where they are: a hash below a bound that is known from the count leaves a few more than the
        # sample, surely enough by six deviations, and only their features are ordered.
        total = sum(r.n for r in counts)
        share = min(1.0, (sample + 6 * sample**0.5 + 36) / max(total, 1))
        order = F.xxhash64(F.lit("quire-sample"), F.col("doc_id"), "text")
        few = docs.select("text", order.alias("o")).where(F.col("o") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
        rows = few.mapInPandas(common.released(look), "o long, pattern long, at array<int>, x array<double>").orderBy("o", "pattern").limit(sample).collect()
    rows = [(model.posterior[r.pattern], np.array(r.at), np.array(r.x)) for r in rows]
    weights = train([(a, x) for _, a, x in rows], np.array([p for p, _, _ in rows])) if rows else np.zeros(BUCKETS + 1)
    return model, weights


def scores(texts: pa.Array, weights: np.ndarray, some: int = 500) -> np.ndarray:
    """The scorer's chance of good quality of each text; `some` texts are Python objects at a time."""
    z = np.zeros(len(texts))
    for lo in range(0, len(texts), some):
        for i, raw in enumerate(map(_raw, texts.slice(lo, some).to_pylist()), lo):
            at, x = features(raw, raw.split())
            z[i] = x @ weights[at] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def classify(docs: DataFrame, sample: int = SAMPLE, cut: float = 0.5) -> DataFrame:
    """(doc_id, score, keep) for each row of docs (doc_id, text): keep where the scorer's chance of good quality is `cut` or more.

    Null and empty texts count as texts without words; very long ones are judged whole; repeated rows are judged each, as
    are ties; a null doc_id stays null; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    weights = fit(docs, sample)[1]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch.column("text"), weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array(found >= cut)], ["doc_id", "score", "keep"])

    return docs.mapInArrow(common.released(judge), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, keep boolean")


def filtered(docs: DataFrame, sample: int = SAMPLE, cut: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns as they are; awkward rows as in classify()."""
    weights = fit(docs, sample)[1]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text"), weights) >= cut))

    return docs.mapInArrow(common.released(keep), docs.schema)
