"""Full-text search: query parsing, an inverted index, boolean, prefix and phrase matching, BM25 rank and snippets."""

from __future__ import annotations

import bisect
import ctypes
import gc
import io
import itertools
import re
import time
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources import views as V

K1, B, LIMIT, SNIPPET = 1.2, 0.75, 30, 18


@dataclass(frozen=True)
class Term:
    """Words that must follow each other; the last is a beginning of words where prefix is set."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    op: str
    args: tuple = field(default_factory=tuple)


def parse(typed: str):
    """A tree of AND, OR, NOT over terms from what is typed, or None for what asks for nothing (Q01 to Q05).

    Words next to each other are joined by AND; capitals AND, OR, NOT are operators, the last of several in a row counts,
    those at the end and AND or OR at the start are dropped, NOT at the start asks for nothing. NOT binds first, then
    AND, then OR. A word's end is open where it has a * or ends in two letters or digits or more; a closed quote is exact.
    """
    if len(typed.strip()) < 2:
        return None
    items: list = []
    for quoted, rest, word in re.findall(r'"([^"]*)"|"([^"]*)$|([^\s"]+)', typed.strip()):
        if word in ("AND", "OR", "NOT"):
            items.append(word)
            continue
        text = quoted or rest or word
        words = tuple(re.findall(r"[^\W_]+", text.lower()))
        if not words:
            continue
        if word and re.fullmatch(r"[^\W_]+(-[^\W_]+)+\*?", word):
            term = Node("OR", (Term(words, True), Term(("".join(words),), False)))
        else:
            open_end = bool(rest) or (not quoted and (text.endswith("*") or (text[-1].isalnum() and len(words[-1]) >= 2 and len(words) == 1)))
            term = Term(words, open_end)
        items += ["AND"] if items and not isinstance(items[-1], str) else []
        items.append(term)
    kept: list = []
    for x in items:
        if isinstance(x, str) and kept and isinstance(kept[-1], str):
            kept[-1] = x
        else:
            kept.append(x)
    while kept and isinstance(kept[-1], str):
        kept.pop()
    if kept and kept[0] in ("AND", "OR"):
        kept.pop(0)
    if not kept or kept[0] == "NOT":
        return None

    def level(ops: list[str]):
        if not ops:
            return kept.pop(0)
        left = level(ops[1:])
        while kept and kept[0] == ops[0]:
            op = kept.pop(0)
            left = Node(op, (left, level(ops[1:])))
        return left

    return level(["OR", "AND", "NOT"])


def leaves(tree, positive: bool = True) -> list[tuple[Term, bool]]:
    if isinstance(tree, Term):
        return [(tree, positive)]
    out = leaves(tree.args[0], positive)
    return out + leaves(tree.args[1], positive and tree.op != "NOT")


def index(p: DataFrame, stem: bool = False) -> DataFrame:
    """Postings (book_id, chapter, ord, term, tf, positions, length): one row for each term of a paragraph (Q06, Q13). A filter on term goes below the one shuffle."""
    t = T.terms(F.col("text"))
    if stem:
        from quire.functions.udfs import stems

        t = stems(t)
    # The length is worked out before the words are rows, else it would be again for each of them.
    d = p.select("book_id", "chapter", "ord", t.alias("t")).select("book_id", "chapter", "ord", F.size("t").cast("long").alias("length"), "t")
    d = d.select("book_id", "chapter", "ord", "length", F.posexplode("t").alias("at", "term"))
    d = d.groupBy("book_id", "chapter", "ord", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("positions"), F.max("length").alias("length"))
    return d.select("book_id", "chapter", "ord", "term", "tf", "positions", "length")


#: Columns of stored postings.
POSTING = "book_id string, chapter long, ord long, term string, tf long, positions array<int>, length long"
POSTINGS = pa.schema([("book_id", pa.string()), ("chapter", pa.int64()), ("ord", pa.int64()), ("term", pa.string()), ("tf", pa.int64()), ("positions", pa.list_(pa.int32())), ("length", pa.int64())])
#: Words of paragraphs that are packed at once, and that a bucket holds at most, about.
PART, BUCKET = 500_000, 1_000_000


def _postings(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of the paragraphs (book_id, chapter, ord, words), by term, chapter and ord."""
    words = pc.split_pattern(rows["words"], " ")
    size, flat = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
    place = [pc.fill_null(rows[c], -(2**63)).to_numpy() for c in ("chapter", "ord")]
    by_place = np.lexsort(place[::-1])
    rank, n = np.empty(len(size), np.int64), len(size)
    rank[by_place] = np.arange(n)
    by_term = pc.sort_indices(flat.dictionary).to_numpy()
    code = np.empty(len(by_term), np.int64)
    code[by_term] = np.arange(len(by_term))
    key = code[flat.indices.to_numpy()] * n + np.repeat(rank, size)
    at = (np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    row, end = pa.array(by_place[key[start] % n]), np.append(start, len(key)).astype(np.int32)
    term = flat.dictionary.take(pa.array(by_term[key[start] // n]))
    columns = [*(rows[c].take(row) for c in ("book_id", "chapter", "ord")), term, pa.array(np.diff(end).astype(np.int64)), pa.ListArray.from_arrays(pa.array(end), pa.array(at)), pa.array(size.astype(np.int64)).take(row)]
    return pa.RecordBatch.from_arrays(columns, schema=POSTINGS)


def _write_postings(p: DataFrame, folder: str, words: int, buckets: int, mode: str) -> None:
    """Writes the postings of p by ranges of (term, chapter, ord), a file each and ordered in it.

    A paragraph's postings are made where it is read. Their one shuffle is of blocks, sorted and squeezed; a sample of
    about 20,000 postings says where ranges end and nothing else.
    """
    buckets = max(buckets, words // BUCKET)
    t = p.select(F.col("book_id").cast("string"), F.col("chapter").cast("long"), F.col("ord").cast("long"), T.terms(F.col("text")).alias("t"))
    share = max(1, words // 2_000_000)
    some = t.where(F.pmod(F.xxhash64("chapter", "ord"), F.lit(share)) == 0).select(F.explode(F.array_distinct("t")).alias("term"), "chapter", "ord")
    some = some.where(F.pmod(F.xxhash64("term", "chapter", "ord"), F.lit(max(1, words // share // 20_000))) == 0)
    seen = sorted((r["term"], -(2**63) if r["chapter"] is None else r["chapter"], r["ord"]) for r in some.collect())
    bounds = [seen[len(seen) * i // buckets] for i in range(1, buckets)] if seen else []

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The paragraphs in parts of about PART words, a longer one alone."""
        held, words = [], 0
        for batch in batches:
            total = np.cumsum(batch["n"].to_numpy()) + words
            cuts = np.unique(np.append(np.searchsorted(total, np.arange(PART, total[-1] + 1 if len(total) else 0, PART)) + 1, 0))
            for lo, hi in itertools.pairwise(np.unique(np.append(cuts, len(batch))).tolist()):
                held.append(batch.slice(lo, hi - lo))
                if hi in cuts:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
            words = int(total[-1]) % PART if len(total) else words
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            x = _postings(part)
            run, chapter, ord_ = pc.run_end_encode(x["term"]), *(pc.fill_null(x[c], -(2**63)).to_numpy() for c in ("chapter", "ord"))
            terms, ends, at = run.values.to_pylist(), run.run_ends.to_pylist(), [0]
            for term, c, o in bounds:
                i = bisect.bisect_left(terms, term)
                a = ends[i - 1] if i else 0
                if i < len(terms) and terms[i] == term:
                    own = chapter[a : ends[i]]
                    a, b = a + int(np.searchsorted(own, c)), a + int(np.searchsorted(own, c, "right"))
                    a += int(np.searchsorted(ord_[a:b], o))
                at.append(a)
            for bucket, (a, b) in enumerate(itertools.pairwise([*at, len(x)])):
                if a < b:
                    out = io.BytesIO()
                    pq.write_table(pa.Table.from_batches([x.slice(a, b - a)]), out, compression="zstd", write_statistics=False, store_schema=False)
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([out.getvalue()])], names=["bucket", "data"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, data in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist(), strict=True):
                held.setdefault(bucket, []).append(data)
        for bucket in sorted(held):
            found = pa.concat_tables([pq.read_table(io.BytesIO(data), use_threads=False).cast(POSTINGS) for data in held.pop(bucket)])
            yield from found.sort_by([(c, "ascending") for c in ("term", "chapter", "ord")]).to_batches(100_000)

    t = t.where(F.size("t") > 0).select("book_id", "chapter", "ord", F.size("t").alias("n"), F.array_join("t", " ").alias("words"))
    blocks = t.mapInArrow(_released(packed), "bucket int, data binary").repartitionById(buckets, "bucket")
    _stored(blocks.mapInArrow(_released(merged), POSTING), f"{folder}/postings", mode)
    del blocks
    _tidy(p.sparkSession)


def _released(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A step of mapInArrow that gives its memory back when a task ends, as Python workers stay."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only where the C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def _tidy(spark) -> None:
    """Lets Spark delete the shuffle files of what is over, which it does once the driver's garbage is collected."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def _stored(postings: DataFrame, path: str, mode: str) -> None:
    """Small row groups, so that a search reads little of a file that holds several ranges."""
    postings.write.mode(mode).option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)


def _totals(p: DataFrame) -> DataFrame:
    return p.select(F.size(T.terms(F.col("text"))).alias("n")).agg(F.count("*").alias("N"), F.avg("n").alias("avgdl"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("terms"))


def build_index(p: DataFrame, folder: str, buckets: int = 64) -> None:
    """Stores the index of paragraphs (book_id, chapter, ord, text): postings by ranges of terms and one row of totals (Q11).

    Postings are ordered by term inside `buckets` ranges or more, so a search opens the files and row groups of its words
    only.
    """
    _totals(p).write.mode("overwrite").parquet(f"{folder}/totals")
    _write_postings(p, folder, p.sparkSession.read.parquet(f"{folder}/totals").first()["terms"], buckets, "overwrite")


def update_index(folder: str, new: str, changed: DataFrame, p: DataFrame, buckets: int = 64) -> None:
    """Writes to the folder `new` the index of `folder` with the paragraphs of the chapters (chapter) in `changed` as they are in p; chapters that p lacks go.

    What stays is copied without a shuffle, for a million changed chapters or fewer; the others' postings lie in files
    beside it. The old index stays whole until the new one is put in its place.
    """
    spark = p.sparkSession
    old = spark.read.parquet(f"{folder}/postings")
    keys = changed.select("chapter").distinct()
    keys = F.broadcast(keys) if few(keys, 1_000_000) else keys
    _stored(old.join(keys, "chapter", "left_anti").select(old.columns), f"{new}/postings", "overwrite")
    # Paragraphs without a term have no posting, so the totals come from the paragraphs themselves.
    _totals(p).write.mode("overwrite").parquet(f"{new}/totals")
    _write_postings(p.join(keys, "chapter", "left_semi"), new, spark.read.parquet(f"{new}/totals").first()["terms"], buckets, "append")


def search_index(spark, folder: str, typed: str, limit: int | None = LIMIT) -> DataFrame:
    """search() over a stored index."""
    return _ranked(spark, parse(typed), spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/totals").select("N", "avgdl"), limit)


def evaluate(postings: DataFrame, tree) -> DataFrame:
    """(book_id, chapter, ord, length, f0, f1, ...): how often each leaf occurs in the paragraphs that the tree asks for."""
    return _hits(postings, tree).where(_holds(tree))


def _hits(postings: DataFrame, tree) -> DataFrame:
    """evaluate() of all paragraphs with a word of a leaf.

    Postings are filtered by the leaves' words before the one shuffle by paragraph; phrases are checked on positions.
    """
    terms = [t for t, _ in leaves(tree)]
    wanted = F.lit(False)
    for t in terms:
        for i, w in enumerate(t.words):
            wanted = wanted | (F.col("term").startswith(w) if t.prefix and i == len(t.words) - 1 else F.col("term") == w)
    hits = postings.where(wanted).groupBy("book_id", "chapter", "ord").agg(F.max("length").alias("length"), F.collect_list(F.struct("term", "positions")).alias("h"))

    def places(w: str, prefix: bool) -> Column:
        return F.flatten(F.transform(F.filter("h", lambda x: x["term"].startswith(w) if prefix else x["term"] == w), lambda x: x["positions"]))

    for n, t in enumerate(terms):
        first = places(t.words[0], t.prefix and len(t.words) == 1)
        ok = first
        for i, w in enumerate(t.words[1:], 1):
            nxt = places(w, t.prefix and i == len(t.words) - 1)
            ok = _followed(ok, nxt, i)
        hits = hits.withColumn(f"f{n}", F.size(ok).cast("long"))
    return hits.drop("h")


def _holds(tree) -> Column:
    """Whether the tree asks for a row of _hits()."""
    count = iter(range(len(leaves(tree))))

    def holds(node) -> Column:
        if isinstance(node, Term):
            return F.col(f"f{next(count)}") > 0
        a, b = holds(node.args[0]), holds(node.args[1])
        return a & b if node.op == "AND" else a | b if node.op == "OR" else a & ~b

    return holds(tree)


def _followed(starts: Column, places: Column, by: int) -> Column:
    return F.filter(starts, lambda p: F.array_contains(places, p + by))


def search(p: DataFrame, typed: str, limit: int | None = LIMIT, stem: bool = False) -> DataFrame:
    """(rank, book_id, chapter, ord, score) of the best paragraphs by BM25, the smaller score the better.

    Terms under NOT do not count for the rank. Corpus statistics are one row and leaf counts one row, both crossed in.
    """
    total = p.agg(F.count("*").alias("N"), F.avg(F.size(T.terms(F.col("text")))).alias("avgdl"))
    return _ranked(p.sparkSession, parse(typed), index(p, stem), total, limit)


def _ranked(spark, tree, postings: DataFrame, total: DataFrame, limit: int | None) -> DataFrame:
    from pyspark.sql import Window

    if tree is None:
        return spark.createDataFrame([], "rank long, book_id string, chapter long, ord long, score double")
    count = [i for i, (_, good) in enumerate(leaves(tree)) if good]
    hits = _hits(postings, tree)
    # Both uses need a hit's length, so their shuffle is the same one and is made once.
    seen = hits.agg(*[F.count_if((F.col(f"f{i}") > 0) & F.col("length").isNotNull()).alias(f"n{j}") for j, i in enumerate(count)])
    found = hits.where(_holds(tree)).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(seen))  # one row each
    score = F.lit(0.0)
    for j, i in enumerate(count):
        n = F.col(f"n{j}")
        idf = F.ln((F.col("N") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
        f = F.col(f"f{i}")
        score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    found = found.select("book_id", "chapter", "ord", F.round(score, 6).alias("score"))
    if limit is None:
        return found
    best = found.orderBy("score", "book_id", "chapter", "ord").limit(limit)
    w = Window.orderBy("score", "book_id", "chapter", "ord")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).select("rank", "book_id", "chapter", "ord", "score")


def matches(p: DataFrame, typed: str) -> DataFrame:
    """(book_id, chapter, ord) of the paragraphs that the search asks for."""
    tree = parse(typed)
    return evaluate(index(p), tree).select("book_id", "chapter", "ord") if tree else p.select("book_id", "chapter", "ord").where("false")


def snippets(p: DataFrame, word: str, width: int = SNIPPET) -> DataFrame:
    """(chapter, ord, snippet): `width` terms from five before the first hit on, hits in brackets, ... where something is cut (Q08, Q09)."""
    d = p.select("chapter", "ord", T.terms(F.col("text")).alias("t"))
    d = d.withColumn("at", F.array_position("t", word)).where("at > 0")
    start = F.greatest(F.lit(1).cast("bigint"), F.col("at") - 5)
    cut = F.transform(F.slice("t", start.cast("int"), width), lambda x: F.when(x == word, F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    text = F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(cut, " "), F.when(start + width - 1 < F.size("t"), "...").otherwise(""))
    return d.select("chapter", "ord", text.alias("snippet"))


def statistics(p: DataFrame) -> DataFrame:
    """(term, df, cf, idf) of the corpus (Q06). Terms are counted with map-side sums; no positions are made."""
    t = p.select(T.terms(F.col("text")).alias("t"))
    one = lambda terms, df, cf: F.transform(terms, lambda x: F.named_struct(F.lit("term"), x, F.lit("df"), F.lit(df), F.lit("cf"), F.lit(cf)))
    rows = t.select(F.inline(F.concat(one(F.col("t"), 0, 1), one(F.array_distinct("t"), 1, 0))))
    d = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return d.crossJoin(F.broadcast(p.agg(F.count("*").alias("N")))).select("term", "df", "cf", F.round(F.ln((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def relocate(docs: DataFrame, quotes: DataFrame, gram: int = 6) -> DataFrame:
    """(item_id, chapter, start_word, end_word): each place where a quote's words stand in a chapter, whatever the blanks (Q15, Q16).

    Quotes meet texts by the hash of their first `gram` words, shorter ones by that of all their words, so there is no
    pairwise comparison; quotes without words take no part. Keys are broadcast where few, and joined by shuffle where not.
    """
    words = lambda c: F.filter(F.split(c, r"\s+", -1), lambda w: w != "")
    d = docs.select(F.col("doc_id").alias("chapter"), words(F.col("text")).alias("w"))
    q = quotes.select("item_id", words(F.col("text")).alias("q")).where(F.size("q") > 0)
    q = q.withColumn("n", F.least(F.size("q"), F.lit(gram)))
    q = q.withColumn("key", F.xxhash64(F.expr("slice(q, 1, n)")))
    first = q.select("n", "key").distinct()
    sizes = [r["n"] for r in q.select("n").distinct().collect()]  # `gram` at most

    def keyed(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("w", i, n)).alias("key"), i.alias("i")))

    at = [keyed(n) for n in sorted(sizes)]
    at = F.concat(*at) if at else F.array().cast("array<struct<n:int,key:bigint,i:int>>")
    grams = d.select("chapter", F.inline(at)).join(F.broadcast(first) if few(first) else first, ["n", "key"], "left_semi")
    hits = grams.join(q, ["n", "key"]).join(d, "chapter").where(F.expr("slice(w, i, size(q)) = q"))
    return hits.select("item_id", "chapter", F.col("i").cast("long").alias("start_word"), (F.col("i") + F.size("q")).cast("long").alias("end_word"))


#: What \s is in JavaScript.
SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def place(docs: DataFrame, highlights: DataFrame) -> DataFrame:
    """(item_id, chapter, start, end): where each highlight (item_id, chapter, exact, prefix, suffix) shows in its chapter's text, from 0 (Q15).

    Characters without white space are matched, so a highlight may be of any length and start or end inside a word; of
    several copies the one with most characters of the prefix before and of the suffix after it counts, the first of equals.
    """
    h = highlights.groupBy("chapter").agg(F.collect_list(F.struct("item_id", "exact", "prefix", "suffix")).alias("h"))
    j = docs.select(F.col("doc_id").alias("chapter"), "text").where("text is not null").join(h, "chapter")
    bare = lambda t: re.sub(SPACE, "", t or "")

    def alike(pairs) -> int:
        return sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], pairs))

    def run(batches):
        for pdf in batches:
            out = []
            for chapter, text, rows in zip(pdf["chapter"], pdf["text"], pdf["h"], strict=True):
                places = [i for i, c in enumerate(text) if not re.match(SPACE, c)]
                shown = "".join(text[i] for i in places)
                for r in rows:
                    exact, prefix, suffix = bare(r["exact"]), bare(r["prefix"])[::-1], bare(r["suffix"])
                    best, most, at = -1, -1, shown.find(exact) if exact else -1
                    while at >= 0 and most < len(prefix) + len(suffix):
                        end = at + len(exact)
                        score = alike(zip(prefix, shown[max(0, at - len(prefix)) : at][::-1])) + alike(zip(suffix, shown[end : end + len(suffix)]))
                        if score > most:
                            best, most = at, score
                        at = shown.find(exact, at + 1)
                    if best >= 0:
                        out.append((r["item_id"], chapter, places[best], places[best + len(exact) - 1] + 1))
            yield pd.DataFrame(out, columns=["item_id", "chapter", "start", "end"])

    return j.mapInPandas(run, f"item_id {highlights.schema['item_id'].dataType.simpleString()}, chapter long, start long, end long")


def few(rows: DataFrame, most: int = 100_000) -> bool:
    """Whether there are few enough rows to broadcast."""
    return rows.limit(most + 1).count() <= most
