"""Paragraph, sentence and chapter operators over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources import views as V


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(book_id, chapter, ord, sentence, is_first, is_last, text) of each paragraph (T02, W03). Arrays only, no shuffle."""
    p = V.paragraphs(docs).withColumn("all", V.sentences(F.col("text")))
    rows = p.select("book_id", "chapter", "ord", F.size("all").alias("n"), F.posexplode("all").alias("pos", "text"))
    return rows.select("book_id", "chapter", "ord", (F.col("pos") + 1).cast("long").alias("sentence"), (F.col("pos") == 0).alias("is_first"), (F.col("pos") + 1 == F.col("n")).alias("is_last"), "text")


def first_last(p: DataFrame) -> DataFrame:
    """First and last anchor and number of paragraphs by chapter."""
    return p.groupBy("book_id", "chapter").agg(F.min_by("anchor", "ord").alias("first_anchor"), F.max_by("anchor", "ord").alias("last_anchor"), F.count("*").alias("n_paragraphs"))


def head_tail(docs: DataFrame, depth: int = 2) -> DataFrame:
    """The first and last `depth` paragraphs of each chapter; where they would overlap the first half, rounded up, is head."""
    arr = F.filter(V.blocks(F.col("text")), lambda b: ~b.rlike(V.HEADING))
    d = docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter"), F.size(arr).alias("n"), F.posexplode(arr).alias("pos", "text"))
    head = F.when((F.col("n") >= 2) & (F.col("n") < 2 * depth), F.ceil(F.col("n") / 2)).when(F.col("n") == 1, 1).otherwise(depth)
    tail = F.greatest(F.lit(0), F.least(F.lit(depth), F.col("n") - head))
    part = F.when(F.col("pos") < head, "head").when(F.col("pos") >= F.col("n") - tail, "tail")
    return d.select("book_id", "chapter", V.anchor(F.col("pos") + 1).alias("anchor"), part.alias("part")).where("part is not null")


def library(docs: DataFrame) -> DataFrame:
    """Books by lower title: chapters, words, minutes at 225 words and running total of words."""
    b = docs.groupBy(F.col("source").alias("book_id")).agg(F.count("*").alias("chapters"), F.sum(T.word_count(F.col("text"))).cast("long").alias("total_words"))
    w = Window.orderBy(F.lower("book_id"), "book_id")  # one row a book
    return b.select("book_id", "chapters", "total_words", F.expr("total_words div 225").alias("minutes"), F.row_number().over(w).cast("long").alias("place"))


def readability(docs: DataFrame) -> DataFrame:
    """Words, sentences, syllables, grade and minutes of each text (T04, T06, A14). Array functions only."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    pieces = F.filter(F.split("text", r"[.!?]+(\s+|$)", -1), lambda s: F.trim(s) != "")
    d = docs.select("doc_id", words.alias("w"), F.greatest(F.size(pieces), F.lit(1)).cast("long").alias("sentences")).where(F.size("w") > 0)
    d = d.select("doc_id", F.size("w").cast("long").alias("words"), "sentences", F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + T.syllables(x)).alias("syllables"))
    return d.select("doc_id", "words", "sentences", "syllables", T.grade(F.col("words"), F.col("sentences"), F.col("syllables")).alias("grade"), T.minutes(F.col("words")).alias("minutes"))


def salient(docs: DataFrame) -> DataFrame:
    """Sentences with their salience."""
    s = sentence_rows(docs)
    return s.withColumn("score", T.salience(F.col("text"), F.col("is_first"), F.col("is_last")))


def top_per_chapter(scored: DataFrame, n: int = 8) -> DataFrame:
    """The n best sentences of each chapter, earlier ones first among equals."""
    w = Window.partitionBy("chapter").orderBy(F.desc("score"), "ord", "sentence")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n).select("chapter", "rank", "ord", "sentence", "score")


def overlaps(docs: DataFrame) -> DataFrame:
    """Keywords that neighbouring paragraphs of a chapter share."""
    arr = F.transform(F.filter(V.blocks(F.col("text")), lambda b: ~b.rlike(V.HEADING)), T.keywords)
    d = docs.select(F.col("doc_id").alias("chapter"), arr.alias("k")).where(F.size("k") > 1)
    pairs = F.zip_with(F.slice("k", 1, F.size("k") - 1), F.slice("k", 2, F.size("k")), lambda a, b: F.size(F.array_intersect(a, b)).cast("long"))
    return d.select("chapter", F.posexplode(pairs).alias("pos", "shared")).select("chapter", (F.col("pos") + 1).cast("long").alias("ord"), "shared")


def violations(docs: DataFrame) -> DataFrame:
    """One row for each check a chapter fails (C11, A25, F09, F10): no text, unreadable characters, too long lines, footnotes without notes."""
    b = V.blocks(F.col("text"))
    checks = F.array(
        F.when(F.coalesce(F.size(F.filter(b, lambda x: ~x.rlike(V.HEADING))), F.lit(0)) <= 0, "no_text"),
        F.when(F.col("text").contains("�"), "unreadable"),
        F.when(F.exists(b, lambda x: F.length(x) > 2000), "long_block"),
        F.when(F.exists(b, lambda x: x.rlike(r"([!#$%&*]{2,}\s+\S+){4}")), "marks"),
        F.when(F.col("text").rlike(r"\[\^[^\]]+\]") & ~F.col("text").rlike(r"(?m)^\[\^[^\]]+\]:"), "footnote_without_note"),
    )
    return docs.select(F.col("doc_id").alias("chapter"), F.explode(F.array_compact(checks)).alias("violation"))


def invented_first_words(docs: DataFrame) -> DataFrame:
    """Opening words seen at most once in their book whose rest, without the first letter, is seen three times or more (T31). Counts are joined, never gathered."""
    words = docs.select(F.col("source").alias("book_id"), F.explode(T.terms(F.col("text"))).alias("word")).groupBy("book_id", "word").agg(F.count("*").alias("seen"))
    p = V.paragraphs(docs).select("book_id", "chapter", "ord", F.get(T.terms(F.col("text")), F.lit(0)).alias("word")).where("length(word) >= 4")
    p = p.withColumn("rest", F.expr("substr(word, 2)"))
    rare = p.join(words.where("seen <= 1").select("book_id", "word"), ["book_id", "word"])
    return rare.join(words.where("seen >= 3").select("book_id", F.col("word").alias("rest"), F.col("seen").alias("rest_seen")), ["book_id", "rest"]).select("book_id", "chapter", "ord", "word", "rest_seen")


def changed(new: DataFrame, old: DataFrame, version: str = "2") -> DataFrame:
    """(doc_id, status): new, changed, same or gone, by the hash of version and text."""
    h = F.sha2(F.concat(F.lit(f"{version}\n"), F.col("text")), 256)
    a, b = new.select("doc_id", h.alias("h")), old.select(F.col("doc_id").alias("o_id"), h.alias("o"))
    j = a.join(b, a.doc_id == b.o_id, "full")
    status = F.when(F.col("o_id").isNull(), "new").when(F.col("doc_id").isNull(), "gone").when(F.col("h") != F.col("o"), "changed").otherwise("same")
    return j.select(F.coalesce("doc_id", "o_id").alias("doc_id"), status.alias("status"))


def old_version(docs: DataFrame) -> DataFrame:
    """An earlier state made from docs: every seventh is missing, every fifth differs, and one more book is there."""
    d = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    return d.select("doc_id", "text").unionByName(docs.where("doc_id % 11 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), "text"))


def repeated_terms(docs: DataFrame, n: int = 20, least: int = 2) -> DataFrame:
    """Runs of two or three naming words that a chapter repeats, ranked by count times words squared, then first seen."""
    ok = lambda t: (F.length(t) >= 4) & ~t.isin(*T.STOPWORDS)
    d = docs.select(F.col("doc_id").alias("chapter"), T.terms(F.col("text")).alias("t")).where(F.size("t") > 1)
    at = lambda i, w: F.slice(F.col("t"), i, w)

    def runs(w: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("t") - (w - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(w).alias("words"), at(i, w).alias("g")))

    grams = d.select("chapter", F.explode(F.filter(F.concat(runs(2), runs(3)), lambda g: (F.size(g["g"]) == g["words"]) & F.forall(g["g"], ok))).alias("g"))
    counts = grams.groupBy("chapter", F.concat_ws(" ", "g.g").alias("term"), F.col("g.words").cast("long").alias("words")).agg(F.count("*").alias("n"), F.min("g.pos").cast("long").alias("first_seen")).where(F.col("n") >= least)
    w = Window.partitionBy("chapter").orderBy(F.desc(F.col("n") * F.col("words") * F.col("words")), "first_seen", "words")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n).select("chapter", "rank", "term", "words", "n", "first_seen")
