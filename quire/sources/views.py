"""Readers of the tables, and the deterministic views of them that stand in for books, logs and notes.

A document's source is its book and its id the chapter; its lines are the paragraphs. Events are reviews and reading;
conversation turns are notes, highlights and saved words; benchmark texts are quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1_706_745_600
HEADING = r"^#{1,6}([ \t]|$)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def anchor(n: Column) -> Column:
    """^p-NNN, three digits at least."""
    return F.concat(F.lit("^p-"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))


def blocks(text: Column, separator: str = "\n") -> Column:
    """The trimmed, non-empty blocks of a text, line endings made one."""
    same = F.regexp_replace(text, "\r\n?", "\n")
    return F.filter(F.transform(F.split(same, separator, -1), lambda b: F.trim(b)), lambda b: b != "")


def paragraphs(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """(book_id, chapter, ord, anchor, text): blocks that are no headings, numbered from 1 in their chapter (C06, W01). A map without a shuffle."""
    rows = F.posexplode(F.filter(blocks(F.col("text"), separator), lambda b: ~b.rlike(HEADING))).alias("pos", "block")
    p = docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter"), rows)
    ord_ = (F.col("pos") + 1).cast("long")
    return p.select("book_id", "chapter", ord_.alias("ord"), anchor(ord_).alias("anchor"), F.col("block").alias("text"))


def sentences(text: Column) -> Column:
    """Sentences A: cut after . ! or ? and space before a capital, digit or quote; blanks squeezed; a piece that ends in an abbreviation takes the next."""
    pieces = F.filter(F.transform(F.split(text, r'(?<=[.!?])\s+(?=[A-Z0-9"])', -1), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    add = lambda acc, s: F.when((F.size(acc) > 0) & F.element_at(F.concat(acc, F.array(s)), F.greatest(F.size(acc), F.lit(1))).rlike(ABBREVIATION), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(F.concat(acc, F.array(s)), F.greatest(F.size(acc), F.lit(1))), s)))).otherwise(F.concat(acc, F.array(s)))
    folded = F.aggregate(pieces, F.array().cast("array<string>"), add)
    return F.when(F.exists(pieces, lambda s: s.rlike(ABBREVIATION)), folded).otherwise(pieces)


#: Ends that do not end a sentence, in any case and also inside a word; a fixed list.
ABBREVIATIONS = ("e.g.", "i.e.", "dr.", "mr.", "mrs.", "prof.", "fig.", "vs.", "al.")
ABBREVIATION = r"(?i)(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + ")$"


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without a zone."""
    return F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def reviews(events: DataFrame) -> DataFrame:
    """(card_id, book_id, rating, reviewed_at, seq): error is 1, view 2, click 3, purchase 4; a sign-up has no rating."""
    rating = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "purchase", 4)
    return events.select(F.col("user_id").alias("card_id"), F.concat(F.lit("b"), (F.col("user_id") % 5).cast("string")).alias("book_id"), rating.cast("long").alias("rating"), seconds(F.col("ts")).alias("reviewed_at"), F.col("event_id").alias("seq"))


def reading(events: DataFrame) -> DataFrame:
    """(book_id, chapter_file, seconds, completed, read_at, seq)."""
    chapter = F.concat(F.lit("ch-"), F.lpad((F.col("user_id") % 12 + 1).cast("string"), 2, "0"), F.lit(".md"))
    return events.select(F.concat(F.lit("b"), (F.col("user_id") % 5).cast("string")).alias("book_id"), chapter.alias("chapter_file"), F.floor("value").cast("long").alias("seconds"), (F.col("event_type") == "purchase").alias("completed"), seconds(F.col("ts")).alias("read_at"), F.col("event_id").alias("seq"))


def notes(conversations: DataFrame) -> DataFrame:
    """(id, item_type, book_id, chapter, ord, text): a user's turn is a note, an assistant's a highlight, the system's a word."""
    kind = F.when(F.col("role") == "user", "note").when(F.col("role") == "assistant", "highlight").otherwise("word")
    return conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"), kind.alias("item_type"), F.concat(F.lit("b"), (F.col("conv_id") % 5).cast("string")).alias("book_id"), (F.col("conv_id") % 15).alias("chapter"), F.col("turn").alias("ord"), "text", "conv_id")


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good lines, damaged lines) of a log of JSON lines; blank lines are skipped, a bad line never hides the good ones."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    raw = spark.read.text(path).where("trim(value) <> ''").select("value", F.from_json("value", f"{schema}, _bad string", options).alias("r"))
    return raw.where("r._bad is null").select("r.*").drop("_bad"), raw.where("r._bad is not null").select(F.col("value").alias("line"))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON; a damaged file is an error and never read as empty."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_chapters(spark: SparkSession, root: str) -> DataFrame:
    """(book_id, chapter_file, text, sha256) of root/<book>/ch-*.md."""
    files = spark.read.text(f"{root}/*/ch-*.md", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("book_id"), F.regexp_extract("path", r"[^/]+$", 0).alias("chapter_file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"), F.sha2("value", 256).alias("sha256"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, changed, sha256) of all files under root, for snapshots."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"), F.sha2("content", 256).alias("sha256"))
