"""Queues of due cards, study and reading analytics, streaks and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import fsrs
from quire.sources.views import NOW

DAY, MASTERED, BLOCK = 86_400, 21.0, 900


def cards(reviews: DataFrame) -> DataFrame:
    """Replayed cards, and those never rated as new ones due now; a card is of type scenario where its id is divisible by 3."""
    done = fsrs.replay(reviews)
    new = reviews.select("card_id", "book_id").distinct().join(done.select("card_id"), "card_id", "left_anti")
    zero = lambda n: F.lit(0).cast("long").alias(n)
    new = new.select("card_id", "book_id", zero("state"), F.lit(0.0).alias("stability"), F.lit(0.0).alias("difficulty"), F.lit(NOW).cast("long").alias("due"), zero("reps"), zero("last_review"))
    return done.unionByName(new).withColumn("kind", F.when(F.col("card_id") % 3 == 0, "scenario").otherwise("cloze"))


def fresh(c: DataFrame, every: int = 7) -> DataFrame:
    """c with every seventh card set back to new, so that queues have both kinds."""
    new = F.col("card_id") % every == 0
    for name in ("state", "reps", "last_review"):
        c = c.withColumn(name, F.when(new, F.lit(0).cast("long")).otherwise(F.col(name)))
    return c.withColumn("due", F.when(new, F.lit(NOW).cast("long")).otherwise(F.col("due")))


def queue(c: DataFrame, now: int = NOW, limit: int = 50) -> DataFrame:
    """Reviewed cards that are due by due time, then new ones in the places left (F02, F03, L02, L03, P11). Two bounded top-k selections."""
    limit = max(1, limit)
    due = c.where((F.col("reps") > 0) & (F.col("due") <= now)).select(F.lit(0).cast("long").alias("phase"), "due", "card_id", "kind").orderBy("due", "card_id").limit(limit)
    new = c.where("reps = 0").select(F.lit(1).cast("long").alias("phase"), "due", "card_id", "kind").orderBy("due", "card_id").limit(limit)
    w = Window.orderBy("phase", "due", "card_id")
    return due.unionByName(new).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= limit).select("place", "card_id", "kind", "phase")


def hybrid(c: DataFrame, now: int = NOW, limit: int = 30, ratio: float = 0.5) -> DataFrame:
    """Cloze and scenario cards in turn, ratio of them cloze; what one kind lacks the other fills, last."""
    ratio = min(max(ratio, 0.05), 0.95)
    want = int(limit * ratio + 0.5)
    rows = []
    for kind in ("cloze", "scenario"):
        q = queue(c.where(F.col("kind") == kind), now, limit)
        rows.append(q.withColumn("fill", (F.col("place") > (want if kind == "cloze" else limit - want)).cast("long")))
    w = Window.orderBy("fill", "place", "kind")
    both = rows[0].unionByName(rows[1])
    return both.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= limit).select("position", "card_id", "kind", "fill")


def count_of(cond: Column, name: str) -> Column:
    return F.count_if(cond).cast("long").alias(name)


def deck_stats(c: DataFrame, now: int = NOW) -> DataFrame:
    """Due or new, new, learning, review and total by book in one pass."""
    return c.groupBy("book_id").agg(count_of((F.col("due") <= now) | (F.col("reps") == 0), "due"), count_of(F.col("reps") == 0, "new"), count_of(F.col("state").isin(1, 3), "learning"), count_of(F.col("state") == 2, "review"), F.count("*").alias("total"))


def percent(share: Column) -> Column:
    """A share in percent with one decimal; null stays null."""
    return F.floor(share * 1000 + 0.5) / 10


def analytics(reviews: DataFrame, now: int = NOW) -> DataFrame:
    """One row: due within a day, total, mastered, new, retention of the log and of the model."""
    c = fresh(cards(reviews))
    days = F.when(F.col("last_review") > 0, (F.lit(now) - F.col("last_review")) / DAY).otherwise(0.0)
    model = F.avg(F.when(F.col("reps") > 0, fsrs.retrievability(days, F.col("stability"))))
    a = c.agg(count_of((F.col("due") <= now + DAY) | (F.col("reps") == 0), "due_today"), F.count("*").alias("total"), count_of((F.col("state") == 2) & (F.col("stability") >= MASTERED), "mastered"), count_of(F.col("reps") == 0, "new"), F.round(model, 4).alias("model_retention"))
    log = reviews.where("rating is not null").agg(percent(F.avg((F.col("rating") > 1).cast("double"))).alias("log_retention"))
    return a.crossJoin(F.broadcast(log))  # one row each


def blocks(reviews: DataFrame) -> DataFrame:
    """Reviews by blocks of 15 minutes."""
    return reviews.where("rating is not null").groupBy((F.col("reviewed_at") - F.col("reviewed_at") % BLOCK).alias("block")).agg(F.count("*").alias("n"))


def per_day(reviews: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Rated reviews by calendar day of a time zone."""
    day = F.expr(f"cast(convert_timezone('UTC', '{zone}', timestampadd(SECOND, cast(reviewed_at as int), timestamp_ntz'1970-01-01 00:00:00')) as date)")
    return reviews.where("rating is not null").groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def streaks(reviews: DataFrame) -> DataFrame:
    """Runs of days with a review by card: first day, last day, length (W12). Gaps and islands on distinct days."""
    day = F.floor(F.col("reviewed_at") / DAY).cast("long")
    d = reviews.where("rating is not null").select("card_id", day.alias("day")).distinct()
    w = Window.partitionBy("card_id").orderBy("day")
    d = d.withColumn("run", F.col("day") - F.row_number().over(w))
    return d.groupBy("card_id", "run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("run")


def heatmap(reviews: DataFrame, now: int = NOW, weeks: int = 52) -> DataFrame:
    """(day, week, weekday, n, level): a calendar of `weeks` weeks from a Monday to today, levels at 0, 3, 7, 14."""
    today = now // DAY
    first = today - (today + 3) % 7 - 7 * (weeks - 1)
    n = reviews.where("rating is not null").groupBy(F.floor(F.col("reviewed_at") / DAY).cast("long").alias("d")).agg(F.count("*").alias("n"))
    days = reviews.sparkSession.range(first, today + 1).select(F.col("id").alias("d"))
    c = days.join(n, "d", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    level = F.when(F.col("n") == 0, 0).when(F.col("n") <= 3, 1).when(F.col("n") <= 7, 2).when(F.col("n") <= 14, 3).otherwise(4)
    return c.select(F.col("d").alias("day"), F.floor((F.col("d") - first) / 7).cast("long").alias("week"), F.pmod(F.col("d") - first, F.lit(7)).cast("long").alias("weekday"), "n", level.cast("long").alias("level"))


def outline(spark) -> DataFrame:
    """Chapters 1 to 10 of books b0 to b4 in order, with titles."""
    s = spark.range(50).select(F.concat(F.lit("b"), F.floor(F.col("id") / 10).cast("string")).alias("book_id"), (F.col("id") % 10 + 1).alias("place"))
    return s.select("book_id", F.concat(F.lit("ch-"), F.lpad(F.col("place").cast("string"), 2, "0"), F.lit(".md")).alias("chapter_file"), "place", F.concat(F.lit("Chapter "), F.col("place").cast("string")).alias("title"))


def chapters(log: DataFrame) -> DataFrame:
    """Time, completion and last reading by chapter of the log."""
    return log.groupBy("book_id", "chapter_file").agg(F.sum("seconds").cast("long").alias("seconds"), F.bool_or("completed").alias("completed"), F.max("read_at").alias("last_read"))


def velocity(log: DataFrame) -> DataFrame:
    """Chapters read with their title and place in the book's outline, unlisted ones last without a title."""
    from pyspark.sql.functions import broadcast

    c = chapters(log)
    return c.join(broadcast(outline(log.sparkSession)), ["book_id", "chapter_file"], "left").select("book_id", "chapter_file", "title", F.coalesce("place", F.lit(999)).cast("long").alias("place"), "seconds", "completed", "last_read")


def sessions(log: DataFrame, gap: int = 1800, cap: int = 5) -> DataFrame:
    """(book_id, session, first, last, ticks, seconds): reading by book, a new session after half an hour's gap, each tick worth 5 seconds at most."""
    w = Window.partitionBy("book_id").orderBy("read_at", "seq")
    d = log.withColumn("gap", F.col("read_at") - F.lag("read_at").over(w))
    d = d.withColumn("session", F.sum((F.coalesce("gap", F.lit(gap + 1)) > gap).cast("long")).over(w))
    return d.groupBy("book_id", "session").agg(F.min("read_at").alias("first"), F.max("read_at").alias("last"), F.count("*").alias("ticks"), F.sum(F.least(F.coalesce("gap", F.lit(0)), F.lit(cap))).cast("long").alias("seconds"))


def progress(log: DataFrame) -> DataFrame:
    """Readings that reach a new whole percent of a chapter of 1000 seconds."""
    w = Window.partitionBy("book_id", "chapter_file").orderBy("read_at", "seq")
    done = F.least(F.lit(100).cast("long"), F.floor(F.sum("seconds").over(w) / 10).cast("long"))
    d = log.withColumn("percent", done)
    d = d.withColumn("was", F.lag("percent").over(w))
    return d.where("was is null or percent > was").select("book_id", "chapter_file", "read_at", "seq", "percent")
