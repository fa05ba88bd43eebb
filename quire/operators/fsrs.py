"""FSRS-5 scheduling as column expressions, and the fold of a card's reviews into its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the scheduler.
W = (0.40255, 1.18385, 3.173, 15.69105, 7.1949, 0.5345, 1.4604, 0.0046, 1.54575, 0.1192, 1.01925, 1.9395, 0.11, 0.29605, 2.2698, 0.2315, 2.9898, 0.51655, 0.6621)
FACTOR, DECAY, RETENTION, MAX_DAYS, AGAIN_SECONDS, DAY = 19 / 81, -0.5, 0.9, 36_500, 600, 86_400
NEW, LEARNING, REVIEW, RELEARNING = 0, 1, 2, 3


def retrievability(days: Column, stability: Column) -> Column:
    """Chance of recall after some days."""
    return F.when(stability <= 0, 0.0).otherwise(F.pow(F.lit(1.0) + F.lit(FACTOR) * F.greatest(days, F.lit(0.0)) / stability, F.lit(DECAY)))


def _clamp(d: Column) -> Column:
    return F.least(F.greatest(d, F.lit(1.0)), F.lit(10.0))


def first_stability(rating: Column) -> Column:
    """P02."""
    return F.greatest(F.element_at(F.array(*map(F.lit, W[:4])), rating.cast("int")), F.lit(0.1))


def first_difficulty(rating: Column) -> Column:
    """P03."""
    return _clamp(F.lit(W[4]) - F.exp(F.lit(W[5]) * (rating - 1)) + 1)


def next_difficulty(d: Column, rating: Column) -> Column:
    """Damped towards 10, then reverted to the easy start."""
    moved = d + (F.lit(10.0) - d) * (F.lit(-W[6]) * (rating - 3)) / 9
    return _clamp(F.lit(W[7]) * first_difficulty(F.lit(4)) + F.lit(1 - W[7]) * moved)


def same_day(s: Column, rating: Column) -> Column:
    """P06."""
    return s * F.exp(F.lit(W[17]) * (rating - 3 + F.lit(W[18])))


def next_stability(d: Column, s: Column, r: Column, rating: Column) -> Column:
    """After a day or more: grown by recall, or what is left after forgetting."""
    grown = s * (1 + F.lit(2.718281828459045**W[8]) * (F.lit(11.0) - d) * F.pow(s, F.lit(-W[9])) * (F.exp((F.lit(1.0) - r) * W[10]) - 1) * F.when(rating == 2, W[15]).otherwise(1.0) * F.when(rating == 4, W[16]).otherwise(1.0))
    left = F.lit(W[11]) * F.pow(d, F.lit(-W[12])) * (F.pow(s + 1, F.lit(W[13])) - 1) * F.exp((F.lit(1.0) - r) * W[14])
    return F.when(rating == 1, F.least(left, s / F.exp(F.lit(W[17] * W[18])))).otherwise(grown)


def interval(s: Column, retention: float = RETENTION) -> Column:
    """Whole days until recall falls to the wanted chance."""
    grow = min(max(retention, 0.7), 0.98) ** (1 / DECAY) - 1
    return F.greatest(F.lit(1), F.least(F.lit(MAX_DAYS), F.round(s / F.lit(FACTOR) * F.lit(grow)))).cast("long")


STATE = "struct<state:bigint,stability:double,difficulty:double,due:bigint,reps:bigint,last:bigint>"


def step(card: Column, rating: Column, now: Column) -> Column:
    """The card's state after one review."""
    new = card["state"] == NEW
    days = F.floor(F.greatest(now - card["last"], F.lit(0)) / DAY)
    r = retrievability(days.cast("double"), card["stability"])
    s = F.when(new, first_stability(rating)).when(days == 0, same_day(card["stability"], rating)).otherwise(next_stability(card["difficulty"], card["stability"], r, rating))
    d = F.when(new, first_difficulty(rating)).otherwise(next_difficulty(card["difficulty"], rating))
    state = F.when(rating == 1, F.when(card["state"].isin(NEW, LEARNING), LEARNING).otherwise(RELEARNING)).otherwise(REVIEW)
    made = F.struct(state.cast("long").alias("state"), s.alias("stability"), d.alias("difficulty"), now.alias("due"), (card["reps"] + 1).alias("reps"), now.alias("last"))
    due = F.transform(F.array(made), lambda m: F.struct(m["state"].alias("state"), m["stability"].alias("stability"), m["difficulty"].alias("difficulty"), F.when(rating == 1, now + AGAIN_SECONDS).otherwise(now + interval(m["stability"]) * DAY).alias("due"), m["reps"].alias("reps"), now.alias("last")))
    return due[0].cast(STATE)


def replay(reviews: DataFrame) -> DataFrame:
    """(card_id, book_id, state, stability, difficulty, due, reps, last_review): each card's rated reviews folded in time order.

    The fold is one JVM expression over a card's own sorted reviews; cards are independent of each other.
    """
    start = F.struct(F.lit(0).cast("long").alias("state"), F.lit(0.0).alias("stability"), F.lit(0.0).alias("difficulty"), F.lit(0).cast("long").alias("due"), F.lit(0).cast("long").alias("reps"), F.lit(0).cast("long").alias("last"))
    log = F.sort_array(F.collect_list(F.struct("reviewed_at", "seq", "rating")))
    d = reviews.where("rating is not null").groupBy("card_id", "book_id").agg(log.alias("log"))
    d = d.select("card_id", "book_id", F.aggregate("log", start, lambda acc, x: step(acc, x["rating"], x["reviewed_at"])).alias("s"))
    return d.select("card_id", "book_id", "s.state", "s.stability", "s.difficulty", "s.due", "s.reps", F.col("s.last").alias("last_review"))


def rounded(cards: DataFrame) -> DataFrame:
    return cards.withColumn("stability", F.round("stability", 6)).withColumn("difficulty", F.round("difficulty", 6))


def new_cards(spark) -> DataFrame:
    """Stability, difficulty and wait in seconds of a new card by its first rating."""
    r = spark.range(1, 5).select(F.col("id").alias("rating"))
    s = first_stability(F.col("rating"))
    return r.select("rating", F.round(s, 6).alias("stability"), F.round(first_difficulty(F.col("rating")), 6).alias("difficulty"), F.when(F.col("rating") == 1, F.lit(AGAIN_SECONDS)).otherwise(interval(s) * DAY).cast("long").alias("wait"))
