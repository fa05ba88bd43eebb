"""The registered queries over whole tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import udfs
from quire.operators import cards, corpus, fsrs, records, search, study
from quire.plans import more, sql
from quire.sources import views as V

SEARCHES = {"search_and": "the AND with", "search_or": "zone OR nichts OR ouble", "search_not": "the NOT and", "search_prefix": "th* ouble*", "search_phrase": '"of the" AND in'}


def docs(spark, d):
    return V.table(spark, d, "documents")


def paras(spark, d):
    return V.paragraphs(docs(spark, d))


def reviews(spark, d):
    return V.reviews(V.table(spark, d, "events"))


def reading(spark, d):
    return V.reading(V.table(spark, d, "events"))


def notes(spark, d):
    return V.notes(V.table(spark, d, "conversations"))


def all_cards(spark, d):
    return study.fresh(study.cards(reviews(spark, d)))


def _blocks(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("chapter"), F.posexplode(V.blocks(F.col("text"))).alias("pos", "block")).select("chapter", F.col("pos").cast("long").alias("pos"), "block", F.col("block").rlike(V.HEADING).alias("heading"))


def _sentences(spark, d):
    return corpus.sentence_rows(docs(spark, d)).select("chapter", "ord", "sentence", "text")


def _flags(spark, d):
    return corpus.sentence_rows(docs(spark, d)).groupBy("chapter").agg(study.count_of(F.col("is_first"), "firsts"), study.count_of(F.col("is_last"), "lasts"), study.count_of(F.col("is_first") & F.col("is_last"), "alone"), F.count("*").alias("sentences"))


def _word_counts(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("chapter"), T.word_count(F.col("text")).alias("words"))


def _preview(spark, d):
    marked = F.concat(F.lit("## **"), F.col("text"), F.lit("** see [there](x) [^1]  ^p-"), F.col("ord").cast("string"))
    return paras(spark, d).select("chapter", "ord", T.preview(marked).alias("preview"))


def _html_plain(spark, d):
    return V.table(spark, d, "pages").select("page_id", T.plain(F.col("html")).alias("text"))


def _html_blocks(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.posexplode(udfs.blocks_of_html("html")).alias("pos", "b")).select("page_id", F.col("pos").cast("long").alias("pos"), "b.kind", "b.text")


def _text_forms(spark, d):
    t = F.col("text")
    return V.table(spark, d, "benchmark").select("item_id", T.squashed(t).alias("squashed"), T.matching(t).alias("matching"), T.slug(t).alias("slug"), T.fixation(F.length(t)).alias("fixation"), T.duration(F.length(t) * 37).alias("duration"))


def _eligibility(spark, d):
    s = corpus.sentence_rows(docs(spark, d))
    return s.groupBy(F.coalesce(T.eligible_sentence(F.col("text")), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def _retrievability(spark, d):
    c = fsrs.replay(reviews(spark, d))
    return c.select("card_id", F.round(fsrs.retrievability((F.lit(V.NOW) - F.col("last_review")) / 86_400, F.col("stability")), 6).alias("chance"))


def _calendar(spark, d):
    return fsrs.replay(reviews(spark, d)).groupBy(F.floor(F.col("due") / 86_400).cast("long").alias("day")).agg(F.count("*").alias("n"))


def _search(typed):
    return lambda spark, d: search.matches(paras(spark, d), typed)


def _stemmed(spark, d):
    return search.search(paras(spark, d), "things AND that", stem=True)


def _citations(spark, d):
    return records.check_citations(records.citations(V.table(spark, d, "benchmark"), docs(spark, d)), docs(spark, d))


def _archive(spark, d):
    e = V.table(spark, d, "events")
    return e.where("event_type = 'signup'").select(F.col("user_id").alias("card_id"), F.col("event_id").alias("archive_id"))


def _deck(spark, d):
    return V.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("card_id")).distinct()


def _leavers(spark, d):
    return records.leavers(reviews(spark, d).select("card_id").distinct(), _deck(spark, d))


def _restorable(spark, d):
    live = reviews(spark, d).where("rating = 4 and card_id % 2 = 0").select("card_id").distinct()
    return records.restorable(_archive(spark, d), _deck(spark, d), live)


def _missing(spark, d):
    r = reviews(spark, d)
    cache = r.where("seq % 3 = 0 and rating is not null").select("card_id", "reviewed_at").distinct()
    return records.missing_reviews(r, cache)


def _standing(spark, d):
    r = reviews(spark, d)
    c = r.where("card_id % 4 <> 0").groupBy("card_id").agg(F.max(F.when(F.col("card_id") % 3 != 0, F.col("reviewed_at")).otherwise(0)).alias("last_review"))
    return records.newest_standing(r, c)


def _study_books(spark, d):
    s = docs(spark, d)
    toxic = V.table(spark, d, "labels").where("toxic = 1").select("doc_id")
    a = s.join(toxic, "doc_id", "left_semi").select(F.col("source").alias("book_id"))
    b = s.where("lang <> 'en'").select(F.col("source").alias("book_id"))
    folders = s.where("source like '%1%'").select(F.col("source").alias("book_id")).distinct()
    return records.study_books(a, b, folders)


def _realign(spark, d):
    p = paras(spark, d)
    old = p.where("chapter % 2 = 0 and ord % 3 <> 0").withColumn("ord", F.col("ord") + 1)
    return records.realign(p, old)


def _votes(spark, d):
    return records.votes(_realign(spark, d))


def _fuzzy(spark, d):
    b = V.blocks(F.col("text"))
    pairs = docs(spark, d).select(F.col("source").alias("book_id"), b.alias("new"), F.transform(F.filter(b, lambda x, i: i % 4 != 3), lambda x, i: F.when(i % 5 == 1, F.concat(x, F.lit(" and more"))).otherwise(x)).alias("old"))
    return records.realign_fuzzy(pairs.where("size(new) > 0"))


def _ledger(spark, d):
    s = docs(spark, d)
    t = T.word_count(F.col("text"))
    written = s.groupBy(F.col("source").alias("book_id")).agg(F.count("*").alias("written_chapters"), F.sum(F.when(F.col("doc_id") % 97 == 0, 0).otherwise(t)).cast("long").alias("written_words"))
    return records.ledger_differences(written, s)


def _star(spark, d):
    t = lambda n: V.table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"))


QUERIES = {
    "blocks_explode": _blocks,
    "paragraph_anchors": lambda s, d: paras(s, d),
    "chapter_first_last_anchor": lambda s, d: corpus.first_last(paras(s, d)),
    "head_tail_sampling": lambda s, d: corpus.head_tail(docs(s, d)),
    "sentence_split": _sentences,
    "sentence_position_flags": _flags,
    "chapter_word_counts": _word_counts,
    "library_listing": lambda s, d: corpus.library(docs(s, d)),
    "syllables_readability": lambda s, d: corpus.readability(docs(s, d)),
    "salience_scores": lambda s, d: corpus.salient(docs(s, d)).select("chapter", "ord", "sentence", "score"),
    "salience_top8_per_chapter": lambda s, d: corpus.top_per_chapter(corpus.salient(docs(s, d))),
    "keyword_overlap": lambda s, d: corpus.overlaps(docs(s, d)),
    "quality_gate_violations": lambda s, d: corpus.violations(docs(s, d)),
    "invented_first_words": lambda s, d: corpus.invented_first_words(docs(s, d)),
    "preview_text": _preview,
    "text_forms": _text_forms,
    "sentence_eligibility": _eligibility,
    "content_hash_changed": lambda s, d: corpus.changed(docs(s, d), corpus.old_version(docs(s, d))),
    "inverted_index_stats": lambda s, d: search.statistics(paras(s, d)),
    **{name: _search(typed) for name, typed in SEARCHES.items()},
    "search_bm25_top30": lambda s, d: search.search(paras(s, d), "the AND of OR from NOT and"),
    "search_snippet": lambda s, d: search.snippets(paras(s, d), "the"),
    "search_stemmed": _stemmed,
    "html_plain_text": _html_plain,
    "html_blocks": _html_blocks,
    "quote_relocation": lambda s, d: search.relocate(docs(s, d), V.table(s, d, "benchmark")),
    "fsrs_new_card": lambda s, d: fsrs.new_cards(s),
    "fsrs_replay_state": lambda s, d: fsrs.rounded(fsrs.replay(reviews(s, d))),
    "fsrs_retrievability_now": _retrievability,
    "fsrs_due_calendar": _calendar,
    "due_queue": lambda s, d: study.queue(all_cards(s, d)),
    "hybrid_mix": lambda s, d: study.hybrid(all_cards(s, d)),
    "deck_stats": lambda s, d: study.deck_stats(all_cards(s, d)),
    "study_analytics": lambda s, d: study.analytics(reviews(s, d)),
    "review_blocks_15min": lambda s, d: study.blocks(reviews(s, d)),
    "reviews_per_local_day": lambda s, d: study.per_day(reviews(s, d)),
    "streaks": lambda s, d: study.streaks(reviews(s, d)),
    "heatmap_52_weeks": lambda s, d: study.heatmap(reviews(s, d)),
    "reading_velocity": lambda s, d: study.velocity(reading(s, d)),
    "reading_sessions": lambda s, d: study.sessions(reading(s, d)),
    "reading_progress": lambda s, d: study.progress(reading(s, d)),
    "cloze_candidates": lambda s, d: cards.cloze(docs(s, d)),
    "repeated_terms": lambda s, d: corpus.repeated_terms(docs(s, d)),
    "scenario_passages": lambda s, d: cards.passages(docs(s, d)).select("chapter", "ord", "passage", "target", "score"),
    "distractor_band_join": lambda s, d: cards.distractors(docs(s, d)),
    "scenario_cards": lambda s, d: cards.scenarios(docs(s, d)),
    "citation_check": _citations,
    "notes_aggregate": lambda s, d: records.aggregate_notes(notes(s, d)),
    "notes_search_filter": lambda s, d: records.filter_notes(notes(s, d), "note", "the"),
    "notes_headings": lambda s, d: records.headings_down(notes(s, d)),
    "book_summary": lambda s, d: records.summary(notes(s, d)),
    "vocabulary_latest": lambda s, d: records.vocabulary(notes(s, d)),
    "restore_missing_reviews": _missing,
    "newest_standing": _standing,
    "archive_leavers": _leavers,
    "restore_archived": _restorable,
    "removed_books_union": _study_books,
    "duplicate_merge": lambda s, d: records.merge_duplicates(docs(s, d)),
    "paragraph_realign_exact": _realign,
    "chapter_votes": _votes,
    "paragraph_realign_fuzzy": _fuzzy,
    "nearest_anchor_asof": lambda s, d: records.nearest(paras(s, d)),
    "ledger_disagreements": _ledger,
    "star_schema_smoke": _star,
}

QUERIES |= more.QUERIES
ORACLE_SQL: dict[str, str] = more.SQL | {name: text for name, text in sql.SQL.items() if name in QUERIES}
