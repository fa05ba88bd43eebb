"""DuckDB SQL that gives the rows of the registered queries, written from their definitions."""

from __future__ import annotations

from quire.operators.fsrs import W
from quire.sources.views import NOW

#: The fixed lists, written out here again so that a wrong one shows.
STOPWORDS = "this that these those with from have were been their which about would could should there where when what some other more most only also into than then they them will just like such each very much does did doing done your ours our".split()
DEFINING = ["is defined as", "refers to", "means", "is characterized by", "consists of", "is known as", "denotes", "is considered to be", "the primary purpose of", "the fundamental principle of", "is essential for", "plays a critical role in", "represents the"]
ANALYTICAL = ["consequently", "therefore", "furthermore", "crucially", "specifically", "in particular", "in contrast", "most importantly", "the core mechanism", "as a result"]
REASONING = "therefore thus however consequently because requires means process market level skill".split()
HEADING = r"'^#{1,6}([ \t]|$)'"
BLOCKS = r"list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda b: trim(b)), lambda b: b <> '')"
PARAS = f"""b AS (SELECT source AS book_id, doc_id AS chapter, list_filter({BLOCKS}, lambda x: NOT regexp_matches(x, {HEADING})) AS l FROM documents),
p AS (SELECT book_id, chapter, ord, '^p-' || CASE WHEN ord < 1000 THEN lpad(CAST(ord AS VARCHAR), 3, '0') ELSE CAST(ord AS VARCHAR) END AS anchor, text
      FROM (SELECT book_id, chapter, unnest(l) AS text, unnest(range(1, len(l) + 1)) AS ord FROM b))"""
#: s: sentences of paragraphs; a piece follows in the same sentence where the one before ends in an abbreviation.
SENTENCES = PARAS + r""",
s0 AS (SELECT book_id, chapter, ord, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM p),
s1 AS (SELECT book_id, chapter, ord, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM s0),
s2 AS (SELECT *, coalesce(lag(regexp_matches(lower(t), '(e\.g\.|i\.e\.|dr\.|mr\.|mrs\.|prof\.|fig\.|vs\.|al\.)$')) OVER w, false) AS goes_on FROM s1 WINDOW w AS (PARTITION BY chapter, book_id, ord ORDER BY i)),
s3 AS (SELECT *, CAST(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY chapter, book_id, ord ORDER BY i) AS BIGINT) AS sentence FROM s2),
s4 AS (SELECT book_id, chapter, ord, sentence, string_agg(t, ' ' ORDER BY i) AS text FROM s3 GROUP BY ALL),
s AS (SELECT *, sentence = 1 AS is_first, sentence = max(sentence) OVER (PARTITION BY chapter, book_id, ord) AS is_last FROM s4)"""
TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
WORDS = r"CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT)"
EDGE = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
STOPS = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _any(words) -> str:
    return f"regexp_matches(lower(text), '{EDGE[0]}({'|'.join(words)}){EDGE[1]}')"


def _salience(first: str, last: str) -> str:
    return rf"""(CASE WHEN {_any(DEFINING)} THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN {_any(ANALYTICAL)} THEN 2 ELSE 0 END
      + 4 * len(regexp_extract_all(text, '\*\*[^*]{{2,50}}\*\*')) + CASE WHEN {first} THEN 1.5::DOUBLE WHEN {last} THEN 1 ELSE 0 END
      + CASE WHEN length(text) < 40 THEN -2 WHEN length(text) > 250 THEN -1 ELSE 0 END)"""


SCORED = SENTENCES + f", x AS (SELECT *, {_salience('is_first', 'is_last')} AS score FROM s)"
KEYWORDS = f"list_filter(list_distinct(regexp_extract_all(lower(%s), '[a-z]{{4,}}')), lambda k: NOT list_contains({STOPS}, k))"
POSTINGS = PARAS + f""",
t AS (SELECT book_id, chapter, ord, {TERMS} AS t FROM p)"""

SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"
REVIEWS = f"""r AS (SELECT user_id AS card_id, 'b' || (user_id % 5) AS book_id,
  CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS BIGINT) AS rating, {SECONDS} AS reviewed_at, event_id AS seq FROM events)"""
READING = f"""g AS (SELECT 'b' || (user_id % 5) AS book_id, 'ch-' || lpad(CAST(user_id % 12 + 1 AS VARCHAR), 2, '0') || '.md' AS chapter_file, CAST(floor(value) AS BIGINT) AS seconds,
  event_type = 'purchase' AS completed, {SECONDS} AS read_at, event_id AS seq FROM events)"""
NOTES = """n AS (SELECT conv_id || '-' || turn AS id, CASE role WHEN 'user' THEN 'note' WHEN 'assistant' THEN 'highlight' ELSE 'word' END AS item_type, 'b' || (conv_id % 5) AS book_id, conv_id % 15 AS chapter, turn AS ord, text, conv_id FROM conversations)"""
NOTE_TITLES = """j AS (SELECT n.*, CASE WHEN chapter < 10 THEN 'Title ' || chapter ELSE 'Chapter ' || chapter END AS title, CAST(CASE WHEN chapter < 10 THEN 9 - chapter ELSE 999 END AS BIGINT) AS place FROM n)"""

_d0 = lambda r: f"least(greatest({W[4]}::DOUBLE - exp({W[5]}::DOUBLE * ({r} - 1)) + 1, 1), 10)"
_s0 = lambda r: f"greatest([{', '.join(f'{w}::DOUBLE' for w in W[:4])}][{r}], 0.1::DOUBLE)"
_days = "greatest(l.reviewed_at - c.last, 0) // 86400"
_rec = f"CASE WHEN c.stability <= 0 THEN 0 ELSE pow(1 + (19::DOUBLE / 81) * ({_days}) / c.stability, -0.5::DOUBLE) END"
_grow = f"c.stability * (1 + exp({W[8]}::DOUBLE) * (11 - c.difficulty) * pow(c.stability, -{W[9]}::DOUBLE) * (exp((1 - {_rec}) * {W[10]}::DOUBLE) - 1) * CASE WHEN l.rating = 2 THEN {W[15]}::DOUBLE ELSE 1 END * CASE WHEN l.rating = 4 THEN {W[16]}::DOUBLE ELSE 1 END)"
_left = f"least({W[11]}::DOUBLE * pow(c.difficulty, -{W[12]}::DOUBLE) * (pow(c.stability + 1, {W[13]}::DOUBLE) - 1) * exp((1 - {_rec}) * {W[14]}::DOUBLE), c.stability / exp({W[17] * W[18]!r}::DOUBLE))"
_next = f"CASE WHEN {_days} = 0 THEN c.stability * exp({W[17]}::DOUBLE * (l.rating - 3 + {W[18]}::DOUBLE)) WHEN l.rating = 1 THEN {_left} ELSE {_grow} END"
_nd = f"least(greatest({W[7]}::DOUBLE * {_d0(4)} + (1 - {W[7]}::DOUBLE) * (c.difficulty + (10 - c.difficulty) * (-{W[6]}::DOUBLE * (l.rating - 3)) / 9), 1), 10)"
_ivl = lambda s: f"CAST(greatest(1, least(36500, round({s} / (19::DOUBLE / 81) * (pow(0.9::DOUBLE, -2) - 1)))) AS BIGINT)"
#: c: card states after each review i; f: the last.
REPLAY = REVIEWS + f""",
l AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY reviewed_at, seq, rating) AS i FROM r WHERE rating IS NOT NULL),
c AS (
  SELECT card_id, book_id, i, CASE WHEN rating = 1 THEN 1 ELSE 2 END AS state, {_s0('rating')} AS stability, {_d0('rating')} AS difficulty, reviewed_at AS last, rating FROM l WHERE i = 1
  UNION ALL
  SELECT c.card_id, c.book_id, l.i, CASE WHEN l.rating > 1 THEN 2 WHEN c.state = 1 THEN 1 ELSE 3 END, {_next}, {_nd}, l.reviewed_at, l.rating
  FROM c JOIN l ON c.card_id = l.card_id AND l.i = c.i + 1),
f AS (SELECT card_id, book_id, CAST(state AS BIGINT) AS state, stability, difficulty, last + CASE WHEN rating = 1 THEN 600 ELSE 86400 * {_ivl('stability')} END AS due, i AS reps, last AS last_review
      FROM c QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY i DESC) = 1),
k0 AS (SELECT * FROM f UNION ALL SELECT DISTINCT card_id, book_id, 0, 0.0::DOUBLE, 0.0::DOUBLE, {NOW}, 0, 0 FROM r WHERE card_id NOT IN (SELECT card_id FROM f)),
k AS (SELECT card_id, book_id, CASE WHEN card_id % 7 = 0 THEN 0 ELSE state END AS state, stability, difficulty, CASE WHEN card_id % 7 = 0 THEN {NOW} ELSE due END AS due,
      CASE WHEN card_id % 7 = 0 THEN 0 ELSE reps END AS reps, CASE WHEN card_id % 7 = 0 THEN 0 ELSE last_review END AS last_review, CASE WHEN card_id % 3 = 0 THEN 'scenario' ELSE 'cloze' END AS kind FROM k0)"""


def _queue(where: str, limit: int) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY phase, due, card_id) AS BIGINT) AS place, card_id, kind, phase FROM (
      SELECT CAST(CASE WHEN reps = 0 THEN 1 ELSE 0 END AS BIGINT) AS phase, due, card_id, kind FROM k WHERE (reps = 0 OR due <= {NOW}) AND {where}) QUALIFY place <= {limit}"""


def _has(word: str, prefix: bool = False) -> str:
    return f"len(list_filter(t, lambda w: {f'starts_with(w, {word!r})' if prefix else f'w = {word!r}'})) > 0"


def _found(where: str) -> str:
    return f"WITH {POSTINGS} SELECT book_id, chapter, ord FROM t WHERE {where}"


def _bm25(leaves: list[str], where: str) -> str:
    freq = ", ".join(f"CAST(len(list_filter(t, lambda w: starts_with(w, '{w}'))) AS BIGINT) AS f{i}" for i, w in enumerate(leaves))
    n = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(leaves)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) > 0 THEN ln((n - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))" for i in range(len(leaves)))
    return f"""WITH {POSTINGS}, m AS (SELECT *, CAST(len(t) AS BIGINT) AS dl, {freq} FROM t), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {n} FROM m)
SELECT CAST(row_number() OVER (ORDER BY score, book_id, chapter, ord) AS BIGINT) AS rank, book_id, chapter, ord, score
FROM (SELECT book_id, chapter, ord, round(-({score}), 6) AS score FROM m, st WHERE {where}) QUALIFY rank <= 30"""


SQL = {
    "blocks_explode": f"WITH b AS (SELECT doc_id AS chapter, {BLOCKS} AS l FROM documents) SELECT chapter, pos, block, regexp_matches(block, {HEADING}) AS heading FROM (SELECT chapter, unnest(range(0, len(l))) AS pos, unnest(l) AS block FROM b)",
    "paragraph_anchors": f"WITH {PARAS} SELECT * FROM p",
    "chapter_first_last_anchor": f"WITH {PARAS} SELECT book_id, chapter, arg_min(anchor, ord) AS first_anchor, arg_max(anchor, ord) AS last_anchor, count(*) AS n_paragraphs FROM p GROUP BY ALL",
    "head_tail_sampling": f"""WITH {PARAS}, q AS (SELECT *, max(ord) OVER (PARTITION BY book_id, chapter) AS n FROM p),
h AS (SELECT *, CASE WHEN n = 1 THEN 1 WHEN n < 4 THEN CAST(ceil(n / 2) AS BIGINT) ELSE 2 END AS head FROM q)
SELECT book_id, chapter, anchor, CASE WHEN ord <= head THEN 'head' ELSE 'tail' END AS part FROM h WHERE ord <= head OR ord > n - greatest(0, least(2, n - head))""",
    "sentence_split": f"WITH {SENTENCES} SELECT chapter, ord, sentence, text FROM s",
    "sentence_position_flags": f"WITH {SENTENCES} SELECT chapter, count(*) FILTER (is_first) AS firsts, count(*) FILTER (is_last) AS lasts, count(*) FILTER (is_first AND is_last) AS alone, count(*) AS sentences FROM s GROUP BY chapter",
    "chapter_word_counts": f"SELECT doc_id AS chapter, {WORDS} AS words FROM documents",
    "library_listing": f"""SELECT *, total_words // 225 AS minutes, row_number() OVER (ORDER BY lower(book_id), book_id) AS place
FROM (SELECT source AS book_id, count(*) AS chapters, CAST(sum({WORDS}) AS BIGINT) AS total_words FROM documents GROUP BY source)""",
    "syllables_readability": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, greatest(len(list_filter(string_split(regexp_replace(text, '[.!?]+(\s+|$)', chr(31), 'g'), chr(31)), lambda x: trim(x) <> '')), 1) AS sentences FROM documents),
y AS (SELECT doc_id, len(w) AS words, sentences, CAST(list_sum(list_transform(w, lambda x: CASE WHEN NOT regexp_matches(x, '[a-z]') THEN 0 WHEN length(x) <= 3 THEN 1 ELSE
  greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN (regexp_matches(x, '[^e]e$') AND NOT regexp_matches(x, '[^aeiouy]le$')) OR (regexp_matches(x, 'ed$') AND NOT regexp_matches(x, '[dt]ed$'))
  OR (regexp_matches(x, 'es$') AND NOT regexp_matches(x, '(s|z|sh|ch|x)es$')) THEN 1 ELSE 0 END) END)) AS BIGINT) AS syllables FROM d WHERE len(w) > 0)
SELECT doc_id, words, sentences, syllables, floor(greatest(0.39::DOUBLE * words / sentences + 11.8::DOUBLE * syllables / words - 15.59::DOUBLE, 0) * 100 + 0.5::DOUBLE) / 100 AS grade,
  CAST(greatest(1, ceil(words / 200)) AS BIGINT) AS minutes FROM y""",
    "salience_scores": f"WITH {SCORED} SELECT chapter, ord, sentence, score FROM x",
    "salience_top8_per_chapter": f"WITH {SCORED} SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY score DESC, ord, sentence) AS rank, ord, sentence, score FROM x QUALIFY rank <= 8",
    "keyword_overlap": f"""WITH {PARAS}, k AS (SELECT chapter, ord, {KEYWORDS % 'text'} AS k FROM p)
SELECT a.chapter, a.ord, CAST(len(list_intersect(a.k, b.k)) AS BIGINT) AS shared FROM k a JOIN k b ON a.chapter = b.chapter AND b.ord = a.ord + 1""",
    "quality_gate_violations": rf"""WITH b AS (SELECT doc_id AS chapter, text, {BLOCKS} AS l FROM documents)
SELECT chapter, 'no_text' AS violation FROM b WHERE len(list_filter(l, lambda x: NOT regexp_matches(x, {HEADING}))) = 0
UNION ALL SELECT chapter, 'unreadable' FROM b WHERE contains(text, chr(65533))
UNION ALL SELECT chapter, 'long_block' FROM b WHERE len(list_filter(l, lambda x: length(x) > 2000)) > 0
UNION ALL SELECT chapter, 'marks' FROM b WHERE len(list_filter(l, lambda x: regexp_matches(x, '([!#$%&*]{{2,}}\s+\S+){{4}}'))) > 0
UNION ALL SELECT chapter, 'footnote_without_note' FROM b WHERE regexp_matches(text, '\[\^[^\]]+\]') AND NOT regexp_matches(text, '(?m)^\[\^[^\]]+\]:')""",
    "invented_first_words": f"""WITH {PARAS}, w AS (SELECT book_id, word, count(*) AS seen FROM (SELECT source AS book_id, unnest({TERMS}) AS word FROM documents) GROUP BY ALL),
o AS (SELECT book_id, chapter, ord, {TERMS}[1] AS word FROM p)
SELECT o.book_id, chapter, ord, o.word, r.seen AS rest_seen FROM o JOIN w ON o.book_id = w.book_id AND o.word = w.word AND w.seen <= 1 JOIN w r ON r.book_id = o.book_id AND r.word = substr(o.word, 2) AND r.seen >= 3 WHERE length(o.word) >= 4""",
    "preview_text": rf"""WITH {PARAS}, m AS (SELECT chapter, ord, '## **' || text || '** see [there](x) [^1]  ^p-' || ord AS t FROM p)
SELECT chapter, ord, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\s*\^p-[0-9]+\s*$', '', 'g'), '^#{{1,6}}\s+', '', 'g'), '\[\^[^\]]*\]', '', 'g'),
  '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`]+', '', 'g'), '\s+', ' ', 'g')) AS preview FROM m""",
    "text_forms": r"""SELECT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS squashed, trim(regexp_replace(regexp_replace(text, '[*`]', '', 'g'), '\s+', ' ', 'g')) AS matching,
  trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CAST(CASE WHEN n <= 3 THEN 1 WHEN n <= 6 THEN 2 WHEN n <= 9 THEN 3 ELSE ceil(n * 0.4::DOUBLE) END AS BIGINT) AS fixation,
  CASE WHEN s >= 3600 THEN (s // 3600) || ' h ' || (s % 3600 // 60) || ' min' WHEN s >= 60 THEN (s // 60) || ' min' ELSE s || ' s' END AS duration FROM (SELECT *, length(text) AS n, length(text) * 37 AS s FROM benchmark)""",
    "sentence_eligibility": rf"""WITH {SENTENCES}, e AS (SELECT text, regexp_replace(text, '[^\p{{L}}]', '', 'g') AS l FROM s)
SELECT CASE WHEN regexp_matches(text, '<[A-Za-z/!]') THEN 'tag' WHEN regexp_matches(text, '\]\(') THEN 'link' WHEN contains(text, chr(65533)) THEN 'unreadable' WHEN contains(text, '|') THEN 'table'
  WHEN regexp_matches(text, '[{{}}]') THEN 'brace' WHEN regexp_matches(text, '\^p-[0-9]') THEN 'anchor' WHEN l <> '' AND upper(l) = l THEN 'capitals' WHEN NOT regexp_matches(text, '[.!?]["'')\]]?$') THEN 'unfinished' ELSE 'ok' END AS reason, count(*) AS n FROM e GROUP BY 1""",
    "content_hash_changed": """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' old' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id + 1000000000, text FROM documents WHERE doc_id % 11 = 0)
SELECT coalesce(d.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'gone' WHEN d.text <> o.text THEN 'changed' ELSE 'same' END AS status FROM documents d FULL JOIN o ON d.doc_id = o.doc_id""",
    "inverted_index_stats": f"""WITH {POSTINGS}, u AS (SELECT book_id, chapter, ord, unnest(t) AS term FROM t), d AS (SELECT term, count(DISTINCT (book_id, chapter, ord)) AS df, count(*) AS cf FROM u GROUP BY term)
SELECT term, df, cf, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM d, (SELECT count(*) AS n FROM t)""",
    "search_and": _found(f"{_has('the', True)} AND {_has('with', True)}"),
    "search_or": _found(f"{_has('zone', True)} OR {_has('nichts', True)} OR {_has('ouble', True)}"),
    "search_not": _found(f"{_has('the', True)} AND NOT {_has('and', True)}"),
    "search_prefix": _found(f"{_has('th', True)} AND {_has('ouble', True)}"),
    "search_phrase": _found(f"len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0 AND {_has('in', True)}"),
    "search_bm25_top30": _bm25(["the", "of", "from"], f"(f0 > 0 AND f1 > 0) OR (f2 > 0 AND NOT ({_has('and', True)}))"),
    "search_snippet": f"""WITH {POSTINGS}, h AS (SELECT chapter, ord, t, greatest(1, list_position(t, 'the') - 5) AS a FROM t WHERE list_contains(t, 'the'))
SELECT chapter, ord, CASE WHEN a > 1 THEN '...' ELSE '' END || array_to_string(list_transform(t[a:a + 17], lambda w: CASE WHEN w = 'the' THEN '[the]' ELSE w END), ' ') || CASE WHEN a + 17 < len(t) THEN '...' ELSE '' END AS snippet FROM h""",
    "html_plain_text": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?is)<nav\b.*?</nav\s*>', ' ', 'g'),
  '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[A-Za-z/!][^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""",
    "quote_relocation": r"""WITH d AS (SELECT doc_id AS chapter, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents), q AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS q FROM benchmark),
x AS (SELECT chapter, w, unnest(w) AS one, unnest(range(1, len(w) + 1)) AS i FROM d)
SELECT item_id, chapter, i AS start_word, i + len(q) AS end_word FROM x JOIN q ON q.q[1] = x.one AND len(q) >= 6 AND w[i:i + len(q) - 1] = q""",
    "fsrs_new_card": f"SELECT rating, round({_s0('rating')}, 6) AS stability, round({_d0('rating')}, 6) AS difficulty, CAST(CASE WHEN rating = 1 THEN 600 ELSE 86400 * {_ivl(_s0('rating'))} END AS BIGINT) AS wait FROM (SELECT unnest(range(1, 5)) AS rating)",
    "fsrs_replay_state": f"WITH RECURSIVE {REPLAY} SELECT card_id, book_id, state, round(stability, 6) AS stability, round(difficulty, 6) AS difficulty, due, reps, last_review FROM f",
    "fsrs_retrievability_now": f"WITH RECURSIVE {REPLAY} SELECT card_id, round(pow(1 + (19::DOUBLE / 81) * greatest(({NOW} - last_review) / 86400::DOUBLE, 0) / stability, -0.5::DOUBLE), 6) AS chance FROM f",
    "fsrs_due_calendar": f"WITH RECURSIVE {REPLAY} SELECT due // 86400 AS day, count(*) AS n FROM f GROUP BY 1",
    "due_queue": f"WITH RECURSIVE {REPLAY} {_queue('true', 50)}",
    "hybrid_mix": f"""WITH RECURSIVE {REPLAY}, a AS ({_queue("kind = 'cloze'", 30)}), b AS ({_queue("kind = 'scenario'", 30)}),
u AS (SELECT *, CAST(CASE WHEN place > 15 THEN 1 ELSE 0 END AS BIGINT) AS fill FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT row_number() OVER (ORDER BY fill, place, kind) AS position, card_id, kind, fill FROM u QUALIFY position <= 30""",
    "deck_stats": f"WITH RECURSIVE {REPLAY} SELECT book_id, count(*) FILTER (due <= {NOW} OR reps = 0) AS due, count(*) FILTER (reps = 0) AS new, count(*) FILTER (state IN (1, 3)) AS learning, count(*) FILTER (state = 2) AS review, count(*) AS total FROM k GROUP BY book_id",
    "study_analytics": f"""WITH RECURSIVE {REPLAY} SELECT count(*) FILTER (due <= {NOW + 86400} OR reps = 0) AS due_today, count(*) AS total, count(*) FILTER (state = 2 AND stability >= 21) AS mastered, count(*) FILTER (reps = 0) AS new,
  round(avg(CASE WHEN reps > 0 THEN pow(1 + (19::DOUBLE / 81) * (CASE WHEN last_review > 0 THEN ({NOW} - last_review) / 86400::DOUBLE ELSE 0 END) / stability, -0.5::DOUBLE) END), 4) AS model_retention,
  (SELECT floor(avg(CASE WHEN rating > 1 THEN 1.0::DOUBLE ELSE 0 END) * 1000 + 0.5::DOUBLE) / 10 FROM r WHERE rating IS NOT NULL) AS log_retention FROM k""",
    "review_blocks_15min": f"WITH {REVIEWS} SELECT reviewed_at - reviewed_at % 900 AS block, count(*) AS n FROM r WHERE rating IS NOT NULL GROUP BY 1",
    "reviews_per_local_day": f"WITH {REVIEWS} SELECT CAST(timezone('America/New_York', to_timestamp(reviewed_at)) AS DATE) AS day, count(*) AS n FROM r WHERE rating IS NOT NULL GROUP BY 1",
    "streaks": f"""WITH {REVIEWS}, d AS (SELECT DISTINCT card_id, reviewed_at // 86400 AS day FROM r WHERE rating IS NOT NULL), g AS (SELECT *, day - row_number() OVER (PARTITION BY card_id ORDER BY day) AS run FROM d)
SELECT card_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM g GROUP BY card_id, run""",
    "heatmap_52_weeks": f"""WITH {REVIEWS}, c AS (SELECT reviewed_at // 86400 AS d, count(*) AS n FROM r WHERE rating IS NOT NULL GROUP BY 1),
b AS (SELECT {NOW // 86400 - (NOW // 86400 + 3) % 7 - 357} AS first), s AS (SELECT unnest(range(first, {NOW // 86400 + 1})) AS day, first FROM b)
SELECT day, (day - first) // 7 AS week, (day - first) % 7 AS weekday, coalesce(n, 0) AS n, CAST(CASE WHEN coalesce(n, 0) = 0 THEN 0 WHEN n <= 3 THEN 1 WHEN n <= 7 THEN 2 WHEN n <= 14 THEN 3 ELSE 4 END AS BIGINT) AS level FROM s LEFT JOIN c ON s.day = c.d""",
    "reading_velocity": f"""WITH {READING}, a AS (SELECT book_id, chapter_file, CAST(sum(seconds) AS BIGINT) AS seconds, bool_or(completed) AS completed, max(read_at) AS last_read FROM g GROUP BY ALL), z AS (SELECT *, CAST(substr(chapter_file, 4, 2) AS BIGINT) AS c FROM a)
SELECT book_id, chapter_file, CASE WHEN c <= 10 THEN 'Chapter ' || c END AS title, CASE WHEN c <= 10 THEN c ELSE 999 END AS place, seconds, completed, last_read FROM z""",
    "reading_sessions": f"""WITH {READING}, a AS (SELECT *, read_at - lag(read_at) OVER (PARTITION BY book_id ORDER BY read_at, seq) AS gap FROM g), b AS (SELECT *, CAST(sum(CASE WHEN coalesce(gap, 1801) > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY read_at, seq) AS BIGINT) AS session FROM a)
SELECT book_id, session, min(read_at) AS first, max(read_at) AS last, count(*) AS ticks, CAST(sum(least(coalesce(gap, 0), 5)) AS BIGINT) AS seconds FROM b GROUP BY book_id, session""",
    "reading_progress": f"""WITH {READING}, a AS (SELECT *, CAST(least(100, floor(sum(seconds) OVER (PARTITION BY book_id, chapter_file ORDER BY read_at, seq ROWS UNBOUNDED PRECEDING) / 10)) AS BIGINT) AS percent FROM g),
b AS (SELECT *, lag(percent) OVER (PARTITION BY book_id, chapter_file ORDER BY read_at, seq) AS was FROM a) SELECT book_id, chapter_file, read_at, seq, percent FROM b WHERE was IS NULL OR percent > was""",
    "scenario_passages": rf"""WITH {SENTENCES}, q AS (SELECT chapter, ord, string_agg(CASE WHEN NOT is_last THEN text END, ' ' ORDER BY sentence) AS passage, max(CASE WHEN is_last THEN text END) AS text FROM s GROUP BY chapter, ord HAVING count(*) >= 2)
SELECT chapter, ord, passage, text AS target, {_salience('false', 'true')} + CASE WHEN {_any(REASONING)} THEN 2 ELSE 0 END AS score FROM q WHERE length(passage) BETWEEN 40 AND 550 AND length(text) BETWEEN 35 AND 240 AND NOT regexp_matches(text, '\?|\|') AND regexp_matches(text, '[.!]["'')\]]?$')""",
    "distractor_band_join": rf"""WITH {SENTENCES}, q AS (SELECT chapter, ord, string_agg(CASE WHEN NOT is_last THEN text END, ' ' ORDER BY sentence) AS passage, max(CASE WHEN is_last THEN text END) AS text FROM s GROUP BY chapter, ord HAVING count(*) >= 2),
t AS (SELECT chapter, ord, text, length(text) AS n, {_salience('false', 'true')} + CASE WHEN {_any(REASONING)} THEN 2 ELSE 0 END AS score, {KEYWORDS % 'text'} AS k FROM q WHERE length(passage) BETWEEN 40 AND 550 AND length(text) BETWEEN 35 AND 240 AND NOT regexp_matches(text, '\?|\|') AND regexp_matches(text, '[.!]["'')\]]?$')),
j AS (SELECT a.chapter, a.ord, b.ord AS other, CAST(len(list_intersect(a.k, b.k)) AS BIGINT) AS shared, b.score FROM t a JOIN t b ON a.chapter = b.chapter AND b.ord NOT IN (a.ord, a.ord + 1) AND b.n >= 0.4::DOUBLE * a.n AND b.n <= 2.5::DOUBLE * a.n AND lower(a.text) <> lower(b.text))
SELECT chapter, ord, row_number() OVER (PARTITION BY chapter, ord ORDER BY shared DESC, score DESC, other) AS rank, other, shared FROM j QUALIFY rank <= 3""",
    "repeated_terms": f"""WITH t AS (SELECT doc_id AS chapter, {TERMS} AS t FROM documents), g AS (SELECT chapter, t, unnest(range(1, len(t) + 1)) AS pos FROM t),
h AS (SELECT chapter, pos, k AS words, t[pos:pos + k - 1] AS g FROM g, (SELECT unnest([2, 3]) AS k) WHERE pos + k - 1 <= len(t)),
c AS (SELECT chapter, array_to_string(g, ' ') AS term, CAST(words AS BIGINT) AS words, count(*) AS n, min(pos) AS first_seen FROM h WHERE len(list_filter(g, lambda w: length(w) < 4 OR list_contains({STOPS}, w))) = 0 GROUP BY ALL HAVING count(*) >= 2)
SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY n * words * words DESC, first_seen, words) AS rank, term, words, n, first_seen FROM c QUALIFY rank <= 20""",
    "citation_check": rf"""WITH {PARAS}, c0 AS (SELECT b.item_id, b.item_id * 7 AS chapter, b.item_id % 3 + 1 AS ord, b.text, p.text AS t FROM benchmark b LEFT JOIN p ON p.chapter = b.item_id * 7 AND p.ord = b.item_id % 3 + 1),
c1 AS (SELECT item_id, chapter, CASE WHEN item_id % 7 = 3 THEN ord + 100000 ELSE ord END AS ord, CASE WHEN item_id % 5 = 0 THEN '  ' WHEN item_id % 5 = 1 THEN text ELSE coalesce(substr(t, 1, 40), text) END AS quote FROM c0),
c2 AS (SELECT c1.*, d.doc_id, p.text AS t, regexp_replace(lower(quote), '[^\p{{L}}\p{{N}}]+', '', 'g') AS q FROM c1 LEFT JOIN documents d ON d.doc_id = c1.chapter LEFT JOIN p ON p.chapter = c1.chapter AND p.ord = c1.ord)
SELECT item_id, CASE WHEN trim(quote) = '' THEN 'NoQuote' WHEN doc_id IS NULL THEN 'ChapterNotRead' WHEN t IS NULL THEN 'ParagraphNotThere' WHEN q <> '' AND contains(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', '', 'g'), q) THEN 'Checked' ELSE 'QuoteNotThere' END AS outcome FROM c2""",
    "notes_aggregate": f"WITH {NOTES}, {NOTE_TITLES} SELECT id, item_type, book_id, title, place, ord, length(text) AS size FROM j",
    "notes_search_filter": f"WITH {NOTES}, {NOTE_TITLES} SELECT book_id, title, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM j WHERE item_type = 'note' AND (contains(lower(text), 'the') OR contains(lower(title), 'the')) GROUP BY ALL",
    "notes_headings": f"""WITH {NOTES}, h AS (SELECT *, last_value(CASE WHEN item_type = 'highlight' THEN id END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY ord) AS heading FROM n)
SELECT id, heading, lag(heading) OVER (PARTITION BY conv_id ORDER BY ord) IS DISTINCT FROM heading AS printed FROM h""",
    "book_summary": f"WITH {NOTES} SELECT book_id, string_agg('- ' || id, chr(10) ORDER BY chapter, CASE WHEN item_type = 'highlight' THEN 0 ELSE 1 END, conv_id, ord, id) AS text FROM n GROUP BY book_id",
    "vocabulary_latest": f"WITH {NOTES}, w AS (SELECT *, {TERMS}[1] AS word FROM n) SELECT book_id, word, conv_id, ord FROM w WHERE word IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id, word ORDER BY conv_id DESC, ord DESC) = 1",
    "restore_missing_reviews": f"WITH {REVIEWS}, x AS (SELECT card_id, reviewed_at FROM r WHERE seq % 3 = 0 AND rating IS NOT NULL) SELECT DISTINCT card_id, reviewed_at FROM r WHERE rating IS NOT NULL AND (card_id, reviewed_at) NOT IN (SELECT (card_id, reviewed_at) FROM x)",
    "newest_standing": f"""WITH {REVIEWS}, c AS (SELECT card_id, max(CASE WHEN card_id % 3 <> 0 THEN reviewed_at ELSE 0 END) AS last_review FROM r WHERE card_id % 4 <> 0 GROUP BY card_id),
s AS (SELECT card_id, reviewed_at, seq FROM r QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY reviewed_at DESC, seq) = 1)
SELECT s.card_id, reviewed_at, seq, CASE WHEN last_review IS NULL THEN 'waiting' WHEN last_review < reviewed_at THEN 'applied' ELSE 'kept' END AS status FROM s LEFT JOIN c ON s.card_id = c.card_id""",
    "archive_leavers": "SELECT DISTINCT user_id AS card_id, 'not_in_deck' AS reason FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "restore_archived": """SELECT user_id AS card_id, max(event_id) AS archive_id FROM events WHERE event_type = 'signup' AND user_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0) GROUP BY user_id""",
    "removed_books_union": """SELECT book_id FROM (SELECT source AS book_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION SELECT source FROM documents WHERE lang <> 'en') WHERE book_id NOT LIKE '%1%'""",
    "duplicate_merge": "SELECT sha256(text) AS hash, min(doc_id) AS kept, count(*) AS n, max(n_chars) AS n_chars FROM documents GROUP BY text HAVING count(*) > 1",
    "nearest_anchor_asof": f"""WITH {PARAS} SELECT chapter, ord, coalesce(last_value(CASE WHEN ord % 4 = 0 THEN ord END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY ord),
  first_value(CASE WHEN ord % 4 = 0 THEN ord END IGNORE NULLS) OVER (PARTITION BY chapter ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS nearest FROM p""",
    "ledger_disagreements": f"""WITH a AS (SELECT source AS book_id, count(*) AS written_chapters, CAST(sum(CASE WHEN doc_id % 97 = 0 THEN 0 ELSE {WORDS} END) AS BIGINT) AS written_words, count(*) AS chapters, CAST(sum({WORDS}) AS BIGINT) AS words FROM documents GROUP BY source)
SELECT book_id, written_chapters, chapters, written_words, words FROM a WHERE written_words <> words""",
    "star_schema_smoke": "SELECT n_name, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
}

_ALIGN = rf"""WITH {PARAS}, h AS (SELECT chapter, ord, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '', 'g') AS key FROM p),
a AS (SELECT key, min(chapter) AS chapter, min(ord) AS ord FROM h GROUP BY key HAVING count(*) = 1),
o AS (SELECT key, min(chapter) AS old_chapter, min(ord + 1) AS old_ord FROM h WHERE chapter % 2 = 0 AND ord % 3 <> 0 GROUP BY key HAVING count(*) = 1),
j AS (SELECT chapter, ord, old_chapter, old_ord FROM a JOIN o ON a.key = o.key)"""
SQL["paragraph_realign_exact"] = _ALIGN + " SELECT * FROM j"
SQL["chapter_votes"] = _ALIGN + " SELECT old_chapter, chapter, count(*) AS n FROM j GROUP BY old_chapter, chapter QUALIFY row_number() OVER (PARTITION BY old_chapter ORDER BY count(*) DESC, chapter) = 1"
#: Kept sentences with a quoted or bold or defined term are found by the same rules in SQL; see the tests for the prompts.
SQL["cloze_candidates"] = rf"""WITH {SCORED}, e AS (SELECT *, regexp_replace(text, '[^\p{{L}}]', '', 'g') AS l FROM x),
ok AS (SELECT * FROM e WHERE NOT (regexp_matches(text, '<[A-Za-z/!]') OR regexp_matches(text, '\]\(') OR contains(text, chr(65533)) OR contains(text, '|') OR regexp_matches(text, '[{{}}]') OR regexp_matches(text, '\^p-[0-9]') OR (l <> '' AND upper(l) = l)) AND regexp_matches(text, '[.!?]["'')\]]?$')),
f AS (SELECT *, [regexp_extract(text, '\*\*([^*]{{2,50}})\*\*', 1), regexp_extract(text, '^(?:The |An? )?(\p{{L}}[\p{{L}} -]{{1,48}}?) (?:is defined as|refers to|means|consists of) ', 1), regexp_extract(text, '"([^"]{{3,50}})"', 1)] AS found FROM ok),
a AS (SELECT *, list_filter(found, lambda a: a <> '' AND length(a) BETWEEN 3 AND 50 AND regexp_matches(a, '\p{{L}}') AND NOT regexp_matches(a, '[0-9]$') AND NOT regexp_matches(a, '[*_`\[\]{{}}<>|]') AND NOT regexp_matches(a, '^[\p{{P}}\p{{S}}]|[\p{{P}}\p{{S}}]$')
  AND NOT regexp_matches(a, '(?i)^(the|a|an|of|and|or|to|in|on|for|is|are|it|this|that)\b|\b(the|a|an|of|and|or|to|in|on|for|is|are|it|this|that)$'))[1] AS answer FROM f),
o AS (SELECT * FROM a WHERE answer IS NOT NULL AND length(text) - length(replace(text, answer, '')) = length(answer) QUALIFY row_number() OVER (PARTITION BY chapter, lower(answer) ORDER BY score DESC, ord, sentence) = 1)
SELECT chapter, row_number() OVER (PARTITION BY chapter ORDER BY score DESC, ord, sentence) AS rank, answer, replace(text, answer, '{{{{c1::' || answer || '}}}}') AS prompt FROM o QUALIFY rank <= 8"""
