"""Rules of the operators on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from quire.functions import rules, udfs
from quire.functions import text as T
from quire.operators import cards, fsrs, publish, records, search
from quire.plans import catalog
from quire.sources import views as V
from quire.streaming import logs


def shown(tree):
    if isinstance(tree, search.Node):
        return f"({f' {tree.op} '.join(map(shown, tree.args))})"
    return tree and ('"' + " ".join(tree.words) + '"' if len(tree.words) > 1 else tree.words[0]) + "*" * tree.prefix


@pytest.mark.parametrize(
    ("typed", "want"),
    [
        ("", None), ("a", None), ("war", "war*"), ("war peace", "(war* AND peace*)"), ("war AND peace", "(war* AND peace*)"), ("war OR peace north", "(war* OR (peace* AND north*))"),
        ("war NOT peace north", "((war* NOT peace*) AND north*)"), ("AND war", "war*"), ("war AND", "war*"), ("war OR AND NOT peace", "(war* NOT peace*)"), ("NOT war", None), ("AND OR", None),
        ('"the war"', '"the war"'), ('"the war', '"the war"*'), ("e-mail", '("e mail"* OR email)'), ("don't", '"don t"'), ("C++", "c"), ("U.S.", '"u s"'), ("?!", None), ("th*", "th*"), ("x y", "(x AND y)"),
    ],
)
def test_parse(typed, want):
    assert shown(search.parse(typed)) == want


@pytest.mark.parametrize("typed", ['"', '""', "***", "AND AND", "NOT NOT x", "a\"b", "((", "' OR 1=1", "x:y", "-", "--", "NEAR(a b)", "^a", "{a}", "\\", "\0 ab", "é è", "a AND", "OR"])
def test_hostile_searches(spark, typed):
    p = spark.createDataFrame([("b", 1, 1, "one two")], "book_id string, chapter long, ord long, text string")
    search.search(p, typed).collect()


def test_fsrs_new_cards(spark):
    rows = {r.rating: r for r in fsrs.new_cards(spark).collect()}
    assert [rows[i].stability for i in range(1, 5)] == pytest.approx([0.40255, 1.18385, 3.173, 15.69105])
    assert [rows[i].difficulty for i in range(1, 5)] == pytest.approx([7.1949, 6.488305, 5.282434, 3.224502], abs=5e-6)
    assert [rows[i].wait for i in range(1, 5)] == [600, 86_400, 3 * 86_400, 16 * 86_400]


def test_fsrs_good_at_each_due_day(spark):
    days, at, rows = [3, 11, 35, 101, 269, 669, 1563, 3454], 0, []
    for d in [0, *days]:
        at += d * 86_400
        rows.append((1, "b", 3, 1_000_000 + at, len(rows)))
    want = [3.173, 10.738926, 34.577624, 100.748313, 269.283835, 669.309326, 1563.237654, 3453.862383]
    for n in range(1, 9):
        df = spark.createDataFrame(rows[:n], "card_id long, book_id string, rating long, reviewed_at long, seq long")
        r = fsrs.replay(df).first()
        assert r.stability == pytest.approx(want[n - 1], abs=5e-6) and (r.due - r.last_review) // 86_400 == days[n - 1]


@pytest.mark.parametrize(("second", "after", "s", "d"), [(2, 3, 4.924512, 6.03495), (3, 0, 4.466858, None)])
def test_fsrs_later_reviews(spark, second, after, s, d):
    df = spark.createDataFrame([(1, "b", 3, 1_000_000, 1), (1, "b", second, 1_000_000 + after * 86_400, 2)], "card_id long, book_id string, rating long, reviewed_at long, seq long")
    r = fsrs.replay(df).first()
    assert r.stability == pytest.approx(s, abs=5e-6) and (d is None or r.difficulty == pytest.approx(d, abs=5e-6))


def test_fsrs_lapse(spark):
    df = spark.createDataFrame([(1, "b", r, 1_000_000 + d * 86_400, d) for r, d in ((3, 0), (3, 3), (1, 14))], "card_id long, book_id string, rating long, reviewed_at long, seq long")
    r = fsrs.replay(df).first()
    assert (r.stability, r.difficulty, r.state) == (pytest.approx(2.185775, abs=5e-6), pytest.approx(6.790568, abs=5e-6), 3)
    assert r.due == r.last_review + 600


def test_hashes_and_stems():
    assert udfs.fnv1a(b"") == "cbf29ce484222325" and udfs.fnv1a(b"a") == "af63dc4c8601ec8c"
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "generalizations": "gener"}
    assert {w: udfs.porter(w) for w in pairs} == pairs


def test_html_blocks():
    page = "<html><head><title>x</title></head><body><nav>menu</nav><h1>One &amp; two</h1><p>First <b>line<p>Second</b><br>more<script>var a='</p>';</script><ul><li>a<li>b</ul></body>"
    assert [(b["kind"], b["text"]) for b in udfs.html_blocks(page)] == [("h1", "One & two"), ("p", "First line"), ("p", "Second more"), ("li", "a"), ("li", "b")]
    assert udfs.html_blocks(None) == []


def test_sentences(spark):
    df = spark.createDataFrame([('Dr. Smith came. He met Mr. Jones etc. And left! "Why?" No. 5 it is.',), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(V.sentences(F.col("t"))).collect()] == [["Dr. Smith came.", "He met Mr. Jones etc.", "And left!", '"Why?" No.', "5 it is."], [], None]


def test_salience(spark):
    df = spark.createDataFrame([("The **margin** is defined as the gap between a price and its cost.", True), ("A plain line of words that says little of any note.", False)], "t string, f boolean")
    a, b = [r[0] for r in df.select(T.salience(F.col("t"), F.col("f"), F.lit(False))).collect()]
    assert a >= 9.0 > b


def test_decks_round_trip(spark):
    items = spark.createDataFrame([("b", "ch-10.md", 1, "cloze", "A {{c1::x1y}} here.", "x1y"), ("b", "ch-2.md", 1, "cloze", "B {{c1::word}}.", "word")], "book_id string, chapter_file string, rank long, kind string, prompt string, answer string")
    deck = cards.write_deck(items)
    assert [(r.chapter_file, r.prompt, r.answer) for r in cards.parse_deck(deck).orderBy("section").collect()] == [("ch-2.md", "B {{c1::word}}.", "word"), ("ch-10.md", "A {{c1::x1y}} here.", "x1y")]
    scenario = spark.createDataFrame([("b", "### card-1\nChapter: ch-1.md\nScenario: What next?\n- [ ] a\n- [x] b\n- [ ] c\n\n### card-2\nScenario: two\n- [x] a\n- [x] b\n- [ ] c\n")], "book_id string, text string")
    assert [(r.kind, r.answer) for r in cards.parse_deck(scenario).collect()] == [("scenario", "b")]


def test_card_identity(spark):
    df = spark.createDataFrame([("b", "cloze", "A **bold**  line", "X"), ("b", "cloze", "a bold line", "x"), ("b", "scenario", "q", "(A) yes")], "b string, k string, p string, a string")
    x, y, z = [r[0] for r in df.select(udfs.card_identity("b", "k", "p", "a")).collect()]
    assert x == y and x.startswith("b-card-") and z.startswith("b-sc-")


def test_logs_and_damaged_lines(spark, tmp_path):
    (tmp_path / "log").mkdir()
    good = {"cardId": "c", "bookId": "b", "rating": 3, "reviewedAt": 5}
    (tmp_path / "log/reviews.jsonl").write_text(json.dumps(good) + '\n\n{"cardId": "c", "rat\n')
    ok, bad = V.read_log(spark, str(tmp_path / "log"), "cardId string, bookId string, rating int, reviewedAt long")
    assert [r.cardId for r in ok.cache().collect()] == ["c"] and len(bad.collect()) == 1
    (tmp_path / "meta.json").write_text("{")
    with pytest.raises(Exception):  # noqa: B017, PT011
        V.read_strict(spark, str(tmp_path / "meta.json"), "title string").collect()


def test_publish_swaps_or_keeps(spark, tmp_path):
    target = str(tmp_path / "t")
    publish.publish(spark.range(5), target)
    with pytest.raises(ValueError, match="lose rows"):
        publish.publish(spark.range(3), target)
    with pytest.raises(ValueError, match="violations"):
        publish.publish(spark.range(9), target, violations=lambda d: d.where("id = 8"))
    assert spark.read.parquet(target).count() == 5
    publish.publish(publish.upsert(spark.read.parquet(target), spark.createDataFrame([(4,), (7,)], "id long"), ["id"]), target)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4, 7]
    s = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2)], "path string, made long")
    assert [r.path for r in publish.surplus(s, 0).collect()] == ["c", "a"]


def test_realignment(spark):
    old = ["The first paragraph of all.", "A second one about ships.", "Gone entirely, never seen again.", "The last words here."]
    new = ["The first paragraph of all.", "A second one about big ships.", "Something new.", "The last words here."]
    df = spark.createDataFrame([("b", old, new)], "book_id string, old array<string>, new array<string>")
    got = {r.old_ord: r.new_ord for r in records.realign_fuzzy(df).collect()}
    assert got == {1: 1, 2: 2, 4: 4}


def test_long_documents_are_realigned(spark, tmp_path):
    text = "\n".join(f"Line {i} of a long text, with the words {i * 7919 % 10007} and {i * 104729 % 10009}." for i in range(900))
    spark.createDataFrame([(1, text, "long"), (2, "One line.", "short")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES["paragraph_realign_fuzzy"](spark, str(tmp_path)).groupBy("book_id").count().collect()
    assert {r.book_id: r["count"] for r in got} == {"long": 675, "short": 1}


def test_realignment_looks_in_the_whole_stretch(spark):
    line = lambda i, end: f"{i * 7919 % 10007} {i * 104729 % 10009} {i * 1299709 % 100003} words of it {end}"
    old = [line(i, "then") for i in range(100)]
    far = [f"@{chr(97 + i % 26)}@{chr(65 + i // 26)}" * 9 for i in range(90)] + [line(i, "later") for i in range(100)]
    most = [f"@{chr(97 + i % 26)}@{chr(65 + i // 26)}" * 9 for i in range(310)] + [line(i, "later") for i in range(100)]
    df = spark.createDataFrame([("all", old, far), ("window", old, most)], "book_id string, old array<string>, new array<string>")
    got = records.realign_fuzzy(df).collect()
    assert {r.old_ord: r.new_ord for r in got if r.book_id == "all"} == {i: i + 90 for i in range(1, 101)}
    assert not any(r.book_id == "window" for r in got)  # 41,000 pairs


def test_quotes_of_any_length(spark):
    docs = spark.createDataFrame([(1, "one two  three\nfour five six seven one two"), (2, "two"), (3, "")], "doc_id long, text string")
    quotes = spark.createDataFrame([(1, "two"), (2, "two three"), (3, "two three four five six seven"), (4, " "), (5, "five seven"), (6, "one two")], "item_id long, text string")
    got = sorted(tuple(r) for r in search.relocate(docs, quotes).collect())
    assert got == [(1, 1, 2, 3), (1, 1, 9, 10), (1, 2, 1, 2), (2, 1, 2, 4), (3, 1, 2, 8), (6, 1, 1, 3), (6, 1, 8, 10)]
    assert search.relocate(docs, quotes.where("item_id = 4")).count() == 0


def test_highlights_are_placed(spark):
    text = "A cat sat. The  cat\nsat down; another cat sat."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = [("first", 1, "cat sat", "", ""), ("prefix", 1, "cat sat", "sat. The", ""), ("suffix", 1, "catsat", "", " down"), ("inside", 1, "noth", "", ""), ("both", 1, "cat sat", "other", "."), ("gone", 1, "dog", "", ""), ("empty", 1, " ", "", "")]
    got = {r.item_id: (r.start, r.end) for r in search.place(docs, spark.createDataFrame(rows, "item_id string, chapter long, exact string, prefix string, suffix string")).collect()}
    assert {k: text[a:b] for k, (a, b) in got.items()} == {"first": "cat sat", "prefix": "cat\nsat", "suffix": "cat\nsat", "inside": "noth", "both": "cat sat"}
    assert got["first"][0] == 2 and got["both"][0] == text.rindex("cat")


def test_snapshot_differences(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    f = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert sorted(map(tuple, records.snapshot_differences(m, f).collect())) == [("b", "changed"), ("c", "missing"), ("d", "extra")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [("c1", 3, 1000), ("c1", 3, 1000), ("c1", 1, 500), ("c2", 2, 1900), ("c2", None, 2000)]
    (tmp_path / "in/a.json").write_text("".join(json.dumps({"cardId": c, "bookId": "b", "rating": r, "reviewedAt": t}) + "\n" for c, r, t in lines) + "{bad\n")
    once = logs.once(logs.reviews(spark, str(tmp_path / "in")))
    logs.publish(once, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    q = logs.newest(logs.reviews(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.cardId, r["last"], r.rating) for r in spark.sql("select * from newest").collect()} == {("c1", 1000, 3), ("c2", 1900, 2)}
    q = logs.block_counts(logs.reviews(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("blocks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r.n for r in spark.sql("select * from blocks").collect()) == 4


def test_chapters_are_read(spark, tmp_path):
    (tmp_path / "book-a").mkdir()
    (tmp_path / "book-a/ch-01.md").write_bytes("# T\r\n\r\none\r\n\r\ntwo".encode())
    r = V.read_chapters(spark, str(tmp_path)).first()
    assert (r.book_id, r.chapter_file, r.text) == ("book-a", "ch-01.md", "# T\n\none\n\ntwo")
    p = V.paragraphs(spark.createDataFrame([(r.text, "a", 1)], "text string, source string, doc_id long"), "\n\n")
    assert [(x.anchor, x.text) for x in p.collect()] == [("^p-001", "one"), ("^p-002", "two")]
    assert V.listing(spark, str(tmp_path)).count() == 1


def test_blocks_are_trimmed_of_blanks_only(spark):
    from quire.sources import views as V

    df = spark.createDataFrame([("0 a 0\n  1b1 \n\n 2 \r\n3",)], "text string").select(V.blocks(F.col("text")).alias("b"))
    assert df.first().b == ["0 a 0", "1b1", "2", "3"]


def test_long_paragraph_and_stored_index(spark, tmp_path):
    """A paragraph of 100,000 words is indexed, and a stored index that is brought up to date is that of the new texts."""
    from quire.operators import search

    words = [f"w{i % 5000}" for i in range(100_000)]
    schema = "book_id string, chapter long, ord long, text string"
    old = spark.createDataFrame([("b", 1, 1, " ".join(words)), ("b", 2, 1, "gone away"), ("b", 3, 1, "w1 w2 stays"), ("b", 4, 1, "w1 stays")], schema)
    new = spark.createDataFrame([("b", 1, 1, "w1 w2 short"), ("b", 3, 1, "w1 w2 stays"), ("b", 4, 1, "w1 stays"), ("b", 5, 1, "w2 fresh"), ("b", 5, 2, "--")], schema)
    search.build_index(old, str(tmp_path / "a"))
    kept = spark.read.parquet(str(tmp_path / "a" / "postings"))
    assert kept.where("chapter = 1").count() == 5000 and kept.where("term = 'w7' and chapter = 1").first().positions == list(range(7, 100_000, 5000))
    search.update_index(str(tmp_path / "a"), str(tmp_path / "b"), spark.createDataFrame([(1,), (2,), (5,)], "chapter long"), new)
    rows = lambda df: sorted(map(tuple, df.select("book_id", "chapter", "ord", "term", "tf", "positions", "length").collect()))
    assert rows(spark.read.parquet(str(tmp_path / "b" / "postings"))) == rows(search.index(new))
    for typed in ("w1 AND w2", "stays NOT w2", "w* OR fresh", '"w1 w2"'):
        assert search.search_index(spark, str(tmp_path / "b"), typed).collect() == search.search(new, typed).collect()


def test_publish_survives_a_stop_between_its_renames(spark, tmp_path):
    import os

    from quire.operators import publish

    target = str(tmp_path / "t")
    publish.publish(spark.range(5), target)
    os.rename(target, target + "__old")  # a publish() broke off here
    with pytest.raises(ValueError, match="lose rows"):
        publish.publish(spark.range(1), target)
    assert spark.read.parquet(target).count() == 5
    os.rename(target, target + "__old")
    publish.publish(spark.range(7), target)
    assert spark.read.parquet(target).count() == 7 and not os.path.exists(target + "__old")


def test_three_line_ends_are_a_break_and_a_line_end(spark):
    df = spark.createDataFrame([("a\nb\n\nc\n\n\nd\n\n\n\ne",)], "t string")
    assert df.select(rules.exact_text(F.col("t"))).first()[0] == "a b\n\nc\n\n d\n\n\n\ne"


def test_answers_end_in_small_words_by_ascii_letters(spark):
    df = spark.createDataFrame([(" éçon",), ("aé x",), ("énon",), ("an idea",), ("idea on",), ("cannon",), ("plain",)], "a string")
    assert [r[0] for r in df.select(T.eligible_answer(F.col("a"))).collect()] == [False, False, True, False, False, True, True]


def test_cloze_display_without_a_second_word(spark, tmp_path):
    texts = ["One.\nTwo three.", "One.\nTwo", "One.\nTwo", "x A b", "x A b", "x A b", "x y a==b == c", "x y a==b == c", "x y a==b == c"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: (r.before, r.target, r.after) for r in catalog.QUERIES["cloze_display"](spark, str(tmp_path)).collect()}
    want = [("", t) if t.startswith("One") else (t.split()[1], t[3:]) for t in texts]
    assert got == {i: ("A ", word, rest) for i, (word, rest) in enumerate(want)}


def _shuffled(spark):
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_stored_postings_are_those_of_the_index(spark, tmp_path):
    d = spark.createDataFrame([("b", 2, 1, "One two one."), ("b", 1, 1, "two ÉÉ three"), ("c", None, 1, "one"), ("b", 1, 2, "?!"), ("b", 3, 7, "one " * 50)], "book_id string, chapter long, ord long, text string")
    d = d.unionByName(V.paragraphs(V.table(spark, "/root/testdata/sf0.001", "documents")).select(d.columns))
    before = _shuffled(spark)
    search.build_index(d, f"{tmp_path}/a", buckets=5)
    assert _shuffled(spark) - before < 1_000_000  # 3,496,439 bytes as rows of words
    got = spark.read.parquet(f"{tmp_path}/a/postings")
    assert got.exceptAll(search.index(d).select(got.columns)).isEmpty() and search.index(d).select(got.columns).exceptAll(got).isEmpty()
    search.update_index(f"{tmp_path}/a", f"{tmp_path}/b", d.where("chapter = 2 or chapter = 3"), d.where("chapter <> 3 or chapter is null"), buckets=3)
    want, got = search.index(d.where("chapter <> 3 or chapter is null")).select(got.columns), spark.read.parquet(f"{tmp_path}/b/postings")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stems_take_each_word_once(spark, monkeypatch):
    import pyarrow as pa

    asked, stem = [], udfs.porter
    monkeypatch.setattr(udfs, "porter", lambda w: asked.append(w) or stem(w))
    udfs._stem.cache_clear()
    got = udfs.stems.func(pa.array([["ponies", "relational", "ponies"], None, [], ["ponies", "éclairs"]]))
    assert got.to_pylist() == [["poni", "relat", "poni"], [], [], ["poni", "eclair"]]
    assert sorted(asked) == ["eclairs", "ponies", "relational"]
    df = spark.createDataFrame([(["ponies", "x"],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in df.select(udfs.stems("t")).collect()] == [["poni", "x"], [], []]


def test_near_copies_are_those_of_difflib_and_unlike_texts_need_none(monkeypatch):
    import difflib
    import random

    r, ratio = random.Random(5), lambda *p: difflib.SequenceMatcher(None, *p, autojunk=False).ratio()
    pairs, some = [], set()
    for _ in range(300):
        x = "".join(r.choices("aeinst é.", k=r.randint(5, 60)))
        y = "".join(c if r.random() > r.choice([0.1, 0.2, 0.3]) else r.choice("aeinst é.") for c in x)
        pairs.append((x, y))
    for x, y in pairs:
        some.add(want := x in y or y in x or max(ratio(x, y), ratio(y, x)) >= cards.ALIKE)
        assert cards.near_copies(x, y) == want
    assert some == {True, False}
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert not cards.near_copies("The market sets a price for each level.", "Rain fell on dusk and nobody knew why.")
