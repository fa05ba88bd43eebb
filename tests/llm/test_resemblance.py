"""Near-dedup of the pipeline against all pairs of a small table."""

import itertools
import random

import pytest

from quire.llm import common, resemblance, simhash
from tests.llm.test_operators import fingerprint_by_hand


def sets(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {b" ".join(w)} if w else set()


def smallest(texts, fingerprints=True):
    up, s, fp = {i: i for i in texts}, {i: sets(t) for i, t in texts.items()}, {i: fingerprint_by_hand(t, 5) for i, t in texts.items()}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if s[a] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) or fingerprints and (fp[a] ^ fp[b]).bit_count() <= 2:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {top(i) for i in texts}


def drift(rng, words, n):
    """n texts, each the one before with three words changed: those far apart resemble each other less and less."""
    for _ in range(n):
        yield " ".join(words)
        for at in rng.sample(range(len(words)), 3):
            words[at] = f"w{rng.randrange(5000)}"


@pytest.mark.parametrize("case", ["real", "drift"])
def test_deduplicated(spark, case):
    if case == "real":
        docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
        texts = {r.doc_id: r.text for r in docs.collect()}
    else:
        rng = random.Random(7)
        made = [t for _ in range(3) for t in drift(rng, [f"w{rng.randrange(5000)}" for _ in range(150)], 40)] + ["a b", "A  b", "c", "", "  "]
        rng.shuffle(made)
        texts = dict(enumerate(made))
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    kept = sorted(r.doc_id for r in simhash.deduplicated(docs).collect())
    assert kept == sorted(smallest(texts))


def test_pairs_are_few_and_true(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(words[:150] + [f"x{rng.randrange(10**6)}"] + words[150:]) for i in range(200)}
    member, pairs = resemblance.links(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = pairs.collect()
    assert member.count() == 200 and len(got) <= 199 * 8
    assert all(len(sets(texts[p.a]) & sets(texts[p.b])) >= 0.8 * len(sets(texts[p.a]) | sets(texts[p.b])) for p in got)
    assert {r.component for r in common.components(pairs).collect()} == {0}


def test_nothing(spark):
    member, pairs = resemblance.links(spark.createDataFrame([(1, None), (None, "a b"), (2, " ")], "doc_id long, text string"))
    assert member.count() == pairs.count() == 0


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rng = random.Random(3)
    word = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c = word(60), word(60), word(60)
    rows = [(5, a), (5, b), (5, b), (3, b + " x"), (9, c), (9, None), (2, ""), (None, a), (7, a)]
    kept = {(r.doc_id, r.text) for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {(5, a), (3, b + " x"), (9, c), (2, ""), (None, a)}


def test_copies_of_one_text_meet_through_it(spark):
    """Copies that differ from a text by a tenth of their words and so from each other by too much are linked through it, with few pairs."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = {900: " ".join(words)}
    for i in range(150):
        w = list(words)
        for at in rng.sample(range(400), 8):
            w[at] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    s = {i: sets(t) for i, t in texts.items()}
    assert len(s[0] & s[1]) < 0.8 * len(s[0] | s[1]) and len(s[0] & s[900]) > 0.8 * len(s[0] | s[900])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, pairs = resemblance.links(docs)
    assert pairs.count() < 4 * 150
    assert {r.component for r in common.components(pairs).collect()} == {0} and [r.doc_id for r in simhash.deduplicated(docs).collect()] == [0]
