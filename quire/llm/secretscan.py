"""Op 7: secret scan by patterns and a randomness test battery, by DataFrame functions only.

Besides three fixed patterns, runs of encoding characters are tested for randomness: chi-squared uniformity over the
alphabet of the encoding inferred from the run, a runs test about the alphabet's middle, and lag-one serial correlation.
The three p-values are combined by Fisher's method. Runs that are not random are discoveries, controlled by
Benjamini-Hochberg within each length class over the whole corpus, so few random runs are thrown away at any length;
the runs that stay, and that are long enough for the battery to have power, are secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order in which ties are listed; (kind, pattern, least length of the group, group).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets of the inferred encodings, the narrowest that holds a run is its encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Upper bounds of the length classes, bins of -log10 p, false-discovery rate, and least information of a secret in bits.
CLASSES, BINS, RATE, LEAST_BITS = (24, 32, 48, 64, 96, 160), 200, 0.05, 96.0
RANDOM = "random"


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, e>>: code-point spans of the leftmost non-overlapping matches whose group has `least` characters.

    The pieces between matches give the places: split() cuts at the same matches that regexp_extract_all() returns.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("of"))

    def walk(p: Column) -> Column:
        steps = F.zip_with(F.transform(p["hits"], F.length), F.transform(F.slice(p["gaps"], 1, F.size(p["hits"])), F.length), lambda h, g: F.struct(g.alias("gap"), h.alias("hit")))
        steps = F.zip_with(steps, F.transform(p["of"], F.length), lambda x, o: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), o.alias("of")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,of:int>>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["hit"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("s"), (acc["at"] + x["gap"] + x["hit"]).alias("e"), x["of"].alias("of")))).alias("out"))
        spans = F.aggregate(steps, start, add, lambda acc: acc["out"])
        return F.transform(F.filter(spans, lambda x: x["of"] >= least), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    none = F.array().cast("array<struct<s:int,e:int>>")
    return F.when(text.rlike(pattern), F.transform(F.array(parts), walk)[0]).otherwise(none)


def _upper_normal(z: Column) -> Column:
    """P(Z > z) for z of either sign, by Abramowitz and Stegun 26.2.17."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + a * 0.2316419)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.greatest(F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail), F.lit(1e-300))


def encoding(run: Column) -> Column:
    """Name of the narrowest alphabet that holds the run without its trailing =; base64 where none does."""
    body, out = F.regexp_replace(run, "=+$", ""), F.lit("base64")
    for name, letters in reversed(ALPHABETS.items()):
        out = F.when(body.rlike(f"^[{letters.replace('-', chr(92) + '-')}]*$"), F.lit(name)).otherwise(out)
    return out


def battery(run: Column) -> Column:
    """Struct (n, k, chi2, runs, serial, p): length and alphabet size, p-values of the three tests against randomness, and Fisher's combination."""
    name = encoding(run)
    letters = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), name)
    chars = F.filter(F.split(F.regexp_replace(run, "=+$", ""), ""), lambda c: c != "")
    base = F.struct(chars.alias("c"), letters.alias("l"))

    def places(b: Column) -> Column:
        x = F.transform(b["c"], lambda c: F.call_function("instr", b["l"], c).cast("double"))
        return F.struct(b["c"].alias("c"), x.alias("x"), F.length(b["l"]).cast("double").alias("k"), F.size(b["c"]).cast("double").alias("n"))

    def tests(p: Column) -> Column:
        n, k, zero = p["n"], p["k"], F.lit(0.0)
        squares = F.aggregate(F.transform(F.array_distinct(p["c"]), lambda d: F.size(F.filter(p["c"], lambda c: c == d)).cast("double")), zero, lambda a, v: a + v * v)
        chi = squares * k / n - n
        # Wilson and Hilferty: the cube root of chi2 / df is nearly normal.
        z_chi = (F.pow(F.greatest(chi, zero) / (k - 1), F.lit(1 / 3)) - (F.lit(1.0) - F.lit(2 / 9) / (k - 1))) / F.sqrt(F.lit(2 / 9) / (k - 1))
        high = F.transform(p["x"], lambda v: (v > k / 2).cast("int"))
        up = F.aggregate(high, F.lit(0), lambda a, v: a + v).cast("double")
        steps = F.zip_with(F.slice(high, 2, F.size(high)), F.slice(high, 1, F.greatest(F.size(high) - 1, F.lit(0))), lambda a, b: (a != b).cast("int"))
        runs = F.aggregate(steps, F.lit(1), lambda a, v: a + v).cast("double")
        both = 2 * up * (n - up)
        spread = F.sqrt(F.greatest(both * (both - n) / (n * n * F.greatest(n - 1, F.lit(1.0))), F.lit(1e-9)))
        p_runs = F.when((up == 0) | (up == n), F.pow(F.lit(2.0), 1 - n)).otherwise(2 * _upper_normal(F.abs(runs - both / n - 1) / spread))
        mean = F.aggregate(p["x"], zero, lambda a, v: a + v) / n
        dev = F.transform(p["x"], lambda v: v - mean)
        var = F.greatest(F.aggregate(dev, zero, lambda a, v: a + v * v), F.lit(1e-9))
        lag = F.aggregate(F.zip_with(F.slice(dev, 2, F.size(dev)), F.slice(dev, 1, F.greatest(F.size(dev) - 1, F.lit(0))), lambda a, b: a * b), zero, lambda a, v: a + v)
        p_serial = 2 * _upper_normal(F.abs((lag / var + 1 / n) * F.sqrt(n)))
        return F.struct(n.alias("n"), k.alias("k"), _upper_normal(z_chi).alias("chi2"), F.least(F.lit(1.0), p_runs).alias("runs"), F.least(F.lit(1.0), p_serial).alias("serial"))

    def fisher(t: Column) -> Column:
        x = -(F.log(t["chi2"]) + F.log(t["runs"]) + F.log(t["serial"]))
        # chi-squared with six degrees of freedom, in closed form
        p = F.exp(-x) * (1 + x + x * x / 2)
        return F.struct(*[t[f].alias(f) for f in ("n", "k", "chi2", "runs", "serial")], F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300)).alias("p"))

    for f in (places, tests, fisher):
        base = F.transform(F.array(base), f)[0]
    return base


def _class(n: Column) -> Column:
    out = F.lit(len(CLASSES))
    for i, most in reversed(list(enumerate(CLASSES))):
        out = F.when(n <= most, F.lit(i)).otherwise(out)
    return out


def _candidates(text: Column) -> Column:
    """array<struct<s, e, t>>: runs of encoding characters with a digit and a letter, the battery's results in t."""
    spans = matches(text, CANDIDATE, 0, 20)
    runs = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.substring(text, x["s"] + 1, x["e"] - x["s"]).alias("run")))
    runs = F.filter(runs, lambda x: x["run"].rlike("[0-9]") & x["run"].rlike("[A-Za-z]"))
    return F.transform(runs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), battery(x["run"]).alias("t")))


def _bin(p: Column) -> Column:
    """Bins of -log10 p, a tenth wide, the last open; a p-value counts as its bin's largest."""
    return F.least(F.floor(-F.log10(p) * 10), F.lit(BINS)).cast("int")


def thresholds(docs: DataFrame) -> dict[int, int]:
    """The least bin of discoveries by length class, by Benjamini-Hochberg over the histogram of all candidates: at most classes * bins rows."""
    t = docs.select(F.explode(_candidates(F.coalesce("text", F.lit("")))).alias("c")).select(_class(F.col("c.t.n")).alias("class"), _bin(F.col("c.t.p")).alias("bin"))
    counts: dict[int, dict[int, int]] = {}
    for r in t.groupBy("class", "bin").count().collect():
        counts.setdefault(r["class"], {})[r["bin"]] = r["count"]
    out = {}
    for c, bins in counts.items():
        total, seen, best = sum(bins.values()), 0, BINS + 1
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / 10) <= RATE * seen / total:
                best = b
        out[c] = best
    return out


def with_spans(docs: DataFrame, limits: dict[int, int] | None = None) -> DataFrame:
    """docs with __spans, array<struct<s, rank, e, kind>> ascending: base kinds and, from the battery, kind random."""
    limits = thresholds(docs) if limits is None else limits
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs
    for kind, pattern, group, least in KINDS:
        d = d.withColumn(f"__{kind}", matches(text, pattern, group, least))
    d = d.withColumn("__random", _candidates(text))

    def secret(x: Column) -> Column:
        least = F.lit(BINS + 1)
        for c, b in limits.items():
            least = F.when(_class(x["t"]["n"]) == c, F.lit(b)).otherwise(least)
        return (_bin(x["t"]["p"]) < least) & (x["t"]["n"] * F.log2(x["t"]["k"]) >= LEAST_BITS)

    def tagged(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")))

    listed = [tagged(F.col(f"__{k[0]}"), i, k[0]) for i, k in enumerate(KINDS)] + [tagged(F.filter("__random", secret), len(KINDS), RANDOM)]
    return d.withColumn("__spans", F.sort_array(F.concat(*listed))).drop("__random")


def _join(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs (doc_id, text).

    Spans are kind:start:end in code points, the end exclusive, of whole matches. Null texts are empty and have no spans;
    repeated rows are scanned each; other columns are ignored; an empty table gives an empty result.
    """
    d = with_spans(docs.select("doc_id", "text"))
    base = F.filter("__spans", lambda x: x["kind"] != RANDOM)
    counts = [F.size(f"__{k[0]}").cast("long").alias(f"n_{k[0]}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(_join(base).cast("binary"), 256).alias("base_sha256"), _join(F.col("__spans")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """docs with `mark` in place of each secret (overlapping ones together) and, if there, n_chars of the new text."""
    d = with_spans(docs)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.coalesce(F.col("text"), F.lit(""))
    add = lambda acc, x: F.struct(
        F.greatest(acc["at"], x["e"]).alias("at"),
        F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
    )
    new = F.aggregate("__spans", start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    d = d.withColumn("text", F.when(F.size("__spans") > 0, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)
