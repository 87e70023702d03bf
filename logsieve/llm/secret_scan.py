"""Secret scan: fixed patterns plus a randomness test battery.

Three patterns (assignments, access keys, long hex runs) always report. Beside
them every long token over an encoding's alphabet is tested: its symbols must
pass a runs test and a lag-1 serial-correlation test for randomness, and its
chi-squared uniformity statistic must be too small for text. The p-value of the
last (chance that text of this length over this alphabet looks as uniform) is
weighted by length, and the Benjamini-Hochberg rule over all tokens of the
corpus, weighted so, bounds the share of false discoveries by ``fdr``.

One pass over the texts makes a small row for each document, which is
checkpointed; the rule needs only a histogram of the weighted p-values (at most
``BINS`` rows, pre-aggregated before their shuffle). DataFrame functions only.

Positions are code points, the end is exclusive. A pattern's span is its whole
match. Spans of the battery have the kind ``random`` and never overlap those of
the patterns.

Defined results: null text counts as empty; texts without finds have zero
counts, empty ``spans`` and the digest of the empty string. Very long texts are scanned whole. Repeated rows give
repeated results; an empty table gives an empty result. Spans that begin together are in the order of their kinds.
Columns beyond id and text, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import durable, table

# Fixed values of the contract of op7: kind, pattern, tested group, least characters of that group.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
KINDS = [p[0] for p in PATTERNS] + ["random"]
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Fixed values of the battery: encodings, narrowest first: (test, alphabet).
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UP + "234567"),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _DIGITS + _LOW),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", _DIGITS + _UP),
    (r"^(?=.*([0-9]|[A-Z].+[A-Z]))(?=.*[a-z])[A-Za-z0-9]+$", _UP + _LOW + _DIGITS),
    (r"^(?=.*([0-9]|[A-Z].+[A-Z]))(?=.*[a-z])[A-Za-z0-9+/]+$", _UP + _LOW + _DIGITS + "+/"),
    (r"^(?=.*([0-9]|[A-Z].+[A-Z]))(?=.*[a-z])[A-Za-z0-9_-]+$", _UP + _LOW + _DIGITS + "-_"),
)
#: Sum of squared letter frequencies of text, for the text hypothesis.
TEXT_COINCIDENCE = 0.06
#: Resolution and range of the histogram of -log10(weighted p).
BIN, BINS = 0.05, 800
_BLOCK = 128


@dataclass(frozen=True)
class Battery:
    fdr: float = 0.01
    #: Least p-value of the runs and serial tests.
    accept: float = 0.01
    #: Length at which a token's weight stops growing.
    full_length: int = 64


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the logistic approximation (error below 2e-4)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z))


def _sum(xs: Column, f=lambda x: x, zero=0.0) -> Column:
    return F.aggregate(xs, F.lit(zero), lambda a, x: a + f(x))


def _locate(df: DataFrame, text: Column, name: str, pattern: str, group: int) -> DataFrame:
    """Adds column ``name``: array of (s, e, g), the matches of ``pattern`` in order.

    Starts are prefix sums over the lengths of what the pattern splits; blocks
    keep them linear in the number of matches.
    """
    empty = F.array().cast("array<string>")
    hit = text.rlike(pattern)
    whole = F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty)
    part = F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(empty) if group else None
    cut = F.when(hit, F.transform(F.split(text, pattern), F.char_length)).otherwise(F.array().cast("array<int>"))
    m, c, g, b = f"__m{name}", f"__c{name}", f"__g{name}", f"__b{name}"
    df = df.withColumns({m: whole, c: cut} | ({g: part} if group else {}))
    step = f"__s{name}"
    df = df.withColumn(step, F.transform(m, lambda x, i: F.get(c, i) + F.char_length(x)))
    n = F.size(step)
    sums = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / _BLOCK).cast("int")),
        lambda k: _sum(F.slice(step, k * _BLOCK + 1, _BLOCK), zero=0),
    )
    bases = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    df = df.withColumn(b, bases)

    def span(x: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        before = F.get(b, block) + _sum(F.slice(step, block * _BLOCK + 1, i % _BLOCK), zero=0)
        start = before + F.get(c, i)
        return F.struct(
            start.alias("s"), (start + F.char_length(x)).alias("e"), (F.get(g, i) if group else x).alias("g")
        )

    df = df.withColumn(name, F.transform(m, span))
    return df.drop(m, c, b, step, *([g] if group else []))


def _symbol_values(x: Column) -> Column:
    """Place of each symbol of x.g in the alphabet x.a, from 0."""
    symbols = F.filter(F.split(x["g"], ""), lambda ch: ch != "")
    return F.transform(symbols, lambda ch: (F.call_function("instr", x["a"], ch) - 1).cast("double"))


def _with_battery(df: DataFrame, name: str, battery: Battery) -> DataFrame:
    """Turns the located tokens of column ``name`` into (s, e, n, p): p is null if a test rejects randomness."""
    alphabet = lambda g: F.coalesce(*(F.when(g.rlike(test), F.lit(a)) for test, a in ENCODINGS))
    keep = lambda x, *more: F.struct(x["s"].alias("s"), x["e"].alias("e"), *more)
    df = df.withColumn(name, F.transform(name, lambda x: keep(x, x["g"].alias("g"), alphabet(x["g"]).alias("a"))))
    df = df.withColumn(name, F.filter(name, lambda x: x["a"].isNotNull()))

    def facts(x):
        k, n = F.char_length(x["a"]).cast("double"), F.char_length(x["g"]).cast("double")
        counts = F.transform(
            F.filter(F.split(x["a"], ""), lambda ch: ch != ""),
            lambda ch: n - F.char_length(F.call_function("replace", x["g"], ch, F.lit(""))),
        )
        return keep(x, k.alias("k"), n.alias("n"), _symbol_values(x).alias("v"), _sum(counts, lambda c: c * c).alias("q"))

    def moments(x):
        mean = _sum(x["v"]) / x["n"]
        ups = F.transform(x["v"], lambda v: F.when(v * 2 >= x["k"] - 1, 1.0).otherwise(0.0))
        return keep(x, *(x[f].alias(f) for f in "knvq"), mean.alias("mean"), ups.alias("up"))

    def tests(x):
        pairs = F.slice(x["v"], 2, F.size(x["v"]))
        centred = lambda v: v - x["mean"]
        spread = _sum(x["v"], lambda v: centred(v) * centred(v))
        products = _sum(F.transform(pairs, lambda v, i: centred(v) * centred(F.get(x["v"], i))))
        serial = (products / F.greatest(spread, F.lit(1e-9)) + 1 / x["n"]) * F.sqrt(x["n"])
        n1 = _sum(x["up"])
        n2 = x["n"] - n1
        both = 2 * n1 * n2
        runs = 1 + _sum(
            F.transform(
                F.slice(x["up"], 2, F.size(x["up"])),
                lambda u, i: F.when(u != F.get(x["up"], i), 1.0).otherwise(0.0),
            )
        )
        expected = both / x["n"] + 1
        variance = F.greatest(both * (both - x["n"]) / (x["n"] * x["n"] * (x["n"] - 1)), F.lit(1e-9))
        z_runs = (runs - expected) / F.sqrt(variance)
        chi = x["k"] / x["n"] * x["q"] - x["n"]
        shift = x["n"] * F.greatest(x["k"] * TEXT_COINCIDENCE - 1, F.lit(0.5))
        z_text = (x["k"] - 1 + shift - chi) / F.sqrt(2 * (x["k"] - 1) + 4 * shift)
        z_random = (chi - (x["k"] - 1)) / F.sqrt(2 * (x["k"] - 1) * (x["n"] - 1) / x["n"])
        random = (
            (2 * _normal_tail(F.abs(serial)) >= battery.accept)
            & (2 * _normal_tail(F.abs(z_runs)) >= battery.accept)
            & (_normal_tail(z_random) >= battery.accept)
        )
        return keep(x, x["n"].alias("n"), F.when(random, _normal_tail(z_text)).alias("p"))

    for stage in (facts, moments, tests):
        df = df.withColumn(name, F.transform(name, stage))
    return df


def _threshold(df: DataFrame, battery: Battery, weight) -> float:
    """Largest weighted p-value that the weighted Benjamini-Hochberg rule accepts; 0 if none."""
    tokens = df.select(F.explode("random").alias("x")).select("x.n", "x.p")
    total = tokens.agg(F.count(F.lit(1)).alias("m"), F.avg(weight(F.col("n"))).alias("w")).first()
    if not total["m"]:
        return 0.0
    place = F.floor(-F.log10(F.greatest(F.col("p") * total["w"] / weight(F.col("n")), F.lit(1e-39))) / BIN)
    bins = tokens.where("p is not null").groupBy(F.greatest(F.lit(0), place).alias("bin")).count()
    found, best = 0, 0.0
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):  # at most BINS rows
        found += row["count"]
        edge = 10 ** (-BIN * row["bin"])
        if edge * total["m"] <= battery.fdr * found:
            best = edge
    return best * total["w"]


def _long_enough(name: str, kind: int, least: int) -> Column:
    found = F.filter(name, lambda x: F.char_length(x["g"]) >= least)
    return F.transform(
        found, lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"))
    )


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", battery: Battery = Battery()
) -> DataFrame:
    """id_col and ``found``: array of (start, kind, end), sorted; kind is a place in KINDS."""
    text = "__text"
    df = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    for name, pattern, group, _ in PATTERNS:
        df = _locate(df, F.col(text), name, pattern, group)
    df = _with_battery(_locate(df, F.col(text), "random", TOKEN, 0), "random", battery)
    base = F.concat(*(_long_enough(name, kind, least) for kind, (name, _, _, least) in enumerate(PATTERNS)))
    df = durable(df.select(id_col, F.sort_array(base).alias("base"), "random"))
    weight = lambda n: F.least(n, F.lit(float(battery.full_length)))
    most = _threshold(df, battery, weight)
    new = F.filter("random", lambda x: x["p"].isNotNull() & (x["p"] / weight(x["n"]) <= most))
    free = F.filter(new, lambda x: ~F.exists("base", lambda b: (b["start"] < x["e"]) & (x["s"] < b["end"])))
    as_spans = F.transform(
        free, lambda x: F.struct(x["s"].alias("start"), F.lit(len(PATTERNS)).alias("kind"), x["e"].alias("end"))
    )
    return df.select(id_col, "base", F.sort_array(F.concat("base", as_spans)).alias("found"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def op7_randomness_battery(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{name}") for kind, (name, *_) in enumerate(PATTERNS)),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("found")).alias("spans"),
    )
