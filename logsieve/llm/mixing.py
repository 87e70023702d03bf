"""Temperature mixing of sources, realised as budgeted block permutations.

Weights are the sources' token shares raised to an exponent and normalised.
The exponent is found by bisection: the largest one in [0, 1] whose weights reach
a target entropy, but not below the least one that keeps every source within
a repetition limit. Each job tries the 31 exponents that five bisection steps could
ask for, over the small table of sources.

A source's budget is its weight's share of the total budget. Without a given total
the budget is the least one at which every source is seen whole once, so that
nothing is lost. A budget is spent in blocks: every block is a pseudo-random
permutation of the whole source, the last one is cut where the budget ends.

No document is shuffled to make the choice. The cut of a last block is found from
token sums by leading digits of the permutation key (half of the digits, then the other
half), then inside one digit bucket for each source; all are pre-aggregated and hold no
more than a bounded share of a hot source. DataFrame functions only: no Python on the executors.

Defined results: a null source counts as the source of the empty name. Texts
without words have 0 tokens and follow their block. Repeated rows are drawn
each on its own; their keys are equal, so a cut takes or leaves them together.
Null ids count as empty text in the key; rows of one source with equal ids share a place. Very long texts are one row like any
other. An empty table gives an empty result. Other columns are kept; ``block``,
``place`` and ``n_tokens`` are added and replace columns of those names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import durable, shuffle_partitions, table, words_of

STEPS_PER_JOB, JOBS = 5, 8
#: Tables of sources up to this many rows are broadcast, larger ones are joined by shuffle.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """``entropy`` is a share of the largest possible entropy, the logarithm of the number of sources."""

    entropy: float | None = 0.97
    repeats: float = 2.0
    budget: int | None = None
    seed: int = 1


def _curve(sources: DataFrame, exponents: list[float]) -> dict[float, dict]:
    """Entropy and largest and smallest weight-to-share ratio at each exponent."""
    tried = sources.where("n > 0").withColumn("a", F.explode(F.array(*map(F.lit, exponents))))
    power = F.exp(F.col("a") * F.ln("p"))
    rows = tried.groupBy("a").agg(
        F.sum(power).alias("z"),
        F.sum(power * F.ln("p")).alias("s"),
        F.max(power / F.col("p")).alias("high"),
        F.min(power / F.col("p")).alias("low"),
    )
    return {
        r["a"]: {"z": r["z"], "entropy": math.log(r["z"]) - r["a"] * r["s"] / r["z"], "high": r["high"] / r["z"], "low": r["low"] / r["z"]}
        for r in rows.collect()  # one row for each exponent tried
    }


def find_exponent(sources: DataFrame, mix: Mix, total: float, n_sources: int) -> float:
    """Bisects for both conditions at once; each holds on one side of its bound."""

    def repeats(c: dict) -> float:
        return mix.budget / total * c["high"] if mix.budget else c["high"] / c["low"]

    # spread[x] keeps the known bounds: the entropy holds up to its bound, the limit from its bound.
    bounds = {"entropy": (0.0, 1.0), "repeats": (0.0, 1.0)}
    ends = _curve(sources, [0.0, 1.0])
    target = None if mix.entropy is None else mix.entropy * math.log(n_sources)
    holds = {
        "entropy": (lambda c: c["entropy"] >= target) if target is not None else (lambda c: True),
        "repeats": lambda c: repeats(c) > mix.repeats,  # still too many
    }
    for name, test in holds.items():
        if test(ends[1.0]):
            bounds[name] = (1.0, 1.0)
        elif not test(ends[0.0]):
            bounds[name] = (0.0, 0.0)
    for _ in range(JOBS):
        grids = {
            name: [lo + (hi - lo) * i / 2**STEPS_PER_JOB for i in range(1, 2**STEPS_PER_JOB)]
            for name, (lo, hi) in bounds.items()
            if hi > lo
        }
        if not grids:
            break
        curve = _curve(sources, sorted({a for g in grids.values() for a in g}))
        for name, grid in grids.items():
            lo, hi = bounds[name]
            for a in grid:
                if holds[name](curve[a]):
                    lo = a
                else:
                    hi = a
                    break
            bounds[name] = (lo, hi)
    highest = bounds["entropy"][0] if mix.entropy is not None else 0.0
    return max(highest, bounds["repeats"][1])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _edge(sums: DataFrame, digits: int, sources: int) -> DataFrame:
    """src, edge, before: each source's first bucket that doesn't fit whole into ``rest``, and the tokens of all earlier ones.

    Found by prefix sums in two levels: over the first half of a bucket's digits, then over the second half inside the one
    group that the first step found. A source has at most 16 ** 3 rows in either window, however large it is.
    """
    half = (digits + 1) // 2
    levels = sums.withColumns({"group": F.substring("bucket", 1, half), "before": F.lit(0).cast("long")})
    ordered = lambda place: Window.partitionBy("src").orderBy(place)

    def first_over(rows: DataFrame, place: str) -> DataFrame:
        upto = rows.withColumn("upto", F.col("before") + F.sum("t").over(ordered(place)))
        over = upto.where(F.col("upto") > F.col("rest")).groupBy("src")
        return over.agg(F.min_by(F.struct(F.col(place).alias("edge"), (F.col("upto") - F.col("t")).alias("before")), place).alias("e")).select("src", "e.*")

    groups = levels.groupBy("src", "group").agg(F.sum("t").alias("t"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    found = _small(first_over(groups, "group").withColumnRenamed("edge", "group"), sources)
    return first_over(levels.drop("before").join(found, ["src", "group"]), "bucket")


def _key(mix: Mix, source: Column, block: Column, id_: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(mix.seed)), source, block.cast("string"), id_.cast("string")))


def mix_sources(
    docs: DataFrame,
    mix: Mix = Mix(),
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """A row for each document and block that it is drawn in: + block, place (order in the block), n_tokens."""
    docs = docs.drop("block", "place", "n_tokens")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    light = durable(
        docs.select(F.col(id_col).alias("id"), source.alias("src"), F.size(words_of(F.col(text_col))).cast("long").alias("t"))
    )
    totals = durable(light.groupBy("src").agg(F.sum("t").alias("n"), F.count(F.lit(1)).alias("docs")))
    whole = totals.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("k"), F.count(F.lit(1)).alias("rows"), F.sum("docs").alias("docs")).first()
    empty = docs.withColumns({"block": F.lit(0), "place": _key(mix, source, F.lit(0), F.col(id_col)), "n_tokens": F.lit(0).cast("long")})
    if not whole["n"]:
        return empty
    shares = totals.withColumn("p", F.col("n") / F.lit(float(whole["n"])))
    a = find_exponent(shares, mix, float(whole["n"]), whole["k"])
    at = _curve(shares, [a])[a]
    scale = mix.budget / whole["n"] if mix.budget else 1 / at["low"]
    power = F.exp(F.lit(a) * F.ln("p"))
    epochs = F.when(F.col("n") > 0, power / F.lit(at["z"]) / F.col("p") * F.lit(scale)).otherwise(F.lit(1.0))
    # Rounded to a millionth of an epoch, so that a source meant to be seen whole isn't cut by rounding.
    epochs = F.round(epochs, 6)
    plan = shares.withColumn("epochs", epochs).withColumns(
        {
            "full": F.floor("epochs").cast("int"),
            "rest": F.floor((F.col("epochs") - F.floor("epochs")) * F.col("n")).cast("long"),
        }
    )
    plan = durable(plan.select("src", "full", "rest"))
    # Enough digits that a bucket of the largest source is small beside a partition.
    per_bucket = 2000
    digits = min(6, max(1, math.ceil(math.log(max(whole["docs"] / per_bucket, 1), 16)) + 1))
    drawn = light.join(_small(plan.where("rest > 0"), whole["rows"]), "src")
    drawn = drawn.withColumn("key", _key(mix, F.col("src"), F.col("full"), F.col("id")))
    drawn = drawn.withColumn("bucket", F.substring("key", 1, digits))
    sums = durable(drawn.groupBy("src", "bucket").agg(F.sum("t").alias("t"), F.first("rest").alias("rest")))
    edge = durable(_edge(sums, digits, whole["rows"]))
    near = drawn.join(_small(edge, whole["rows"]), "src").where(F.col("bucket") == F.col("edge"))
    inside = Window.partitionBy("src").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("upto", F.col("before") + F.sum("t").over(inside))
    last = near.where(F.col("upto") <= F.col("rest")).groupBy("src").agg(F.max("key").alias("cut"))
    cuts = plan.join(edge, "src", "left").join(last, "src", "left")
    # Keys below the edge bucket are drawn, inside it up to the cut; without an edge the block is drawn whole.
    cuts = durable(
        cuts.select(
            "src",
            "full",
            F.when(F.col("rest") == 0, "").when(F.col("edge").isNull(), "~").otherwise(F.coalesce("cut", "edge")).alias("cut"),
        )
    )
    joined = docs.withColumn("__src", source).join(
        _small(cuts.select(F.col("src").alias("__src"), F.col("full").alias("__full"), F.col("cut").alias("__cut")), whole["rows"]),
        "__src",
    )
    last_key = _key(mix, F.col("__src"), F.col("__full"), F.col(id_col))
    more = F.when((F.col("__cut") != "") & (last_key <= F.col("__cut")), F.col("__full")).otherwise(F.col("__full") - 1)
    joined = joined.withColumn(
        "block",
        F.explode(F.when(more >= 0, F.sequence(F.lit(0), more)).otherwise(F.array().cast("array<int>"))),
    )
    return joined.withColumns(
        {
            "place": _key(mix, F.col("__src"), F.col("block"), F.col(id_col)),
            "n_tokens": F.size(words_of(F.col(text_col))).cast("long"),
        }
    ).drop("__src", "__full", "__cut")


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows dealt out and sorted as drawn: by block, then by place."""
    n = shuffle_partitions(mixed.sparkSession)
    return mixed.repartitionByRange(n, "block", "place").sortWithinPartitions("block", "place")


def op3_temperature_mixing(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "block", "place", "n_tokens")


def oracle(mix: Mix = Mix()) -> str:
    """DuckDB form: both bisections as recursive queries of 40 steps."""
    space = r"[\x20\x09-\x0D]"
    key = lambda block: f"md5(concat_ws('|', '{mix.seed}', src, CAST({block} AS VARCHAR), CAST(doc_id AS VARCHAR)))"
    at = lambda a, what: f"(SELECT {what} FROM (SELECT sum(exp({a} * ln(p))) AS z, sum(exp({a} * ln(p)) * ln(p)) AS s, max(exp({a} * ln(p)) / p) AS high, min(exp({a} * ln(p)) / p) AS low FROM shares) q)"

    def bisect(name: str, holds: str) -> str:
        return f"""{name} AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
          SELECT i + 1, CASE WHEN {holds} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {holds} THEN hi ELSE (lo + hi) / 2 END
          FROM {name} WHERE i < {STEPS_PER_JOB * JOBS})"""

    mid = "((lo + hi) / 2)"
    entropy = at(mid, f"ln(z) - {mid} * s / z") + f" >= {mix.entropy} * ln((SELECT count(*) FROM shares))"
    repeats = at(mid, "high / low") + f" > {mix.repeats}"
    return f"""
    WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce(source, '') AS src,
        CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM documents),
    totals AS (SELECT src, sum(n_tokens) AS n FROM docs GROUP BY src),
    shares AS (SELECT src, n, n / (SELECT sum(n) FROM totals)::DOUBLE AS p FROM totals WHERE n > 0),
    {bisect("by_entropy", entropy)}, {bisect("by_repeats", repeats)},
    -- As found: the largest exponent with the entropy, raised to the least one within the limit.
    found AS (SELECT greatest(
        CASE WHEN {at("1.0", "ln(z) - s / z")} >= {mix.entropy} * ln((SELECT count(*) FROM shares)) THEN 1.0 ELSE (SELECT lo FROM by_entropy ORDER BY i DESC LIMIT 1) END,
        CASE WHEN {at("0.0", "high / low")} <= {mix.repeats} THEN 0.0 ELSE (SELECT hi FROM by_repeats ORDER BY i DESC LIMIT 1) END) AS a),
    weights AS (SELECT src, n, exp(a * ln(p)) / p AS ratio FROM shares, found),
    plan AS (SELECT src, n, round(ratio / (SELECT min(ratio) FROM weights), 6) AS epochs FROM weights),
    cut AS (SELECT src, CAST(floor(epochs) AS INT) AS whole, CAST(floor((epochs - floor(epochs)) * n) AS BIGINT) AS rest FROM plan
            UNION ALL SELECT src, 1, 0 FROM totals WHERE n = 0),
    drawn AS (SELECT doc_id, source, src, n_tokens, whole, rest, sum(n_tokens) OVER (PARTITION BY src ORDER BY {key("whole")}) AS upto FROM docs JOIN cut USING (src)),
    rows_ AS (SELECT doc_id, source, src, n_tokens, unnest(range(0, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)) AS block FROM drawn)
    SELECT doc_id, source, CAST(block AS INT) AS block, {key("block")} AS place, n_tokens FROM rows_"""
