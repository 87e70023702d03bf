"""Line-first cleaning: per-line rules, then a document verdict from what they removed.

Each line is judged alone (symbols, shouting, repetition, navigation,
punctuation, boilerplate). Failing lines are removed; a document that loses
more than ``max_loss`` percent of its characters (blanks not counted) is
rejected, as is one that fails the base rules (too few words, or too many words
inside repeated five-word windows).

One projection per step, no shuffle and no Python: a document never leaves its
row. Windows are compared by a 64-bit hash of their words' 64-bit hashes. Words are split once, line by line, and
characters are counted in what remains of a line without blanks and a-z, which is short.

Defined results: null text counts as empty; texts without words have zero
counts, fail the base rules and are rejected. Very long texts are judged whole, in one row. Ties and repeated rows are
judged alike; an empty table gives an empty result. ``judge_lines`` sets the columns named in its docstring and
keeps all others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import LOWER, table, words_of

WINDOW = 5

# Fixed values of the boilerplate rule: phrases of page furniture, lower case.
BOILERPLATE = (
    r"(cookie|privacy) policy|terms of (use|service)|(enable|requires) javascript|accept (all )?cookies|"
    r"skip to (main )?content|back to top|click here to|sign (in|up) to|subscribe to (our|the) newsletter|lorem ipsum"
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds; percentages are of the line's characters, letters or words."""

    max_symbol_pct: int = 5
    max_upper_pct: int = 50
    min_shout_letters: int = 20
    min_repeat_words: int = 8
    max_repeat_factor: int = 3
    min_separators: int = 3
    min_unpunctuated_words: int = 25
    max_boilerplate_words: int = 20
    max_loss_pct: int = 50
    min_words: int = 10
    max_window_pct: int = 20
    #: Lines of fewer symbols aren't noise.
    min_symbols: int = 3


#: Sentence marks: punctuation of any script (danda, Arabic and Urdu signs, ...) but signs that end or part no sentence.
MARKS = r"""[\p{Po}&&[^#%&*@/\\'"•·]]"""
#: No symbols: heading, list and quote marks at the begin of a line, and the signs of single amounts.
PLAIN = r"^\s*(?:(?:#{1,6}|[*>])\s+)+|\$(?=\d)|(?<=\d)\s?%"
#: The rules of the query and of the pipeline.
PRODUCTION = LineRules()


def _count(c: Column, drop: str) -> Column:
    """Characters of ``c`` outside the class ``drop``."""
    return F.char_length(F.regexp_replace(c, drop + "+", ""))


def line_facts(line: Column, words: Column, rest: Column) -> Column:
    """What the rules look at, each computed once; ``rest`` is the line without blanks and a-z."""
    small = F.char_length(F.array_join(words, "")) - F.char_length(rest)
    return F.struct(
        line.alias("t"),
        words.alias("w"),
        (small + F.char_length(rest)).alias("chars"),
        (small + _count(rest, r"[^\p{L}]")).alias("letters"),
        _count(rest, r"[^\p{Lu}]").alias("upper"),
        _count(rest, r"[^\p{N}]").alias("digits"),
        _count(rest, r"[^#*$%&|<>]").alias("symbols"),
        _count(rest, "[^|»›•·]").alias("separators"),
    )


def line_fails(x: Column, rules: LineRules = PRODUCTION) -> Column:
    """Whether a line of these facts is removed; blank lines never fail."""
    n_words = F.size(x["w"])
    noisy = lambda n: (n >= rules.min_symbols) & (n * 100 > x["chars"] * rules.max_symbol_pct)
    # Leaving plain marks out can only make a line less noisy, so only lines that are noisy with them are looked at.
    symbol_noise = noisy(x["symbols"]) & noisy(_count(F.regexp_replace(x["t"], PLAIN, ""), r"[^#*$%&|<>]"))
    shouting = (x["letters"] >= rules.min_shout_letters) & (x["upper"] * 100 > x["letters"] * rules.max_upper_pct)
    # Vocabulary grows about as the root of the length, so long lines of prose pass.
    distinct = F.size(F.array_distinct(x["w"])).cast("long")
    repetition = (
        (n_words >= rules.min_repeat_words) & (distinct * rules.max_repeat_factor < n_words) & (distinct * distinct < 4 * n_words)
    )
    navigation = (x["separators"] >= rules.min_separators) & (x["separators"] * 4 >= n_words)
    unpunctuated = (n_words >= rules.min_unpunctuated_words) & ~x["t"].rlike(MARKS)
    boilerplate = (n_words <= rules.max_boilerplate_words) & F.lower(x["t"]).rlike(BOILERPLATE)
    no_text = x["letters"] + x["digits"] == 0
    return (x["chars"] > 0) & (
        symbol_noise | shouting | navigation | no_text | repetition | boilerplate | unpunctuated
    )


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside five-word windows found twice or more."""
    window = F.transform(
        F.when(F.size("__w") >= WINDOW, F.sequence(F.lit(0), F.size("__w") - WINDOW)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.xxhash64(*(F.get("__wh", i + k) for k in range(WINDOW))),
    )
    df = df.withColumn("__wh", F.transform("__w", lambda w: F.xxhash64(w))).withColumn("__g", window)
    has = F.size(F.array_distinct("__g")) < F.size("__g")
    ordered = F.when(has, F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    df = df.withColumn("__o", ordered)
    twin = lambda e, k: (F.get("__o", k - 1)["g"] == e["g"]) | (F.get("__o", k + 1)["g"] == e["g"])
    starts = F.sort_array(F.transform(F.filter("__o", lambda e, k: F.coalesce(twin(e, k), F.lit(False))), lambda e: e["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct(
            (p + WINDOW).alias("end"), (a["n"] + (p + WINDOW - F.greatest(a["end"], p))).cast("long").alias("n")
        ),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def judge_lines(docs: DataFrame, text_col: str = "text", rules: LineRules = PRODUCTION) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed,
    chars_removed, clean_text, base_failed and kept."""
    df = docs.withColumn("__l", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    df = df.withColumn("__lw", F.transform("__l", words_of))
    df = _with_repeats(df.withColumn("__w", F.flatten("__lw")))
    rests = F.transform("__lw", lambda w: F.translate(F.array_join(w, ""), LOWER, ""))
    parts = F.arrays_zip(F.col("__l").alias("l"), F.col("__lw").alias("w"), rests.alias("r"))
    df = df.withColumn("__f", F.transform(parts, lambda x: line_facts(x["l"], x["w"], x["r"])))
    df = df.withColumn("__v", F.transform(F.filter("__f", lambda x: x["chars"] > 0), lambda x: x["t"]))
    judged = F.transform(
        "__f", lambda x: F.struct(x["t"].alias("t"), x["chars"].alias("chars"), line_fails(x, rules).alias("bad"))
    )
    df = df.withColumn("__j", judged)
    total = lambda xs, name="chars": F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x[name])
    removed = F.filter("__j", lambda x: x["bad"])
    df = df.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": total(F.col("__f")),
            "n_symbols": total(F.col("__f"), "symbols"),
            "n_dup_lines": (F.size("__v") - F.size(F.array_distinct("__v"))).cast("long"),
            "n_lines_removed": F.size(removed).cast("long"),
            "chars_removed": total(removed),
            "clean_text": F.array_join(
                F.transform(F.filter("__j", lambda x: ~x["bad"]), lambda x: x["t"]), "\n"
            ),
        }
    )
    failed = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_window_pct
    )
    lost = F.col("chars_removed") * 100 > F.col("word_chars") * rules.max_loss_pct
    df = df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~lost)
    return df.drop("__w", "__l", "__lw", "__wh", "__g", "__o", "__f", "__j", "__v")


RESULT = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
]


def op8_line_rules(spark, sf_dir):
    return judge_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*RESULT)


def _oracle_parts() -> str:
    r = PRODUCTION
    space = r"[\x20\x09-\x0D]"
    symbols = r"[^#*$%&|<>]"
    # Without look-around and class intersection, step by step.
    unled = rf"regexp_replace(t, '^{space}*(?:(?:#{{1,6}}|[*>]){space}+)+', '')"
    plain = rf"regexp_replace(regexp_replace({unled}, '\$(\d)', '\1', 'g'), '(\d){space}?%', '\1', 'g')"
    marks = r"""regexp_matches(regexp_replace(t, '[#%&*@/\\''"•·]', '', 'g'), '\p{Po}')"""
    cnt = lambda keep: f"length(regexp_replace(t, '{keep}', '', 'g'))"
    words = f"list_filter(regexp_split_to_array(t, '{space}+'), lambda w: w <> '')"
    return f"""
    d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT doc_id, u.t AS t, u.i AS i FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {{'t': x, 'i': i}})) AS u FROM d)),
    stats AS (SELECT doc_id, i, t, {words} AS w, {cnt(space)} AS chars, {cnt(r"[^\p{L}]")} AS letters,
                     {cnt(r"[^\p{Lu}]")} AS upper_, {cnt(symbols)} AS symbols,
                     length(regexp_replace({plain}, '{symbols}', '', 'g')) AS noise, {cnt("[^|»›•·]")} AS seps,
                     {cnt(r"[^\p{N}]")} AS digits FROM lines),
    judged AS (SELECT doc_id, i, t, chars, len(w) > 0 AS worded, chars > 0 AND (
        (noise >= {r.min_symbols} AND noise * 100 > chars * {r.max_symbol_pct})
        OR (letters >= {r.min_shout_letters} AND upper_ * 100 > letters * {r.max_upper_pct})
        OR (len(w) >= {r.min_repeat_words} AND len(list_distinct(w)) * {r.max_repeat_factor} < len(w)
            AND len(list_distinct(w)) * len(list_distinct(w)) < 4 * len(w))
        OR (seps >= {r.min_separators} AND seps * 4 >= len(w))
        OR (len(w) >= {r.min_unpunctuated_words} AND NOT {marks})
        OR (len(w) <= {r.max_boilerplate_words} AND regexp_matches(lower(t), '{BOILERPLATE}'))
        OR letters + digits = 0) AS bad FROM stats),
    by_line AS (SELECT doc_id, CAST(count(*) FILTER (WHERE worded) - count(DISTINCT t) FILTER (WHERE worded) AS BIGINT) AS n_dup_lines,
                       CAST(sum(chars) AS BIGINT) AS word_chars, coalesce(sum(chars) FILTER (WHERE bad), 0) AS chars_removed,
                       coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS clean_text
                FROM judged GROUP BY doc_id),
    words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{space}+'), lambda w: w <> '') AS w,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
    windows AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM words WHERE len(w) >= {WINDOW}),
    grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS n FROM windows),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
                FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM grams WHERE n >= 2) GROUP BY doc_id),
    facts AS (SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines,
                     CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, chars_removed, clean_text
              FROM words JOIN by_line USING (doc_id) LEFT JOIN covered USING (doc_id)),
    verdicts AS (SELECT *, n_words < {r.min_words} OR n_repeat_words * 100 > n_words * {r.max_window_pct} AS base_failed,
                        chars_removed * 100 > word_chars * {r.max_loss_pct} AS lost FROM facts)"""


ORACLE = f"""WITH {_oracle_parts()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT lost AS kept
FROM verdicts"""
