"""URL filter: a weighted term vocabulary searched by Aho-Corasick, plus host/path rules.

Every URL is scanned once and whole, in whatever form it is, with its query and
fragment, whatever the size of the vocabulary. A term counts
only between boundaries (the neighbours are no ASCII letters or digits). A URL
is blocked by one strict term, or by ``min_soft`` distinct soft terms whose weights add up to ``min_weight``. List
rules (host and path prefix) come first: the longest fitting rule decides.

The vocabulary is given as arguments, or read from a table (``read_vocabulary``, at most ``MAX_TERMS`` terms).
Map-only: no shuffle; the vocabulary is broadcast and each worker builds its automaton once.

Defined results: null URLs match nothing and are allowed; URLs without ``://`` have an empty host and
path and match no rule, but their text is scanned. Very long URLs are scanned whole. Of equally long
rules the last in text order counts. Repeated rows are judged
alike; an empty table gives an empty result; other columns are untouched by ``judge_urls`` (``host``, ``path``,
``rule``, ``verdict``, ``strict_hits``, ``soft_hits``, ``weight`` are set and
replace columns of those names).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import importable
from .runtime import LOWER, UPPER

# Fixed values of this filter: terms that block alone.
STRICT_TERMS = (
    "casino", "porn", "pornhub", "xxx", "viagra", "cialis", "escorts", "hentai", "camgirls", "jackpot", "warez",
    "sportsbook",
)
# Fixed values of this filter: terms that block in company, with their weights. Words that are common in clean URLs weigh least:
# two of them don't block, three do, and so does one with a heavy one.
SOFT_TERMS = {
    "ad": 0.5, "ads": 0.5, "adult": 1.0, "affiliate": 0.5, "bet": 1.0, "bets": 1.0, "bonus": 0.5, "cams": 0.5,
    "cheap": 0.5, "click": 0.4, "farm": 0.4, "free": 0.4, "gambling": 1.0, "link": 0.4, "loan": 0.5, "loans": 0.5,
    "nude": 1.0, "payday": 1.0, "pharmacy": 0.5, "pill": 1.0, "pills": 1.0, "poker": 1.0, "prize": 0.5, "sex": 1.0,
    "slots": 1.0, "spam": 1.0, "torrent": 0.5, "track": 0.4, "tracker": 0.4, "win": 0.4, "x": 0.4,
}
#: Terms that a vocabulary read from a table may have: what the driver collects and broadcasts.
MAX_TERMS = 2_000_000


@dataclass(frozen=True)
class HostRule:
    """``action`` for ``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Fixed values of the contract of op2.
DEFAULT_RULES = (
    HostRule("block", "com", "/en/"),
    HostRule("allow", "example.com", "/en/7"),
    HostRule("allow", "net", "/de/"),
    HostRule("block", "example.net", "/de/8"),
    HostRule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """(rule text, action) of the longest fitting rule, null if none fits."""
    text = action = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, rule.text).otherwise(text)
        action = F.when(fits, rule.action).otherwise(action)
    return text, action


def read_vocabulary(spark: SparkSession, path: str) -> tuple[tuple[str, ...], dict[str, float]]:
    """(strict terms, soft terms with weights) of a Parquet table (term, weight); a null weight marks a strict term.

    Terms are lower-cased; null and empty ones are left out, repeated ones keep their largest weight, strict above all.
    """
    term = F.translate("term", UPPER, LOWER)
    terms = spark.read.parquet(path).select(term.alias("term"), F.col("weight").cast("double").alias("weight")).where("term <> ''")
    terms = terms.groupBy("term").agg(F.max("weight").alias("weight"), F.bool_or(F.col("weight").isNull()).alias("strict"))
    rows = terms.limit(MAX_TERMS + 1).toPandas()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the vocabulary has over {MAX_TERMS} terms")
    soft = rows[~rows["strict"]]
    return tuple(rows["term"][rows["strict"]]), dict(zip(soft["term"], soft["weight"], strict=True))


def build_automaton(strict: Sequence[str], soft: Mapping[str, float]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, weight in soft.items():
        automaton.add_word(term, (term, False, weight))
    for term in strict:
        automaton.add_word(term, (term, True, 0.0))
    automaton.make_automaton()
    return automaton


def count_terms(automaton, text: str) -> tuple[int, int, float]:
    """(strict hits, distinct soft terms, weight of the distinct soft terms)."""
    if not len(automaton):
        return 0, 0, 0.0
    strict, soft, last = 0, {}, len(text) - 1
    for end, (term, is_strict, weight) in automaton.iter(text):
        start = end - len(term)
        if start >= 0 and text[start].isascii() and text[start].isalnum():
            continue
        if end < last and text[end + 1].isascii() and text[end + 1].isalnum():
            continue
        if is_strict:
            strict += 1
        else:
            soft[term] = weight
    return strict, len(soft), float(sum(soft.values()))


#: The automaton that this worker built last, by the vocabulary's key.
_BUILT: dict[str, object] = {}


def term_counter(spark: SparkSession, strict: Sequence[str], soft: Mapping[str, float]):
    vocabulary, key = spark.sparkContext.broadcast((tuple(strict), dict(soft))), uuid.uuid4().hex

    @F.pandas_udf("strict long, soft long, weight double")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = build_automaton(*vocabulary.value)
        for texts in batches:
            yield pd.DataFrame([count_terms(_BUILT[key], t) for t in texts], columns=["strict", "soft", "weight"])

    return count


def judge_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules: Sequence[HostRule] = DEFAULT_RULES,
    strict: Sequence[str] = STRICT_TERMS,
    soft: dict[str, float] | None = None,
    min_soft: int = 2,
    min_weight: float = 1.0,
) -> DataFrame:
    """Adds host, path, rule, strict_hits, soft_hits, weight and verdict (allow or block)."""
    importable(pages.sparkSession)
    host, path = host_and_path(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path})
    text, action = longest_rule(F.col("host"), F.col("path"), rules)
    scanned = F.translate(F.coalesce(F.col(url_col), F.lit("")), UPPER, LOWER)
    hits = "__hits"
    out = out.withColumn(hits, term_counter(pages.sparkSession, strict, SOFT_TERMS if soft is None else soft)(scanned))
    several = (F.col(f"{hits}.soft") >= min_soft) & (F.col(f"{hits}.weight") >= min_weight)
    by_terms = F.when((F.col(f"{hits}.strict") > 0) | several, "block").otherwise("allow")
    return out.withColumns(
        {
            "rule": text,
            "strict_hits": F.col(f"{hits}.strict"),
            "soft_hits": F.col(f"{hits}.soft"),
            "weight": F.col(f"{hits}.weight"),
            "verdict": F.coalesce(action, by_terms),
        }
    ).drop(hits)


#: Fixed values of the SQL form, written out so that an error in the filter's own can't hide on both sides.
_SQL_TERMS = """
    ('casino', NULL), ('porn', NULL), ('pornhub', NULL), ('xxx', NULL), ('viagra', NULL), ('cialis', NULL), ('escorts', NULL), ('hentai', NULL),
    ('camgirls', NULL), ('jackpot', NULL), ('warez', NULL), ('sportsbook', NULL),
    ('ad', 5), ('ads', 5), ('adult', 10), ('affiliate', 5), ('bet', 10), ('bets', 10), ('bonus', 5), ('cams', 5), ('cheap', 5), ('click', 4),
    ('farm', 4), ('free', 4), ('gambling', 10), ('link', 4), ('loan', 5), ('loans', 5), ('nude', 10), ('payday', 10), ('pharmacy', 5), ('pill', 10),
    ('pills', 10), ('poker', 10), ('prize', 5), ('sex', 10), ('slots', 10), ('spam', 10), ('torrent', 5), ('track', 4), ('tracker', 4), ('win', 4),
    ('x', 4)"""

#: DuckDB SQL of the query's rows: a term counts as a whole word of the URL; weights are tenths. No term holds a word border.
ORACLE = f"""
WITH terms(term, weight) AS (VALUES {_SQL_TERMS}),
a AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT row_number() OVER () AS n, page_id, translate(url, '{UPPER}', '{LOWER}') AS s, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM a),
words AS (SELECT DISTINCT n, unnest(regexp_split_to_array(s, '[^a-z0-9]+')) AS term FROM b),
hits AS (SELECT n, bool_or(weight IS NULL) AS strict, count(weight) AS soft, sum(weight) AS weight FROM words JOIN terms USING (term) GROUP BY n)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
       WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
       WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
       WHEN strict OR (soft >= 2 AND weight >= 10) THEN 'block' ELSE 'allow' END AS verdict
FROM b LEFT JOIN hits USING (n)"""
