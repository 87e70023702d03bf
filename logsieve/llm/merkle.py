"""Merkle manifest of a dataset by superblock reduction.

Every row is a leaf: the digest of its fields, each ``-`` if null, else its length in UTF-8 bytes, a
colon and its value. The leaves of a group (``lang``) in the order of their ids are the lowest level of a
tree; every ``fanout`` consecutive nodes become the digest of their digests until one remains, the
group's subroot. The subroots in the order of their groups, nulls first, are reduced likewise to the root.

The reduction. Leaves get their place in their group from a range partitioning: tasks number what
they hold, and the numbers of the tasks before are added, which are few rows. Places are bucketed by
fanout^k; a bucket has at most fanout^k rows whatever the group's size, and ``applyInPandas`` collapses its k
levels into one node. The nodes of all buckets are reduced in the same way, until each tree has one
node. A leaf's proof is the lower one, of its bucket, followed by the upper one, of the bucket's node; the
upper ones are made from the top downwards, one a bucket, and meet the leaves when these are
collapsed again, so that proofs of leaves never leave their task but as digests, or as texts if asked for.

Defined results: null and empty values differ (``-`` and ``0:``). Rows of one id stand in the order of their digests and rows
that repeat in every field have places of their own; null ids stand first. The null group stands before the empty one. Very long
texts are digested whole. A group of one row is its own subroot, a table of one group has that subroot as its root. Extra columns
aren't part of a leaf, whatever their names, unless ``fields`` names them. An empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import importable
from .runtime import LOWER, UPPER, ascii_lower, durable, shuffle_partitions, table, tidy


@dataclass(frozen=True)
class Manifest:
    """Parameters: fields of a leaf, grouping field, id, children of a node, levels that a bucket collapses."""

    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")
    group: str = "lang"
    id_col: str = "doc_id"
    fanout: int = 8
    levels: int = 3

    def __post_init__(self):
        if self.fanout < 2 or self.levels < 1:
            raise ValueError("fanout must be at least 2 and levels at least 1")


def leaf_digest(values: list[Column]) -> Column:
    """Lowercase hexadecimal SHA-256 of the fields' lengths and values."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def leaves(docs: DataFrame, config: Manifest = Manifest(), changed: dict[str, Column] | None = None) -> DataFrame:
    """id, tree (the group's name after ``=``, empty for null), leaf, and with ``changed`` the leaf of the row so changed as ``seen``."""
    own = {f: F.col(f) for f in config.fields}
    tree = F.coalesce(F.concat(F.lit("="), F.col(config.group).cast("string")), F.lit("")).alias("tree")
    seen = leaf_digest([*(own | changed).values()]) if changed else F.lit(None).cast("string")
    return docs.select(F.col(config.id_col).alias("id"), tree, leaf_digest([*own.values()]).alias("leaf"), seen.alias("seen"))


def _height(size: Column, fanout: int) -> Column:
    """Levels above ``size`` nodes, by whole numbers."""
    over = F.transform(F.sequence(F.lit(1), F.lit(62)), lambda i: F.pow(F.lit(float(fanout)), i - 1) < size)
    return F.size(F.filter(over, lambda x: x))


def ranked(rows: DataFrame, order: list[str], fanout: int) -> DataFrame:
    """Adds place (from 0, in ``order``), size and height of each row's tree. Rows must be durable: they are read twice."""
    n = shuffle_partitions(rows.sparkSession)
    kinds = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("near", T.LongType())])
    at = rows.columns.index("tree")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, near = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for tree in batch.column(at).to_pylist():
                near = near + 1 if tree == last else 0
                last = tree
                places.append(near)
            own = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "part", "near"])

    keys = ["tree", *order]
    dealt = durable(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(tidy(number), kinds))
    # A row for each tree and task that holds some of it.
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("part")
    whole = Window.partitionBy("tree")
    counts = counts.select(
        "tree", "part", (F.sum("n").over(before) - F.col("n")).alias("first"), F.sum("n").over(whole).alias("size")
    )
    placed = dealt.join(counts, ["tree", "part"]).withColumn("place", F.col("first") + F.col("near"))
    return placed.withColumn("height", _height(F.col("size"), fanout)).drop("part", "near", "first")


# --- nodes ---------------------------------------------------------------------------------------------------------


def join_digests(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def collapse(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of a bucket, level by level from the lowest; the last level has one."""
    rows = [digests]
    for _ in range(levels):
        low = rows[-1]
        rows.append([join_digests(low[i : i + fanout]) for i in range(0, len(low), fanout)])
    return rows


def siblings(rows: list[list[str]], place: int, fanout: int) -> list[tuple[list[str], list[str]]]:
    """What stands before and after a node in its run, for every level of a bucket but the last."""
    found = []
    for low in rows[:-1]:
        first = place - place % fanout
        found.append((low[first:place], low[place + 1 : first + fanout]))
        place //= fanout
    return found


def proof_text(steps: list[tuple[list[str], list[str]]]) -> str:
    """A proof as text: for each level the digests before and after, ``>`` where the own one stands, ``/`` between levels."""
    return "/".join("".join(a) + ">" + "".join(z) for a, z in steps)


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and a proof lead to."""
    for step in proof.split("/") if proof else ():
        before, _, after = step.partition(">")
        leaf = sha256((before + leaf + after).encode()).hexdigest()
    return leaf


def _buckets(nodes: DataFrame, config: Manifest) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("place") / F.lit(config.fanout**config.levels)).cast("bigint"))


def superblocks(nodes: DataFrame, config: Manifest) -> DataFrame:
    """Nodes (tree, place, height, digest) up to ``levels`` levels higher: one for each bucket."""
    importable(nodes.sparkSession)
    k, fanout = config.levels, config.fanout

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        levels = min(k, int(group["height"].iloc[0]))
        top = collapse(group["digest"].tolist(), levels, fanout)[-1]
        first = group.iloc[0]
        return pd.DataFrame({"tree": [first["tree"]], "place": [first["bucket"]], "height": [int(first["height"]) - levels], "digest": top})

    rows = _buckets(nodes.select("tree", "place", "height", "digest"), config)
    return rows.groupBy("tree", "bucket").applyInPandas(work, "tree string, place bigint, height int, digest string")


def _with_upper(nodes: DataFrame, above: DataFrame, config: Manifest) -> DataFrame:
    """Nodes with the upper proof and root of their bucket's node."""
    upper = above.select("tree", F.col("place").alias("bucket"), F.col("proof").alias("upper"), "root")
    return _buckets(nodes, config).join(upper, ["tree", "bucket"])


def _joined(lower: str, upper: str) -> str:
    return f"{lower}/{upper}" if lower and upper else lower or upper


def proofs(nodes: DataFrame, config: Manifest) -> DataFrame:
    """(tree, place, digest, proof, root) of nodes of which there are few: a leaf's proofs are made by ``prove``."""
    nodes = durable(nodes)
    if not nodes.where("height > 0").take(1):
        return nodes.select("tree", "place", "digest", F.lit("").alias("proof"), F.col("digest").alias("root"))
    above = proofs(superblocks(nodes, config), config)
    k, fanout = config.levels, config.fanout

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place").reset_index(drop=True)
        rows = collapse(group["digest"].tolist(), min(k, int(group["height"].iloc[0])), fanout)
        upper = group["upper"].iloc[0]
        group["proof"] = [_joined(proof_text(siblings(rows, i, fanout)), upper) for i in range(len(group))]
        return group[["tree", "place", "digest", "proof", "root"]]

    grouped = _with_upper(nodes, above, config).groupBy("tree", "bucket")
    return durable(grouped.applyInPandas(work, "tree string, place bigint, digest string, proof string, root string"))


# --- manifest ------------------------------------------------------------------------------------------------------


def subroots(nodes: DataFrame, config: Manifest) -> DataFrame:
    """(tree, digest): each tree's last node."""
    while nodes.where("height > 0").take(1):
        nodes = durable(superblocks(nodes, config))
    return nodes.select("tree", "digest")


def manifest(
    docs: DataFrame, config: Manifest = Manifest(), changed: dict[str, Column] | None = None, texts: bool = False
) -> DataFrame:
    """id_col, tree, place, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    ``changed`` has other expressions for some fields: folded_root is what the row so changed and the original proof
    lead to, else what the row itself leads to. ``texts`` adds the proof itself (see ``proof_text``).
    """
    rows = durable(leaves(docs, config, changed))
    kind = rows.schema["id"].dataType.simpleString()
    placed = durable(ranked(rows, ["id", "leaf"], config.fanout))
    nodes = placed.withColumnRenamed("leaf", "digest")
    first = durable(superblocks(nodes, config))
    subs = durable(subroots(first, config))
    # The trees' subroots are the nodes of one more tree.
    tops = ranked(subs.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"], config.fanout)
    tops = durable(tops)
    top = proofs(tops.drop("name", "size"), config).join(tops.select("place", "name"), "place")
    top = top.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("proof").alias("last"), F.col("root").alias("whole"))
    above = proofs(first, config).drop("root").join(top, "tree")
    last = F.when(F.col("proof") == "", F.col("last")).when(F.col("last") == "", F.col("proof")).otherwise(F.concat_ws("/", "proof", "last"))
    upper = above.select("tree", F.col("place").alias("bucket"), last.alias("upper"), "subroot", F.col("whole").alias("root"))
    # As text: pandas has no whole numbers with nulls.
    joined = _buckets(placed.drop("size").withColumn("id", F.col("id").cast("string")), config).join(upper, ["tree", "bucket"])
    k, fanout = config.levels, config.fanout
    names = ["id", "tree", "place", "leaf", "subroot", "root", "proof_sha256", "folded_root", *(["proof"] if texts else [])]

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place").reset_index(drop=True)
        digests = group["leaf"].tolist()
        rows = collapse(digests, min(k, int(group["height"].iloc[0])), fanout)
        upper = group["upper"].iloc[0]
        steps = [_joined(proof_text(siblings(rows, i, fanout)), upper) for i in range(len(group))]
        seen = group["seen"].where(group["seen"].notna(), group["leaf"])
        group["proof_sha256"] = [sha256(p.replace(">", "").replace("/", "").encode()).hexdigest() for p in steps]
        group["folded_root"] = [fold(leaf, p) for leaf, p in zip(seen, steps, strict=True)]
        if texts:
            group["proof"] = steps
        return group[names]

    schema = "id string, tree string, place bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    found = joined.groupBy("tree", "bucket").applyInPandas(work, schema + (", proof string" if texts else ""))
    found = found.select(F.col("id").cast(kind).alias(config.id_col), *names[1:])
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_superblock_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    rows = manifest(docs, Manifest(), {"text": tampered})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


# --- oracle ----------------------------------------------------------------------------------------------------------


def oracle(fanout: int = 8, levels: int = 8) -> str:
    """DuckDB SQL of the query's rows; trees of at most fanout^levels nodes."""
    field = lambda c: f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(range(8)::BIGINT[], lambda c, _: {bit}, xor(a, x))"
    crc = f"xor(list_reduce([ascii(ch)::BIGINT FOR ch IN string_split(doc_id::VARCHAR, '')], lambda a, x: {byte}, 4294967295::BIGINT), 4294967295)"
    ctes = [
        f"""rows AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf,
            CASE WHEN ({crc}) % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS seen FROM documents)""",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows)",
        "l0 AS (SELECT tree, place, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM placed)",
    ]

    def tree(low: str, level: int) -> None:
        ctes.append(
            f"""{low}{level + 1} AS (SELECT tree, place // {fanout} AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest,
                (any_value(size) + {fanout - 1}) // {fanout} AS size FROM {low}{level} WHERE size > 1 GROUP BY tree, place // {fanout})"""
        )
        ctes.append(
            f"""{low}s{level} AS (SELECT tree, place, coalesce(string_agg(digest, '' ORDER BY place) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                coalesce(string_agg(digest, '' ORDER BY place) OVER (b ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
                FROM {low}{level} WHERE size > 1 WINDOW b AS (PARTITION BY tree, place // {fanout} ORDER BY place))"""
        )

    for i in range(levels):
        tree("l", i)
    last = " UNION ALL ".join(f"SELECT tree, digest FROM l{i} WHERE size = 1" for i in range(levels + 1))
    ctes.append(f"subs AS ({last})")
    ctes.append("t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, digest, count(*) OVER () AS size FROM subs)")
    ctes.append("names AS (SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS top FROM subs)")
    for i in range(levels):
        tree("t", i)
    ctes.append("root AS (" + " UNION ALL ".join(f"SELECT digest AS root FROM t{i} WHERE size = 1" for i in range(levels + 1)) + ")")
    ctes.append("f0 AS (SELECT doc_id, leaf, subroot, tree, place, top, coalesce(seen, leaf) AS folded, '' AS proof FROM placed JOIN names ON tree = name)")
    step = 0
    for low, tree_of, place in (("l", "f.tree", "f.place"), ("t", "''", "f.top")):
        for i in range(levels):
            ctes.append(
                f"""f{step + 1} AS (SELECT doc_id, leaf, subroot, f.tree, f.place, top,
                    CASE WHEN s.place IS NULL THEN folded ELSE sha256(before || folded || after) END AS folded,
                    proof || coalesce(before || after, '') AS proof
                    FROM f{step} f LEFT JOIN {low}s{i} s ON s.tree = {tree_of} AND s.place = {place} // {fanout**i})"""
            )
            step += 1
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM f{step}, root"""


ORACLE = oracle()
