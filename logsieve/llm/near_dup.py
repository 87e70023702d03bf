"""Near duplicates by a chosen-path set similarity join.

Every document becomes its set of word shingles. Documents with equal sets are
one class (a map-side combined aggregation), so copies cost nothing further.
Each of ``trees`` independent trees branches the classes recursively by their
minwise shingle under the level's hash; a node that has become small is compared
exhaustively on minwise sketches, and candidate pairs are confirmed on the full
sets. Trees repeat until a link at the threshold meets in some node with the
target recall (``recall`` gives the formula).

Where work is done. Nodes that could fill a task alone (counted exactly; at most
``4 * partitions`` of them) take further levels as Spark jobs, all others finish
their recursion inside the task that holds them. A node still hot at the last
level is dealt over tasks by a salt, different in each tree, into parts of about ``hot_rows``. A node that is
large at the last level first compares its documents with its most typical ones and
in blocks of ``leaf``. When the links so found are united, what such nodes still hold
in different components is joined exactly (``rest_links``): their shingles are counted, and
a pair either shares a rare shingle, by which it is found, or could link on frequent ones
alone; only documents for which those suffice meet in pairs of blocks, where the
sizes of all intersections are one matrix product. Neither way ranks or cuts.

Confirmation of the candidates runs in two rounds: each document's best one, then all
others but the pairs whose ends are already connected, which cannot change a
component (of those in large nodes only the best of each component). Every candidate of small nodes between
components is confirmed on full sets before it is dropped. Texts travel only if a round needs them, once for each ``HUB`` edges of a document.

Defined results: null and empty texts have an empty set, link with nothing and
stay. Texts of fewer than ``k`` words are one shingle; very long texts are read whole, one after another. Of
equally likely partners the one with the smaller id is tried first. Repeated rows get the
same component; rows without an id stay or follow an equal set. Ids identify texts: a row that repeats an id adds its text to
that id. An empty table gives an empty result. Columns beyond id and text are
kept by ``drop_near_copies`` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import importable
from .runtime import durable, shuffle_partitions, table, tidy
from .shingles import minwise, minwise_keys, overlap, sets_of


#: Edges that one task unites.
EDGES_PER_TASK = 500_000
#: Rows at most of the table that says which texts a round needs.
BUCKETS = 1 << 20
#: Edges of one document that meet one copy of its text.
HUB = 500


@dataclass(frozen=True)
class Join:
    """Parameters of the join; ``percent`` is the least Jaccard similarity in per cent."""

    k: int = 5
    percent: int = 80
    #: Independent trees; unless given, as many as ``target`` needs at the deepest level, ten at least.
    trees: int | None = None
    target: float = 0.99
    depth: int = 6
    leaf: int = 24
    sketch: int = 128
    #: Standard deviations of the sketch by which a candidate may fall short.
    slack: float = 3.5
    hot_rows: int = 2000
    #: Rows and shingles of one block of a node that is large at the last level.
    block: int = 500
    block_shingles: int = 500_000
    #: Shingles of so many documents at most, among those of large nodes, are rare.
    rare: int = 32

    def __post_init__(self):
        if self.trees is None:
            apart = 1 - (self.percent / 100) ** self.depth
            needed = np.ceil(np.log(1 - self.target) / np.log(apart)) if apart > 0 else 1
            object.__setattr__(self, "trees", max(10, int(needed)))

    def recall(self, level: int) -> float:
        """Chance that a pair at the threshold meets in some tree, if nodes branch to ``level``.

        Nodes that are large or hot at the last level lose no pair (``rest_links``), so this
        holds for them at ``depth``. The sketch refuses a pair at the threshold with a chance of
        about 2e-4 (``slack``).
        """
        return 1 - (1 - (self.percent / 100) ** level) ** self.trees

    def _matches(self, deviations: float) -> float:
        """Equal sketch values of a pair at the threshold, so many standard deviations off the mean."""
        p = self.percent / 100
        seen = p + (1 - p) / 256  # one byte of each value is kept
        return self.sketch * seen + deviations * np.sqrt(self.sketch * p * (1 - p))

    @property
    def least_matches(self) -> int:
        return int(np.floor(self._matches(-self.slack)))


def sketch_documents(docs: DataFrame, join: Join, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, sig (of the set), paths (trees x depth values) and sketch (one byte a value)."""
    schema = "id bigint, n_shingles bigint, sig binary, paths binary, sketch binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = join.trees * join.depth
        keys = minwise_keys(max(join.sketch, used))
        for batch in batches:
            sizes, sigs, paths, sketches = [], [], [], []
            for shingles in sets_of(batch.column(1), join.k):
                sizes.append(len(shingles))
                if len(shingles):
                    low = minwise(shingles, keys)
                    sigs.append(blake2b(shingles.tobytes(), digest_size=16).digest())
                    paths.append((low[:used] >> np.uint64(32)).astype("<u4").tobytes())
                    sketches.append(((low[: join.sketch] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes())
                else:
                    sigs.append(None), paths.append(None), sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sigs, pa.binary()),
                    pa.array(paths, pa.binary()),
                    pa.array(sketches, pa.binary()),
                ],
                names=["id", "n_shingles", "sig", "paths", "sketch"],
            )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy(work), schema)


def _branches(classes: DataFrame, join: Join) -> DataFrame:
    """A row for each class and tree at the first level of the tree."""
    width = 4 * join.depth
    rows = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(join.trees - 1))))
    path = F.expr(f"substring(paths, tree * {width} + 1, {width})")
    rows = rows.select("id", "n_shingles", "tree", path.alias("path"), "sketch", F.lit(1).alias("level"))
    return rows.withColumn("node", _node(F.col("tree").cast("long"), 0))


def _node(above, level: int):
    return F.xxhash64(above, F.expr(f"substring(path, {4 * level + 1}, 4)"))


def _spread_hot(rows: DataFrame, join: Join, partitions: int) -> DataFrame:
    """Sends rows of hot nodes down the tree until no node can fill a task."""
    done = None
    for level in range(1, join.depth + 1):
        counts = durable(rows.groupBy("node").count().where(F.col("count") >= join.hot_rows))
        total = rows.count() if counts.take(1) else 0
        least = max(join.hot_rows, total // (4 * partitions))
        hot = counts.where(F.col("count") >= least).orderBy(F.desc("count")).limit(4 * partitions).collect()
        if not hot:
            break
        names = [r["node"] for r in hot]
        cool, rest = rows.where(~F.col("node").isin(names)), rows.where(F.col("node").isin(names))
        done = cool if done is None else done.unionByName(cool)
        if level < join.depth:
            rows = durable(rest.withColumns({"node": _node(F.col("node"), level), "level": F.lit(level + 1)}))
        else:
            # Parts of a node meet again in rest_links.
            salts = F.greatest(F.lit(2), F.ceil(F.col("count") / join.hot_rows))
            rest = rest.join(F.broadcast(counts.where(F.col("node").isin(names))), "node")
            salt = F.pmod(F.xxhash64("id", "tree"), salts)
            rest = rest.withColumns({"node": F.xxhash64("node", salt), "level": F.lit(join.depth + 1)})
            rows = rest.drop("count")
    return rows if done is None else done.unionByName(rows)


def _pairs_in(rows: np.ndarray, columns: dict, join: Join, level: int, out: list, hints: list, large: list) -> None:
    """Candidate pairs of one node, by further branching while it is large.

    ``large`` gets the nodes left large, which rest_links joins; ``hints`` a likely partner of each document in them.
    """
    stack = [(rows, level)]
    while stack:
        at, deep = stack.pop()
        if len(at) < 2 and deep <= join.depth:
            continue
        if len(at) <= join.leaf and deep <= join.depth:
            _compare(at, at, columns, join, out)
        elif deep < join.depth:
            value = columns["path"][at, deep]
            order = np.argsort(value, kind="stable")
            cuts = np.flatnonzero(np.diff(value[order])) + 1
            stack += [(part, deep + 1) for part in np.split(at[order], cuts) if len(part) > 1]
        else:
            large.append(at)
            likely: list = []
            _compare(_typical(at, columns["sketch"]), at, columns, join, likely)
            for i in range(0, len(at), join.leaf):
                _compare(at[i : i + join.leaf], at[i : i + join.leaf], columns, join, likely)
            best: dict[int, tuple] = {}
            for pair in sorted(set(likely)):
                for x in pair[:2]:
                    if x not in best or pair[2] > best[x][2]:
                        best[x] = pair
            hints += best.values()


def _typical(at: np.ndarray, sketch: np.ndarray, n: int = 3) -> np.ndarray:
    """The documents whose sketches agree best with the node's most frequent values."""
    s = sketch[at]
    score = np.zeros(len(at), np.int64)
    for j in range(s.shape[1]):
        counts = np.bincount(s[:, j], minlength=256)
        score += s[:, j] == counts.argmax()
    return at[np.argsort(-score, kind="stable")[:n]]


def _compare(a: np.ndarray, b: np.ndarray, columns: dict, join: Join, out: list) -> None:
    ids, size, sketch = columns["id"], columns["size"], columns["sketch"]
    for i in a:
        match = (sketch[b] == sketch[i]).sum(axis=1)
        low, high = np.minimum(size[b], size[i]), np.maximum(size[b], size[i])
        good = (match >= join.least_matches) & (low * 100 >= high * join.percent) & (ids[b] != ids[i])
        for j in b[good]:
            u, v = ids[i], ids[j]
            out.append((min(u, v), max(u, v), int((sketch[j] == sketch[i]).sum())))


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut only where ``key`` changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # Keep the last node's rows until the node has ended.
        node = batch.column(batch.schema.get_field_index(key)).to_numpy()
        if held and held[-1].column(key)[-1].as_py() == node[0] == node[-1]:
            held.append(batch)
            continue
        tail = int(np.searchsorted(node, node[-1], side="left"))
        yield pa.Table.from_batches([*held, batch.slice(0, tail)]).combine_chunks()
        held = [batch.slice(tail)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _fixed(t: pa.Table, name: str, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(t[name].to_pylist()), kind).reshape(t.num_rows, width)


def _found(pairs: list, hints: list, large: list, columns: dict) -> pa.RecordBatch:
    """Rows (u, v, score) of pairs, with ``tree`` -1 of hints, and (u, tree, node) of documents in nodes left large."""
    pairs = sorted(set(pairs)) + [(*p, -1, None) for p in sorted(set(hints))]
    for at in large:
        tree, path = int(columns["tree"][at[0]]), columns["path"][at[0]].tobytes()
        node = int.from_bytes(blake2b(path, digest_size=8, salt=tree.to_bytes(4, "little")).digest(), "little", signed=True)
        pairs += [(int(i), None, None, tree, node) for i in columns["id"][at]]
    kinds = {"u": pa.int64(), "v": pa.int64(), "score": pa.int32(), "tree": pa.int32(), "node": pa.int64()}
    rows = [(*p, None, None) if len(p) == 3 else p for p in pairs]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def candidate_pairs(classes: DataFrame, join: Join) -> DataFrame:
    """(u, v, score) with u < v: classes that met in a small node with similar sketches; the same with ``tree`` -1:
    likely partners in a large node; (u, tree, node): class u is in a node that is large at the last level of a tree."""
    n = shuffle_partitions(classes.sparkSession)
    rows = _spread_hot(_branches(classes, join), join, n)
    rows = rows.repartition(n, "node").sortWithinPartitions("node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, "node"):
            columns = {
                "id": t["id"].to_numpy(),
                "size": t["n_shingles"].to_numpy(),
                "tree": t["tree"].to_numpy(),
                "path": _fixed(t, "path", "<u4", join.depth),
                "sketch": _fixed(t, "sketch", np.uint8, join.sketch),
            }
            node, level = t["node"].to_numpy(), t["level"].to_numpy()
            found: list = []
            hints: list = []
            large: list = []
            for part in np.split(np.arange(t.num_rows), np.flatnonzero(np.diff(node)) + 1):
                _pairs_in(part, columns, join, int(level[part[0]]), found, hints, large)
            yield _found(found, hints, large, columns)

    pairs = rows.mapInArrow(tidy(work), "u bigint, v bigint, score int, tree int, node bigint")
    return pairs.groupBy("u", "v", "tree", "node").agg(F.max("score").alias("score"))


def shingle_rows(texts: DataFrame, join: Join) -> DataFrame:
    """(id, shingle) of (id, text): a row for each shingle of the set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, shingles in enumerate(sets_of(batch.column(1), join.k)):
                ids = pa.array(np.full(len(shingles), batch.column(0)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(shingles.view(np.int64))], names=["id", "shingle"])

    return texts.select("id", "text").mapInArrow(tidy(work), "id bigint, shingle bigint")


def rest_links(classes: DataFrame, texts: DataFrame, labels: DataFrame, large: DataFrame, join: Join) -> DataFrame | None:
    """(u, v) with u < v: links between components inside the nodes of ``large`` (id, tree, node), if any node holds two.

    With sets of s and t shingles a link needs an intersection of percent * (s + t) / (100 + percent)
    shingles. Shingles of over ``rare`` held documents are frequent, c of a document's. If min(c, c')
    is less than that, the rest must be rare shingles in common, so the pair meets at one of the rarest shingles of both
    (a prefix filter), in lists of at most ``rare`` documents. All other pairs are of documents whose frequent shingles could
    suffice (``dense``). These meet in pairs of blocks, every one outside the node's largest component with all.
    """
    n = shuffle_partitions(classes.sparkSession)
    least = lambda s, t: F.ceil(join.percent * (s + t) / (100 + join.percent))
    marks = large.join(labels.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "tree", "node")
    mixed = marks.groupBy("node").agg(F.min("label").alias("a"), F.max("label").alias("z")).where(F.col("a") != F.col("z"))
    marks = durable(marks.join(mixed.select("node"), "node"))
    if not marks.take(1):
        return None
    held = durable(marks.groupBy("id").agg(F.first("label").alias("label")))
    needed = durable(_within_buckets(texts, held, ["id"]).join(held.select("id"), "id", "left_semi").distinct())
    rows = shingle_rows(needed, join)
    often = rows.groupBy("shingle").count().where(F.col("count") > 1)
    counted = rows.join(often, "shingle").groupBy("id").agg(
        F.count_if(F.col("count") > join.rare).alias("c"),
        F.count_if(F.col("count") <= join.rare).alias("r"),
        F.collect_list(F.when(F.col("count") <= join.rare, F.struct("count", "shingle"))).alias("rare"),
    )
    # One row for each held document, no longer than its own set.
    facts = counted.join(classes.select("id", F.col("n_shingles").alias("s")), "id").join(held, "id")
    wanted = F.greatest(F.lit(1), least(F.col("s"), F.ceil(F.col("s") * join.percent / 100)) - F.col("c"))
    # Shingles of one document only are the rarest of all.
    prefix = F.col("r") - wanted + 1
    facts = durable(
        facts.select("id", "label", "s", "c", F.slice(F.array_sort("rare"), F.lit(1), F.greatest(F.lit(0), prefix).cast("int")).alias("rare"))
    )
    lists = facts.select(F.explode("rare").alias("x"), F.struct("id", "label", "s", "c").alias("d"))
    lists = lists.groupBy("x.shingle").agg(F.array_sort(F.collect_list("d")).alias("ds")).where(F.size("ds") > 1)
    fits = lambda a, b: (a["label"] != b["label"]) & (F.least(a["s"], b["s"]) * 100 >= F.greatest(a["s"], b["s"]) * join.percent)
    met = F.flatten(
        F.transform("ds", lambda a: F.transform(F.filter("ds", lambda b: (b["id"] > a["id"]) & fits(a, b)), lambda b: F.struct(a["id"].alias("u"), b["id"].alias("v"))))
    )
    by_rare = durable(lists.select(F.explode(met).alias("p")).select("p.u", "p.v").distinct())
    links = confirm(by_rare, needed, join).where("linked").select("u", "v")
    dense = _dense_cells(marks, facts, join, least)
    if dense.take(1):
        links = links.unionByName(_dense_links(dense, needed, n, join))
    return links


def _dense_cells(marks: DataFrame, facts: DataFrame, join: Join, least) -> DataFrame:
    """(id, label, s, c, cell, block): each document whose frequent shingles could suffice, in every cell of its block."""
    rows = marks.select("id", "node").join(facts.drop("rare"), "id")
    shortest = rows.groupBy("node").agg(F.min("s").alias("shortest"))
    rows = rows.join(shortest, "node")
    other = F.greatest(F.col("shortest"), F.ceil(F.col("s") * join.percent / 100))
    rows = durable(rows.where(least(F.col("s"), other) <= F.col("c")).drop("shortest"))
    parts = rows.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("w"))
    nodes = parts.groupBy("node").agg(
        F.sum("n").alias("n"), F.sum("w").alias("w"), F.max("n").alias("n_most"), F.max_by(F.struct("label", "w"), F.struct("n", "label")).alias("most")
    ).where(F.col("n_most") < F.col("n"))
    blocks = lambda n, w: F.greatest(F.ceil(n / join.block), F.ceil(w / join.block_shingles)).cast("int")
    nodes = nodes.select(
        "node",
        F.col("most.label").alias("most"),
        blocks(F.col("n_most"), F.col("most.w")).alias("n_first"),
        blocks(F.col("n") - F.col("n_most"), F.col("w") - F.col("most.w")).alias("n_other"),
    )
    first = F.col("label") == F.col("most")
    block = F.when(first, F.pmod(F.xxhash64("id"), F.col("n_first"))).otherwise(F.col("n_first") + F.pmod(F.xxhash64("id"), F.col("n_other")))
    others = F.sequence(F.when(first, F.col("n_first")).otherwise(0), F.col("n_first") + F.col("n_other") - 1)
    cells = rows.join(nodes, "node").select("id", "label", "s", "c", "node", block.alias("block"), F.explode(others).alias("meets"))
    cell = F.xxhash64("node", F.least("block", "meets"), F.greatest("block", "meets"))
    return durable(cells.select("id", "label", "s", "c", cell.alias("cell"), "block"))


def _dense_links(cells: DataFrame, texts: DataFrame, n: int, join: Join) -> DataFrame:
    cells = cells.join(texts.select("id", "text"), "id").repartition(n, "cell").sortWithinPartitions("cell")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, "cell"):
            cell = t["cell"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
            links = [x for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z - a > 1 for x in _links_in(t.slice(a, z - a), join)]
            u, v = ([x[i] for x in links] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return cells.mapInArrow(tidy(work), "u bigint, v bigint").distinct()


def _links_in(t: pa.Table, join: Join) -> list[tuple[int, int]]:
    """Links between components of a cell's two blocks, enough to connect all that they connect."""
    ids, size, core, label, block = (t[name].to_numpy() for name in ("id", "s", "c", "label", "block"))
    low = np.flatnonzero(block == block.min())
    high = low if len(low) == len(ids) else np.flatnonzero(block != block.min())
    most = np.minimum(core[high][:, None], core[low][None, :]) * (100 + join.percent)
    need = (size[high][:, None] + size[low][None, :]) * join.percent
    open_ = (label[high][:, None] != label[low][None, :]) & (most >= need) & (ids[high][:, None] != ids[low][None, :])
    high, low, need = high[open_.any(axis=1)], low[open_.any(axis=0)], need[open_.any(axis=1)][:, open_.any(axis=0)]
    if not len(high):
        return []
    either = np.union1d(high, low)
    sets = list(sets_of(t["text"].take(pa.array(either)).combine_chunks(), join.k))
    shared = intersections(sets, np.searchsorted(either, high), np.searchsorted(either, low))
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    links = []
    for i, j in zip(*np.nonzero((shared > 0) & (shared * (100 + join.percent) >= need)), strict=True):
        x, y = high[i], low[j]
        a, b = root(int(label[x])), root(int(label[y]))
        if a != b and ids[x] != ids[y]:
            above[max(a, b)] = min(a, b)
            links.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
    return links


def intersections(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of two groups of sets, as products of 0/1 matrices of ``width`` values at a time."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    many = count > 1  # values of one set only meet nothing
    rank = np.cumsum(many) - 1
    owner, place = owner[many[place]], rank[place[many[place]]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(rows), len(columns)), np.int64)
    for at in range(0, int(many.sum()), width):
        part = slice(*np.searchsorted(place, (at, at + width)))
        found = np.zeros((len(sets), width), np.float32)
        found[owner[part], place[part] - at] = 1
        out += (found[rows] @ found[columns].T).astype(np.int64)
    return out


def _with_text(edges: DataFrame, texts: DataFrame, end: str, other: str) -> DataFrame:
    """Adds text_<end>. Edges of a document with many are dealt by a salt over copies of its text."""
    many = edges.groupBy(end).count().where(F.col("count") > HUB)
    parts = many.select(end, F.ceil(F.col("count") / HUB).alias("__n"))
    salted = edges.join(parts, end, "left").withColumn("__s", F.pmod(F.xxhash64(other), F.coalesce("__n", F.lit(1)))).drop("__n")
    copies = texts.join(parts.withColumnRenamed(end, "id"), "id", "left")
    copies = copies.select(
        F.col("id").alias(end), F.col("text").alias(f"text_{end}"), F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1)).alias("__s")
    )
    return salted.join(copies, [end, "__s"]).drop("__s")


def confirm(edges: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """(u, v, linked) of pairs, on the full sets of both texts."""
    both = edges.select("u", "v")
    if edges.groupBy("u").count().where(F.col("count") > HUB).take(1) or edges.groupBy("v").count().where(F.col("count") > HUB).take(1):
        both = _with_text(_with_text(both, texts, "u", "v"), texts, "v", "u")
    else:
        for end in "uv":
            both = both.join(texts.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}")), end)
    both = both.select("u", "v", "text_u", "text_v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(sets_of(batch.column(2), join.k), sets_of(batch.column(3), join.k), strict=True):
                shared = overlap(x, y)
                linked.append(bool(shared) and 100 * shared >= join.percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["u", "v", "linked"]
            )

    return both.mapInArrow(tidy(work), "u bigint, v bigint, linked boolean")


def _forest(edges: DataFrame) -> DataFrame:
    """(id, root) of the vertices of each partition: the smallest id reachable by its edges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while above.setdefault(x, x) != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    above[max(a, b)] = min(a, b)
        ids = list(above)
        for i in range(0, len(ids), 50_000):
            part = ids[i : i + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["id", "root"]
            )

    return edges.select("u", "v").mapInArrow(tidy(work), "id bigint, root bigint")


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u < v; components stay."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # Large star: every neighbour above u joins u's least neighbour.
    edges = edges.join(near, "u").select(F.col("m").alias("u"), "v").distinct()
    # Small star: u and its neighbours below join the least of them.
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    lower = edges.join(least, "v").where(F.col("u") != F.col("m")).select(F.col("m").alias("u"), F.col("u").alias("v"))
    return lower.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame, per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(id, label) for every id in ``edges`` (u, v): the smallest id reachable.

    Up to ``per_task`` edges are united in one task. More are first united inside the tasks that
    hold them, then by alternating large-star and small-star rounds, whose number grows with the logarithm
    of the vertices, until each component is a star around its smallest id.
    """
    edges = durable(edges.select("u", "v"))
    tasks = -(-edges.count() // per_task)
    stars = _forest(edges.coalesce(1) if tasks <= 1 else edges.repartition(tasks))
    if tasks <= 1:
        return durable(stars.withColumnRenamed("root", "label"))
    edges = durable(stars.where("id <> root").select(F.col("root").alias("u"), F.col("id").alias("v")).distinct())
    state = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = None
    while (now := state(edges)) != before:
        before, edges = now, durable(_star_round(edges))
    roots = edges.select(F.col("u").alias("id"), F.col("u").alias("label")).distinct()
    return durable(edges.select(F.col("v").alias("id"), F.col("u").alias("label")).unionByName(roots))


def _within_buckets(texts: DataFrame, rows: DataFrame, ends: list[str]) -> DataFrame:
    """Drops most texts that no row needs before anything is shuffled.

    The ends of the rows are hashed to 64 times as many buckets; that table has at most ``BUCKETS`` rows and is
    broadcast. Beyond it the texts that are needed are no small part any more, and all go to the join.
    """
    wanted = rows.select(F.explode(F.array(*ends)).alias("id"))
    n = rows.count() * len(ends)
    if n > BUCKETS:
        return texts
    bucket = F.pmod(F.xxhash64("id"), F.lit(64 * max(n, 1)))
    wanted = wanted.select(bucket.alias("__b")).distinct()
    return texts.withColumn("__b", bucket).join(F.broadcast(wanted), "__b", "left_semi").drop("__b")


def link_documents(
    docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, n_shingles, class_id (smallest id with an equal set), component_id and kept."""
    importable(docs.sparkSession)
    few = max(1, shuffle_partitions(docs.sparkSession) // 16)  # partitions of light tables
    sketched = durable(sketch_documents(docs, join, id_col, text_col))
    filled = sketched.where(F.col("sig").isNotNull() & F.col("id").isNotNull())
    classes = durable(
        filled.groupBy("sig").agg(
            F.min("id").alias("id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("paths").alias("paths"),
            F.first("sketch").alias("sketch"),
        )
    )
    met = durable(candidate_pairs(classes, join).coalesce(few))
    pairs = met.where("v IS NOT NULL").select("u", "v", "score", (F.col("tree") == -1).alias("hint"))
    large = met.where("v IS NULL").select(F.col("u").alias("id"), "tree", "node")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    # First round: the best candidate of each class.
    ends = pairs.select("u", "v", "score", F.explode(F.array("u", "v")).alias("end"))
    best = F.max_by(F.struct("u", "v"), F.struct("score", -F.col("u"), -F.col("v")))
    left = durable(ends.groupBy("end").agg(best.alias("e")).select("e.u", "e.v").distinct().coalesce(few))
    checked = durable(confirm(left, _within_buckets(texts, left, ["u", "v"]), join))
    links = checked.where("linked").select("u", "v")
    labels = components(links)
    # Second round: every other candidate between components, and of the hints each component's best one.
    of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"l{x}"))
    rest = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    rest = rest.withColumns({"lu": F.coalesce("lu", "u"), "lv": F.coalesce("lv", "v")}).where(F.col("lu") != F.col("lv"))
    hints = rest.where(F.coalesce("hint", F.lit(False))).select("u", "v", "score", F.explode(F.array("lu", "lv")).alias("label"))
    hints = hints.groupBy("label").agg(best.alias("e")).select("e.u", "e.v")
    rest = rest.where("hint IS NULL").select("u", "v").unionByName(hints).distinct()
    rest = durable(rest.join(checked.select("u", "v"), ["u", "v"], "left_anti").coalesce(few))
    if rest.take(1):
        more = durable(confirm(rest, _within_buckets(texts, rest, ["u", "v"]), join).where("linked"))
        if more.take(1):
            links = links.unionByName(more.select("u", "v"))
            labels = components(links)
    # What large nodes still hold apart.
    more = rest_links(classes, texts, labels, large, join)
    if more is not None:
        more = durable(more.coalesce(few))
        if more.take(1):
            labels = components(links.unionByName(more))
    by_class = classes.select("sig", F.col("id").alias("class_id"))
    by_class = by_class.join(labels.select(F.col("id").alias("class_id"), "label"), "class_id", "left")
    by_class = by_class.select("sig", "class_id", F.coalesce("label", "class_id").alias("component_id"))
    out = sketched.select("id", "n_shingles", "sig").join(by_class, "sig", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("class_id", "id").alias("class_id"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id."""
    linked = link_documents(docs, join, id_col, text_col)
    gone = linked.where(~F.col("kept")).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")


#: The contract of op1: three-word shingles, similarity of 0.85 or more.
CONTRACT = Join(k=3, percent=85)


def op1_chosen_path(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return link_documents(docs, CONTRACT).select("doc_id", "n_shingles", "component_id", "kept")
