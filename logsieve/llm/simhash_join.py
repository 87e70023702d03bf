"""Near duplicates by SimHash fingerprints, joined by the generalised pigeonhole principle.

Every document becomes a 64-bit fingerprint: a bit is set if it is set in over half of the 64-bit
hashes of the document's word shingles, repeats included. Documents with equal fingerprints are one
class (a map-side combined aggregation), so copies cost nothing further. Fingerprints that differ
in at most ``limit`` bits are linked.

The join. Bits are grouped into ``m`` partitions so that correlated bits stand together. With
thresholds t_i whose (t_i + 1) add up to limit + 1, two fingerprints within the limit lie within t_i
of each other in some partition i; a partition at -1 isn't probed. Each fingerprint gets thresholds of its own by
dynamic programming over the partitions, at the least sum of probes and estimated candidates. Estimates come from
histograms of groups of at most eight bits of a partition over all fingerprints, convolved as if
groups were independent; m is the one of least estimated cost over all fingerprints. Estimates steer
the work only: any thresholds find every link.

Every fingerprint is entered once for each partition under its bits there, and probes all values within t_i. Rows of
a value meet in one task and are verified by counting the bits that differ; tasks emit no more than
a forest of the links that they find. Values with many rows are compared through midpoints: two
fingerprints within two bits of each other have a common neighbour within one bit, so that rows in proportion to
the members connect all links, whatever the size. Values that could fill a task alone (counted
exactly, at most ``4 * partitions``) do so as Spark aggregations, whose groups have at most 65 fingerprints.

Defined results: texts without words, null and empty ones included, have the fingerprint zero and
are linked like others. Texts of fewer than ``k`` words are one shingle; very long texts are read whole, their shingles
hashed in chunks. Ties of a bit (exactly half) leave it unset. Repeated rows get the same component. A row without an id
gets its fingerprint's component, null if no row with an id has that fingerprint. Other columns, whatever their names,
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workers import importable
from .near_dup import _whole, components
from .runtime import durable, shuffle_partitions, table, tidy

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: Shingles hashed, and fingerprints probed, at a time.
_CHUNK = 1 << 14
_PROBED = 1 << 10
BITS = 64
#: Bits of one histogram.
GROUP = 8


@dataclass(frozen=True)
class SimHash:
    """Parameters: words of a shingle, hash seed, bits that may differ, numbers of partitions to choose from."""

    k: int = 3
    seed: int = 42
    limit: int = 2
    partitions: tuple[int, ...] = (2, 3, 4)
    #: Cost of a probe in candidates.
    probe: float = 4.0
    #: Rows of a value from which midpoints are used, and from which it may be too many for a task.
    wide: int = 64
    hot_rows: int = 2000

    def __post_init__(self):
        if not 0 <= self.limit <= 2:
            raise ValueError("midpoints connect fingerprints of at most two differing bits")


# --- fingerprints ------------------------------------------------------------------------------------------------


def fingerprint(text: bytes, config: SimHash = SimHash()) -> tuple[int, int]:
    """(fingerprint, number of shingles) of a UTF-8 text."""
    lowered = text.lower()  # of bytes: A-Z only
    chars = np.frombuffer(lowered, np.uint8)
    edges = np.diff(np.concatenate(([0], (~_SEPARATOR[chars]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return 0, 0
    if not (np.all(starts[1:] - ends[:-1] == 1) and np.all(chars[ends[:-1]] == 32)):
        chars = chars.copy()
        chars[ends[:-1]] = 32
        kept = ~_SEPARATOR[chars]
        kept[ends[:-1]] = True
        lowered = chars[kept].tobytes()
        lengths = ends - starts
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        ends = starts + lengths
    k = min(config.k, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    n, seed, digest = len(starts), config.seed, xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        bounds = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(lowered[a:z], seed) for a, z in bounds], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]), n


def fingerprint_documents(docs: DataFrame, config: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (as a signed number) and n_shingles of each row."""
    importable(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1))
            found = [fingerprint(x, config) for x in texts]
            prints = np.array([x[0] for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(prints), pa.array([x[1] for x in found], pa.int64())],
                names=["id", "fingerprint", "n_shingles"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(tidy(work), "id bigint, fingerprint bigint, n_shingles bigint")


# --- partitions of bits --------------------------------------------------------------------------------------------


def _prints(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("fingerprint")).to_numpy().view(np.uint64)


def bits_of(prints: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each fingerprint, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(prints, "<u8").view(np.uint8), bitorder="little").reshape(-1, BITS)


def _summed(rows: DataFrame, count, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all fingerprints of an array of fixed ``shape`` that ``count`` makes of some; its size bounds what is collected."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                total += count(_prints(batch)[at : at + _CHUNK])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total.ravel()[cells])], names=["cell", "n"])

    found = np.zeros(shape, np.int64)
    sums = rows.select("fingerprint").mapInArrow(tidy(work), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in sums.collect():
        found.flat[r["cell"]] = r["n"]
    return found


def correlations(together: np.ndarray, n: int) -> np.ndarray:
    """Absolute correlations of bits, from the numbers of fingerprints with both of two bits set."""
    share = together / max(n, 1)
    mean = np.diag(share)
    spread = np.sqrt(mean * (1 - mean))
    scale = np.outer(spread, spread)
    return np.abs(np.divide(share - np.outer(mean, mean), scale, out=np.zeros_like(share), where=scale > 0))


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` partitions of near equal width: each begins with the two most correlated bits that are left
    and takes the bit most correlated with what it has."""
    left, groups = list(range(len(correlation))), []
    for i in range(m):
        width = -(-len(left) // (m - i))
        pairs = correlation[np.ix_(left, left)].copy()
        np.fill_diagonal(pairs, -1)
        group = [left[int(pairs.max(axis=1).argmax())]]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(correlation[np.ix_(rest, group)].sum(axis=1).argmax())])
        groups.append(group)
        left = [b for b in left if b not in group]
    return groups


@dataclass(frozen=True)
class Split:
    """Partitions of bits, and the histograms of their groups of at most ``GROUP`` bits."""

    parts: list[list[int]]

    @property
    def groups(self) -> list[tuple[int, list[int]]]:
        """(partition, bits) of each group."""
        return [(i, bits[a : a + GROUP]) for i, bits in enumerate(self.parts) for a in range(0, len(bits), GROUP)]

    def masks(self) -> list[np.uint64]:
        return [np.uint64(sum(1 << b for b in bits)) for bits in self.parts]

    def values(self, bits: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(partition, group, value) with the values of a group for each row of ``bits``."""
        for g, (i, own) in enumerate(self.groups):
            yield i, g, bits[:, own].astype(np.int64) @ (1 << np.arange(len(own)))

    def histogram(self, prints: np.ndarray, cells: int) -> np.ndarray:
        """Counts of each group's values; groups beyond this split's stay zero."""
        found = np.zeros((cells, 1 << GROUP), np.int64)
        for _, g, value in self.values(bits_of(prints)):
            found[g] = np.bincount(value, minlength=1 << GROUP)
        return found


def distance_shares(histogram: np.ndarray, limit: int) -> np.ndarray:
    """For each group and value, the share of fingerprints whose value there differs in 0, 1, ..., limit bits."""
    every = np.arange(1 << GROUP)
    apart = np.bitwise_count(every[:, None] ^ every[None, :])
    total = max(int(histogram[0].sum()), 1)
    return np.stack([histogram @ (apart == d) / total for d in range(limit + 1)], axis=-1)


def _flips(bits: list[int], most: int) -> list[np.ndarray]:
    """By weight up to ``most``, the numbers with so many of ``bits`` set."""
    return [np.array([sum(1 << b for b in c) for c in itertools.combinations(bits, w)], np.uint64) for w in range(most + 1)]


def allocate(prints: np.ndarray, split: Split, shares: np.ndarray, n: int, config: SimHash) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds of each partition, cost) of each fingerprint: the least sum of probes and estimated candidates.

    Dynamic programming over the partitions; a partition at threshold t uses t + 1 of the limit + 1 units.
    """
    units, m = config.limit + 1, len(split.parts)
    within = np.zeros((m, len(prints), units))
    within[:, :, 0] = 1
    for i, g, value in split.values(bits_of(prints)):
        near = shares[g][value]
        within[i] = np.stack([sum(within[i][:, a] * near[:, d - a] for a in range(d + 1)) for d in range(units)], axis=1)
    candidates = n * np.cumsum(within, axis=2)
    best, picks = np.full((len(prints), units + 1), np.inf), []
    best[:, 0] = 0
    for i, bits in enumerate(split.parts):
        probes = np.cumsum([len(f) for f in _flips(bits, config.limit)]) * config.probe
        cost = np.concatenate([np.zeros((len(prints), 1)), candidates[i] + probes], axis=1)
        # choices[:, s, e]: s units so far, e of them in this partition.
        choices = np.stack([np.stack([best[:, s - e] + cost[:, e] if e <= s else np.full(len(prints), np.inf) for e in range(units + 1)], axis=1) for s in range(units + 1)], axis=1)
        picks.append(choices.argmin(axis=2))
        best = choices.min(axis=2)
    left, chosen = np.full(len(prints), units), np.zeros((len(prints), m), np.int64)
    for i in reversed(range(m)):
        chosen[:, i] = picks[i][np.arange(len(prints)), left]
        left = left - chosen[:, i]
    return chosen - 1, best[:, units]


def choose_split(classes: DataFrame, config: SimHash) -> tuple[Split, np.ndarray, int]:
    """(split, shares, number of fingerprints): the split of least estimated cost over all fingerprints."""
    together = _summed(classes, lambda p: (lambda b: (b.T @ b).astype(np.int64))(bits_of(p).astype(np.float64)), (BITS, BITS))
    n = classes.count()
    correlation = correlations(together, n)
    splits = [Split(group_bits(correlation, m)) for m in config.partitions]
    cells = max(len(s.groups) for s in splits)
    histograms = _summed(classes, lambda p: np.stack([s.histogram(p, cells) for s in splits]), (len(splits), cells, 1 << GROUP))
    shares = [distance_shares(h, config.limit) for h in histograms]
    cost = lambda p: np.array([np.ceil(allocate(p, s, h, n, config)[1].sum()) for s, h in zip(splits, shares, strict=True)]).astype(np.int64)
    least = int(_summed(classes, cost, (len(splits),)).argmin())
    return splits[least], shares[least], n


# --- join ------------------------------------------------------------------------------------------------------------

#: Kinds of rows: entered under a value, probing it, or both.
ENTERED, PROBING, BOTH = 0, 1, 2


def entries(classes: DataFrame, split: Split, shares: np.ndarray, n: int, config: SimHash) -> DataFrame:
    """(part, value, fingerprint, id, kind): each fingerprint under its bits of every partition and at its probes."""
    flips, masks = [_flips(bits, config.limit) for bits in split.parts], split.masks()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, names = _prints(batch), batch.column(batch.schema.get_field_index("id")).to_numpy()
            for at in range(0, len(every), _PROBED):
                prints, ids = every[at : at + _PROBED], names[at : at + _PROBED]
                chosen, _ = allocate(prints, split, shares, n, config)
                for i, mask in enumerate(masks):
                    own = prints & mask
                    pieces = [(own, prints, ids, np.where(chosen[:, i] >= 0, BOTH, ENTERED))]
                    for weight in range(1, config.limit + 1):
                        far = chosen[:, i] >= weight
                        value = (own[far][:, None] ^ flips[i][weight][None, :]).ravel()
                        w = len(flips[i][weight])
                        pieces.append((value, np.repeat(prints[far], w), np.repeat(ids[far], w), np.full(len(value), PROBING)))
                    value, whole, of, kind = (np.concatenate(x) for x in zip(*pieces, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(value), i, np.int8)), pa.array(value.view(np.int64)),
                            pa.array(whole.view(np.int64)), pa.array(of), pa.array(kind.astype(np.int8)),
                        ],
                        names=["part", "value", "fingerprint", "id", "kind"],
                    )

    rows = classes.select("id", "fingerprint").mapInArrow(tidy(work), "part tinyint, value bigint, fingerprint bigint, id bigint, kind tinyint")
    return rows.withColumn("key", F.xxhash64("part", "value"))


def _forest_of(u: np.ndarray, v: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs that connect all that the given ones connect, without cycles."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    ends: tuple[list[int], list[int]] = ([], [])
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            above[max(a, b)] = min(a, b)
            ends[0].append(min(x, y))
            ends[1].append(max(x, y))
    return ends


def _near_in(prints: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all links of at most two bits among fingerprints, through midpoints."""
    prints, first = np.unique(prints, return_index=True)
    ids = ids[first]
    around = np.concatenate(([0], np.uint64(1) << np.arange(BITS, dtype=np.uint64))).astype(np.uint64)
    middle = (prints[:, None] ^ around[None, :]).ravel()
    owner = np.repeat(np.arange(len(prints)), len(around))
    order = np.argsort(middle, kind="stable")
    middle, owner = middle[order], owner[order]
    same = np.flatnonzero(middle[1:] == middle[:-1])  # both lie within one bit of the middle
    return ids[owner[same]], ids[owner[same + 1]]


def _links_of(t: pa.Table, config: SimHash) -> tuple[list[int], list[int]]:
    """Verified links among rows of whole values, sorted by value, as a forest."""
    part, value, kind, ids = (t[c].to_numpy() for c in ("part", "value", "kind", "id"))
    prints = t["fingerprint"].to_numpy().view(np.uint64)
    new = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0)) + 1
    cuts = np.concatenate(([0], new, [len(part)]))
    sizes = np.diff(cuts)
    us, vs = [], []
    for i in np.flatnonzero(sizes > config.wide):
        if config.limit == 2:
            u, v = _near_in(prints[cuts[i] : cuts[i + 1]], ids[cuts[i] : cuts[i + 1]])
        else:
            rows = np.arange(cuts[i], cuts[i + 1])
            met = [(r, rows[np.bitwise_count(prints[rows] ^ prints[r]) <= config.limit]) for r in rows]
            u, v = np.concatenate([np.full(len(x), ids[r]) for r, x in met]), np.concatenate([ids[x] for _, x in met])
        us.append(u), vs.append(v)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= config.wide), sizes))
    for step in range(1, config.wide):
        at = at[at + step < len(bucket)]
        at = at[bucket[at] == bucket[at + step]]
        if not len(at):
            break
        far = at + step
        probed = ((kind[at] != ENTERED) & (kind[far] != PROBING)) | ((kind[far] != ENTERED) & (kind[at] != PROBING))
        good = probed & (np.bitwise_count(prints[at] ^ prints[far]) <= config.limit) & (ids[at] != ids[far])
        us.append(ids[at[good]]), vs.append(ids[far[good]])
    return _forest_of(np.concatenate(us or [ids[:0]]), np.concatenate(vs or [ids[:0]]))


def links_between(classes: DataFrame, config: SimHash = SimHash()) -> DataFrame:
    """(u, v) with u < v: pairs of ids of ``classes`` (id, fingerprint: distinct) that connect all links."""
    spark = classes.sparkSession
    n = shuffle_partitions(spark)
    split, shares, total = choose_split(classes, config)
    rows = entries(classes, split, shares, total, config)
    counts = durable(rows.groupBy("key").count().where(F.col("count") >= config.hot_rows))
    hot: list[int] = []
    if counts.take(1):
        least = max(config.hot_rows, rows.count() // (4 * n))
        hot = [r["key"] for r in counts.where(F.col("count") >= least).orderBy(F.desc("count")).limit(4 * n).collect()]
    cool = rows.where(~F.col("key").isin(hot)) if hot else rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, "key"):
            u, v = _links_of(t, config)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    met = cool.repartition(n, "key").sortWithinPartitions("key", "part", "value").mapInArrow(tidy(work), "u bigint, v bigint")
    if hot:
        met = met.unionByName(_hot_links(rows.where(F.col("key").isin(hot)), config))
    return met.where("u <> v").distinct()


def _hot_links(rows: DataFrame, config: SimHash) -> DataFrame:
    """Links among the fingerprints of hot values. A midpoint has at most 65 fingerprints around it."""
    members = rows.select("id", "fingerprint").distinct()
    middles = [F.col("fingerprint"), *(F.col("fingerprint").bitwiseXOR(F.lit((1 << b) - (1 << BITS if b == BITS - 1 else 0))) for b in range(BITS))]
    around = members.select("id", "fingerprint", F.explode(F.array(*middles)).alias("middle"))
    met = around.groupBy("middle").agg(F.collect_set(F.struct("id", "fingerprint")).alias("all")).where(F.size("all") > 1)
    apart = lambda a, b: F.bit_count(a["fingerprint"].bitwiseXOR(b["fingerprint"])) <= config.limit
    first = F.array_min("all")
    if config.limit == 2:  # all around a midpoint are linked: a star connects them
        pairs = F.transform("all", lambda b: F.struct(first["id"].alias("u"), b["id"].alias("v")))
    else:
        pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: (b["id"] > a["id"]) & apart(a, b)), lambda b: F.struct(a["id"].alias("u"), b["id"].alias("v")))))
    return met.select(F.explode(pairs).alias("p")).select(F.least("p.u", "p.v").alias("u"), F.greatest("p.u", "p.v").alias("v"))


def link_fingerprints(docs: DataFrame, config: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, fingerprint (16 hex digits), class_id (smallest id of the fingerprint) and component_id."""
    prints = durable(fingerprint_documents(docs, config, id_col, text_col))
    classes = durable(prints.where("id IS NOT NULL").groupBy("fingerprint").agg(F.min("id").alias("id")))
    labels = components(links_between(classes, config))
    by_class = classes.join(labels, "id", "left").select("fingerprint", F.col("id").alias("class_id"), F.coalesce("label", "id").alias("component_id"))
    return prints.join(by_class, "fingerprint", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "class_id", "component_id"
    )


def op11_pigeonhole(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_fingerprints(docs, SimHash()).select("doc_id", "fingerprint", "component_id")
