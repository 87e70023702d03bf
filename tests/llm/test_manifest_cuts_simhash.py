"""SimHash join, Merkle manifest and fill-in-the-middle against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logsieve.llm import fill_middle, merkle, simhash_join
from logsieve.llm.fill_middle import EliasFano, FillMiddle, fill_in_middle
from logsieve.llm.merkle import Manifest, manifest
from logsieve.llm.simhash_join import SimHash, link_fingerprints

from .conftest import prose

SF = "/root/testdata/sf0.001"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- SimHash ---------------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k=3):
    words = re.findall("[^\x20\x09-\x0d]+", fold(text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, limit=2):
    """Smallest id reachable for each (id, fingerprint)."""
    above = {i: i for i, _ in prints}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, p in prints:
        for b, q in prints:
            if a < b and (p ^ q).bit_count() <= limit:
                x, y = root(a), root(b)
                above[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in prints}


AWKWARD = [
    None, "", " \t\n", "One", "one two", "A\x0bB  c\x0cd\r\ne", " lead and trail ", "É é İ ẞ mixed Case", "漢字 かな 文 text 😀 here", "a b c d e",
    "x" * 5000, "Word " * 3000, prose(9, 40_000), "same same same same",
]


@pytest.mark.parametrize("text", AWKWARD)
def test_fingerprint(text):
    got, n = simhash_join.fingerprint((text or "").encode())
    assert got == plain_fingerprint(text)
    assert n == max(len(re.findall("[^\x20\x09-\x0d]+", text or "")) - 2, bool((text or "").strip(" \t\n\x0b\x0c\r")))


def test_spark_hash_is_the_same(spark):
    rows = spark.createDataFrame([("one two three",), ("É 漢 😀",)], "x string")
    for r in rows.select("x", F.xxhash64("x").alias("h")).collect():
        assert r.h % 2**64 == xxhash.xxh64_intdigest(r.x.encode(), seed=42)


def classes_of(spark, prints):
    signed = [(i, p - (1 << 64 if p >> 63 else 0)) for i, p in prints]
    return spark.createDataFrame(signed, "id bigint, fingerprint bigint").repartition(3)


def clustered(seed, n, centres, flips, bits=64):
    r = random.Random(seed)
    base = [r.getrandbits(bits) for _ in range(centres)]
    found = {}
    while len(found) < n:
        p = r.choice(base)
        for _ in range(r.randint(0, flips)):
            p ^= 1 << r.randrange(64)
        found.setdefault(p, len(found))
    ids = list(range(1, n + 1))
    r.shuffle(ids)
    return list(zip(ids, found, strict=True))


CASES = {
    "spread": (clustered(1, 300, 300, 0), SimHash()),
    "families": (clustered(2, 500, 40, 5), SimHash()),
    "dense": (clustered(3, 600, 1, 6), SimHash(wide=8, hot_rows=20)),
    "dense in tasks": (clustered(3, 600, 1, 6), SimHash(wide=8, hot_rows=10**6)),
    "two far families": (clustered(4, 400, 2, 4), SimHash(wide=4, hot_rows=50)),
    "one partition count": (clustered(5, 300, 20, 4), SimHash(partitions=(3,))),
    "few bits used": (clustered(6, 300, 30, 3, bits=12), SimHash()),
    "limit 1": (clustered(7, 400, 20, 4), SimHash(limit=1, wide=8, hot_rows=30)),
    "limit 0": (clustered(8, 100, 20, 4), SimHash(limit=0, wide=8, hot_rows=30)),
}


@pytest.mark.parametrize("name", CASES)
def test_links_connect_what_brute_force_connects(spark, name):
    prints, config = CASES[name]
    links = [(r.u, r.v) for r in simhash_join.links_between(classes_of(spark, prints), config).collect()]
    of = dict(prints)
    assert all((of[u] ^ of[v]).bit_count() <= config.limit for u, v in links)
    above = {i: i for i in of}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for u, v in links:
        a, b = root(u), root(v)
        above[max(a, b)] = min(a, b)
    assert {i: root(i) for i in of} == plain_components(prints, config.limit)
    assert len(links) < 40 * len(prints)


def test_allocation_is_a_cover_of_least_cost():
    """Thresholds add up as the principle asks, and no other choice costs less."""
    r = np.random.default_rng(11)
    prints = r.integers(0, 2**64, 400, dtype=np.uint64)
    prints[:300] = prints[:300] & ~np.uint64(0xFFFFFF) | np.uint64(0x5A5A5A)  # most share 24 bits
    together = simhash_join.bits_of(prints).astype(float)
    parts = simhash_join.group_bits(simhash_join.correlations(together.T @ together, len(prints)), 3)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} == {21, 22}
    split = simhash_join.Split(parts)
    shares = simhash_join.distance_shares(split.histogram(prints, len(split.groups)), 2)
    config = SimHash(probe=0.01)
    chosen, cost = simhash_join.allocate(prints, split, shares, len(prints), config)
    assert (chosen.sum(axis=1) == 2 - 3 + 1).all() and chosen.min() >= -1
    assert len({tuple(c) for c in chosen.tolist()}) > 1  # thresholds differ between fingerprints
    for row in range(0, 400, 37):
        within = []
        for i, _ in enumerate(parts):
            spread = np.array([1.0, 0, 0])
            for part, g, value in split.values(simhash_join.bits_of(prints[row : row + 1])):
                if part == i:
                    spread = np.array([sum(spread[a] * shares[g][value[0]][d - a] for a in range(d + 1)) for d in range(3)])
            within.append(spread.cumsum() * len(prints))
        probes = [np.cumsum([len(f) for f in simhash_join._flips(bits, 2)]) * config.probe for bits in parts]
        every = [(a, b, 3 - a - b) for a in range(4) for b in range(4 - a)]
        best = min(sum(within[i][e - 1] + probes[i][e - 1] for i, e in enumerate(es) if e) for es in every)
        assert np.isclose(cost[row], best)


def test_correlated_bits_share_a_partition():
    r = np.random.default_rng(5)
    free = r.integers(0, 2, (4000, 32), dtype=np.uint8)
    bits = np.concatenate([free, free], axis=1).astype(float)  # bit b and b + 32 are equal
    parts = simhash_join.group_bits(simhash_join.correlations(bits.T @ bits, 4000), 4)
    assert all(b + 32 in p for p in parts for b in p if b < 32)


def test_op11_awkward_rows(spark, docs, empty):
    got = link_fingerprints(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows])
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {r.doc_id: (f"{plain_fingerprint(r.text):016x}", want[r.doc_id]) for r in rows}
    assert link_fingerprints(empty).count() == 0
    no_id = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "else where"), (3, "a b c d")], "doc_id bigint, text string")
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in link_fingerprints(no_id).collect()))) == sorted(map(str, [(None, 3), (5, 3), (None, None), (3, 3)]))


def test_op11_query(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_join.op11_pigeonhole(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    want = plain_components(prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints} and len(set(want.values())) < len(want)


# --- Merkle manifest ---------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests, fanout):
    """(last node, siblings of every leaf: (before, after) by level)."""
    steps, at, low = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(low) > 1:
        for leaf, place in enumerate(at):
            first = place // fanout * fanout
            steps[leaf].append((low[first:place], low[place + 1 : first + fanout]))
        low = [sha("".join(low[i : i + fanout])) for i in range(0, len(low), fanout)]
        at = [p // fanout for p in at]
    return low[0], steps


def plain_manifest(rows, fields, group, changed, fanout):
    """(id, leaf, subroot, root, proof digest, folded root) of each row, by definition."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[group], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, out = [], []
    for name in names:
        mine = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf([r[f] for f in fields])))
        leaves = [plain_leaf([r[f] for f in fields]) for r in mine]
        sub, steps = plain_tree(leaves, fanout)
        subs.append(sub)
        out += [(r, leaf, sub, step, len(subs) - 1) for r, leaf, step in zip(mine, leaves, steps, strict=True)]
    if not out:
        return []
    root, upper = plain_tree(subs, fanout)
    found = []
    for r, leaf, sub, step, at in out:
        path = step + upper[at]
        proof = sha("".join("".join(a) + "".join(z) for a, z in path))
        folded = plain_leaf([changed(r, f) for f in fields])
        for a, z in path:
            folded = sha("".join(a) + folded + "".join(z))
        found.append((r["doc_id"], leaf, sub, root, proof, folded))
    return sorted(found, key=str)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tampered(r, f):
    hit = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
    return fold(r[f]) if f == "text" and hit and r[f] is not None and r["doc_id"] is not None else r[f]


def tamper():
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return {"text": F.when(hit, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))}


@pytest.mark.parametrize(
    ("fanout", "levels", "sizes"),
    [(8, 3, [1]), (8, 3, [8]), (8, 1, [9]), (8, 1, [1, 8, 65, 200]), (2, 2, [1, 8, 65]), (3, 2, [3, 1, 1, 1, 1, 1, 1, 1, 1, 30]), (10, 1, [11, 100, 101])],
)
def test_manifest_by_definition(spark, fanout, levels, sizes):
    r = random.Random(sum(sizes))
    rows = []
    for g, size in enumerate(sizes):
        name = [None, "", "é", "z", "Z", "漢", "a", "aa", "😀", "b"][g]
        rows += [(r.randrange(10**6), r.choice([None, "", "s"]), name, r.choice([None, 5]), r.choice([None, "", "Text", "é X"]), "clash", 1) for _ in range(size)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, place int").repartition(3)
    got = manifest(docs, Manifest(fanout=fanout, levels=levels), tamper()).collect()
    want = plain_manifest([x.asDict() for x in docs.collect()], FIELDS, "lang", tampered, fanout)
    assert sorted(((x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root) for x in got), key=str) == want
    assert all(x.verified == (x.folded_root == x.root) for x in got)


def test_manifest_awkward_rows(spark, docs, empty):
    config = Manifest(fanout=3, levels=2)
    got = manifest(docs, config, tamper(), texts=True).collect()
    want = plain_manifest([x.asDict() for x in docs.collect()], FIELDS, "lang", tampered, 3)
    assert sorted(((x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root) for x in got), key=str) == want
    assert all(merkle.fold(x.leaf, x.proof) == x.root for x in got)
    assert {x.verified for x in got} == {True, False}
    assert manifest(empty).count() == 0
    rows = spark.createDataFrame([(None, None), (None, None), (1, "x"), (1, "x"), (2**60 + 1, "y")], "doc_id bigint, text string")
    rows = rows.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "n_chars": F.lit(1)})
    got = manifest(rows, config).collect()
    assert sorted((x.doc_id or 0) for x in got) == [0, 0, 1, 1, 2**60 + 1] and all(x.verified for x in got)
    want = plain_manifest([x.asDict() for x in rows.collect()], FIELDS, "lang", lambda r, f: r[f], 3)
    assert sorted(((x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256, x.folded_root) for x in got), key=str) == want


# --- fill in the middle ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_elias_fano(seed):
    r = np.random.default_rng(seed)
    bound = int(r.choice([1, 70, 1000, 10**6, 2**40]))
    values = np.unique(r.integers(0, bound, int(r.choice([1, 5, 64, 1000]))))
    held = EliasFano(values, bound)
    assert [held.select(i) for i in range(len(values))] == values.tolist()
    if len(values) > 500:
        assert 8 * (held.words.nbytes + held.low.nbytes) < len(values) * (3 + np.log2(bound / len(values))) + 200
    assert EliasFano(np.zeros(0, np.int64), 0).n == 0


def plain_cut(doc_id, text, c):
    text = text or ""
    d = hashlib.sha256(f"{c.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= c.cut_percent:
        return (doc_id, n, "plain", None, None, text)
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:z], text[z:]
    if h4 % 100 < c.spm_percent:
        return (doc_id, n, "spm", a, z - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, z - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("config", [FillMiddle(), FillMiddle(hot_rows=3), FillMiddle(seed=7, cut_percent=100, spm_percent=50, hot_rows=20)])
def test_cuts_by_definition(spark, docs, empty, config):
    more = [(None, "no id"), (None, "no id"), (50, "has <P> it"), (51, "<S"), (52, "P><M <S< M>"), (53, "é combining 👩‍👩‍👧"), (54, "\x00 nul")]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string")).repartition(4)
    found = fill_in_middle(rows.withColumn("form", F.lit("clash")), config)
    again = fill_middle.restored(F.col("output"), F.col("form"))
    found = found.withColumns({"again": again, "is_text": F.sha2(again, 256) == F.col("text_sha256")}).collect()
    assert all(r.is_text for r in found)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=str)
    assert got == sorted((plain_cut(r.doc_id, r.text, config) for r in rows.collect()), key=str)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert sorted((r.again for r in found), key=str) == sorted((r.text or "" for r in rows.collect()), key=str)
    assert fill_in_middle(empty).count() == 0


def test_boundary_list_is_made_once_for_a_text(monkeypatch):
    bounds = fill_middle.Boundaries("aé漢😀z".encode())
    assert [bounds.offset(i) for i in range(bounds.n + 1)] == [0, 1, 3, 6, 10, 11]
    assert fill_middle.arrange("aé漢😀z".encode(), bounds, 1, 3, "psm").decode() == "<P>a<S>😀z<M>é漢"
    assert fill_middle.arrange("aé漢😀z".encode(), bounds, 1, 3, "spm").decode() == "<S>😀z<P>a<M>é漢"


@pytest.mark.parametrize("name", ["op12_superblock_manifest", "op13_distinct_text_cuts"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from logsieve.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    got = sorted(tuple(str(r[n]) for n in names) for r in df.collect())
    assert sorted(names) == sorted(df.columns) and got == sorted(tuple(map(str, r)) for r in result.fetchall())


def test_text_shuffles_once(spark):
    """Of the two sides of the join only the index has texts."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fill_in_middle(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(digest") == 2 and "Exchange hashpartitioning(digest#" in plan
    assert plan.count("FileScan parquet") == 1
