"""Exact dedup (6) and near dedup (1) against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsieve.llm import content_sort, near_dup
from logsieve.llm.near_dup import Join
from logsieve.llm.shingles import sets_of
from .conftest import WORDS, prose

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(FOLD))


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("partitions", [1, 4])
def test_exact(docs, keep, partitions):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    got = content_sort.sort_content(docs, keep=keep, partitions=partitions)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "block", "host", "keep_id", "group_size", "kept", "text_sha256"]
    kept: dict[str, int] = {}
    for r in got.collect():
        norm = (r.text or "").translate(FOLD)
        pick = (min if keep == "smallest" else max)(groups[norm])
        assert (r.keep_id, r.group_size) == (pick, len(groups[norm]))
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
        kept[norm] = kept.get(norm, 0) + r.kept
        assert not r.kept or r.doc_id == pick
    assert set(kept.values()) == {1} and len(got.collect()) == len(rows)


def test_exact_hot_group(spark):
    rows = [(i, "Hot text" if i % 3 == 0 else f"text {i}") for i in range(600)]
    got = content_sort.sort_content(spark.createDataFrame(rows, "doc_id long, text string"), keep="largest", partitions=8)
    hot = got.where("group_size > 1").collect()
    assert len(hot) == 200 and {r.keep_id for r in hot} == {597} and sum(r.kept for r in hot) == 1
    assert got.where("kept").count() == 401


def test_exact_empty(empty):
    assert content_sort.sort_content(empty).count() == 0


@pytest.mark.parametrize("k", [1, 3, 5])
def test_shingle_sets(docs, k):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sizes = [len(s) for s in sets_of(pa.array([t for _, t in rows]), k)]
    assert sizes == [len(shingles(t, k)) for _, t in rows]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near(docs, k, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, sizes = brute_components(rows, k, percent)
    got = near_dup.link_documents(docs, Join(k=k, percent=percent)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_groups_and_chains(spark):
    r = random.Random(8)
    rows, n = [], 0
    for g in range(12):
        text = prose(100 + g, 150).split(" ")
        for _ in range(r.choice([1, 2, 5, 60])):
            copy = list(text)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            rows.append((n, " ".join(copy)))
            n += 1
            if r.random() < 0.3:
                text = copy  # a chain: the ends drift apart
    want, _ = brute_components(rows, 3, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in near_dup.link_documents(df, Join(k=3, percent=85)).collect()}
    assert got == want
    # Every large node goes through the distributed levels, and salts at the last one.
    hot = Join(k=3, percent=85, hot_rows=20, leaf=8, depth=3, target=0.9999)
    got = {x.doc_id: x.component_id for x in near_dup.link_documents(df, hot).collect()}
    assert got == want


def family(members, links):
    """Texts of one family below the threshold, and ``links`` of them with a partner just above it."""
    r = random.Random(11)
    base, rows = prose(500, 240).split(" ")[:200], []
    # A shared opening of 150 of 170 shingles: any two have a similarity of 0.79, planted pairs 0.858.
    for i in range(members):
        own = [f"{r.choice(WORDS)}{i}x{j}" for j in range(20)]
        rows.append((i, " ".join(base[:152] + own)))
    for i in range(0, links * 7, 7):
        own = rows[i][1].split(" ")
        own[159:] = [f"new{i}x{j}" for j in range(13)]
        rows.append((10_000 + i, " ".join(own)))
    return rows


@pytest.mark.parametrize("hot_rows", [2000, 40])
def test_near_family_below_threshold(spark, hot_rows):
    """Only planted pairs link, so nothing but the whole comparison of a large node finds them."""
    rows = family(300, 40)
    want, _ = brute_components(rows, 3, 85)
    assert sum(want[i] != i for i in want) == 40
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    join = Join(k=3, percent=85, leaf=4, depth=2, hot_rows=hot_rows, block=50)
    got = {x.doc_id: x.component_id for x in near_dup.link_documents(df, join).collect()}
    assert got == want


def templates(pairs, inside, across, boilerplate=1002):
    """Pages of one template in pairs: similarity ``inside`` a pair and ``across`` pairs, of three-word shingles."""
    r = random.Random(17)
    shared = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(boilerplate)]
    n = boilerplate - 2
    own = (n / across - n) / 2  # further shingles of a page
    common = round((inside * (n + 2 * own) - n) / (1 + inside))  # of them also its partner's
    own = round(own)
    rows = []
    for p in range(pairs):
        for side in (0, 1):
            tail = [f"p{p}w{j}" for j in range(common)] + [f"p{p}s{side}w{j}" for j in range(own - common)]
            rows.append((2 * p + side, " ".join(shared + tail)))
    return rows


@pytest.mark.parametrize(("pairs", "inside", "across"), [(750, 0.859, 0.843), (2000, 0.859, 0.843), (750, 0.853, 0.820)])
def test_near_templates(spark, pairs, inside, across):
    """Pages just below the threshold around pairs just above it: every pair is found, and nothing else."""
    df = spark.createDataFrame(templates(pairs, inside, across), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in near_dup.link_documents(df, near_dup.CONTRACT).collect()}
    right = sum(got[2 * p + 1] == 2 * p for p in range(pairs))
    assert all(c // 2 == i // 2 for i, c in got.items())
    assert right >= 0.97 * pairs  # the trees' target is 0.99


def test_near_templates_of_frequent_shingles(spark):
    """Every shingle is frequent: two slots of a template, filled from pools; only the matrix product can decide."""
    r = random.Random(18)
    base = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(200)]
    fill = lambda tag, i, n: [f"{tag}{i}w{j}" for j in range(n)]
    rows = [(i, " ".join(base + fill("a", i % 60, 22) + fill("b", i * 7 // 60 % 60, 4))) for i in range(2400)]
    want, _ = brute_components([rows[i] for i in range(0, 2400, 8)], 3, 85)
    df = spark.createDataFrame([rows[i] for i in range(0, 2400, 8)], "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in near_dup.link_documents(df, Join(k=3, percent=85, rare=2)).collect()}
    assert got == want and 1 < len(set(want.values())) < 300


def test_intersections():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 300, r.integers(0, 120))).astype(np.uint64) for _ in range(40)]
    got = near_dup.intersections(sets, np.arange(10), np.arange(5, 40), width=16)
    assert got.tolist() == [[len(set(sets[i]) & set(sets[j])) for j in range(5, 40)] for i in range(10)]


def test_salts_follow_each_node(spark):
    rows = [(i, 1, tree, bytes(4), bytes(128), 1, tree) for tree, n in ((0, 100), (1, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, n_shingles long, tree int, path binary, sketch binary, level int, node long")
    got = near_dup._spread_hot(df, Join(depth=1, hot_rows=10), 4)
    parts = {x.tree: x.parts for x in got.groupBy("tree").agg(F.countDistinct("node").alias("parts")).collect()}
    assert got.columns == df.columns and got.count() == 120 and parts == {0: 10, 1: 2}


def test_components_in_parts(spark):
    r = random.Random(3)
    edges = [(a, a + r.choice([1, 1, 7])) for a in range(300) if r.random() < 0.8]
    label = {x: x for e in edges for x in e}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    got = near_dup.components(spark.createDataFrame(edges, "u long, v long"), per_task=40).collect()
    assert {x.id: x.label for x in got} == {x: find(x) for x in label}


def test_components_of_a_long_chain(spark, monkeypatch):
    rounds, step = [], near_dup._star_round
    monkeypatch.setattr(near_dup, "_star_round", lambda e: rounds.append(1) or step(e))
    ids = np.random.default_rng(6).permutation(100_001)
    edges = [(int(min(a, b)), int(max(a, b))) for a, b in zip(ids[:-1], ids[1:], strict=True)]
    got = near_dup.components(spark.createDataFrame(edges, "u long, v long"), per_task=5000)
    assert got.count() == 100_001 and got.where("label <> 0").count() == 0
    assert len(rounds) <= 20


def test_hubs_meet_copies_of_their_text(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HUB", 7)
    texts = spark.createDataFrame([(i, prose(1, 30) if i < 60 else prose(2, 30)) for i in range(90)], "id long, text string")
    edges = spark.createDataFrame([(0, i) for i in range(1, 90)] + [(i, 89) for i in range(1, 89)], "u long, v long")
    got = {(r.u, r.v): r.linked for r in near_dup.confirm(edges, texts, Join()).collect()}
    assert got == {(u, v): (u < 60) == (v < 60) for u, v in [(0, i) for i in range(1, 90)] + [(i, 89) for i in range(1, 89)]}


def test_trees_reach_the_target():
    for join in (Join(), near_dup.CONTRACT, Join(percent=70), Join(target=0.999)):
        assert all(join.recall(level) >= join.target for level in range(1, join.depth + 1))
    assert (Join().trees, near_dup.CONTRACT.trees, Join(trees=3).trees) == (16, 10, 3)


def test_more_trees_than_sketch(docs):
    join = Join(trees=30)  # 180 branching values, a sketch of 128
    got = near_dup.link_documents(docs, join).select("doc_id", "component_id")
    want = near_dup.link_documents(docs).select("doc_id", "component_id")
    assert sorted(got.collect()) == sorted(want.collect())


def test_near_empty(empty):
    assert near_dup.link_documents(empty).count() == 0
    assert near_dup.drop_near_copies(empty).count() == 0
    assert Join().recall(2) > 0.9999 and Join(percent=85).recall(6) > 0.98


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("partitions", [2, 200])
def test_exact_null_ids(spark, keep, partitions):
    """Hot or not: one row of a text stays, with an id if any row has one."""
    rows = [(None, "Same")] * 40 + [(7, "same"), (9, "SAME"), (7, "same")] + [(None, "lone")] * 30 + [(None, None), (3, ""), (None, "once")]
    got = content_sort.sort_content(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), keep=keep, partitions=partitions).collect()
    assert len(got) == len(rows)
    kept = sorted(((r.text or "").lower(), r.doc_id, r.keep_id, r.group_size) for r in got if r.kept)
    assert kept == [("", 3, 3, 2), ("lone", None, None, 30), ("once", None, None, 1), ("same", 7 if keep == "smallest" else 9, 7 if keep == "smallest" else 9, 43)]


def test_near_null_ids(spark):
    """Rows without an id follow an equal set, or stay; they never link others."""
    base = prose(41, 120)
    near = base.replace(base.split(" ")[60], "other", 1)
    rows = [(None, base), (5, near), (None, near), (None, prose(42, 50)), (None, None), (8, base), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.link_documents(df, Join(k=3, percent=80)).collect()), key=str)
    assert got == sorted([(None, 5, False), (5, 5, True), (None, 5, False), (None, None, True), (None, None, True), (8, 5, False), (None, None, True)], key=str)
    stay = near_dup.drop_near_copies(df, Join(k=3, percent=80)).collect()
    assert (5, near) in [(r.doc_id, r.text) for r in stay] and (8, base) not in [(r.doc_id, r.text) for r in stay]
