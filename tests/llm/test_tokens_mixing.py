"""Tokenizer, packing (10), separator scan (5), mixing (3), pipeline."""

from __future__ import annotations

import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logsieve.llm import mixing, packing, token_scan, tokens
from logsieve.llm.mixing import Mix
from logsieve.llm.packing import Capacity
from logsieve.llm.tokens import Encoder, blocks, tokenizer_path
from .conftest import prose

PARTS = ["'s", "'t", "'re", "'ll", "'S", "'", " ", "  ", "\n", "\r\n", "\t", "a", "B", "é", "1", "22", "½", "\xa0", "　", "漢", "😀", "!", "...", '"', "don't", "<|endoftext|>", "\x1c", "\x85", "_", "٣"]


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|>x", "x<|endoftext|>", "<|endoftext|><|endoftext|>", " <|endoftext|>  <|endoftext|>\n", "<|endoftext", "|>"]


class Plain:
    """The tokenizer file as it is, and with special strings as ordinary text."""

    def __init__(self):
        from tokenizers import Tokenizer

        self.tokenizer, self.ordinary = Tokenizer.from_file(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
        self.ordinary.encode_special_tokens = True


@pytest.fixture(scope="module")
def encoder():
    return Plain()


@pytest.mark.parametrize("ordinary", [False, True])
def test_encoder_equals_tokenizer(encoder, ordinary):
    r = random.Random(1)
    texts = ["".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(5000)] + [prose(1, 500), "x" * 5000, "", *SPECIAL]
    own = Encoder(tokenizer_path(), ordinary)
    for block in blocks(pa.array(texts), 10_000):
        ids, bounds = own.encode(block)
        plain = (encoder.ordinary if ordinary else encoder.tokenizer).encode_batch(block.to_pylist(), add_special_tokens=False)
        for i, want in enumerate(plain):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want.ids


def brute_pieces(encoder, text, most=1024):
    ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    first = len(ids) % most or most
    cuts = [0, *range(first, len(ids), most)]
    return [(k, a, ids[a:z]) for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True))]


def test_packing(docs, encoder):
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(3000 + i, x) for i, x in enumerate(SPECIAL)], "doc_id long, text string"))
    got = packing.pack_documents(docs, with_ids=True).collect()
    want = sorted((r.doc_id, *p) for r in docs.collect() for p in brute_pieces(encoder, r.text))
    assert sorted((r.doc_id, r.piece, r.start, list(r.ids)) for r in got) == want
    bins: dict = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_best_fit_keeps_every_limit(choose):
    r = np.random.default_rng(3)
    lengths = r.integers(1, 101, 2000)
    cap = Capacity(tokens=100, documents=4, cost=6000 if choose == "dot" else 10_000, choose=choose)
    lengths = np.minimum(lengths, int(cap.cost**0.5))
    where, offset = packing.best_fit(lengths, cap)
    for b in range(where.max() + 1):
        mine = lengths[where == b]
        assert mine.sum() <= 100 and len(mine) <= 4 and (mine.astype(int) ** 2).sum() <= cap.cost
    assert len(set(zip(where.tolist(), offset.tolist(), strict=True))) == len(lengths)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), cap)


def test_best_fit_is_tight():
    lengths = np.random.default_rng(4).integers(1, 1025, 5000)
    where, _ = packing.best_fit(lengths, Capacity())
    assert where.max() + 1 <= -(-lengths.sum() // 1024) * 1.02


def plain_best_fit(lengths, cap):
    """Sequence of each length: every open sequence is scored for every piece."""
    limits = (cap.tokens, cap.documents, cap.cost)
    weights = [w / x**2 for w, x in zip(cap.weights, limits, strict=True)]
    opened, where = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        demand = (lengths[i], 1, lengths[i] ** 2)
        best = None
        for k, has in enumerate(opened):
            if all(r >= d for r, d in zip(has, demand, strict=True)):
                if cap.choose == "norm":
                    score = sum(w * (r - d) ** 2 for w, r, d in zip(weights, has, demand, strict=True))
                else:
                    score = -sum(w * r * d for w, r, d in zip(weights, has, demand, strict=True))
                best = min(best, (score, k)) if best else (score, k)
        if best is None:
            opened.append(limits)
            best = (0, len(opened) - 1)
        where[i] = best[1]
        opened[best[1]] = tuple(r - d for r, d in zip(opened[best[1]], demand, strict=True))
    return where


@pytest.mark.parametrize("choose", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(1024, 1024, 1024**2), (100, 4, 4000), (60, 3, 3600), (50, 10**6, 2500)])
@pytest.mark.parametrize("kind", ["spread", "ties", "one length"])
def test_best_fit_equals_scoring_every_sequence(choose, limits, kind):
    r = np.random.default_rng(len(kind) + limits[0])
    most = min(limits[0], int(limits[2] ** 0.5))
    lengths = {"spread": r.integers(1, most + 1, 300), "ties": r.choice([most // 2, most // 3, 5, 1], 300), "one length": np.full(40, most // 4)}[kind]
    cap = Capacity(*limits, choose=choose)
    where, offset = packing.best_fit(lengths, cap)
    assert where.tolist() == plain_best_fit(lengths.tolist(), cap)
    for s in set(where.tolist()):
        inside = sorted(zip(offset[where == s].tolist(), lengths[where == s].tolist(), strict=True))
        assert [a for a, _ in inside] == [sum(n for _, n in inside[:i]) for i in range(len(inside))]


def test_packing_many_pieces_in_one_partition():
    """Time in proportion to the pieces, and few sequences beyond the lower bound."""
    r = np.random.default_rng(1)
    for n in (50_000, 200_000):
        lengths = r.integers(1, 1025, n)
        began = time.process_time()
        where, _ = packing.best_fit(lengths, Capacity())
        assert time.process_time() - began < n / 10_000
        assert where.max() + 1 <= 1.005 * -(-lengths.sum() // 1024)


def test_wide_vocabularies_need_wide_ids(spark, tmp_path):
    """The kind of id follows the vocabulary's size, and ids over 65,535 are counted whole."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {"[UNK]": 0} | {f"w{i}": i for i in range(1, 100_000)}
    made = Tokenizer(models.WordLevel(words, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "wide.json")
    made.save(path)
    assert token_scan.id_type(path, 5) == "<u4" and token_scan.id_type() == "<u2" and token_scan.id_type(end_id=70_000) == "<u4"
    end = 65_535  # what 131,071 would become in two bytes
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    ids = {"a": [99_999, 65_537, 70_000], "b": [1] * 500, "": []}
    texts = rows.replace({"a": " ".join(f"w{i}" for i in ids["a"]), "b": " ".join(["w1"] * 500)}, subset="text")
    blocks = token_scan.scan_blocks(wide_shards(texts, path, end), "<u4", end)
    counts = sorted(r.n_tokens for r in token_scan.stitch(blocks).collect())
    assert counts == [0, 3, 500]


def wide_shards(texts, path, end):
    """Blocks of 64 ids of four bytes each of all texts in one shard."""
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(path).encode
    ids = np.array([x for r in texts.collect() for x in [*encode(r.text or "").ids, end]], "<u4").tobytes()
    rows = [("s", i, ids[256 * i : 256 * i + 256]) for i in range(-(-len(ids) // 256))]
    return texts.sparkSession.createDataFrame(rows, "shard string, block bigint, data binary")


def test_narrow_ids_fail(spark, docs):
    with pytest.raises(Exception, match="an id exceeds"):
        token_scan.token_shards(docs, end_id=70_000, dtype="<u2").collect()
    wide = token_scan.token_shards(docs, dtype="<u4", block_tokens=100)
    narrow = token_scan.token_shards(docs, dtype="<u2", block_tokens=100)
    count = lambda rows, dtype: sorted(r.n_tokens for r in token_scan.stitch(token_scan.scan_blocks(rows, dtype).where("block IS NOT NULL")).collect())
    assert count(wide, "<u4") == count(narrow, "<u2")


def test_packing_does_not_depend_on_partitions(spark):
    rows = [(i, prose(i, 20 + i * 37 % 160)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 60):
        got = packing.pack_documents(docs.repartition(n), with_ids=True).collect()
        assert len(got) == len({(r.doc_id, r.piece) for r in got}) and len({r.doc_id for r in got}) == 600
        ends: dict = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends.get(r.sequence_id, 0) and r.length == len(r.ids)
            ends[r.sequence_id] = r.offset + r.length
        least = -(-sum(r.length for r in got) // 1024)
        assert max(ends.values()) <= 1024 and len(ends) <= least + 1


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_separator_scan_of_files(spark, tmp_path, block_bytes):
    r = random.Random(9)
    want = {}
    for name in range(4):
        lengths = [r.choice([0, 1, 5, 40]) for _ in range(r.randint(0, 30))]
        ids = [x for n in lengths for x in [*r.choices(range(1000), k=n), token_scan.END_ID]]
        tail = r.choice([0, 7])
        ids += [3] * tail
        np.array(ids, "<u2").tofile(tmp_path / f"shard-{name}.bin")
        want[f"shard-{name}.bin"] = [(n, True) for n in lengths] + [(tail, False)] * (tail > 0)
    found = token_scan.read_token_files(spark, str(tmp_path), block_bytes, 3 * block_bytes)
    for group in (2, 1024):
        got: dict = {k: [] for k in want}
        for x in token_scan.stitch(token_scan.scan_blocks(found), group).orderBy("shard", "ordinal").collect():
            got[x.shard.rsplit("/", 1)[-1]].append((x.n_tokens, x.complete))
        assert got == want


def test_token_file_of_more_than_two_gigabytes(spark, tmp_path):
    name, size = tmp_path / "large file.bin", (1 << 31) + (5 << 20)
    with open(name, "wb") as f:
        for at in (6, 1 << 31, size - 4):
            f.seek(at)
            f.write(np.array([token_scan.END_ID, 9], "<u2").tobytes())
    got = token_scan.count_tokens(token_scan.read_token_files(spark, str(name), 8 << 20, 64 << 20)).orderBy("ordinal").collect()
    assert [(r.n_tokens, r.complete) for r in got] == [(3, True), ((1 << 30) - 4, True), ((5 << 19) - 3, True), (1, False)]
    with pytest.raises(ValueError):
        token_scan.read_token_files(spark, str(name), 3)


def test_token_counts_of_documents(spark, docs, encoder, tmp_path):
    docs = docs.unionByName(docs.sparkSession.createDataFrame([(3000 + i, x) for i, x in enumerate(SPECIAL)], "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_tokens) for r in token_scan.op5_separator_scan(spark, str(tmp_path)).collect())
    assert got == sorted((r.doc_id, len(encoder.ordinary.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert token_scan.count_tokens(token_scan.token_shards(docs.where("false"))).count() == 0


def test_memo_forgets_rare_pieces_only(encoder, monkeypatch):
    """A memo that overflows at every few texts gives the same ids, stays within its bound and keeps what texts share."""
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 200)
    small = tokens.Encoder(tokenizer_path())
    texts = [f"{prose(i, 40)} zq{i * 7919} {'long' * 20}{i} 漢字{i}" * (1 + i % 2) for i in range(120)] + [""]
    most = 0
    for text in texts:
        ids, _ = small.encode(pa.array([text]))
        assert list(ids) == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        most = max(most, small.n)
    distinct = 150  # pieces of a text, at most
    assert most <= 200 + distinct and len(small.slots) <= small.n
    assert max(small.uses[: small.n]) > 1 and any(p.startswith(b" ka") for p in small.slots)


def mixed(spark, sizes, mix):
    rows = [(f"{s}-{i}", s, prose(i, 5 + i % 7)) for s, n in sizes.items() for i in range(n)]
    return rows, mixing.mix_sources(spark.createDataFrame(rows, "doc_id string, source string, text string"), mix)


def test_mixing_covers_every_document(spark):
    sizes = {"big": 300, "mid": 60, "small": 20}
    rows, got = mixed(spark, sizes, Mix(entropy=None, repeats=3.0))
    counts = {r.source: r for r in got.groupBy("source").agg(F.count_distinct("doc_id").alias("docs"), F.sum("n_tokens").alias("t")).collect()}
    natural = {s: sum(len(t.split()) for _, x, t in rows if x == s) for s in sizes}
    assert {s: counts[s].docs for s in sizes} == sizes
    epochs = {s: counts[s].t / natural[s] for s in sizes}
    assert epochs["big"] == 1 and 1 < epochs["mid"] < epochs["small"] and 2.8 <= epochs["small"] <= 3.0
    assert got.groupBy("doc_id", "block").count().where("count > 1").count() == 0


def test_mixing_entropy_and_budget(spark):
    sizes = {"big": 300, "mid": 60, "small": 20}
    rows, got = mixed(spark, sizes, Mix(entropy=0.9, repeats=100.0, budget=2000))
    t = np.array([r.t for r in got.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()], float)
    p = t / t.sum()
    assert 1900 <= t.sum() <= 2000 and abs(-(p * np.log(p)).sum() / np.log(3) - 0.9) < 0.02


def test_mixing_cases(docs, empty):
    got = mixing.mix_sources(docs)
    assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "keep_id", "host", "block", "place", "n_tokens"]
    assert got.where("block = 0").count() == docs.count()
    assert mixing.mix_sources(empty).count() == 0
    blank = docs.withColumn("text", F.lit(""))
    assert mixing.mix_sources(blank).count() == docs.count()
    first = mixing.in_order(got).where("block = 0").select("place").collect()
    assert len(first) == docs.count()


def test_mixing_long_texts_and_equal_ids_at_a_cut(spark):
    """A text as long as all others is one row; rows of equal ids are taken or left together where a block is cut."""
    rows = [(i // 2, "word " * 5, "small") for i in range(40)] + [(100, "word " * 200_000, "long"), (101, "x", "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix_sources(docs, Mix(entropy=None, repeats=2.5))
    draws = {(r.source, r.doc_id, r.block): r["count"] for r in got.groupBy("source", "doc_id", "block").count().collect()}
    assert {n for (s, _, _), n in draws.items() if s == "small"} == {2}  # both rows of an id, or none
    assert sum(1 for s, _, b in draws if s == "small" and b == 0) == 20 and any(b for s, _, b in draws if s == "small")
    (long,) = [r for r in got.where("doc_id = 100").collect()]
    assert long.n_tokens == 200_000 and long.block == 0


@pytest.mark.parametrize("digits", [1, 2, 3, 5, 6])
def test_mixing_edge_in_two_levels(spark, digits):
    """The first bucket that doesn't fit, against a plain running sum: budgets at bucket ends, of nothing, of all and beyond."""
    r = random.Random(digits)
    names = sorted({"".join(r.choices("0123456789abcdef", k=digits)) for _ in range(400)})
    sums, want = [], {}
    for s in range(12):
        held = [(b, r.choice([0, 1, 7, 400])) for b in names if r.random() < 0.7]
        total = sum(t for _, t in held)
        rest = [1, total, total + 5, sum(t for _, t in held[: len(held) // 2])][s % 4] if s < 8 else r.randint(1, total)
        sums += [(f"s{s}", b, t, rest) for b, t in held]
        before = 0
        for b, t in held:
            if before + t > rest:
                want[f"s{s}"] = (b, before)
                break
            before += t
    table = spark.createDataFrame(sums, "src string, bucket string, t long, rest long").repartition(5)
    for sources in (12, mixing.BROADCAST_SOURCES + 1):
        got = mixing._edge(table, digits, sources)
        assert {x.src: (x.edge, x.before) for x in got.select("src", "edge", "before").collect()} == want


def test_separator_scan_of_a_document_over_several_blocks(spark, tmp_path, encoder):
    """A document of more ids than two blocks of the query have."""
    texts = {1: "short one", 2: " ".join(f"w{i % 977}x" for i in range(60_000)), 3: None, 4: "tail"}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_tokens for r in token_scan.op5_separator_scan(spark, str(tmp_path)).collect()}
    assert got == {i: len(encoder.ordinary.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    assert got[2] > 2 * token_scan.BLOCK_TOKENS


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    rows, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, rows, str(tmp_path)).write.parquet(out)
        rows = spark.read.parquet(out)
        ids.append({r.doc_id for r in rows.select("doc_id").collect()})
        if k < 4:
            assert rows.columns == corpus_pipeline.COLUMNS
    assert {0, 1, 2, 3, 10, 16} <= ids[0] and not ids[0] & {4, 5, 6, 7, 9, 13, 14, 15}
    assert 1 not in ids[1] and 2 in ids[1] and len(ids[1] & set(range(100, 140))) == 1
    assert 2 not in ids[2] and ids[2] == ids[3] == ids[4]
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in total.select("doc_id").distinct().collect()} == ids[4]
    assert total.count() == rows.count()


def test_pipeline_of_awkward_tables(spark, docs, tmp_path):
    import corpus_pipeline

    docs.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    odd = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") == 3, None).otherwise(F.col("doc_id")))
    odd.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = [r.doc_id for r in got.where("piece = 0").select("doc_id", "ids_crc32", "length").distinct().collect()]
    assert {0, 10, 16, None} <= set(ids) and not {4, 5, 6, 13} & set(ids) and len(ids) == len(set(ids))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_url_filter", "op3_temperature_mixing", "op6_content_sort", "op8_line_rules"])
def test_oracles(spark, name):
    import duckdb

    from logsieve.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in result.fetchall())
