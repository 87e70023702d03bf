"""JSON arrays read by ranges, against the standard reader."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from logsieve.sources import arrays
from logsieve.sources.logs import read_json_logs


def awkward(r: random.Random):
    texts = ["", "plain", 'quote " inside', "back\\slash", "\\\\", '\\"', "[1, {", "}],", "a,b", "é漢😀", "\n\t", "x" * r.randint(0, 60)]
    kind = r.randrange(7)
    if kind == 0:
        return r.choice([3, -1.5, True, None, "only text, with ] and \"", [], [[1, [2]], {"a": ","}]])
    return {r.choice(texts) + str(i): r.choice([r.choice(texts), i, None, [r.choice(texts)], {"in": r.choice(texts)}]) for i in range(r.randrange(4))}


def whole(text: bytes, size: int) -> list[tuple[int, object]]:
    """Items by ranges of ``size`` bytes, states by composing summaries in groups of three."""
    import pyarrow as pa

    file = pa.BufferReader(text)
    cuts = range(0, len(text), size)
    found, before = [], None
    for at in cuts:
        state, depth, marks, item = OUT if before is None else (before[0][0], before[0][1], before[0][2], before[0][3].get(1, 0))
        row = {"name": "f", "path": "f", "length": len(text), "at": at, "size": min(size, len(text) - at), "state": state, "depth": depth, "marks": marks, "item": item}
        found += arrays.items_of(file, row, chunk=7)
        one = arrays.summary(text[at : at + size])
        before = one if before is None else arrays.compose(before, one)
    return found


OUT = (arrays.OUTSIDE, 0, 0, 0)


@pytest.mark.parametrize("seed", range(12))
def test_ranges_of_any_size_give_the_items(seed):
    r = random.Random(seed)
    items = [awkward(r) for _ in range(r.choice([0, 1, 2, 30]))]
    text = json.dumps(items, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 2]), separators=r.choice([None, (",", ":")])).encode()
    text = r.choice([b"", b"\xef\xbb\xbf", b" \n"]) + text + r.choice([b"", b"\n "])
    for size in (1, 2, 3, 5, 8, 64, 10**6)[2 if text[0] == 0xEF else 0 :]:  # a byte-order mark is in the first range
        got = whole(text, size)
        assert [i for i, _ in got] == list(range(len(items)))
        assert [json.loads(v) for _, v in got] == items


INVALID = ["[", "[1", "[1,]", "[,1]", "[1,,2]", "[1}", "[{]", "[1] 2", "[1][2]", "[\"a]", "[{\"a\": 1]", "[1]]", "[{}}"]


@pytest.mark.parametrize("text", INVALID)
@pytest.mark.parametrize("size", [1, 3, 100])
def test_broken_structure_fails(text, size):
    with pytest.raises(arrays.InvalidArray):
        whole(text.encode(), size)


@pytest.mark.parametrize("text", ["[foo]", "[{\"a\": }]", "[1 2]", "[{\"a\": 1}x]", "[tru]", *INVALID[:4]])
def test_invalid_files_are_fatal(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="invalid JSON array"):
        read_json_logs(spark, str(tmp_path / "a.json")).collect()


def test_one_file_in_many_tasks(spark, tmp_path):
    r = random.Random(1)
    items = [{"n": i, "msg": 'a, "b" [' + "x" * r.randint(0, 300)} if i % 7 else r.choice([1, "s, t", None, [{}]]) for i in range(3000)]
    (tmp_path / "one line.json").write_text(json.dumps(items))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({"n": i, "msg": "l"}) for i in range(50)))
    with gzip.open(tmp_path / "packed.json.gz", "wt") as f:
        f.write(json.dumps([{"n": i, "msg": "z"} for i in range(40)]))
    rows = read_json_logs(spark, str(tmp_path), range_bytes=4096)
    got = sorted((r.source_meta.source.rsplit("/", 1)[1][:2], r.source_meta.idx, r.fields["n"], r.fields["msg"]) for r in rows.where("source_meta.idx IS NOT NULL").collect())
    want = [("on", i, str(i), x["msg"]) for i, x in enumerate(items) if isinstance(x, dict)] + [("pa", i, str(i), "z") for i in range(40)]
    assert got == sorted(want)
    assert rows.where("source_meta.format = 'ndjson'").count() == 50
    files = arrays.list_files(spark, str(tmp_path)).where("path LIKE '%line.json'")
    states = arrays.range_states(files, 4096, group=5).orderBy("at").collect()
    assert len(states) > 100 and {s.state for s in states} >= {0, 1}
    again = arrays.read_items(files, 4096, group=5)
    assert again.count() == 3000 and again.agg({"idx": "max"}).first()[0] == 2999
    assert again.rdd.getNumPartitions() > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_light_rows_of_ranges_keep_their_tasks(spark, tmp_path):
    """Names and places of ranges are few bytes, by which adaptive execution would give all of the reading to one task."""
    for i in range(30):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"n": j, "msg": "x" * 50} for j in range(40)]))
    files = arrays.list_files(spark, str(tmp_path))
    rows = arrays.read_items(files, 256, group=3)
    assert rows.count() == 1200
    assert rows.select(F.spark_partition_id()).distinct().count() > 4
    assert arrays._tasks(files, 1 << 20) <= 30 and arrays._tasks(files.where("false"), 256) == 1


def test_batches_share_files(spark, tmp_path):
    """Array files hold many batches, with ids left out; places count inside a batch."""
    from logsieve import queries

    ids = [i for i in range(0, 70_000, 7) if i // 500 not in (3, 64)] + [31_999, 32_001]
    rows = spark.createDataFrame([(i,) for i in ids], "event_id bigint").selectExpr(
        "event_id", "timestamp_ntz '2024-01-01 00:00:00' AS ts", "'click' AS event_type", "'{\"k\": 1}' AS props"
    )
    rows.write.parquet(str(tmp_path / "events.parquet"))
    queries._array_files(spark, str(tmp_path), str(tmp_path / "files"))
    names = sorted((tmp_path / "files").glob("file=*/*.txt"))
    assert len(names) == 3 and sum(len(json.loads(n.read_text())) for n in names) == len(ids)
    seen, want = {}, []
    for i in sorted(ids):
        want.append((i // 500, seen.setdefault(i // 500, 0), i))
        seen[i // 500] += 1
    got = queries.json_array_items(spark, str(tmp_path)).select("batch", "idx", "event_id").collect()
    assert sorted(map(tuple, got)) == want
