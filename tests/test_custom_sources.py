"""Sources by registered formats, in batch and as streams; spreading by size."""

from __future__ import annotations

import os

import pytest

from logsieve.operators import parse
from logsieve.plans import canonical_logs
from logsieve.sources import FileRange, LogfmtSource, LogIngestionError, LogSource, read_logs, register_source, spread
from logsieve.sources.custom import pack
from logsieve.streaming.run import drain


class Fixed(LogSource):
    """Records of 20 bytes: a format that may be entered at whole records only."""

    format = "fixed"
    SIZE = 20

    def ranges(self, path, first, last, length):
        step = 4 * self.SIZE
        return [FileRange(path, a, min(a + step, last), length) for a in range(first, last, step)]

    def rows(self, part):
        with part.open() as file:
            for at in range(part.first, part.last, self.SIZE):
                record = file.read_at(self.SIZE, at).decode()
                yield {"timestamp": "2031-04-02T08:00:00Z", "message": record.strip()}, at // self.SIZE


@pytest.fixture(scope="module")
def sources(spark):
    register_source(spark, LogfmtSource)
    register_source(spark, Fixed)


def write_lines(path, lines, end="\n"):
    path.write_bytes("".join(x + end for x in lines).encode())


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10**6])
def test_lines_of_ranges(tmp_path, size):
    """Every line is in exactly one range, whatever the cuts."""
    for lines, end in ((["a", "", "bb" * 40, "é漢", "last"], "\n"), (["x"], ""), ([], ""), (["", "", ""], "\n"), (["no end", "here"], "\n")):
        path = tmp_path / "f"
        write_lines(path, lines, end)
        data = path.read_bytes()
        got = [x for a in range(0, len(data), size) for x in FileRange(str(path), a, min(a + size, len(data)), len(data)).lines(chunk=5)]
        want, at = [], 0
        for line in data.split(b"\n")[: len(data.split(b"\n")) - data.endswith(b"\n") if data else 0]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ts=1 level=info msg=up", {"ts": "1", "level": "info", "msg": "up"}),
        ('msg="two words \\"q\\" \\\\ \\n" n=', {"msg": 'two words "q" \\ \n', "n": ""}),
        ("flag other=3", {"flag": "", "other": "3"}),
        ('é=漢 e=""', {"é": "漢", "e": ""}),
    ],
)
def test_logfmt(text, want):
    assert LogfmtSource.fields(text) == want


def test_batch_in_partitions(spark, sources, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder / "sub")
    rows = [f'ts=2031-04-02T08:{i // 60 % 60:02d}:{i % 60:02d}Z level=warn app=shop-{i % 3} msg="order {i} slow" duration={i}' for i in range(500)]
    write_lines(folder / "a.log", rows[:300])
    write_lines(folder / "sub" / "b.log", rows[300:])
    write_lines(folder / "_hidden", ["msg=no"])
    raw = read_logs(spark, str(folder), "logfmt", rangeBytes=2000)
    assert raw.rdd.getNumPartitions() > 10
    logs = canonical_logs(raw).collect()
    assert sorted(r.message for r in logs) == sorted(f"order {i} slow" for i in range(500))
    assert {r.level for r in logs} == {"WARNING"} and {r.service for r in logs} == {"shop-0", "shop-1", "shop-2"}
    assert {r.source_meta.format for r in raw.select("source_meta").distinct().collect()} == {"logfmt"}


def test_own_format_and_errors(spark, sources, tmp_path):
    (tmp_path / "r.bin").write_bytes(b"".join(f"record {i}".ljust(20).encode() for i in range(50)))
    raw = read_logs(spark, str(tmp_path / "r.bin"), "fixed")
    assert raw.rdd.getNumPartitions() == 13
    got = sorted((r.source_meta.idx, r.fields["message"]) for r in raw.collect())
    assert got == [(i, f"record {i}") for i in range(50)]
    assert parse.quality_report(parse.parse_logs(raw)).first().accepted == 50
    (tmp_path / "empty.bin").write_bytes(b"")
    assert read_logs(spark, str(tmp_path / "empty.bin"), "fixed").count() == 0
    with pytest.raises(LogIngestionError, match="not found"):
        read_logs(spark, str(tmp_path / "missing"), "fixed")
    with pytest.raises(LogIngestionError, match="unknown"):
        read_logs(spark, str(tmp_path), "nothing")


def test_stream_grows_with_its_files(spark, sources, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    write_lines(folder / "a.log", [f"ts=1 msg=a{i}" for i in range(20)])
    stream = spark.readStream.format("logfmt").load(str(folder))
    assert drain(stream, str(tmp_path / "out")).count() == 20
    with open(folder / "a.log", "ab") as f:
        f.write("".join(f"ts=1 msg=a{i}\n" for i in range(20, 30)).encode())
    write_lines(folder / "b.log", [f"ts=1 msg=b{i}" for i in range(5)])
    got = drain(stream, str(tmp_path / "out"))
    assert sorted(r.fields["msg"] for r in got.collect()) == sorted([f"a{i}" for i in range(30)] + [f"b{i}" for i in range(5)])


def test_spread_leaves_large_scans_alone(spark, tmp_path):
    spark.range(2000).selectExpr("id", "repeat('x', 100) AS t").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert spread(rows).rdd.getNumPartitions() > rows.rdd.getNumPartitions()
    assert spread(rows, most=100).rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_small_ranges_share_tasks(spark, sources, tmp_path):
    """Many small ranges are dealt to some hundred tasks; every line comes once."""
    write_lines(tmp_path / "a.log", [f"ts=1 msg=a{i}" for i in range(4000)])
    raw = read_logs(spark, str(tmp_path / "a.log"), "logfmt", rangeBytes=16)
    assert raw.rdd.getNumPartitions() <= 400
    assert sorted(r.m for r in raw.selectExpr("fields['msg'] AS m").collect()) == sorted(f"a{i}" for i in range(4000))
    parts = [FileRange("f", a, a + 10, 1000) for a in range(0, 1000, 10)]
    assert pack(parts) == [[p] for p in parts]
    packed = pack(parts, packs=10)
    assert len(packed) == 10 and [p for q in packed for p in q] == parts
    assert len(pack(parts, packs=1, most=50)) == 20 and len(pack(parts, packs=1, most=5)) == 100 and pack([]) == []


def test_a_range_reads_little_more_than_itself(tmp_path, monkeypatch):
    write_lines(tmp_path / "f", ["x" * 99] * 30_000)
    read, opened = [], FileRange.open

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            data = self.file.read(n)
            read.append(len(data))
            return data

    monkeypatch.setattr(FileRange, "open", lambda self: Counted(opened(self)))
    got = list(FileRange(str(tmp_path / "f"), 200_050, 260_050, 3_000_000).lines())
    assert len(got) == 600 and got[0][0] == 200_100 and sum(read) < 80_000
