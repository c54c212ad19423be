"""Data sources with splits and byte offsets."""

import io

import pytest

from swarmlake.sources import codecs, formats

KINDS = {"dump": codecs.write_dump, "frames": codecs.write_frame}


def entry(i, files=2):
    return {"infohash": i.to_bytes(4, "big") * 5, "name": f"näme {i} " + "x" * (i % 50), "size": i, "discovered_at": i * 3, "files": [(f"d/{k}", k) for k in range(i % (files + 1))]}


def names(df):
    return sorted(r["name"] for r in df.collect())


@pytest.mark.parametrize("kind", KINDS)
def test_cuts_stand_between_records(kind):
    records = [KINDS[kind](entry(i)) for i in range(1, 400)]
    ends = {0}
    for r in records:
        ends.add(max(ends) + len(r))
    raw = b"".join(records)
    for every in (1, 100, 5000, 1 << 30):
        found, cut = formats.cuts(io.BytesIO(raw + records[0][:30]), 0, kind, every)
        assert set(found) <= ends and found[0] == 0 and found[-1] == len(raw) and cut
        assert all(b - a >= min(every, len(raw)) for a, b in zip(found, found[1:-1]))
    inner = sorted(ends)[50]
    assert formats.cuts(io.BytesIO(raw), inner, kind, 300)[0][0] == inner
    bounded, _ = formats.cuts(io.BytesIO(raw), 0, kind, 100, 1000)
    assert 1000 <= bounded[-1] < 1300 and bounded[-1] in ends


def test_one_large_dump_is_read_in_splits(spark, tmp_path):
    """A file that another program wrote as a whole: many tasks, every record once; places left by a job are used."""
    formats.register(spark)
    raw = b"".join(codecs.write_dump(entry(i)) for i in range(1, 3000))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/one.bin").write_bytes(raw + b"short hash")
    (tmp_path / "d/small.bin").write_bytes(codecs.write_dump(entry(5000)))
    path = f"file://{tmp_path}/d"
    read = lambda: spark.read.format("swarm_dump").option("splitBytes", 20_000).load(path)
    want = sorted(entry(i)["name"] for i in [*range(1, 3000), 5000])
    assert names(read()) == want
    assert read().rdd.getNumPartitions() >= len(raw) // 21_000
    assert formats.write_offsets(spark, path, 20_000) == 1
    assert formats.DumpReader({"path": path, "splitBytes": "20000"})._known()
    assert names(read()) == want and read().rdd.getNumPartitions() >= len(raw) // 21_000
    got = {r["name"]: r for r in read().collect()}[entry(8)["name"]]
    assert [(f["path"], f["size"]) for f in got["files"]] == entry(8)["files"] and got["discovered_at"] == max(0, entry(8)["discovered_at"])


def test_a_cut_dump_fails(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "x.bin").write_bytes(codecs.write_dump(entry(1)) * 50 + codecs.write_dump(entry(2))[:30])
    for split in (100, 1 << 20):
        with pytest.raises(Exception, match="Truncated|inside a record"):
            spark.read.format("swarm_dump").option("splitBytes", split).load(str(tmp_path / "x.bin")).count()


def test_empty_folder(spark, tmp_path):
    formats.register(spark)
    for name in ("swarm_dump", "swarm_frames"):
        assert spark.read.format(name).load(f"file://{tmp_path}").count() == 0


def test_frames_resume_inside_a_file(spark, tmp_path):
    """A run that stops halfway goes on inside the file; what is appended later, a cut frame included, comes once."""
    formats.register(spark)
    where, out = tmp_path / "in", f"file://{tmp_path}/rows"
    where.mkdir()
    frames = [codecs.write_frame(entry(i)) for i in range(1, 601)]
    (where / "a").write_bytes(b"".join(frames[:400]))

    def run(times=1, fail_at=None):
        def keep(batch, n):
            batch.write.mode("overwrite").parquet(f"{out}/{n}")
            if n == fail_at:
                raise ConnectionError("cut off")

        for _ in range(times):
            stream = spark.readStream.format("swarm_frames").option("bytesPerBatch", 10_000).option("splitBytes", 3000).load(f"file://{where}")
            q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/state").start()
            try:
                q.processAllAvailable()
            except Exception:
                assert fail_at is not None
            finally:
                q.stop()
        return spark.read.option("recursiveFileLookup", True).parquet(out).count()

    assert 100 < run(fail_at=1) < 350  # it stands inside the file now, in a batch that was not committed
    assert len(list((tmp_path / "rows").iterdir())) == 2
    assert run() == 400
    with (where / "a").open("ab") as f:
        f.write(b"".join(frames[400:500]) + frames[500][:17])
    (where / "b").write_bytes(b"".join(frames[501:]) + b"\0\0")
    assert run() == 599
    with (where / "a").open("ab") as f:
        f.write(frames[500][17:] + b"\0\0")
    assert run(2) == 600
    want = sorted(entry(i)["name"] for i in range(1, 601))
    assert names(spark.read.option("recursiveFileLookup", True).parquet(out)) == want
    for split in (3000, 1 << 20):
        whole = spark.read.format("swarm_frames").option("splitBytes", split).load(f"file://{where}")
        assert names(whole) == want and (split > 3000 or whole.rdd.getNumPartitions() > 5)


def test_frames_are_made_and_read_by_the_column(spark, tmp_path):
    """Frames of built-in expressions are those of `write_frame`, byte for byte, and columns those of `read_frames`."""
    from swarmlake.sources import datasource, sink

    long, many = "é" * 40_000, [(f"p{i}", i) for i in range(70_000)]
    found = [(b"\1" * 20, "a", 0, 0, []), (b"\2" * 20, long, (1 << 50) + 5, (1 << 32) - 1, [(long, 1 << 62), ("", 0), ("b/ü", 7)]), (b"\3" * 20, "many", 3, 4, many)]
    rows = spark.createDataFrame([*found, (b"\4" * 20, "", 1, 1, []), (b"\5" * 20, None, 1, 1, [])], datasource.DUMP).coalesce(1)
    want = b"".join(codecs.write_frame({"infohash": h, "name": n, "size": s, "discovered_at": t, "files": f}) for h, n, s, t, f in found)
    plan = rows.select(sink.frame())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    sink.write_frames(rows, f"file://{tmp_path}/f")
    (made,) = (tmp_path / "f").glob("part-*")
    assert made.read_bytes() == want + b"\0\0"
    for size in (1, 2, 5000):
        got = [r for b in datasource.frame_batches(made.read_bytes() + b"behind", size) for r in b.to_pylist()]
        assert [r | {"files": [(f["path"], f["size"]) for f in r["files"]]} for r in got] == list(codecs.read_frames(want))
    whole = codecs.write_frame({"infohash": b"\1" * 20, "name": "a", "size": 0, "discovered_at": 0, "files": [("x", 1)]})
    for n in range(1, len(whole)):
        with pytest.raises(codecs.Truncated):
            list(codecs.read_frame_columns(whole[:n], 10))
    for broken in ((b"\1" * 20, "a", 1, -1, []), (b"\1" * 20, "a", 1, 1 << 32, []), (None, "a", 1, 1, []), (b"\1" * 20, "a", 1, 1, [(None, 1)]), (b"\1" * 20, "a", 1, 1, [("x", None)])):
        with pytest.raises(Exception, match="a frame has no null|32 bits"):
            spark.createDataFrame([broken], datasource.DUMP).select(sink.frame()).collect()
