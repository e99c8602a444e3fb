"""The merge as a sink (S16): only changed partitions are written, replays and failures do no harm, NULLs are filled, amounts never change."""

import random
from pathlib import Path

import pytest
from ledgerloom.sources import merge as G

ROW = "id long, day string, model string, total long"


def files(path):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(path, "rows").rglob("*.parquet")}


def stored(spark, path):
    return sorted((tuple(r) for r in spark.read.schema(ROW).parquet(f"{path}/rows").select("id", "day", "model", "total").collect()), key=repr)


def test_batches_against_a_dictionary(spark, tmp_path):
    rng, path, held = random.Random(5), str(tmp_path / "table"), {}
    day = lambda i: None if i % 12 == 11 else f"2024-01-{i % 12 + 1:02}"
    for number in range(6):
        ids = [rng.randrange(200) for _ in range(60)] if number % 2 else [i for i in range(200) if day(i) in ("2024-01-03", None)]
        batch = [(i, day(i), rng.choice([None, f"m{rng.randrange(3)}"]), rng.randrange(1000)) for i in ids]
        G.merge_events(spark.createDataFrame(batch, ROW), path, "id", ["model"], "day", number)
        first = {}
        for r in sorted(batch, key=lambda r: (r[0], r[2] is not None, r[2] or "", r[3])):
            first.setdefault(r[0], r)
        for i, r in first.items():
            held[i] = r if i not in held else (*held[i][:2], held[i][2] or r[2], held[i][3])
        assert stored(spark, path) == sorted(held.values(), key=repr)


def test_only_changed_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(i, f"d{i % 20}", None if i % 2 else "m", i) for i in range(2_000)]
    assert len(G.merge_events(spark.createDataFrame(rows, ROW), path, "id", ["model"], "day", 0)) == 20
    before = files(path)
    assert G.merge_events(spark.createDataFrame([(5000, "d7", "m", 1), (3, "d3", "x", 99), (4, "d4", "x", 99)], ROW), path, "id", ["model"], "day", 1) in (["d7", "d3"], ["d3", "d7"])
    after = files(path)
    assert {f.split("day=")[1].split("/")[0] for f in after.keys() ^ before.keys()} == {"d3", "d7"}  # d4's row was known and whole
    assert {(r.part, r.new_rows, r.repaired_rows) for r in G.merged_batches(spark, path).where("batch = 1").collect()} == {("d7", 1, 0), ("d3", 0, 1)}
    assert G.merge_events(spark.createDataFrame([(9, "d9", "new", 1)], ROW), path, "id", ["model"], "day", 1) == []  # the number is known
    assert G.merge_events(spark.createDataFrame(rows, ROW), path, "id", ["model"], "day", 2) == []  # all rows are known
    assert files(path) == after
    assert (3, "d3", "x", 3) in stored(spark, path)


def test_a_batch_that_failed_is_merged_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    batch = spark.createDataFrame([(i, f"d{i % 3}", None, i) for i in range(30)], ROW)
    G.merge_events(batch.where("id < 10"), path, "id", ["model"], "day", 0)
    real = spark.createDataFrame

    def lost(*a, **k):
        raise RuntimeError("lost")

    monkeypatch.setattr(type(spark), "createDataFrame", lost)  # after the rows, before the note
    with pytest.raises(RuntimeError, match="lost"):
        G.merge_events(batch, path, "id", ["model"], "day", 1)
    monkeypatch.undo()
    assert real is not None and G.merge_events(batch, path, "id", ["model"], "day", 1) == []
    assert len(stored(spark, path)) == 30 and G.merged_batches(spark, path).where("batch = 1").count() == 1


def test_in_a_stream(spark, tmp_path):
    source, state, path = (str(tmp_path / n) for n in ("source", "state", "table"))
    for part in ([(1, "a", None, 1), (2, "b", "m", 2)], [(1, "a", "late", 7), (3, "b", None, 3)], [(2, "b", "other", 9)]):
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(source)
        spark.readStream.schema(ROW).parquet(source).writeStream.foreachBatch(G.merge_sink(path, "id", ["model"], "day")).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert stored(spark, path) == [(1, "a", "late", 1), (2, "b", "m", 2), (3, "b", None, 3)]
