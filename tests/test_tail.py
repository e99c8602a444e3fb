"""The tail of growing logs (T1): appended, truncated and replaced files over restarts and failed batches, against what the files hold."""

import json
import random

import pytest
from ledgerloom.sources.event_log import parse_lines
from ledgerloom.streaming import tail as T
from pyspark.sql import functions as F


def line(kind, n):
    return json.dumps({"type": "event_msg", "payload": {"type": kind, "n": n}})


class Logs:
    """A folder of logs and a stream over it that stops after each run."""

    def __init__(self, spark, tmp_path):
        self.spark, self.folder, self.tables = spark, tmp_path / "logs", str(tmp_path / "tables")
        self.state, self.planned = str(tmp_path / "state"), str(tmp_path / "planned")
        self.folder.mkdir()
        self.n = 0

    def lines(self, many):
        out = ""
        for _ in range(many):
            self.n += 1
            out += line(["token_count", "compacted", "turn_context"][self.n % 3], self.n) + "\n"
        return out

    def write(self, name, text, mode="a"):
        path = self.folder / name
        path.parent.mkdir(exist_ok=True)
        with path.open(mode, newline="") as f:
            f.write(text)

    def run(self, fail_after=None):
        of = lambda *names: lambda df: parse_lines(df, "generation").where(F.col("nested").isin(*names))
        made = {"ledger": of("token_count"), "evidence": of("compacted", "turn_context")}
        if fail_after:
            def broken(df):
                raise RuntimeError("lost")
            made = {"ledger": made["ledger"], fail_after: broken}
        sink = T.write_together(self.tables, made)
        q = T.stream_tail(self.spark, str(self.folder), self.planned).writeStream.foreachBatch(sink).option("checkpointLocation", self.state).trigger(availableNow=True).start()
        if fail_after:
            with pytest.raises(Exception, match="lost"):
                q.awaitTermination()
        else:
            q.awaitTermination()

    def check(self):
        want = {"ledger": [], "evidence": []}
        for path in sorted(p for p in self.folder.rglob("*") if p.is_file()):
            at = 0
            for raw in path.read_bytes().splitlines(keepends=True):
                if raw.endswith(b"\n"):
                    kind = json.loads(raw)["payload"]["type"]
                    want["ledger" if kind == "token_count" else "evidence"].append((str(path.relative_to(self.folder)), at, raw.decode().rstrip("\r\n")))
                at += len(raw)
        for name, rows in want.items():
            got = sorted((r.file, r.ordinal, r.value) for r in T.committed(self.spark, self.tables, name).collect())
            assert got == sorted(rows), name


def test_growth_truncation_and_replacement_over_restarts(spark, tmp_path):
    logs = Logs(spark, tmp_path)
    for name in ("a.jsonl", "b.jsonl", "sub/c.jsonl", "d.jsonl"):
        logs.write(name, logs.lines(20))
    logs.write("empty.jsonl", "")
    logs.run()
    logs.check()
    logs.write("a.jsonl", logs.lines(5) + line("token_count", 0)[:20])  # appended, its last line not yet whole
    logs.write("b.jsonl", logs.lines(3), "w")  # truncated
    logs.write("new.jsonl", logs.lines(4))
    logs.run()
    assert T.committed(spark, logs.tables, "ledger").where("file = 'b.jsonl'").select("generation").distinct().collect()[0][0] == 1
    logs.check()
    logs.write("a.jsonl", line("token_count", 0)[20:] + "\n")  # the rest of that line
    logs.write("sub/c.jsonl", logs.lines(40), "w")  # replaced by a longer one
    logs.write("b.jsonl", logs.lines(30))  # the second generation grows past the first one's length
    logs.write("d.jsonl", "", "w")  # emptied
    logs.run()
    logs.check()
    logs.run()  # nothing new
    logs.check()
    assert not T.committed(spark, logs.tables, "ledger").where("file = 'd.jsonl'").count()


def test_a_batch_that_fails_between_its_tables_shows_nowhere(spark, tmp_path):
    logs = Logs(spark, tmp_path)
    logs.write("a.jsonl", logs.lines(30))
    logs.run()
    logs.write("a.jsonl", logs.lines(30))
    logs.write("b.jsonl", logs.lines(30))
    before = T.committed(spark, logs.tables, "ledger").count()
    logs.run(fail_after="evidence")  # the ledger of the batch is written, its evidence is not
    assert T.committed(spark, logs.tables, "ledger").count() == before
    logs.run()
    logs.check()


def test_pieces_of_large_files(spark, tmp_path, monkeypatch):
    """Ranges cut anywhere, in lines of any length: each line belongs to one piece."""
    rng = random.Random(3)
    monkeypatch.setattr(T, "PIECE", 37)
    monkeypatch.setattr(T, "BLOCK", 11)
    monkeypatch.setattr(T, "ROWS", 3)
    folder = tmp_path / "logs"
    folder.mkdir()
    texts = {f"f{i}": "".join("x" * rng.randrange(90) + rng.choice(["\n", "\r\n"]) for _ in range(rng.randrange(30))) for i in range(6)}
    for name, text in texts.items():
        (folder / name).write_bytes((text + "no end").encode())
    reader = T.LogTailReader({"path": str(folder), "planned": str(tmp_path / "planned")})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) > 10
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    for name, text in texts.items():
        want, at = [(-1, None)], 0
        for raw in text.splitlines(keepends=True):
            want.append((at, raw.rstrip("\r\n")))
            at += len(raw)
        assert sorted(((r["ordinal"], r["value"]) for r in rows if r["file"] == name), key=lambda r: r[0]) == want
    assert reader.partitions(end, reader.latestOffset()) == []
