"""Files that grow, wait for the rest of a line, shrink and go."""

import os
import random

from pyspark.sql import functions as F

from memolake.sources.growing import growing_lines


def test_growing_files(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    state = str(tmp_path / "checkpoint")

    def run():
        q = growing_lines(spark, str(folder), "*.jsonl", split=7).writeStream.option("checkpointLocation", state).trigger(once=True).start(out)
        q.awaitTermination(120)
        assert q.exception() is None

    def lines():
        rows = spark.read.schema("path string, at long, line string").parquet(out).collect() if os.path.exists(out) else []
        return sorted((os.path.basename(r["path"]), r["at"], r["line"]) for r in rows)

    folder.mkdir()
    (folder / "a.jsonl").write_bytes(b"one\ntwo longer than a part\nhal")
    (folder / "other.txt").write_bytes(b"no\n")
    run()
    want = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two longer than a part")]
    assert lines() == want
    with open(folder / "a.jsonl", "ab") as f:
        f.write(b"f of it")
    run()
    assert lines() == want
    with open(folder / "a.jsonl", "ab") as f:
        f.write(b" is whole\n\nnext\r\n\xff\n")
    (folder / "b.jsonl").write_bytes("é\n".encode())
    run()
    want += [("a.jsonl", 27, "half of it is whole"), ("a.jsonl", 47, ""), ("a.jsonl", 48, "next"), ("a.jsonl", 54, "�"), ("b.jsonl", 0, "é")]
    assert lines() == sorted(want)
    (folder / "a.jsonl").write_bytes(b"anew\n")
    os.remove(folder / "b.jsonl")
    run()
    want += [("a.jsonl", 0, "anew")]
    assert lines() == sorted(want)
    (folder / "b.jsonl").write_bytes(b"back\n")
    run()
    assert lines() == sorted([*want, ("b.jsonl", 0, "back")])


def test_parts_have_each_line_once(spark, tmp_path):
    rng = random.Random(3)
    text = b"".join(bytes(rng.choice(b"ab ") for _ in range(rng.choice([0, 1, 5, 40]))) + b"\n" for _ in range(300))
    (tmp_path / "x.log").write_bytes(text + b"rest")
    want, at = [], 0
    for line in text.split(b"\n")[:-1]:
        want.append((at, line.decode()))
        at += len(line) + 1
    for split in (100_000, 1000, 64):
        d = growing_lines(spark, str(tmp_path), "*.log", stream=False, split=split)
        assert sorted((r["at"], r["line"]) for r in d.select("at", "line").collect()) == want
    assert growing_lines(spark, str(tmp_path / "none"), stream=False).agg(F.count("*")).first()[0] == 0
