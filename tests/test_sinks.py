"""Batches that are retried, merged and compacted; ticks that a stream drops, and symbols that fall silent."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import counts as K
from plumbline.streaming.sinks import MergedStore, depth_store, reaction_store

DAY = datetime.datetime(2024, 1, 1)
SNAPSHOT = "symbol string, ts timestamp, seq long, bid double"


def snapshots(n, seed, seqs=0):
    rng = random.Random(seed)
    return [(rng.choice("abc"), DAY + datetime.timedelta(hours=rng.randrange(60)), seqs + i, rng.random()) for i in range(n)]


def last_by_key(batches):
    held = {}
    for b in batches:
        for r in sorted(b, key=lambda r: r[2]):
            held[r[0], r[1]] = r
    return sorted(held.values())


def test_retried_batches_are_stored_once_and_the_last_wins(spark, tmp_path):
    batches = [snapshots(40, k, 100 * k) for k in range(4)]
    frame = lambda b: spark.createDataFrame(b, SNAPSHOT).repartition(3)
    store = depth_store(spark, str(tmp_path / "d"), frame(batches[0]), ["seq"])
    assert store.read().count() == 0
    for k in (0, 1, 1, 2, 1):  # 1 is retried at once, and again after 2
        store.write(frame(batches[k]), k)
    got = lambda: sorted(map(tuple, store.read().collect()))
    assert got() == last_by_key(batches[:3])
    store.write(frame(batches[2][:5]), 2)  # a batch that failed half way is replaced whole
    assert got() == last_by_key([*batches[:2], batches[2][:5]])
    store.write(frame(batches[2]), 2)
    store.compact()
    assert got() == last_by_key(batches[:3]) and sorted(p.name for p in (tmp_path / "d").iterdir()) == ["base=2"]
    store.write(frame(batches[0]), 0)  # part of the base: done with
    store.write(frame(batches[3]), 3)
    assert got() == last_by_key(batches)
    store.compact()
    store.compact()
    assert got() == last_by_key(batches)
    one = sorted(map(tuple, store.read("2024-01-02", "2024-01-02").collect()))
    assert one == [r for r in last_by_key(batches) if r[1].day == 2] and one
    # a base whose writer died is no base
    (tmp_path / "d/base=9").mkdir()
    assert got() == last_by_key(batches)


def test_a_stream_that_dies_between_batches_is_stored_once(spark, tmp_path):
    batches = [snapshots(20, 10 + k, 100 * k) for k in range(3)]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SNAPSHOT).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    class Dying(MergedStore):
        def write(self, batch, number):
            super().write(batch, number)
            if number == 1 and not (tmp_path / "died").exists():
                (tmp_path / "died").write_text("")
                raise RuntimeError("lost after the batch was written")

    store = Dying(spark, str(tmp_path / "out"), spark.createDataFrame([], SNAPSHOT).schema, ["symbol", "ts"], ["seq"], "ts")
    with pytest.raises(Exception, match="lost after"):
        store.sink(stream, str(tmp_path / "c")).awaitTermination()
    store.sink(stream, str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, store.read().collect())) == last_by_key(batches)
    folders = sum(p.name.startswith("batch=") for p in (tmp_path / "out").iterdir())
    assert folders == 3


def test_reactions_keep_the_last(spark, tmp_path):
    rows = [("a", DAY, 1, 0.5), ("a", DAY, 2, 0.7), ("b", DAY, 1, 0.1)]
    df = spark.createDataFrame(rows, "symbol string, event_time timestamp, seq long, reaction double")
    store = reaction_store(spark, str(tmp_path / "r"), df, ["seq"])
    store.write(df, 0)
    store.write(df.where("seq = 1").withColumn("reaction", F.col("reaction") + 1), 1)
    assert {(r["symbol"], r["reaction"]) for r in store.read().collect()} == {("a", 1.5), ("b", 1.1)}


def test_drops_are_counted_and_silence_is_seen(spark, tmp_path):
    rng = random.Random(5)
    at = lambda s: (DAY + datetime.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S")
    files = []
    for k in range(3):
        lines = []
        for i in range(60):
            inst = rng.choice([1, 2, 3, 99])
            if inst == 3 and k > 0:
                inst = 1  # 3 falls silent after the first file
            late = k > 0 and i % 10 == 0
            lines.append({"instrument": inst, "last_price": 1.0, "last_quantity": 2, "ts": at((k * 600 + i) - (800 if late else 0))})
        lines += ["no tick", {"instrument": 1, "last_price": 2.0}, {"instrument": 2, "last_trade_time": at(k * 600 + 60)}]
        files.append([x if isinstance(x, str) else json.dumps(x) for x in lines])
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.txt").write_text("\n".join(files[-1]) + "\n")
    instruments = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "instrument long, symbol string")
    name = "ticks"
    batch = K.observed(spark.read.text(str(tmp_path / "in")), instruments, name)
    parsed = [json.loads(x) if x[0] == "{" else {} for f in files for x in f]
    want = {"seen": len(parsed), "malformed": sum(not p for p in parsed), "unknown": sum(p.get("instrument") == 99 for p in parsed), "untimed": sum(bool(p) and p.get("instrument") != 99 and "ts" not in p and "last_trade_time" not in p for p in parsed)}
    kept = want["seen"] - want["malformed"] - want["unknown"] - want["untimed"]
    assert batch.count() == kept
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    out = K.watched(K.observed(raw, instruments, name), "100 seconds", 500)
    query = out.writeStream.outputMode("update").format("memory").queryName("watched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert K.metrics_of(query, name) == want
    rows = spark.table("watched").collect()
    final = {}
    for r in rows:
        if r["symbol"] not in final or (r["rows"], r["silent"]) >= (final[r["symbol"]]["rows"], final[r["symbol"]]["silent"]):
            final[r["symbol"]] = r
    assert sum(r["rows"] for r in final.values()) == kept
    assert {s for s, r in final.items() if r["silent"]} == {"c"}
    # late against the watermark that each batch began with: 100 s behind the newest tick of the files before
    newest, late = 0, {}
    for f in files:
        mark = max(newest - 100, 0)
        for x in (json.loads(v) for v in f if v[0] == "{"):
            t = x.get("ts") or x.get("last_trade_time")
            if t and x["instrument"] != 99:
                s = (datetime.datetime.fromisoformat(t) - DAY).total_seconds()
                late[x["instrument"]] = late.get(x["instrument"], 0) + (s < mark)
                newest = max(newest, s)
    assert {r["symbol"]: r["late"] for r in final.values()} == {"abc"[k - 1]: v for k, v in late.items()} and sum(late.values()) > 5
