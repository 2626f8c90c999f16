"""Versioned tables that survive a writer's death, pruning, graph arrays, job life cycles as table and stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from causalake.operators import tensors as TE
from causalake.plans import systems as Y
from causalake.sources import versions as V
from causalake.streaming import buffers as B
from causalake.streaming import jobs as J
from causalake.streaming import runs
from tests.conftest import rows

KV = "k string, v int"


def test_a_dying_writer_loses_nothing(spark, tmp_path, monkeypatch):
    t = V.VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.write(spark.createDataFrame([("a", 1)], KV)) == 1
    with monkeypatch.context() as m:
        m.setattr(V.VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            t.write(spark.createDataFrame([("b", 2)], KV))
    assert rows(t.read()) == [("a", 1)] and t.files().count() == 2
    (tmp_path / "t" / "log" / f"{2:012d}").write_text("half a poin")  # died while writing its pointer
    assert t.latest() == 1 and rows(t.read()) == [("a", 1)]
    assert t.upsert(spark.createDataFrame([("a", 5), ("c", 3)], KV), ["k"], ["v"]) == 3
    assert rows(t.read()) == [("a", 5), ("c", 3)] and rows(t.read(1)) == [("a", 1)]
    freed = t.prune(1)
    assert freed > 0 and t.files().count() == 1 and rows(t.read()) == [("a", 5), ("c", 3)]
    with pytest.raises(FileNotFoundError):
        t.read(1)


def test_two_writers(spark, tmp_path):
    t = V.VersionedTable(spark, str(tmp_path / "t"))
    base = t.write(spark.createDataFrame([("a", 1)], KV))
    t.write(spark.createDataFrame([("b", 1)], KV), base)
    with pytest.raises(V.Conflict):
        t.write(spark.createDataFrame([("c", 1)], KV), base)
    with pytest.raises(V.Conflict):
        t._commit(2, "other")
    assert rows(t.read()) == [("b", 1)]


def test_prune_inputs(spark):
    records = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run string")
    inputs = spark.createDataFrame([("r1", "x", 10), ("r1", "y", 5), ("r2", "x", 10), ("r2", "z", 7), ("r3", "z", 7)], "run string, input string, bytes long")
    got = {r.run: (r.replayable, r.pruned_bytes, r.dropped) for r in V.prune_inputs(records, inputs, records.where("run = 'r1'")).collect()}
    assert got == {"r1": (True, 0, []), "r2": (False, 7, ["z"]), "r3": (False, 0, ["z"])}


def test_arrays_round_trip(spark, sf):
    places, index = Y.tensors(spark, sf)
    back = TE.from_compressed_rows(TE.compressed_rows(places, index))
    assert rows(back) == rows(index) and index.select("type_id").distinct().count() == 3
    e = spark.createDataFrame([("g", "a", "b", "Activates"), ("g", "a", "b", "activates"), ("g", "a", "zz", "activates"), ("g", "b", "a", None)], "graph_id string, source_id string, target_id string, edge_type string")
    at = TE.node_places(spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c"), ("g", "a")], "graph_id string, node_id string"))
    got = TE.compressed_rows(at, TE.edge_index(at, e, TE.edge_vocabulary(e))).first()
    assert (got.offsets, got.targets, got.types) == ([0, 2, 3, 3], [1, 1, 0], [1, 1, 0])


def test_stream_equals_table(spark, sf, tmp_path):
    events = Y.job_events(spark, sf).orderBy("at", "seq")
    end = events.agg(F.max("at")).first()[0]
    src = str(tmp_path / "in")
    parts = 3
    held = events.collect()
    step = len(held) // parts + 1
    for i in range(parts):
        spark.createDataFrame(held[i * step : (i + 1) * step], events.schema).coalesce(1).write.mode("append").parquet(src)
    told = J.transitions_stream(runs.stream(spark, src, events.schema), Y.PATIENCE)
    told.writeStream.format("memory").queryName("jobs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(150)
    want = J.transitions(events, Y.PATIENCE)
    assert want.where("finding = 'stale'").count() > 0 and want.where("finding = 'illegal'").count() > 0 and want.where("finding = 'ok'").count() > 0
    assert rows(spark.table("jobs").where(F.col("at") < end)) == rows(want.where(F.col("at") < end))


def test_recalibrations_stream_equals_table(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value").withColumn("x", F.col("event_id") % 97)
    src, n = str(tmp_path / "in"), e.count()
    for i in range(4):
        e.where((F.col("event_id") >= i * n // 4) & (F.col("event_id") < (i + 1) * n // 4)).coalesce(1).write.mode("append").parquet(src)
    args = ("event_type", "event_id", "x", "value", 20)
    told = B.recalibrations_stream(runs.stream(spark, src, e.schema), *args)
    told.writeStream.format("memory").queryName("fits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(100)
    values = lambda d: {(r.key, r.n): (r.mean_x, r.mean_y, r.slope, r.intercept) for r in d.collect()}
    want, got = values(B.recalibrations(e, *args)), values(spark.table("fits"))
    assert want and got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-9)
    odd = spark.createDataFrame([("k", i, 1.0, v) for i, v in enumerate([1.0, None, float("nan"), 3.0])], "key string, ord int, x double, y double")
    assert [tuple(r) for r in B.recalibrations(odd, "key", "ord", "x", "y", 2).collect()] == [("k", 2, 1.0, 2.0, None, None)]
