from __future__ import annotations

from pyspark.sql import functions as F

from provenlake.operators import writes
from provenlake.queries_ledger import life_events
from provenlake.streaming import windows
from provenlake.streaming.writes import stream_lifecycle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_stream_and_batch_give_the_same_lives(spark, sf_dir, tmp_path):
    """Events arrive in the order of their times, in several micro-batches; the watermark ends the wait of what is pending."""
    policy = writes.Policy(memory=False, auto_skill_improve="off")
    events = life_events(spark, sf_dir).withColumn("ttl_hours", F.col("ttl_hours").cast("int")).orderBy("at", "seq").toPandas()
    size = -(-len(events) // 4)
    schema = "write_id long, seq long, at timestamp, kind string, target string, origin string, ttl_hours int"
    table = [(w, s, at.to_pydatetime(), *rest, None if hours != hours else int(hours)) for w, s, at, *rest, hours in events.itertuples(index=False)]
    for k in range(4):
        part = spark.createDataFrame(table[k * size : (k + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = stream_lifecycle(windows.read_folder(spark, str(tmp_path / "in"), schema, files_at_once=1), policy)
        got = windows.run_to_end(stream, "lives").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    batch = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    want = writes.write_lifecycle(batch, policy, F.lit(table[-1][2])).collect()
    key = lambda r: (r.write_id, -1 if r.seq is None else r.seq, r.kind, r.code, r.status or "")
    events_only = lambda rows: sorted(key(r) for r in rows if r.kind != "expire")
    assert events_only(got) == events_only(want)
    swept = lambda rows: {r.write_id for r in rows if r.kind == "expire"}
    assert swept(got) == swept(want) and swept(want)
    codes = {r.code for r in want}
    assert {"queued", "applied_immediate", "rejected_by_policy", "duplicate", "ok", "idempotent", "not_found", "cannot_apply", "expired"} <= codes


def test_what_needs_no_decision():
    strict, free = writes.Policy(strict=True, memory=False), writes.Policy(memory=False, beliefs=False, skills=False)
    assert strict.needs_approval("memory") and not free.needs_approval("memory") and free.needs_approval("constitution")
    assert writes.Policy(auto_skill_improve="off").refuses("skill_file", "cron") and not writes.Policy().refuses("skill", "cron")


def test_holds_end_once(spark):
    holds = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "a", True)], "hold_id long, kind string, released boolean")
    asked = spark.createDataFrame([(1, 1, "b"), (2, 1, "a"), (3, 1, "a"), (4, 3, "a"), (5, 9, "a"), (6, 1, "b")], "release_id long, hold_id long, expected_kind string")
    got = [r.code for r in writes.release_holds(holds, asked).orderBy("release_id").collect()]
    assert got == ["kind_mismatch", "released", "already_released", "already_released", "not_found", "already_released"]
    assert [r.hold_id for r in writes.open_holds(holds, asked).collect()] == [2]
