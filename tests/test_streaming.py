from __future__ import annotations

from pyspark.sql import functions as F

from provenlake.operators import chains
from provenlake.streaming import windows


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("channel"), F.round(F.col("value") * 1_000_000).cast("long").alias("cost_usd_micros"), F.col("user_id").alias("chain"), F.col("event_id").alias("seq"))


def test_sliding_spend_matches_batch(spark, sf_dir, tmp_path):
    batch = _events(spark, sf_dir)
    batch.orderBy("created_at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.sliding_spend(windows.read_folder(spark, str(tmp_path / "in"), batch.schema), slide="1 hour")
    got = {tuple(r) for r in windows.run_to_end(stream, "spend", "complete").collect()}
    want = batch.groupBy(F.window("created_at", "1 hour").alias("w"), "channel").agg(F.count(F.lit(1)), F.sum("cost_usd_micros"))
    assert got == {(r.w.start, *r[1:]) for r in want.collect()}


def test_chain_batches_match_one_fold(spark, sf_dir, tmp_path):
    rows = _events(spark, sf_dir).select("chain", "seq", F.concat(F.lit("e"), F.col("seq").cast("string")).alias("payload"))
    out = str(tmp_path / "chains")
    sink = windows.fold_chain_batches(out)
    sink(rows.where("seq < 300"), 0)
    sink(rows.where("seq >= 300"), 1)
    sink(rows.where("seq >= 300"), 1)  # a batch that is run again after a failure
    got = {tuple(r) for r in spark.read.parquet(out).select("chain", "seq", "entry_hash").collect()}
    want = {tuple(r) for r in chains.append_chain(rows, "chain", "seq", "payload").select("chain", "seq", "entry_hash").collect()}
    assert got == want
