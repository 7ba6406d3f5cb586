from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from provenlake.operators import sessions
from provenlake.plans import flows
from provenlake.sources import sinks


def test_stems():
    # Pairs from the published description of the algorithm.
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "hopefulness": "hope", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "controll": "control", "roll": "roll"}.items():
        assert sessions.stem(word) == want


def test_session_search(spark):
    m = spark.createDataFrame([(1, "We were running the tests"), (2, "a run of tests"), (3, "nothing here"), (4, "tested runs")], "message_id long, text string")
    q = spark.createDataFrame([(1, "run")], "query_id long, text string")
    assert {r.message_id for r in sessions.session_search(m, q).collect()} == {1, 2, 4}
    newest = m.withColumn("created_at", F.col("message_id"))
    assert [r.message_id for r in sessions.plain_search(newest, "TEST").collect()] == [4, 2, 1]


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"))
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    assert t.version() == 0 and t.upsert(a, "id") == 1
    assert t.upsert(spark.createDataFrame([(2, "B"), (3, "c")], "id long, x string"), "id") == 2
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "B"), (3, "c")}
    t.delete(spark.createDataFrame([(1,)], "id long"), "id")
    assert t.read().count() == 2 and t.read(1).count() == 2 and t.version() == 3


def test_anchor_names_its_predecessor(tmp_path):
    one = sinks.export_checkpoint({"seq": 1, "b": {"z": 1, "a": 2}}, str(tmp_path / "r1"), str(tmp_path / "log"))
    two = sinks.export_checkpoint({"seq": 2}, str(tmp_path / "r2"), str(tmp_path / "log"))
    assert two["prevAnchorHash"] == one["anchorHash"] and sinks.anchor(two) == two
    assert len((tmp_path / "log").read_text().splitlines()) == 2


def test_ask(spark):
    passages = spark.createDataFrame(
        [(1, "p1", "vault_page", "m", 2, "Refunds", "Refunds take thirty days", [1.0, 0.0]), (2, "p2", "vault_page", "m", 2, "Shipping", "Shipping takes a week", [0.0, 1.0]), (3, "p3", "symbol", "m", 2, "x", "refunds refunds", [1.0, 0.0])],
        "doc_id long, id string, kind string, model string, dims int, title string, body string, vector array<double>",
    )
    asked = spark.createDataFrame([(1, "refunds?", [1.0, 0.1]), (2, "nothing", [0.0, 0.0])], "query_id long, text string, vector array<double>")
    answer = "Refunds are paid within thirty days [1].\nRefunds are always instant and free [9].\nRefunds are always instant and free.\nI don't know more."
    complete = lambda p: p.select("query_id", F.lit(answer).alias("answer"))
    got = {r.no: (r.kind, r.status) for r in flows.ask(asked, passages, complete).collect()}
    assert got == {0: ("assertion", "ALLOWED"), 1: ("assertion", "DEBT"), 2: ("assertion", "DEBT"), 3: ("aporia", "APORIA")}
    drifted = spark.createDataFrame([("p1", False)], "ref_id string, verified boolean")
    assert {r.no: r.status for r in flows.ask(asked, passages, complete, drifted).collect()}[0] == "DEBT"


def test_cover(spark):
    c = spark.createDataFrame([(1, 0, 1, 4), (1, 1, 5, 8)], "chain long, no long, from_seq long, to_seq long")
    s = spark.createDataFrame([(1, 1), (1, 4), (1, 5), (1, 9)], "chain long, seq long")
    assert {(r.seq, r.no) for r in flows.cover(c, s).collect()} == {(1, 0), (4, 0), (5, 1)}


def test_gate_log(spark):
    c = spark.createDataFrame([(1, "h", "refused"), (2, "h", "committed")], "seq long, claim_hash string, outcome string")
    e = spark.createDataFrame([(7,)], "belief_id long")
    d = spark.createDataFrame([(1, "waived"), (2, "paid")], "debt_id long, status string")
    gate, audit = flows.gate_log(c, e, d)
    assert {r.action for r in gate.collect()} == {"commit:blocked", "commit:passed", "expire", "debt:paid"}
    assert {r.action for r in audit.collect()} == {"gate:commit:blocked", "gate:commit:passed", "debt:waived"}


def test_bad_pointer_is_not_hidden(spark, tmp_path):
    (tmp_path / "published").mkdir(parents=True)
    (tmp_path / "published" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        sinks.VersionedTable(spark, str(tmp_path)).version()
