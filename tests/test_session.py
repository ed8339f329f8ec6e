import json

import pytest
from pyspark.sql import functions as F

from orrery.session import Engine, Router, Unavailable, envelope
from orrery.store import SnapshotStore
from orrery.streaming import events
from tests.test_git import repository  # noqa: F401


def absent(*_):
    raise Unavailable("no server here")


@pytest.fixture(scope="module")
def router(spark, repository, tmp_path_factory):  # noqa: F811
    root = tmp_path_factory.mktemp("store")
    (root / "c.info").write_text("SF:current.rs\nDA:1,1\nend_of_record\n")
    store = SnapshotStore(spark, str(root / "s"))
    engine = Engine(spark, store, [("lsp.registered", absent, False)])
    record = engine.index(repository, reports=[str(root / "c.info")])
    assert record["coverage"] == "partial" and record["diagnostics"][0]["observer"] == "lsp.registered"
    assert record["entity_count"] >= 2
    return Router(store)


def ask(router, method, **params):
    return json.loads(router.handle_line(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))


def test_rpc(router):
    found = ask(router, "engine.search", name="a", limit=3)["result"]
    assert found and {"id", "label", "kind", "path", "line_start", "line_end"} == set(found[0])
    node = ask(router, "getNode", id=found[0]["id"])["result"]
    assert node["id"] == found[0]["id"]
    assert ask(router, "getNode", id="nothing")["result"] is None
    assert ask(router, "getStats")["result"]["scored_entities"] == 0
    assert ask(router, "getHighFriction", limit=0)["error"]["code"] == -32603
    assert ask(router, "nope")["error"]["code"] == -32601
    assert ask(router, "getNode")["error"]["code"] == -32602
    assert ask(router, "getStats", version="x")["error"]["code"] == -32603
    assert json.loads(router.handle_line("{"))["error"]["code"] == -32700
    assert json.loads(router.handle_line("[]"))["error"]["code"] == -32600
    assert router.handle_line("  ") is None
    assert json.loads(envelope("x", 1)) == {"schema_version": 1, "kind": "x", "data": 1}


def test_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:10:00", 1, "a" if i % 2 else "b", float(i), "{}") for i in range(20)] + [(99, "2024-01-02 00:00:00", 1, "a", 0.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = events.write_windows(events.windowed(events.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    want = events.windowed(df).where("window_start < '2024-01-02'")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 10
