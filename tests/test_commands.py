"""Command line, listener, registry, sessions, runtimes and batches."""

import io
import json
import socket
import sys
import threading

import pytest
from pyspark.sql import functions as F

from orrery import session
from orrery.operators import merge, traverse
from orrery.plans import catalog_sources
from orrery.schema import ENTITY_DDL, RELATION_DDL, ConflictError, InvalidRequest
from orrery.sources import lsp_registry, lsp_session, runtimes
from tests.test_git import repository  # noqa: F401


@pytest.fixture(scope="module")
def store(spark, repository, tmp_path_factory):  # noqa: F811
    """A store with the repository's last commit, by the command line."""
    at = tmp_path_factory.mktemp("commands")
    (at / "m.csv").write_text('6,3,20,2,6,"at","current.rs","extra","extra(a)",3,6\n9,1,1,0,1,"at","gone.rs","x","x",1,1\n')
    path = str(at / "store")
    assert [*say("init", path)] == [{"store": path, "created": True}]
    registered = next(say("lsp-register", path, "--id", "none", "--language", "Rust", "--command", f"{at}/absent", "--extension", ".rs"))
    assert registered["language"] == "rust" and registered["extensions"] == ["rs"]
    record = next(say("index", path, repository, "--lizard", str(at / "m.csv")))
    assert [p["observer"] for p in record["provenance"]] == ["git", "treesitter.rust", "lizard"]
    assert [d["observer"] for d in record["diagnostics"]] == ["lsp.registered:none"] and record["coverage"] == "partial"
    return path, record["world"], record["version"]


def say(*argv):
    return session.run(*session.parse([*argv]))


def test_commands(store):
    path, world, version = store
    at = (path, world, version)
    assert next(say("snapshots", path))["version"] == version and [*say("snapshots", path, "--world", "other")] == []
    named = [e["label"] for e in say("find", *at, "--name", "extra")]
    assert named == ["extra"] and [e["id"] for e in say("find", *at, "--kind", "file")] == ["file:current.rs"]
    assert len([*say("find", *at, "--path", "current.rs", "--line", "4")]) == 1
    whole = next(say("inspect", *at, "file:current.rs"))
    assert whole["entity"]["kind"] == "file" and len(whole["relations"]) >= 2
    assert next(say("stats", *at))["scored_entities"] == 0 and next(say("friction", *at)) == [] == next(say("unstable", *at)) == next(say("patterns", *at, "--friction", "0.9"))
    report = next(say("gaps", *at))
    assert report["scoreable"] == len(report["gaps"]) == report["with_gaps"] and {"label", "path", "missing_scores"} < set(report["gaps"][0]) and report["metadata"]["version"] == version
    assert next(say("impact", *at, "file:current.rs"))["direct"] == 0
    assert [n["id"] for n in next(say("dependencies", *at, "file:current.rs", "--scores", "true"))] == ["file:current.rs"]
    assert {r["change"] for r in say("diff", path, world, "before", version)} == {"added"}
    assert next(say("doctor"))["analysis_engines"]["json_rpc"] and next(say("version"))["version"] and "runtimes" in next(say("runtimes"))
    assert [s["id"] for s in next(say("lsp-list", path))] == ["none"]


@pytest.mark.parametrize("argv", [[], ["nothing"], ["stats", "x"], ["find", "s", "w", "v", "--limit"], ["find", "s", "w", "v", "--color", "red"], ["find", "s", "w", "v", "--name", "a", "--name", "b"]])
def test_usage(argv, capsys):
    assert session.main(argv) == 2
    assert json.loads(capsys.readouterr().err)["kind"] == "error"


def test_main(store, capsys):
    path, world, version = store
    assert session.main(["inspect", path, world, version, "nobody"]) == 1
    assert "does not exist" in json.loads(capsys.readouterr().err)["data"]
    assert session.main(["find", path, world, version, "--line", "1"]) == 2 and session.main(["find", path, world, version, "--limit", "many"]) == 2
    capsys.readouterr()
    assert session.main(["snapshots", path]) == 0
    assert json.loads(capsys.readouterr().out)["data"]["world"] == world


def test_listener(store):
    router = session.Router(session.SnapshotStore(session.SparkSession.active(), store[0]))
    with session.serve(router, port=0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        for ask, want in (({"jsonrpc": "2.0", "id": 4, "method": "acc.listLsp"}, 1), ({"jsonrpc": "2.0", "id": 5, "method": "unregisterLsp", "params": {"streamId": "nobody"}}, False)):
            with socket.create_connection(server.server_address, timeout=60) as s:
                s.sendall(b"\n" + json.dumps(ask).encode() + b"\n")
                said = json.loads(s.makefile().readline())
            assert said["id"] == ask["id"] and (len(said["result"]) if isinstance(want, int) and want is not False else said["result"]) == want
        server.shutdown()
    out = io.StringIO()
    session.serve_lines(router, ["", "{}\n", '{"jsonrpc":"2.0","method":"listLsp"}'], out)
    assert json.loads(out.getvalue())["error"]["code"] == -32600  # a notification has no answer
    bad = {"jsonrpc": "2.0", "id": 1, "method": "registerLsp", "params": {"id": "x y", "language": "l", "command": "c", "extensions": ["e"]}}
    assert json.loads(router.handle_line(json.dumps(bad)))["error"]["code"] == -32602


def test_registry(tmp_path):
    known = lsp_registry.Registry(str(tmp_path / "db"))
    assert known.registrations() == [] and not known.remove("x")
    one = known.upsert(lsp_registry.Registration("b", "Go", "gopls", ["-v"], [".GO", "go"], {"a": 1}))
    known.upsert(lsp_registry.Registration("a", "c", "clangd", [], ["c"]))
    again = lsp_registry.Registry(str(tmp_path / "db")).registrations()
    assert [r["id"] for r in again] == ["a", "b"] and again[1]["initialization_options"] == {"a": 1}
    assert one.serves("x/y.Go") and not one.serves("go") and not one.serves("x.py")
    (tmp_path / "db.lsp.json").write_text("{")
    with pytest.raises(InvalidRequest):
        lsp_registry.Registry(str(tmp_path / "db"))


def test_frames():
    two = lsp_session.frame({"a": "é"}) + b"content-length: 2\r\nContent-Type: x\r\n\r\n{}"
    stream = io.BytesIO(two)
    assert [lsp_session.read_frame(stream) for _ in range(3)] == [{"a": "é"}, {}, None]
    for broken in (b"\r\n{}", b"Content-Length: 9\r\n\r\n{}"):
        with pytest.raises(lsp_session.ProtocolError):
            lsp_session.read_frame(io.BytesIO(broken))


def test_server_that_stays_silent(tmp_path):
    with pytest.raises(lsp_session.ProtocolError, match="timed out"):
        lsp_session.Session([sys.executable, "-c", "import time; time.sleep(60)"], str(tmp_path), seconds=0.5)
    with pytest.raises(lsp_session.ProtocolError, match="closed"):
        lsp_session.Session([sys.executable, "-c", ""], str(tmp_path), seconds=20)


def test_registered_server_observes(spark, tmp_path):
    (tmp_path / "a.py").write_text("x")
    files = spark.createDataFrame([("a.py",), ("b.rs",)], "path string")
    entry = lsp_registry.Registration("py", "python", sys.executable, ["-c", catalog_sources._SERVER], ["py"])
    seen = session.lsp_analyser(entry)(spark, str(tmp_path), "HEAD", files, "w", "v")
    assert sorted(r["id"][:5] for r in seen.entities.collect()) == ["file:", "node_"] and seen.relations.count() == 1 and seen.source == "python"


def test_runtime_probe(tmp_path):
    slow = runtimes.probe(runtimes.Runtime("x", "sleep", "X", ("5",)), "sleep", "path", seconds=0.2)
    assert not slow.available and "timed out" in slow.detail
    failed = runtimes.probe(runtimes.Runtime("x", "false", "X", ()), "false", "path")
    assert not failed.available and "exited with 1" in failed.detail
    lost = runtimes.Resolver(managed=tmp_path, environment={}).resolve(runtimes.Runtime("x", "no-such-program", "X"))
    assert not lost.available and lost.detail.count("no-such-program") >= 3


def test_batches(spark):
    e = lambda *ids: spark.createDataFrame([("w", "v", i, "m", "k", i, {}, [], []) for i in ids], ENTITY_DDL)
    none = spark.createDataFrame([], RELATION_DDL)
    batch = lambda frame, **x: merge.Batch("w", "v", frame, none, **x)
    found = merge.merge_batches([batch(e("a"), diagnostics=[{"n": 1}]), batch(e("a", "b", "b"), coverage="unavailable", diagnostics=[{"n": 2}])])
    assert sorted(r["id"] for r in found.entities.collect()) == ["a", "b"] and found.coverage == "partial" and found.diagnostics == [{"n": 1}, {"n": 2}]
    assert merge.merge_batches([batch(e("a", "a"))]).entities.count() == 2  # left for validation
    for other in (merge.Batch("w", "v2", e("c"), none), merge.Batch("x", "v", e("c"), none), batch(e("c"), mode="amend")):
        with pytest.raises(ConflictError):
            merge.merge_batches([batch(e("a")), other])


def test_traversal_beyond_broadcasts(spark, monkeypatch):
    """Frontiers that are shuffled give what broadcast ones give."""
    e = spark.range(60).select(F.lit("w").alias("world"), F.lit("v").alias("version"), F.col("id").cast("string"))
    r = spark.range(200).select((F.col("id") % 60).cast("string").alias("from_id"), ((F.col("id") * 3 + F.floor(F.col("id") / 60) * 11 + 1) % 60).cast("string").alias("to_id"), F.col("id").cast("string"), F.lit("calls").alias("kind"))
    found = lambda: sorted(map(tuple, traverse.traverse(e, r, "1", "both", 2, 20).nodes.collect()))
    want = found()
    monkeypatch.setattr(traverse, "BROADCAST_NODES", 0)
    assert found() == want and len(want) > 5
