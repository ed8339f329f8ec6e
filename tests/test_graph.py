"""Search, traversal, difference, ranking, gaps, merge, validation, store."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.operators import derive, diff, find, merge, rank, traverse, validate
from orrery.schema import DIMENSIONS, ENTITY_DDL, RELATION_DDL, REQUIRED, ConflictError, DifferentWorlds, EntityNotFound, InvalidBatch, InvalidNodeLimit, InvalidRequest
from orrery.store import SnapshotStore


def entity(i, label=None, version="v1", kind="function", attributes=None, measurements=(), scores=()):
    return ("w", version, i, "code", kind, label or i, {"file_path": '"src/lib.rs"', **(attributes or {})}, list(measurements), list(scores))


def edge(a, b, version="v1", kind="calls", weight=1.0):
    return ("w", version, f"{a}:{kind}:{b}", "code", kind, a, b, weight, {})


@pytest.fixture(scope="module")
def world(spark):
    e = spark.createDataFrame(
        [entity("a", "alpha"), entity("b", "beta"), entity("c", "gamma"), entity("a", "alpha", "v2"), entity("b", "beta changed", "v2"), entity("d", "delta", "v2")], ENTITY_DDL
    )
    r = spark.createDataFrame([edge("a", "b"), edge("b", "c"), edge("c", "a"), edge("a", "b", "v2"), edge("a", "d", "v2")], RELATION_DDL)
    return e, r


def v1(df):
    return df.where("version = 'v1'")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_find(world):
    e, r = world
    assert ids(find.find_entities(v1(e), "CODE", "function", "ALPHA", {"file_path": '"src/lib.rs"'})) == ["a"]
    assert ids(find.find_entities(v1(e), limit=2)) == ["a", "b"]
    assert ids(find.find_entities(v1(e), limit=0)) == []
    assert ids(find.code_find(v1(e), path="src/lib.rs", name_contains="gam")) == ["c"]
    assert ids(find.relations_of(v1(r), "a")) == ["a:calls:b", "c:calls:a"]
    with pytest.raises(InvalidRequest):
        find.relations_of(r, "a", "sideways")


def test_traverse_cycle(world):
    e, r = v1(world[0]), v1(world[1])
    t = traverse.traverse(e, r, "a", "outgoing", 10, 10)
    assert sorted((x["id"], x["depth"]) for x in t.nodes.collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert t.relations.count() == 3 and not t.truncated


def test_traverse_limits(world):
    e, r = v1(world[0]), v1(world[1])
    t = traverse.traverse(e, r, "a", "outgoing", 10, 2)
    assert sorted(ids(t.nodes)) == ["a", "b"] and t.truncated and ids(t.relations) == ["a:calls:b"]
    t = traverse.traverse(e, r, "a", "outgoing", 0, 10)
    assert ids(t.nodes) == ["a"] and not t.truncated and t.relations.count() == 0
    with pytest.raises(InvalidNodeLimit):
        traverse.traverse(e, r, "a", max_nodes=0)
    with pytest.raises(EntityNotFound):
        traverse.traverse(e, r, "zz")
    one = traverse.impact(e, r, "c", 3)[0].first()
    assert (one["direct"], one["transitive"], one["truncated"]) == (1, 1, False)


def test_self_loop(spark):
    e = spark.createDataFrame([entity("a"), entity("b")], ENTITY_DDL)
    r = spark.createDataFrame([edge("a", "a"), edge("a", "b")], RELATION_DDL)
    t = traverse.traverse(e, r, "a", "both", 1, 2)
    assert not t.truncated and t.relations.count() == 2
    degree = {x["id"]: (x["incoming"], x["outgoing"]) for x in derive.degrees(r).collect()}
    assert degree == {"a": (1, 2), "b": (1, 0)}
    view = {x["id"]: (len(x["incoming"]), len(x["outgoing"])) for x in find.node_views(e, r).collect()}
    assert view == {"a": (0, 2), "b": (1, 0)}


def test_diff(world):
    got = [(x["side"], x["change"], x["id"]) for x in diff.diff(*world, ("w", "v1"), ("w", "v2")).collect()]
    assert sorted(x[1:] for x in got if x[0] == "entity") == [("added", "d"), ("changed", "b"), ("removed", "c")]
    assert sorted(x[1] for x in got if x[0] == "relation") == ["added", "removed", "removed"]
    with pytest.raises(DifferentWorlds):
        diff.diff(*world, ("w", "v1"), ("x", "v1"))


def test_locations(spark):
    spans = spark.createDataFrame([("p", "target", 10, 14), ("p", "caller", 1, 30), ("p", "open", 12, None), ("p", "none", None, 40)], "path string, id string, line_start int, line_end int")
    assert ids(find.at_location(spans, "p", 11)) == ["target"] and ids(find.at_location(spans, "p", 12)) == ["open"] and ids(find.at_location(spans, "q", 12)) == []
    points = spark.createDataFrame([("p", 11), ("p", 11), ("p", 99)], "path string, line int")
    assert ids(find.locations(spans, points)) == ["target", "target"]


def measured(name, value, observer=None, confidence=None):
    return (name, value, None, observer, confidence)


def scored(model, values):
    return [(model, 1, d, v) for d, v in zip(DIMENSIONS, values, strict=True)]


def test_gaps_and_ranks(spark):
    e = spark.createDataFrame(
        [
            entity("target", measurements=[measured(REQUIRED[0], 5.0)]),
            entity("caller", measurements=[measured(n, 1.0) for n in REQUIRED], scores=scored("avec-code", [0.5] * 4)),
            entity("transitive"),
        ],
        ENTITY_DDL,
    )
    one = rank.gaps_summary(e).first()
    assert (one["scoreable"], one["fully_scored"], one["with_gaps"]) == (2, 1, 1)
    gap = rank.gaps(e).first()
    assert gap["id"] == "target" and gap["missing_measurements"] == list(REQUIRED[1:]) and gap["missing_scores"] == list(DIMENSIONS)
    p = rank.scores_pivot(spark.createDataFrame([entity("calm", scores=scored("avec.code", [0.9, 0.2, 0.1, 0.8])), entity("hot", scores=scored("avec.code", [0.2, 0.2, 0.9, 0.8])), entity("half", scores=scored("avec.code", [0.2] * 4)[:2])], ENTITY_DDL))
    assert ids(rank.patterns(p, dict(zip(DIMENSIONS, [0.9, 0.2, 0.1, 0.8], strict=True)), 0.8)) == ["calm"]
    assert ids(rank.high_friction(p)) == ["hot"] and ids(rank.unstable(p)) == ["hot"] and ids(rank.unstable(p, math.nan)) == []
    assert rank.stats(e, p).first()["mean_stability"] == pytest.approx(0.55)
    assert rank.stats(e, p.limit(0)).first()["mean_stability"] is None
    for bad in (lambda: rank.patterns(p, {}, 1.5), lambda: rank.patterns(p, {}, math.nan), lambda: rank.high_friction(p, limit=0)):
        with pytest.raises(InvalidRequest):
            bad()


def test_best_measurement(spark):
    rows = [("x", "n", 1.0, "b", 0.5, 0), ("x", "n", 2.0, "a", 0.5, 1), ("x", "n", 3.0, "a", 0.5, 2), ("x", "n", 9.0, None, None, 3)]
    df = spark.createDataFrame(rows, "id string, name string, value double, observer string, confidence double, ordinal int")
    assert rank.best_measurements(df, ["id", "name"]).first()["value"] == 3.0


def test_merge(spark):
    def obs(*rows):
        return merge.union_ranked([spark.createDataFrame([r], ENTITY_DDL) for r in rows])

    a, b = entity("e", "Item", measurements=[measured("one", 1.0)], kind="unknown"), entity("e", "m::Item", measurements=[measured("two", 2.0), measured("one", 1.0)], kind="method")
    got = merge.merge(obs(a, b))[0].first()
    assert (got["kind"], got["label"], [m["name"] for m in got["measurements"]]) == ("method", "m::Item", ["one", "two"])
    with pytest.raises(ConflictError, match="measurement one"):
        merge.merge(obs(a, entity("e", measurements=[measured("one", 3.0)], kind="unknown")))
    with pytest.raises(ConflictError, match="kind"):
        merge.merge(obs(b, entity("e", kind="type")))
    with pytest.raises(ConflictError, match="attribute"):
        merge.merge(obs(a, entity("e", attributes={"file_path": '"other"'})))
    both = merge.merge(obs(a, entity("e", measurements=[measured("one", 3.0, "other")])))[0].first()
    assert len(both["measurements"]) == 2


def test_merged_coverage(spark):
    df = spark.createDataFrame([(1, "complete"), (1, "complete"), (2, "complete"), (2, "unavailable"), (3, "unavailable"), (4, "partial")], "g int, coverage string")
    assert {r["g"]: r["c"] for r in df.groupBy("g").agg(merge.merged_coverage().alias("c")).collect()} == {1: "complete", 2: "partial", 3: "unavailable", 4: "partial"}


def test_violations(spark):
    e = spark.createDataFrame([entity("a"), entity("a"), entity("b", measurements=[measured("n", math.inf), measured("m", 1.0, "o", 1.5)], scores=[("m", 1, "d", math.nan)])], ENTITY_DDL)
    r = spark.createDataFrame([edge("a", "b"), edge("a", "b", weight=2.0), edge("a", "gone")], RELATION_DDL)
    got = [x["rule"] for x in validate.violations(e, r, "w", "v1").orderBy("order").collect()]
    assert got == ["duplicate_entity", "measurement_not_finite", "confidence_out_of_range", "score_out_of_range", "missing_endpoint", "weight_out_of_range", "duplicate_relation"]
    assert validate.violations(e, r, "w", "v9").where("rule = 'foreign_snapshot'").count() == 6


def test_store(spark, world, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    e, r = v1(world[0]), v1(world[1])
    assert store.snapshot("w", "v1") is None and store.entities("w", "v1").count() == 0 and store.snapshots().count() == 0
    assert store.ingest("w", "v1", e, r)["entity_count"] == 3
    store.ingest("w", "v1", e.where("id <> 'c'"), r.where("id = 'a:calls:b'"))
    assert ids(store.entities("w", "v1").orderBy("id")) == ["a", "b"]
    with pytest.raises(InvalidBatch, match="duplicate_entity"):
        store.ingest("w", "v1", e.unionByName(e), r)
    again = SnapshotStore(spark, str(tmp_path / "store"))
    assert again.entity("w", "v1", "a").count() == 1 and again.snapshots("w").first()["entity_count"] == 2
    again.ingest("w", "v1", e.limit(0), r.limit(0))
    assert again.entities("w", "v1").count() == 0 and again.snapshot("w", "v1")["entity_count"] == 0


def test_history(spark):
    day = 86400
    rows = [("x", 0, 0, "ada"), ("x", 1, 10 * day, "grace"), ("x", 2, 20 * day, "ada"), ("x", 3, 40 * day, "grace")]
    df = spark.createDataFrame(rows, "path string, seq int, ts long, author string")
    got = derive.file_history(df, 0).first()
    assert (got["commits"], got["contributors"], got["recent"], got["frequency"]) == (4, 2, 4, "medium") and got["average_days"] == pytest.approx(40 / 3)


def test_degrees_deriver(spark):
    python = entity("p", attributes={"language": '"python"'})
    e = spark.createDataFrame([python], ENTITY_DDL)
    r = spark.createDataFrame([], RELATION_DDL)
    got = derive.derive_graph_metrics(e, r, [{"observer": "lsp.registered", "source": "python"}]).first()
    assert [(m["name"], m["value"]) for m in got["measurements"]] == [("graph.incoming_edges", 0.0), ("graph.outgoing_edges", 0.0)]
    assert derive.derive_graph_metrics(e, r, [{"observer": "syntax"}]).first()["measurements"] == []
    assert derive.semantic_languages([{"observer": "lsp.rust-analyzer"}]) == {"rust"}


def test_page_imports_of_any_script(spark, tmp_path):
    import hashlib

    from orrery.plans import catalog

    targets = ["/a", "/A B", "/für", "/OSÓCIÓNTA", "/ΟΔΟΣ", "/İ", "/中文", "/\t", ""]
    html = "".join(f'<a href="{t}">x</a>' for t in [*targets, "/für"])
    spark.createDataFrame([(1, html), (2, None), (3, "none")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.queries()["page_imports"](spark, str(tmp_path)).collect()
    want = [(1, t, "module_" + hashlib.sha256(f"html:{t}".lower().encode()).hexdigest()[:32]) for t in targets]
    assert sorted(tuple(r) for r in got) == sorted(want)
