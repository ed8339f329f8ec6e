import pytest
from pyspark.sql import functions as F

from orrery.operators import derive
from orrery.schema import ENTITY_DDL, InvalidRequest
from orrery.sources import coverage, lizard, lsp

LCOV = "TN:nightly\nSF:/build/7/engine/gears.rs\nFN:3,turn\nDA:3,12\nBRDA:3,1,0,4\nBRDA:3,1,1,0\nBRDA:3,1,2,8\nDA:4,0\nDA:4,5\nBRDA:9,0,0,-\nDA:8,0\nLF:4\nend_of_record\n"


def test_lcov_ratios(spark, tmp_path):
    (tmp_path / "a.info").write_text(LCOV)
    lines = coverage.read_lcov(spark, str(tmp_path / "a.info"))
    got = sorted(tuple(r) for r in lines.select("line", "hit", "branches_covered", "branches_total").collect())
    assert got == [(3, True, 2, 3), (4, True, 0, 0), (8, False, 0, 0), (9, False, 0, 1)]
    e = spark.createDataFrame([("w", "v", "x", "code", "function", "x", {"file_path": '"engine/gears.rs"', "line_start": "3", "line_end": "8"}, [], [])], ENTITY_DDL)
    m = {m["name"]: m["value"] for m in derive.derive_coverage(e, lines).first()["measurements"]}
    assert m == {"test.line_coverage": pytest.approx(2 / 3), "test.branch_coverage": pytest.approx(2 / 3)}


@pytest.mark.parametrize("bad", ["DA:1,1\n", "SF:x\nDA:1,many\n"])
def test_lcov_errors(spark, bad):
    with pytest.raises(Exception, match="record before SF|bad count"):
        coverage.parse_lcov(spark.createDataFrame([(1, bad)], "report long, value string")).collect()


def test_cobertura(spark, tmp_path):
    lines = "".join(f'<line number="{n}" hits="{h}" branch="{bool(c)}"{c}/>' for n, h, c in ((21, 0, ""), (22, 7, ' condition-coverage="75% (3/4)"'), (22, 0, ' condition-coverage="25% (1/4)"'), (30, 1, ' condition-coverage="none"')))
    (tmp_path / "c.xml").write_text(f'<coverage version="5"><packages><package name="p"><classes><class name="Loom" filename="weave/Loom.java"><methods/><lines>{lines}</lines></class></classes></package></packages></coverage>')
    got = sorted(tuple(r) for r in coverage.read_cobertura(spark, str(tmp_path / "c.xml")).collect())
    assert got == [("weave/Loom.java", 21, False, 0, 0), ("weave/Loom.java", 22, True, 3, 4), ("weave/Loom.java", 30, True, 0, 0)]


def test_detect():
    assert coverage.coverage_detect(LCOV) == "lcov" and coverage.coverage_detect("<?xml?><coverage>") == "cobertura"
    with pytest.raises(InvalidRequest):
        coverage.coverage_detect("hello")


def test_path_match(spark):
    paths = spark.createDataFrame([("src/a.rs",), ("./b.rs",), ("lib/c.rs",), ("d.rs",)], "path string")
    files = spark.createDataFrame([("/w/src/a.rs",), ("b.rs",), ("c.rs",), ("x/d.rs",), ("y/d.rs",)], "file string")
    assert {r["path"]: r["file"] for r in derive.coverage_path_match(paths, files).collect()} == {"src/a.rs": "/w/src/a.rs", "./b.rs": "b.rs", "lib/c.rs": "c.rs"}


def test_lizard(spark, tmp_path):
    (tmp_path / "l.csv").write_text(
        '6,3,20,2,6,"loc","scorer.py","score","score( a , b )",1,6\n8,3,30,2,9,"loc","Calculator.cs","Score","Calculator::Score( ""x"" )",5,13\n1,1,1,0,1,"loc","scorer.rs","","",1,1\n'
    )
    rows = lizard.read_lizard(spark, str(tmp_path / "l.csv"))
    e, r = lizard.lizard_symbols(rows, "w", "v")
    got = {x["label"]: (x["kind"], x["id"]) for x in e.collect()}
    assert got["score"] == ("function", "node_74432c1b3da8e5afe4de63d36eddd918")
    assert got["Calculator::Score"][0] == "method" and r.count() == 2 and e.first()["attributes"]["language"] in ('"python"', '"csharp"')


SYMBOLS = """[{"name": "Box", "kind": 5, "detail": "class Box : Base<T>, IThing", "range": {"start": {"line": 0}, "end": {"line": 9}},
 "selectionRange": {"start": {"line": 0, "character": 6}}, "children": [{"name": "open", "kind": 6, "range": {"start": {"line": 2}, "end": {"line": 4}}}]}]"""


def test_lsp(spark):
    cat = lsp.lsp_symbols(spark.createDataFrame([("a.cs", SYMBOLS)], "path string, symbols string"))
    got = {x["name"]: x for x in cat.collect()}
    assert got["Box"]["line_start"] == 1 and got["open"]["line_end"] == 5 and got["open"]["callable"]
    edges, unresolved = lsp.lsp_bases(cat, "csharp")
    assert sorted(x["kind"] for x in edges.collect()) == ["implements", "inherits"] and sorted(x["label"] for x in unresolved.collect()) == ["Base", "IThing"]
    places = spark.createDataFrame([("a.cs", 3, got["Box"]["id"]), ("a.cs", 3, got["open"]["id"])], "path string, line int, target string")
    assert [tuple(x) for x in lsp.lsp_references(cat, places).collect()] == [(got["open"]["id"], "references", got["Box"]["id"])]
    calls = spark.createDataFrame([("other", "a.cs", "open", 2, None)], "caller string, path string, name string, sel_line long, sel_char long")
    assert lsp.lsp_calls(cat, calls.withColumn("sel_char", F.lit(None).cast("long"))).count() == 0
