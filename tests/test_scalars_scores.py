import pytest
from pyspark.sql import functions as F

from orrery.functions import scalars
from orrery.functions.scores import METRICS, score_columns


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(
    "path,name,line,want",
    [
        ("Calculator.cs", "Calculator::Score", 5, "node_11b451953ae3a83e6a851d595eda1f51"),
        ("scorer.py", "score", 1, "node_74432c1b3da8e5afe4de63d36eddd918"),
        ("scorer.ts", "score", 1, "node_5953cc61223e61da996fa4395252c5d5"),
        ("scorer.rs", "score", 1, "node_8188e6d9162545174b3d60e144b1afe8"),
    ],
)
def test_symbol_ids(spark, path, name, line, want):
    assert one(spark, scalars.symbol_id(F.lit(path), F.lit(name), F.lit(line))) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("git@host.org:me/x.git", "host.org/me/x"),
        ("https://user@host.org/me/x.git/", "host.org/me/x"),
        ("ssh://host.org/x.git.git", "host.org/x"),
        ("  ", None),
        ("/local/path", "/local/path"),
    ],
)
def test_normalize_remote(spark, raw, want):
    assert one(spark, scalars.normalize_remote(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [(" ./././a/b ", "a/b"), ("\\a\\b", "a/b"), (".//x", "x"), ("a/./b", "a/./b")])
def test_normalize_path(spark, raw, want):
    assert one(spark, scalars.normalize_path(F.lit(raw))) == want


@pytest.mark.parametrize("path,want", [("src/lib.RS", "rust"), ("web/a.tsx", "typescript"), ("README.md", None), (".rs", None), ("a.b/c", None), ("x.pl", "perl")])
def test_detect_language(spark, path, want):
    assert one(spark, scalars.detect_language(F.lit(path))) == want


def test_frequency(spark):
    assert [one(spark, scalars.recent_frequency(F.lit(n))) for n in (0, 2, 3, 9, 10)] == ["low", "low", "medium", "medium", "high"]


def scores(spark, values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{m} double" for m in METRICS))
    return df.select(*[c.alias(d) for d, c in score_columns({m: F.col(m) for m in METRICS}).items()]).first().asDict()


def test_score_vector(spark):
    got = scores(spark, [12.0, 2.0, 1.0, 0.0, 1.0, 3.0, 1.0, 4.0, 0.8, 0.6])
    assert got["stability"] == pytest.approx(0.647378)
    assert got["logic"] == 1.0
    assert got["friction"] == pytest.approx(0.0516)
    assert got["autonomy"] == pytest.approx(0.193333, abs=1e-6)


def test_scores_stay_in_range_and_need_all(spark):
    assert all(0 <= v <= 1 for v in scores(spark, [300.0, 80.0, 20.0, 100.0, 100.0, 1000.0, 100.0, 0.0, 2.0, 2.0]).values())
    assert scores(spark, [0.0] * 8 + [1.0, 1.0])["stability"] == pytest.approx(0.8)
    assert set(scores(spark, [12.0, 2.0, None, 0.0, 1.0, 3.0, 1.0, 4.0, 0.8, 0.6]).values()) == {None}
