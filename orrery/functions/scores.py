"""The four scores as column expressions over ten metrics.

All arithmetic is in double precision, from left to right. Scores are null
unless every metric is there: missing evidence is never zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.scalars import clamp01

METRICS = ("loc", "cc", "params", "incoming", "outgoing", "commits", "contributors", "avg_days", "line_cov", "branch_cov")


@dataclass(frozen=True)
class Weights:
    """Version 1 of the formula's weights."""

    formula_version: int = 1
    churn: float = 0.4
    contributor: float = 0.3
    test: float = 0.3
    churn_normalize: float = 10.0
    contributor_cap: float = 5.0
    test_base: float = 0.5
    test_line: float = 0.5
    test_branch: float = 0.5
    line_normalize: float = 1.0
    branch_normalize: float = 1.0
    complexity: float = 0.7
    parameters: float = 0.3
    lines_divisor: float = 10.0
    parameter_cap: float = 5.0
    structural: float = 0.4
    process: float = 0.3
    cognitive: float = 0.3
    centrality: float = 0.4
    dependency: float = 0.6
    friction_churn: float = 0.7
    collaboration: float = 0.3
    incoming_cap: float = 10.0
    commits_normalize: float = 50.0
    contributors_normalize: float = 10.0
    complexity_normalize: float = 20.0
    dependency_ratio: float = 0.8
    absolute_count: float = 0.2
    outgoing_cap: float = 30.0


def _upto1(x: Column) -> Column:
    return F.least(x, F.lit(1.0))


def score_columns(m: dict[str, Column], w: Weights = Weights()) -> dict[str, Column]:
    """{dimension: column} from columns named as in METRICS."""
    d = {k: m[k].cast("double") for k in METRICS}
    one = F.lit(1.0)
    floor1 = lambda x: F.greatest(x, one)
    normal = lambda x: x if x != 0 else 1.0
    rate = _upto1(d["commits"] / floor1(d["avg_days"]) / w.churn_normalize)
    people = _upto1(d["contributors"] / w.contributor_cap)
    tests = w.test_line * (d["line_cov"] / normal(w.line_normalize)) + w.test_branch * (d["branch_cov"] / normal(w.branch_normalize))
    degree = floor1(d["incoming"] + d["outgoing"])
    out = {
        "stability": (one - w.churn * rate) * (one - w.contributor * people) * (w.test_base + w.test * tests),
        "logic": w.complexity * (d["cc"] / floor1(d["loc"] / w.lines_divisor)) + w.parameters * _upto1(d["params"] / w.parameter_cap),
        "friction": w.structural * (w.centrality * (d["incoming"] / degree) + w.dependency * _upto1(d["incoming"] / w.incoming_cap))
        + w.process
        * (w.friction_churn * _upto1(d["commits"] / w.commits_normalize) + w.collaboration * _upto1(d["contributors"] / w.contributors_normalize))
        + w.cognitive * _upto1(d["cc"] / w.complexity_normalize),
        "autonomy": w.dependency_ratio * (one - d["outgoing"] / degree) + w.absolute_count * (one - _upto1(d["outgoing"] / w.outgoing_cap)),
    }
    whole = F.lit(True)
    for k in METRICS:
        whole = whole & d[k].isNotNull()
    return {k: F.when(whole, clamp01(v)) for k, v in out.items()}
