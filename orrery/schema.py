"""The observation model: column names, types and fixed lists."""

from __future__ import annotations

MEASUREMENT = "struct<name:string,value:double,unit:string,observer:string,confidence:double>"
SCORE = "struct<model:string,version:int,dimension:string,value:double>"
ENTITY_DDL = (
    "world string, version string, id string, model string, kind string, label string, "
    f"attributes map<string,string>, measurements array<{MEASUREMENT}>, scores array<{SCORE}>"
)
RELATION_DDL = (
    "world string, version string, id string, model string, kind string, from_id string, to_id string, "
    "weight double, attributes map<string,string>"
)
SNAPSHOT_DDL = (
    "world string, version string, coverage string, entity_count long, relation_count long, generation string, "
    "provenance array<struct<observer:string,version:string,configuration_digest:string,source:string>>, "
    "diagnostics array<struct<severity:string,observer:string,message:string,scope:string>>"
)

CODE_MODEL, SCORE_MODEL = "code", "avec.code"
# Required measurements and score dimensions, in order.
REQUIRED = (
    "code.lines_of_code",
    "code.cyclomatic_complexity",
    "code.parameters",
    "graph.incoming_edges",
    "graph.outgoing_edges",
    "git.total_commits",
    "git.contributors",
    "git.average_days_between_changes",
    "test.line_coverage",
    "test.branch_coverage",
)
DIMENSIONS = ("stability", "logic", "friction", "autonomy")
DEPENDENCY_KINDS = ("calls", "imports", "references", "implements", "inherits")
# Weight of a relation by its kind; any other kind has 0.5.
WEIGHTS = {"inherits": 1.0, "implements": 1.0, "contains": 1.0, "calls": 0.7, "imports": 0.5, "references": 0.3}
OTHER_WEIGHT = 0.5
U32_MAX = 4294967295


class QueryError(Exception):
    """Base of the errors that a query raises before it runs."""


class EntityNotFound(QueryError):
    pass


class DifferentWorlds(QueryError):
    pass


class InvalidNodeLimit(QueryError):
    pass


class InvalidRequest(QueryError):
    pass


class ConflictError(QueryError):
    """Observers disagree; carries the violation rows."""


class InvalidBatch(QueryError):
    """A batch breaks the store's rules; nothing was written."""
