"""Indexing, queries by snapshot, and the JSON envelope and RPC around them."""

from __future__ import annotations

import json
import os
import socketserver
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.scalars import json_string
from orrery.operators import derive, diff, find, merge, rank, traverse
from orrery.schema import CODE_MODEL, DIMENSIONS, ENTITY_DDL, RELATION_DDL, EntityNotFound, InvalidRequest, QueryError
from orrery.sources import coverage, git, lizard, lsp, lsp_registry, lsp_session, runtimes, rust, syntax
from orrery.store import SnapshotStore


VERSION = "0.2"
#: Files with syntax errors that a snapshot's record names, at most.
MOST_DIAGNOSTICS = 1000


@dataclass
class Observation:
    """What one analyser says: frames, and what it was."""

    observer: str
    entities: DataFrame
    relations: DataFrame
    coverage: str = "complete"
    source: str | None = None
    diagnostics: list[dict] = field(default_factory=list)


class Unavailable(QueryError):
    """Raised by an optional analyser that can't run here."""


@dataclass
class Engine:
    """Analysers are functions (spark, root, commit, files, world, version) ->
    Observation, in order; required ones must succeed."""

    spark: SparkSession
    store: SnapshotStore
    analysers: list = field(default_factory=list)  # (name, function, required)

    def index(self, path: str, revision: str = "HEAD", reports: list[str] = ()) -> dict:
        """Observe a commit, reconcile, derive, score and store it; the record."""
        lines = None
        for report in reports:
            with open(report, encoding="utf-8-sig") as f:
                kind = coverage.coverage_detect(f.read(4096))
            found = coverage.read_lcov(self.spark, report) if kind == "lcov" else coverage.read_cobertura(self.spark, report)
            lines = found if lines is None else lines.unionByName(found)
        info = git.git_inspect(self.spark, path, revision)
        root, commit, world, version = info["root"], info["commit"], info["world"], info["version"]
        files = git.git_tree(self.spark, root, commit).persist()
        stamp = int(git._git(root, "show", "-s", "--format=%at", commit))
        history = git.git_history(git.git_changes(self.spark, root, commit), stamp)
        seen = [Observation("git", git.git_inventory(files, history, world, version), self.spark.createDataFrame([], RELATION_DDL), "partial")]
        skipped = []
        for name, analyse, required in [("treesitter.rust", rust_analyser, True), *self.analysers]:
            try:
                seen.append(analyse(self.spark, root, commit, files, world, version))
            except Unavailable as e:
                if required:
                    raise
                skipped.append({"severity": "warning", "observer": name, "message": str(e), "scope": None})
        told = lambda o: {"observer": o.observer, "version": "1", "configuration_digest": None, "source": o.source}
        whole = merge.merge_batches([merge.Batch(world, version, o.entities, o.relations, o.observer, coverage=o.coverage, provenance=[told(o)], diagnostics=o.diagnostics) for o in seen])
        e = derive.derive_graph_metrics(whole.entities, whole.relations, whole.provenance)
        if lines is not None:
            e = derive.derive_coverage(e, lines)
        record = self.store.ingest(world, version, derive.score(e), whole.relations, "partial" if skipped else whole.coverage, whole.provenance, [*whole.diagnostics, *skipped])
        files.unpersist()
        return record


def rust_analyser(spark: SparkSession, root: str, commit: str, files: DataFrame, world: str, version: str) -> Observation:
    """Symbols, contains edges and imports of the commit's Rust files."""
    blobs = git.git_blobs(syntax.supported(files, syntax.RUST), root).persist()
    s, problems = syntax.observe(blobs, syntax.RUST)
    i = rust.rust_imports(blobs.select("path", F.expr("try_validate_utf8(CAST(content AS STRING))").alias("content")))
    m = lambda name, c: F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value"), F.lit("count").alias("unit"), F.lit("treesitter.rust").alias("observer"), F.lit(0.9).alias("confidence"))
    fixed = (F.lit(world).alias("world"), F.lit(version).alias("version"))
    empty = spark.createDataFrame([], ENTITY_DDL).schema
    entities = s.select(
        *fixed, "id", F.lit(CODE_MODEL).alias("model"), "kind", F.col("qualified_name").alias("label"),
        F.create_map(F.lit("language"), F.lit('"rust"'), F.lit("file_path"), json_string(F.col("path")), F.lit("line_start"), F.col("line_start").cast("string"), F.lit("line_end"), F.col("line_end").cast("string"), F.lit("qualified_name"), json_string(F.col("qualified_name"))).alias("attributes"),
        F.array(m("code.lines_of_code", "lines_of_code"), m("code.cyclomatic_complexity", "complexity"), m("code.parameters", "parameters")).cast(empty["measurements"].dataType).alias("measurements"),
        F.array().cast(empty["scores"].dataType).alias("scores"),
    ).dropDuplicates(["id"])
    modules = i.select(*fixed, "id", F.lit(CODE_MODEL).alias("model"), F.lit("module").alias("kind"), F.col("target").alias("label"), F.create_map(F.lit("language"), F.lit('"rust"'), F.lit("resolution"), F.lit('"unresolved"')).alias("attributes"), F.array().cast(empty["measurements"].dataType).alias("measurements"), F.array().cast(empty["scores"].dataType).alias("scores")).dropDuplicates(["id"])
    edge = lambda df, rid, kind, a, b, w: df.select(*fixed, rid.alias("id"), F.lit(CODE_MODEL).alias("model"), F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"), F.lit(w).alias("weight"), F.create_map().cast("map<string,string>").alias("attributes"))
    owner = F.concat(F.lit("file:"), F.col("path"))
    relations = edge(s.dropDuplicates(["contains_id"]), F.col("contains_id"), "contains", owner, F.col("id"), 1.0).unionByName(edge(i, F.col("relation_id"), "imports", owner, F.col("id"), 0.5))
    found = [r.asDict() for r in problems.limit(MOST_DIAGNOSTICS).collect()]
    return Observation("treesitter.rust", entities.unionByName(modules), relations, syntax.COVERAGE, diagnostics=found)


def lizard_analyser(csv: str):
    """An analyser that reads the metric CSV of an external tool."""

    def analyse(spark: SparkSession, root: str, commit: str, files: DataFrame, world: str, version: str) -> Observation:
        if not os.path.exists(csv):
            raise Unavailable(f"no metrics at {csv}")
        entities, relations = lizard.lizard_symbols(lizard.read_lizard(spark, csv).join(files.select("path"), "path", "left_semi"), world, version)
        return Observation("lizard", entities, relations, "partial")

    return analyse


def lsp_analyser(registration: lsp_registry.Registration):
    """An analyser that drives a registered language server over the files with
    its extensions: symbols and bases."""

    def analyse(spark: SparkSession, root: str, commit: str, files: DataFrame, world: str, version: str) -> Observation:
        paths = [r["path"] for r in files.select("path").toLocalIterator() if registration.serves(r["path"])]
        try:
            documents = lsp_session.symbols_of(spark, [registration.command, *registration.arguments], root, paths, registration.language)
        except lsp_session.ServerUnavailable as e:
            raise Unavailable(str(e)) from e
        catalog = lsp.lsp_symbols(documents).dropDuplicates(["id"])
        edges, unresolved = lsp.lsp_bases(catalog, registration.language)
        entities, relations = lsp.lsp_assemble(catalog, edges, unresolved, registration.language, world, version)
        return Observation("lsp.registered", entities, relations, "partial", registration.language)

    return analyse


def envelope(kind: str, data: Any) -> str:
    """The JSON line of a result or an error."""
    return json.dumps({"schema_version": 1, "kind": kind, "data": data}, default=str)


class Router:
    """JSON-RPC over one store, a line at a time; results are bounded by limits."""

    LSP = {"registerLsp", "registerLspStream", "unregisterLsp", "unregisterLspStream", "listLsp", "listLspStreams"}
    QUERIES = {"getNode", "queryRelations", "queryDependencies", "queryPatterns", "search", "getHighFriction", "getUnstable", "getStats", "impact", "gaps"}

    def __init__(self, store: SnapshotStore):
        self.store = store

    def _snapshot(self, p: dict) -> tuple[str, str]:
        if p.get("version") and not p.get("world"):
            raise InvalidRequest("version without world")
        if p.get("version"):
            return p["world"], p["version"]
        rows = self.store.snapshots(p.get("world")).limit(2).collect()
        if len(rows) != 1:
            raise InvalidRequest("exactly one stored snapshot is needed, or world and version")
        return rows[0]["world"], rows[0]["version"]

    def _servers(self, name: str, p: dict) -> Any:
        known = lsp_registry.Registry(self.store.root)
        if name.startswith("register"):
            made = known.upsert(lsp_registry.Registration(p["id"], p["language"], p["command"], p.get("arguments", []), p.get("extensions", []), p.get("initializationOptions")))
            return {"success": True, "id": made.id, "streamId": made.id}
        return known.remove(p["id"] if "id" in p else p["streamId"]) if name.startswith("un") else known.registrations()

    def call(self, method: str, p: dict) -> Any:
        name = method.rpartition(".")[2]
        if name in self.LSP:
            return self._servers(name, p)
        if name not in self.QUERIES:
            raise KeyError(method)
        snap = self._snapshot(p)
        e, r = self.store.entities(*snap), self.store.relations(*snap)
        rows = lambda df: [x.asDict(recursive=True) for x in df.collect()]
        if name in ("getNode", "queryRelations"):
            one = e.where(F.col("id") == p["id"])
            near = r.where((F.col("from_id") == p["id"]) | (F.col("to_id") == p["id"]))
            return next(iter(rows(find.node_views(one, near, name == "getNode" or p.get("includeScores", False)))), None)
        if name == "queryDependencies":
            depth = p.get("maxDepth", -1)
            return rows(traverse.dependencies(e, r, p["id"], p.get("direction", "both"), None if depth < 0 else depth, p.get("maxNodes", 10_000), p.get("includeScores", False)))
        if name == "impact":
            return traverse.impact(e, r, p["id"], p.get("maxDepth", 3), p.get("maxNodes", 1000))[0].first().asDict()
        if name == "search":
            return rows(find.summary(find.code_find(e, p.get("path"), p.get("name"), p.get("kind"), p.get("language"), p.get("limit", 10))))
        if name == "gaps":
            code = e.where(F.col("model") == CODE_MODEL)
            listed = rank.gaps(code).join(find.summary(code), "id").orderBy("id")
            return rank.gaps_summary(code).first().asDict() | {"metadata": self.store.snapshot(*snap), "gaps": rows(listed)}
        profiles = rank.scores_pivot(e)
        if name == "queryPatterns":
            return rows(rank.patterns(profiles, p["profile"], p.get("threshold", 0.8), p.get("limit", 50)))
        if name == "getHighFriction":
            return rows(rank.high_friction(profiles, p.get("minimum", 0.7), p.get("limit", 20)))
        if name == "getUnstable":
            return rows(rank.unstable(profiles, p.get("maximum", 0.4), p.get("limit", 20)))
        return rank.stats(e.where(F.col("model") == CODE_MODEL), profiles).first().asDict()

    def handle_line(self, line: str) -> str | None:
        """The answer to one line; None for blank lines and notifications."""
        if not line.strip():
            return None
        answer = lambda i, **x: json.dumps({"jsonrpc": "2.0", "id": i, **x}, default=str)
        error = lambda i, code, text: answer(i, error={"code": code, "message": text})
        try:
            q = json.loads(line)
        except ValueError as e:
            return error(None, -32700, str(e))
        if not isinstance(q, dict) or q.get("jsonrpc") != "2.0" or not isinstance(q.get("method"), str):
            return error(q.get("id") if isinstance(q, dict) else None, -32600, "not a request")
        params = q.get("params") or {}
        if not isinstance(params, dict):
            return error(q.get("id"), -32602, "params must be an object")
        try:
            result = self.call(q["method"], params)
        except KeyError as e:
            missing = e.args[0] != q["method"]
            return error(q.get("id"), -32602 if missing else -32601, f"missing {e}" if missing else f"unknown method {q['method']}")
        except QueryError as e:
            bad = q["method"].rpartition(".")[2] in self.LSP
            return error(q.get("id"), -32602 if bad else -32603, str(e))
        return answer(q["id"], result=result) if "id" in q else None


def serve(router: Router, bind: str = "127.0.0.1", port: int = 9339) -> socketserver.TCPServer:
    """A bound TCP server of the router: one exchange for each connection."""

    class Exchange(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for raw in self.rfile:
                said = router.handle_line(raw.decode(errors="replace"))
                if raw.strip():
                    if said is not None:
                        self.wfile.write(said.encode() + b"\n")
                    return

    class Server(socketserver.ThreadingTCPServer):
        allow_reuse_address = daemon_threads = True

    return Server((bind, port), Exchange)


def serve_lines(router: Router, lines: Iterable[str], out: TextIO) -> None:
    """Answers to lines until they end; blank ones are skipped."""
    for line in lines:
        if (said := router.handle_line(line)) is not None:
            print(said, file=out, flush=True)


def doctor() -> dict:
    """What this engine has, and which external programs run here."""
    inventory = runtimes.Resolver().inventory()
    runs = {s["spec"]["id"]: s["available"] for s in inventory["runtimes"]}
    engines = {"tree_sitter": True, "lizard": runs["lizard"], "lsp_host": True, "rust_analyzer": runs["rust-analyzer"], "json_rpc": True}
    return {"name": "orrery", "version": VERSION, "sdk": "available", "store": "parquet", "world_models": [CODE_MODEL], "language_packs": ["rust"], "coverage_formats": ["lcov", "cobertura"], "analysis_engines": engines, "runtime_contract": inventory}


class Usage(Exception):
    """The command line is no command."""


#: Command: (positional arguments, options that take a value once).
COMMANDS = {
    "version": ((), ()),
    "doctor": ((), ()),
    "runtimes": ((), ()),
    "init": (("STORE",), ()),
    "index": (("STORE", "PATH"), ("revision", "coverage", "lizard")),
    "snapshots": (("STORE",), ("world",)),
    "inspect": (("STORE", "WORLD", "VERSION", "ENTITY"), ()),
    "find": (("STORE", "WORLD", "VERSION"), ("path", "name", "kind", "language", "line", "limit")),
    "impact": (("STORE", "WORLD", "VERSION", "ENTITY"), ("depth", "max-nodes")),
    "diff": (("STORE", "WORLD", "FROM", "TO"), ()),
    "gaps": (("STORE", "WORLD", "VERSION"), ()),
    "dependencies": (("STORE", "WORLD", "VERSION", "ENTITY"), ("direction", "depth", "max-nodes", "scores")),
    "patterns": (("STORE", "WORLD", "VERSION"), ("stability", "logic", "friction", "autonomy", "threshold", "limit")),
    "friction": (("STORE", "WORLD", "VERSION"), ("minimum", "limit")),
    "unstable": (("STORE", "WORLD", "VERSION"), ("maximum", "limit")),
    "stats": (("STORE", "WORLD", "VERSION"), ()),
    "serve": (("STORE",), ("bind", "port")),
    "lsp-register": (("STORE",), ("id", "language", "command", "argument", "extension")),
    "lsp-unregister": (("STORE",), ("id",)),
    "lsp-list": (("STORE",), ()),
}
#: Options that may come more than once.
REPEATED = {"coverage", "argument", "extension"}


def parse(argv: list[str]) -> tuple[str, list[str], dict]:
    """(command, positional arguments, options), or Usage."""
    if not argv or argv[0] not in COMMANDS:
        raise Usage("commands: " + ", ".join(COMMANDS))
    names, allowed = COMMANDS[argv[0]]
    usage = f"usage: {argv[0]} {' '.join(f'<{n}>' for n in names)} {' '.join(f'[--{o} VALUE]' for o in allowed)}".strip()
    places, options, rest = [], {}, iter(argv[1:])
    for word in rest:
        if not word.startswith("--"):
            places.append(word)
            continue
        name, value = word[2:], next(rest, None)
        if name not in allowed or value is None or (name in options and name not in REPEATED):
            raise Usage(f"option {word} is unknown, has no value or comes twice\n{usage}")
        options[name] = [*options.get(name, []), value] if name in REPEATED else value
    if len(places) != len(names):
        raise Usage(usage)
    return argv[0], places, options


def _number(options: dict, name: str, kind: type, default: Any) -> Any:
    try:
        return kind(options[name]) if name in options else default
    except ValueError as e:
        raise Usage(f"--{name}: {e}") from e


def run(command: str, places: list[str], o: dict, spark: Callable[[], SparkSession] = lambda: SparkSession.builder.getOrCreate()) -> Iterator[Any]:
    """What a command says: one value, or a row at a time where results are
    unbounded."""
    if command == "version":
        yield {"version": VERSION}
    elif command == "doctor":
        yield doctor()
    elif command == "runtimes":
        yield runtimes.Resolver().inventory()
    elif command.startswith("lsp-"):
        known = lsp_registry.Registry(places[0])
        if command == "lsp-register":
            yield asdict(known.upsert(lsp_registry.Registration(o.get("id", ""), o.get("language", ""), o.get("command", ""), o.get("argument", []), o.get("extension", []))))
        else:
            yield known.registrations() if command == "lsp-list" else {"id": o.get("id"), "removed": known.remove(o.get("id", ""))}
    else:
        yield from _run_stored(command, places, o, SnapshotStore(spark(), places[0]))


def _run_stored(command: str, places: list[str], o: dict, store: SnapshotStore) -> Iterator[Any]:
    router, dicts = Router(store), lambda df: (r.asDict(recursive=True) for r in df.toLocalIterator())
    at = dict(zip(("world", "version"), places[1:3], strict=False))
    whole, real = lambda n, d: _number(o, n, int, d), lambda n, d: _number(o, n, float, d)
    if command == "init":
        store.create()
        yield {"store": store.root, "created": True}
    elif command == "index":
        servers = [lsp_registry.Registration(**r) for r in lsp_registry.Registry(store.root).registrations()]
        analysers = [("lizard", lizard_analyser(o["lizard"]), True)] if "lizard" in o else []
        analysers += [(f"lsp.registered:{s.id}", lsp_analyser(s), False) for s in servers]
        yield Engine(store.spark, store, analysers).index(places[1], o.get("revision", "HEAD"), o.get("coverage", []))
    elif command == "snapshots":
        yield from dicts(store.snapshots(o.get("world")))
    elif command == "inspect":
        found = next(dicts(store.entity(*places[1:4])), None)
        if found is None:
            raise EntityNotFound(f"entity {places[3]} does not exist in snapshot")
        yield {"entity": found, "relations": [*dicts(find.relations_of(store.relations(*places[1:3]), places[3]))]}
    elif command == "find" and "line" in o:
        if "path" not in o:
            raise Usage("--line requires --path")
        spans = find.summary(store.entities(*places[1:3]))
        yield from dicts(find.at_location(spans, o["path"], whole("line", None)))
    elif command == "find":
        yield from dicts(find.code_find(store.entities(*places[1:3]), o.get("path"), o.get("name"), o.get("kind"), o.get("language"), whole("limit", None)))
    elif command == "diff":
        a, b = (places[1], places[2]), (places[1], places[3])
        yield from dicts(diff.diff(store.entities(*a).unionByName(store.entities(*b)), store.relations(*a).unionByName(store.relations(*b)), a, b))
    elif command == "serve":
        with serve(router, o.get("bind", "127.0.0.1"), whole("port", 9339)) as server:
            yield {"listening": "%s:%d" % server.server_address[:2]}
            server.serve_forever()
    elif command == "impact":
        yield router.call("impact", at | {"id": places[3], "maxDepth": whole("depth", 3), "maxNodes": whole("max-nodes", 1000)})
    elif command == "dependencies":
        yield router.call("queryDependencies", at | {"id": places[3], "direction": o.get("direction", "both"), "maxDepth": whole("depth", -1), "maxNodes": whole("max-nodes", 10_000), "includeScores": o.get("scores") == "true"})
    elif command == "patterns":
        yield router.call("queryPatterns", at | {"profile": {d: real(d, 0.5) for d in DIMENSIONS}, "threshold": real("threshold", 0.8), "limit": whole("limit", 50)})
    elif command == "friction":
        yield router.call("getHighFriction", at | {"minimum": real("minimum", 0.7), "limit": whole("limit", 20)})
    elif command == "unstable":
        yield router.call("getUnstable", at | {"maximum": real("maximum", 0.4), "limit": whole("limit", 20)})
    else:
        yield router.call({"gaps": "gaps", "stats": "getStats"}[command], at)


def main(argv: list[str]) -> int:
    """A command; results on stdout as envelopes, errors on stderr. 0, 1 if the
    command failed, 2 if it is none."""
    import sys

    try:
        command, places, options = parse(argv)
        for value in run(command, places, options):
            print(envelope(command, value), flush=True)
    except Usage as e:
        print(envelope("error", str(e)), file=sys.stderr)
        return 2
    except (QueryError, KeyError, OSError) as e:
        print(envelope("error", str(e)), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    import sys

    sys.exit(main(sys.argv[1:]))
