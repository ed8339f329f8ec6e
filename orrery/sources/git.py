"""A Git commit as artifacts, blobs, history and file entities.

Git itself runs as child processes: the listing and the log on the driver (both
are one sequential stream by nature), blobs in tasks, a group of artifacts at a
time, on hosts that see the repository.
"""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.scalars import detect_language, file_id, json_string, media_type, normalize_remote
from orrery.operators.derive import file_history
from orrery.folders import shared_folder
from orrery.schema import MEASUREMENT, SCORE, QueryError

#: Bytes of one read group; days that count as recent.
GROUP_BYTES, RECENT_DAYS = 4 << 20, 90
#: Bytes of the log read at a time; changes that the driver holds at a time.
CHUNK_BYTES, LOG_BATCH = 1 << 16, 50_000
_LOG = ("--reverse", "--topo-order", "--name-status", "-M90", "-z", "--format=%x01%H%x1f%at%x1f%ae%x1f%aI")
CHANGE = "seq long, ts long, author string, day string, status string, path string, old_path string"


class SourceError(QueryError):
    pass


def _git(root: str, *args: str, data: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", root, *args], input=data, capture_output=True)
    if done.returncode:
        raise SourceError(done.stderr.decode(errors="replace").strip())
    return done.stdout


def git_inspect(spark: SparkSession, path: str, revision: str = "HEAD") -> dict:
    """root, commit, branch, remote, dirty, world and version; the commit alone
    is the identity."""
    root = _git(path, "rev-parse", "--show-toplevel").decode().strip()
    commit = _git(root, "rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()
    branch = _git(root, "rev-parse", "--abbrev-ref", "HEAD").decode().strip()
    try:
        origin = _git(root, "config", "--get", "remote.origin.url").decode().strip()
    except SourceError:
        origin = ""
    remote = spark.range(1).select(normalize_remote(F.lit(origin))).first()[0]
    repository = f"remote:{remote}" if remote else "local:" + hashlib.sha256(root.encode()).hexdigest()[:32]
    return {
        "root": root,
        "commit": commit,
        "branch": None if branch == "HEAD" else branch,
        "remote": remote,
        "dirty": bool(_git(root, "status", "--porcelain")),
        "world": f"code.repository:{repository}",
        "version": commit,
    }


def parse_tree(raw: DataFrame) -> DataFrame:
    """path, oid, mode, size, language of the blobs in (record), by path."""
    fields = F.split(F.regexp_extract("record", r"^([^\t]*)\t", 1), r"\s+")
    path = F.regexp_extract("record", r"(?s)^[^\t]*\t(.*)$", 1)
    rows = raw.where(F.get(fields, 1) == "blob").select(path.alias("path"), F.get(fields, 2).alias("oid"), F.get(fields, 0).alias("mode"), F.when(F.get(fields, 3) != "-", F.get(fields, 3).cast("long")).alias("size"))
    bad = F.raise_error(F.concat(F.lit("newline in path: "), F.col("path")))
    return rows.withColumn("path", F.when(F.regexp_like("path", F.lit("[\r\n]")), bad).otherwise(F.col("path"))).withColumn("language", detect_language(F.col("path"))).orderBy("path")


def git_tree(spark: SparkSession, root: str, commit: str) -> DataFrame:
    """The tracked files of a commit."""
    try:
        records = _git(root, "ls-tree", "-r", "-z", "-l", commit).decode().split("\0")
    except UnicodeDecodeError as e:
        raise SourceError("the tree contains a path that is not UTF-8") from e
    return parse_tree(spark.createDataFrame([(r,) for r in records if r], "record string"))


def read_groups(sizes: list[int | None], budget: int = GROUP_BYTES) -> list[list[int]]:
    """Consecutive items in groups of at most budget bytes; items of unknown or
    larger size are alone."""
    out: list[list[int]] = []
    held = None
    for i, size in enumerate(sizes):
        if size is None or size > budget:
            out.append([i])
            held = None
        elif held is not None and held + size <= budget:
            out[-1].append(i)
            held += size
        else:
            out.append([i])
            held = size
    return out


def git_blobs(files: DataFrame, root: str) -> DataFrame:
    """files (path, oid, size) with content; a group of files is one child
    process. Type, id and size of every blob are verified."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sizes = [None if pd.isna(s) else int(s) for s in pdf["size"]]
            for group in read_groups(sizes):
                part = pdf.iloc[group]
                raw, at, contents = _git(root, "cat-file", "--batch", data="".join(f"{o}\n" for o in part["oid"]).encode()), 0, []
                for oid, size in zip(part["oid"], [sizes[i] for i in group], strict=True):
                    end = raw.index(b"\n", at)
                    head = raw[at:end].decode().split(" ")
                    if len(head) != 3 or head[0] != oid or head[1] != "blob" or (size is not None and int(head[2]) != size):
                        raise SourceError(f"unexpected blob: {head}")
                    stop = end + 1 + int(head[2])
                    if raw[stop : stop + 1] != b"\n":
                        raise SourceError(f"blob {oid} is cut short")
                    contents.append(raw[end + 1 : stop])
                    at = stop + 1
                yield pd.DataFrame({"path": part["path"].to_numpy(), "oid": part["oid"].to_numpy(), "content": contents})

    return files.select("path", "oid", "size").mapInPandas(run, "path string, oid string, content binary")


def _log_blocks(root: str, commit: str) -> Iterator[str]:
    """The log's commits one by one, read from the child process by chunks."""
    with subprocess.Popen(["git", "-C", root, "log", *_LOG, commit], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as child:
        held = b""
        while chunk := child.stdout.read(CHUNK_BYTES):
            *whole, held = (held + chunk).split(b"\x01")
            yield from (b.decode(errors="replace") for b in whole if b)
        if held:
            yield held.decode(errors="replace")
        problem = child.stderr.read().decode(errors="replace").strip()
    if child.returncode:
        raise SourceError(problem)


def _log_rows(root: str, commit: str) -> Iterator[tuple]:
    """Rows of CHANGE, in the log's order."""
    seq = 0
    for block in _log_blocks(root, commit):
        head, _, rest = block.partition("\0")
        _, at, author, day = head.strip("\n").split("\x1f")
        tokens = [t.lstrip("\n") for t in rest.split("\0") if t.strip("\n")]
        while tokens:
            status = tokens.pop(0)
            old = tokens.pop(0) if status[0] in "RC" else None
            yield (seq, int(at), author, day, status[0], tokens.pop(0), old)
            seq += 1


def git_changes(spark: SparkSession, root: str, commit: str, batch: int = LOG_BATCH) -> DataFrame:
    """Every change of every commit up to this one, in topological order. A log
    of more than a batch of changes goes to the shared folder batch by batch, so
    that the driver holds one."""
    rows = _log_rows(root, commit)
    first = list(islice(rows, batch))
    more = list(islice(rows, batch))
    if not more:
        return spark.createDataFrame(first, CHANGE)
    folder = shared_folder(spark, "log")
    for part in (first, more, *iter(lambda: list(islice(rows, batch)), [])):
        spark.createDataFrame(part, CHANGE).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def lineages(changes: DataFrame) -> DataFrame:
    """changes with lineage: the path that a change's history ends at, null if
    a rename overwrote it. Only changes of paths that some rename touches are
    put in order, in one pass, as renames of a log are a sequence; all other
    changes are of their own path."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="world").sort_values("seq")
        at: dict[str, int] = {}
        owner: list[int] = []
        for n, (status, path, old) in enumerate(zip(pdf["status"], pdf["path"], pdf["old_path"], strict=True)):
            if status == "R":
                at[path] = at.pop(old, n + len(pdf))
            at.setdefault(path, n)
            owner.append(at[path])
        last = {v: k for k, v in at.items()}
        return pdf.assign(lineage=[last.get(o) for o in owner])

    touched = changes.where("status = 'R'").select(F.explode(F.array("path", "old_path")).alias("path")).distinct()
    alone = changes.join(touched, "path", "left_anti").withColumn("lineage", F.col("path"))
    moved = changes.join(touched, "path", "left_semi").withColumn("world", F.lit(1)).groupBy("world")
    return alone.unionByName(moved.applyInPandas(run, CHANGE + ", lineage string"))


def git_history(changes: DataFrame, snapshot_ts: int) -> DataFrame:
    """file_history of each lineage, recent: within 90 days of the snapshot."""
    rows = lineages(changes).where("lineage IS NOT NULL").drop("path").withColumnRenamed("lineage", "path")
    first, last = F.min_by("day", "seq").alias("created_day"), F.max_by("day", "seq").alias("modified_day")
    return file_history(rows, snapshot_ts - RECENT_DAYS * 86400, also=(first, last))


def _history_attributes() -> list[Column]:
    return [
        F.lit("git.created_at"), json_string(F.col("created_day")), F.lit("git.last_modified_at"), json_string(F.col("modified_day")),
        F.lit("git.recent_frequency"), json_string(F.col("frequency")),
    ]


def artifact_attributes(files: DataFrame, history: DataFrame) -> DataFrame:
    """path, content_id, media_type and attributes (JSON texts) of every tracked
    file; its history is among them where its language is known."""
    known = files.where("language IS NOT NULL").select("path").join(history, "path")
    found = files.select("path", "oid", "mode", "size", "language").join(known, "path", "left")
    number = lambda c: F.col(c).cast("string")
    attributes = F.create_map(
        F.lit("language"), json_string(F.col("language")), F.lit("git.mode"), json_string(F.col("mode")), F.lit("file.size_bytes"), F.coalesce(number("size"), F.lit("null")), *_history_attributes(),
        F.lit("git.total_commits"), number("commits"), F.lit("git.contributors"), number("contributors"), F.lit("git.average_days_between_changes"), number("average_days"), F.lit("git.recent_commits"), number("recent"),
    )
    return found.select("path", F.col("oid").alias("content_id"), media_type(F.col("language")).alias("media_type"), F.map_filter(attributes, lambda k, v: v.isNotNull()).alias("attributes"))


def git_inventory(files: DataFrame, history: DataFrame, world: str, version: str) -> DataFrame:
    """File entities of known languages, with their history as measurements."""
    m = lambda name, c, unit="count": F.struct(F.lit(name).alias("name"), F.col(c).cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit("git").alias("observer"), F.lit(1.0).alias("confidence"))
    known = files.where("language IS NOT NULL").join(history, "path", "left")
    evidence = F.array(m("git.total_commits", "commits"), m("git.contributors", "contributors"), m("git.recent_commits", "recent"), m("git.average_days_between_changes", "average_days", "days"))
    attributes = F.create_map(
        F.lit("file_path"), json_string(F.col("path")), F.lit("language"), json_string(F.col("language")), F.lit("git.blob_oid"), json_string(F.col("oid")), F.lit("git.mode"), json_string(F.col("mode")),
        F.lit("file.size_bytes"), F.coalesce(F.col("size").cast("string"), F.lit("null")), *_history_attributes(),
    )
    return known.select(
        F.lit(world).alias("world"),
        F.lit(version).alias("version"),
        file_id(F.col("path")).alias("id"),
        F.lit("code").alias("model"),
        F.lit("file").alias("kind"),
        F.col("path").alias("label"),
        F.map_filter(attributes, lambda k, v: v.isNotNull()).alias("attributes"),
        F.when(F.col("commits").isNotNull(), evidence).otherwise(F.array()).cast(f"array<{MEASUREMENT}>").alias("measurements"),
        F.array().cast(f"array<{SCORE}>").alias("scores"),
    )
