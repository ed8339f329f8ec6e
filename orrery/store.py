"""Snapshots in Parquet: immutable generations and an atomic pointer.

A snapshot's rows live in ``<root>/<table>/generation=<id>``; which generation
a (world, version) has stands in one small JSON file that is replaced by a
rename. Readers of an old generation are undisturbed, a rejected batch leaves
no trace, and an empty batch empties its snapshot.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.validate import violations
from orrery.schema import ENTITY_DDL, RELATION_DDL, InvalidBatch


class SnapshotStore:
    """A folder on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self) -> None:
        """The store's folder, if it is not there."""
        self._fs.mkdirs(self._path(f"{self.root}/snapshots"))

    def _pointer(self, world: str, version: str) -> str:
        name = hashlib.sha256(f"{world}\0{version}".encode()).hexdigest()[:40]
        return f"{self.root}/snapshots/{name}.json"

    def _write_pointer(self, record: dict) -> None:
        path = self._pointer(record["world"], record["version"])
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/snapshots"))
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options, "Rename").OVERWRITE
        context.rename(self._path(draft), self._path(path), options)

    def ingest(self, world: str, version: str, entities: DataFrame, relations: DataFrame, coverage: str = "complete", provenance: list[dict] | None = None, diagnostics: list[dict] | None = None) -> dict:
        """Validate, write, then publish: replaces exactly this snapshot."""
        broken = violations(entities, relations, world, version).orderBy("order", "id").limit(5).collect()
        if broken:
            raise InvalidBatch("; ".join(f"{r['rule']}: {r['id']}" for r in broken))
        generation = uuid.uuid4().hex
        counts = {}
        for name, df, ddl in (("entities", entities, ENTITY_DDL), ("relations", relations, RELATION_DDL)):
            where = f"{self.root}/{name}/generation={generation}"
            columns = [c.strip().split(" ")[0] for c in _top_level(ddl)]
            df.select(*columns).sortWithinPartitions("id").write.parquet(where)
            counts[name] = self.spark.read.schema(ddl).parquet(where).count()
        record = {
            "world": world,
            "version": version,
            "coverage": coverage,
            "entity_count": counts["entities"],
            "relation_count": counts["relations"],
            "generation": generation,
            "provenance": provenance or [],
            "diagnostics": diagnostics or [],
        }
        self._write_pointer(record)
        return record

    def snapshots(self, world: str | None = None) -> DataFrame:
        """Records by world and version."""
        ddl = "world string, version string, coverage string, entity_count long, relation_count long, generation string, provenance array<map<string,string>>, diagnostics array<map<string,string>>"
        folder = f"{self.root}/snapshots"
        if not self._fs.exists(self._path(folder)):
            return self.spark.createDataFrame([], ddl)
        found = self.spark.read.schema(ddl).json(folder)
        return (found if world is None else found.where(F.col("world") == world)).orderBy("world", "version")

    def snapshot(self, world: str, version: str) -> dict | None:
        """One record, or None."""
        path = self._path(self._pointer(world, version))
        if not self._fs.exists(path):
            return None
        rows = self.spark.read.text(self._pointer(world, version), wholetext=True).collect()
        return json.loads(rows[0][0])

    def _scan(self, name: str, ddl: str, world: str, version: str) -> DataFrame:
        record = self.snapshot(world, version)
        if record is None:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.root}/{name}/generation={record['generation']}")

    def entities(self, world: str, version: str) -> DataFrame:
        """All entities of a snapshot; none if it is unknown."""
        return self._scan("entities", ENTITY_DDL, world, version)

    def relations(self, world: str, version: str) -> DataFrame:
        return self._scan("relations", RELATION_DDL, world, version)

    def entities_scan(self, world: str, version: str) -> DataFrame:
        """All entities of a snapshot by id."""
        return self.entities(world, version).orderBy("id")

    def relations_scan(self, world: str, version: str) -> DataFrame:
        """All relations of a snapshot by id."""
        return self.relations(world, version).orderBy("id")

    def entity(self, world: str, version: str, entity_id: str) -> DataFrame:
        return self.entities(world, version).where(F.col("id") == entity_id).limit(1)


def _top_level(ddl: str) -> list[str]:
    """The columns of a DDL string, commas inside brackets apart."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]
