"""What the operators need from a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where it names none, a
    local session gets a folder of its own; a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="orrery-checkpoints-")


_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """This subpackage to the application's workers, once."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="orrery-package-")) / "orrery_llm.zip"
    with zipfile.ZipFile(archive, "w") as out:
        out.write(package.parent / "__init__.py", "orrery/__init__.py")
        for source in sorted(package.glob("*.py")):
            out.write(source, f"orrery/llm/{source.name}")
    context.addPyFile(str(archive))
    _sent.add(context.applicationId)


def prepare(spark: SparkSession, batch_rows: int = 400) -> None:
    """The session's checkpoint folder, this code on the workers, and Arrow
    batches small enough that long texts fit a worker."""
    send_package(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > batch_rows:
        spark.conf.set(key, str(batch_rows))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A key is hot if it holds more than one of this many parts of the rows, and
#: more rows than a task reads in a moment, if they are small.
HEAVY, SMALL_ROWS = 10_000, 50_000


def hot_keys(counts: DataFrame, key: str, floor: int, total: int) -> DataFrame | None:
    """The keys of counts (key, n) that hold more than floor rows and more than
    1/HEAVY of total, which is the sum of n or more; None if there are none.
    There are fewer than HEAVY whatever the input, so that they may be collected
    and broadcast."""
    if total <= floor:
        return None
    rows = counts.where(F.col("n") > max(floor, total // HEAVY)).select(key).collect()
    return counts.sparkSession.createDataFrame(rows, counts.select(key).schema) if rows else None


def join_spread(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Inner join of left with right (a row per key). Rows of hot keys are not
    shuffled: right's rows of those keys are broadcast to them."""
    if hot is None:
        return left.join(right, key)
    hot = F.broadcast(hot)
    rest = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key)
    return rest.unionByName(left.join(F.broadcast(right.join(hot, key, "left_semi")), key))


def nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed at every depth, as Arrow tables have them."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    return T.MapType(kind.keyType, nullable(kind.valueType)) if isinstance(kind, T.MapType) else kind
