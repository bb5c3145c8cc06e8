"""Cutting lineage in iterative plans: written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def folder(spark, name: str = "step") -> str:
    """A new path in spark.checkpoint.dir (a temporary folder only where that is unset), removed with the session."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="deploom-shared-")
        sc.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/deploom-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once into a ``folder`` and read it back."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def present(spark, pattern: str) -> list[str]:
    """Paths that match."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [f.getPath().toString() for f in found or ()]


def counted(df: DataFrame, name: str = "step", column: str | None = None) -> tuple[DataFrame, int]:
    """``materialise``, and how many rows were written (with ``column``: where that is not null), counted on the way."""
    seen = Observation()
    what = F.lit(1) if column is None else F.col(column)
    out = materialise(df.observe(seen, F.count(what).alias("rows")), name)
    rows = seen.get.get("rows")
    return out, out.where(what.isNotNull()).count() if rows is None else rows


def _remove(spark, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass
