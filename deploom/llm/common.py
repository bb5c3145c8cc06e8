"""Shared plumbing: tables, the cluster's shared folder, code shipping, Arrow mapping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark's own readers (any Hadoop store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Arrow functions can import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="deploom-"), "deploom_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(at, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; only where unset (tests) a temporary one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="deploom-shared-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    The table is computed once, survives lost executors, and is removed when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/deploom-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already; the folder is the cluster's to clean
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(batch) -> dict of columns`` over Arrow batches; the plan stays a narrow map."""
    ship(df.sparkSession)
    target = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict(fn(b), schema=target)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    return to_arrow_schema(kind)


def text_or_empty(col: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).alias("text")


def quoted(name: str):
    """The column of this very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted name one that no column of ``df`` has, whatever its letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(docs: DataFrame):
    """128 bits that tell rows apart by doc_id and text: no two different rows of any real corpus share them."""
    number = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return F.unhex(F.md5(F.concat(number, F.lit(" "), F.coalesce(F.col("text").cast("string"), F.lit("")))))


_ACTIVE: dict[str, object] = {}


def one_table_at_a_time(name: str, drop) -> None:
    """A worker keeps the look-up tables of one operator at a time: another's are dropped when ``name`` begins."""
    for other in [k for k in _ACTIVE if k != name]:
        _ACTIVE.pop(other)()
    _ACTIVE[name] = drop
