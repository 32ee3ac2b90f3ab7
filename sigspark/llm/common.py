"""Shared plumbing: reading tables, shipping the package to executors, batch mapping, shared folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows an Arrow batch holds at most; rows can be long texts, so far fewer than Spark's default of 10,000.
BATCH_ROWS = 500
_shipped: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="pkg")
    atexit.register(shutil.rmtree, folder, True)
    root = Path(__file__).resolve().parent.parent
    path = f"{folder}/{root.name}_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset, a folder of our own on a local master, and an error on any other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _shipped.get("root")
        if not root:
            root = _shipped["root"] = f"file://{tempfile.mkdtemp(prefix='shared')}"
            atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared root; removed when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, with its lineage cut there."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: compressed, columnar, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, func: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """func over Arrow batches of BATCH_ROWS rows at most, one at a time: memory is bounded by a batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH_ROWS):
                if (out := func(b.slice(i, BATCH_ROWS))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def map_stream(df: DataFrame, func: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """func over the iterator of a partition's batches, each sliced to BATCH_ROWS."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from func(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Lowers Arrow's rows a batch where the session left Spark's default, and its bytes a batch, as a row here may be a long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def text_or_empty(col: str) -> F.Column:
    return F.coalesce(F.col(col), F.lit(""))


def apart(df: DataFrame, reserved: tuple[str, ...]) -> tuple[DataFrame, list[F.Column]]:
    """df with columns of reserved names renamed, and the columns that give df's own back from what was made of it."""
    taken = {c.lower() for c in df.columns} | {r.lower() for r in reserved}
    back, out = [], []
    for c in df.columns:
        name = c
        if c.lower() in {r.lower() for r in reserved}:
            while name.lower() in taken:
                name = f"own_{name}"
            taken.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
        back.append(F.col(f"`{name}`").alias(c))
    return df.select(*out), back
