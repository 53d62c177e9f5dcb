"""What the operators of this subpackage share: reading tables, cutting lineage, deterministic sampling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that every executor sees: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own; a
    cluster must name one, since its executors share no local disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that lost executors cost no recomputation."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else df.sparkSession.read.parquet(path)
    out.written_to = path
    return out


def erase(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_training_row(id_col: Column) -> Column:
    """The rows from which labels may be learned; the rest is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def slices(batches: Iterator[pa.RecordBatch], text: str, max_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``max_chars`` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = batch.column(batch.schema.get_field_index(text)).nbytes
        step = max(1, n * max_chars // max(size, 1))
        for i in range(0, n, step):
            yield batch.slice(i, step)
