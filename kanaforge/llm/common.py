"""Shared helpers: scratch tables in the cluster's shared folder, bounded label samples, table access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that Python turns into objects at a time inside a task.
SLICE_ROWS = 256


#: What this worker process remembers between its tasks: that of the operator which ran last.
_IN_USE: list[dict] = []


def remember(*found: dict) -> None:
    """At the start of a task: what its worker process keeps in these for its next tasks.

    What it has kept for another operator is cleared. Workers outlive the stages of a session, so what each operator
    remembers would add up otherwise. Without arguments nothing is kept."""
    for other in _IN_USE:
        if not any(other is x for x in found):
            other.clear()
    _IN_USE[:] = found


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="kanaforge-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where all run in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own_dir()


def materialize(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    Returns the table and its path (for drop())."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kanaforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame) -> DataFrame:
    return materialize(df)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def packed(df: DataFrame) -> Column:
    """A whole row as one struct, behind which no column's name can clash; its fields are the columns in order."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def id_bucket(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod: the hold-out rule of the learned operators."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % mod


def label_sample(lab: DataFrame, label: str, mod: int, held: int, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """At most per_class labelled rows of each class outside the hold-out, picked by a hash of the id.

    Returns (doc_id, y) of at most 2 x per_class rows - the proven bound that lets callers broadcast it -
    and the weight of each class that restores the label table's class shares."""
    usable = lab.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (id_bucket("doc_id", mod) != held)).select("doc_id", F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    picked = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    total = sum(counts.values()) or 1
    kept = {y: min(per_class, counts.get(y, 0)) for y in (0, 1)}
    n = sum(kept.values()) or 1
    weight = {y: (counts.get(y, 0) / total) / (kept[y] / n) if kept[y] else 0.0 for y in (0, 1)}
    return picked[0].unionByName(picked[1]).dropDuplicates(["doc_id"]), weight


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(y, text) of a sample (doc_id, y) as of label_sample(): one row for each id, of several texts the smallest."""
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return picked.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text")).select("y", "text")


def utf8_values(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string column as UTF-8 bytes, a slice of rows at a time."""
    for at in range(0, len(column), SLICE_ROWS):
        yield from column.slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist()


def str_values(column: pa.Array) -> Iterator[str | None]:
    for at in range(0, len(column), SLICE_ROWS):
        yield from column.slice(at, SLICE_ROWS).to_pylist()
