"""Versions of a store of words, addressed by content.

A store is cut into buckets by a hash of the word. A version is a manifest: for each bucket its rows, a hash of its content that does not
depend on their order, and where the bucket's file is; the hashes of the buckets make those of their groups, and these the root. A new
version writes only buckets whose hash no earlier version has, and its manifest last, so nothing that a reader may hold is ever changed.
Loading checks the manifest against its root and every bucket against the manifest, and falls back to the last version that is whole.
The difference of two versions reads only buckets whose hashes differ."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, GROUPS = 256, 16
MANIFEST = "bucket int, rows long, hash string, object string, root string"


def bucket_of(word: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def bucket_hashes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket, rows, hash) of rows (bucket, columns...): sums and counts, so tasks add up what they have before any exchange."""
    one = F.xxhash64(*columns)
    return rows.groupBy("bucket").agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*"), F.sum(one.cast("decimal(38,0)")), F.bit_xor(one), F.sum(F.crc32(F.to_json(F.struct(*columns)).cast("binary")))), 256).alias("hash"))


def root_of(manifest: DataFrame) -> str:
    """The hash over all buckets, by way of their groups: a small table, one row a bucket."""
    groups = manifest.groupBy((F.col("bucket") % GROUPS).alias("group")).agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "rows", "hash")))), 256).alias("hash"))
    return groups.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "group", "hash")))), 256)).first()[0]


def _number(path: str) -> int:
    return int(path.rsplit("/v", 1)[1])


def _versions(spark: SparkSession, folder: str, whole: bool = True) -> list[str]:
    """Paths of the manifests (whole: that were written to their end), the newest first."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(where)] if files.exists(where) else []
    named = [p for p in found if re.fullmatch(r"v\d+", p.getName())]
    return sorted((str(p) for p in named if not whole or files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), key=_number, reverse=True)


def manifest_of(spark: SparkSession, path: str) -> DataFrame | None:
    """A version's manifest, if it is the one that its root names."""
    try:
        found = spark.read.schema(MANIFEST).parquet(path)
        roots = [r[0] for r in found.select("root").distinct().collect()]
        return found if len(roots) == 1 and roots[0] == root_of(found) else None
    except Exception as e:  # Spark tells of damaged files by errors of many classes
        if "parquet" in str(e).lower() or "FAILED_READ_FILE" in str(e) or "CANNOT_READ" in str(e):
            return None
        raise


def save(rows: DataFrame, folder: str, word: str = "word", buckets: int = BUCKETS) -> str:
    """Write rows as the next version; the path of its manifest. Buckets that an earlier whole version has are not written."""
    spark, columns = rows.sparkSession, rows.columns
    cut = rows.withColumn("bucket", bucket_of(word, buckets))
    hashes = bucket_hashes(cut, columns)
    known = [m for m in (manifest_of(spark, p) for p in _versions(spark, folder)[:1]) if m is not None]
    earlier = known[0].select("bucket", "hash", F.col("object").alias("_object")) if known else spark.createDataFrame([], "bucket int, hash string, _object string")
    name = uuid.uuid4().hex
    told = hashes.join(earlier, ["bucket", "hash"], "left").select("bucket", "rows", "hash", F.coalesce("_object", F.lit(name)).alias("object"))
    listed = spark.createDataFrame(told.collect(), "bucket int, rows long, hash string, object string")  # a row for each bucket
    fresh = [r["bucket"] for r in listed.where(F.col("object") == name).collect()]
    if fresh:
        cut.where(F.col("bucket").isin(fresh)).repartition(min(len(fresh), buckets), "bucket").write.partitionBy("bucket").parquet(f"{folder}/objects/{name}")
    number = max(map(_number, _versions(spark, folder, whole=False)), default=0) + 1
    path = f"{folder}/versions/v{number:08d}"
    listed.withColumn("root", F.lit(root_of(listed))).coalesce(1).write.parquet(path)
    return path


def rows_of(spark: SparkSession, folder: str, manifest: DataFrame, schema: str, only: list[int] | None = None) -> DataFrame:
    """(bucket, columns...) of a version's buckets, or of some of them."""
    places = [(r["object"], r["bucket"]) for r in manifest.collect() if only is None or r["bucket"] in only]
    parts = [f"{folder}/objects/{o}/bucket={b}" for o, b in sorted(places)]
    if not parts:
        return spark.createDataFrame([], f"bucket int, {schema}")
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    read = spark.read.schema(schema).parquet(*parts)
    return read.select(F.regexp_extract(F.col("_metadata.file_path"), "bucket=([0-9]+)", 1).cast("int").alias("bucket"), *columns)


def broken_buckets(spark: SparkSession, folder: str, manifest: DataFrame, schema: str) -> list[int]:
    """Buckets whose files are missing, cannot be read, or hold other rows than the manifest says."""
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    try:
        found = bucket_hashes(rows_of(spark, folder, manifest, schema), columns)
        both = manifest.select("bucket", "rows", "hash").join(found.select("bucket", F.col("rows").alias("_rows"), F.col("hash").alias("_hash")), "bucket", "left")
        return sorted(r["bucket"] for r in both.where(~F.coalesce((F.col("rows") == F.col("_rows")) & (F.col("hash") == F.col("_hash")), F.lit(False))).select("bucket").collect())
    except Exception as e:
        if any(x in str(e) for x in ("FAILED_READ_FILE", "PATH_NOT_FOUND", "CANNOT_READ", "parquet", "FileNotFound")):
            return [-1]
        raise


def load(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """The rows of the newest version that is whole; None where there is none."""
    for path in _versions(spark, folder):
        manifest = manifest_of(spark, path)
        if manifest is not None and not broken_buckets(spark, folder, manifest, schema):
            return rows_of(spark, folder, manifest, schema).drop("bucket")
    return None


def drift(spark: SparkSession, folder: str, old: str, new: str, schema: str) -> DataFrame:
    """(word, change): missing, extra and changed readings between two versions (paths of manifests), which need word and kana."""
    from kanaforge.operators.lexicon import drift as compared

    a, b = (spark.read.schema(MANIFEST).parquet(p) for p in (old, new))
    other = a.select("bucket", "hash").join(b.select("bucket", F.col("hash").alias("_hash")), "bucket", "full_outer")
    differ = [r["bucket"] for r in other.where(~F.coalesce(F.col("hash") == F.col("_hash"), F.lit(False))).collect()]
    return compared(*(rows_of(spark, folder, m, schema, differ).drop("bucket") for m in (a, b)))
