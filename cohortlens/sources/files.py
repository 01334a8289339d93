"""Table and report files: CSV, Parquet and JSON through the Spark readers and writers."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import shared_dir


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV with every column as text; typing is left to the standardizer."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_view(spark: SparkSession, path: str, name: str) -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return spark.table(name)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fingerprint(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """SHA-256 of a dataset: of the bytes of a single file, else a hash tree over the files.

    Each file is hashed in the task that reads it. The sorted digests are hashed per prefix
    (4,096 groups) and these once more, so no task holds the list of all files.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    digests = found.select(F.sha2("content", 256).alias("sha256"))

    def joined(column: str):
        return F.sha2(F.concat_ws("", F.sort_array(F.collect_list(column))), 256)

    count = F.count(F.lit(1))
    groups = digests.groupBy(F.substring("sha256", 1, 3).alias("prefix")).agg(
        count.alias("files"), F.max("sha256").alias("one"), joined("sha256").alias("many")
    )
    files = F.sum("files")
    return groups.agg(
        files.alias("files"), F.when(files == 1, F.max("one")).otherwise(joined("many")).alias("sha256")
    )


def content_fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table's content, whatever its files, row order or compression: the sum of 60-bit row digests.

    Values are compared as text, NULL apart from empty; both columns are partial sums, no row leaves its task.
    """
    text = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in df.columns]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *text)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(bits).cast("string").alias("digest"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
