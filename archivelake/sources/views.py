"""Archives over ordinary tables: their rows seen as files with paths, addresses and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import stats
from ..schema import FILE_COLUMNS


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(rows: DataFrame, path, size, key: str, shards: int = 3) -> DataFrame:
    """Files of rows laid into shards by key, with the other columns that files have."""
    k = F.col(key)
    rows = rows.withColumns({"path": path, "size": size.cast("long"), "shard": (k % shards).cast("int")})
    before = Window.partitionBy("shard").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns(
        {
            "parent": paths.parent(F.col("path")),
            "offset": F.coalesce(F.sum("size").over(before), F.lit(0)),
            "crc32c": F.lit(None).cast("long"),
            "mode": F.lit(33188),
            "uid": (1000 + k % 5).cast("int"),
            "gid": F.lit(100),
            "mtime_ns": F.lit(1700000000000000000) + k * 1000000007,
        }
    )


def doc_files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    rows = read(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")))
    out = _files(rows, path, F.octet_length("text"), "doc_id")
    return out.select(*FILE_COLUMNS, "doc_id", *([F.encode("text", "UTF-8").alias("content")] if content else []))


def doc_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_files(spark, sf_dir).filter("doc_id % 7 <> 3")


def doc_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.complete_dirs(doc_files(spark, sf_dir))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    path = F.concat_ws("/", F.lit("events"), F.date_format("ts", "yyyy/MM/dd/HH"), "event_type", F.concat(F.col("event_id").cast("string"), F.lit(".json")))
    return rows.select(path.alias("path"), F.octet_length("props").cast("long").alias("size")).withColumn("parent", paths.parent(F.col("path")))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders")
    path = F.concat_ws("/", F.lit("orders"), F.year("o_orderdate").cast("string"), "o_orderstatus", F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".json")))
    return rows.select(path.alias("path"), F.floor("o_totalprice").cast("long").alias("size")).withColumn("parent", paths.parent(F.col("path")))


def conv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    path = F.concat(F.lit("conv/"), F.lpad(F.col("conv_id").cast("string"), 5, "0"), F.lit("/"), F.lpad(F.col("turn").cast("string"), 3, "0"), F.lit("_"), F.col("role"), F.lit(".txt"))
    return rows.select(path.alias("path"), F.octet_length("text").cast("long").alias("size")).withColumn("parent", paths.parent(F.col("path")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    path = F.concat(F.lit("web/"), F.regexp_replace(bare, "/+$", ""), F.lit("/"), F.col("page_id").cast("string"), F.lit(".html"))
    return rows.select(path.alias("path"), F.octet_length("html").cast("long").alias("size")).withColumn("parent", paths.parent(F.col("path")))


def sync_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = doc_files(spark, sf_dir)
    other = files.filter("doc_id % 10 <> 1").withColumns({"size": F.expr("size + if(doc_id % 5 = 2, 1, 0)"), "mtime_ns": F.expr("mtime_ns + if(doc_id % 4 = 3, 1, 0)")})
    return files.filter("doc_id % 10 <> 0"), other
