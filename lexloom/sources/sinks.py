"""Writing tables (SNK-*): idempotent overwrites, deletes by key, upserts, citations, audit lists, reports.

Tables are rewritten rather than updated in place: a partition of a version is overwritten as a whole, other
rows are kept by anti joins, so a job that is run again gives the same table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def overwrite_versions(rows: DataFrame, path: str, version: str) -> None:
    """SNK-01, SNK-02, SNK-06. Replace the partitions of the versions in `rows`, leave all others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def delete_versions(rows: DataFrame, versions: DataFrame, version: str, kind: Column | None = None) -> DataFrame:
    """SNK-02, SNK-04, SNK-07. Rows whose version is not deleted; with `kind`, only rows of that kind go."""
    gone = versions.select(F.col(version).alias("__version"))
    match = F.col(version) == F.col("__version")
    return rows.join(gone, match if kind is None else match & kind, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], written: str) -> DataFrame:
    """SNK-03, SNK-05. The last written row of each key."""
    ranked = old.unionByName(new).withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(written))))
    return ranked.where("__rank = 1").drop("__rank")


def merge_graph(nodes: DataFrame, edges: DataFrame, text: str, longest: int = 2000) -> tuple[DataFrame, DataFrame]:
    """SNK-05. Each node and edge once, texts cut."""
    return nodes.withColumn(text, F.substring(text, 1, longest)).dropDuplicates(["id"]), edges.dropDuplicates(["source", "target", "relation"])


def citation_rows(refs: DataFrame, latest: DataFrame, longest: int = 4000) -> DataFrame:
    """SNK-09. Citations of a message: the first reference of each chunk that the latest pass holds and that has
    text, the text cut, numbered without gaps in the order of the references.

    refs: message_id, place, chunk_id, snippet; latest: message_id, chunk_id, retrieval_id.
    """
    rows = refs.where(F.btrim(F.coalesce("snippet", F.lit(""))) != "").join(latest, ["message_id", "chunk_id"])
    first = Window.partitionBy("message_id", "chunk_id").orderBy("place")
    rows = rows.withColumn("__first", F.row_number().over(first)).where("__first = 1")
    order = F.row_number().over(Window.partitionBy("message_id").orderBy("place")) - 1
    return rows.select("message_id", "chunk_id", "retrieval_id", F.substring("snippet", 1, longest).alias("text_snippet"), order.alias("order_index"))


def soft_delete(rows: DataFrame, condition: Column, now: Column, actor: Column) -> DataFrame:
    """SNK-15. Marks rows as deleted that are not yet."""
    hit = condition & F.col("deleted_at").isNull()
    return rows.withColumn("deleted_by", F.when(hit, actor).otherwise(F.col("deleted_by"))).withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at")))


def append_event(events: Column, event: Column, most: int = 5000) -> Column:
    """SNK-16. The list with one more event; a full list stays as it is."""
    return F.when(F.size(events) < most, F.array_append(events, event)).otherwise(events)


def render_markdown(blocks: DataFrame, report: str, order: str, title: str, body: str) -> DataFrame:
    """SNK-17. One Markdown text for each report from its blocks in order."""
    part = F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.col(body))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return blocks.groupBy(report).agg(F.array_join(F.transform(listed, lambda s: s["p"]), "\n\n").alias("markdown"))


def staged(df: DataFrame, name: str) -> DataFrame:
    """CMP-23. A stage's result written as Parquet and read again, so that what follows has a short plan and a lost executor
    repeats no stage. It lies in the shared folder of spark.checkpoint.dir; only local sessions may lack one, and have one
    temporary folder. The files stay until release() or release_since() is called."""
    spark = df.sparkSession
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or getattr(context, "_lexloom_local", None)
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = context._lexloom_local = "file://" + tempfile.mkdtemp(prefix="lexloom-stages-")
    path = f"{where.rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"
    context._lexloom_stages = [*getattr(context, "_lexloom_stages", ()), path]
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._lexloom_path = path
    return found


def release(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._lexloom_path)


def staged_so_far(spark: SparkSession) -> int:
    return len(getattr(spark.sparkContext, "_lexloom_stages", ()))


def release_since(spark: SparkSession, mark: int = 0) -> None:
    """Delete all stages since staged_so_far() gave `mark`: after a query's result is written or collected."""
    for path in getattr(spark.sparkContext, "_lexloom_stages", ())[mark:]:
        _delete(spark, path)
    spark.sparkContext._lexloom_stages = list(getattr(spark.sparkContext, "_lexloom_stages", ()))[:mark]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
