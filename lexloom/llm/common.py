"""What the operators of this subpackage share: reading tables, the shared folder for written tables, and a
few expressions on arrays."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the cluster shares, or the one that was given to
    setCheckpointDir. Only where both are unset and all work is on this machine (tests) a temporary folder is
    set; on a cluster that is an error, since executors couldn't read each other's files."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexloom-shared-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; discard_since() finds it."""
    path = f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._lexloom_paths = [*getattr(context, "_lexloom_paths", ()), path]
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again. This cuts the lineage: a lost executor costs
    no more than reading the files again. The files stay until discard() or discard_since() is called."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    saved = df.sparkSession.read.schema(df.schema).parquet(path)
    saved._lexloom_path = path
    return saved


def discard(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, [table._lexloom_path])


def discard_path(spark: SparkSession, path: str) -> None:
    _delete(spark, [path])


def discard_since(spark: SparkSession, mark: int, keep: Iterable[DataFrame] = ()) -> None:
    """Delete all that was saved since saved_so_far() gave `mark`, but for the tables to keep."""
    kept = {t._lexloom_path for t in keep}
    _delete(spark, [p for p in getattr(spark.sparkContext, "_lexloom_paths", [])[mark:] if p not in kept])


def saved_so_far(spark: SparkSession) -> int:
    return len(getattr(spark.sparkContext, "_lexloom_paths", []))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` evaluated once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of non-null values under an associative `join`, in log2(n) passes: after
    pass k each place holds the total of the 2^k values that end there. Folding into a growing array instead
    would copy it at each step."""
    passes = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")

    def double(a: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(a, lambda x, i: F.when(i >= back, join(F.get(a, i - back), x)).otherwise(x))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), passes - 1), values, double))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file. LEXLOOM_TOKENIZERS names another folder."""
    if folder := os.environ.get("LEXLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Input columns that have the name of an output column are replaced by it, in either case."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])
