"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame
that is written as Parquet and read again as the next stage's documents. What a stage wrote to the shared
folder is deleted as soon as its result is written.

All stages take texts whole, however long. Repeated rows are taken one by one unless a stage says otherwise,
other columns (whatever their names) are kept as they are, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import discard, discard_since, documents, save, saved_so_far
from lexloom.llm.line_dedup import drop_repeated_lines
from lexloom.llm.near_texts import keep_one
from lexloom.llm.packing import pack
from lexloom.llm.secrets import redact
from lexloom.llm.toxicity import learn, score_documents
from lexloom.session import ship


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that none meets a column of an operator."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row"))


def _unwrapped(df: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of `docs` again with another text, and with n_chars as that text has it."""
    new = {"text": text, "n_chars": F.coalesce(F.length(text).cast("long"), F.col("__row.n_chars")) if "n_chars" in docs.columns else None}
    return df.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5. Null and empty texts score 0 and stay; null doc_ids are scored alike."""
    ship(spark)
    model = learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = score_documents(_wrapped(docs), model).where("toxicity < 0.5")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of at least 40 code points that five or more documents hold; the greatest
    doc_id keeps them. Null texts stay null, and rows with null doc_id stay whole. No row is dropped."""
    ship(spark)
    found = drop_repeated_lines(_wrapped(docs))
    return _unwrapped(found, docs, F.when(F.col("text").isNotNull(), F.col("kept_text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near-duplicates: texts with a Jaccard
    similarity of at least 0.8 over five-word shingles, directly or by way of others. Found by SimHash blocks, the Hamming
    check of the fingerprints, an exact check and components, as `near_texts` says. Texts without a word are one group, of repeated rows one stays, and rows with null doc_id all stay."""
    ship(spark)
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark; null texts stay null. No row is dropped."""
    ship(spark)
    return _unwrapped(redact(_wrapped(docs)), docs, F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 1024 tokens. Null and empty texts are one end token;
    pieces of equal length, also those of repeated rows, take their places in the order of doc_id."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: The classifier of the first stage, the hashes of the third and the tokens of the last have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        mark = saved_so_far(spark)
        before, docs = docs, save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        discard_since(spark, mark, keep=[docs])
        if hasattr(before, "_lexloom_path"):
            discard(before)
    return docs
