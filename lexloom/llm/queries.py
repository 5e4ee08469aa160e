"""Registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import sql
from .common import documents


def _on_documents(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that applies one operator, with its production parameters, to the whole documents table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from importlib import import_module

        ship(spark)
        return getattr(import_module(f".{module}", __package__), function)(documents(spark, sf_dir))

    return run


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    ship(spark)
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    ship(spark)
    return quality_rules(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import conversation_trie

    ship(spark)
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": _on_documents("fingerprints", "document_fingerprints"),
    "op2_toxicity": _toxicity,
    "op3_secret_scan": _on_documents("secrets", "secret_scan"),
    "op4_token_counts": _on_documents("token_counts", "token_counts"),
    "op5_line_dedup": _on_documents("line_dedup", "line_dedup"),
    "op6_language_id": _on_documents("language_id", "identify"),
    "op7_bpe": _on_documents("bpe", "encode_decode"),
    "op8_quality_rules": _quality,
    "op9_simhash": _on_documents("simhash", "near_duplicates"),
    "op10_packing": _on_documents("packing", "pack"),
    "op11_source_mix": _on_documents("mixing", "mix_sources"),
    "op12_conversation_trie": _trie,
    "op13_merkle_manifest": _on_documents("manifest", "merkle_manifest"),
}
SQL: dict[str, str] = {
    "op5_line_dedup": """
with rows as (
  select doc_id, row_number() over () as rid, string_split(coalesce(text, ''), chr(10)) as l from documents
), lines as (
  select doc_id, rid, unnest(l) as line, generate_subscripts(l, 1) as pos from rows
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), repeated as (
  select k, max(doc_id) as keeper from keyed where length(k) >= 40 and doc_id is not null
  group by k having count(distinct doc_id) >= 5
), judged as (
  select keyed.*, coalesce(keyed.doc_id <> keeper, false) as dropped from keyed left join repeated using (k)
)
select doc_id, count(*) as n_lines, cast(sum(dropped::int) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from judged group by rid, doc_id
""",
    "op12_conversation_trie": sql.TRIE,
    "op13_merkle_manifest": sql.MANIFEST,
}
