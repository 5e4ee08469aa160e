"""Reading tables: Parquet folders, files as bytes or text, paged scans, JSON artifacts (SRC-01..05, 15, 19..23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types by extension (fixed values).
FILE_TYPES = ("pdf", "docx", "xlsx", "pptx", "txt")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def detect_file_type(path: Column) -> Column:
    """SRC-01. Known type of a file name's extension in any case, null for others."""
    extension = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    return F.when(extension.isin(*FILE_TYPES), extension)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02, SRC-03. Files as bytes with SHA-256, size and type; one row a file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        "path", "modificationTime", F.col("length").alias("file_size_bytes"), "content",
        F.sha2("content", 256).alias("checksum_sha256"), detect_file_type(F.col("path")).alias("file_type"),
    )


def read_text_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-04, SRC-05. Plain-text files as paragraphs: runs of lines between blank lines, in order."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return paragraphs(texts, "path")


def paragraphs(texts: DataFrame, key: str) -> DataFrame:
    """key, paragraph_index, content of every paragraph of column `text`."""
    parts = F.filter(F.transform(F.split("text", r"\n[ \t\r]*\n\s*"), lambda s: F.btrim(s)), lambda p: p != "")
    return texts.select(key, F.posexplode(parts).alias("paragraph_index", "content"))


def markdown_lines(texts: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """SRC-15. key, line_no (from 1), line of every line of a text; null texts have none. The key may have several columns."""
    keys = [key] if isinstance(key, str) else key
    return texts.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).select(*keys, (F.col("at") + 1).cast("long").alias("line_no"), "line")


def page_of(rows: DataFrame, order: list[Column], page: int, page_size: int) -> DataFrame:
    """SRC-22. One page of an ordered table; the page is at least 1, its size from 1 to 100."""
    size = min(max(page_size, 1), 100)
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def resolve_page_count(file_type: Column, pages: Column, sections: Column) -> Column:
    """SRC-19. Sections count as pages for word-processor files, if they have any."""
    return F.when((file_type == "docx") & (F.coalesce(sections, F.lit(0)) > 0), sections).otherwise(pages)


def parse_fallback(primary: Column, fallback: Column) -> Column:
    """SRC-13. The first parser's text if it gave any, else the second one's."""
    return F.coalesce(F.nullif(F.btrim(primary), F.lit("")), fallback)


def save_json(rows: DataFrame, path: str) -> None:
    """SRC-20, writing side."""
    rows.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-20, SRC-21. JSON rows of a known schema; nothing is inferred."""
    return spark.read.schema(schema).json(path)


def version_chunks(chunks: DataFrame, version_id) -> DataFrame:
    """SRC-23. Chunks of one version in document order."""
    return chunks.where(F.col("document_version_id") == F.lit(version_id)).orderBy("chunk_index")
