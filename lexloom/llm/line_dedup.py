"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

Documents come in batches, those with the greatest doc_ids first. A batch's line hashes are merge-anti-joined
with the runs: lines that no run holds are new, and their document with the greatest doc_id keeps them; of
lines that some run holds only the number of documents is added. Then the batch's own run is written, sorted
by hash in buckets, so that joins with it need neither shuffle nor sort. As soon as a level has FAN runs they
are compacted to one run of the next level. At the end the runs give every line's number of documents and
its keeper.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, discard_path, let, new_path, save
from .ranks import small

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
BATCHES, FAN = 3, 2
BLANKS = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(BLANKS)), upper, upper.lower())


def lines_of(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash, pos, h1, h2 (a 128-bit hash of the key) for every line whose key has `least` code points."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.where("doc_id is not null").select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = rows.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= least)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


class LineRuns:
    """Runs of (h1, h2, documents, keeper) in levels; keeper is null in a run that only adds documents."""

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame, level: int) -> None:
        table = f"{self.name}_{len(self.levels)}_{uuid.uuid4().hex[:8]}"
        path = self.paths[table] = new_path(self.spark, table)
        (
            rows.repartition(self.buckets, *KEY).write.format("parquet").option("path", path)
            .bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(table)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def _read(self, tables: list[str]) -> DataFrame:
        """One row for each line of some runs, merged pairwise on their sorted buckets."""
        found = self.spark.table(tables[0])
        for table in tables[1:]:
            more = self.spark.table(table).select(*KEY, F.col("documents").alias("more"), F.col("keeper").alias("other"))
            found = found.join(more, KEY, "full_outer").select(
                *KEY, (F.coalesce("documents", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("documents"), F.greatest("keeper", "other").alias("keeper")
            )
        return found

    def add(self, batch: DataFrame) -> None:
        """Add the lines (doc_id, h1, h2) of a batch whose doc_ids are below those of all batches before it."""
        own = (
            batch.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
            .groupBy(*KEY).agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper"))
        )
        runs = [t for level in self.levels for t in level]
        rows = own
        if runs:
            own = save(own, "own_lines")
            fresh, known = own, None
            for table in runs:
                run = self.spark.table(table).select(*KEY)
                again = fresh.join(run, KEY, "left_semi")
                known = again if known is None else known.unionByName(again)
                fresh = fresh.join(run, KEY, "left_anti")
            rows = fresh.unionByName(known.withColumn("keeper", F.lit(None).cast("long")))
        self._write(rows, 0)
        if runs:
            discard(own)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan:
            full, self.levels[level] = self.levels[level], []
            self._write(self._read(full), level + 1)
            for table in full:
                self._drop(table)
            level += 1

    def lines(self) -> DataFrame:
        """h1, h2, documents, keeper of every line."""
        return self._read([t for level in self.levels for t in level])

    def _drop(self, table: str) -> None:
        self.spark.sql(f"drop table if exists {table}")
        discard_path(self.spark, self.paths.pop(table))

    def close(self) -> None:
        """Forget the runs that are left and delete their files."""
        for table in list(self.paths):
            self._drop(table)


#: Places of dropped lines that are broadcast at most, in at most BROADCAST_ROWS rows.
BROADCAST_PLACES = 1 << 20


def _batches(lines: DataFrame, batches: int):
    """Lines in ranges of doc_id, greatest first."""
    shares = [k / batches for k in range(1, batches)]
    cuts = sorted(set(lines.approxQuantile("doc_id", shares, 0.01))) if shares else []
    bounds = [None, *cuts, None]
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        part = lines if low is None else lines.where(F.col("doc_id") >= int(low))
        yield part if high is None else part.where(F.col("doc_id") < int(high))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """`docs` with n_lines, n_dropped and kept_text.

    A line is dropped if its key has at least `least_chars` code points, at least `least_documents` documents
    (distinct doc_ids) hold it, and this is not the greatest of them. Null and empty texts are one empty line,
    which stays. Rows with null doc_id keep all lines and count for none. Rows that repeat a doc_id count
    once, each loses its own lines. Input columns with the three names are replaced, others stay whatever their names.
    An empty table stays empty. Texts are shuffled only where the places of dropped lines are too many to be broadcast.
    """
    taken = {"n_lines", "n_dropped", "kept_text"}
    names = [c for c in docs.columns if c.lower() not in taken]
    columns = [F.col("text") if c == "text" else F.col(f"__row.`{c}`") for c in names]
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("__row"), "doc_id", "text")
    lines = save(lines_of(docs.select("doc_id", "text"), least_chars), "lines")
    runs = LineRuns(docs.sparkSession)
    try:
        for batch in _batches(lines, batches):
            runs.add(batch.select("doc_id", *KEY))
        repeated = save(runs.lines().where(F.col("documents") >= least_documents).select(*KEY, "keeper"), "repeated_lines")
    finally:
        runs.close()
    drops = save(
        lines.join(repeated, KEY).where("doc_id <> keeper")
        .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("__drop"))
        .select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "__drop"), "drops",
    )
    if (drops.agg(F.sum(F.size("__drop"))).first()[0] or 0) <= BROADCAST_PLACES:
        drops = small(drops)
    text = F.coalesce("text", F.lit(""))
    joined = docs.join(drops, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64(text) == F.col("__hash")), "left")
    parts, drop = F.split(text, "\n", -1), F.col("__drop")

    def undropped(s: Column) -> Column:
        """What stays lies between neighbouring dropped lines; each text is split once."""
        edges = lambda k: F.get(s["edges"], k)
        between = F.transform(F.sequence(F.lit(0), F.size(s["edges"]) - 2), lambda k: F.slice(s["parts"], edges(k) + 2, edges(k + 1) - edges(k) - 1))
        return F.array_join(F.flatten(between), "\n")

    cut = let(parts, lambda p: F.struct(p.alias("parts"), F.concat(F.array(F.lit(-1)), drop, F.array(F.size(p))).alias("edges")))
    kept = F.when(drop.isNull(), text).otherwise(let(cut, undropped))
    return joined.select(
        *columns, F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.array_size(drop), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text")
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of `docs`."""
    found = drop_repeated_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
