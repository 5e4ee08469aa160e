"""Language identification by nearest centroid.

A text is its TF-IDF vector of hashed character trigrams, of unit length. Each language has several
centroids, clustered among its own documents by cosine. A text takes the language of the nearest centroid;
one that is farther from it than all but a few training documents were is marked as rejected.

The centroids are fitted on a bounded sample: of the LANGUAGES languages with most rows, at most SAMPLE
documents each and about SAMPLE_ROWS together, of at most SAMPLE_CHARS code points, those with the least hash
of doc_id and text. Every whole text is read for its prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grams import gram_hashes, squeezed
from .pretokens import blocks
from .toxicity import fold

SAMPLE, SAMPLE_ROWS, SAMPLE_CHARS, LANGUAGES = 800, 8000, 20_000, 2000
BITS, GRAM, CENTROIDS = 12, 3, 3
HELD_OUT, FOLDS = 1, 3
UNKNOWN = "und"


@dataclass
class Model:
    """Languages of the centroids, centroids (rows of unit length), inverse document frequencies, and for
    each centroid the least cosine that is not rejected."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """Rows of unit length, or of zeros for texts without a trigram: (1 + log count) x idf."""
    codes, owner, _, _ = squeezed(texts)
    ((h, at),) = gram_hashes(codes, owner, (GRAM,))
    cell = owner[at].astype(np.int64) * (1 << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64)
    counts = np.bincount(cell, minlength=len(texts) << BITS).reshape(len(texts), 1 << BITS).astype(np.float32)
    v = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def cluster(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Up to k centroids of unit length by cosine k-means; the first ones are rows far from one another."""
    picked = [0]
    nearest = v @ v[0]
    while len(picked) < min(k, len(v)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, v @ v[picked[-1]])
    c = v[picked]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        sums = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = sums / np.where(norm > 0, norm, 1)
    return c


def fit(texts: list[str], languages: list[str]) -> Model:
    flat = np.ones(1 << BITS, np.float32)
    seen = np.zeros(1 << BITS)
    for block in blocks(texts, most=512):
        seen += (vectors(block, flat) > 0).sum(axis=0)
    idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    names, rows, least = [], [], []
    for lang in sorted(set(languages)):
        own = [t for t, x in zip(texts, languages, strict=True) if x == lang]
        v = np.concatenate([vectors(block, idf) for block in blocks(own, most=512)])
        c = cluster(v, CENTROIDS)
        cosines = v @ c.T
        nearest = cosines.argmax(axis=1)
        for j in range(len(c)):
            mine = cosines[nearest == j, j]
            names.append(lang)
            rows.append(c[j])
            least.append(float(np.quantile(mine, 0.01)) if len(mine) else 0.0)
    centroids = np.array(rows, np.float32).reshape(len(rows), 1 << BITS)
    return Model(names, centroids, idf, np.array(least))


def predict_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text."""
    languages, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
    if model.languages and lettered.any():
        cosines = vectors(texts, model.idf) @ model.centroids.T
        best = cosines.argmax(axis=1)
        nearest = cosines[np.arange(len(texts)), best]
        scores = np.where(lettered, np.clip(nearest, 0, 1), 0.0)
        rejected = ~lettered | (nearest < model.least[best])
        languages = [model.languages[j] if ok else UNKNOWN for j, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
    return languages, scores, rejected


def learn(docs: DataFrame) -> Model:
    """A model of the languages of rows whose fold is not held out. Null texts and languages are left out."""
    rows = docs.where("text is not null and lang is not null").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    # A hash of doc_id and text below a cut-off that holds about twice the sample comes first, so that no
    # language meets whole in one task.
    place = F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5
    rows = rows.where(F.length("text") <= SAMPLE_CHARS).select("lang", "text", "doc_id", place.alias("place"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return fit([], [])
    most = max(1, min(SAMPLE, SAMPLE_ROWS // len(sizes)))
    shares = [(r.lang, max(r.least, min(1.0, 2.0 * most / r.n))) for r in sizes]
    shares = docs.sparkSession.createDataFrame(shares, "known_lang string, share double")
    near = rows.join(F.broadcast(shares), F.col("lang") == F.col("known_lang")).where("place <= share")  # <= LANGUAGES rows
    first = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    sample = (
        near.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= most).orderBy("lang", "rank").select("text", "lang").toPandas()
    )
    return fit(sample.text.tolist(), sample.lang.tolist())


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), rejected for every row of `docs` (doc_id, text, lang).

    Null texts and texts without a letter are `und` with score 0 and rejected, and so are all texts if nothing
    can be learned. Letters too few for a trigram give score 0 and the first language; of centroids at the same distance the first one counts. Repeated rows have
    equal results; other columns are ignored; an empty table gives an empty result. A null doc_id hashes as
    empty text.
    """
    if model is None:
        model = learn(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(text: pd.Series) -> pd.DataFrame:
        parts = [predict_texts(block, shared.value) for block in blocks(text.tolist(), most=512)]
        return pd.DataFrame({
            "lang_pred": [x for p in parts for x in p[0]],
            "score": np.concatenate([p[1] for p in parts]) if parts else np.zeros(0),
            "rejected": np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, bool),
        })

    return docs.select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), run(F.coalesce("text", F.lit(""))).alias("found")
    ).select("doc_id", "held_out", "found.*")
