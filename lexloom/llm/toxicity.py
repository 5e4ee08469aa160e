"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in the character 4- and 5-grams it holds,
the document's score is the noisy-or of its sentences, and the weights are trained from document labels
alone. Sentences with a score of at least 0.5 are reported as spans.

The classifier is fitted on a bounded sample of labelled rows: at most SAMPLE_TOXIC toxic and SAMPLE_CLEAN
other documents of at most SAMPLE_CHARS code points, those with the least hash of doc_id. It keeps at most
FEATURES n-grams. So at most 72 million code points come to the driver. Scores read every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without
from .grams import gram_hashes, squeezed
from .pretokens import blocks

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1200, 2400, 20_000
FEATURES, SIZES, TABLE_BITS = 512, (4, 5), 22
HELD_OUT, FOLDS = 0, 5
#: Code points that end a sentence (fixed values): . ! ? and the line feed.
SENTENCE_ENDS = np.array([0x2E, 0x21, 0x3F, 0x0A], np.uint32)


@dataclass
class Model:
    """Sorted hashes of the n-grams kept, their weights, and the bias of a sentence that holds any of them."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of code point, feature) of every n-gram that the model keeps."""
        at, feature = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for h, where in gram_hashes(codes, owner, SIZES) if len(self.grams) else ():
            near = np.flatnonzero(self.table[h >> np.uint64(64 - TABLE_BITS)])
            k = np.minimum(np.searchsorted(self.grams, h[near]), len(self.grams) - 1)
            same = self.grams[k] == h[near]
            at.append(where[near[same]])
            feature.append(k[same])
        return np.concatenate(at), np.concatenate(feature)


def _instances(texts: list[str | None], model: Model):
    """Distinct (sentence, feature) pairs of the sentences that hold a feature, numbered over all texts, and
    each such sentence's text, start and end in code points."""
    codes, owner, position, raw = squeezed(texts)
    at, feature = model.hits(codes, owner)
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    ends = (raw == SENTENCE_ENDS[0]) | (raw == SENTENCE_ENDS[1]) | (raw == SENTENCE_ENDS[2]) | (raw == SENTENCE_ENDS[3])
    sizes = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    text_at = np.cumsum(sizes) - sizes
    begins = np.flatnonzero(ends[:-1] & ~ends[1:]) + 1
    begins = np.union1d(begins, text_at)
    # The second code point tells the sentence: a gram's blank can be the full stop before it.
    sentence = np.searchsorted(begins, position[at + 1], "right") - 1
    kept, number = np.unique(sentence, return_inverse=True)
    pairs = np.unique(number * len(model.grams) + feature)
    doc = np.searchsorted(text_at, begins[kept], "right") - 1
    start = np.maximum(begins[kept] - text_at[doc] - 1, 0)
    end = np.append(begins, len(raw))[kept + 1] - text_at[doc] - 1
    return pairs // len(model.grams), pairs % len(model.grams), doc, start, np.minimum(end, sizes[doc] - 1)


def _sentence_scores(sentence, feature, n, model):
    z = np.bincount(sentence, model.weights[feature], n) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_texts(texts: list[str | None], model: Model) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Score of each text and the spans of its sentences with a score of at least 0.5."""
    scores, found = np.zeros(len(texts)), [[] for _ in texts]
    sentence, feature, doc, start, end = _instances(texts, model)
    if len(doc):
        s = _sentence_scores(sentence, feature, len(doc), model)
        scores = 1 - np.exp(np.bincount(doc, np.log1p(-np.minimum(s, 1 - 1e-9)), len(texts)))
        bad = s >= 0.5
        for d, a, b in zip(doc[bad].tolist(), start[bad].tolist(), end[bad].tolist(), strict=True):
            found[d].append((a, b))
    return np.clip(scores, 0, 1), found


def _select(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams whose presence tells toxic from other documents best."""
    counts = np.zeros((2, 1 << TABLE_BITS), np.int32)
    shift = np.uint64(64 - TABLE_BITS)

    def each():
        for text, y in zip(texts, toxic.tolist(), strict=True):
            codes, owner, _, _ = squeezed([text])
            yield y, np.unique(np.concatenate([h for h, _ in gram_hashes(codes, owner, SIZES)]))

    for y, h in each():
        counts[y][np.unique((h >> shift).astype(np.int64))] += 1
    n1, n0 = int(toxic.sum()), int(len(toxic) - toxic.sum())

    def gain(c1, c0):
        """Likelihood ratio statistic of a gram's presence against the label, 0 if it is not on the toxic side."""
        n, there = n1 + n0, c1 + c0
        cells = ((c1, n1 * there), (n1 - c1, n1 * (n - there)), (c0, n0 * there), (n0 - c0, n0 * (n - there)))
        with np.errstate(divide="ignore", invalid="ignore"):
            g = sum(np.where(o > 0, 2 * o * np.log(o * n / np.maximum(e, 1)), 0) for o, e in cells)
        return np.where(c1 * n0 > c0 * n1, g, 0)

    # As many grams are tried, so much larger a statistic does chance reach.
    tried = np.flatnonzero(counts[1] >= 3)
    least = 2 * np.log(max(len(tried), 2))
    wanted = np.zeros(1 << TABLE_BITS, bool)
    wanted[tried[gain(counts[1][tried].astype(float), counts[0][tried].astype(float)) > least]] = True
    exact: dict[int, list[int]] = {}
    for y, h in each():
        for g in np.unique(h[wanted[(h >> shift).astype(np.int64)]]).tolist():
            exact.setdefault(g, [0, 0])[y] += 1
    if not exact:
        return np.zeros(0, np.uint64)
    grams = np.array(list(exact), np.uint64)
    c = np.array(list(exact.values()), float)
    s = gain(c[:, 1], c[:, 0])
    best = np.lexsort((grams, -s))[:FEATURES]
    return np.sort(grams[best[(c[best, 1] >= 3) & (s[best] > least)]])


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Weights that maximise the likelihood of document labels under the noisy-or, by gradient steps (Adam)."""
    toxic = np.asarray(toxic, np.int64)
    grams = _select(texts, toxic) if 0 < toxic.sum() < len(toxic) else np.zeros(0, np.uint64)
    model = Model(grams, np.ones(len(grams)), -2.0)
    parts, docs, n = [], [], 0
    for at in range(0, len(texts) if len(grams) else 0, 256):
        sentence, feature, doc, _, _ = _instances(texts[at : at + 256], model)
        parts.append((sentence + n, feature))
        docs.append(doc + at)
        n += len(doc)
    if not n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -2.0)
    sentence, feature = (np.concatenate(x) for x in zip(*parts))
    doc = np.concatenate(docs)
    y = toxic[doc]
    theta = np.append(model.weights, model.bias)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, theta[feature], n) + theta[-1]
        s = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)
        p = np.clip(1 - np.exp(np.bincount(doc, np.log1p(-s), len(texts))), 1e-9, 1)[doc]
        pull = np.where(y == 1, -(1 - p) / p * s, s)
        slope = np.append(np.bincount(feature, pull[sentence], len(grams)), pull.sum()) / len(texts)
        slope[:-1] += decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(grams, theta[:-1], float(theta[-1]))


def fold(doc_id, folds: int = FOLDS):
    """Remainder that tells held-out rows: crc32 of doc_id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows of `docs` whose fold is not held out. Several labels of a doc_id count as toxic
    if any of them does; null labels and null doc_ids are left out. Without rows of both kinds every score is 0."""
    known = (
        labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != HELD_OUT)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    ids = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for y, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))
    ]
    sample = ids[0].union(ids[1]).withColumnRenamed("doc_id", "known_id")
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("known_id"))
        .where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text", "toxic")
        .orderBy("doc_id", "text").limit(SAMPLE_TOXIC + SAMPLE_CLEAN).toPandas()
    )
    return fit(rows.text.tolist(), rows.toxic.to_numpy(np.int64))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with toxicity (0 to 1) and toxic_spans, an array of start and end (code points) of offending sentences.

    Null and empty texts score 0. Every row is scored by its text alone, repeated or not; input columns with
    these two names are replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.grams, model.weights, model.bias))
    kept: list[Model] = []

    @F.pandas_udf("toxicity double, toxic_spans array<struct<start:int,end:int>>")
    def run(text: pd.Series) -> pd.DataFrame:
        if not kept:
            kept.append(Model(*shared.value))
        scores, spans = [], []
        for block in blocks(text.tolist(), most=1 << 12):
            s, found = score_texts(block, kept[0])
            scores.append(s)
            spans += [[{"start": a, "end": b} for a, b in x] for x in found]
        return pd.DataFrame({"toxicity": np.concatenate(scores) if scores else np.zeros(0), "toxic_spans": pd.Series(spans, dtype=object)})

    plain = without(docs, "toxicity", "toxic_spans")
    columns = [F.col(f"`{c}`") for c in plain.columns]
    return plain.select(*columns, run(F.coalesce("text", F.lit(""))).alias("__found")).select(*columns, "__found.*")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row of `docs`. A null doc_id hashes as empty text.
    Null and empty texts score 0; repeated rows score alike; other columns are ignored; an empty table gives an
    empty result. Labelled rows of equal hash are taken into the sample in the order of doc_id."""
    docs = docs.select("doc_id", "text")
    scored = score_documents(docs, learn(docs, labels))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"),
    )
