"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are words, word pairs and pairs with one word between them, hashed.
Every coordinate has its own learning rate, and L1 sparsity leaves few weights,
which travel to the scoring tasks in their closure: their number is bounded by
the number of hash buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowlens.llm.common import hash_share, held_out, staged, text_blocks
from rowlens.llm.words import IS_SPACE, LOWER, mixed, span_hashes, spans, raw_bytes

BUCKET_BITS = 20
# The classifier is fitted on at most so many labelled documents and so many bytes of text.
FIT_DOCUMENTS = 8_000
FIT_BYTES = 32 << 20
EPOCHS = 5
SEED = 11

# Characters that are part of no word: punctuation and blanks of ASCII.
_GAP = IS_SPACE.copy()
_GAP[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass
class Rates:
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature of a block of texts, grouped by text, and the bounds of each text's."""
    data, offsets = raw_bytes(texts)
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, _GAP[data])
    words = span_hashes(data, starts, ends)
    n = len(words)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    kinds = [(words, text)]
    for gap, salt in ((1, 0x51), (2, 0x52)):
        if n > gap:
            same = text[gap:] == text[:-gap]
            pair = mixed(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + words[gap:] + np.uint64(salt))
            kinds.append((pair[same], text[:-gap][same]))
    bucket = np.concatenate([h for h, _ in kinds]) >> np.uint64(64 - BUCKET_BITS)
    owner = np.concatenate([t for _, t in kinds])
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(offsets)))
    return bucket[order].astype(np.int64), bounds


def fit(buckets: list[np.ndarray], labels: np.ndarray, rates: Rates = Rates(), epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes of FTRL-proximal; a feature counts once per text."""
    size = 1 << BUCKET_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * rates.l1) / ((rates.beta + np.sqrt(n[i])) / rates.alpha + rates.l2)
        return np.where(np.abs(zi) <= rates.l1, 0.0, w)

    order = np.random.default_rng(SEED)
    for _ in range(epochs):
        for i in order.permutation(len(buckets)):
            x = np.append(buckets[i], size)  # the last coordinate is the bias
            w = weight(x)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - labels[i]
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / rates.alpha
            z[x] += g - sigma * w
            n[x] += g * g
    weights = weight(np.arange(size + 1))
    return weights[:size], float(weights[size])


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of labelled documents outside the held-out fold, about as many as the fit takes at most.

    A share of either class by hash, so that nothing is sorted; the share
    follows from the counts of the classes.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = staged(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    share = F.lit(0.0)
    for kind, n in counts.items():
        share = F.when(F.col("toxic") == kind, FIT_DOCUMENTS / 2 / n).otherwise(share)
    some = known.where(hash_share("doc_id", SEED) < share)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # FIT_DOCUMENTS ids at most, give or take the chance of the hash: no text is shuffled for them.
    return rows.join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on the bounded sample; without labels all scores are one half."""
    rows = staged(training_rows(docs, labels))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.where(hash_share("doc_id", SEED + 1) < FIT_BYTES / max(size, FIT_BYTES))
    table = rows.orderBy("doc_id", "text").select("text", "toxic").toArrow()
    buckets, labels_ = [], table.column("toxic").to_numpy().astype(float)
    if not len(labels_):
        return np.zeros(1 << BUCKET_BITS), 0.0
    for batch in text_blocks(iter(table.to_batches())):
        found, bounds = features(batch.column("text"))
        buckets += [np.unique(found[a:b]) for a, b in zip(bounds, bounds[1:])]
    return fit(buckets, labels_)


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, ``score`` (0 to 1), ``predicted``. A null text is scored as an empty one."""
    kept = np.flatnonzero(weights)
    sparse = weights[kept]
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BUCKET_BITS)
        dense[kept] = sparse
        for block in text_blocks(batches):
            found, bounds = features(block.column("text"))
            values = dense[found]
            live = np.flatnonzero(values)
            owner = np.searchsorted(bounds, live, side="right") - 1
            # A feature counts once per text.
            _, once = np.unique(owner * (1 << BUCKET_BITS) + found[live], return_index=True)
            total = bias + np.bincount(owner[once], values[live[once]], minlength=len(block))
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"]
            )

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(each, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_column)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``.

    Learns from rows of ``labels`` outside the held-out fold; a document
    labelled twice counts as toxic if any label says so.
    """
    weights, bias = train(docs, labels)
    return score(docs, weights, bias).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
