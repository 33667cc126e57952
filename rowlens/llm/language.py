"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word's subwords are the n-grams of its UTF-8 bytes, with marks at its ends, hashed to
rows of an embedding table. A text is the average over its subwords; a linear
layer and a softmax give the languages. Both tables are trained by stochastic
gradient descent in numpy on a bounded sample. A temperature, fitted on
documents that the descent has not seen, makes the probabilities honest, and
texts below the threshold that keeps such documents right are marked rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rowlens.llm.common import broadcast_if_small, hash_share, held_out, staged, text_blocks
from rowlens.llm.words import IS_SPACE, keyed_hashes, mixed, raw_bytes, spans

BUCKETS = 1 << 16
DIM = 16
SIZES = (2, 3, 4)
# The model is fitted on at most so many documents of each language, and on so many bytes of text, shared
# out evenly among the languages. A language's shortest documents come first, and the shortest
# FIT_LEAST whatever its share is. Documents of more than FIT_LONGEST bytes are not learned from.
FIT_DOCUMENTS = 600
FIT_BYTES = 12 << 20
FIT_LEAST = 5
FIT_LONGEST = 1 << 20
EPOCHS = 12
RATE = 0.5
BATCH = 16
SEED = 5
# Share of the documents that are set apart for the temperature, and of them the share that may be wrong once rejected texts are gone.
APART = 5
MAX_WRONG = 0.01
UNKNOWN = "und"

_GAP = IS_SPACE.copy()
_GAP[[b for b in range(33, 127) if not chr(b).isalpha()]] = True


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of words in UTF-8 bytes, size by size, and the word that each is of."""
    sizes = ends - starts + 2
    at = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    marked = np.full(total, ord("<"), np.uint64)
    inner = np.ones(total, bool)
    inner[at], inner[at + sizes - 1] = False, False
    marked[inner] = data[(np.repeat(starts - at - 1, sizes) + np.arange(total))[inner]]
    marked[at + sizes - 1] = ord(">")
    left = np.repeat(at + sizes, sizes) - np.arange(total)  # bytes to the end of the word
    word = np.repeat(np.arange(len(sizes)), sizes)
    found, owner, code = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], marked.copy()
    for n in range(2, max(SIZES) + 1):
        code = code[: total - n + 1] * np.uint64(257) + marked[n - 1 :]
        if n in SIZES and len(code):
            whole = np.flatnonzero(left[: len(code)] >= n)
            found.append((mixed(code[whole]) >> np.uint64(64 - 16)).astype(np.int64))
            owner.append(word[whole])
    return np.concatenate(found), np.concatenate(owner)


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a block in lower case, where its words start and end, and the text that each word is in."""
    data, offsets = raw_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, first = spans(data, offsets, _GAP[data])
    return data, starts, ends, np.repeat(np.arange(len(texts)), np.diff(first))


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of a block in the order of its texts, and the bounds of each text's."""
    data, starts, ends, text = _lowered(texts)
    buckets, word = _hashed(data, starts, ends)
    owners = text[word]
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.searchsorted(owners[order], np.arange(len(texts) + 1))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x width: embeddings, or with few languages their logits
    layer: np.ndarray  # width x language
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each text for each language, from its subwords."""
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return self._shares(_totals(owner, (column[buckets] for column in self.table.T), len(sizes)), sizes)

    def of_texts(self, texts: pa.Array) -> np.ndarray:
        """The same from a block of texts: each distinct word of the block is added up once."""
        data, starts, ends, text = _lowered(texts)
        _, some, which = np.unique(keyed_hashes(data, starts, ends), return_index=True, return_inverse=True)
        buckets, word = _hashed(data, starts[some], ends[some])
        in_word = _totals(word, (column[buckets] for column in self.table.T), len(some))
        totals = _totals(text, (column[which] for column in in_word.T), len(texts))
        return self._shares(totals, np.bincount(text, np.bincount(word, minlength=len(some))[which], len(texts)))

    def _shares(self, totals: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _softmax((totals / np.maximum(sizes, 1)[:, None] @ self.layer + self.bias) / self.temperature)


def _totals(owner: np.ndarray, columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    """Sums of each column by owner."""
    return np.stack([np.bincount(owner, column, n) for column in columns], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, from a geometric grid."""
    best = min(
        np.geomspace(0.05, 5, 60),
        key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean(),
    )
    return float(best)


def _threshold(p: np.ndarray, labels: np.ndarray) -> float:
    """The lowest probability above which at most ``MAX_WRONG`` of the texts are wrong."""
    top = p.max(axis=1)
    order = np.argsort(-top)
    wrong = np.cumsum(p.argmax(axis=1)[order] != labels[order]) / np.arange(1, len(labels) + 1)
    good = np.flatnonzero(wrong <= MAX_WRONG)
    return float(top[order[good[-1]]]) if len(good) else 1.0


def fit(texts: list[np.ndarray], labels: np.ndarray, languages: list[str], seed: int = SEED) -> Model:
    """Descent over the texts' buckets, then calibration on those set apart."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, k)), np.zeros(k)
    counted = [np.unique(t, return_counts=True) for t in texts]
    usable = np.array([i for i, (b, _) in enumerate(counted) if len(b)], np.int64)
    apart, learn = usable[usable % APART == 0], usable[usable % APART != 0]
    if not len(learn):
        learn = usable
    steps = EPOCHS * max(1, -(-len(learn) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for i in range(0, len(order), BATCH):
            rate, step = RATE * (1 - step / steps), step + 1
            some = order[i : i + BATCH]
            shares = [counted[j][1][:, None] / counted[j][1].sum() for j in some]
            means = np.stack([(table[counted[j][0]] * s).sum(axis=0) for j, s in zip(some, shares)])
            error = _softmax(means @ layer + bias)
            error[np.arange(len(some)), labels[some]] -= 1
            down = error @ layer.T
            layer -= rate * means.T @ error
            bias -= 0.1 * rate * error.mean(axis=0)
            for j, s, d in zip(some, shares, down):
                table[counted[j][0]] -= rate * 50 * s * d
    if k <= DIM:  # the layer is applied to the table once, not to every text
        table, layer = table @ layer, np.eye(k)
    model = Model(languages, np.asfortranarray(table), layer, bias, 1.0, 0.0)
    if len(apart):
        rows = [texts[i] for i in apart]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        raw = np.log(model.probabilities(np.concatenate(rows), bounds) + 1e-300)
        model.temperature = _temperature(raw, labels[apart])
        model.threshold = _threshold(_softmax(raw / model.temperature), labels[apart])
    return model


def training_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang`` outside the held-out fold, bounded for each language by itself.

    Documents are drawn by a hash of id and text, so that repeated rows count
    once. No language with a document of at most ``FIT_LONGEST`` bytes is left out.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", "text", "lang", F.octet_length("text").alias("bytes"))
    known = known.where(F.col("bytes") <= FIT_LONGEST).withColumn("mark", F.xxhash64("doc_id", "text"))
    found = staged(known.groupBy("lang").agg(F.approx_count_distinct("mark", 0.02).alias("n")))
    languages = max(1, found.count())
    shares = found.withColumn("share", F.lit(float(FIT_DOCUMENTS)) / F.greatest("n", F.lit(1))).drop("n")
    shares = broadcast_if_small(shares, F.octet_length("lang") + 16)
    # A language of few documents is taken whole; of the others the hash takes about the share wanted.
    drawn = staged(known.join(shares, "lang").where(hash_share("mark", SEED) < F.col("share")).drop("share").distinct())
    order = Window.partitionBy("lang").orderBy("bytes", "mark", "doc_id")
    ranked = drawn.select("lang", "mark", "doc_id", "bytes", F.row_number().over(order).alias("rank"),
                          F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    fits = (F.col("rank") <= FIT_LEAST) | (F.col("upto") <= FIT_BYTES // languages)
    chosen = ranked.where((F.col("rank") <= FIT_DOCUMENTS) & fits).select("lang", "mark", "doc_id")
    return drawn.join(chosen, ["lang", "mark", "doc_id"], "left_semi").select("doc_id", "text", "lang")


def train(docs: DataFrame) -> Model | None:
    """Fit on the bounded sample; None if no document has a language."""
    table = training_rows(docs).orderBy("doc_id", "lang", "text").select("text", "lang").toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    if not names:
        return None
    texts: list[np.ndarray] = []
    for batch in text_blocks(iter(table.to_batches())):
        buckets, bounds = subwords(batch.column("text"))
        texts += [buckets[a:b] for a, b in zip(bounds, bounds[1:])]
    number = {name: i for i, name in enumerate(names)}
    return fit(texts, np.array([number[x] for x in table.column("lang").to_pylist()]), names)


def predict(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, ``lang_pred, score, rejected``.

    ``und`` with score 0 where the text is null or has no letter; ``rejected``
    there, and where the calibrated score is below the threshold. Every row comes
    out, those that repeat an id or a text included, and equal texts get equal
    scores; a very long text is one block. Of languages that score alike the first in
    code point order is taken. An empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            texts = block.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = len(block)
            names, top, reject = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
            if model is not None:
                p = model.of_texts(texts)
                best = np.array(model.languages, object)[p.argmax(axis=1)]
                names[lettered], top[lettered] = best[lettered], p.max(axis=1)[lettered]
                reject = ~lettered | (top < model.threshold)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(names, pa.string()), pa.array(top), pa.array(reject)],
                ["id", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    out = rows.mapInArrow(each, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_column)


def identify(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` outside the held-out fold, predict all: ``doc_id, held_out, lang_pred, score, rejected``."""
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
