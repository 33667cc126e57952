"""Text to vectors and prompts to answers, through functions the user passes in.

A model function is built once per Python worker and sees Arrow batches, so a
remote client or a model file is opened once and called with many texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rowlens.functions.text import is_blank, tokens
from rowlens.functions.vectors import zero_vector
from rowlens.sources.scratch import kept
from rowlens.sources.tables import ParquetTable

EmbedFunction = Callable[[Sequence[str]], Sequence[Sequence[float]]]
CompleteFunction = Callable[[Sequence[str], str | None], Sequence[str]]
VECTOR = T.ArrayType(T.FloatType())
VECTOR_COLUMN = "embedding"


def _each_or_all(fn: Callable[[list], Sequence], items: list, keep_errors: bool) -> tuple[list, list[str | None]]:
    """Results of one call for all items; if it fails and errors are kept, of one call for each."""
    try:
        out = list(fn(items))
        if len(out) != len(items):
            raise ValueError(f"the function returned {len(out)} results for {len(items)} items")
        return out, [None] * len(items)
    except Exception as e:
        if not keep_errors:
            raise
        if len(items) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    pairs = [_each_or_all(fn, [item], True) for item in items]
    return [out[0] for out, _ in pairs], [errors[0] for _, errors in pairs]


def _model_column(make_call: Callable[[], Callable[[list], Sequence]], kind: T.DataType, keep_errors: bool):
    """A column function from text to ``struct(value, error)``; nulls never reach the model."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fn = make_call()
        for items in batches:
            out = pd.DataFrame({"value": None, "error": None}, index=items.index, dtype=object)
            present = items[items.notna()]
            if len(present):
                values, errors = _each_or_all(fn, present.tolist(), keep_errors)
                for row, value, error in zip(present.index, values, errors):
                    out.at[row, "value"], out.at[row, "error"] = value, error
            yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    result = T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())])
    return F.pandas_udf(run, result).asNondeterministic()


def _with_model(df: DataFrame, called: Column, value: Callable[[Column], Column], output: str, error: str | None) -> DataFrame:
    call = "model_call"
    while call in df.columns:
        call = f"_{call}"
    added = df.withColumn(call, called).withColumn(output, value(F.col(call)["value"]))
    return (added if error is None else added.withColumn(error, F.col(call)["error"])).drop(call)


def embed(
    df: DataFrame,
    make_function: Callable[[], EmbedFunction],
    dim: int,
    text: str = "text",
    output: str = "embedding",
    error: str | None = None,
) -> DataFrame:
    """Add a vector per text; blank texts get the zero vector and never reach the model.

    ``make_function`` returns ``fn(list of texts) -> list of vectors``. Batch
    size is ``spark.sql.execution.arrow.maxRecordsPerBatch``. The column is
    marked non-deterministic so that no plan calls the model twice per row.
    A failing call ends the job, unless ``error`` names a column: then each text
    of the batch is tried by itself, and one that fails has no vector and its
    message there.
    """

    def make_call():
        fn = make_function()

        def call(texts: list[str]) -> list[np.ndarray]:
            rows = [np.asarray(v, dtype=np.float32) for v in fn(texts)]
            if len(rows) != len(texts) or any(v.shape != (dim,) for v in rows):
                raise ValueError(f"the embedding function must return one vector of {dim} per text")
            return rows

        return call

    c = F.col(f"`{text}`")
    model = _model_column(make_call, VECTOR, error is not None)
    blank = is_blank(c)
    return _with_model(
        df, model(F.when(~blank, c)), lambda v: F.when(blank, zero_vector(dim)).otherwise(v), output, error
    )


def complete(
    df: DataFrame,
    make_function: Callable[[], CompleteFunction],
    prompt: str = "prompt",
    output: str = "answer",
    system_prompt: str | None = None,
    error: str | None = None,
) -> DataFrame:
    """Add a model answer per prompt; null prompts stay null.

    ``make_function`` returns ``fn(list of prompts, system_prompt) -> list of answers``.
    ``error`` as in :func:`embed`.
    """

    def make_call():
        fn = make_function()
        return lambda prompts: fn(prompts, system_prompt)

    model = _model_column(make_call, T.StringType(), error is not None)
    return _with_model(df, model(F.col(f"`{prompt}`")), lambda v: v, output, error)


def hashed_counts(c: Column, dim: int = 64) -> Column:
    """Built-in stand-in for a model: token counts in ``dim`` buckets chosen by MD5.

    Texts are cut in the JVM; each Arrow batch hashes its distinct tokens once. A
    blank text has no tokens and gives the zero vector.
    """

    @F.arrow_udf(VECTOR)
    def counts(words: pa.Array) -> pa.Array:
        encoded = words.flatten().dictionary_encode()
        bucket = np.array(
            [int(md5(w.encode()).hexdigest()[:6], 16) % dim for w in encoded.dictionary.to_pylist()], dtype=np.int64
        )
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        cell = row * dim + bucket[encoded.indices.to_numpy(zero_copy_only=False)]
        table = np.bincount(cell, minlength=len(words) * dim).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), pa.array(table))

    return counts(F.coalesce(tokens(c), F.array().cast("array<string>")))


def hashed_embedding(
    df: DataFrame, dim: int = 64, text: str = "text", output: str = "embedding"
) -> DataFrame:
    """:func:`embed` with :func:`hashed_counts` in place of a model."""
    return df.withColumn(output, hashed_counts(F.col(text), dim))


def remembered(spark: SparkSession, path: str, embedder: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An embedder that calls ``embedder`` once per distinct text, ever.

    Vectors are kept in a table at ``path`` by a hash of the text. Rows join to
    it; only texts that it lacks reach the model, each once however many rows
    hold it. Null and empty texts are one text. A text on which a model that keeps its errors
    fails is not remembered, so the next call tries it again.
    """
    table = ParquetTable(spark, path, "text_id")

    def run(documents: DataFrame) -> DataFrame:
        known = table.read()
        text_id = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_id")
        texts = documents.select(text_id, "text").groupBy("text_id").agg(F.first("text").alias("text"))
        if known is not None:
            texts = texts.join(known.select("text_id"), "text_id", "left_anti")
        fresh = embedder(texts)
        failed = "error" in fresh.columns
        fresh = kept(fresh.select("text_id", VECTOR_COLUMN, *(["error"] if failed else [])), "fresh")
        good = (fresh.where("error is null") if failed else fresh).select("text_id", VECTOR_COLUMN)
        if known is None or not good.isEmpty():
            table.append(good)
        rows = documents.select("*", text_id).join(table.read(), "text_id", "left")
        if failed:
            rows = rows.join(fresh.where("error is not null").select("text_id", "error"), "text_id", "left")
        return rows.drop("text_id")

    return run
