"""Context, prompt and answer for a table of questions, and the question history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowlens.functions.text import is_blank
from rowlens.operators.embed import CompleteFunction, complete
from rowlens.operators.index import VectorIndex

# The texts a question can be answered with when no model is asked,
# and the wording of the prompt.
NO_QUESTION = "Please provide a question."
NO_RESULT = "I don't know based on the uploaded data. No relevant information was found in the dataset."
NO_CONTEXT = "No relevant context found."
RETRIEVAL_FAILED = "Error retrieving documents: "
ANSWER_FAILED = "Error generating answer: "
PROMPT = """Context from the Excel dataset:
{context}

Question: {question}

Please answer the question based only on the above context."""

# What a model is told before any prompt, unless the caller says otherwise.
SYSTEM_PROMPT = (
    "You answer questions about rows of a table. Rely on the rows you are shown and on nothing else. "
    "If they do not hold the answer, say that the data does not tell. Name the rows you used."
)

ANSWER_PREVIEW = 200
HISTORY_ROWS = 10


def relevance(distance: Column) -> Column:
    return F.lit(1.0) - distance


def relevance_percent(distance: Column) -> Column:
    """``87.50%``, as shown beside a source."""
    return F.concat(F.format_number(relevance(distance) * 100, 2), F.lit("%"))


def contexts(hits: DataFrame) -> DataFrame:
    """``query_id, context, sources`` from ``query_id, rank, row_id, text, distance[, metadata]``.

    A question has at most ``k`` hits, so its group is small by construction. Each
    text goes through the group once; what is shown of it is put together afterwards.
    """
    fields = [c for c in ("row_id", "text", "metadata", "distance") if c in hits.columns]
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("source"))))

    def part(hit: Column) -> Column:
        shown = F.format_number(F.coalesce(relevance(hit["source"]["distance"]), F.lit(0.0)), 2)
        head = F.concat(F.lit("[Result "), hit["rank"].cast("string"), F.lit("] (Relevance: "), shown, F.lit(")\n"))
        return F.concat(head, F.coalesce(hit["source"]["text"], F.lit("")))

    return hits.groupBy("query_id").agg(ordered.alias("found")).select(
        "query_id",
        F.concat_ws("\n\n", F.transform("found", part)).alias("context"),
        F.col("found.source").alias("sources"),
    )


def prompt(question: Column, context: Column) -> Column:
    head, rest = PROMPT.split("{context}")
    middle, tail = rest.split("{question}")
    shown = F.when(F.coalesce(context, F.lit("")) == "", NO_CONTEXT).otherwise(context)
    return F.concat(F.lit(head), shown, F.lit(middle), question, F.lit(tail))


def answer(
    questions: DataFrame,
    hits: DataFrame,
    make_function: Callable[[], CompleteFunction] | None = None,
    system_prompt: str | None = SYSTEM_PROMPT,
    return_sources: bool = True,
    failures: DataFrame | None = None,
) -> DataFrame:
    """``query_id, question, answer, context, sources[, error]`` for ``questions(query_id, text)``.

    A blank question is told so; one without hits gets the fixed reply; only the
    rest reaches the model. Without a model the answer is the text of the first
    hit. With one, a question it fails on has that as its answer and in ``error``;
    the others are answered. ``failures(query_id, error)`` are questions that could not be
    searched; they are told so, have no sources, and their message in ``error``.
    """
    blank, found = is_blank(F.col("question")), F.size("sources") > 0
    joined = (
        questions.select("query_id", F.col("text").alias("question"))
        .join(contexts(hits), "query_id", "left")
        .withColumn("sources", F.when(~blank, F.col("sources")))
        .withColumn("context", F.when(blank, "").otherwise(F.coalesce("context", F.lit(""))))
    )
    if make_function is None:
        answered = joined.withColumn("model", F.get(F.col("sources"), F.lit(0))["text"])
    else:
        ask = F.when(found, prompt(F.col("question"), F.col("context")))
        answered = complete(
            joined.withColumn("prompt", ask), make_function, "prompt", "model", system_prompt, "error"
        )
        failed = F.concat(F.lit(ANSWER_FAILED), F.col("error"))
        answered = answered.withColumn("model", F.coalesce("model", failed))
    unsearched = F.lit(None).cast("string")
    if failures is not None:
        told = failures.select("query_id", F.col("error").alias("search_error"))
        answered = answered.join(told, "query_id", "left")
        unsearched = F.col("search_error")
        own = F.col("error") if make_function is not None else F.lit(None).cast("string")
        answered = answered.withColumn("error", F.coalesce(unsearched, own))
    reply = F.when(blank, NO_QUESTION).when(unsearched.isNotNull(), F.concat(F.lit(RETRIEVAL_FAILED), unsearched))
    reply = reply.when(found, F.col("model")).otherwise(NO_RESULT)
    columns = ["query_id", "question", reply.alias("answer"), "context"]
    if make_function is not None or failures is not None:
        columns.append("error")
    if return_sources:
        columns.append(F.coalesce("sources", F.array().cast(joined.schema["sources"].dataType)).alias("sources"))
    return answered.select(*columns)


def ask(
    index: VectorIndex,
    questions: DataFrame,
    k: int = 5,
    make_function: Callable[[], CompleteFunction] | None = None,
    **options,
) -> DataFrame:
    """Search and :func:`answer` for ``questions(query_id, text)``; blank ones are not searched.

    With an embedder that keeps its errors in a column ``error``, a question that it
    fails on is told so and the others are answered.
    """
    asked = index.embedded(questions.filter(~is_blank(F.col("text"))))
    failures = asked.where("error is not null").select("query_id", "error") if "error" in asked.columns else None
    return answer(questions, index.nearest(asked, k), make_function, failures=failures, **options)


# -- history ---------------------------------------------------------------


def log_answers(answers: DataFrame, path: str) -> None:
    """Append ``asked_at, question, answer`` to the history.

    This runs the plan of ``answers``, its model calls included; to show answers
    as well as keep them, log first and read the history.
    """
    answers.select(F.current_timestamp().alias("asked_at"), "question", "answer").write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def recent(
    history: DataFrame, *newest_first: str, n: int = HISTORY_ROWS, preview: int = ANSWER_PREVIEW
) -> DataFrame:
    """The last ``n`` questions, newest first, answers cut to a preview."""
    keys = newest_first or ("asked_at",)
    return history.withColumn("answer", F.substring("answer", 1, preview)).orderBy(
        *[F.desc(c) for c in keys]
    ).limit(n)
