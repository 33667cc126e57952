import pytest

from rowlens.operators.answer import (
    NO_QUESTION, NO_RESULT, answer, ask, contexts, log_answers, prompt, read_history, recent, relevance_percent,
)
from pyspark.sql import functions as F

from rowlens.operators.identity import add_row_ids
from rowlens.operators.index import VectorIndex

HITS = [
    (1, 2, "b", "second", 0.875, '{"n":2}'),
    (1, 1, "a", "first", 0.125, '{"n":1}'),
    (2, 1, "c", "only", None, None),
]
QUESTIONS = [(1, "what?"), (2, "and?"), (3, " \t"), (4, "nothing"), (5, None)]


@pytest.fixture
def hits(spark):
    return spark.createDataFrame(HITS, "query_id bigint, rank int, row_id string, text string, distance double, metadata string")


@pytest.fixture
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id bigint, text string")


def test_context(hits):
    out = {r.query_id: r for r in contexts(hits).collect()}
    assert out[1].context == "[Result 1] (Relevance: 0.88)\nfirst\n\n[Result 2] (Relevance: 0.12)\nsecond"
    assert [s.row_id for s in out[1].sources] == ["a", "b"] and out[1].sources[0].metadata == '{"n":1}'
    assert out[2].context == "[Result 1] (Relevance: 0.00)\nonly"


def test_relevance_rounds_like_printed_floats(spark):
    values = [0.995, 0.985, 0.005, 1.0, 0.0, 2.0, 0.335, 0.345]
    df = spark.createDataFrame(
        [(i, 1, "r", "t", d) for i, d in enumerate(values)], "query_id bigint, rank int, row_id string, text string, distance double"
    )
    out = {r.query_id: r.context for r in contexts(df).collect()}
    assert [out[i] for i in range(len(values))] == [f"[Result 1] (Relevance: {1 - d:.2f})\nt" for d in values]


def test_relevance_percent(spark):
    df = spark.createDataFrame([(0.125,), (1.5,), (0.0,)], "d double")
    assert [r.p for r in df.select(relevance_percent(F.col("d")).alias("p")).collect()] == ["87.50%", "-50.00%", "100.00%"]


def test_prompt(spark):
    df = spark.createDataFrame([("q?", "ctx"), ("q?", ""), ("q?", None)], "q string, c string")
    texts = [r.p for r in df.select(prompt(F.col("q"), F.col("c")).alias("p")).collect()]
    assert texts[0] == (
        "Context from the Excel dataset:\nctx\n\nQuestion: q?\n\n"
        "Please answer the question based only on the above context."
    )
    assert texts[1] == texts[2] == texts[0].replace("ctx", "No relevant context found.")


def test_answers_without_a_model(questions, hits):
    out = {r.query_id: r for r in answer(questions, hits).collect()}
    assert {i: r.answer for i, r in out.items()} == {1: "first", 2: "only", 3: NO_QUESTION, 4: NO_RESULT, 5: NO_QUESTION}
    assert out[4].context == "" and out[4].sources == [] and out[3].sources == []
    assert "sources" not in answer(questions, hits, return_sources=False).columns


def test_the_model_sees_answerable_questions_only(questions, hits):
    def model():
        def fn(prompts, system):
            assert all("Question: what?" in p or "Question: and?" in p for p in prompts)
            return [system + str(len(p)) for p in prompts]

        return fn

    out = {r.query_id: r.answer for r in answer(questions, hits, model, system_prompt="s").collect()}
    assert out[1].startswith("s") and out[2].startswith("s")
    assert (out[3], out[4], out[5]) == (NO_QUESTION, NO_RESULT, NO_QUESTION)


def test_history(spark, tmp_path, questions, hits):
    path = str(tmp_path / "history")
    log_answers(answer(questions, hits), path)
    log_answers(answer(questions.limit(1), hits), path)
    assert read_history(spark, path).count() == 6
    long = spark.createDataFrame([(i, f"q{i}", "x" * 300) for i in range(15)], "asked_at int, question string, answer string")
    out = recent(long).collect()
    assert [r.question for r in out] == [f"q{i}" for i in range(14, 4, -1)]
    assert len(out[0].answer) == 200


def test_ask_an_index(spark, tmp_path, questions):
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert {r.answer for r in ask(index, questions).collect()} == {NO_QUESTION, NO_RESULT}
    index.update(add_row_ids(spark.createDataFrame([("what now",), ("and then",)], "title string")))
    out = {r.query_id: r for r in ask(index, questions, k=1).collect()}
    assert out[1].answer == "Title: what now" and out[2].answer == "Title: and then"
    assert out[3].answer == out[5].answer == NO_QUESTION and len(out[1].sources) == 1


def test_a_question_that_cannot_be_searched_is_told_so(spark, tmp_path, questions):
    from rowlens.operators.embed import embed

    def model():
        def fn(texts):
            if any(t == "what?" for t in texts):
                raise OSError("no route")
            return [[float(len(t)), 1.0] for t in texts]

        return fn

    index = VectorIndex(spark, str(tmp_path / "index"), lambda d: embed(d, model, dim=2, error="error"))
    index.update(add_row_ids(spark.createDataFrame([("what now",), ("and then",)], "title string")))
    for chat in (None, lambda: lambda prompts, system: ["yes"] * len(prompts)):
        out = {r.query_id: r for r in ask(index, questions, k=1, make_function=chat).collect()}
        assert out[1].answer == "Error retrieving documents: OSError: no route" and out[1].error == "OSError: no route"
        assert out[1].sources == [] and out[1].context == ""
        assert out[2].error is None and len(out[2].sources) == 1 and out[3].answer == NO_QUESTION
