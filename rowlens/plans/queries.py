"""Every registered query: ``(spark, folder of Parquet tables) -> DataFrame``.

All of them run over the whole tables they name. Doubles that come from vector
arithmetic carry nine decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowlens.operators import answer as answers, explore, index, nearest, store
from rowlens.operators.documents import metadata_field, row_metadata, row_text, row_variant, to_documents
from rowlens.operators.embed import complete, embed, hashed_embedding, remembered
from rowlens.operators.identity import add_row_ids, dedup_rows
from rowlens.operators.postings import TokenIndex
from rowlens.operators.profiles import STANDARD_ERROR, StoredProfile
from rowlens.operators.quantised import ProductIndex
from rowlens.operators.trigrams import TrigramIndex
from rowlens.sources.sheets import ingest, merge_sheets, read_sheet_folder, read_sheets, write_original_sheets
from rowlens.functions.names import clean_columns
from rowlens.sources.scratch import kept, scratch_folder
from rowlens.sources.tables import ParquetTable
from rowlens.streaming.upserts import append_stream, distinct_stream, upsert_stream

Query = Callable[[SparkSession, str], DataFrame]
TOP_K = 5
PROBES = 6
HASH_DIM = 64

# Sheets with headers as people type them.
HEADERS = {
    "customer": ["  Cust Key", "Title of Publicaion", "NATION  KEY ", "Acct_Bal_", "Department"],
    "supplier": ["Supp Key", "Title_of_Publication", "Nation Key", " acct bal "],
    "part": ["Part Key", "title", "Brand", "Publication Type", "Size", "Retail Price"],
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of files: the path is a pattern, as a plain one must be a folder."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def raw_sheets(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, folder, n).toDF(*HEADERS[n]) for n in names or HEADERS}


# -- sheets ------------------------------------------------------------------


def sheets_union(spark, folder):
    sheets = {n: clean_columns(df) for n, df in raw_sheets(spark, folder).items()}
    return merge_sheets(sheets)


def sheet_counts(spark, folder):
    return explore.sheet_counts(sheets_union(spark, folder))


def ingested(spark, folder):
    return ingest(raw_sheets(spark, folder))


def customers(spark, folder):
    return ingest(raw_sheets(spark, folder, "customer"))


# -- identity and documents --------------------------------------------------


def row_ids(spark, folder):
    docs = table(spark, folder, "documents")
    return add_row_ids(docs, ["text", "lang", "source", "n_chars"]).select("doc_id", "row_id")


def row_ids_typed(spark, folder):
    return add_row_ids(table(spark, folder, "orders")).select("o_orderkey", "row_id")


def row_ids_lineitem(spark, folder):
    return add_row_ids(table(spark, folder, "lineitem")).select("l_orderkey", "l_linenumber", "row_id")


def documents_by_text(spark, folder):
    return add_row_ids(table(spark, folder, "documents"), id_columns=["text"])


def row_dedup(spark, folder):
    return dedup_rows(documents_by_text(spark, folder), order_by=["doc_id"])


def gappy_customers(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cust_key"),
        F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_name")).alias("co-author_name"),
        F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("nation"),
        F.col("c_acctbal").alias("acct_bal"),
        F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment")).alias("pub_type"),
    )


def row_texts(spark, folder):
    df = gappy_customers(spark, folder)
    return df.select("cust_key", row_text(df).alias("text"))


def row_metadatas(spark, folder):
    df = gappy_customers(spark, folder)
    return df.select("cust_key", row_metadata(df).alias("metadata"))


def documents_view(spark, folder):
    return to_documents(ingested(spark, folder))


# -- store -------------------------------------------------------------------


def labelled_documents(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id").distinct()
    return documents_by_text(spark, folder).join(labels, "doc_id", "left_semi")


def store_upsert(spark, folder):
    existing = store.upsert(None, labelled_documents(spark, folder))
    return store.upsert(existing, documents_by_text(spark, folder))


def store_append(spark, folder):
    incoming = raw_sheets(spark, folder, "supplier")["supplier"]
    return store.append_rows(customers(spark, folder), incoming)


def store_delete(spark, folder):
    rows = customers(spark, folder)
    return store.delete_rows(rows, rows.filter(F.col("dept") == "BUILDING").select("row_id"))


def row_lookup(spark, folder):
    rows = customers(spark, folder)
    ends = rows.agg(F.array(F.min("row_id"), F.max("row_id")).alias("ids"))
    return store.find_rows(rows, ends.select(F.explode("ids").alias("row_id")))


def store_stats(spark, folder):
    return store.store_counts(table(spark, folder, "documents"))


def entries(spark, folder):
    orders = table(spark, folder, "orders")
    priority, year = F.col("o_orderpriority"), F.year("o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.when(priority.startswith("5"), "n/a")
        .when(priority.startswith("4"), "  ")
        .when(priority.startswith("1"), (year + 300).cast("string"))
        .otherwise(F.concat(F.lit(" "), year.cast("string")))
        .alias("order_year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("note"),
    )


def entry_coercion(spark, folder):
    return store.coerce_entries(entries(spark, folder))[0]


def entry_rejects(spark, folder):
    return store.coerce_entries(entries(spark, folder))[1]


# -- explore -----------------------------------------------------------------


def search_column(spark, folder):
    return explore.search(table(spark, folder, "part"), "RED", ["p_name"])


def search_all(spark, folder):
    return explore.search(table(spark, folder, "customer"), "R#00000012")


def search_regex(spark, folder):
    docs = explore.search(table(spark, folder, "documents"), r"(licen[cs]e|@[a-z]+\.com)", ["text"], regex=True)
    return docs.select("doc_id", "lang", "source")


def column_profile(spark, folder):
    return explore.profile(table(spark, folder, "orders"))


def column_profile_stored(spark, folder):
    """Four batches sketched one after the other; estimates are held against exact counts of the whole table."""
    rows = table(spark, folder, "orders")
    stored = StoredProfile(spark, scratch_folder(spark, "profile"))
    for part in range(4):
        stored.add(rows.where(F.pmod("o_orderkey", F.lit(4)) == part))
    exact = explore.profile(rows).select("column", F.col("n_distinct").alias("exact"))
    error = F.abs(F.col("n_distinct") - F.col("exact"))
    return stored.read().join(exact, "column").select(
        "column", "type", "non_null", "sample", (error <= 4 * STANDARD_ERROR * F.col("exact") + 1).alias("within_error")
    )


def display_strings(spark, folder):
    nation = table(spark, folder, "nation")
    return explore.display_strings(
        nation.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("n_regionkey"))
    )


def preview(spark, folder):
    return explore.preview(table(spark, folder, "orders"), ["o_orderkey"])


# -- vectors -----------------------------------------------------------------


def vectors(spark, folder):
    return table(spark, folder, "embeddings").withColumnRenamed("vec_id", "row_id")


def vector_questions(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def knn_single(spark, folder):
    rows = vectors(spark, folder)
    centre = nearest.mean_centroids(rows.withColumn("all", F.lit(0)), "all")
    asked = centre.select(F.lit(0).cast("bigint").alias("query_id"), "embedding")
    return nearest.knn(rows, asked, TOP_K).drop("query_id").orderBy("rank").limit(TOP_K)


def knn_batch(spark, folder):
    return nearest.knn(vectors(spark, folder), vector_questions(spark, folder), TOP_K)


def knn_metadata(spark, folder):
    """Over a stored index with typed metadata, which is filtered before the top-k."""
    rows = vectors(spark, folder)
    path = scratch_folder(spark, "typed")
    rows.select("row_id", "embedding", row_variant(rows.select("row_id", "label")).alias("metadata")).write.parquet(path)
    entries = spark.read.parquet(path)
    entries = entries.where(metadata_field(entries, "label", "int").isin(2, 3, 5))
    return nearest.knn(entries, vector_questions(spark, folder), TOP_K)


def knn_approx(spark, folder):
    """Over a stored index of which only the probed cells are read."""
    rows = vectors(spark, folder)
    centres = kept(nearest.mean_centroids(rows, "label"), "centres")
    path = scratch_folder(spark, "cells")
    nearest.assign_cells(rows, centres).write.partitionBy("cell").parquet(path)
    return nearest.knn_approx(spark.read.parquet(path), vector_questions(spark, folder), centres, TOP_K, PROBES)


def text_documents(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "text")


def questions(spark, folder):
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical_topk(spark, folder):
    return nearest.lexical_topk(text_documents(spark, folder), questions(spark, folder), TOP_K)


def make_measure():
    """A stand-in model: length of the text, and how many of its characters are blanks."""
    return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]


def embed_blank(spark, folder):
    turns = table(spark, folder, "conversations").withColumn(
        "text", F.when(F.col("role") == "system", " \n ").otherwise(F.col("text"))
    )
    return embed(turns, make_measure, dim=2).select(
        "conv_id", "turn", F.size("embedding").alias("dim"), *[
            F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(2)
        ]
    )


# -- stored searches -----------------------------------------------------------


def knn_quantised(spark, folder):
    """All vectors as questions over stored codes; how many of the exact hits are found."""
    rows, asked = vectors(spark, folder), vector_questions(spark, folder)
    stored = ProductIndex(spark, scratch_folder(spark, "codes"))
    stored.build(rows)
    hits = stored.search(asked, TOP_K).select("query_id", "row_id", F.lit(1).alias("found"))
    exact = nearest.knn(rows, asked, TOP_K).join(hits, ["query_id", "row_id"], "left")
    recall = F.count("found") / F.count(F.lit(1))
    return exact.agg(F.count(F.lit(1)).alias("hits"), (recall >= 0.9).alias("recall_at_least_0_9"))


def lexical_stored(spark, folder):
    stored = TokenIndex(spark, scratch_folder(spark, "postings"))
    stored.build(text_documents(spark, folder))
    return stored.search(questions(spark, folder), TOP_K)


def search_stored(spark, folder):
    stored = TrigramIndex(spark, scratch_folder(spark, "trigrams"), "doc_id")
    stored.build(table(spark, folder, "documents"), ["text", "source"])
    return stored.search("Licen").select("doc_id", "lang", "source", "n_chars")


def embed_once(spark, folder):
    """Half of the documents, then all; the model sees each distinct text once."""
    path = scratch_folder(spark, "texts")
    once = remembered(spark, path, lambda d: embed(d, make_measure, dim=2))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept(once(docs.where("doc_id % 2 = 0")), "half")
    rows = once(docs)
    texts = ParquetTable(spark, path, "text_id").read().agg(F.count(F.lit(1)).alias("n_texts"))
    return rows.join(texts, how="cross").select(
        "doc_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(2)], "n_texts"
    )


# -- index -------------------------------------------------------------------


def index_store(spark, folder):
    """Rows of the store: the labelled documents."""
    labels = table(spark, folder, "labels").select("doc_id").distinct()
    docs = table(spark, folder, "documents").join(labels, "doc_id", "left_semi")
    return docs.select(F.col("doc_id").cast("string").alias("row_id"), "text", "lang")


def blank_some(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.when(F.col("lang") != "de", F.col("text")).otherwise(" \t"))


def index_ids(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("row_id"), "label")


def _entry_summary(entries: DataFrame) -> DataFrame:
    return entries.select(
        "row_id",
        F.round("norm", 6).alias("norm"),
        F.col("embedding")[0].cast("double").alias("first"),
        F.col("embedding")[HASH_DIM - 1].cast("double").alias("last"),
    )


def index_incremental(spark, folder):
    docs = index_store(spark, folder).select("row_id", "text", F.lit("{}").alias("metadata"))
    return _entry_summary(index.index_entries(index.missing_documents(docs, index_ids(spark, folder))))


def index_incremental_counts(spark, folder):
    return index.incremental_counts(index_store(spark, folder), index_ids(spark, folder))


def index_rebuild(spark, folder):
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("row_id"),
        F.when(F.col("lang") != "de", F.col("text")).otherwise(" \t").alias("text"),
        F.lit("{}").alias("metadata"),
    )
    return _entry_summary(index.rebuilt_index(docs))


def index_sync(spark, folder):
    return index.sync_counts(blank_some(index_store(spark, folder)), index_ids(spark, folder))


def index_delete(spark, folder):
    entries = index_ids(spark, folder)
    return index.delete_entries(entries, index.orphans(index_store(spark, folder), entries))


def index_search(spark, folder):
    entries = hashed_embedding(text_documents(spark, folder), HASH_DIM)
    asked = hashed_embedding(questions(spark, folder), HASH_DIM)
    hits = nearest.knn(entries, asked, TOP_K)
    return index.with_payload(hits, text_documents(spark, folder), "text").select(
        "query_id", "rank", "row_id", "distance", F.length("text").alias("n_chars")
    )


# -- answers -----------------------------------------------------------------


def asked_questions(spark, folder):
    """The benchmark items, a blank question and one that nothing matches."""
    asked = questions(spark, folder)
    extra = asked.agg(F.max("query_id").alias("last")).select(
        F.inline(
            F.array(
                F.struct((F.col("last") + 1).alias("query_id"), F.lit("  ").alias("text")),
                F.struct((F.col("last") + 2).alias("query_id"), F.lit("qqqqzzzzqqqq").alias("text")),
            )
        )
    )
    return asked.unionByName(extra)


def text_hits(spark, folder):
    docs = text_documents(spark, folder)
    return index.with_payload(nearest.lexical_topk(docs, asked_questions(spark, folder), TOP_K), docs, "text")


def context_build(spark, folder):
    return answers.contexts(text_hits(spark, folder)).select("query_id", "context")


def prompt_build(spark, folder):
    asked = asked_questions(spark, folder).join(context_build(spark, folder), "query_id", "left")
    return asked.select("query_id", answers.prompt(F.col("text"), F.col("context")).alias("prompt"))


def answer_batch(spark, folder):
    answered = answers.answer(asked_questions(spark, folder), text_hits(spark, folder))
    return answered.select(
        "query_id",
        "question",
        "answer",
        "context",
        F.size("sources").alias("n_sources"),
        F.get(F.col("sources"), F.lit(0))["row_id"].alias("top_row_id"),
    )


def source_list(spark, folder):
    return text_hits(spark, folder).select(
        "query_id", "rank", answers.relevance_percent(F.col("distance")).alias("relevance"), "row_id", "text"
    )


def history(spark, folder):
    """User turns with the assistant turn that follows; joined, so a long conversation is no hot group."""
    turns = table(spark, folder, "conversations")
    replies = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    return asked.join(replies, ["conv_id", "turn"])


def query_history(spark, folder):
    return answers.recent(history(spark, folder), "conv_id", "turn")


# -- stream ------------------------------------------------------------------


def stream_upsert(spark, folder):
    """The documents read as a stream, upserted batch by batch; read back from the store."""
    where = scratch_folder(spark, "stream")
    target = store.RowStore(spark, f"{where}/store")
    identified = add_row_ids(table_stream(spark, folder, "documents"), id_columns=["text"])
    upsert_stream(identified, target, f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return target.load()


def stream_distinct(spark, folder):
    """The events as a stream, each user and type of event once; ids seen are kept as state."""
    where = scratch_folder(spark, "distinct")
    seen = distinct_stream(table_stream(spark, folder, "events"), "ts", "3650 days", id_columns=["user_id", "event_type"])
    writer = append_stream(seen, f"{where}/rows", f"{where}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(seen.schema).parquet(f"{where}/rows").select("user_id", "event_type", "row_id")


# -- stored forms ------------------------------------------------------------


def row_ids_timestamp(spark, folder):
    orders = table(spark, folder, "orders")
    return add_row_ids(orders.select("o_orderkey", F.timestamp_seconds(F.col("o_orderkey") * 1000).alias("seen"))).select(
        "o_orderkey", "row_id"
    )


def store_life(spark, folder):
    """Save, save again, append with raw headers, delete, load."""
    target = store.RowStore(spark, scratch_folder(spark, "store"))
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    target.save(docs.where("doc_id % 2 = 0"))
    target.save(docs)
    toxic = table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").alias(" Doc ID "), F.lit("xx").alias("LANG"))
    target.append(toxic)
    target.delete(target.load().where("lang = 'de'").select("row_id"))
    return target.load().select("doc_id", "lang")


def original_sheets(spark, folder):
    """Sheets kept as read; one called All is not."""
    raw = raw_sheets(spark, folder, "customer", "part")
    path = scratch_folder(spark, "sheets")
    write_original_sheets({**raw, "All": raw["part"]}, path)
    sheets = read_sheets(spark, {name: f"{path}/source_sheet={name}" for name in raw})
    return explore.sheet_counts(merge_sheets(sheets))


def sheet_folder(spark, folder):
    """CSV files whose headers differ in names and in order."""
    path = scratch_folder(spark, "csv")
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("Key"), F.col("lang").alias("Title"))
    items = table(spark, folder, "benchmark").select(F.length("text").alias("Author Name"), F.col("item_id").alias(" KEY"))
    for name, df in (("documents", docs), ("benchmark", items)):
        df.write.option("header", True).csv(f"{path}/{name}")
    rows = read_sheet_folder(spark, f"{path}/*", "csv", header=True, ignoreLeadingWhiteSpace=True)
    # Spark names the files it writes; which of the two sheets a row is from shows in its columns.
    sheet = F.when(F.col("title").isNotNull(), "documents").otherwise("benchmark")
    return rows.select("key", "title", "author", sheet.alias("source_sheet"))


def search_none(spark, folder):
    return explore.search(table(spark, folder, "nation"), "")


def find_row(spark, folder):
    rows = customers(spark, folder)
    return store.find_row(rows, rows.agg(F.max("row_id")).first()[0])


def stored_index(spark, folder, rows: DataFrame) -> index.VectorIndex:
    stored = index.VectorIndex(spark, scratch_folder(spark, "index"), name="documents")
    stored.update(rows)
    return stored


def document_rows(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("row_id"), "text", "lang")


def index_clear(spark, folder):
    stored = stored_index(spark, folder, document_rows(spark, folder))
    stored.clear()
    return stored.read().select("row_id")


def index_empty(spark, folder):
    """An index without entries answers every question with the fixed reply."""
    stored = stored_index(spark, folder, document_rows(spark, folder).limit(0))
    stored.clear()
    return answers.ask(stored, questions(spark, folder), TOP_K).select("query_id", "answer")


def index_stats(spark, folder):
    stats = stored_index(spark, folder, document_rows(spark, folder)).stats()
    return spark.createDataFrame([(stats["name"], stats["document_count"])], "name string, document_count long")


def index_stored_sync(spark, folder):
    """Entries of rows that are gone leave, blank ones never enter, a second sync changes nothing."""
    rows = document_rows(spark, folder)
    stored = stored_index(spark, folder, rows.where("lang IN ('es', 'en')"))
    # Text and language are blank for one language, so that its documents are.
    wanted = rows.where("lang <> 'es'").select(
        "row_id", *[F.when(F.col("lang") != "de", F.col(c)).otherwise(" ").alias(c) for c in ("text", "lang")]
    )
    stored.sync(wanted)
    again = stored.sync(wanted)
    if again["added"] or again["removed"]:
        raise AssertionError(f"a second sync changed the index: {again}")
    return stored.ids()


def history_log(spark, folder):
    asked = table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("question"), F.length("text").cast("string").alias("answer")
    )
    path = scratch_folder(spark, "history")
    answers.log_answers(asked, path)
    answers.log_answers(asked, path)
    return answers.read_history(spark, path).select("question", "answer")


def make_counter():
    """A stand-in chat model: the length of the question; it refuses every third."""

    def fn(prompts, system):
        out = []
        for p in prompts:
            number, _, text = p.split("\n\nQuestion: ")[1].rsplit("\n\n", 1)[0].partition(":")
            if int(number) % 3 == 0:
                raise ValueError("refused")
            out.append(str(len(text)))
        return out

    return fn


def answer_model(spark, folder):
    """A model that fails on some questions answers the others."""
    asked = questions(spark, folder).select("query_id", F.concat_ws(":", F.col("query_id").cast("string"), "text").alias("text"))
    hits = asked.select("query_id", F.lit(1).alias("rank"), F.lit("r").alias("row_id"), F.lit("hit").alias("text"), F.lit(0.5).alias("distance"))
    return answers.answer(asked, hits, make_counter).select("query_id", "answer", "error")


def make_fussy_measure():
    """As :func:`make_measure`, but it refuses texts that begin with a number divisible by three."""
    measure = make_measure()

    def fn(texts):
        for t in texts:
            head = t.partition(":")[0]
            if head.isdigit() and int(head) % 3 == 0:
                raise ValueError("refused")
        return measure(texts)

    return fn


def answer_unsearched(spark, folder):
    """Questions whose embedding fails are told so; the others are answered from the index."""
    stored = index.VectorIndex(
        spark, scratch_folder(spark, "index"), lambda d: embed(d, make_fussy_measure, dim=2, error="error")
    )
    stored.update(document_rows(spark, folder))
    asked = questions(spark, folder).select("query_id", F.concat_ws(":", F.col("query_id").cast("string"), "text").alias("text"))
    answered = answers.ask(stored, asked, TOP_K)
    shown = F.when(F.col("error").isNotNull(), F.col("answer")).otherwise("answered")
    return answered.select("query_id", shown.alias("answer"), "error", F.size("sources").alias("n_sources"))


def make_shouter():
    return lambda prompts, system: [f"{system}: {p.upper()}" for p in prompts]


def complete_prompts(spark, folder):
    turns = table(spark, folder, "conversations")
    return complete(turns, make_shouter, "role", "reply", "be brief").select("conv_id", "turn", "reply")


QUERIES: dict[str, Query] = {
    "sheets_union": sheets_union,
    "sheet_counts": sheet_counts,
    "ingest": ingested,
    "row_id": row_ids,
    "row_id_typed": row_ids_typed,
    "row_id_lineitem": row_ids_lineitem,
    "row_dedup": row_dedup,
    "row_text": row_texts,
    "row_metadata": row_metadatas,
    "documents_view": documents_view,
    "store_upsert": store_upsert,
    "store_append": store_append,
    "store_delete": store_delete,
    "row_lookup": row_lookup,
    "store_stats": store_stats,
    "entry_coercion": entry_coercion,
    "entry_rejects": entry_rejects,
    "search_column": search_column,
    "search_all": search_all,
    "search_regex": search_regex,
    "column_profile": column_profile,
    "column_profile_stored": column_profile_stored,
    "display_strings": display_strings,
    "preview": preview,
    "knn_single": knn_single,
    "knn_batch": knn_batch,
    "knn_approx": knn_approx,
    "knn_quantised": knn_quantised,
    "lexical_topk": lexical_topk,
    "lexical_stored": lexical_stored,
    "search_stored": search_stored,
    "embed_blank": embed_blank,
    "embed_once": embed_once,
    "index_incremental": index_incremental,
    "index_incremental_counts": index_incremental_counts,
    "index_rebuild": index_rebuild,
    "index_sync": index_sync,
    "index_delete": index_delete,
    "index_search": index_search,
    "knn_metadata": knn_metadata,
    "context_build": context_build,
    "prompt_build": prompt_build,
    "answer_batch": answer_batch,
    "source_list": source_list,
    "query_history": query_history,
    "stream_upsert": stream_upsert,
    "stream_distinct": stream_distinct,
    "row_id_timestamp": row_ids_timestamp,
    "store_life": store_life,
    "original_sheets": original_sheets,
    "sheet_folder": sheet_folder,
    "search_none": search_none,
    "find_row": find_row,
    "index_clear": index_clear,
    "index_empty": index_empty,
    "index_stats": index_stats,
    "index_stored_sync": index_stored_sync,
    "history_log": history_log,
    "answer_model": answer_model,
    "answer_unsearched": answer_unsearched,
    "complete_prompts": complete_prompts,
}
