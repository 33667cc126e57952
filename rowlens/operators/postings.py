"""A stored inverted index: top-k by cosine of token counts without reading the texts again.

Documents are dealt into blocks by a hash of their id. A posting row is a token
in a block: the places in the block of the documents that have it, how often they have it, and
the largest of their weights (count over the length of the document's count vector).
One more row per block, without a token, names its documents and their lengths. So the texts are
shuffled once, whole blocks become postings in one task, and a posting is a few bytes. Rows
are stored in folders by a hash of the token, so a search reads the folders and rows of its own
tokens only. They meet by block, each block is scored for all questions in
numpy, and a question skips a block in which even the largest weights together
cannot beat what it has found so far.

    path/postings   bucket=.../ token, block, largest, places, counts
                    bucket=-1/  block, documents, lengths
    path/shape      blocks, buckets, type of the ids
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from rowlens.functions.text import tokens
from rowlens.operators.nearest import BROADCAST_BYTES, BROADCAST_ROWS, TokenQuestions, _ranks, _SCALE, _token_counts, _top_k
from rowlens.sources.scratch import kept

BLOCK_ROWS = 256
# Folders that the tokens are dealt to.
BUCKETS = 64
# Up to this many tokens of a search are named in the scan's filter; more are joined.
NAMED_TOKENS = 2_000


# Folder of the rows without a token.
NO_TOKEN = -1


def _bucket(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``block``, cut and put together to one for each block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            block = batch.column("block").to_numpy()
            if held and held[0].column("block")[0].as_py() != block[0]:
                yield pa.concat_batches(held)
                held = []
            n = int(np.searchsorted(block, block[0], side="right"))
            held.append(batch.slice(0, n))
            batch = batch.slice(n)
    if held:
        yield pa.concat_batches(held)


def _place_type(documents: int):
    """Of places in a block, from the number of its documents."""
    return np.dtype("<u2" if documents <= 1 << 16 else "<u4")


def _binary(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One value of bytes for each stretch of numbers."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * numbers.itemsize
    if ends[-1] >= 1 << 31:
        raise ValueError("a block of postings has more than 2 GB; build with fewer rows in a block")
    buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(numbers.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)


class TokenIndex:
    """Stored postings of ``row_id, text``; ``row_id`` is unique."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, documents: DataFrame, text: str = "text", block_rows: int = BLOCK_ROWS, buckets: int = BUCKETS) -> None:
        """Tokenise once and store. Documents without a token have no posting and are never a hit."""
        rows = documents.select("row_id", F.col(text).alias("payload")).where("row_id is not null and payload is not null")
        blocks = max(1, -(-documents.count() // block_rows))
        kind = documents.schema["row_id"].dataType.simpleString()

        def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in _whole_blocks(batches):
                words, row, word, counts = _token_counts(block.column("payload"))
                if not len(row):
                    continue
                order = np.lexsort((row, word))
                row, word, counts = row[order], word[order], counts[order]
                lengths = np.sqrt(np.bincount(row, counts**2, len(block)))
                per = np.bincount(word, minlength=len(words))
                first = np.cumsum(per) - per
                largest = np.maximum.reduceat(counts / lengths[row], first)
                number, n = block.column("block")[0].as_py(), len(words)
                few = np.dtype("<u1" if counts.max() < 256 else "<u4")
                ids = block.column("row_id")
                own = pa.array([0, len(block)], pa.int32())
                columns = {
                    "token": pa.concat_arrays([words, pa.nulls(1, words.type)]),
                    "block": pa.array(np.full(n + 1, number, np.int32)),
                    "largest": pa.array(np.append(largest, 0.0)),
                    "places": pa.concat_arrays([_binary(row.astype(_place_type(len(block))), per), pa.nulls(1, pa.binary())]),
                    "counts": pa.concat_arrays([_binary(counts.astype(few), per), pa.nulls(1, pa.binary())]),
                    "documents": pa.concat_arrays([pa.nulls(n, pa.list_(ids.type)), pa.ListArray.from_arrays(own, ids)]),
                    "lengths": pa.concat_arrays([pa.nulls(n, pa.list_(pa.float64())), pa.ListArray.from_arrays(own, pa.array(lengths))]),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        dealt = rows.withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"))
        # Cut into tokens behind the shuffle, as lists of tokens are larger than texts.
        whole = dealt.repartition("block").sortWithinPartitions("block").withColumn("payload", tokens(F.col("payload")))
        lists = whole.mapInArrow(invert, self._schema(kind))
        placed = lists.withColumn("bucket", F.when(F.col("token").isNull(), NO_TOKEN).otherwise(_bucket("token", buckets)))
        # A bucket is one range of tokens after another, so row groups are pruned by token.
        placed = placed.repartition("bucket", F.pmod("block", F.lit(16))).sortWithinPartitions("bucket", "token", "block")
        placed.write.partitionBy("bucket").parquet(f"{self.path}/postings")
        shape = self.spark.createDataFrame([(blocks, buckets, kind)], "blocks int, buckets int, kind string")
        shape.write.parquet(f"{self.path}/shape")

    @staticmethod
    def _schema(kind: str) -> str:
        lists = f"documents array<{kind}>, lengths array<double>"
        return f"token string, block int, largest double, places binary, counts binary, {lists}"

    def _stored(self) -> tuple[DataFrame, int]:
        _, buckets, kind = self.spark.read.parquet(f"{self.path}/shape").first()
        return self.spark.read.schema(f"{self._schema(kind)}, bucket int").parquet(f"{self.path}/postings"), buckets

    def postings(self, asked: DataFrame) -> DataFrame:
        """The stored rows of the tokens in ``asked(token)``; other folders are not listed, other rows not read."""
        stored, buckets = self._stored()
        own = kept(asked.select("token").distinct().withColumn("bucket", _bucket("token", buckets)), "tokens")
        folders = [r["bucket"] for r in own.select("bucket").distinct().collect()]
        stored = stored.where(F.col("bucket").isin(folders))
        few = own.limit(NAMED_TOKENS + 1).select("token").collect()
        if len(few) <= NAMED_TOKENS:
            stored = stored.where(F.col("token").isin([r["token"] for r in few]))
            return stored.select("token", "block", "largest", "places", "counts")
        joined = stored.join(own, ["bucket", "token"], "left_semi")
        return joined.select("token", "block", "largest", "places", "counts")

    def _scored(self, questions: DataFrame, k: int) -> DataFrame:
        """Best ``k`` per task of a bounded number of ``questions(query_id, payload)``."""
        shared = self.spark.sparkContext.broadcast(questions.toArrow())
        rows = self.postings(questions.select(F.explode("payload").alias("token")))
        # The rows that name the documents of the blocks: one for each block.
        named = self._stored()[0].where(F.col("bucket") == NO_TOKEN).drop("bucket")
        rows = rows.unionByName(named, allowMissingColumns=True)
        ids, kind = (df.schema[c].dataType for df, c in ((questions, "query_id"), (rows, "documents")))
        schema = f"query_id {ids.simpleString()}, row_id {kind.elementType.simpleString()}, distance double, skipped long"
        by_block = rows.repartition("block").sortWithinPartitions("block")

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = TokenQuestions(shared.value)
            search = _BlockSearch(asked, k)
            for block in _whole_blocks(batches):
                search.add(block)
            yield from search.result()

        return by_block.mapInArrow(score, schema)

    def search(
        self, questions: DataFrame, k: int = 5, text: str = "text", broadcast_rows: int = BROADCAST_ROWS
    ) -> DataFrame:
        """``query_id, rank, row_id, distance`` as :func:`rowlens.operators.nearest.lexical_topk` gives them.

        Questions go in chunks of bounded size. Those without a token, or that share none with any document, have no hits.
        """
        asked = kept(questions.select("query_id", tokens(F.col(text)).alias("payload")).where(F.size("payload") > 0), "questions")
        size = F.octet_length(F.concat_ws(" ", "payload"))
        count, bytes_ = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        chunks = max(-(-2 * count // broadcast_rows), -(-2 * bytes_ // BROADCAST_BYTES)) if count > broadcast_rows or bytes_ > BROADCAST_BYTES else 1
        part = F.pmod(F.xxhash64(F.lit(7), "query_id"), F.lit(chunks))
        found = None
        for i in range(chunks):
            some = self._scored(asked.where(part == i), k).where("row_id is not null").drop("skipped")
            some = _top_k(some, k)
            found = some if found is None else found.unionByName(some)
        return found

    def skipped(self, questions: DataFrame, k: int = 5, text: str = "text") -> int:
        """How many (question, block) pairs a search leaves out by their bound."""
        asked = kept(questions.select("query_id", tokens(F.col(text)).alias("payload")).where(F.size("payload") > 0), "questions")
        return self._scored(asked, k).agg(F.coalesce(F.sum("skipped"), F.lit(0))).first()[0]


class _BlockSearch:
    """Blocks of postings in, the best ``k`` rows per question out."""

    def __init__(self, asked: TokenQuestions, k: int):
        self.asked, self.k, self.skipped = asked, k, 0
        self.query = self.rank = np.zeros(0, np.int64)
        self.rows: list = []
        self.place = np.zeros(0, np.int64)
        self.ids: pa.Array | None = None
        self.bar = np.full(len(asked.ids), np.iinfo(np.int64).max)  # what a rank must not exceed

    def add(self, block: pa.RecordBatch) -> None:
        asked, n_asked = self.asked, len(self.asked.ids)
        known = pc.is_valid(block.column("token"))
        head, block = block.filter(pc.invert(known)), block.filter(known)
        if not block.num_rows:
            return
        word = pc.index_in(block.column("token"), asked.words)
        word = pc.fill_null(word, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, end = asked.first[word], asked.first[word + 1]
        sizes = end - begin
        # Upper bounds: the largest weight of each shared token, added up per question.
        which = np.repeat(np.arange(len(word)), sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[which]
        largest = block.column("largest").to_numpy()
        bound = np.bincount(asked.question[at], asked.weight[at] * largest[which], n_asked)
        # A rank is rounded; one unit more than the bound allows for both roundings.
        hopeful = (bound > 0) & (_ranks(bound) - 1 <= self.bar)
        self.skipped += int(((bound > 0) & ~hopeful).sum())
        mine = np.flatnonzero(hopeful)
        if not len(mine):
            return
        names = head.column("documents").flatten().dictionary_encode()
        kind = _place_type(len(names))
        per = pc.binary_length(block.column("places")).to_numpy().astype(np.int64) // kind.itemsize
        first = np.cumsum(per) - per
        here = np.frombuffer(b"".join(block.column("places").to_pylist()), kind)
        counts = b"".join(block.column("counts").to_pylist())
        counts = np.frombuffer(counts, f"<u{len(counts) // len(here)}")
        weight = counts / head.column("lengths").flatten().to_numpy()[here]
        document = names.indices.to_numpy().astype(np.int64)[here]
        ids = names.dictionary
        order = pc.sort_indices(ids).to_numpy().astype(np.int64)
        position = np.empty(len(ids), np.int64)
        position[order] = np.arange(len(ids))  # in the order of ids, which breaks ties
        ids = ids.take(pa.array(order))
        live = np.full(n_asked, -1)
        live[mine] = np.arange(len(mine))
        pairs = np.flatnonzero(live[asked.question[at]] >= 0)
        scores = np.zeros(len(mine) * len(ids))
        for lo in range(0, len(pairs), 4_096):
            some = pairs[lo : lo + 4_096]
            row = which[some]
            reach = per[row]
            inside = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(first[row], reach)
            question = np.repeat(live[asked.question[at[some]]], reach)
            value = np.repeat(asked.weight[at[some]], reach) * weight[inside]
            scores += np.bincount(question * len(ids) + position[document[inside]], value, len(scores))
        scores = scores.reshape(len(mine), len(ids))
        query, place = np.nonzero(scores > 0)
        rank = _ranks(scores[query, place])
        query = mine[query]
        good = rank <= self.bar[query]
        self._merge(query[good], rank[good], place[good], ids)

    def _merge(self, query: np.ndarray, rank: np.ndarray, place: np.ndarray, ids: pa.Array) -> None:
        if self.ids is not None:
            old = len(self.ids)
            names = pa.concat_arrays([self.ids, ids])
            query, rank = np.concatenate([self.query, query]), np.concatenate([self.rank, rank])
            place = np.concatenate([self.place, place + old])
        else:
            names = ids
        used = names.take(pa.array(place))
        by_id = np.empty(len(used), np.int64)
        by_id[pc.sort_indices(used).to_numpy().astype(np.int64)] = np.arange(len(used))
        order = np.lexsort((by_id, rank, query))
        query, rank = query[order], rank[order]
        starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = nth < self.k
        self.query, self.rank = query[keep], rank[keep]
        self.ids = used.take(pa.array(order[keep]))
        self.place = np.arange(len(self.ids))
        full = nth == self.k - 1
        self.bar[query[full]] = rank[full]

    def result(self) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "row_id", "distance", "skipped"]
        if self.ids is None:
            return
        n = len(self.query)
        yield pa.RecordBatch.from_arrays(
            [self.asked.ids.take(pa.array(self.query)), self.ids, pa.array(self.rank / _SCALE), pa.array(np.zeros(n, np.int64))], names
        )
        nothing = [pa.nulls(1, self.asked.ids.type), pa.nulls(1, self.ids.type), pa.nulls(1, pa.float64())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([self.skipped])], names)
