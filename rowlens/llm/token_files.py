"""Token ids of documents in compact binary files, written and read in parallel.

Every document is tokenised once, where it is read. Counts of all ids of all
documents make one shared frequency table. Documents are range-sorted by id and
each task writes its stretch as independent blocks of a static range asymmetric
numeral system (:mod:`rowlens.llm.rans`), with checkpoints and checksums, so any
block, or any segment of one, can be decoded by itself.

    path/table    id, frequency
    path/blocks   part, block, ids before it in its part, its documents, the block
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowlens.llm.common import staged, text_blocks
from rowlens.llm.rans import BLOCK_IDS, Table, decode_blocks, encode_blocks, joined_crc, scaled

END_ID = 1
# Encoded words kept by one Python worker.
MEMO_WORDS = 600_000
# Blocks that a task encodes or decodes side by side.
BLOCKS_AT_ONCE = 8
# Compressed ids of a document, while they are sorted.
_LEVEL = 1
_PLAIN_BYTES = 64


def word_end_tokenizer(model: dict):
    """The vocabulary of a BPE file with word ends, in an encoder that is fast on single words.

    A blank after the word stands for its end. The lowest ranks are those of
    single bytes, then of a byte that ends a word, so the end always joins the
    last byte first. A merge of two tokens is known by what it makes, which is
    the same as long as every token is what its own merges make of it; a test
    makes sure of that for the whole vocabulary.
    """
    import tiktoken

    # Such files write each byte as one printable character, itself or the next one after U+0100.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, plain), plain))
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in model["added_tokens"]}
    end = model["model"]["end_of_word_suffix"]
    ranks = {}
    for token, i in model["model"]["vocab"].items():
        if token in special:
            continue
        ends = token.endswith(end) and token != end
        word = bytes(letters[c] for c in (token.removesuffix(end) if ends else token))
        if ends and word == b" ":
            continue  # a blank never ends a word
        ranks[word + b" " * ends] = i
    return tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


# The pre-tokens of such a tokenizer.
_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEndIds(dict):
    """Ids, as bytes, of the words of a text in a tokenizer that lower-cases and drops white space."""

    def __init__(self, tokenizer_path: str, width: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.width = width
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            model = json.load(f)
        self.fast = word_end_tokenizer(model).encode_ordinary
        self.pretokens = regex.compile(_PRETOKENS).findall
        vocabulary, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(end)]] = True

    def _remember(self, words: list[str]) -> None:
        """Encode new words: those of plain letters and signs in one call, the rest by the file's own tokenizer."""
        plain, rest, flat, counts = [], [], [], []
        self[""] = b""
        for word in filter(None, words):
            # Letters, perhaps with a mark behind them, need no pattern. Normal forms leave
            # the characters below U+0100 alone, and each has one lower case.
            mark = word[-1] if word[-1] in ",." else ""
            letters = word[:-1] if mark else word
            if letters.isalpha() and (letters.isascii() or max(letters) <= "\xff"):
                pieces = (letters.lower(), mark) if mark else (letters.lower(),)
            elif word.isprintable() and max(word) <= "\xff" and "<|" not in word:
                pieces = self.pretokens(word.lower())
            else:
                rest.append(word)
                continue
            plain.append(word)
            flat.extend(pieces)
            counts.append(len(pieces))
        if rest:
            for word, found in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
                self[word] = array(self.width, found.ids).tobytes()
        if flat:
            ids = np.array(self.fast(" ".join(flat) + " "), np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(flat):
                raise ValueError("an encoded word lacks its end")
            upto = np.concatenate([[0], last + 1])[np.concatenate([[0], np.cumsum(counts)])]
            data = ids.astype(f"<u{array(self.width).itemsize}").tobytes()
            size = array(self.width).itemsize
            bounds = (upto * size).tolist()
            self.update(zip(plain, [data[a:b] for a, b in zip(bounds, bounds[1:])]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """No pre-token goes across white space, so words are encoded one by one and remembered."""
        if len(self) >= MEMO_WORDS:
            self.clear()
        words = [text.replace("\n", " ").split(" ") for text in texts]
        self._remember([word for word in set().union(*words) if word not in self])
        return [b"".join(map(self.__getitem__, some)) for some in words]


def _width(tokenizer_path: str, end_id: int) -> str:
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    return "H" if most <= 1 << 16 else "I"


def token_ids(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID
) -> DataFrame:
    """``id, tie, ids``: every document's ids with the end id, compressed; ``tie`` orders rows of one id."""
    kind = docs.schema[id_column].dataType.simpleString()
    width = _width(tokenizer_path, end_id)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, pack = WordEndIds(tokenizer_path, width), zstandard.ZstdCompressor(_LEVEL).compress
        end = array(width, [end_id]).tobytes()
        for block in text_blocks(batches):
            found, ties = [], []
            for ids in encoder.encode([text or "" for text in block.column("text").to_pylist()]):
                ids += end
                ties.append(zlib.crc32(ids))
                found.append(b"\1" + pack(ids) if len(ids) > _PLAIN_BYTES else b"\0" + ids)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(ties, pa.int64()), pa.array(found, pa.binary())], ["id", "tie", "ids"]
            )

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(each, f"id {kind}, tie long, ids binary")


def _unpacker(width: str):
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    kind = np.dtype("<u2" if width == "H" else "<u4")
    return lambda data: np.frombuffer(unpack(data[1:]) if data[0] else data[1:], kind)


def token_counts(rows: DataFrame, width: str) -> DataFrame:
    """``token, n`` over all documents."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, counts = _unpacker(width), np.zeros(1, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                found = np.bincount(unpack(data.as_py()), minlength=len(counts))
                found[: len(counts)] += counts
                counts = found
        token = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(counts[token])], ["token", "n"])

    return rows.select("ids").mapInArrow(each, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _table(frequencies: list) -> Table:
    size = 1 + max(f[0] for f in frequencies)
    frequency = np.zeros(size, np.int64)
    for token, n in frequencies:
        frequency[token] = n
    return Table.of(frequency)


_BLOCK = "part int, block int, before long, first_document long, ids array<{kind}>, lengths array<int>, begins boolean, ends boolean, n long, data binary"


class _Stretch:
    """Documents in order, given out as the ids and documents of whole blocks."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.documents: list = []  # [id, ids left]
        self.begun = False  # whether the first one has ids in an earlier block

    def add(self, key, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        self.documents.append([key, len(ids)])

    def take(self, n: int) -> tuple[np.ndarray, list]:
        """The next ``n`` ids, and for each block its documents, their ids in it, whether it begins and ends with a whole one."""
        flat = np.concatenate(self.ids) if len(self.ids) > 1 else self.ids[0]
        now, rest = flat[:n], flat[n:]
        self.ids, self.held = ([rest] if len(rest) else []), len(rest)
        blocks, at = [], 0
        for start in range(0, n, BLOCK_IDS):
            room, keys, lengths = min(BLOCK_IDS, n - start), [], []
            begins = not self.begun
            while room:
                key, left = self.documents[at]
                used = min(room, left)
                keys.append(key)
                lengths.append(used)
                room -= used
                if used == left:
                    at += 1
                    self.begun = False
                else:
                    self.documents[at][1] -= used
                    self.begun = True
            blocks.append((keys, lengths, begins, not self.begun))
        del self.documents[:at]
        return now, blocks


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = END_ID,
) -> None:
    """Write the ids of all documents, in ascending order of their id, to ``path``.

    Rows without an id come first, rows that repeat an id are ordered by a
    checksum of their ids and then by the ids. A null or empty text is its end id alone. Very long documents
    go on from block to block. Other columns are not read. The only thing the driver sees
    is the frequency table, of at most as many rows as the vocabulary has ids.
    """
    spark = docs.sparkSession
    width = _width(tokenizer_path, end_id)
    rows = staged(token_ids(docs, tokenizer_path, id_column, text_column, end_id))
    counts = token_counts(rows, width).collect()
    tokens = np.array([r["token"] for r in counts], np.int64)
    frequency = scaled(np.array([r["n"] for r in counts], np.int64))
    pairs = [(int(t), int(f)) for t, f in sorted(zip(tokens, frequency))]
    spark.createDataFrame(pairs, "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(pairs)
    kind = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, document = TaskContext.get().partitionId(), 0, 0, 0
        unpack, stretch, table = _unpacker(width), _Stretch(), None
        id_type = None

        def flush(n: int) -> pa.RecordBatch:
            nonlocal block, before, document
            ids, about = stretch.take(n)
            columns: list[list] = [[] for _ in range(8)]
            for (count, data), (keys, lengths, begins, ends) in zip(encode_blocks(ids, table), about):
                for column, value in zip(columns, (block, before, document, keys, lengths, begins, ends, (count, data))):
                    column.append(value)
                block, before, document = block + 1, before + count, document + len(keys) - (not ends)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.bool_(), pa.bool_())
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            data = [pa.array([x[0] for x in columns[7]], pa.int64()), pa.array([x[1] for x in columns[7]], pa.binary())]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(arrays[0]), part, np.int32)), *arrays, *data],
                ["part", "block", "before", "first_document", "ids", "lengths", "begins", "ends", "n", "data"],
            )

        most = BLOCKS_AT_ONCE * BLOCK_IDS
        for batch in batches:
            table = table or _table(shared.value)
            id_type = batch.schema.field("id").type
            keys = batch.column("id").to_pylist()
            for key, data in zip(keys, batch.column("ids")):
                stretch.add(key, unpack(data.as_py()))
                while stretch.held >= most:
                    yield flush(most)
        if stretch.held:
            yield flush(stretch.held)

    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "ids")
    ordered.mapInArrow(encode, _BLOCK.format(kind=kind)).write.option("compression", "none").parquet(f"{path}/blocks")


_PIECE = "id {kind}, part int, block int, document long, before long, n long, ids_crc32 long, begins boolean, ends boolean"


def read_pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """What each block has of each document: ``id, part, block, document, before, n, ids_crc32, begins, ends[, ids]``.

    ``document`` numbers the documents of a part and ``before`` counts the ids
    of the part before the piece, both in order; ``ids`` is an array.
    """
    table = spark.read.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast([tuple(r) for r in table.collect()])
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCKS_AT_ONCE):
                batch = whole.slice(at, BLOCKS_AT_ONCE)
                own = own or _table(shared.value)
                found = decode_blocks(batch.column("data").to_pylist(), own)
                lists, keys = batch.column("lengths"), batch.column("ids").flatten()
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.cumsum(sizes) - sizes
                ids = np.concatenate(found)
                ends_at = np.cumsum(lengths)
                if len(ids) != (ends_at[-1] if len(ends_at) else 0):
                    raise ValueError("a block holds another number of ids than its documents")
                data = ids.astype("<u4")
                bounds = np.concatenate([[0], ends_at]).tolist()
                sums = [zlib.crc32(data[a:b]) for a, b in zip(bounds, bounds[1:])]
                row = np.repeat(np.arange(len(batch)), sizes)
                inside = np.arange(len(lengths)) - first[row]
                in_block = ends_at - lengths - (ends_at - lengths)[first[row]]
                begins = (inside > 0) | batch.column("begins").to_numpy(zero_copy_only=False)[row]
                ends = (inside < sizes[row] - 1) | batch.column("ends").to_numpy(zero_copy_only=False)[row]
                columns = [
                    keys,
                    batch.column("part").take(pa.array(row)),
                    batch.column("block").take(pa.array(row)),
                    pa.array(batch.column("first_document").to_numpy()[row] + inside),
                    pa.array(batch.column("before").to_numpy()[row] + in_block),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                    pa.array(begins),
                    pa.array(ends),
                ]
                names = ["id", "part", "block", "document", "before", "n", "ids_crc32", "begins", "ends"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.mapInArrow(decode, _PIECE.format(kind=kind) + (", ids array<int>" if with_ids else ""))


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document from its pieces in order; only what is being joined is held."""
    key, now, id_type = None, None, None
    names = ["id", "part", "document", "before", "n", "ids_crc32"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate([id_type, *types])], names
        )

    for batch in batches:
        id_type, done = batch.schema.field("id").type, []
        for r in batch.to_pylist():
            if (r["part"], r["document"]) != key:
                if now:
                    done.append(now)
                key, now = (r["part"], r["document"]), [r[n] for n in names]
            else:
                now[4] += r["n"]
                now[5] = joined_crc(now[5], r["ids_crc32"], 4 * r["n"])
        if done:
            yield out(done)
    if now:
        yield out([now])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: ``id, start, n_tokens, ids_crc32``.

    Documents that lie in one block are done where it is decoded. Of those that
    were cut, the pieces' counts and checksums (no ids) are sorted and joined.
    """
    pieces = staged(read_pieces(spark, path))
    columns = ["id", "part", "document", "before", "n", "ids_crc32"]
    whole = pieces.where("begins and ends").select(*columns)
    kind = pieces.schema["id"].dataType.simpleString()
    cut = pieces.where("not (begins and ends)").repartition("part", "document")
    cut = cut.sortWithinPartitions("part", "document", "block").mapInArrow(
        _join_pieces, f"id {kind}, part int, document long, before long, n long, ids_crc32 long"
    )
    # One row per file part: where it begins.
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("total"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.select("part", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("first")))
    return whole.unionByName(cut).join(parts, "part").select(
        "id", (F.col("first") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32"
    )
