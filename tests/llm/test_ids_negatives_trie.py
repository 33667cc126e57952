"""Token files, hard negatives and the prefix trie against plain versions."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlens.llm import rans
from rowlens.llm.hard_negatives import Anchors, coded, hard_negatives
from rowlens.llm.prefix_trie import as_paths, conversation_trie, conversations, prefix_trie, regrafted
from rowlens.llm.queries import LLM_QUERIES, tokenizer_path
from rowlens.llm.token_files import WordEndIds, read_digests, read_pieces, write_tokens

WORDS = "word_bpe_49k.json"


# -- token files -------------------------------------------------------------


@pytest.mark.parametrize("n, values", [(1, 1), (5, 3), (127, 2), (129, 50_000), (40_000, 100), (rans.BLOCK_IDS + 33_000, 9_000)])
def test_blocks_round_trip(n, values):
    ids = (np.random.default_rng(n).zipf(1.2, n) % values).astype(np.uint32)
    table = rans.Table.of(rans.scaled(np.bincount(ids, minlength=values)))
    blocks = rans.encode_blocks(ids, table)
    assert sum(count for count, _ in blocks) == n
    assert np.array_equal(np.concatenate(rans.decode_blocks([data for _, data in blocks], table)), ids)
    if n > rans.BLOCK_IDS:  # from a checkpoint on
        part = rans.decode_blocks([blocks[0][1]], table, [(2, 4)])[0]
        assert np.array_equal(part, ids[2 * rans.SEGMENT_IDS : 4 * rans.SEGMENT_IDS])
        share = np.bincount(ids) / n
        entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
        assert 8 * sum(len(data) for _, data in blocks) / n < 1.05 * entropy


def test_damage_is_found():
    ids = np.arange(5_000, dtype=np.uint32) % 50
    table = rans.Table.of(rans.scaled(np.bincount(ids)))
    (_, block), = rans.encode_blocks(ids, table)
    for place in (30, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[place] ^= 4
        with pytest.raises(ValueError, match="checksum"):
            rans.decode_blocks([bytes(broken)], table)


def test_frequencies():
    for counts in ([1], [1] * 5_000, [10**12, *[1] * 300], [0, 3, 0, 10**9]):
        counts = np.array(counts)
        scaled = rans.scaled(counts)
        assert bin(scaled.sum()).count("1") == 1 and ((scaled > 0) == (counts > 0)).all()


@pytest.mark.parametrize("a, b", [(b"", b""), (b"abc", b""), (b"", b"abc"), (b"x" * 1000, bytes(range(256)) * 9)])
def test_joined_crc(a, b):
    assert rans.joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_every_token_is_what_its_merges_make():
    """So a merge may be known by what it makes, as the fast encoder does."""
    with open(tokenizer_path(WORDS), encoding="utf-8") as f:
        model = json.load(f)
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["model"]["merges"])}
    end, special = model["model"]["end_of_word_suffix"], {t["content"] for t in model["added_tokens"]}
    for token in model["model"]["vocab"].keys() - special:
        parts = list(token.removesuffix(end))
        parts[-1] += end if token.endswith(end) else ""
        while len(parts) > 1:
            best, i = min((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            assert best < 1 << 60, token
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [token]


def test_words_are_encoded_as_the_file_does():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer_path(WORDS)), WordEndIds(tokenizer_path(WORDS), "H")
    random.seed(3)
    letters = [chr(c) for c in range(1, 400)] + [" "] * 60 + ["'"] * 9 + list("eanist,.") * 12
    texts = ["".join(random.choices(letters, k=80)) for _ in range(1_500)]
    texts += ["<|endoftext|>, Hi <|ENDOFTEXT|>", "don't I'LL 's", "Éa ́b", "İΣΑΣ ǅ ß ﬁ", "日本語 ½²", "", " \n", "x,. y.. 'S'T''ll"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files(spark, tmp_path):
    """Null, empty and very long texts, missing and repeated ids, clashing columns."""
    from tokenizers import Tokenizer

    long = "lorem ipsum " * 250_000  # more than one block
    rows = [(None, "a b"), (None, "c"), (5, long), (5, "y"), (3, None), (4, ""), (9, long + "z"), (10, "q"), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({"id": F.lit("x"), "ids": F.lit(1), "part": F.lit(2), "TIE": F.lit(0)})
    write_tokens(docs, f"{tmp_path}/t", tokenizer_path(WORDS))
    found = [tuple(r) for r in read_digests(spark, f"{tmp_path}/t").orderBy("start").collect()]
    plain, expected = Tokenizer.from_file(tokenizer_path(WORDS)), []
    for key, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r[0], *r[2:]) for r in found), key=str) == sorted(expected, key=str)
    keys = [r[0] if r[0] is not None else -1 for r in found]
    assert keys == sorted(keys)
    assert [r[1] for r in found] == [sum(r[2] for r in found[:i]) for i in range(len(found))]
    blocks = spark.read.parquet(f"{tmp_path}/t/blocks")
    assert blocks.count() > len(rows) / 2 and blocks.agg(F.max("n")).first()[0] == rans.BLOCK_IDS
    ids = read_pieces(spark, f"{tmp_path}/t", with_ids=True).where("id = 10").first()["ids"]
    assert ids == [*plain.encode("q", add_special_tokens=False).ids, 1]


def test_no_documents_to_write(spark, tmp_path):
    write_tokens(spark.createDataFrame([], "doc_id string, text string"), f"{tmp_path}/t", tokenizer_path(WORDS))
    assert read_digests(spark, f"{tmp_path}/t").collect() == []


def test_token_files_of_the_table(spark, sf):
    from tokenizers import Tokenizer

    plain, start, expected = Tokenizer.from_file(tokenizer_path(WORDS)), 0, []
    for key, text in sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in LLM_QUERIES["op11_token_files"](spark, sf).collect()) == expected


# -- hard negatives ------------------------------------------------------------

NEGATIVES = "vec_id long, vector array<long>, label int, anchor boolean"


def plain_negatives(rows, k=5, n=10):
    out, rows = [], [r for r in rows if r[1] and None not in r[1] and r[2] is not None]
    last = 1 << 63
    for a in rows:
        if not a[3] or a[0] is None:
            continue
        scored = [(-sum(x * y for x, y in zip(a[1], b[1])), last if b[0] is None else b[0], b[2], b is a) for b in rows if len(b[1]) == len(a[1])]
        scored.sort()
        for p in [s for s in scored if s[2] == a[2] and not s[3]][:k]:
            ok = [s for s in scored if s[2] != a[2] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:n]
            out += [(a[0], p[1] % last or None if p[1] == last else p[1], i + 1, None if s[1] == last else s[1], -p[0], -s[0]) for i, s in enumerate(ok)]
    return sorted(out, key=str)


def test_hard_negatives(spark):
    """Ties, copies, missing and repeated ids, nulls, lengths that differ, several chunks."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        vector = rng.integers(-9, 9, 6 if i % 5 else 70).tolist()
        rows.append((i, vector, int(rng.integers(0, 3)), i % 10 == 0))
    rows += [(7, [1] * 6, 1, True), (7, [1] * 6, 1, True), (20, [3] * 6, 0, True), (None, [2] * 6, 1, True), (None, [2] * 6, 0, False)]
    rows += [(500, None, 1, True), (501, [1, None, 1, 1, 1, 1], 1, True), (502, [1] * 6, None, True), (503, [0] * 6, 1, True), (504, [], 1, True), (505, [], 0, None)]
    rows += [(600 + i, [4, 4, 4, 0, 0, 0], 2, i < 3) for i in range(40)]
    df = spark.createDataFrame(rows, NEGATIVES).repartition(5).withColumns({"key": F.lit(1), "ID": F.lit(2), "score": F.lit("x"), "code": F.lit(0)})
    expected = plain_negatives(rows)
    for at_once in (16_384, 13):
        assert sorted((tuple(r) for r in hard_negatives(df, rows_at_once=at_once).collect()), key=str) == expected
    assert hard_negatives(df.limit(0)).collect() == []
    assert hard_negatives(df.where("not anchor")).collect() == []


def test_scores_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(0, [1 << 40] * 4, 1, True), (1, [1] * 4, 1, False)], NEGATIVES)
    with pytest.raises(Exception, match="too large"):
        hard_negatives(df).collect()


@pytest.mark.parametrize("dim", [1, 3, 64, 65, 200])
def test_intervals_hold(dim):
    rng = np.random.default_rng(dim)
    rows, asked = rng.integers(-300, 300, (200, dim)), rng.integers(-300, 300, (40, dim))
    rows[:20] = asked[:20] + rng.integers(-9, 9, (20, dim))
    rows[50] = 0
    asked[30] = 0
    anchors = Anchors(np.arange(40), np.arange(40), np.zeros(40), asked)
    lower, upper = anchors.interval(slice(0, 40), *coded(rows))
    scores = rows @ asked.T
    assert (lower <= scores).all() and (scores <= upper).all()
    if dim >= 64:  # and they tell near from far
        alike = np.diag(scores[:20, :20])
        assert (upper[100:, :20] < alike).mean() > 0.5


# -- prefix trie ---------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows, graft):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        base = c - c % 100 if c >= 0 else c + -c % 100
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children, leaves, saved, out = {}, {}, {}, []
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    for path in sorted(members, key=len, reverse=True):
        below, inside = children.get(path, []), members[path]
        leaves[path] = sum(leaves[p] for p in below) or 1
        saved[path] = sum(saved[p] for p in below) + (len(inside) - 1) * (len(path[-1][1]) if path else 0)
        ends = ",".join(str(c) for c in sorted(inside) if len(paths[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(inside), len(path), parent, len(inside), len(below), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(turns, graft, shards=None):
    steps = conversations(turns)
    return sorted((tuple(r) for r in prefix_trie(as_paths(regrafted(steps) if graft else steps), shards).collect()), key=str)


@pytest.mark.parametrize("shards", [None, 1, 60])
def test_trie(spark, shards):
    """Null and tied turns, null roles and texts, turnless and negative conversations, clashing columns."""
    random.seed(1)
    rows = [(None, 0, "a", "b"), (4_000, None, None, None)]
    for c in range(-250, 300):
        for k in range(random.choice([0, 0, 1, 2, 3, 7, 12])):
            rows.append((c, random.choice([None, k, k, 1]), random.choice(["a", "b", None, "ab"]), random.choice(["x", "é", "", "bx", None])))
    turns = spark.createDataFrame(rows, TURNS).repartition(4).withColumns({"path": F.lit(1), "one": F.lit(2), "Shard": F.lit("s")})
    for graft in (True, False):
        assert trie_rows(turns, graft, shards) == plain_trie(rows, graft)


def test_trie_of_copies_and_long_conversations(spark):
    rows = [(c, k, "u", f"t{k}") for c in range(700) for k in range(4 if c % 3 else 300 if c % 9 else 2)]
    turns = spark.createDataFrame(rows, TURNS)
    assert trie_rows(turns, False, 16) == plain_trie(rows, False)


def test_trie_of_the_table_and_of_nothing(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = sorted((tuple(r) for r in LLM_QUERIES["op13_prefix_trie"](spark, sf).collect()), key=str)
    assert found == plain_trie([tuple(r) for r in turns.collect()], True)
    assert conversation_trie(turns.limit(0)).collect() == []
