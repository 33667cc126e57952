"""Quality, SimHash, substrings, mixing and packing against brute force, with hostile rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from rowlens.llm import buckets, quality as q, simhash as s, substrings as sub
from rowlens.llm.components import connected_components
from rowlens.llm import mixing
from rowlens.llm.mixing import mix, mix_plan, source_targets, take_mix
from rowlens.llm.packing import pack, padded, padding, solve_patterns
from rowlens.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash long, host string, c0 string, doc int"


def words(text):
    return WORD.findall(text or "")


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghéñ"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, blanks of all kinds, nulls, a very long text."""
    shared, base = passage(1, 60), passage(2, 90)
    texts = [
        base,
        base,
        base + " more",
        None,
        "",
        " \t\n\x0b ",
        "one",
        f"{passage(3, 40)}\n{shared}\n{passage(4, 30)}",
        f"{passage(5, 20)}\n{shared}",
        shared.upper(),
        "a  b \n a\tb c a b c a b c # $ <|endoftext|> |",
        " lead and trail ",
        passage(6, 9_000),
        "\n".join(["same line here"] * 40),
        passage(7, 12),
        passage(7, 12) + " x",
        "café 　 wide space É",
    ]
    out = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", 1, 7, "h", "c", 3) for i, t in enumerate(texts)]
    out += [out[0], (None, base, None, "s1", None, 7, "h", "c", 3), (None, None, None, None, None, None, None, None, None)]
    out += [(100 + i, passage(50 + i, 60), "en", "s0", 1, 7, "h", "c", 3) for i in range(30)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- quality -------------------------------------------------------------------


def stats(text):
    w, text = words(text), text or ""
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(repeated)


def test_quality_counts(docs, rows):
    out = q.quality(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = Counter((r["doc_id"], *(r[n] for n in names), r["base_failed"]) for r in out)
    expected = Counter()
    for row in rows:
        st = stats(row[1])
        expected[(row[0], *st, st[0] < 50 or 100 * st[4] > 50 * st[0])] += 1
    assert got == expected
    assert not [r for r in out if r["base_failed"] and r["kept"]]


def test_boilerplate_lines_reject_depleted_documents_only(spark):
    line = "Buy 12 now " + passage(77, 60)
    rows = [(i, f"  {line.replace('Buy 12', f'BUY {10 + i}')}\n{passage(i, 30)}", "a") for i in range(30)]
    rows += [(100 + i, passage(200 + i, 70) + "\nfooter of the site", "a") for i in range(30)]
    rows += [(200 + i, passage(9, 70), "a") for i in range(60)]  # one text many times is one document
    rows += [(300, f"{line}\n{passage(1, 30)}", "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in q.quality(docs).collect()}
    assert all(not out[i]["kept"] and not out[i]["base_failed"] for i in range(30))
    assert all(out[100 + i]["kept"] and out[100 + i]["n_removed_words"] == 4 for i in range(30))
    assert all(out[200 + i]["kept"] for i in range(60)) and out[300]["kept"]
    kept = q.keep_quality(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}


def test_keep_quality_removes_boilerplate_lines(spark):
    body = [f"{passage(200 + i, 40)}\n\n \x0b\n{passage(300 + i, 30)}é" for i in range(30)]
    rows = [(i, f"\n FOOTER of  the site {i % 10}\n{t}\nfooter of the site 7", "a", -1) for i, t in enumerate(body)]
    rows += [(100, passage(1, 70) + "\nfooter of the site 1", "other", -1), (101, passage(2, 70), "a", -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    kept = q.keep_quality(docs)
    assert kept.schema == docs.schema
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert out == {**{i: ("\n" + t, len(t) + 1) for i, t in enumerate(body)}, **{r[0]: (r[1], -1) for r in rows[30:]}}


def test_keep_quality_leaves_columns_as_they_are(docs):
    kept = q.keep_quality(docs)
    assert kept.schema == docs.schema
    assert {r["text_hash"] for r in kept.collect()} == {7}


# -- SimHash -------------------------------------------------------------------


def print_of(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hashes = [xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, linked):
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def expected_groups(rows, prints):
    distinct = sorted(set(prints))
    comp = components(distinct, lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for row, p in zip(rows, prints):
        if row[0] is not None:
            least[comp[p]].append(row[0])
    return Counter(
        (row[0], p, min(least[comp[p]], default=None)) for row, p in zip(rows, prints)
    )


def test_simhash(docs, rows):
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in s.simhash_groups(docs).collect())
    assert got == expected_groups(rows, [print_of(r[1]) for r in rows])


@pytest.mark.parametrize("block", [3, 1024])
def test_every_pair_of_near_prints_is_found(spark, monkeypatch, block):
    monkeypatch.setattr(s, "BLOCK", block)
    rng = np.random.default_rng(block)
    prints = set(map(int, rng.integers(0, 2**63, 40, dtype=np.uint64)))
    for p in list(prints)[:20]:
        for k in range(6):
            prints.add(p ^ sum(1 << int(b) for b in rng.choice(64, size=k, replace=False)))
    prints |= {1 << b for b in range(64)} | {0}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    found = s.near_prints(spark.createDataFrame(signed, "fp long")).collect()
    # Smallest as signed numbers, as the graph sees them.
    comp = components(sorted(x for x, in signed), lambda a, b: ((a ^ b) % 2**64).bit_count() <= 4)
    sizes = Counter(comp.values())
    assert {r["node"]: r["component"] for r in found} == {k: c for k, c in comp.items() if sizes[c] > 1}


def test_one_of_each_group_stays(docs, rows):
    kept = s.drop_near_copies(docs)
    assert kept.columns == docs.columns
    prints = [print_of(r[1]) for r in rows]
    groups = components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    expected = {}
    for r, p in zip(rows, prints):
        known = expected.get(groups[p])
        if known is None or (r[0] is None, r[0] or 0) < (known[0] is None, known[0] or 0):
            expected[groups[p]] = r
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in expected.values())


def test_rows_that_share_an_id_are_judged_each_by_itself(spark):
    a, b = ("alpha beta gamma delta " * 9, "one two three four five six " * 9)
    schema = "doc_id long, text string, row string, row_verdict int, tags map<string,string>"
    extra = ("x", 1, {"k": "v"})
    cases = [
        ([(1, a), (2, a), (2, b)], [(1, a), (2, b)]),
        ([(7, a), (7, b)], [(7, a), (7, b)]),
        ([(None, a), (None, a), (None, b)], [(None, a), (None, b)]),
        ([(None, a), (3, a), (3, a), (3, None), (None, "")], [(3, a), (3, None)]),
    ]
    for rows, expected in cases:
        docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
        kept = s.drop_near_copies(docs)
        assert kept.columns == docs.columns
        assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted(expected, key=str)


def test_no_words_are_made_to_collide():
    """The Thue-Morse word and its complement have one hash under every polynomial modulo 2**64."""
    import pyarrow as pa

    from rowlens.llm.words import words_of

    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes = words_of(pa.array([word, other, "ab", "ab\0", "abcd", "abcd\0\0\0\0"])).hashes()
    assert len(set(hashes.tolist())) == 6


def test_words_that_used_to_collide_stay(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{word} {rest}"), (2, f"{other} {rest}")], "doc_id long, text string")
    assert [r["n_removed"] for r in sub.substring_dedup(docs).collect()] == [0, 0]
    assert [r["n_dup_lines"] for r in q.quality(docs.select("doc_id", F.lit("h").alias("source"), F.lit(f"{word}\n{other}").alias("text"))).collect()] == [0, 0]


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    out = connected_components(spark.createDataFrame(path + star, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in out} == {**{i: 1 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(200)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_runs_across_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 2, 2, 2, 3, 4, 4, 5, 5, 5, 5]
    for size in (1, 2, 3, 7, 15):
        table = pa.table({"key": keys, "n": list(range(15))})
        whole, parts = [], []
        for batch, starts, before in buckets.sorted_runs(iter(table.to_batches(max_chunksize=size)), 3):
            rows = batch.column("n").to_pylist()
            if before < 0:
                ends = [*starts.tolist()[1:], len(rows)]
                whole += [rows[a:b] for a, b in zip(starts, ends)]
            else:
                parts += [(before + i, n) for i, n in enumerate(rows)]
        assert whole == [[0, 1], [8], [9, 10]]
        assert parts == [*enumerate(range(2, 8)), *enumerate(range(11, 15))]


# -- substrings ----------------------------------------------------------------


def expected_removal(rows):
    key = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for row in rows:
        w = words(row[1])
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, key(row[0])), key(row[0]))
    out = Counter()
    for row in rows:
        w = words(row[1])
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < key(row[0]) for k in range(13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(row[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block, group", [(4 << 20, 200_000), (200, 5)])
def test_substrings(docs, rows, monkeypatch, block, group):
    monkeypatch.setattr(sub, "BLOCK", block)
    monkeypatch.setattr(sub, "GROUP_SUFFIXES", group)
    out = sub.substring_dedup(docs)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect())
    assert got == expected_removal(rows)


def test_groups_cut_in_the_middle_of_a_window():
    import pyarrow as pa

    key = [1] * 20 + [2] * 3
    sub_ = [1] * 4 + [2] * 9 + [3] * 7 + [1, 1, 2]
    doc = [*range(4), *range(9), *range(7), 5, 6, 5]
    table = pa.table({"key": key, "sub": sub_, "doc": doc, "known": [False] * 23})
    expected = {(d, s_) for k, s_, d in zip(key, sub_, doc) if d != min(y for x, z, y in zip(key, sub_, doc) if (x, z) == (k, s_))}
    for size in (1, 2, 5, 23):
        for limit in (1, 3, 4, 6, 15, 100):
            sub_limit, sub.GROUP_SUFFIXES = sub.GROUP_SUFFIXES, limit
            try:
                batches = lambda: iter(table.to_batches(max_chunksize=size))
                near = list(sub._runs(sub.split_groups(batches(), False), sub.later_rows))
                beyond = [b for b in sub.split_groups(batches(), True)]
            finally:
                sub.GROUP_SUFFIXES = sub_limit
            rest = sorted((r for b in beyond for r in b.to_pylist()), key=lambda r: (r["key"], r["sub"], r["doc"]))
            far = list(sub._runs(iter(pa.Table.from_pylist(rest, table.schema).to_batches()), sub.later_rows)) if rest else []
            assert {(r["doc"], r["h"]) for b in [*near, *far] for r in b.to_pylist()} == expected, (size, limit)


def test_the_pipeline_form_changes_text_and_length_only(docs, rows):
    out = sub.keep_unrepeated(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.where("doc_id is not null").collect()}
    assert 1 not in got and 0 in got  # a copy has nothing left
    assert got[8]["text"] == passage(5, 20) and got[8]["n_chars"] == len(passage(5, 20))
    assert got[10]["text"] == rows[10][1] and got[3]["text"] is None


# -- mixing --------------------------------------------------------------------


def test_targets_reshare_what_is_above():
    got = {k: t for k, _, t in source_targets([("a", 10), ("b", 100), ("c", 100), (None, 90)])}
    assert got["a"] == 20 and abs(sum(got.values()) - 450) < 1e-6
    assert got[None] == 180 and got["b"] + got["c"] == pytest.approx(250)
    assert source_targets([]) == []


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))) + f" {i}", f"s{min(i % 9, 4)}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(words(t))) for i, t, _ in rows)
    for source in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 61
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    again = mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def merged_by_hand(items):
    """Queues merged one item after the other; ``items``: (source, place, size). Returns copies by item."""
    sizes = Counter()
    for source, _, size in items:
        sizes[source] += size
    target = {s: t for s, _, t in source_targets(list(sizes.items()))}
    done, stream = Counter(), []
    for epoch in range(2):
        for item in sorted(items):
            done[item[0]] += item[2]
            stream.append((done[item[0]] / target[item[0]], item[1], epoch, item))
    copies, total = Counter(), 0
    for _, _, _, item in sorted(stream):
        total += item[2]
        if total > sum(target.values()) + 1e-6:
            break
        copies[item] += 1
    for source in sizes:
        own = [x for x in items if x[0] == source]
        gap = target[source] - sum(copies[x] * x[2] for x in own)
        step = 1 if gap > 0 else -1
        able = [x for x in own if 0 <= copies[x] + step <= 2 and abs(gap - step * x[2]) < abs(gap)]
        if able:
            copies[min(able, key=lambda x: (abs(gap - step * x[2]), x[1]))] += step
    return copies


def test_mix_equals_queues_merged_by_hand(spark):
    rng = np.random.default_rng(4)
    rows = [(i // 2, " ".join(["w"] * int(rng.integers(1, 90))), "abc"[min(i % 5, 2)]) for i in range(300)]
    rows += [(7_000, "one two three", "b")] * 50
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mix_plan(frame)
    place = F.xxhash64(F.lit(7), "id", "text_hash", "source", "number")
    found = plan.select("source", place.alias("place"), "size", "copies").collect()
    expected = merged_by_hand([(r["source"], r["place"], r["size"]) for r in found])
    assert len(found) == len(rows)
    assert {(r["source"], r["place"], r["size"]): r["copies"] for r in found if r["copies"]} == +expected


def test_equal_rows_are_taken_each_by_itself(spark, monkeypatch):
    text = " ".join(["w"] * 100)
    rows = [(1, text, "c", k % 2) for k in range(580)] + [(10 + k, text + "", "c", 0) for k in range(20)]
    rows += [(1_000 + k, text, "a", 0) for k in range(100)] + [(2_000 + k, text, "b", 0) for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, `mix times` int")
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 64)
    out = mix(frame).collect()
    taken = Counter()
    for r in out:
        assert r["taken"] in (0, 100, 200)
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 50 for r in out)
    kept = take_mix(frame)
    assert kept.columns == frame.columns
    found = Counter(r["source"] for r in kept.collect())
    assert {s: n * 100 for s, n in found.items()} == +taken


def test_mix_of_odd_rows(docs, rows, spark):
    out = mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(words(r[1]))) for r in rows)
    taken = Counter()
    for r in out:
        taken[r["doc_id"]] += r["taken"]
    kept = take_mix(docs)
    assert kept.columns == docs.columns
    counted = Counter()
    for r in kept.collect():
        counted[r["doc_id"]] += len(words(r["text"]))
    assert counted == +taken
    assert mix(empty(spark)).count() == 0 and take_mix(empty(spark)).count() == 0


# -- packing -------------------------------------------------------------------


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    ids = [np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4") for r in rows]
    expected = Counter()
    for row, a in zip(rows, ids):
        for i in range(0, len(a), 1024):
            expected[(row[0], i, len(a[i : i + 1024]), zlib.crc32(a[i : i + 1024].tobytes()), len(a))] += 1
    out = pack(docs, tokenizer_path()).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == expected
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert set(places) == set(range(len(places)))


def test_patterns_hold_every_piece_and_waste_little():
    rng = np.random.default_rng(2)
    counts = Counter(map(int, rng.integers(1, 1025, 5_000)))
    found = solve_patterns(dict(counts))
    held, total, used = Counter(), 0, 0
    for p in found:
        full = sum(a * b for a, b in zip(p.lengths, p.counts))
        assert full <= 1024
        used, total = used + full * p.times, total + int(padded(full)) * p.times
        for length, n in zip(p.lengths, p.counts):
            held[length] += n * p.times
    assert held == counts and total <= 1.02 * used
    assert solve_patterns({}) == [] and solve_patterns({5: 0}) == []


def plain_first_fit(counts):
    """Padding of first-fit decreasing, piece by piece."""
    rooms = []
    for piece in sorted(Counter(counts).elements(), reverse=True):
        at = next((i for i, room in enumerate(rooms) if room >= piece), None)
        if at is None:
            rooms.append(1024 - piece)
        else:
            rooms[at] -= piece
    return sum(int(padded(1024 - room)) - (1024 - room) for room in rooms)


def test_priced_patterns_win_where_first_fit_wastes():
    counts = {516: 600, 264: 600, 260: 600, 248: 1200}
    found = solve_patterns(counts)
    assert sum(p.times for p in found) == 900 and padding(found) == 0
    assert {p.origin for p in found} == {"priced"}
    assert plain_first_fit(counts) > 100_000


def test_rounding_the_program_never_pads_more_than_first_fit():
    rng = np.random.default_rng(4)
    for lengths, most in [(1, 3), (2, 40), (5, 7), (20, 3), (60, 200)] * 4:
        counts = {int(k): int(rng.integers(1, most)) for k in rng.integers(1, 1025, lengths)}
        found, held = solve_patterns(counts), Counter()
        for p in found:
            for length, n in zip(p.lengths, p.counts):
                held[length] += n * p.times
        assert held == Counter(counts) and padding(found) <= plain_first_fit(counts)


def test_a_word_by_word_encoding_equals_that_of_the_whole_text():
    from hypothesis import given, settings, strategies as st

    from rowlens.llm.packing import WordIds

    encoder = WordIds(tokenizer_path())
    blanks = [chr(c) for c in (0x1C, 0x85, 0xA0, 0x200B, 0x3000)]
    alphabet = list("ab'st1,. \n\t\ré中<|>") + blanks + ["<|endoftext|>", "'s ", "  ", " the", " word,", "."]

    @settings(max_examples=500, deadline=None)
    @given(st.lists(st.sampled_from(alphabet), max_size=14).map("".join))
    def same(text):
        assert encoder.encode(text) == encoder.ids(text)

    same()


def test_empty_tables(spark):
    none = empty(spark)
    for frame in (q.quality(none), q.keep_quality(none), s.simhash_groups(none), s.drop_near_copies(none)):
        assert frame.count() == 0
    for frame in (sub.substring_dedup(none), sub.keep_unrepeated(none), pack(none, tokenizer_path())):
        assert frame.count() == 0
