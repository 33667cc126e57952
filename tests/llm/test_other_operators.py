"""Chat, toxicity, embeddings, licences and languages, and the registered queries with the pipeline."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from rowlens.llm import chat, embedding_dedup as e, language, licenses, toxicity
from rowlens.llm.words import mixed
from rowlens.llm.queries import HOSTILE_TEXT, LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"


# -- chat ----------------------------------------------------------------------


@given(st.lists(st.sampled_from(["<", "|", "\\", "\n", "n", "<|im_end|>", "a"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_escapes_can_be_undone(text):
    import pyarrow as pa

    column = pa.array([text])
    escaped, role = chat.escape(column)[0].as_py(), chat.escape_role(column)[0].as_py()
    assert "<|" not in escaped and "<|" not in role and "\n" not in role
    assert chat.unescape(escaped) == text and chat.unescape_role(role) == text


def expected_chat(rows):
    by_id = defaultdict(list)
    for conv_id, turn, role, text in rows:
        by_id[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv_id, turns in by_id.items():
        turns.sort()
        everything = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (everything, loss)]
        out[conv_id] = (len(turns), sha[0], len(loss), sha[1])
    return out


def test_chat(spark):
    rows = [(i, t, r, f"text {i} {t} é") for i in range(30) for t, r in enumerate(["system", "user", "assistant"])]
    rows += [(99, t, "assistant" if t % 2 else "user", "y" * (t % 50)) for t in range(3_000)]
    rows += [(-1, 0, "user", HOSTILE_TEXT), (-1, 1, "assistant", HOSTILE_TEXT), (-2, None, None, None), (-2, 1, "assistant", "")]
    rows += [(-3, 0, "a\nb\\n<|", "x"), (-3, 0, "a\nb\\n<|", "x"), (None, 0, "assistant", "z" * 2_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    formatted = chat.format_conversations(df.repartition(5))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(formatted).collect()}
    assert got == expected_chat(rows)
    text = "".join(r["formatted"] for r in formatted.where("conv_id = -1").orderBy("part").collect())
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 2
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# -- toxicity and language -----------------------------------------------------


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(4)
    good, bad = [f"word{i}" for i in range(300)], ["scum", "loser", "idiot"]
    rows, labels = [], []
    for i in range(1_500):
        w = list(rng.choice(good, 60))
        toxic = i % 6 == 0
        if toxic:
            w[int(rng.integers(60))] = str(rng.choice(bad)) + "!"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(5_000, None), (5_001, ""), (None, "scum"), (5_002, "scum " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels += [(1, 1, None), (None, 1, 1)]
    out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows)
    assert all(r["held_out"] == (r["doc_id"] is None or fold(r["doc_id"])) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    known = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 1_500 and r["held_out"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 6 == 0) for r in known]) > 0.95
    assert {r["doc_id"]: r["predicted"] for r in out}[5_002] == 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.5}


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} x y z") for i in range(200)], "doc_id long, text string")
    a = [(i, 1, i % 2) for i in range(200)]
    b = [(i, 1, 1 - i % 2 if fold(i) else i % 2) for i in range(200)]
    frames = [spark.createDataFrame(x, "doc_id long, quality int, toxic int") for x in (a, b)]
    x, y = [Counter(map(tuple, toxicity.toxicity(docs, f).collect())) for f in frames]
    assert x == y


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9_001, None, None), (9_002, "123 ... \n", "en"), (9_003, "", None), (None, "the on", None)]
    extra = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang").unionByName(extra)
    out = {r["doc_id"]: r for r in language.identify(rows).collect()}
    real = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in real if fold(i)]
    assert np.mean([out[i]["lang_pred"] == real[i] for i in held]) > 0.9
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (9_001, 9_002, 9_003))
    assert {r["lang_pred"] for r in out.values()} <= {*real.values(), "und"}
    none = language.identify(rows.limit(0))
    assert none.count() == 0
    unlabelled = rows.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_no_language_is_lost(spark, monkeypatch):
    """Rare languages, languages beyond the layer's width, a hot repeated row, and a text too long to learn from."""
    monkeypatch.setattr(language, "FIT_BYTES", 40_000)
    monkeypatch.setattr(language, "FIT_LONGEST", 20_000)
    ids = iter(i for i in range(1, 100_000) if not fold(i))
    word = {f"l{k:02d}": [f"{chr(97 + k)}{chr(97 + j)}{chr(97 + (j * k) % 26)}" for j in range(12)] for k in range(20)}
    text = {k: " ".join(v * 8) for k, v in word.items()}
    rows = [(next(ids), text["l00"] + f" {i}", "l00") for i in range(300)]
    rows += [(next(ids), text[k], k) for k in word for _ in range(6)]
    hot = next(ids)
    rows += [(hot, text["l01"], "l01")] * 3_000 + [(next(ids), text["l02"] * 500, "l02")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    sample = Counter(r["lang"] for r in language.training_rows(docs).collect())
    assert set(sample) == set(word) and min(sample.values()) >= 5 and sample["l01"] <= 7
    model = language.train(docs)
    assert model.languages == sorted(word) and model.table.shape == (language.BUCKETS, language.DIM)
    out = language.predict(docs, model).collect()
    assert len(out) == len(rows)
    assert len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] == hot}) == 1


def plain_subwords(text):
    """Hashed byte n-grams one by one, as a multiset."""
    found = Counter()
    for word in re.split(rb"[\x09-\x0d\x20-@\[-`{-~]+", text.lower().encode()):
        marked = b"<" + word + b">"
        for n in language.SIZES if word else ():
            for i in range(len(marked) - n + 1):
                code = 0
                for byte in marked[i : i + n]:
                    code = (code * 257 + byte) % (1 << 64)
                found[int(mixed(np.array([code], np.uint64))[0] >> np.uint64(48))] += 1
    return found


def test_subwords_and_scores_one_by_one():
    texts = ["The cat, sat!", "", "élan vital", "x", "a-b c_d 12 e", "  ", "the the sat CAT the"]
    buckets, bounds = language.subwords(pa.array(texts))
    assert [Counter(buckets[a:b].tolist()) for a, b in zip(bounds, bounds[1:])] == [plain_subwords(t) for t in texts]
    rng = np.random.default_rng(1)
    model = language.Model(list("abc"), rng.normal(size=(language.BUCKETS, 5)), rng.normal(size=(5, 3)), rng.normal(size=3), 0.7, 0.0)
    assert np.allclose(model.of_texts(pa.array(texts)), model.probabilities(buckets, bounds))
    for text, got in zip(texts, model.of_texts(pa.array(texts))):
        counts = plain_subwords(text)
        mean = sum((model.table[b] * n for b, n in counts.items()), np.zeros(5)) / max(sum(counts.values()), 1)
        e = np.exp((mean @ model.layer + model.bias) / 0.7)
        assert np.allclose(got, e / e.sum())


# -- embeddings ----------------------------------------------------------------


def expected_links(vectors):
    rows = {i: np.array(v, float) for i, v in vectors}
    unit = {i: v / np.linalg.norm(v) for i, v in rows.items()}
    links = {i: {j for j in unit if j != i and len(unit[j]) == len(unit[i]) and unit[i] @ unit[j] >= e.THRESHOLD} for i in unit}
    out = {}
    for i in unit:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


@pytest.mark.parametrize("block", [7, 1024])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(e, "BLOCK", block)
    rng = np.random.default_rng(8)
    vectors = []
    for c in range(12):
        centre = rng.normal(size=16)
        vectors += [centre + rng.normal(scale=0.12, size=16) for _ in range(15)]
    vectors += [vectors[0]] * 20 + [vectors[5] * 3]
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)] + [(900, [1.0, 0.0]), (901, [1e-30, 0.0])]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] + [1.0] * 15), (1005, [float("inf")] * 16)]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash"))
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in e.embedding_groups(df.repartition(4)).collect()}
    expected = expected_links(vectors) | {i: (0, i, True) for i, _ in odd}
    wrong = {i for i in expected if out[i] != expected[i]}
    assert len(wrong) <= 0.02 * len(expected)
    assert all(out[i][0] <= expected[i][0] for i in expected)
    assert e.embedding_groups(df.limit(0)).count() == 0


# -- licences ------------------------------------------------------------------


def dice(a, b):
    a, b = set(licenses.template_grams(a)), set(licenses.template_grams(b))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0


def test_licenses(spark):
    t = licenses.TEMPLATES
    texts = [None, "", "word", "\n\n", t["MIT-grant"], "x " * 30_000 + "\n" + t["Apache-2.0"], t["GPL-3.0"].upper() + "\nAll Rights  reserved"]
    texts += [t["BSD-3-Clause"].replace("binary", "binaries"), "Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC 4.0", "all\nrights\nreserved"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("units", F.lit("clash"))
    plan = licenses.scan_licenses(df)
    assert not any(x in plan._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow", "Exchange"))
    for r in plan.collect():
        text = texts[r["doc_id"]] or ""
        units = {*text.split("\n"), text}
        hits = [(dice(u, t[n]), n) for u in units for n in t if dice(u, t[n]) >= licenses.MIN_DICE]
        assert r["licenses"] == sorted({n for _, n in hits}) and r["n_matches"] == len(hits)
        best = min(((-d, n) for d, n in hits), default=None)
        assert (r["best_license"], r["best_dice"]) == ((best[1], pytest.approx(-best[0])) if best else (None, None))
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_a_licence_exactly_at_the_threshold(spark):
    df = spark.createDataFrame([(0, "A.\nAll rights reserved.")], "doc_id long, text string")
    (r,) = licenses.scan_licenses(df).collect()
    assert (r["licenses"], r["n_matches"], r["best_dice"]) == (["Proprietary"], 2, 1.0)


def test_licenses_in_passages(spark):
    t, prose = licenses.TEMPLATES, " ".join(f"word{i} of the page" for i in range(40))
    wrap = lambda text, mark="": "\n".join(mark + line for line in textwrap.wrap(text, 30))
    expected = {
        # wrapped, embedded, inline
        f"{prose}\n{wrap(t['GPL-3.0-notice'], ' * ')}\n{prose}": {"GPL-3.0-notice"},
        f"{wrap(t['MIT-grant'], '# ')}\n\n{prose}": {"MIT-grant"},
        "This package is by the team. Released under the MIT License. See the site for more of it.": {"MIT"},
        f"{prose} {t['CC-BY-4.0']} {prose}\n{prose} {t['MPL-2.0']} {prose}": {"CC-BY-4.0", "MPL-2.0"},
        # a passage is found after a part of it, and after a copy of it
        f"{wrap(t['MIT-grant'][:250])} {prose[:200]} {wrap(t['MIT-grant'])} {prose} {wrap(t['MIT-grant'])}": {"MIT-grant"},
        # found by line already: counted there only
        f"{t['MIT']}\n{prose} {t['MIT']} {prose}": {"MIT"},
        # too little of one, and its words far apart
        wrap(t["GPL-3.0-notice"][:100]) + prose: set(),
        f" {prose} ".join(w for w in re.findall(r"\S+ \S+", t["MIT-grant"])): set(),
    }
    # whole files, alone and with other text around them
    for name, text in licenses.TEXTS.items():
        for whole in (f"Copyright (c) 2020 A. Name\n\n{text}", f"{prose}\n{text.upper()}\n{prose}"):
            expected[whole] = {name}
    texts = list(expected)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = licenses.scan_licenses(df)
    assert not any(x in plan._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow", "Exchange"))
    for r in plan.collect():
        want, got = expected[texts[r["doc_id"]]], set(r["licenses"])
        # a whole text holds the notices that stand in it as well
        assert want <= got if any(n in licenses.TEXTS for n in want) else want == got, (r["doc_id"], got)
        assert r["n_matches"] == len(r["licenses"]) and (r["best_dice"] or 0) >= (0.8 if want else 0)
    short = {"a": "one two three four five six", "b": "two three nine"}
    rng, rows = random.Random(4), []
    for i in range(300):
        rows.append((i, " ".join(rng.choice("one two three four five six nine x".split()) for _ in range(rng.randint(0, 25)))))
    out = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), short, 0.6, texts={})
    found = 0
    for r in out.collect():
        w, best = rows[r["doc_id"]][1].split(), {}
        for n, text in short.items():
            longest = int((2 - 0.6) / 0.6 * (len(text.split()) - 1) + 1e-9)
            runs = [w[a:b] for a in range(len(w)) for b in range(a + 2, min(len(w), a + longest + 1) + 1)]
            best[n] = max((dice(" ".join(x), text) for x in [*runs, w]), default=0)
        assert r["licenses"] == sorted(n for n, d in best.items() if d >= 0.6)
        found += len(r["licenses"])
    assert found > 20


# -- registered ----------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cur = con.execute(LLM_ORACLES[name])
    names = [d[0] for d in cur.description]
    df = LLM_QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(map(repr, (tuple(r) for r in df.select(*names).collect()))) == Counter(map(repr, map(tuple, cur.fetchall())))


def test_there_is_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline(spark):
    from rowlens.llm.common import staged
    from rowlens.llm.mixing import mix
    from rowlens.llm.packing import pack
    from rowlens.llm.quality import quality
    from rowlens.llm.queries import tokenizer_path
    from rowlens.llm.simhash import simhash_groups
    from rowlens.llm.substrings import substring_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_copies", "repeated_passages", "source_mix", "packing"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    good = staged(stages["quality_rules"](spark, docs, SF))
    assert good.columns == docs.columns and ids(good) == ids(quality(docs).where("kept"))
    single = staged(stages["near_copies"](spark, good, SF))
    assert single.columns == docs.columns and ids(single) == ids(simhash_groups(good).where("doc_id = component_id"))
    clean = staged(stages["repeated_passages"](spark, single, SF))
    left = {r["doc_id"]: r for r in substring_dedup(single).collect()}
    assert ids(clean) == {i for i, r in left.items() if r["n_removed"] < r["n_words"]}
    mixed = staged(stages["source_mix"](spark, clean, SF))
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix(clean).collect() if r["taken"]}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(taken)
    packed = stages["packing"](spark, mixed, SF)
    assert Counter(map(tuple, packed.collect())) == Counter(map(tuple, pack(mixed, tokenizer_path()).collect()))
    assert packed.count() == corpus_pipeline.run(spark, SF).count()


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_on_empty_documents(spark, stage):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, none, SF).count() == 0
