"""Fill-in-the-middle, substring dedup and phrases against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import fill_middle, language_id, phrases, quality_classifier, queries, substring_dedup, token_files, vector_graph
from tests.compare import assert_same, connect

DOCS = "doc_id bigint, text string"


def _fim(doc_id, text, unit=r"[^\n]*\n|[^\n]+", rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(unit, text)
    s = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"


def _odd_texts():
    rnd = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "no end\nof line", "é\n中\n\U0001f600\n", "<P> held", "a<\nS>b\n<", "<\n<\n<", " \t\n x", "x" * 300_000 + "\n" + "y" * 200_000]
    return texts + ["".join(rnd.choice("ab é\n中<>") for _ in range(rnd.randrange(80))) for _ in range(300)]


UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+"}


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_fill_middle_against_plain_python(spark, unit):
    rows = [(None if k % 50 == 9 else k // 2, t) for k, t in enumerate(_odd_texts())]
    made = fill_middle.fill_middle(spark.createDataFrame(rows, DOCS), unit=unit, rate=80, spm=30).drop("text").collect()
    expected = [_fim(*r, unit=UNITS[unit], rate=80, spm=30) for r in rows]
    assert sorted((tuple(r) for r in made), key=str) == sorted(expected, key=str)


def test_fill_middle_restores_and_carries_columns(spark):
    docs = spark.createDataFrame([(k, t, 1.5, "x") for k, t in enumerate(_odd_texts())], f"{DOCS}, `a.b` double, Form string")
    docs = docs.unionByName(docs)
    made = fill_middle.fill_middle(docs)
    assert made.columns == ["doc_id", "text", "a.b", *fill_middle.RESULTS]
    back = made.select("text", fill_middle.restored(made.fim_text, made.form).alias("t"), "`a.b`").collect()
    assert len(back) == docs.count() and all(r.t == (r.text or "") and r[2] == 1.5 for r in back)
    assert fill_middle.fill_middle(docs.limit(0)).collect() == []


def test_wavelet_matrix():
    rnd = np.random.default_rng(3)
    for size in (0, 1, 63, 64, 65, 1000):
        v = rnd.integers(0, 6, size).astype(np.uint8)
        m, at = fill_middle.WaveletMatrix(v, 3), np.arange(size + 1)
        for c in range(6):
            count = np.concatenate([[0], np.cumsum(v == c)])
            assert (m.rank(c, at) == count).all()
        both = np.concatenate([[0], np.cumsum((v == 1) | (v == 4))])
        k = np.arange(both[-1] + 2)
        found = m.place((1, 4), k, np.zeros(len(k), np.int64), np.full(len(k), size))
        assert found.tolist() == [int(np.argmax(both >= x)) if both[-1] >= x else size for x in k]


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _dedup(rows, n):
    """doc_id, n_words, n_removed and the kept text, by looking at all windows."""
    split = [(d, WORDS.findall(t or "")) for d, t in rows]
    least: dict = {}
    for d, w in split:
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if d is not None and (k not in least or d < least[k]):
                least[k] = d
    out = []
    for d, w in split:
        gone = set()
        for s in range(len(w) - n + 1):
            first = least.get(tuple(w[s : s + n]))
            if first is not None and (d is None or first < d):
                gone |= set(range(s, s + n))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def _passages(seed, n_docs):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "中文", "x" * 40]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(3, 30))] for _ in range(8)] + [["a"] * 25]
    rows = []
    for k in range(n_docs):
        words = []
        for _ in range(rnd.randrange(6)):
            words += rnd.choice(passages) if rnd.random() < 0.6 else [rnd.choice(vocabulary) for _ in range(rnd.randrange(12))]
        text = "".join(w + rnd.choice([" ", "\n", "\t ", "  "]) for w in words)
        rows.append((None if k % 17 == 3 else rnd.randrange(n_docs), rnd.choice([text, text.strip(), text, None]) if k % 11 == 0 else text))
    return rows + rows[:10]


@pytest.mark.parametrize(("n", "how"), [(13, {}), (5, {"group_rows": 8}), (5, {"group_rows": 40, "filter_bits": 19}), (2, {"group_rows": 4}), (1, {})])
def test_substring_dedup_against_all_windows(spark, n, how):
    rows = _passages(n, 120)
    made = substring_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS).repartition(5), min_words=n, **how).drop("text").collect()
    expected = _dedup(rows, n)
    assert any(r[2] for r in expected) and any(r[2] < r[1] for r in expected if r[2])
    assert sorted((tuple(r) for r in made), key=str) == sorted(expected, key=str)


def test_substring_dedup_long_text_and_names(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    long = " ".join(f"q{k}" for k in range(400_000))
    rows = [(1, f"{passage} one", 1.0), (2, f"{long} {passage} {long}", 2.0), (3, "clean text of its own", 3.0), (4, f"{passage} one", 4.0)]
    made = substring_dedup.dedup_substrings(spark.createDataFrame(rows, f"{DOCS}, `a.b` double").withColumn("n_words", F.lit("x")), filter_bits=20)
    assert made.columns == ["doc_id", "text", "a.b", *substring_dedup.RESULTS]
    got = {r.doc_id: r for r in made.collect()}
    assert [got[k].n_removed for k in (1, 2, 3, 4)] == [0, 60, 0, 61]
    assert got[2].kept_text == f"{long} {long}" and got[3].kept_text == "clean text of its own" and got[4].kept_text == ""
    empty = substring_dedup.dedup_substrings(spark.createDataFrame([], DOCS))
    assert empty.collect() == []


def test_deep_nodes():
    words = pa.array(["a b c d e", "b c d", "x y z", "a b c"])
    segment, number, new = substring_dedup.deep_nodes(words, 3)
    nodes: dict = {}
    for s, k, node in zip(segment.tolist(), number.tolist(), np.cumsum(new).tolist(), strict=True):
        nodes.setdefault(node, set()).add((s, k))
    assert sorted(map(sorted, nodes.values())) == [[(0, 0), (3, 0)], [(0, 1), (1, 0)], [(0, 2)], [(2, 0)]]


def _phrases(rows, longest, least, top, inside_pct=80):
    f, n = {}, {}
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    around: dict = {}
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                around[lang, w[i : i + size]] = max(a, around.get((lang, w[i : i + size]), 0))
    out: dict = {}
    for (lang, w), a in found.items():
        if 100 * around.get((lang, w), 0) >= inside_pct * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:c]] + f[lang, w[c:]]), c, f[lang, w[:c]], f[lang, w[c:]]) for c in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang in out for k, (s, a, p, l, r) in enumerate(sorted(out[lang])[:top])]


@pytest.mark.parametrize("how", [{}, {"cells": 1 << 16, "spacing": 3}, {"cells": 8, "spacing": 1}, {"spacing": 50, "most": 3}, {"longest": 6, "spacing": 4}])
def test_phrases_against_plain_python(spark, how):
    rnd = random.Random(8)
    vocabulary = ["the", "Of", "a", "é", "Éa", "中", "new", "york", "city", "x-y", "\x0b", "q" * 50]
    rows = []
    for k in range(150):
        words = []
        for _ in range(rnd.randrange(40)):
            words += rnd.choice([["new", "york", "city", "hall"], ["the", "a"], [rnd.choice(vocabulary)], ["."], ["\n"], ["a", "a", "a"]])
        rows.append((rnd.choice(["en", "de", None]), rnd.choice([" ", "\t", "  "]).join(words) if k % 20 else None))
    rows += rows[:20]
    made = phrases.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(4), least=12, top=25, **how)
    expected = _phrases(rows, how.get("longest", 4), 12, 25)
    assert len(expected) > 40
    assert sorted(tuple(r) for r in made.collect()) == sorted(expected)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([(None, None), ("en", ""), ("en", ".,"), ("de", "a b")], "lang string, text string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_chunks_own_every_word_once():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["a", "b", "c.", "d"]) for _ in range(rnd.randrange(200))) for _ in range(30)]
    for longest, spacing, most in ((4, 4, 512), (2, 1, 512), (4, 1000, 5)):
        held, own, text = phrases.chunks(pa.array(texts), longest, spacing, most)
        total = [len(re.findall("[abcd]", t)) for t in texts]
        assert [int(own[text == k].sum()) for k in range(len(texts))] == total
        assert all(o <= len(h.split()) <= o + longest - 1 for h, o in zip(held, own.tolist(), strict=True))


def _clumped(kind):
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((1_000, 32))
    for k in range(330):
        x[3 * k] = x[0] * (1 + k % 7) if kind == "multiples" else x[0] + (1e-3 if kind == "near copies" else 0.1) * rnd.standard_normal(32)
    return x


@pytest.mark.parametrize("kind", ["multiples", "near copies", "clump"])
def test_vectors_beside_a_clump(spark, kind):
    x = _clumped(kind)
    index = vector_graph.VectorIndex(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>"))
    got = index.search(index.rows.filter("id % 50 = 0")).collect()
    u, hits = x / np.linalg.norm(x, axis=1, keepdims=True), {True: [], False: []}
    for i in range(0, 1_000, 50):
        s = np.round(u @ u[i], 12)
        s[i] = -np.inf
        best = np.lexsort((np.arange(1_000), -s))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == i)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(u[v] @ u[i] - c) < 1e-12 for _, v, c in mine)
        hits[i % 3 == 0].append(len({v for _, v, _ in mine} & set(best.tolist())) / 5)
    assert all(np.mean(h) >= 0.9 for h in hits.values())


def test_vectors_of_one_direction(spark):
    rows = [(k, [0.1 * (k + 1), 0.3 * (k + 1), -0.2 * (k + 1)]) for k in range(41)] + [(100, [1e-200, 0.0, 0.0]), (101, [1e200, 0.0, 0.0])]
    index = vector_graph.VectorIndex(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = index.search(index.rows.filter("id in (0, 7)")).collect()
    for q, near in ((0, [1, 2, 3, 4, 5]), (7, [0, 1, 2, 3, 4])):
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == near
    assert index.points.count() == 2
    far = index.search(index.rows.filter("id = 100")).collect()
    assert [(r.vec_id, round(r.score, 9)) for r in sorted(far, key=lambda r: r["rank"])][:2] == [(101, 1.0), (0, round(1 / 14**0.5, 9))]


@pytest.mark.parametrize("ids", [None, 4, 9])
def test_a_language_under_one_id_is_learned(spark, ids):
    rows = [(ids, f"palabra numero{k} sobre la mesa del señor con niños", "es") for k in range(400)]
    rows += [(1000 + k, f"the word number{k} is on the table of the man", "en") for k in range(400)] + [(ids, "même texte répété où là", "fr")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs, docs_per_lang=50)
    assert model.langs == ["en", "es", "fr"]
    asked = spark.createDataFrame([(1, "sobre la mesa"), (2, "on the table"), (3, "texte répété")], DOCS)
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()} == {1: "es", 2: "en", 3: "fr"}


def test_language_scores_against_plain_python(spark):
    counts = {"x": {"abc": 3, "ab": 1, "zz": 2}, "y": {"abd": 4, "bb": 2}}
    model = language_id.LanguageModel(counts)

    def entries(n):
        out = {lang: {} for lang in counts}
        for lang, ws in counts.items():
            for w, c in ws.items():
                for g in [w] if n == 0 else language_id.grams(w, n):
                    out[lang][g] = out[lang].get(g, 0) + c
        return out

    def log_frequency(n, g, lang):
        e = entries(n)
        every = {k for x in e.values() for k in x}
        return np.log((e[lang].get(g, 0) + 0.5) / (sum(e[lang].values()) + 0.5 * max(1, len(every))))

    def word_score(w, lang):
        if any(w in x for x in entries(0).values()):
            return log_frequency(0, w, lang)
        for n in range(min(language_id.MAX_N, len(w) + 2), 0, -1):
            known = {k for x in entries(n).values() for k in x}
            got = [g for g in language_id.grams(w, n) if g in known]
            if got:
                return sum(log_frequency(n, g, lang) for g in got) / len(got) - language_id.BACKOFF * (language_id.MAX_N + 1 - n)
        return -20.0

    for text in ("abc", "abx abc", "bbd zz qqq", "abd abd bb", "ñ"):
        total = {lang: np.mean([word_score(w, lang) for w in text.split()]) for lang in counts}
        best = max(sorted(counts), key=lambda lang: total[lang])
        got = model.predict(text)
        assert got[0] == best and got[1] == pytest.approx(1 / sum(np.exp(total[lang] - total[best]) for lang in counts))


def test_repeated_labels_take_one_place(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(0, 60) if zlib.crc32(str(k).encode()) % 4 != 2], DOCS)
    ids = [r.doc_id for r in docs.collect()]
    labels = spark.createDataFrame([(ids[0], 0)] * 500 + [(i, k % 2) for k, i in enumerate(ids)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda texts, y, seed: seen.append((len(texts), len({t.tobytes() for t in texts}))))
    quality_classifier.train(docs, labels, per_class=100)
    assert seen == [(len(ids), len(ids))]


def test_mixing_stage_keeps_values_that_differ_little(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "one two three", "s", k) for k in range(6)] + [(k, f"w{k} x y z", "s", 0) for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, micros bigint")
    docs = docs.withColumn("at", F.timestamp_micros(F.col("micros"))).withColumn("m", F.create_map(F.lit("k"), F.col("micros")))
    docs = docs.withColumn("p", F.when(F.col("micros") == 1, "v")).withColumn("q", F.when(F.col("micros") == 2, "v"))
    out = pipeline.mix_sources(spark, docs, "").filter("doc_id = 1").collect()
    assert len({r.micros for r in out}) == min(len(out), 6) and all(r.at.microsecond == r.micros and r.m == {"k": r.micros} for r in out)


def test_text_column_named_like_a_result(spark):
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, None)], "i bigint, fim_text string")
    made = {r.i: r for r in fill_middle.fill_middle(docs, "i", "fim_text").collect()}
    assert made[1].n == 2 and made[2].form == "plain" and fill_middle.RESULTS.keys() <= made[1].asDict().keys()
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x a b c d"), (3, None)], "i bigint, kept_text string")
    made = {r.i: r.kept_text for r in substring_dedup.dedup_substrings(docs, "i", "kept_text", min_words=3, filter_bits=20).collect()}
    assert made == {1: "a b c d", 2: "x", 3: ""}


def test_equal_rows_are_dealt_to_files(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    at = str(tmp_path / "tokens")
    docs = spark.createDataFrame([(7, "one text")] * 400 + [(9, "another")], DOCS).repartition(5)
    token_files.write_tokens(docs, at, public_tokenizers.path("word_bpe_49k.json"), files=4)
    got = token_files.token_index(spark, at).orderBy("start").collect()
    assert [r.doc_id for r in got] == [7] * 400 + [9] and len({(r.n_tokens, r.ids_crc32) for r in got[:400]}) == 1
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    sizes = [r["count"] for r in token_files.read_tokens(spark, at).groupBy("file").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 150


@pytest.mark.parametrize("name", ["op11_phrases", "op12_substring_dedup", "op13_fill_middle"])
def test_queries_against_sql(spark, sf_dir, name):
    query, sql = queries.OPERATORS[name]
    assert_same(query(spark, sf_dir), connect(sf_dir), sql)
