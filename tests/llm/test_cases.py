"""Odd ids, letters, names and lengths; plain-Python versions of rules, network and bounds; the token files' metadata."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import common, language_id, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, token_files, url_filter, vector_graph
from tests.llm.test_models import brute_components
from tests.llm.test_native import ODD, WORD, base, docs_of, fill, runs, verdict

D = "/root/testdata/sf0.001"


def test_join_by_weight(spark):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 30), (3, 1)) for i in range(n)], "k int, i int")
    right = common.Scratch(spark, "t").write(spark.createDataFrame([(1, 500, "a"), (2, 30, "b"), (4, 0, "d")], "k int, w bigint, name string"))
    for share in (1, 3, 10_000):
        got = Counter((r.k, r.name) for r in common.join_by_weight(left, right, "k", "w", share).collect())
        assert got == {(1, "a"): 500, (2, "b"): 30}


def test_vectors_negative_ids_and_two_vectors_of_one(spark):
    rows = [(0, [1.0, 0.1]), (0, [0.1, 1.0]), (-3, [1.0, 0.0]), (-2, [0.0, 1.0]), (7, [1.0, 1.0]), (-50, [1.0, 0.0])]
    index = vector_graph.VectorIndex(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = index.search(index.rows.filter("id % 50 = 0")).collect()
    ranked = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"], r.vec_id)):
        ranked[r.query_id].append((r["rank"], r.vec_id))
    assert ranked[-50] == [(1, -3), (2, 0), (3, 7), (4, 0), (5, -2)]
    assert ranked[0] == [(1, -50), (1, -2), (2, -3), (2, 7), (3, -50), (3, 7), (4, -3), (4, -2)]


def test_letters_are_category_l():
    assert all((language_id.LETTERS.fullmatch(c) is not None) == c.isalpha() for c in map(chr, range(0x110000)))


def test_no_letter_is_und(spark):
    model = language_id.LanguageModel({"en": {"the": 3, "of": 2}, "de": {"der": 3}})
    rows = [(1, "² ½ Ⅷ 12 ٣ _", None, None), (2, "²the½", None, None), (3, None, None, None), (4, "the " * 300_000, None, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs_of(spark, rows), model).collect()}
    assert got[1] == got[3] == ("und", 0.0) and got[2][0] == got[4][0] == "en"


def test_language_bound_is_a_parameter(spark):
    rows = [(i, "aa bb" if i % 3 else "cc dd", "x" if i % 3 else "y", None) for i in range(60)]
    assert language_id.train(docs_of(spark, rows)).langs == ["x", "y"]
    assert language_id.train(docs_of(spark, rows), max_langs=1).langs == ["x"]


def test_gradients():
    """Every parameter's gradient against differences of the loss."""
    rng = np.random.default_rng(3)
    q = quality_classifier
    p = {
        "table": rng.normal(0, 0.5, (q.WIDTH, 256, q.FILTERS)), "bias": rng.normal(0, 0.1, q.FILTERS), "w1": rng.normal(0, 0.4, (2 * q.FILTERS, q.HIDDEN)),
        "b1": rng.normal(0, 0.1, q.HIDDEN), "w2": rng.normal(0, 0.5, q.HIDDEN), "b2": rng.normal(0, 0.1, 1),
    }
    chunks, counts = rng.integers(0, 256, (5, q.SPAN)).astype(np.uint8), np.array([2, 1, 2])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.3, 0.9])
    _, grads = q.loss_and_gradients(p, chunks, counts, y, weight)
    for name, g in grads.items():
        places = np.argwhere(np.abs(g) > 1e-4)
        for at in places[rng.permutation(len(places))[:12]]:
            at, step = tuple(at), 1e-5
            before, losses = p[name][at], []
            for to in (before + step, before - step):
                p[name][at] = to
                losses.append(q.loss_and_gradients(p, chunks, counts, y, weight)[0])
            p[name][at] = before
            assert abs((losses[0] - losses[1]) / (2 * step) - g[at]) <= 1e-3 * abs(g[at]) + 1e-6, name


def test_forward_pass():
    """The score of a text byte by byte, in plain Python."""
    q, rng = quality_classifier, np.random.default_rng(4)
    net = q.Net(rng.normal(0, 0.5, (q.WIDTH, 256, q.FILTERS)), rng.normal(0, 0.1, q.FILTERS), rng.normal(0, 0.4, (2 * q.FILTERS, q.HIDDEN)), rng.normal(0, 0.1, q.HIDDEN), rng.normal(0, 0.5, q.HIDDEN), 0.2)
    texts = [b"", b"short", bytes(rng.integers(0, 256, 700).astype(np.uint8))]
    for text, got in zip(texts, net.score(texts), strict=True):
        pooled = []
        for start in range(0, max(1, len(text) - q.OVERLAP), q.STEP):
            chunk = text[start : start + q.SPAN].ljust(q.SPAN, b"\0")
            acts = [[sum(net.table[j][chunk[i + j]][f] for j in range(q.WIDTH)) for i in range(q.SPAN - q.WIDTH + 1)] for f in range(q.FILTERS)]
            pooled.append([max(0.0, max(a) + net.bias[f]) for f, a in enumerate(acts)])
        x = [sum(c) / len(pooled) for c in zip(*pooled, strict=True)] + [max(c) for c in zip(*pooled, strict=True)]
        h = [max(0.0, sum(x[i] * net.w1[i][k] for i in range(len(x))) + net.b1[k]) for k in range(q.HIDDEN)]
        assert abs(1 / (1 + math.exp(-(sum(a * b for a, b in zip(h, net.w2, strict=True)) + net.b2))) - got) < 1e-5


def test_url_hosts_of_many_labels(spark):
    rules = [("com", "/en/", "block"), ("b.example.com", "/en/7", "allow"), ("x.y.z.org", "", "block")]
    urls = [f"http://{'a.' * n}example.com/en/7" for n in (0, 1, 50, 400)] + ["http://" + "b." * 300 + "b.example.com/en/77", "http://q.x.y.z.org/" + "p" * 50_000, "http://y.z.org/", "http://" + "." * 200]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules)).collect()}
    assert got == {i: verdict(u, rules) for i, u in enumerate(urls)}


def test_mixing_many_sources(spark):
    rng = random.Random(7)
    rows = [(i, runs(rng.randrange(0, 9), "w"), "en", rng.choice([f"s{k}" for k in range(300)] + [None] * 100 + ["", "é", "Z"])) for i in range(3000)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    sizes, of = Counter(), {i: (s, len(WORD.findall(t))) for i, t, _, s in rows}
    for s, n in of.values():
        sizes[s] += n
    target, taken = fill(dict(sizes), 1.5, 2.0, mixing.WEIGHTS), Counter()
    for r in got:
        s, n = of[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and abs(r.target - target[s]) < 1e-6 and r.taken in (0, n, 2 * n)
        taken[s] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 9 for s in sizes)


def test_bounds_are_optimal_at_any_length():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        lengths, counts = np.sort(rng.choice(np.arange(1, 9000), n, replace=False)), rng.integers(1, 100, n)
        best = [[math.inf] * (n + 1) for _ in range(k + 1)]
        for b in range(k + 1):
            best[b][0] = 0
            for j in range(1, n + 1):
                if b:
                    best[b][j] = min(best[b - 1][i] + int(lengths[j - 1]) * int(counts[i:j].sum()) for i in range(j))
        bounds = packing.best_bounds(lengths, counts, k)
        assert sum(int(c) * min(b for b in bounds if b >= v) for v, c in zip(lengths, counts, strict=True)) == best[k][n] and len(bounds) <= k


def test_packing_pads_long_documents_to_a_true_length(spark):
    rows = [(i, "w " * n, None, None) for i, n in enumerate([1500, 1501, 2990, 3000, 9000])]
    got = {r.doc_id: r.padded_to for r in packing.pack(docs_of(spark, rows), max_buckets=3).collect()}
    assert got == {0: 1501, 1: 1501, 2: 3000, 3: 3000, 4: 9000}


CLASH = ["_gone", "_gd", "_GT", "_gone_th", "_id", "_copies", "_rows", "_n", "_share", "text_key", "removed_lines", "_removed", "_did", "_th", "th", "cls", "size", "part", "n_words", "score"]


def test_stages_carry_columns_of_any_name(spark):
    long = runs(60, "same")
    rows = [(i, f"{runs(30, f'w{i}_')}\n{long}\n{runs(25, f'v{i}_')}" if i % 3 else long, "en", f"s{i % 2}", 1) for i in range(12)] + [(None, None, None, None, None), (20, "", "en", "s1", 0)]
    docs = spark.createDataFrame([(*r, *[f"{c}:{r[0]}" for c in CLASH]) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[c] == f"{c}:{r.doc_id}" for r in got for c in CLASH)
        assert got or name == "quality_classifier"
    assert corpus_pipeline.pack(spark, docs, D).count() == len(rows)


def test_ngram_join_many_copies(spark):
    """A text that a third of all rows hold, under ids, under none and with small changes."""
    text = runs(80, "hot")
    rows = [(i if i % 5 else None, text) for i in range(200)] + [(1000 + i, text + f" tail{i}") for i in range(60)] + [(2000 + i, runs(20 + i % 9, f"own{i}_")) for i in range(150)] + [(3000 + i, "") for i in range(90)]
    df = docs_of(spark, [(i, t, None, None) for i, t in rows])
    got = ngram_join.NgramJoin(df, block_rows=16).run().collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)


def test_tree_query_finds_all_partners():
    rng = np.random.default_rng(5)
    for n in (1, 2, 40, 700):
        vec = rng.poisson(2, (max(2, n // 10), 64))[rng.integers(0, max(2, n // 10), n)] + (rng.random((n, 64)) < 0.03)
        size, at = vec.sum(1), int(rng.integers(n))
        expected = {i for i in range(n) if i != at and 5 * size[i] >= 4 * size[at] and 5 * size[at] >= 4 * size[i] and 9 * np.minimum(vec[i], vec[at]).sum() >= 4 * (size[i] + size[at])}
        assert set(ngram_join.tree_query(vec, size, at).tolist()) == expected


CLASS_OF = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: c in "0123456789", lambda c: c in "#*$%&|<>", lambda c: ord(c) < 128, lambda c: True]


def brute_rules(rows, common_share=0.005, max_common=16):
    """References, distances and verdicts, text by text: {doc_id: (class distance, word distance, kept)}."""

    def classes(text):
        out = [0] * 6
        for c in "".join(WORD.findall(text or "")):
            out[next(k for k, f in enumerate(CLASS_OF) if f(c))] += 1
        return out

    def distance(p, q):
        return math.sqrt(max(0.0, sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0) for x, y in zip(p, q, strict=True)) / 2))

    shares, counts = defaultdict(list), defaultdict(Counter)
    for _, text, lang, _ in rows:
        c, words = classes(text), WORD.findall(text or "")
        for key in {lang, None} if words else ():
            counts[key].update(words)
            shares[key].append((sum(c), [math.floor(10_000 * x / sum(c) + 0.5) for x in c]))
    refs = {}
    for key, seen in shares.items():
        medians = []
        for k in range(6):
            upto, half = 0, sum(w for w, _ in seen)
            for w, s in sorted((w, s[k]) for w, s in seen) and sorted(((w, s[k]) for w, s in seen), key=lambda x: x[1]):
                upto += w
                if 2 * upto >= half:
                    medians.append(s / 10_000)
                    break
        n = sum(counts[key].values())
        top = sorted((-c / n, w) for w, c in counts[key].items() if c >= common_share * n)[:max_common]
        word_shares = [-s for s, _ in top]
        refs[key] = ([m / sum(medians) for m in medians], [w for _, w in top], [*word_shares, max(0.0, 1 - sum(word_shares))])
    out = {}
    for i, text, lang, _ in rows:
        words, c, ref = WORD.findall(text or ""), classes(text), refs.get(lang, refs.get(None))
        n_words, _, _, _, repeats = base(text)
        of_class = distance([x / sum(c) for x in c], ref[0]) if sum(c) >= 80 else None
        hits = [words.count(w) for w in ref[1]]
        of_words = distance([x / len(words) for x in [*hits, len(words) - sum(hits)]], ref[2]) if len(words) >= 50 else None
        noise = lambda bins, seen: math.sqrt(bins / (8 * max(seen, 1) * math.log(2)))
        far = (of_class is not None and of_class > 0.12 + noise(6, sum(c))) or (of_words is not None and of_words > 0.25 + noise(len(ref[2]), len(words)) / 4)
        out[i] = (of_class, of_words, n_words >= 20 and 100 * repeats <= 30 * n_words and not far)
    return out


def test_quality_rules_against_plain_python(spark):
    rng = random.Random(11)
    langs = {"en": ["the", "of", "and", "to", "Mr."], "de": ["der", "und", "die", "für"], None: ["x1", "#", "||"]}
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "en", "en", "de", "de", None])
        own = langs["de" if rng.random() < 0.1 else lang]
        text = " ".join(rng.choice(own) if rng.random() < 0.5 else "".join(rng.choice("abcdeÄß" if rng.random() < 0.9 else "#$%9Z") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(0, 160)))
        rows.append((i, text, lang, None))
    expected = brute_rules(rows)
    assert {v[2] for v in expected.values()} == {True, False}
    for r in quality_rules.apply_rules(docs_of(spark, rows)).collect():
        c, w, kept = expected[r.doc_id]
        assert (r.class_distance is None) == (c is None) and (c is None or abs(r.class_distance - c) < 1e-6)
        assert (r.word_distance is None) == (w is None) and (w is None or abs(r.word_distance - w) < 1e-6)
        assert r.kept == kept


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_words_against_the_tokenizer(tokenizer_path):
    """Words of letters, marks, signs and numbers in any mixture, alone and remembered, have the tokenizer's own ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, tok = random.Random(2), Tokenizer.from_file(tokenizer_path)
    bits = ["a", "Be", "é", "É", "ß", "ÿ", "İ", "ı", "́", "क़", "ড়", "יִ", "Σ", "ſ", "ﬁ", "ª", "½", "7", ".", ",", "'s", "'", "!", "&", "<|endoftext|>", "­", "漢", "\U0001f600", "×"]
    texts = ["".join(rng.choice([*bits, " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(3000)] + [None, "", "বড়, x", "İ, x", "क़. b", "יִ! z"]
    encoder = token_files.WordEncoder(tokenizer_path, remember=500)
    for _ in range(2):
        ids, size = encoder.encode(pa.array(texts))
        ends = np.cumsum(size)
        for t, a, b in zip(texts, ends - size, ends, strict=True):
            assert ids[a:b].tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_token_files_metadata(spark, tmp_path, tokenizer_path):
    """Integer run-length encoding, row index and Bloom filter of every stripe; readers skip what the metadata rule out."""
    at = str(tmp_path / "tokens")
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.lit("some words of number")] * 3, F.col("id").cast("string")).alias("text"))
    token_files.write_tokens(docs, at, tokenizer_path, files=2)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = sorted((tmp_path / "tokens").glob("part-*.orc"))
    assert len(files) == 2
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows = reader.rows()
        assert reader.getRowIndexStride() == 1000 and reader.getStripes().size() >= 1
        for stripe in reader.getStripes():
            footer = rows.readStripeFooter(stripe)
            assert [c.getKind().toString() for c in footer.getColumnsList()][1:] == ["DIRECT_V2"] * 4
            kinds = Counter(x.getKind().toString() for x in footer.getStreamsList())
            assert kinds["ROW_INDEX"] == 5 and kinds["BLOOM_FILTER_UTF8"] == 1
        rows.close()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = token_files.read_tokens(spark, at).filter("doc_id = 4321")
        assert [r.doc_id for r in one.collect()] == [4321]
        plan = one._jdf.queryExecution().executedPlan()
        plan.executeCollectPublic()
        read = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert read <= 2 * 1000  # a row group a run, not 6,000 rows


def test_rows_of_one_id_are_dealt_to_files(spark, tmp_path, tokenizer_path):
    at = str(tmp_path / "tokens")
    docs = docs_of(spark, [(None if i % 2 else 5, f"text {i}", None, None) for i in range(400)])
    token_files.write_tokens(docs, at, tokenizer_path, files=4)
    got = token_files.token_index(spark, at).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 200 + [5] * 200
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert token_files.read_tokens(spark, at).select("file").distinct().count() == 4


def test_odd_rows_everywhere(spark):
    """Nothing crashes on nulls in any column, and every row comes back once."""
    df = docs_of(spark, ODD)
    assert packing.pack(df).count() == mixing.mix(df).count() == quality_rules.apply_rules(df).count() == ngram_join.NgramJoin(df).run().count() == len(ODD)


def test_letter_runs():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("abé²½Ⅷ７1_ .ßı漢ª①") for _ in range(rng.randrange(25)))
        assert language_id.letter_runs(text) == Counter(language_id.LETTERS.findall(text))


def test_repeated(spark):
    """Each row as often as asked, numbered from 1, also where its copies are dealt to several tasks."""
    rows = common.Scratch(spark, "t").write(spark.createDataFrame([("a", 1), ("b", 7), (None, 25), ("d", 10)], "k string, m bigint"))
    for chunk in (5, 100):
        got = common.repeated(rows, "m", "no", chunk)
        assert got.columns == ["k", "no"]
        assert Counter((r.k, r.no) for r in got.collect()) == Counter((k, i) for k, m in (("a", 1), ("b", 7), (None, 25), ("d", 10)) for i in range(1, m + 1))
    assert common.repeated(rows.limit(0), "m", "no").count() == 0


def test_many_equal_rows_are_mixed_and_packed(spark):
    """A third of all rows share id and text, some with other columns: each kind's rows take its even share."""
    text = "same words here again"
    rows = [(i, f"text {i} " + "w " * (i % 30), "en", f"s{i % 3}", i) for i in range(300)]
    rows += [(1000, text, "en", "s1", 5)] * 101 + [(1000, text, "de", "s1", 6)] * 60 + [(None, "null one two", None, None, None)] * 7
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows) and abs(sum(r.taken for r in mixed) - 1.5 * sum(len(r[1].split()) for r in rows)) <= 60
    assert sorted((r.doc_id is None, r.doc_id or 0, r.copies) for r in mixed) == sorted((r.doc_id is None, r.doc_id or 0, r.copies) for r in mixing.mix(docs.repartition(5)).collect())
    copies = sum(r.copies for r in mixed if r.doc_id == 1000)
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns
    out = [tuple(r) for r in out.collect()]
    assert set(out) <= set(rows) and len(out) == sum(r.copies for r in mixed)
    by_lang = Counter(r[2] for r in out if r[0] == 1000)
    even, more = divmod(copies, 161)
    assert sum(by_lang.values()) == copies and 101 * even <= by_lang["en"] <= 101 * even + min(more, 101) and 60 * even <= by_lang["de"] <= 60 * even + min(more, 60)
    packed = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in packed) == Counter(r[0] for r in rows)
    assert len({(r.bucket, r.batch, r.place) for r in packed}) == len(rows)


def test_hot_fingerprint_is_joined_by_broadcast_and_by_shuffle_alike(spark, monkeypatch):
    """Fingerprints that many documents share and rare ones, by both ways of the join."""
    common_run, rare = ["hot " * 30 + str(i) for i in range(3)], ["rare " * 30 + str(i) for i in range(3)]
    docs = [(i, "\n".join([f"own {i}", *common_run])) for i in range(60)] + [(100, "\n".join(rare)), (101, "\n".join(["x", *rare, "y"]))]
    frame, seen = spark.createDataFrame(docs, "doc_id bigint, text string"), []
    plain = common.join_by_weight
    for share in (1, 20, 10_000):
        monkeypatch.setattr(line_dedup, "join_by_weight", lambda left, right, key, weight, share=share: plain(left, right, key, weight, share))
        seen.append({r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(frame).collect()})
    assert seen[0] == seen[1] == seen[2] == {0: [], 100: [], 101: [1, 2, 3]} | {i: [1, 2, 3] for i in range(1, 60)}
