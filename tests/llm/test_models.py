"""Classifier, language, token files, vector graph, packing and n-gram join against plain Python."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import common, components, language_id, ngram_join, packing, quality_classifier, token_files, vector_graph
from tests.llm.test_native import ODD, WORD, docs_of, runs

D = "/root/testdata/sf0.01"


def crc_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in range(-5, 200)] + [(None,)], "doc_id bigint").withColumn("h", common.held_out())
    assert all(r.h == (r.doc_id is not None and crc_held_out(r.doc_id)) for r in df.collect())


def test_chunks_cover_every_byte():
    for n in (0, 1, 31, 32, 33, 224, 225, 256, 257, 1000):
        text = bytes(i % 251 + 1 for i in range(n))
        chunks, covered = quality_classifier.cut(text), np.zeros(n, bool)
        for s, c in zip(quality_classifier.chunk_starts(n), chunks, strict=True):
            assert bytes(c[: max(0, n - s)]) == text[s : s + quality_classifier.SPAN]
            covered[s : s + quality_classifier.SPAN] = True
        assert covered.all()


def test_classifier_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    got = quality_classifier.train(spark.read.parquet(f"{D}/documents.parquet"), labels)
    out = quality_classifier.score(spark.read.parquet(f"{D}/documents.parquet"), got).join(labels, "doc_id").filter(common.held_out()).collect()
    assert sum((r.score >= 0.7) == r.quality for r in out) >= 0.93 * len(out)


def test_classifier_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (77, 1), (4, None), (4, 9)], "doc_id bigint, quality int")
    df = docs_of(spark, ODD)
    net = quality_classifier.train(df, labels)
    got = quality_classifier.score(df, net).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.keep(df, net, 0.0).count() == len(ODD) and quality_classifier.keep(df, net, 0.0).columns == df.columns
    none = quality_classifier.train(df.limit(0), labels)
    assert {r.score for r in quality_classifier.score(df, none).collect()} == {0.5}
    assert quality_classifier.score(df.limit(0), net).count() == 0


def test_classifier_sample_is_bounded_by_documents(spark, monkeypatch):
    """Copies of a row and labels without a document take no places, and no label is cut away."""
    rows = [(1, "bad one", None, None)] * 50 + [(4, "good four", None, None), (6, "good six", None, None), (6, "good six, again", None, None)]
    labels = spark.createDataFrame([(1, 0), (4, 1), (6, 1)] + [(i, 1) for i in range(100, 200)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda texts, y, seed: seen.append((len(texts), sorted(y.tolist()))))
    for per_class in (1, 2, 3, 10):
        quality_classifier.train(docs_of(spark, rows), labels, per_class=per_class)
    assert seen == [(2, [0, 1]), (3, [0, 1, 1]), (4, [0, 1, 1, 1]), (4, [0, 1, 1, 1])]


def test_language(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    model = language_id.train(docs)
    out = language_id.predict(docs, model).join(docs, "doc_id").filter(common.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    odd = {r.doc_id: r for r in language_id.predict(docs_of(spark, ODD), model).collect()}
    assert (odd[1].lang_pred, odd[2].lang_pred, odd[3].lang_pred) == ("und", "und", "und") and odd[6].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in odd.values())
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs_of(spark, ODD), nothing).collect()} == {"und"}


def test_language_backs_off():
    m = language_id.LanguageModel({"x": {"abcab": 5, "cab": 2}, "y": {"zzyx": 4, "xyz": 3}})
    assert m.predict("abcab")[0] == "x" and m.predict("zzyxy xyzz")[0] == "y" and m.predict("12 .")[0] == "und"
    assert m.predict("bca")[0] == "x"  # unseen, by its n-grams
    assert m.predict("abcab") == m.predict("ABCAB")


def test_token_files(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = [*ODD, (20, "Don't a.b, 'll x<|endoftext|>y <|STARTOFTEXT|> ., ΑΣ É é 1234²Ⅷ\x0b\x0c z", None, None), (21, runs(5000, "longword"), None, None)]
    df = docs_of(spark, rows)
    at = str(tmp_path / "tokens")
    token_files.write_tokens(df, at, path, files=3)
    got = token_files.token_index(spark, at).orderBy("start").collect()
    expected, start = [], 0
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == expected
    assert {r.doc_id for r in token_files.read_tokens(spark, at).filter("doc_id = 20").collect()} == {20}
    empty = str(tmp_path / "none")
    token_files.write_tokens(df.limit(0), empty, path)
    assert token_files.token_index(spark, empty).count() == 0


def test_token_files_letters_that_become_marks(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["MESELESİ. a", "क़. \u0915\u0958. b", "straße, c"]
    at = str(tmp_path / "tokens")
    token_files.write_tokens(docs_of(spark, [(i, x, None, None) for i, x in enumerate(texts)]), at, path, files=2)
    got = {r.doc_id: r.ids for r in token_files.read_tokens(spark, at).collect()}
    assert got == {i: [*tok.encode(x, add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}


def test_token_files_missing_file(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    at = tmp_path / "tokens"
    token_files.write_tokens(docs_of(spark, ODD), str(at), public_tokenizers.path("word_bpe_49k.json"), files=2)
    sorted(at.glob("part-*"))[-1].unlink()
    with pytest.raises(FileNotFoundError):
        token_files.read_tokens(spark, str(at))


def test_vector_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vector_graph.VectorIndex(e, shard_rows=600)
    got = index.search(index.rows.filter("id % 50 = 0"), chunk_rows=16).collect()
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    n, hits, total = np.linalg.norm(x, axis=1), 0, 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i] / n / n[i]
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:5]]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[i])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s[np.flatnonzero(ids == v)[0]] - score) < 1e-12 for _, v, score in mine)
        hits, total = hits + len({v for _, v, _ in mine} & set(best)), total + 5
    assert hits >= 0.95 * total


def test_vector_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (100, [0.0, 0.0]), (150, None), (200, [float("nan"), 1.0]), (250, [1.0, None]), (300, [1.0]), (350, []), (None, [1.0, 1.0]), (1, [0.0, 1.0]), (400, [float("inf"), 1.0])]
    rows += [(1000 + i, [2.0, 0.0]) for i in range(30)] + [(2000 + i, [1.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, score string")
    index = vector_graph.VectorIndex(df)
    got = {}
    for r in sorted(index.search(index.rows.filter("id in (0, 50, 100, 150, 1)")).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {0: [50, 1000, 1001, 1002, 1003], 50: [0, 1000, 1001, 1002, 1003], 1: [0, 50, 1000, 1001, 1002]}
    none = vector_graph.VectorIndex(df.limit(0))
    assert none.search(none.rows).count() == 0
    few = vector_graph.VectorIndex(df.filter("vec_id in (0, 1)"))
    assert {(r.query_id, r["rank"], r.vec_id) for r in few.search(few.rows).collect()} == {(0, 1, 1), (1, 1, 0)}


def test_best_bounds():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(150):
        n, k = int(rng.integers(1, 8)), int(rng.integers(1, 5))
        lengths, counts = np.sort(rng.choice(np.arange(1, 40), n, replace=False)).astype(float), rng.integers(1, 9, n).astype(float)
        cost = lambda bs: sum(c * (min(x for x in bs if x >= v) - v) for v, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        best = min(cost([*x, lengths[-1]]) for r in range(k) for x in itertools.combinations(lengths[:-1], r))
        got = packing.best_bounds(lengths, counts, k)
        assert len(got) <= k and cost(got) == best


def test_packing(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + i, runs(rng.randrange(1, 300), "w"), None, None) for i in range(400)] + [(7, "w " * 5000, None, None)]
    df = docs_of(spark, rows)
    got = packing.pack(df, max_buckets=6, token_budget=1000).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    sizes = Counter((r.bucket, r.batch) for r in got)
    for r in got:
        assert r.n_tokens <= r.padded_to
        assert sizes[(r.bucket, r.batch)] * r.padded_to <= 1000 or sizes[(r.bucket, r.batch)] == 1
    assert len({(r.bucket, r.batch, r.place) for r in got}) == len(got) and len({r.bucket for r in got}) <= 6
    for b in {r.bucket for r in got}:  # all batches but the last of a bucket are full
        pad = next(r.padded_to for r in got if r.bucket == b)
        batches = sorted(k for k in sizes if k[0] == b)
        assert all(sizes[k] == max(1, 1000 // pad) for k in batches[:-1])
    assert packing.pack(df.limit(0)).count() == 0
    assert {r.padded_to for r in packing.pack(df.filter("doc_id in (1, 2, 3)")).collect()} == {1}


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return Counter((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block_rows", [4096, 5])
def test_ngram_join(spark, block_rows):
    rng = random.Random(4)
    rows = [(r[0], r[1]) for r in ODD] + [(30, "Aa B c"), (31, "aA b C"), (32, "aa b c d"), (33, "É A"), (34, "é a")]
    for g in range(6):
        base_words = runs(60 + 20 * g, f"g{g}_").split()
        for k in range(9):  # copies with a few changed words: near, at and below the border, and chains
            w = list(base_words)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
            rows.append((100 + 10 * g + k, " ".join(w)))
    shared = runs(55, "passage")
    rows += [(300 + i, f"{runs(20 + i, f'own{i}_')} {shared} {runs(15, f'tail{i}_')}") for i in range(25)]
    rng.shuffle(rows)
    df = docs_of(spark, [(i, t, None, None) for i, t in rows])
    got = ngram_join.NgramJoin(df, block_rows=block_rows).run().collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert ngram_join.NgramJoin(df.limit(0)).run().count() == 0


def test_ngram_join_null_ids_bridge(spark):
    """Near copies under null ids link, and join two ids that are too far from each other."""
    w = runs(100, "w").split()
    change = lambda *at: " ".join(f"x{i}" if i in at else x for i, x in enumerate(w))
    rows = [(7, change(10)), (None, change(10, 50)), (9, change(10, 50, 90)), (None, change(10, 50, 90, 30)), (20, runs(60, "v")), (None, runs(60, "v") + " more"), (None, runs(40, "u")), (None, runs(40, "u") + " more")]
    expected = brute_components(rows)
    assert expected[(None, 96, 7)] == 2 and expected[(9, 96, 7)] == 1 and expected[(None, 57, 20)] == 1
    got = ngram_join.NgramJoin(docs_of(spark, [(i, t, None, None) for i, t in rows])).run().collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


def test_shingle_sets_are_exact():
    rng = random.Random(9)
    texts = ["", " ", "a", "A b\tC d", "x" * 5000] + [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(200)]
    together = ngram_join.shingle_sets([t.encode() for t in texts])
    codes = {}
    for t, s in zip(texts, together, strict=True):
        assert len(s) == len(shingles(t))
        assert (s == ngram_join.shingle_sets([t.encode()])[0]).all()
        codes.setdefault(frozenset(shingles(t)), set()).add(s.tobytes())
    assert all(len(v) == 1 for v in codes.values()) and len({next(iter(v)) for v in codes.values()}) == len(codes)


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(2)
    for n in (2, 17, 300):
        vec = rng.poisson(2, (max(2, n // 10), 128))[rng.integers(0, max(2, n // 10), n)] + (rng.random((n, 128)) < 0.03)
        size, comp = vec.sum(1), rng.integers(0, 1 + n // 4, n)
        got = {tuple(sorted(p)) for p in ngram_join.tree_pairs(vec, size, comp).tolist()}
        expected = {(i, j) for j in range(n) for i in range(j) if comp[i] != comp[j] and 5 * size[i] >= 4 * size[j] and 5 * size[j] >= 4 * size[i] and 9 * np.minimum(vec[i], vec[j]).sum() >= 4 * (size[i] + size[j])}
        assert got == expected


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(50, 200), rng.randrange(50, 200)) for _ in range(60)]
    got = {r.node: r.comp for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint"), common.Scratch(spark, "t")).collect()}
    root = {}
    for a, b in links:
        ra, rb = root.setdefault(a, {a}), root.setdefault(b, {b})
        if ra is not rb:
            ra |= rb
            for x in rb:
                root[x] = ra
    assert got == {x: min(s) for x, s in root.items() if len(s) > 1}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint"), common.Scratch(spark, "t")).count() == 0


def test_scratch_uses_the_shared_folder(spark):
    assert common.shared_dir(spark) == common.shared_dir(spark)
    s = common.Scratch(spark, "t")
    df = s.write(spark.range(3).select(F.col("id")))
    assert df.count() == 3
    s.drop(df)
