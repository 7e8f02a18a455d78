"""The pipeline stage by stage, each against plain Python on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from brindle.llm import mixing
from brindle.llm.common import Scratch
from tests.llm.test_models import brute_components
from tests.llm.test_native import WORD

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, columns = spark.read.parquet(f"{D}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    scratch, seen = Scratch(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.write(stage(spark, docs, D), name)
        before, after = docs.collect(), out.collect()
        seen[name] = len(after)
        if name != "packing":
            assert out.columns == columns
        if name == "quality_classifier":
            bad = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").filter("quality = 0").collect()}
            left = {r.doc_id for r in after}
            assert len(left & bad) <= 0.3 * len(bad) and len(left) >= 0.8 * (len(before) - len(bad))
        if name == "line_dedup":
            lines = lambda rows: {x.strip() for r in rows for x in r.text.split("\n") if x.strip()}
            assert lines(before) == lines(after)  # every line still stands somewhere
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "ngram_join":
            roots = {c for (_, n, c) in brute_components([(r.doc_id, r.text) for r in before]) if n}
            assert {r.doc_id for r in after if WORD.search(r.text)} == roots
        if name == "mixing":
            total = sum(len(WORD.findall(r.text)) for r in before)
            assert 0.9 * 1.5 * total <= sum(len(WORD.findall(r.text)) for r in after) <= 1.1 * 1.5 * total
            assert max(Counter(r.doc_id for r in after).values()) <= 2
        if name == "packing":
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
        docs = out
    assert corpus_pipeline.run(spark, D).count() == seen["packing"]


def test_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (2, "", None, "a", None), (None, "no id here", "en", "a", 1), (3, "one two three", "en", "a", 1), (3, "one two three", "en", "a", 1), (4, "One two three", "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.dedup_lines(spark, docs, D).count() == 6
    assert Counter(r.doc_id for r in corpus_pipeline.join_ngrams(spark, docs, D).collect()) == Counter([1, 2, None, 3, 3])
    mixed = corpus_pipeline.mix_sources(spark, docs, D).collect()
    assert Counter((r.doc_id, r.text) for r in mixed) == Counter(
        {(r.doc_id, r.text): n for r in [docs.filter("doc_id = 3").first()] for n in [sum(x.copies for x in mixing.mix(docs).filter("doc_id = 3").collect())] if n}
    ) + Counter((r.doc_id, r.text) for r in mixed if r.doc_id != 3)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0


def test_join_decides_by_id_and_text(spark):
    """One document of each group stays: ids with two texts, members of such an id's group, null ids, two groups of one id."""
    a, b, c, d = (" ".join(f"{p}{i}" for i in range(40)) for p in "abcd")
    rows = [(1, a), (5, a), (5, b), (6, b + " more"), (None, a), (None, c), (8, c + " more"), (None, d), (None, d + " more"), (9, "own " + d[:20]), (1, " ".join(reversed(a.split())))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.join_ngrams(spark, docs, D).collect())
    of_d = [k for k in got if k[0] is None]
    assert len(of_d) == 1 and of_d[0][1] in (d, d + " more")
    assert got == Counter([rows[0], rows[2], rows[6], rows[9], rows[10], of_d[0]])
