"""Quality rules, line dedup, URL rules and mixing on small fixtures and against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from brindle.llm import line_dedup, mixing, quality_rules, queries, url_filter
from tests.compare import assert_same, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words int, h string"


def docs_of(spark, rows):
    """Rows of documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (None, "some words without an id", None, "a"),
    (4, "the cat sat " * 3000, "en", "a"), (5, "one two three four five six seven eight nine ten", "en", "b"), (5, "one two three four five six seven eight nine ten", "en", "b"),
    (6, "Ähnlich \U0001f600 ﻿ wörter", "de", "b"),
]


@pytest.mark.parametrize("name", ["op3_url_filter", "op7_ngram_join"])
def test_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])


def base(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_base_counts(spark):
    rng = random.Random(1)
    some = [(100 + i, "".join(rng.choice(["a ", "b ", "&c\n", "d\n", "É| "]) for _ in range(rng.randrange(60))), "en", "s") for i in range(40)]
    got = quality_rules.apply_rules(docs_of(spark, ODD + some))
    expected = Counter((r[0], *base(r[1])) for r in ODD + some)
    rows = got.collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == expected
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in rows)
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality_rules_find_junk(spark, sf_dir):
    d = sf_dir.replace("0.001", "0.01")
    got = quality_rules.op1_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((0, False), 0) >= 0.9 * (n.get((0, False), 0) + n.get((0, True), 0))
    assert n.get((1, True), 0) >= 0.95 * (n.get((1, False), 0) + n.get((1, True), 0))


def test_quality_rules_empty(spark):
    assert quality_rules.apply_rules(docs_of(spark, ODD).limit(0)).count() == 0


def test_quality_references_over_all_documents(spark):
    """A small language of short documents has its own reference, and an unknown one is judged by the pooled row."""
    rows = [(i, " ".join(f"the of w{i}_{j}" for j in range(100)), "en", "a") for i in range(5)] + [(100 + i, " ".join(f"og en x{i}{j}" for j in range(18)), "da", "a") for i in range(20)]
    assert all(len(r[1]) < 600 for r in rows[5:])
    df = docs_of(spark, rows)
    refs = quality_rules.references(df)
    assert {r["_lang"]: set(r.common) for r in refs.collect() if r["_lang"] != quality_rules.POOLED} == {"en": {"the", "of"}, "da": {"og", "en"}}
    assert all(r.word_distance < 0.01 for r in quality_rules.apply_rules(df, refs=refs).filter("doc_id >= 100").collect())
    other = docs_of(spark, [(1, rows[0][1], "xx", "a"), (2, rows[0][1], None, "a")])
    both = [sorted(tuple(r) for r in quality_rules.apply_rules(other, refs=refs, broadcast_langs=n).collect()) for n in (4096, 1)]
    assert both[0] == both[1] and all(r[-1] is not None for r in both[0])


def runs(n, p):
    return " ".join(f"{p}{i}" for i in range(n))


def test_line_dedup(spark):
    a, b, c = runs(30, "a"), runs(30, "b"), runs(60, "c")
    rows = [
        (1, f"x y\n{a}\n{b}\nend", None, None), (2, f"q\n\n{a}\n \n {b}\t\nz", None, None), (3, f"{a}\nother", None, None), (4, c, None, None), (5, f"t\n{c}\n{c}", None, None),
        (6, None, None, None), (7, "", None, None), (8, "\n".join(["dup line"] * 60), None, None), (8, "\n".join(["dup line"] * 60), None, None), (9, f"{b}\n{a}", None, None),
    ]
    out = line_dedup.dedup_lines(docs_of(spark, rows))
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_words", "h", "removed_lines"}
    got = {r.doc_id: (r.removed_lines, r.text) for r in out.collect()}
    assert got[1] == ([], rows[0][1]) and got[2] == ([2, 4], "q\n\n \nz") and got[3][0] == [] and got[4][0] == [] and got[5] == ([1, 2], "t")
    assert got[6] == ([], None) and got[7] == ([], "") and got[8] == (list(range(1, 60)), "dup line") and got[9][0] == []
    assert out.count() == len(rows)
    assert line_dedup.dedup_lines(docs_of(spark, rows).limit(0)).count() == 0


def test_line_dedup_against_all_places(spark):
    """Every line deleted has an equal earlier line, and no run of 50 words and one place for it is left."""
    rng = random.Random(5)
    pool = [runs(20, f"p{i}_") for i in range(12)]
    rows = []
    for i in range(60):
        lines = [runs(rng.randrange(1, 15), f"u{i}_{j}_") for j in range(rng.randrange(4))]
        at = rng.randrange(len(lines) + 1)
        lines[at:at] = pool[(k := rng.randrange(4) * 3) : k + 3] if rng.random() < 0.7 else []
        rows.append((i, "\n".join(lines), None, None))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    before, kept = set(), Counter()
    for i, text, _, _ in rows:
        lines = text.split("\n")
        for n in out[i].removed_lines:
            assert lines[n] in before
        before.update(lines)
        left = [x for n, x in enumerate(lines) if n not in out[i].removed_lines]
        kept.update(tuple(left[j : j + 3]) for j in range(len(left) - 2) if sum(len(x.split()) for x in left[j : j + 3]) >= 50)
    assert all(v == 1 for v in kept.values())


def brute_repeats(rows, least=50):
    """Lines in runs of ``least`` words that stand at an earlier place, by comparing all pairs of places."""
    docs = {i: [(n, x.strip(), len(WORD.findall(x))) for n, x in enumerate(text.split("\n")) if WORD.search(x)] for i, text, _, _ in rows}
    places, gone = [(i, k) for i in sorted(docs) for k in range(len(docs[i]))], {i: set() for i in docs}
    for at, (i, k) in enumerate(places):
        for j, m in places[:at]:
            n = 0
            while k + n < len(docs[i]) and m + n < len(docs[j]) and docs[i][k + n][1] == docs[j][m + n][1]:
                n += 1
            if sum(x[2] for x in docs[i][k : k + n]) >= least:
                gone[i] |= {x[0] for x in docs[i][k : k + n]}
    return {i: sorted(x) for i, x in gone.items()}


def test_line_dedup_common_line_in_passage(spark):
    """A line of the passage also stands earlier elsewhere, or once more before it in the document."""
    lines = [runs(20, f"p{i}_") for i in range(4)]
    passage = "\n".join(lines)
    rows = [(k, f"{x}\nonly {k}", None, None) for k, x in enumerate(lines)] + [(10, f"b\n{passage}\nbb", None, None), (11, f"c\n{passage}\ncc", None, None)]
    rows += [(20 + k, f"{x}\nd{k}\n{passage}\ndd{k}", None, None) for k, x in enumerate(lines)]
    long = runs(60, "long")
    rows += [(30, f"{long}\ne", None, None), (31, f"f\n{long}\nshort one", None, None), (32, f"g\n{long}\nshort one\nh", None, None)]
    got = {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got[10] == [] and got[11] == [1, 2, 3, 4] and got[20] == [2, 3, 4, 5] and got[31] == [1] and got[32] == [1, 2]
    assert got == brute_repeats(rows)


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(8)
    pool = [runs(n, f"p{i}_") for i, n in enumerate([1, 3, 9, 20, 30, 49, 50, 60])]
    rows = [(i, "\n".join(pool[j % 8] for s in [rng.randrange(8) for _ in range(rng.randrange(1, 5))] for j in range(s, s + rng.randrange(1, 7))), None, None) for i in range(40)]
    assert {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()} == brute_repeats(rows)


def verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(3)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("com", "", "allow"), ("a.b.com", "/x", "block"), ("a.b.com", "/x", "allow"), ("b.com", "/x/y", "allow"), ("", "/", "block"), ("net", "/", "block")]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/77?q", "x://a.b.com/x/y/z", "x://b.com", "http://net/", "http://my-net/", "http://.net/", "http://com./en/", "ftp://user@a.b.com:80/x", "http://é.com/en/ü", "a://b://c.com/en/"]
    urls += [f"http://{rng.choice(['a.b.', 'b.', '', 'www.example.'])}{rng.choice(['com', 'net', 'org'])}{rng.choice(['/en/', '/x/y', '/en/7', ''])}{rng.choice(['', '1', '?a=/en/', '#x'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i % 150, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = Counter(tuple(r) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules)).collect())
    assert got == Counter((i % 150, *verdict(u, rules)) for i, u in enumerate(urls))
    again = Counter(tuple(r) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules), max_splitters=2, rows_per_group=10).collect())
    assert again == got
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, [])).collect()} == {"allow"}


def fill(sizes, share, cap, weights):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= cap * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        target |= {s: cap * sizes[s] for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    return target


def test_mixing(spark):
    rng = random.Random(2)
    rows = ODD + [(10 + i, runs(rng.randrange(1, 40), "w"), "en", rng.choice(["a", "b", "c", "d", None, "é"])) for i in range(600)] + [(9999, "same same same", None, "c")] * 40
    df = docs_of(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes, longest = Counter(), Counter()
    for _, text, _, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        longest[source] = max(longest[source], n)
    target = fill({s: n for s, n in sizes.items()}, 1.5, 2.0, mixing.WEIGHTS)
    key = {(r.source_size, round(r.target, 6)) for r in got}
    assert key == {(sizes[s], round(target[s], 6)) for s in sizes}
    taken = Counter()
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[(r.source_size, round(r.target, 6))] += r.taken
    for s in sizes:
        assert abs(taken[(sizes[s], round(target[s], 6))] - target[s]) <= longest[s] + 1e-6
    again = sorted((str(r.doc_id), r.text_key, r.taken) for r in mixing.mix(df.repartition(5)).collect())
    assert again == sorted((str(r.doc_id), r.text_key, r.taken) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_rounding_keeps_expectations(spark):
    """Over many seeds a document is taken about as often as its fraction says."""
    items = spark.createDataFrame([(0, i, 0.3, float(1 + i % 3), i) for i in range(30)], "part int, key bigint, x double, w double, p int").cache()
    hits = Counter()
    for seed in range(12):
        for r in mixing.pivotal_rounding(items, {0: 30}, seed=seed, group=8).collect():
            hits[r.p] += r.x
    assert 0.2 < sum(hits.values()) / (12 * 30) < 0.4


def test_url_rules_of_the_contract(spark):
    """Each rule's own verdict, on URLs that only it decides."""
    urls = ["http://a.com/en/1", "http://www.example.com/en/77", "http://a.net/de/1", "http://example.net/de/80", "http://x.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark)).collect()}
    assert [got[i] for i in range(5)] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
