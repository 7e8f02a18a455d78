"""Removal of word sequences that also start in a document with a smaller id, by prefix-partitioned suffix trees.

A suffix is what a document holds from one of its words on; cut after ``min_words`` words it is a window. Suffixes with a
common prefix meet in one subtree, and every internal node at least ``min_words`` deep is a repeat: the suffixes below it
begin alike. Where the smallest id below such a node is smaller than a suffix's own, the suffix's first ``min_words`` words
go. Neighbouring repeats of one document overlap, so their union is the maximal repeat.

The prefix that parts suffixes into groups begins at the window's anchor, the run of ``anchor_words`` words with the
smallest hash inside it (the leftmost of equals): equal windows have equal anchors at the same offset, and the windows of
one anchor are neighbours, so they travel as one segment of text and not as thirteen words each. The prefix's length
varies: an anchor that few windows have is a whole prefix, and many such form a group of about ``group_rows`` segments; an
anchor with more segments than a quarter of that (or than a millionth of all, so fewer than a million) is lengthened to the
whole window. Where even that is so frequent, there is one node below it: no tree is needed, only the smallest id of its
windows, an aggregation that combines before it shuffles, and these few ids go to all tasks. The others form groups again.

Steps. (1) Anchors of all windows, with the smallest and largest id of each, by aggregation; those of one id alone can't
be repeats across documents. (2) A bitmap of ``2 ** filter_bits`` bits of the others' hashes goes to all tasks: texts are
read again, and the segments of anchors whose bit is set are written. A full bitmap lets more segments through and loses
none. (3) Groups are sorted and cut to nodes, in tasks whose memory is bounded by the group. (4) The ranges to remove meet
their documents; those whose bit in a second bitmap isn't set don't move.

Identity of a document is (doc_id, hash of its text). Defined cases: a null text has no words; a null id is larger than
all others and equal to itself, so a document without id loses what any id holds and gives cause for no removal. Windows
inside one document, or of rows with one id, aren't repeats. Repeated rows get one decision. Fewer words than
``min_words``: nothing goes. Words are compared by their bytes inside groups, by two 64-bit hashes where a whole window is the prefix of one node.
Other columns are carried through; those named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.bitmaps import bitmap, is_set
from brindle.llm.common import Scratch, text_hash
from brindle.llm.texts import ODD, WHITE, apart, chained, codes, joined, mixed, picked, slices, spaced

RANGES = "doc_id bigint, th bigint, begin bigint, stop bigint"
SEGMENTS = "anchor bigint, doc_id bigint, th bigint, begin bigint, long boolean, words string"
RESULTS = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType()}


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words with a space behind each, begin and end of every word, and the number of each text's first word."""
    data, at = apart(*joined(texts))
    flat, begin, end, source = spaced(data, ~WHITE[data])
    return flat, begin, end, np.searchsorted(source, at)


def window_runs(code: np.ndarray, first: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: the anchor's hash, the first and the last window's first word, and the text."""
    none = np.zeros(0, np.int64)
    if len(code) < n:
        return none, none, none, none
    gram = chained(code, m)
    # Hash above, position below: the smallest is the leftmost of the smallest hashes.
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width, least, span = n - m + 1, key, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(text[: len(code) - n + 1] == text[n - 1 :])
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return none, none, none, none
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(start) != 1)])
    opens = np.flatnonzero(new)
    closes = np.concatenate([opens[1:], [len(start)]]) - 1
    return gram[anchor[opens]].view(np.int64), start[opens], start[closes], text[start[opens]]


def _anchors(batches: Iterator[pa.RecordBatch], n: int, m: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        flat, begin, end, first = _words(b.column("text"))
        anchor, _, _, text = window_runs(codes(flat, begin, end), first, n, m)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), b.column("doc_id").take(pa.array(text))], names=["anchor", "doc_id"])


def _segments(batches: Iterator[pa.RecordBatch], n: int, m: int, shared: Broadcast, bits: int) -> Iterator[pa.RecordBatch]:
    marked, frequent = shared.value
    for b in slices(batches, "text"):
        flat, begin, end, first = _words(b.column("text"))
        anchor, opens, closes, text = window_runs(codes(flat, begin, end), first, n, m)
        some = is_set(marked, anchor & ((1 << bits) - 1))
        anchor, opens, closes, text = anchor[some], opens[some], closes[some], text[some]
        rows = pa.array(text)
        held = pa.array(picked(flat, begin[opens], end[closes + n - 1]), pa.binary()).view(pa.string())
        long = pa.array(np.isin(anchor, frequent))
        yield pa.RecordBatch.from_arrays([pa.array(anchor), b.column("doc_id").take(rows), b.column("th").take(rows), pa.array(opens - first[text]), long, held], names=["anchor", "doc_id", "th", "begin", "long", "words"])


def deep_nodes(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of the segments, in the order of their first n words: segment, number in the segment, and whether it
    branches off the one before less than n words deep, that is, begins another node."""
    lists = pc.split_pattern(words, " ")
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code, digits = coded.indices.to_numpy().astype(np.uint64), max(1, len(coded.dictionary).bit_length())
    many = np.diff(at) - n + 1
    segment = np.repeat(np.arange(len(many)), many)
    number = np.arange(len(segment)) - np.repeat(np.cumsum(many) - many, many)
    place, levels, per = at[segment] - at[0] + number, [], 64 // digits
    for k in range(0, n, per):  # several words make one level
        level = np.zeros(len(place), np.uint64)
        for j in range(k, min(n, k + per)):
            level = (level << np.uint64(digits)) | code[place + j]
        levels.append(level)
    order = np.lexsort(levels[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in levels])
    return segment[order], number[order], new


def _ranges(table: pa.Table | pa.RecordBatch, segment: np.ndarray, number: np.ndarray, n: int) -> pa.RecordBatch:
    """Ranges of words of the documents: windows that follow each other or overlap, also in neighbouring segments, make one."""
    doc_id, th, begin = (pa.chunked_array(c) if isinstance(c, pa.Array) else c for c in (table.column(x) for x in ("doc_id", "th", "begin")))
    least = np.iinfo(np.int64).min
    own, text = pc.fill_null(doc_id, least).to_numpy()[segment], th.to_numpy()[segment]
    known, start = pc.is_valid(doc_id).to_numpy()[segment], begin.to_numpy()[segment] + number
    order = np.lexsort((start, own, known, text))
    segment, own, text, known, start = (x[order] for x in (segment, own, text, known, start))
    opens = np.ones(len(start), bool)
    opens[1:] = (np.diff(start) > n) | (own[1:] != own[:-1]) | (text[1:] != text[:-1]) | (known[1:] != known[:-1])
    opens = np.flatnonzero(opens)
    closes = np.concatenate([opens[1:], [len(start)]])[: len(opens)] - 1
    rows = pa.array(segment[opens])
    return pa.RecordBatch.from_arrays([doc_id.take(rows).combine_chunks(), th.take(rows).combine_chunks(), pa.array(start[opens]), pa.array(start[closes] + n)], names=["doc_id", "th", "begin", "stop"])


def _subtrees(table: pa.Table, n: int) -> pa.Table:
    """The ranges that the repeats of one group of suffixes remove."""
    table = table.combine_chunks()
    ids, words = (table.column(c).combine_chunks() for c in ("doc_id", "words"))
    segment, number, new = deep_nodes(words, n)
    known = pc.is_valid(ids).to_numpy(zero_copy_only=False)[segment]
    own = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[segment]
    nodes, node = np.flatnonzero(new), np.cumsum(new) - 1
    least, some = np.minimum.reduceat(own, nodes)[node], np.logical_or.reduceat(known, nodes)[node]
    later = np.where(known, own > least, some)
    segment, number = segment[later], number[later]
    return pa.Table.from_batches([_ranges(table, segment, number, n)])


def _split(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of every window of n words in the segments: segment, number in the segment, two hashes, and its words."""
    flat, begin, end, first = _words(batch.column("words"))
    many = np.diff(first) - n + 1
    segment = np.repeat(np.arange(len(many)), many)
    number = np.arange(len(segment)) - np.repeat(np.cumsum(many) - many, many)
    at, code = first[segment] + number, codes(flat, begin, end)
    w1, w2 = chained(code, n)[at], chained(mixed(code + ODD), n)[at]
    return segment, number, w1.view(np.int64), w2.view(np.int64), picked(flat, begin[at], end[at + n - 1])


def _windows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """w1, w2, n, least: the windows of each slice, summed, with their smallest id."""
    for b in slices(batches, "words", 1 << 20):
        segment, _, w1, w2, _ = _split(b, n)
        ids = b.column("doc_id")
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)[segment]
        own = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)[segment]
        order = np.lexsort((w2, w1))
        w1, w2, known, own = w1[order], w2[order], known[order], own[order]
        new = np.flatnonzero(np.append(True, (np.diff(w1) != 0) | (np.diff(w2) != 0))[: len(w1)])
        if len(new):
            some = np.logical_or.reduceat(known, new)
            found = [pa.array(w1[new]), pa.array(w2[new]), pa.array(np.diff(np.append(new, len(w1)))), pa.array(np.minimum.reduceat(own, new), mask=~some)]
            yield pa.RecordBatch.from_arrays(found, names=["w1", "w2", "n", "least"])


def _below(batches: Iterator[pa.RecordBatch], n: int, nodes: Broadcast) -> Iterator[pa.RecordBatch]:
    """The ranges that the nodes with a prefix of a whole window remove, neighbours joined."""
    for b in slices(batches, "words", 1 << 20):
        segment, number, w1, w2, _ = _split(b, n)
        own = b.column("doc_id").to_pylist()
        found = [(s, k) for s, k, w in zip(segment.tolist(), number.tolist(), zip(w1.tolist(), w2.tolist(), strict=True), strict=True) if (x := nodes.value.get(w)) is not None and (own[s] is None or own[s] > x)]
        yield _ranges(b, *(np.array([f[i] for f in found], np.int64) for i in (0, 1)), n)


def _others(batches: Iterator[pa.RecordBatch], n: int, nodes: Broadcast) -> Iterator[pa.RecordBatch]:
    """Windows that aren't such a node, as segments of one window whose prefix is all of it."""
    for b in slices(batches, "words", 1 << 20):
        segment, number, w1, w2, words = _split(b, n)
        some = np.array([w not in nodes.value for w in zip(w1.tolist(), w2.tolist(), strict=True)], bool)
        rows, words = pa.array(segment[some]), [x for x, y in zip(words, some.tolist(), strict=True) if y]
        begin = pa.array(b.column("begin").to_numpy()[segment[some]] + number[some])
        long = pa.array(np.ones(len(words), bool))
        yield pa.RecordBatch.from_arrays([pa.array(w1[some]), b.column("doc_id").take(rows), b.column("th").take(rows), begin, long, pa.array(words, pa.binary()).view(pa.string())], names=["anchor", "doc_id", "th", "begin", "long", "words"])


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, anchor_words: int = 3, group_rows: int = 20_000, filter_bits: int = 27) -> DataFrame:
    """doc_id, th, begin, stop: distinct ranges of words to remove (stop is the first word behind), in a written table."""
    spark, n, m = docs.sparkSession, min_words, min(anchor_words, min_words)
    scratch = Scratch(spark, "substring-dedup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(lambda b: _anchors(b, n, m), "anchor bigint, doc_id bigint").groupBy("anchor")
    found = found.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max(F.isnull("doc_id")).alias("none"))
    found = scratch.write(found.filter("least < most or (none and least is not null)").select("anchor", "n"), "anchors")
    total = found.agg(F.sum("n")).first()[0] or 0
    # Fewer than a million anchors have over a millionth of the segments.
    frequent = found.filter(F.col("n") > max(group_rows // 4, total // 1_000_000)).select("anchor")
    frequent = np.array([r.anchor for r in frequent.collect()], np.int64)
    marked = bitmap(found.select(F.col("anchor").bitwiseAND((1 << filter_bits) - 1).alias("at")), filter_bits)
    shared = spark.sparkContext.broadcast((marked, frequent))
    keyed = texts.withColumn("th", text_hash("text"))
    segments = keyed.mapInArrow(lambda b: _segments(b, n, m, shared, filter_bits), SEGMENTS)
    at = scratch.path("segments")
    segments.write.partitionBy("long").option("compression", "zstd").parquet(at)
    segments = spark.read.schema(SEGMENTS).parquet(at)

    groups = max(1, -(-total // group_rows))

    def subtrees(rows: DataFrame, key: str) -> DataFrame:
        rows = rows.withColumn("group", F.pmod(F.xxhash64(key), F.lit(groups)))
        return rows.groupBy("group").applyInArrow(lambda t: _subtrees(t, n), RANGES)

    ranges = subtrees(segments.filter("not long"), "anchor")
    if len(frequent):
        long = segments.filter("long").drop("long")
        nodes = long.mapInArrow(lambda b: _windows(b, n), "w1 bigint, w2 bigint, n bigint, least bigint").groupBy("w1", "w2")
        nodes = nodes.agg(F.sum("n").alias("n"), F.min("least").alias("least"))
        nodes = nodes.filter(F.col("n") > max(group_rows // 4, total // 1_000_000)).collect()
        nodes = spark.sparkContext.broadcast({(r.w1, r.w2): r.least for r in nodes})
        ranges = ranges.unionByName(long.mapInArrow(lambda b: _below(b, n, nodes), RANGES))
        ranges = ranges.unionByName(subtrees(long.mapInArrow(lambda b: _others(b, n, nodes), SEGMENTS), "anchor"))
    return scratch.write(ranges.distinct(), "ranges")


def _cut(batches: Iterator[pa.RecordBatch], text_col: str, n_kept: int) -> Iterator[pa.RecordBatch]:
    """The texts without their ranges (if there is such a column), beside the kept columns (c0, c1, ...)."""
    for b in slices(batches, text_col):
        flat, begin, end, first = _words(b.column(text_col))
        edge = np.zeros(len(begin) + 1, np.int64)
        if "ranges" in b.schema.names:
            lists = b.column("ranges")
            text = pc.list_parent_indices(lists).to_numpy()
            ranges = lists.flatten()
            for name, by in (("begin", 1), ("stop", -1)):
                np.add.at(edge, first[text] + ranges.field(name).to_numpy(), by)
        gone = np.cumsum(edge)[:-1] > 0
        removed = np.concatenate([[0], np.cumsum(gone)])
        # Bytes of kept words with the space behind each; the last space of a text goes.
        size = end - begin + 1
        kept = flat[np.repeat(~gone, size)] if gone.any() else flat
        upto = np.concatenate([[0], np.cumsum(np.where(gone, 0, size))])[first]
        out = picked(kept, upto[:-1], np.maximum(upto[:-1], upto[1:] - 1))
        made = [pa.array(np.diff(first)), pa.array(np.diff(removed[first])), pa.array(out, pa.binary()).view(pa.string())]
        names = [f"c{k}" for k in range(n_kept)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*names, *RESULTS])


def _sifted(batches: Iterator[pa.RecordBatch], marked: Broadcast, wanted: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose bit (at) is set, or those whose bit isn't."""
    for b in batches:
        yield b.filter(pa.array(is_set(marked.value, b.column("at").to_numpy()) == wanted))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, **how: int) -> DataFrame:
    """docs with n_words, n_removed and kept_text, the words that stay with one space between them."""
    spark = docs.sparkSession
    ranges = repeated_ranges(docs, id_col, text_col, min_words, **how)
    bits = 24
    at = F.xxhash64("doc_id", "th").bitwiseAND((1 << bits) - 1)
    shared = bitmap(ranges.select("doc_id", "th").distinct().select(at.alias("at")), bits)
    blocks = spark.sparkContext.broadcast(shared)

    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    kept = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]
    fields = [T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(keep)]
    # A text that is kept goes through Python once.
    text, extra = (f"c{keep.index(text_col)}", []) if text_col in keep else ("text", [F.col(text_col).alias("text")])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("th"), *extra, *kept).withColumn("at", at)
    schema = T.StructType([*fields, *(T.StructField(k, t) for k, t in RESULTS.items())])
    names = [f"c{k}" for k in range(len(keep))]
    whole = rows.mapInArrow(lambda b: _cut(_sifted(b, blocks, False), text, len(keep)), schema)
    own = ranges.groupBy("doc_id", "th").agg(F.collect_list(F.struct("begin", "stop")).alias("ranges"))
    own = own.select(F.col("doc_id").alias("_d"), F.col("th").alias("_h"), "ranges")
    some = rows.mapInArrow(lambda b: _sifted(b, blocks, True), rows.schema).join(own.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")), "left")
    ranges_of = F.coalesce("ranges", F.array().cast("array<struct<begin:bigint,stop:bigint>>")).alias("ranges")
    some = some.select(*dict.fromkeys([text, *names]), ranges_of).mapInArrow(lambda b: _cut(b, text, len(keep)), schema)
    return whole.unionByName(some).toDF(*keep, *RESULTS)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words of every document and the hash of those that stay."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
u as (select doc_id, w, unnest(range(1, len(w) - 11)) as s from d),
v as (select doc_id, s, array_to_string(w[s:s + 12], ' ') as k from u),
f as (select k, min(doc_id) as least from v group by k),
g as (select distinct doc_id, unnest(range(s, s + 13)) as i from v join f using (k) where v.doc_id > f.least),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
k as (
  select x.doc_id, count(g.i) as n_removed, string_agg(x.word, ' ' order by x.i) filter (g.i is null) as kept
  from x left join g on x.doc_id = g.doc_id and x.i = g.i group by x.doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from d left join k using (doc_id)
"""
