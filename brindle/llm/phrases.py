"""Collocations: phrases of two to four words that occur together more often than their parts would, by prefix-free parsing.

Texts are parsed into chunks that end behind trigger words (one of ``spacing`` by the hash of a word and the one before),
so the same passage gives the same chunks wherever it stands. A chunk owns the words up to its trigger and also holds the
next ``longest - 1`` words of its last piece, so every n-gram lies whole in the chunk that owns its first word and counts
there only: overlaps count once. Distinct chunks with their frequencies are the dictionary, one aggregation; all that
follows reads the dictionary, where n-grams inside a chunk weigh as much as the chunk.

Counting. (1) Words and pairs of words are counted by a hash of 32 bits and more (more bits, and so more groups, the more
words the corpus has), summed in each task, sent as blocks of hashes and capped counts, and added up block by block, in
groups of about a million words. What isn't frequent by hash isn't frequent; of the others a bitmap of ``cells`` bits goes
to all tasks. Then the same for longer n-grams all of whose words and pairs are in it. (2) What is left of all is counted
exactly by its bytes. Bits that many share only let more of them through to the exact count: results don't depend on
``cells``, but with more frequent n-grams than ``cells`` most get to it. (3) Cuts of the candidates meet the counts of their
parts by joins, and the first ``top`` of every language are ranked inside parts before they meet.

Defined cases: a null text has no pieces; a null language is ``und``; a language without candidates has no rows. Repeated
rows count as often as they occur. Chunks without a trigger end after ``most`` words; a word of any length is one word.
Only the text and language columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, shuffle_partitions
from brindle.llm.bitmaps import bitmap, is_set
from brindle.llm.texts import ODD, U64, apart, chained, codes, joined, mixed, picked, slices, spaced

#: Bytes between pieces and bytes between words.
BREAK, GAP = np.zeros(256, bool), np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def chunks(texts: pa.Array, longest: int, spacing: int, most: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The chunks of all texts (words with a space between, pieces with a newline), how many words each owns, and its text."""
    data, at = apart(*joined(texts))
    data = LOWER[data]
    broken = BREAK[data]
    flat, begin, end, source = spaced(data, ~(GAP[data] | broken))
    if not len(begin):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(source, at)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    # Pieces are numbered through, texts part them as well.
    piece = np.cumsum(broken)[source] + text
    ends = np.append(np.diff(piece) != 0, True)
    flat[end[ends]] = 0x0A
    code = codes(flat, begin, end)
    trigger = np.zeros(len(code), bool)
    trigger[1:] = chained(code, 2) % U64(spacing) == 0
    trigger &= np.append(text[1:] == text[:-1], False)
    opens = np.zeros(len(code), bool)
    opens[first[:-1][first[:-1] < first[1:]]] = True
    opens[1:] |= trigger[:-1]
    opens = np.flatnonzero(opens)
    own = np.diff(np.append(opens, len(code)))
    if own.max() > most:
        times = -(-own // most)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        opens, own = np.repeat(opens, times) + nth * most, np.minimum(most, np.repeat(own, times) - nth * most)
    last = opens + own - 1
    stop = np.minimum(last + longest, np.searchsorted(piece, piece[last], side="right"))
    return picked(flat, begin[opens], end[stop - 1]), own, text[opens]


def _parsed(batches: Iterator[pa.RecordBatch], longest: int, spacing: int, most: int) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        held, own, text = chunks(b.column("text"), longest, spacing, most)
        found = [b.column("lang").take(pa.array(text, pa.int64())), pa.array(own, pa.int32()), pa.array(held, pa.binary()).view(pa.string())]
        yield pa.RecordBatch.from_arrays(found, names=["lang", "own", "chunk"])


class Words:
    """The words of a batch of dictionary entries."""

    def __init__(self, batch: pa.RecordBatch):
        data, at = apart(*joined(batch.column("chunk")))
        line = data == 0x0A
        self.flat, self.begin, self.end, source = spaced(data, ~(line | (data == 0x20)))
        first = np.searchsorted(source, at)
        chunk = np.repeat(np.arange(len(at) - 1), np.diff(first))
        self.piece = np.cumsum(line)[source] + chunk
        self.owned = np.arange(len(source)) - first[chunk] < batch.column("own").to_numpy()[chunk]
        self.weight = batch.column("n").to_numpy()[chunk]
        lang = batch.column("lang").dictionary_encode()
        self.langs, self.lang = lang.dictionary, lang.indices.to_numpy()[chunk].astype(np.int64)
        names = [str(x).encode() for x in self.langs.to_pylist()]
        ends = np.cumsum([len(x) for x in names], dtype=np.int64)
        self.lang_code = codes(np.frombuffer(b"".join(names), np.uint8), ends - [len(x) for x in names], ends)
        self.code = codes(self.flat, self.begin, self.end)

    def together(self, k: int) -> np.ndarray:
        """Whether k words from each on are in one piece."""
        out = np.zeros(len(self.piece), bool)
        out[: max(0, len(out) - k + 1)] = self.piece[: max(0, len(out) - k + 1)] == self.piece[k - 1 :]
        return out

    def keys(self, k: int, bits: int) -> np.ndarray:
        """The first bits of a hash of each word and the k - 1 behind it, by language."""
        gram = np.zeros(len(self.code), U64)
        gram[: max(0, len(gram) - k + 1)] = chained(self.code, k)
        return (mixed(gram + self.lang_code[self.lang]) >> U64(64 - bits)).astype(np.int64)

    def left(self, frequent: list[np.ndarray], bits: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each k where the k-grams begin whose words and pairs (and longer parts, if they were counted too) are left."""
        some = np.ones(len(self.code), bool) & _left(frequent[0], self.keys(1, bits))
        yield 1, some
        for k in range(2, longest + 1):
            some = some & np.append(some[1:], False) & self.together(k)
            if k == 2 or len(frequent) > 1:
                some &= _left(frequent[min(1, k - 2)], self.keys(k, bits))
            yield k, some


def _left(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return is_set(bitmap, keys & (8 * len(bitmap) - 1))


def _hashed(batches: Iterator[pa.RecordBatch], bits: int, least: int, longest: int, first: Broadcast | None, together: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """block, keys and counts (capped at least) of words and pairs; given what is left of these, of the n-grams made of them."""
    kind = np.uint8 if least < 256 else np.int64

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(key)
        key, n = key[order], n[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        key, n = key[new], np.minimum(np.add.reduceat(n, new), least).astype(kind)
        at = np.flatnonzero(np.diff(key >> 32, prepend=-1))
        ends = np.append(at[1:], len(key))
        cut = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(key[at] >> 32), cut(key.astype("<u4")), cut(n)], names=["block", "keys", "counts"])

    held, size = [], 0
    for b in slices(batches, "chunk"):
        w = Words(b)
        which = [(1, np.ones(len(w.code), bool)), (2, w.together(2))] if first is None else [x for x in w.left([first.value], bits, longest) if x[0] > 2]
        for k, some in which:
            some = some & w.owned
            held.append((w.keys(k, bits)[some], np.minimum(w.weight[some], least)))
            size += len(held[-1][0])
        if size >= together:
            yield summed(held)
            held, size = [], 0
    if size:
        yield summed(held)


def _frequent(table: pa.Table, least: int, cells: int) -> pa.Table:
    """The bits of a block's hashes that occur often enough."""
    key = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u4")
    n = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8 if least < 256 else np.int64).astype(np.int64)
    order = np.argsort(key)
    key, n = key[order].astype(np.int64), n[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    often = key[new][np.add.reduceat(n, new) >= least]
    block = table.column("block")[0].as_py()
    return pa.table({"at": ((block << 32) | often) & (cells - 1)})


def frequent_grams(dictionary: DataFrame, bits: int, least: int, cells: int, longest: int = 2, first: Broadcast | None = None) -> np.ndarray:
    """A bitmap of ``cells`` bits (a power of two): those of what occurs at least that often by its hash are set."""
    each = dictionary.mapInArrow(lambda b: _hashed(b, bits, least, longest, first), "block bigint, keys binary, counts binary")
    return bitmap(each.groupBy("block").applyInArrow(lambda t: _frequent(t, least, cells), "at bigint"), cells.bit_length() - 1)[: max(1, cells // 8)]


def _counted(batches: Iterator[pa.RecordBatch], frequent: Broadcast, bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    """lang, k, phrase and n: the n-grams that a batch's owned words begin, numbered by their bytes and summed."""
    for b in slices(batches, "chunk"):
        w = Words(b)
        if not len(w.begin):
            continue
        # A word with the space behind it is what lies between two begins, so the bytes needn't be copied.
        bounds = np.append(w.begin, len(w.flat)).astype(np.int64)
        flat = np.where(w.flat == 0x0A, np.uint8(0x20), w.flat)
        word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.begin), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
        n_words, word = len(word.dictionary), word.indices.to_numpy().astype(np.int64)
        gram = w.lang.copy()
        for k, some in w.left(frequent.value, bits, longest):
            at = np.flatnonzero(some)
            # The number of the (k - 1)-gram and the next word: both below 2**31.
            _, first, number = np.unique(gram[at] * n_words + word[at + k - 1], return_index=True, return_inverse=True)
            gram[at] = number
            mine = w.owned[at]
            n = np.zeros(len(first), np.int64)
            np.add.at(n, number[mine], w.weight[at][mine])
            first = at[first][n > 0]
            phrases = pa.array(picked(flat, w.begin[first], w.end[first + k - 1]), pa.binary()).view(pa.string())
            found = [w.langs.take(pa.array(w.lang[first])), pa.array(np.full(len(first), k, np.int32)), phrases, pa.array(n[n > 0])]
            yield pa.RecordBatch.from_arrays(found, names=["lang", "k", "phrase", "n"])


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, longest: int, least: int, cells: int, spacing: int, most: int) -> tuple[DataFrame, DataFrame]:
    """lang, k, phrase, f of what occurs at least so often, up to longest words; lang, n (words) of every language. Both written."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    parsed = texts.mapInArrow(lambda b: _parsed(b, longest, spacing, most), "lang string, own int, chunk string")
    dictionary = scratch.write(parsed.groupBy("lang", "own", "chunk").agg(F.count("*").alias("n")), "dictionary")
    words = dictionary.agg(F.sum(F.col("own") * F.col("n"))).first()[0] or 0
    bits = 32 + max(0, words >> 20).bit_length()
    first = spark.sparkContext.broadcast(frequent_grams(dictionary, bits, least, cells))
    longer = [frequent_grams(dictionary, bits, least, cells, longest, first)] if longest > 2 else []
    frequent = spark.sparkContext.broadcast([first.value, *longer])
    counts = dictionary.mapInArrow(lambda b: _counted(b, frequent, bits, longest), "lang string, k int, phrase string, n bigint")
    counts = counts.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    return scratch.write(counts, "counts"), scratch.write(totals, "totals")


def _part(begin: Column | int, size: Column) -> Column:
    return F.array_join(F.slice("w", begin, size), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, top: int = 2_000, inside_pct: int = 80, cells: int = 1 << 27, spacing: int = 32, most: int = 512) -> DataFrame:
    """lang, rank, phrase, a (occurrences), l and r (of the parts of the lowest-scoring cut), n (words of the language), score."""
    counts, totals = phrase_counts(docs, text_col, lang_col, longest, least, cells, spacing, most)
    scratch = Scratch(docs.sparkSession, "phrases")
    found = counts.filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = found.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(1, F.col("cut")).alias("first"), _part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    of = counts.select("lang", "phrase", "f")
    cuts = cuts.join(of.toDF("lang", "first", "l"), ["lang", "first"]).join(of.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr("cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))

    # The most frequent longer candidate around each phrase.
    sizes = F.filter(F.sequence(F.lit(2), F.col("k")), lambda s: s < F.col("k"))
    longer = found.filter("k > 2").select("lang", "a", "k", "w", F.explode(sizes).alias("size"))
    longer = longer.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at"))
    longer = longer.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    covered = F.expr(f"cast(100 as decimal(10,0)) * cast(around as decimal(20,0)) >= cast({inside_pct} as decimal(10,0)) * cast(a as decimal(20,0))")
    left = scored.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    left = scratch.write(left.select("lang", "phrase", "a", "c.l", "c.r", "c.score"), "scored")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    best = left.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.filter(F.col("rank") <= top).drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = r"""
with t as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from t),
u as (select lang, w, unnest(range(1, len(w) + 1)) as i from p),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from u, (values (1), (2), (3), (4)) s(k) where i + k - 1 <= len(w)),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= 30),
x as (select *, unnest(range(1, k)) as cut from c),
y as (
  select x.lang, x.phrase, x.a, l.f as l, r.f as r, (2000000::hugeint * x.a // (l.f + r.f))::bigint as score,
         row_number() over (partition by x.lang, x.phrase order by 2000000::hugeint * x.a // (l.f + r.f), cut) as o
  from x join f l on l.lang = x.lang and l.phrase = array_to_string(x.w[1:cut], ' ')
         join f r on r.lang = x.lang and r.phrase = array_to_string(x.w[cut + 1:x.k], ' ')),
s as (select lang, a, w, k, unnest(range(2, k)) as size from c),
z as (select lang, a, w, size, unnest(range(1, k - size + 2)) as i from s),
m as (select lang, array_to_string(w[i:i + size - 1], ' ') as phrase, max(a) as around from z group by all),
q as (
  select y.*, row_number() over (partition by y.lang order by score desc, y.a desc, y.phrase) as rank
  from y left join m using (lang, phrase) where o = 1 and not coalesce(100::hugeint * around >= 80::hugeint * y.a, false))
select lang, rank, phrase, a, l, r, n, score from q join n using (lang) where rank <= 2000
"""
