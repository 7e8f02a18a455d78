"""Fill-in-the-middle: texts cut at two boundaries of units and put together again with the middle last.

The bytes of a batch of texts are put into six classes by what ends with them: nothing (a byte inside a code point), a code
point, and for white space also a newline, a gap between words. A wavelet matrix over the classes answers rank queries (how
many bytes of a class stand before a place); sums of ranks are counts of boundaries: of code points, of words with the gap
behind them, of lines. A cut after k units is the smallest place with k boundaries before it, found by bisection on these
ranks for all texts of the batch at once; the lengths of prefix and middle in code points are differences of ranks.

Cuts and forms come from the sha256 of ``seed:doc_id``, so they are the same in every run, whatever the partitions. Nothing
is shuffled: texts go through Arrow in slices of a few megabytes, a longer text is a slice of its own.

Defined cases: a null text is an empty one; an empty text, or one that holds a marker, is plain (unchanged, lengths null).
A null id counts as an id of no digits. Rows of one id get equal numbers, so repeated rows equal results. A text with fewer
units than cuts gets empty parts. Other columns are carried through; those named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.texts import WHITE, joined, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = "<P>|<S>|<M>"
#: Classes of bytes.
INSIDE, CHAR, WHITE_IN, WHITE_END, NEWLINE_IN, NEWLINE_END = range(6)
#: Classes that end a unit; white space is one byte long, so it ends a code point as well.
UNITS = {
    "char": (CHAR, WHITE_IN, WHITE_END, NEWLINE_IN, NEWLINE_END),
    "word": (WHITE_END, NEWLINE_END),
    "line": (NEWLINE_IN, NEWLINE_END),
}
RESULTS = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "fim_text": T.StringType()}


class WaveletMatrix:
    """Rank queries over an array of small numbers: one row of bits for each binary digit, the highest first, every row
    ordered by the digits before (zeros, then ones), with the ones counted every 64 bits."""

    def __init__(self, values: np.ndarray, digits: int):
        self.size, self.rows = len(values), []
        for d in reversed(range(digits)):
            bit = ((values >> d) & 1).astype(bool)
            packed = np.zeros((len(bit) // 64 + 1) * 8, np.uint8)
            packed[: (len(bit) + 7) // 8] = np.packbits(bit, bitorder="little")
            bits = packed.view("<u8")
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            self.rows.append((d, bits, ones, len(bit) - int(ones[-1])))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(bits: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ones[at >> 6] + np.bitwise_count(bits[at >> 6] & below)

    def rank(self, value: int, at: np.ndarray) -> np.ndarray:
        """How many of the first at numbers are the value, for each at."""
        first = np.zeros(1, np.int64)
        for d, bits, ones, zeros in self.rows:
            both = np.concatenate([first, at])
            before = self._ones(bits, ones, both)
            both = zeros + before if value >> d & 1 else both - before
            first, at = both[:1], both[1:]
        return at - first

    def ranks(self, values: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(v, at) for v in values)

    def place(self, values: tuple[int, ...], count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest place from low to high before which count numbers of the values stand; high, if none has so many."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            half = (low + high) >> 1
            enough = self.ranks(values, half) >= count
            high = np.where(open_ & enough, half, high)
            low = np.where(open_ & ~enough, half + 1, low)
        return low


def classes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class of every byte of the texts."""
    if not len(data):
        return np.zeros(0, np.uint8)
    white, goes_on = WHITE[data], (data & 0xC0) == 0x80
    ends = np.zeros(len(data) + 1, bool)
    ends[at] = True
    ends = ends[1:]
    white_next = np.concatenate([white[1:], [False]]) & ~ends
    inside = np.concatenate([goes_on[1:], [False]]) & ~ends
    gap = np.where(white_next, WHITE_IN, WHITE_END) + np.where(data == 0x0A, NEWLINE_IN - WHITE_IN, 0)
    return np.where(white, gap, np.where(inside, INSIDE, CHAR)).astype(np.uint8)


def cuts(data: np.ndarray, at: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """Units of every text, the places of both cuts, and the code points before the first and between both."""
    matrix, ends = WaveletMatrix(classes(data, at), 3), UNITS[unit]
    begin, stop = at[:-1], at[1:]
    before = matrix.ranks(ends, begin)
    closed = matrix.ranks(ends, stop) - before
    # The last unit may lack what ends the others.
    n = closed + ((stop > begin) & (matrix.ranks(ends, np.maximum(stop - 1, begin)) - before == closed))
    a, b = h1 % (n + 1), h2 % (n + 1)
    first = matrix.place(ends, before + np.minimum(a, b), begin, stop)
    second = matrix.place(ends, before + np.maximum(a, b), begin, stop)
    chars = [matrix.ranks(UNITS["char"], x) for x in (begin, first, second)]
    return n, first, second, chars[1] - chars[0], chars[2] - chars[1]


def _rearranged(batches: Iterator[pa.RecordBatch], text_col: str, unit: str, n_kept: int) -> Iterator[pa.RecordBatch]:
    """Columns h1, h2, form, and those that are kept (c0, c1, ...), of which one is the text, or text."""
    for batch in slices(batches, text_col):
        data, at = joined(batch.column(text_col))
        h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
        n, first, second, p_chars, m_chars = cuts(data, at, h1, h2, unit)
        flat, texts, forms = data.tobytes(), [], batch.column("form").to_pylist()
        for begin, one, two, stop, form in zip(*(x.tolist() for x in (at[:-1], first, second, at[1:])), forms, strict=True):
            prefix, middle, suffix = flat[begin:one], flat[one:two], flat[two:stop]
            if form == "psm":
                texts.append(b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle)
            elif form == "spm":
                texts.append(b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle)
            else:
                texts.append(flat[begin:stop])
        plain = np.array([f == "plain" for f in forms], bool)
        kept = {c: batch.column(c) for c in (f"c{k}" for k in range(n_kept))}
        made = [pa.array(n, pa.int64()), batch.column("form"), pa.array(p_chars, pa.int64(), mask=plain), pa.array(m_chars, pa.int64(), mask=plain), pa.array(texts, pa.binary()).view(pa.string())]
        yield pa.RecordBatch.from_arrays([*kept.values(), *made], names=[*kept, *RESULTS])


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars and fim_text.

    rate: of 100 texts, how many are cut; spm: of 100 cut ones, how many have the suffix first. unit: char, word or line.
    """
    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4))
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = (text == "") | text.rlike(MARKERS) | (h3 % 100 >= rate)
    form = F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    # Numbers stand for the names of kept columns on the way through Python, so any name will do.
    kept = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)]
    schema = T.StructType([*(T.StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(keep)), *(T.StructField(k, t) for k, t in RESULTS.items())])
    # A text that is kept goes through Python once.
    name, extra = (f"c{keep.index(text_col)}", []) if text_col in keep else ("text", [text.alias("text")])
    rows = docs.select(h1.alias("h1"), h2.alias("h2"), form.alias("form"), *extra, *kept)
    return rows.mapInArrow(lambda b: _rearranged(b, name, unit, len(keep)), schema).toDF(*keep, *RESULTS)


def restored(text: Column, form: Column) -> Column:
    """The text that fill_middle made the given one from. The markers can't come about where two parts meet."""
    part = F.split(text, MARKERS)
    psm, spm = (F.concat(F.get(part, F.lit(p)), F.get(part, F.lit(3)), F.get(part, F.lit(s))) for p, s in ((1, 2), (2, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the operator makes of every document, as hashes, and the hash of the text restored from it."""
    made = fill_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_text"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(doc_id::varchar, '')) as s,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u from documents),
h as (
  select *, len(u) as n, ('0x' || s[1:8])::ubigint as h1, ('0x' || s[9:16])::ubigint as h2, ('0x' || s[25:32])::ubigint as h4,
         text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') as plain from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b from h),
p as (
  select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as x,
         case when plain then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from c)
select doc_id, n::bigint as n, form, case when not plain then length(p) end as prefix_chars, case when not plain then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256 from p
"""
