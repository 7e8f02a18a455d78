"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

``write_tokens`` encodes every text with a tokenizer file, appends an end id, and writes (doc_id, ids, at) in ascending
order of doc_id, one file per range of ids; ``at`` counts the ids before the row in its file. ORC's writer stores the
ids with its integer run-length encoding, keeps a row index for every ``row_index_stride`` rows and a Bloom filter on
doc_id, so that a reader of few documents skips files, stripes and row groups by their metadata, and many readers read
stripes in parallel. ``read_tokens`` reads the files back with each row's place among the ids of the whole set.

A text is encoded word by word: the tokenizer's own pattern never joins text across ASCII white space, so the ids of
a text are those of its words one after another, and each worker remembers the ids of recent words (a bounded number).

Defined cases: null and empty texts give the end id alone. A very long text is encoded whole, in a slice of its own. A
null doc_id sorts first. Rows with an equal doc_id are separate documents in the order of a hash of their texts, so that
many texts under one id, or under none, are dealt to many files; so are rows that are equal in both. An empty table gives no rows. Other columns are ignored. The names of
the files are written beside them (``_listing`` appended to the path), and reading fails if one of them is missing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, shuffle_partitions, text_hash

#: Signs that end a word; after letters they are a token run of their own, so both parts can be encoded apart.
END_SIGNS = ".,;:!?$&%#*|"
#: Letters that stay one letter each when normalised and lower-cased.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin : begin + size] of each entry, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordEncoder:
    """Ids of texts by way of their words, with a memory of about ``remember`` word parts.

    The tokenizer joins nothing across ASCII white space, normalises, lower-cases, and parts letters from signs. So a
    word is encoded as its letters and its end signs where it has that form and its letters are among LETTERS, and as it
    stands otherwise: other letters may be normalised to a letter and a mark, which joins the signs behind it.
    """

    def __init__(self, tokenizer_path: str, remember: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.letters = re.compile(LETTERS).fullmatch
        self.tok, self.remember = Tokenizer.from_file(tokenizer_path), remember
        self.ends_word = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(self.tok.get_vocab_size())])
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _one_by_one(self, parts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        ids = [e.ids for k in range(0, len(parts), 20_000) for e in self.tok.encode_batch_fast(parts[k : k + 20_000], add_special_tokens=False)]
        return [np.array(x, np.int32) for x in ids], [len(x) for x in ids]

    def _side_by_side(self, parts: list[str], together: int = 256) -> tuple[list[np.ndarray], list[int]]:
        """Parts of LETTERS, many in one text: each ends with an id that ends a word."""
        flat, size = [], []
        for k in range(0, len(parts), 100 * together):
            groups = [parts[i : i + together] for i in range(k, min(len(parts), k + 100 * together), together)]
            for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.int32)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(group) and ends[-1] == len(ids):
                    flat.append(ids)
                    size += np.diff(ends, prepend=0).tolist()
                else:  # a tokenizer without such ids
                    one, sizes = self._one_by_one(group)
                    flat, size = flat + one, size + sizes
        return flat, size

    def _slots(self, parts: pa.Array) -> np.ndarray:
        """Where the ids of distinct parts are kept; new ones are encoded."""
        known = parts.to_pylist()
        new = [x for x in known if x not in self.slot]
        plain = list(filter(self.letters, new))
        odd = [x for x in new if not self.letters(x)]
        for some, (flat, size) in ((plain, self._side_by_side(plain)), (odd, self._one_by_one(odd))):
            size, n = np.array(size, np.int64), len(self.slot)
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.flat, self.size = np.concatenate([self.flat, *flat]), np.concatenate([self.size, size])
            self.slot.update(zip(some, range(n, n + len(some)), strict=True))
        return np.fromiter(map(self.slot.__getitem__, known), np.int64, len(known))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has. Null counts as empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        bounds = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        core = pc.ascii_rtrim(words, characters=END_SIGNS)
        plain = pc.match_substring_regex(core, f"^{LETTERS}$")
        if len(self.slot) > self.remember:
            self._forget()
        halves = []
        for half in (pc.if_else(plain, pc.utf8_lower(core), words), pc.if_else(plain, pc.replace_substring_regex(words, f"^{LETTERS}", ""), "")):
            half = half.dictionary_encode()
            halves.append(self._slots(half.dictionary)[half.indices.to_numpy()])
        both = np.stack(halves, axis=1)
        flat, size = _gather(self.flat, self.begin[both].reshape(-1), self.size[both].reshape(-1)), self.size[both].sum(axis=1)
        at = coded.indices.to_numpy()
        ids = _gather(flat, (np.cumsum(size) - size)[at], size[at])
        before = np.concatenate([[0], np.cumsum(size[at])])
        return ids, before[bounds[1:] - bounds[0]] - before[bounds[:-1] - bounds[0]]


@lru_cache(maxsize=1)
def _encoder(tokenizer_path: str) -> WordEncoder:
    """One for all tasks of a worker."""
    return WordEncoder(tokenizer_path)


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end_id: int, slice_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    encoder, at = _encoder(tokenizer_path), 0
    for whole in batches:
        # Slices of about slice_bytes of text, so that memory doesn't follow the rows of a batch.
        read = np.cumsum(pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(read // slice_bytes)) + 1).tolist(), whole.num_rows]
        for k, upto in zip(cuts[:-1], cuts[1:], strict=True):
            batch = whole.slice(k, upto - k)
            ids, size = encoder.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(size), end_id).astype(np.int32)
            bounds = np.concatenate([[0], np.cumsum(size + 1)])
            # A list column of 32-bit offsets: the ids of a slice stay far below 2**31.
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(at + bounds[:-1])], names=["doc_id", "ids", "at"])
            at += int(bounds[-1])


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    files: int | None = None,
    row_index_stride: int = 1_000,
    stripe_bytes: int = 16 << 20,
) -> None:
    """files: number of ranges of (id, text hash), one file each; the session's shuffle partitions if not given. Equal rows
    are numbered as they are read, so that any number of them is dealt to many files."""
    parts = files or shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("th"))
    rows = rows.withColumn("nth", F.monotonically_increasing_id())
    order = (F.col("doc_id").asc_nulls_first(), F.col("th"), F.col("nth"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    out = rows.mapInArrow(lambda b: _encoded(b, tokenizer_path, end_id), "doc_id bigint, ids array<int>, at bigint")
    (
        out.write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )
    names = [(x,) for x in _names(docs.sparkSession, path)]
    docs.sparkSession.createDataFrame(names, "file string").coalesce(1).write.parquet(f"{path}_listing")


def _names(spark: SparkSession, path: str) -> list[str]:
    """The data files in a folder, one for each range of ids."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(n for n in (x.getPath().getName() for x in found) if not n.startswith(("_", ".")))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        bounds = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("file"), b.column("at"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "file", "at", "n_tokens", "ids_crc32"],
        )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids, at, file: the rows as written. Fails if a file of the listing is missing."""
    missing = {x.file for x in spark.read.schema("file string").parquet(f"{path}_listing").collect()} - set(_names(spark, path))
    if missing:
        raise FileNotFoundError(f"{path} lacks {', '.join(sorted(missing))}")
    return spark.read.schema("doc_id bigint, ids array<int>, at bigint").orc(path).select("doc_id", "ids", "at", F.col("_metadata.file_name").alias("file"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    each = read_tokens(spark, path).mapInArrow(_digests, "doc_id bigint, file string, at bigint, n_tokens bigint, ids_crc32 bigint")
    each = Scratch(spark, "token-index").write(each, "digests")
    # A row per file; ranges don't overlap, so files are in order of their first id, and of their names where one id has several.
    order = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = each.groupBy("file").agg(F.min(F.struct("at", "doc_id"))["doc_id"].alias("first"), F.sum("n_tokens").alias("n"))
    files = files.select(F.col("file").alias("_file"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("_from"))
    return each.join(files, each["file"] == files["_file"]).select("doc_id", (F.col("_from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "tokens").path("orc")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_index(spark, path)
