"""Language identification by words first, backing off to shorter and shorter character n-grams.

The model has, per language, log frequencies of its known words and of the n-grams of 1 to ``MAX_N`` characters of
those words (with word bounds). A text's words (runs of letters, lower-cased) are scored one by one: a known word by
its log frequency in each language; an unseen word by its n-grams of the largest n of which the model knows any, their
mean, less a fixed penalty for each step down. A language's score is the mean over all words of the whole text.

Fitting covers a bounded sample: at most ``docs_per_lang`` documents of each language among those that are not held out,
with the smallest hashes of id and text (repeated rows are one document; a small language is taken whole), and of these the ``words_per_lang`` most frequent words; of more than ``max_langs`` languages those
with the most rows. All three are parameters; with them the model has a bounded size and is broadcast. Prediction reads every word of every text and never the language, source or id.

Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0. A very long text is
scored whole, from the counts of its distinct words. Rows with a null language are
not learned from, but predicted; an empty language is one like any other. Without any row to learn from every text is ``und`` with score 0. Equal texts get
equal results. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, held_out, text_hash

MAX_N, BACKOFF = 4, 1.0
#: Unseen words whose scores a worker keeps.
REMEMBER = 200_000
#: Runs of letters (Unicode category L, as \\p{L} in the JVM): word signs but digits, the underscore and other numbers.
_NUMBERS = "".join(re.escape(c) for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{_NUMBERS}]+")
#: Runs of letters and numbers that aren't digits: a far quicker pattern.
ALMOST = re.compile(r"[^\W\d_]+")
UND = "und"


def letter_runs(text: str) -> Counter:
    """How often each run of LETTERS occurs. Only runs of ALMOST with another number inside are parted by LETTERS."""
    found = Counter(ALMOST.findall(text))
    for run in [w for w in found if not w.isalpha()]:
        n = found.pop(run)
        for w in LETTERS.findall(run):
            found[w] += n
    return found


def grams(word: str, n: int) -> list[str]:
    padded = f"\x02{word}\x03" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class LanguageModel:
    """counts: {language: {word: count}}."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        width = len(self.langs)
        self.index: list[dict[str, int]] = []  # for whole words (at 0) and n-grams of n characters (at n): their rows
        self.rows: list[np.ndarray] = []
        for n in range(MAX_N + 1):
            table: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(width))
            for k, lang in enumerate(self.langs):
                for word, c in counts[lang].items():
                    for g in [word] if n == 0 else grams(word, n):
                        table[g][k] += c
            seen = np.array(list(table.values())).reshape(len(table), width)
            # Add-half smoothing over the entries of all languages.
            self.rows.append(np.log((seen + 0.5) / (seen.sum(0) + 0.5 * max(1, len(table)))))
            self.index.append(dict(zip(table, range(len(table)), strict=True)))
        self._start()

    def _start(self) -> None:
        """Room for the scores of unseen words, beside those of the known ones."""
        self.known = dict(self.index[0])
        self.scores = np.concatenate([self.rows[0], np.zeros((REMEMBER, len(self.langs)))])

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "index": self.index, "rows": self.rows}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def unseen(self, word: str) -> np.ndarray:
        for n in range(min(MAX_N, len(word) + 2), 0, -1):
            table = self.index[n]
            got = [i for g in grams(word, n) if (i := table.get(g)) is not None]
            if got:
                return self.rows[n][got].sum(0) / len(got) - BACKOFF * (MAX_N + 1 - n)
        return np.full(len(self.langs), -20.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = letter_runs(text.lower()) if text else None
        if not found or not self.langs:
            return UND, 0.0
        known = self.known
        if len(known) + len(found) > len(self.scores):  # forget unseen words
            self._start()
            known = self.known
            if len(known) + len(found) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((len(found), len(self.langs)))])
        for word in [w for w in found if w not in known]:
            known[word] = at = len(known)
            self.scores[at] = self.unseen(word)
        weight = np.fromiter(found.values(), np.float64, len(found))
        total = weight @ self.scores[[known[w] for w in found]] / weight.sum()
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -50, 0)).sum())


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1_500, words_per_lang: int = 30_000,
    max_langs: int = 1_000,
) -> LanguageModel:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = rows.filter(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out("_id"))
    # Documents are drawn by their id and text, so copies of one row are one and no other row depends on them. About twice
    # as many as wanted are drawn, all of a small language, and the smallest hashes of these stay.
    rows = rows.withColumn("_th", text_hash("_text"))
    keys = Scratch(docs.sparkSession, "language").write(rows.select("_id", "_th", "_lang").distinct(), "keys")
    sizes = {r["_lang"]: r["count"] for r in keys.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(max_langs).collect()}
    if not sizes:
        return LanguageModel({})
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * docs_per_lang / n))])
    draw = F.pmod(F.xxhash64("_id", "_th", F.lit(17)), F.lit(1_000_000))
    drawn = keys.filter(F.col("_lang").isin(list(sizes)) & (draw < F.element_at(rate, F.col("_lang")) * 1_000_000)).withColumn("_draw", draw)
    first = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw", "_id", "_th"))
    drawn = drawn.withColumn("_n", first).filter(F.col("_n") <= docs_per_lang)
    drawn = drawn.select(F.col("_id").alias("_i"), F.col("_th").alias("_t"), F.col("_lang").alias("_l"))
    side = F.broadcast(drawn) if docs_per_lang * len(sizes) <= 1_000_000 else drawn.hint("shuffle_hash")
    rows = rows.join(side, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")) & (F.col("_lang") == F.col("_l")), "left_semi")
    rows = rows.groupBy("_id", "_th", "_lang").agg(F.min("_text").alias("_text"))
    found = rows.select("_lang", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    counts = found.groupBy("_lang", "w").count()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("count"), "w"))
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counts.withColumn("_rank", rank).filter(F.col("_rank") <= words_per_lang).select("_lang", "w", "count").collect():
        out[r["_lang"]][r["w"]] = r["count"]
    return LanguageModel(dict(out))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words_per_lang words a language and their n-grams
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
