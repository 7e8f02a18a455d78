"""Removal of repeated runs of lines by winnowing over line hashes.

A window is the shortest group of consecutive lines that holds ``min_words`` words, counted from its first line on or
from its last line back; of each window the line with the smallest hash is selected (the last of equals). A fingerprint
is the selected line, its offset in the window and a hash of all the window's lines, so two windows with one fingerprint
hold the same lines. Each window is joined to the earliest place of its fingerprint in the corpus, and if that is
another place, all its lines are deleted.

Whatever else stands around a common line, a run of at least ``min_words`` words that stands at an earlier place goes
whole: each of its lines is in a window inside the run (the one that begins there, or ends there, or begins the run),
and that window has an earlier place, too.

Earlier means a smaller (doc_id, text hash, line). A deleted line therefore always has an equal line at an earlier
place, and the earliest place of a line is never deleted.

Occurrences are never paired with each other, only with one earlier place, so a passage that a third of all documents
share makes one pair for each of its windows there. The other side of the join has one row per fingerprint; those of
fingerprints with over 1/10,000 of the windows go to all tasks by broadcast, so such a passage meets in no single task.

Defined cases: lines are what lies between newline characters, compared without white space at either end. Lines
without a word are no part of runs and stay. A null text stays null. Rows with an equal id and text are one document
with one decision, given to each of the rows; to drop copies of whole documents is another operator's work, but a copy
under another id is a repeated run, so all its lines with words go and an empty or blank text stays. Texts under
``min_words`` words have no window and stay. Columns beside the id and text are carried through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import NOT_WORD, Scratch, fresh, join_by_weight, text_hash

KEY = ["_did", "_th"]
#: The selected line, its offset in the window, and all the window's lines.
FINGERPRINT = ["h", "at", "wh"]


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{NOT_WORD}|{NOT_WORD}$", "")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_did, _th, pos, h, n (words), ord (number among lines with words), before (words before the line in its document)."""
    rows = docs.select(F.col(id_col).alias("_did"), text_hash(text_col).alias("_th"), F.posexplode(F.split(text_col, "\n")).alias("pos", "_line"))
    line = rows.select(*KEY, "pos", _stripped(F.col("_line")).alias("_line")).filter("_line != ''")
    line = line.select(*KEY, "pos", F.xxhash64("_line").alias("h"), F.size(F.split("_line", NOT_WORD)).alias("n"))
    line = line.dropDuplicates([*KEY, "pos"])
    order = Window.partitionBy(*KEY).orderBy("pos")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return line.withColumn("ord", F.row_number().over(order)).withColumn("before", before)


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """_did, _th, start, stop (numbers of the first and last line) and the fingerprint of every window."""
    lines = lines.withColumn("after", F.col("before") + F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*KEY)))

    def over(frame: Window) -> list[Column]:
        least = F.min(F.struct("h", (-F.col("ord")).alias("at"))).over(frame)
        return [least.alias("least"), F.min("ord").over(frame).alias("start"), F.max("ord").over(frame).alias("stop"), F.min("before").over(frame).alias("begin"), F.collect_list("h").over(frame).alias("hs")]

    # The lines that begin less than min_words words after this one's begin, or end less than that before its end.
    onwards = Window.partitionBy(*KEY).orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*KEY).orderBy("after").rangeBetween(1 - min_words, 0)
    begun = lines.select("*", *over(onwards)).filter(F.col("all") - F.col("before") >= min_words)
    # Without its last line a window that ends here has min_words words left, or it is its first line's window as well.
    ended = lines.select("*", *over(back)).filter((F.col("after") >= min_words) & (F.col("before") - F.col("begin") >= min_words))
    out = begun.unionByName(ended)
    return out.select(*KEY, "start", "stop", F.col("least.h").alias("h"), (-F.col("least.at") - F.col("start")).alias("at"), F.xxhash64("hs").alias("wh"))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """_did, _th, pos of the lines to delete."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.write(_lines(docs, id_col, text_col), "lines")

    windows = scratch.write(_windows(lines, min_words), "windows")

    place = F.struct("_did", "_th", "start")
    first = windows.groupBy(*FINGERPRINT).agg(F.min(place).alias("src"), F.count("*").alias("times")).filter("times > 1")
    first = scratch.write(first, "first")
    later = join_by_weight(windows, first, FINGERPRINT, "times").filter(F.col("src") < place).groupBy(*KEY, "start").agg(F.max("stop").alias("stop"))
    # A line is in a later window if one that begins up to there ends no earlier.
    both = lines.select(*KEY, "ord", "pos", F.lit(None).cast("int").alias("stop"))
    both = both.unionByName(later.select(*KEY, F.col("start").alias("ord"), F.lit(None).cast("int").alias("pos"), "stop"))
    upto = Window.partitionBy(*KEY).orderBy("ord").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("reach", F.max("stop").over(upto)).filter("pos is not null and reach >= ord").select(*KEY, "pos")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, removed_col: str = "removed_lines") -> DataFrame:
    """The rows of docs with the later copies of repeated runs deleted from text_col, and removed_col (their numbers from
    0), which replaces a column of that name."""
    did, th, lines = fresh(docs, "_did", "_th", "_gone")
    gone = repeated_lines(docs, id_col, text_col, min_words).groupBy(*KEY).agg(F.array_sort(F.collect_list("pos")).alias(lines))
    gone = gone.select(F.col("_did").alias(did), F.col("_th").alias(th), lines)
    out = docs.join(gone.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(did)) & (text_hash(text_col) == F.col(th)), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda line, i: ~F.array_contains(lines, i)), "\n")
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(kept)
    removed = F.coalesce(lines, F.array().cast("array<int>"))
    plain = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (text_col.lower(), removed_col.lower())]
    return out.select(*plain, text.alias(text_col), removed.alias(removed_col))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, removed_lines and the text that stays of every document."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed_lines").alias("n_removed"), "removed_lines", "text")
