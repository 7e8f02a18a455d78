"""A training-data pipeline over documents: each stage is one of the corpus operators.

quality classifier -> line dedup -> n-gram Jaccard join -> mixing to target weights -> packing. Every stage but the
last returns the columns of documents; its result is written as Parquet and read again as the next one's input.

Identity of rows: (doc_id, hash of the text), null safe. Rows equal in both get one decision, except in mixing, which
counts each. Columns beside the ones a stage changes are carried through, whatever their names.

Defined cases, stage by stage. Null and empty texts: scored by the classifier like any other; no lines, no n-grams and
no words, so the next two stages keep them and mixing drops them (size 0). Very long texts: read whole by each stage, no
stage cuts them. Null ids, languages and sources: values like any other. Ties: the smaller doc_id, then the smaller hash
of the text, stays or comes first. An empty table: empty results with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from brindle.llm.common import Scratch, fresh, repeated, text_hash


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def _told_apart(field: T.StructField) -> tuple[Column, Column]:
    """What to hash of a column so that values that differ stay apart: nulls are skipped by the hash, maps can't be hashed."""
    c = F.col(f"`{field.name}`")
    plain = "map<" not in field.dataType.simpleString() and "variant" not in field.dataType.simpleString()
    return c.isNull(), c if plain else F.to_json(F.struct(c))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.7). Fitted on labelled rows of its input."""
    net = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep(docs, net, least=0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines are deleted; a document of which no word is left goes."""
    (removed,) = fresh(docs, "_removed")
    out = line_dedup.dedup_lines(docs, removed_col=removed)
    emptied = (F.size(removed) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.filter(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*_columns(docs))


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays, that with the smallest doc_id (nulls last), then text hash."""
    scratch = Scratch(spark, "join-stage")
    gone, gone_th = fresh(docs, "_gone", "_gone_th")
    found = ngram_join.NgramJoin(docs).run().filter("n_shingles > 0").groupBy("doc_id", "th").agg(F.min("comp").alias("comp"))
    found = scratch.write(found, "found")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    kept = found.groupBy("comp").agg(least.alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.th").alias("_th"))
    losers = found.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left_anti")
    losers = scratch.write(losers.select(F.col("doc_id").alias(gone), F.col("th").alias(gone_th)), "losers")
    side = F.broadcast(losers) if losers.count() <= 1_000_000 else losers.hint("shuffle_hash")
    return docs.join(side, F.col("doc_id").eqNullSafe(F.col(gone)) & (text_hash("text") == F.col(gone_th)), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Equal rows share what they take evenly.

    Rows that share id and text are counted by their other columns, so that no number of them meets in one task.
    """
    scratch = Scratch(spark, "mix-stage")
    did, th, copies, rows, other, row, n = fresh(docs, "_id", "_th", "_copies", "_rows", "_other", "_row", "_n")
    taken = mixing.mix(docs.select("doc_id", "text", "source")).groupBy("doc_id", "text_key").agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    taken = scratch.write(taken.filter(F.col(copies) > 0).select(F.col("doc_id").alias(did), F.col("text_key").alias(th), copies, rows), "taken")

    def copied(times: DataFrame) -> DataFrame:
        return docs.join(times.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(did)) & (text_hash("text") == F.col(th)))

    once = copied(taken.filter(F.col(rows) == 1))
    once = once.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*_columns(docs))
    several = taken.filter(F.col(rows) > 1)
    if several.isEmpty():
        return once
    of = F.xxhash64(*[x for c in docs.schema if c.name.lower() != "text" for x in _told_apart(c)], F.lit(0))
    kinds = copied(several).groupBy(did, th, copies, rows, of.alias(other)).agg(F.count("*").alias(n), F.first(F.struct(*_columns(docs))).alias(row))
    kinds = scratch.write(kinds, "kinds")
    # The rows of one id and text are numbered kind after kind; the first of them take what doesn't divide evenly.
    upto = Window.partitionBy(did, th).orderBy(other).rowsBetween(Window.unboundedPreceding, -1)
    each = kinds.drop(row).withColumn("before", F.coalesce(F.sum(n).over(upto), F.lit(0))).withColumn("even", F.floor(F.col(copies) / F.col(rows)))
    more = F.greatest(F.lit(0), F.least(F.col(n), F.col(copies) - F.col("even") * F.col(rows) - F.col("before")))
    each = each.select(did, th, other, (F.col("even") * F.col(n) + more).alias(copies)).filter(F.col(copies) > 0)
    each = each.select(F.col(did).alias("i"), F.col(th).alias("t"), F.col(other).alias("o"), F.col(copies).alias("c"))
    each = kinds.select(did, th, other, row).join(each, F.col(did).eqNullSafe(F.col("i")) & (F.col(th) == F.col("t")) & (F.col(other) == F.col("o")))
    each = repeated(scratch.write(each.select(row, F.col("c").alias(copies)), "shares"), copies, n)
    return once.unionByName(each.select(*[F.col(f"{row}.`{c}`") for c in docs.columns]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_to, batch and place of every document."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, docs = docs, scratch.write(out, name)
        if k:
            scratch.drop(before)


#: A fitted network, random rounding and bucket bounds have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None
