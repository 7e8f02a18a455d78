"""Learned classes of texts, and the words that tell a group of texts from all others. Counts in Spark, scores by joins.

Words are the runs of lower-case letters and digits of the text in lower case. A null text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.stored import stored

WORD = r"[\p{Ll}\p{Nd}]+"


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def counted(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """by, word, n."""
    return rows.select(*by, F.explode(words(text)).alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))


def naive_bayes(labelled: DataFrame, label: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(label, word, n), and one row per label: its rows, its words and its share of rows as a logarithm, with the number
    of distinct words. Rows without label are left out."""
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("_text"))
    n = counted(rows, ["label"], "_text")
    total = n.groupBy("label").agg(F.sum("n").alias("n_words"))
    vocabulary = n.agg(F.countDistinct("word").alias("vocabulary"))
    prior = rows.groupBy("label").agg(F.count("*").alias("rows"))
    all_rows = rows.agg(F.count("*").alias("all"))
    prior = prior.join(total, "label", "left").crossJoin(F.broadcast(vocabulary)).crossJoin(F.broadcast(all_rows))  # one row each
    prior = prior.withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    return n, prior.select("label", F.log(F.col("rows") / F.col("all")).alias("prior"), "n_words", "vocabulary")


def classify(rows: DataFrame, key: list[str], text: str, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """key, label, score: the likeliest label of multinomial naive Bayes with add-one smoothing; of equal ones the smaller.

    log((n + 1) / (N + V)) is log(n + 1) - log(N + V), and the first is 0 for a word that the label hasn't, so only
    words that the label has are joined; a text without words gets the likeliest prior. The labels are few: one array.
    """
    n, prior = model
    each = counted(rows, key, text).withColumnRenamed("n", "times")
    hits = each.join(n, "word").groupBy(*key, "label").agg(F.sum(F.col("times") * F.log(F.col("n") + 1)).alias("gain"))
    length = rows.select(*key, F.size(words(text)).alias("length"))
    labels = prior.select("label", "prior", F.log(F.col("n_words") + F.col("vocabulary")).alias("cost"))
    scored = length.crossJoin(F.broadcast(labels)).join(hits, [*key, "label"], "left")  # rows times labels
    scored = scored.select(*key, "label", (F.col("prior") + F.coalesce("gain", F.lit(0.0)) - F.col("length") * F.col("cost")).alias("score"))
    best = scored.groupBy(*key).agg(F.min(F.struct((-F.round("score", 6)).alias("s"), "label")).alias("b"))
    return best.select(*key, F.col("b.label").alias("label"), (-F.col("b.s")).alias("score"))


def keyness(rows: DataFrame, group: str, text: str, top: int = 10, least: int = 3) -> DataFrame:
    """group, word, a (in the group), b (elsewhere), g2, rank: the ``top`` words that the group has more often than the
    others, by log-likelihood; ties by the word. Words with fewer than ``least`` in the group aren't ranked."""
    n = stored(counted(rows.filter(F.col(group).isNotNull()), [group], text), "counts")  # read four times
    of_word = n.groupBy("word").agg(F.sum("n").alias("of_word"))
    of_group = n.groupBy(group).agg(F.sum("n").alias("c"))
    all_words = n.agg(F.sum("n").alias("all"))
    x = n.filter(F.col("n") >= least).join(of_word, "word").join(of_group, group).crossJoin(F.broadcast(all_words))  # one row
    a, b, c, d = F.col("n"), F.col("of_word") - F.col("n"), F.col("c"), F.col("all") - F.col("c")
    more = a * d > b * c
    here, there = c * F.col("of_word") / F.col("all"), d * F.col("of_word") / F.col("all")
    g2 = F.round(2 * (a * F.log(a / here) + F.when(b > 0, b * F.log(b / there)).otherwise(0.0)), 6)
    x = x.filter(more).select(group, "word", a.alias("a"), b.alias("b"), g2.alias("g2"))
    order = (F.col("g2").desc(), F.col("word"))
    # Ranked in parts of each group first, so that a large group is no single task.
    part = F.pmod(F.xxhash64("word"), F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    x = x.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))).filter(F.col("rank") <= top)
    return x.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= top)
