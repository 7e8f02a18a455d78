"""Quality rules: divergence of a document's histograms from references of its language.

Two histograms are compared by Jensen-Shannon distance (base 2, so 0 to 1): the classes of the characters in words, and
the common words of the language with one bin for all others. The references are counted over all documents, one per
language (medians of class shares, to 1/10,000, each document weighed by its characters; sums of word counts).
Common words are those with at least ``common_share`` of a language's words there, at most ``max_common`` of them (by count, then word).
They are found exactly in two counts: all words by hash bucket, then the words of the heavy buckets alone.

Length guards: a distance is judged only from ``min_class_chars`` characters or ``min_words`` words on, since histograms
of short texts are noise; both bounds also have an allowance for the sampling noise of a text of that length.

Defined cases: null and empty texts have no words and fail the base rules. A null or unseen language, or one without words, so without a
reference, is judged against the pooled reference of all languages (any number of them; references are broadcast while
they are at most ``broadcast_langs`` rows); a very long text is counted whole; without any reference the base rules decide alone.
Repeated rows are judged alike and all kept. Columns beside the id, text and language are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import NOT_WORD, Scratch, let, words

CLASSES = ("lower", "upper", "digit", "symbol", "punct", "other")
POOLED = "\x00all"
REFERENCE = ("classes", "common", "word_shares")


def _sum(xs: Column, start: Column) -> Column:
    return F.aggregate(xs, start, lambda a, x: a + x)


def _windows(all_words: Column) -> Column:
    """Hashes of all windows of eight words, in order: hashes of one word, joined to those of two, four and eight."""

    def joined(h: Column, k: int) -> Column:
        return F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - k, F.lit(0))), F.slice(h, k + 1, F.greatest(F.size(h) - k, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    one = F.transform(all_words, lambda w: F.xxhash64(w))
    return let(let(let(one, lambda h: joined(h, 1)), lambda h: joined(h, 2)), lambda h: joined(h, 4))


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more. Only texts that have such windows are sorted."""

    def in_repeats(s: Column) -> Column:
        hash_at = lambda j: F.get(s, j)["h"]
        return F.filter(s, lambda x, j: F.coalesce(hash_at(j - 1) == x["h"], F.lit(False)) | F.coalesce(hash_at(j + 1) == x["h"], F.lit(False)))

    def covered(at: Column) -> Column:
        return _sum(F.transform(at, lambda p, k: F.least(F.lit(8), F.coalesce(F.get(at, k + 1) - p, F.lit(8)))), F.lit(0))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.sort_array(F.transform(let(ordered, in_repeats), lambda x: x["i"]))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(places, covered)).otherwise(0)


def class_counts(text: str) -> tuple[dict[str, Column], list[Column]]:
    """Columns to add in turn (what is left of a text after each class is taken out), then the count of each class."""
    solid = F.regexp_replace(text, NOT_WORD, "")
    steps, left = {"_left0": solid}, ["_left0"]
    for i, chars in enumerate(("[a-z]+", "[A-Z]+", "[0-9]+", "[#*$%&|<>]+", r"[\x00-\x7F]+"), 1):
        steps[f"_left{i}"] = F.regexp_replace(left[-1], chars, "")
        left.append(f"_left{i}")
    sizes = [F.length(x) for x in left]
    return steps, [(x - y).cast("double") for x, y in zip(sizes, sizes[1:], strict=False)] + [sizes[-1].cast("double")]


def with_classes(df: DataFrame, text: str = "_text") -> DataFrame:
    """_classes: the number of characters of each of CLASSES."""
    steps, counts = class_counts(text)
    for name, step in steps.items():
        df = df.withColumn(name, step)
    return df.withColumn("_classes", F.array(*counts)).drop(*steps)


def signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """_id, _lang, _words and the base counts of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(lang_col), F.lit(POOLED)).alias("_lang"), text.alias("_text"), words(text).alias("_words"))
    a = with_classes(a).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    a = a.select(
        "_id",
        "_lang",
        "_words",
        "_classes",
        F.size("_words").alias("_n"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup_lines"),
        let(_windows(F.col("_words")), _repeat_words).alias("_repeat_words"),
    )
    failed = (F.col("_n") < min_words) | (100 * F.col("_repeat_words").cast("long") > max_repeat_pct * F.col("_n").cast("long"))
    return a.withColumn("_failed", failed)


def references(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
    common_share: float = 0.005, max_common: int = 16, buckets: int = 4096, steps: int = 10_000,
) -> DataFrame:
    """_lang, classes (shares), common (words), word_shares (of the common words, then of all others).

    One row per language with words and a pooled one, counted over all documents. Medians are counted in ``steps``.
    """
    spark = docs.sparkSession
    good = docs.select(F.coalesce(F.col(lang_col), F.lit(POOLED)).alias("_lang"), F.col(text_col).alias("_text")).filter(F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    pooled = lambda df: df.withColumn("_lang", F.explode(F.array_distinct(F.array("_lang", F.lit(POOLED)))))
    by_doc = with_classes(good)
    by_doc = by_doc.withColumn("_chars", _sum(F.col("_classes"), F.lit(0.0)).cast("long"))
    # Medians by characters: junk that is under half of a language doesn't move them, and noise of short texts has little weight.
    bins = by_doc.select("_lang", "_chars", F.posexplode(F.transform("_classes", lambda c: F.round(steps * c / F.col("_chars")).cast("int"))).alias("k", "bin"))
    bins = pooled(bins.groupBy("_lang", "k", "bin").agg(F.sum("_chars").alias("c"))).groupBy("_lang", "k", "bin").agg(F.sum("c").alias("c"))
    of_class = Window.partitionBy("_lang", "k")  # at most steps + 1 rows
    bins = bins.withColumn("upto", F.sum("c").over(of_class.orderBy("bin"))).withColumn("all", F.sum("c").over(of_class))
    middle = F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("bin")))
    medians = bins.groupBy("_lang", "k").agg((middle / steps).alias("m"))
    by_class = medians.groupBy("_lang").agg(*[F.max(F.when(F.col("k") == i, F.col("m"))).alias(c) for i, c in enumerate(CLASSES)])

    each = good.select("_lang", F.explode(words("_text")).alias("w")).withColumn("b", F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int"))
    # At most ``buckets`` rows a language leave each task here. A word with the share has a bucket with the share, too.
    by_bucket = pooled(each.groupBy("_lang", "b").agg(F.count("*").alias("c"))).groupBy("_lang", "b").agg(F.sum("c").alias("c"))
    by_bucket = Scratch(spark, "quality").write(by_bucket, "buckets")
    total = by_bucket.groupBy("_lang").agg(F.sum("c").alias("n"))
    heavy = by_bucket.join(total, "_lang").filter(F.col("c") >= common_share * F.col("n")).select("b").distinct()
    marked = {r.b for r in heavy.collect()}  # of ``buckets`` numbers
    in_heavy = F.element_at(F.array(*[F.lit(i in marked) for i in range(buckets)]), F.col("b") + 1)
    counted = pooled(each.filter(in_heavy).groupBy("_lang", "w").agg(F.count("*").alias("c"))).groupBy("_lang", "w").agg(F.sum("c").alias("c"))
    common = (
        counted.join(total, "_lang")
        .filter(F.col("c") >= common_share * F.col("n"))
        .groupBy("_lang")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c") / F.col("n")).alias("s"), "w"))), 1, max_common).alias("top"))
    )
    mass = sum((F.col(c) for c in CLASSES), F.lit(0.0))
    out = by_class.join(common, "_lang", "left").withColumn("top", F.coalesce("top", F.array().cast("array<struct<s:double,w:string>>")))
    shares = F.transform("top", lambda x: -x["s"])
    out = out.select(
        "_lang",
        F.array(*[F.col(c) / F.greatest(mass, F.lit(1e-9)) for c in CLASSES]).alias("classes"),
        F.transform("top", lambda x: x["w"]).alias("common"),
        F.concat(shares, F.array(F.greatest(F.lit(0.0), 1 - _sum(shares, F.lit(0.0))))).alias("word_shares"),
    )
    return Scratch(spark, "quality").write(out, "references")


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares of one length."""

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), _sum(F.zip_with(p, q, lambda x, y: term(x, y) + term(y, x)), F.lit(0.0)) / 2))


def apply_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = 0.12,
    max_word_distance: float = 0.25,
    min_class_chars: int = 80,
    min_words: int = 50,
    refs: DataFrame | None = None,
    broadcast_langs: int = 4096,
) -> DataFrame:
    """One row per row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance (null where a guard holds)."""
    judged = signals(docs, id_col, text_col, lang_col)
    refs = references(docs, text_col, lang_col) if refs is None else refs
    few = refs.limit(broadcast_langs + 1).count() <= broadcast_langs  # a row of a few hundred numbers each
    pool = refs.filter(F.col("_lang") == POOLED).select(*[F.col(c).alias(f"_pool_{c}") for c in REFERENCE])
    a = judged.join(F.broadcast(refs) if few else refs, "_lang", "left").join(F.broadcast(pool), F.lit(True), "left")  # one row
    a = a.withColumns({c: F.coalesce(c, f"_pool_{c}") for c in REFERENCE})
    n = F.col("_n")
    a = a.withColumn("_chars", _sum(F.col("_classes"), F.lit(0.0)))
    places = F.filter(F.transform("_words", lambda w: F.array_position("common", w).cast("int")), lambda i: i > 0)
    hits = let(places, lambda at: F.transform("common", lambda w, k: (F.size(at) - F.size(F.array_remove(at, k + 1))).cast("double")))
    shares = let(hits, lambda h: F.transform(F.concat(h, F.array(n - _sum(h, F.lit(0.0)))), lambda x: x / n))
    noise = lambda bins, seen: F.sqrt(bins / (8 * F.greatest(seen, F.lit(1)) * F.log(F.lit(2.0))))
    a = a.select(
        F.col("_id").alias(id_col),
        n.cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.col("_classes")[3].cast("long").alias("n_symbols"),
        F.col("_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("_failed").alias("base_failed"),
        F.when(F.col("_chars") >= min_class_chars, js_distance(let(F.col("_chars"), lambda t: F.transform("_classes", lambda c: c / t)), F.col("classes"))).alias("class_distance"),
        F.when(n >= min_words, js_distance(shares, F.col("word_shares"))).alias("word_distance"),
        noise(F.size("word_shares"), n).alias("_word_noise"),
        noise(len(CLASSES), F.col("_chars")).alias("_class_noise"),
    )
    far = F.coalesce(F.col("class_distance") > max_class_distance + F.col("_class_noise"), F.lit(False)) | F.coalesce(F.col("word_distance") > max_word_distance + F.col("_word_noise") / 4, F.lit(False))
    return a.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
