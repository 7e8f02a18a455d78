"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words. A document of the source is to be taken ``target / source size`` times in
expectation: the whole part always, the fraction by dependent rounding. Rounding pairs two fractional documents and
moves words from one to the other, in a random direction with probabilities that keep both expectations, until one of
them is whole. A group of documents folds to one fractional document in this way; the residuals of all groups are
grouped and folded again, up to one per source: a reduction tree whose levels are shuffles of ever fewer narrow rows.
A move keeps the sum of words, so a source's taken words differ from its target by the rounding of its last document. Folds
take long documents first, so that the one left is most likely short.

Sources in code point order, null last, have the weights 3, 1, 2, repeating. The targets share ``share`` of all words
by weight; none exceeds ``cap`` times its source's size, and what lies above is shared again by weight.

Random numbers are hashes of ids, level and seed: a rerun takes the same documents.

Defined cases: a null text has size 0; documents of size 0 take 0, and so does a source without words. A null source is a source of its own. Rows that
share an id are separate documents (equal rows may be told apart by nothing, so either may be the one taken). A null
id is an id like any other. Of a very long text only its size is used. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import Scratch, join_by_weight, let, n_words, repeated, shuffle_partitions, text_hash

WEIGHTS = (3.0, 1.0, 2.0)


def _running(rows: DataFrame, order: list[Column], sums: dict[str, str], scratch: Scratch) -> DataFrame:
    """rows with _rank (from 0) in an order without ties, and for each name in sums the sum of its column over all rows before.

    Ranges of the order are numbered and summed apart, and begin where the ranges before them end: one row a range.
    """
    parts = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    parts = scratch.write(parts, "ranges")
    inside = Window.partitionBy("_part").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.groupBy(F.col("_part").alias("_of")).agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    begins = begins.select("_of", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("_rows", *(f"_{name}" for name in sums))])
    out = parts.withColumn("_rank", F.row_number().over(inside) - 1)
    for name, c in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(earlier), F.lit(0)))
    out = out.join(F.broadcast(begins), F.col("_part") == F.col("_of")).withColumn("_rank", F.col("_rank") + F.col("_rows"))
    return out.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).select(*rows.columns, "_rank", *sums)


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, scratch: Scratch | None = None) -> DataFrame:
    """_source, _order, source_size, n, target from (_source, size, _times): one row per source, of any number of sources.

    Water-filling: in order of cap * size / weight, a source is capped while its cap is below what the level gives it.
    """
    scratch = scratch or Scratch(sizes.sparkSession, "targets")
    by = sizes.groupBy("_source").agg(F.sum(F.col("size") * F.col("_times")).alias("source_size"), F.sum("_times").alias("n"))
    by = _running(by, [F.col("_source").asc_nulls_last()], {}, scratch).withColumnRenamed("_rank", "_order")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_order") % len(weights) + 1).cast("int"))
    by = scratch.write(by.withColumn("_w", w).withColumn("_cap", cap * F.col("source_size")), "weights")
    rising = [F.col("_cap") / F.col("_w"), F.col("_order")]
    by = scratch.write(_running(by, rising, {"_caps": "_cap", "_ws": "_w"}, scratch), "rising")
    whole = by.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    level = (F.lit(share * (whole["size"] or 0)) - F.col("_caps")) / (F.lit(whole["w"] or 1.0) - F.col("_ws"))
    # Once one source stays below its cap, so do all that follow it, at the level of the first of them.
    free = by.withColumn("_level", level).filter(F.col("_level") * F.col("_w") < F.col("_cap")).agg(F.min(F.struct("_rank", "_level")).alias("first")).first()["first"]
    filled = F.when(F.col("_rank") >= free["_rank"], F.least("_cap", F.lit(free["_level"]) * F.col("_w"))).otherwise(F.col("_cap")) if free else F.col("_cap")
    return by.select("_source", "_order", "source_size", "n", filled.alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(items: Column, item_type: str, level: int, seed: int) -> Column:
    """Fold an array of items (w, key, x, p) with x from 0 to 1: the last carry, and those that became whole."""
    done_type = f"array<{item_type}>"
    state_type = f"struct<carry:{item_type},done:{done_type}>"
    with_x = lambda i, x: F.struct(i["w"].alias("w"), i["key"].alias("key"), x.alias("x"), i["p"].alias("p"))
    whole = lambda i: (i["x"] <= 0.0) | (i["x"] >= 1.0)

    def merge(state: Column, it: Column) -> Column:
        def moved(m: Column) -> Column:
            # Towards i: "up" words at most until i is full or c empty; else "down" words until i is empty or c full.
            # The odds keep both expectations.
            c, i = m["c"], m["i"]
            to_i = m["go"] < m["down"] / (m["up"] + m["down"])
            words = F.when(to_i, m["up"]).otherwise(-m["down"])
            end = F.when(to_i, F.lit(1.0)).otherwise(0.0)
            i_ends = F.when(to_i, (1 - i["x"]) * i["w"] <= c["x"] * c["w"]).otherwise(i["x"] * i["w"] <= (1 - c["x"]) * c["w"])
            new_i = with_x(i, F.when(i_ends, end).otherwise(i["x"] + words / i["w"]))
            new_c = with_x(c, F.when(i_ends, c["x"] - words / c["w"]).otherwise(1 - end))
            return F.struct(F.when(i_ends, new_c).otherwise(new_i).alias("carry"), F.concat(state["done"], F.array(F.when(i_ends, new_i).otherwise(new_c))).alias("done"))

        c = state["carry"]
        m = F.struct(
            c.alias("c"),
            it.alias("i"),
            F.least((1 - it["x"]) * it["w"], c["x"] * c["w"]).alias("up"),
            F.least(it["x"] * it["w"], (1 - c["x"]) * c["w"]).alias("down"),
            _uniform(c["key"], it["key"], F.lit(level), F.lit(seed)).alias("go"),
        )
        settle = lambda carry, out: F.struct(carry.alias("carry"), F.concat(state["done"], F.array(out)).alias("done")).cast(state_type)
        return (
            F.when(c.isNull(), F.struct(it.alias("carry"), state["done"].alias("done")).cast(state_type))
            .when(whole(c), settle(it, c))
            .when(whole(it), settle(c, it))
            .otherwise(let(m, moved).cast(state_type))
        )

    start = F.struct(F.lit(None).cast(item_type).alias("carry"), F.array().cast(done_type).alias("done")).cast(state_type)
    return F.aggregate(items, start, merge)


def pivotal_rounding(items: DataFrame, counts: dict[int, int] | None = None, seed: int = 0, group: int = 64, scratch: Scratch | None = None, most: int | None = None) -> DataFrame:
    """The items (part, key, x, w, p) with x rounded to 0.0 or 1.0 so that each part's sum of x * w stays.

    counts: an upper bound on the items of each part, if items have no column n of it; most: the greatest of these
    bounds; group: the mean number of items that one fold takes.
    """
    scratch = scratch or Scratch(items.sparkSession, "rounding")
    if counts is not None:
        bounds = items.sparkSession.createDataFrame(list(counts.items()), f"part {items.schema['part'].dataType.simpleString()}, n bigint")
        items, most = items.join(bounds, "part"), max(counts.values())
    item = F.struct("w", "key", "x", "p")
    item_type = items.select(item.alias("i")).schema["i"].dataType.simpleString()
    level, done, live, most = 0, [], items, most or 1
    while True:
        groups = F.when(F.col("n") > 2 * group, F.ceil(F.col("n") / group)).otherwise(1).cast("long")
        folded = (
            live.withColumn("n", groups)
            .withColumn("_g", F.pmod(F.xxhash64("key", F.lit(level), F.lit(seed)), F.col("n")))
            .groupBy("part", "n", "_g")
            .agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
            .select("part", "n", _fold(F.col("items"), item_type, level, seed).alias("s"))
        )
        folded = scratch.write(folded, f"level{level}")
        done.append(folded.select("part", F.explode("s.done").alias("i")).select("part", "i.key", "i.x", "i.w", "i.p"))
        live = folded.filter(F.col("s.carry").isNotNull()).select("part", "n", "s.carry.key", "s.carry.x", "s.carry.w", "s.carry.p")
        if most <= 2 * group:
            last = F.when(F.col("x").isin(0.0, 1.0), F.col("x")).when(_uniform(F.col("key"), F.lit(-1), F.lit(seed)) < F.col("x"), 1.0).otherwise(0.0)
            done.append(live.withColumn("x", last).drop("n"))
            break
        most, level = -(-most // group), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _key(source: Column) -> Column:
    """A source's name, or one of its own for null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple = WEIGHTS,
    seed: int = 0,
) -> DataFrame:
    """One row per row of docs: id_col, text_key (hash of the text), size, source_size, target, copies, taken."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sizes = docs.select(F.col(id_col).alias("_id"), text_hash(text_col).alias("_th"), F.col(source_col).alias("_source"), n_words(text_col).alias("size"))
    # Equal rows are counted, then numbered, so that no number of them meets in one task.
    sizes = scratch.write(sizes.groupBy(*sizes.columns).agg(F.count("*").alias("_times")), "sizes")
    targets = source_targets(sizes, share, cap, weights, scratch)
    ratio = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    targets = scratch.write(targets.select(_key(F.col("_source")).alias("_s"), F.col("_order").alias("part"), "source_size", "n", "target", ratio.alias("ratio")), "targets")
    a = join_by_weight(repeated(sizes, "_times", "_twin").withColumn("_s", _key(F.col("_source"))), targets, "_s", "n")
    ratio = F.when(F.col("size") > 0, F.col("ratio")).otherwise(0.0)
    a = a.withColumn("ratio", ratio).withColumn("whole", F.floor("ratio").cast("long")).withColumn("x", F.col("ratio") - F.col("whole"))
    of = ["_id", "_th", "size", "whole", "source_size", "target"]
    items = (
        a.filter("x > 0")
        .select("part", "n", F.xxhash64("_id", "_th", "_twin", F.lit(seed)).alias("key"), "x", F.col("size").cast("double").alias("w"), F.struct(*of).alias("p"))
    )
    rounded = pivotal_rounding(items, seed=seed, scratch=scratch, most=targets.agg(F.max("n")).first()[0])
    taken = rounded.select("p.*", (F.col("p.whole") + F.col("x").cast("long")).alias("copies"))
    taken = taken.unionByName(a.filter("x = 0").select(*of, F.col("whole").alias("copies")))
    return taken.select(F.col("_id").alias(id_col), F.col("_th").alias("text_key"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
