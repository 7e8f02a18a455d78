"""Signal mining over documents: preprocessing, clusters, scores and a report. Weights and word lists are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTENTS = ("COMPLAINT", "WORKAROUND", "DEMAND", "COMPETITOR", "FAILURE_POST", "FEATURE_REQUEST")


def content_hash(c: Column) -> Column:
    """SHA-256 of the text in lower case with single spaces."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(c), r"[ \t\r\n]+", " ")), 256)


def dedupe(signals: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The row with the smallest key of each content hash. An aggregate, so copies combine before the shuffle."""
    keep = signals.groupBy(content_hash(F.col(text)).alias("content_hash")).agg(F.min(key).alias("_k"))
    return signals.join(keep, F.col(key) == F.col("_k")).drop("_k")


def address(url: Column) -> Column:
    """A URL without fragment and closing slashes, scheme and host in lower case."""
    u = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")
    head = F.regexp_extract(u, "^[^/?]*://[^/?]*", 0)
    return F.concat(F.lower(head), F.substr(u, F.length(head) + 1))


def first_of_url(pages: DataFrame, url: str, key: str) -> DataFrame:
    """The smallest key of each address, and how many pages have it; pages without URL are left out."""
    return pages.filter(F.col(url).isNotNull()).groupBy(address(F.col(url)).alias("address")).agg(F.min(key).alias(key), F.count("*").alias("n"))


def merge_new(old: DataFrame, new: DataFrame, key: str = "content_hash") -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti").dropDuplicates([key]).select(old.columns))


def tags(text: Column, words: dict[str, list[str]]) -> Column:
    """The names whose words occur in the text, in order."""
    lower = F.lower(text)
    hit = [F.when(reduce(lambda a, b: a | b, [lower.contains(w) for w in ws]), name) for name, ws in words.items()]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())


def intensity(text: Column, words: list[str]) -> Column:
    """Share of the words that occur, 0 to 1."""
    lower = F.lower(text)
    return sum((lower.contains(w).cast("int") for w in words), F.lit(0)) / len(words)


def preprocess(docs: DataFrame, labels: DataFrame, priority: dict[str, int], demand: dict[str, list[str]], strong: list[str]) -> DataFrame:
    """One signal per content hash, with what is read off its text. No text is shuffled: copies combine to narrow rows first."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv])[F.col("source")], F.lit(3))
    narrow = docs.select("doc_id", "source", "lang", rank.alias("priority"), tags(F.col("text"), demand).alias("demand_tags"), intensity(F.col("text"), strong).alias("intensity"), content_hash(F.col("text")).alias("content_hash"))
    first = narrow.groupBy("content_hash").agg(F.min_by(F.struct(*[c for c in narrow.columns if c != "content_hash"]), "doc_id").alias("r")).select("r.*", "content_hash")
    return first.join(labels.select(F.col("doc_id").alias("_l"), "quality"), F.col("doc_id") == F.col("_l"), "left").filter("quality is null or quality = 1").select(*narrow.columns)


def rollup(signals: DataFrame, cluster: str) -> DataFrame:
    """frequency, mean intensity, who is affected and the evidence of each cluster."""
    return signals.groupBy(cluster).agg(
        F.count("*").alias("frequency"), F.avg("intensity").alias("intensity"), F.array_sort(F.collect_set("lang")).alias("affected"), F.array_sort(F.collect_set("source")).alias("sources")
    )


def score(clusters: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), high: float = 0.5) -> DataFrame:
    """final score from problem, market and timing (0 to 1), and the quadrant of problem against market."""
    w = weights
    final = w[0] * F.col("problem") + w[1] * F.col("market") + w[2] * F.col("timing")
    quadrant = F.concat(F.when(F.col("problem") >= high, "strong").otherwise("weak"), F.lit("/"), F.when(F.col("market") >= high, "large").otherwise("small"))
    return clusters.withColumn("final", final).withColumn("quadrant", quadrant)


def queries_for(topics: DataFrame, intents: tuple[str, ...] = INTENTS) -> DataFrame:
    """A query for each topic and intent: six rows a topic."""
    return topics.select("topic", F.explode(F.array(*[F.lit(i) for i in intents])).alias("intent")).withColumn("query", F.concat_ws(" ", "topic", F.lower(F.replace("intent", F.lit("_"), F.lit(" ")))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def near_in_window(new: DataFrame, old: DataFrame, key: str, vector: str, at: str, block: str, window_s: int, least: float) -> DataFrame:
    """Pairs (new, old) of one block, at most ``window_s`` seconds apart, old first, whose unit vectors have at least this
    dot product. An equi-join on the block and a piece of time of the window's length: an old row is in its own piece and
    the next, so each pair meets once and only rows of two windows meet."""
    piece = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / window_s)
    a = new.select(F.col(key).alias("new_id"), F.col(vector).alias("_a"), F.col(at).alias("_new_at"), block, piece.alias("_piece"))
    b = old.select(F.col(key).alias("old_id"), F.col(vector).alias("_b"), F.col(at).alias("_old_at"), F.col(block).alias("_block"), F.explode(F.array(piece, piece + 1)).alias("_of"))
    apart = F.unix_seconds(F.col("_new_at").cast("timestamp")) - F.unix_seconds(F.col("_old_at").cast("timestamp"))
    met = a.join(b, (F.col(block) == F.col("_block")) & (F.col("_piece") == F.col("_of"))).filter((F.col("new_id") != F.col("old_id")) & apart.between(0, window_s))
    return met.withColumn("similarity", dot(F.col("_a"), F.col("_b"))).filter(F.col("similarity") >= least).select("new_id", "old_id", "similarity")


def author_class(text: Column, rules: dict[str, list[str]], default: str = "unknown") -> Column:
    """The first class one of whose phrases the text holds."""
    lower, out = F.lower(text), None
    for name, phrases in rules.items():
        hit = reduce(lambda a, b: a | b, [lower.contains(p) for p in phrases])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out, F.lit(default))


def demand(signals: DataFrame, cluster: str) -> DataFrame:
    """How many of a cluster's signals carry each demand tag, and their share."""
    each = signals.select(cluster, F.explode("demand_tags").alias("tag")).groupBy(cluster, "tag").agg(F.count("*").alias("n"))
    total = signals.groupBy(F.col(cluster).alias("_c")).agg(F.count("*").alias("_n"))
    return each.join(total, F.col(cluster).eqNullSafe(F.col("_c"))).select(cluster, "tag", "n", (F.col("n") / F.col("_n")).alias("share"))


def estimates(signals: DataFrame, cluster: str) -> DataFrame:
    """market (share of all signals), competition (share of the cluster's signals that name something in demand) and
    opportunity (market times what is not contested), each 0 to 1."""
    total = signals.agg(F.count("*").alias("_all"))  # one row
    tagged = F.avg(F.when(F.size("demand_tags") > 0, 1.0).otherwise(0.0))
    per = signals.groupBy(cluster).agg(F.count("*").alias("_n"), tagged.alias("competition")).join(F.broadcast(total))
    market = F.col("_n") / F.col("_all")
    return per.select(cluster, market.alias("market"), "competition", (market * (1 - F.col("competition"))).alias("opportunity"))


def centres(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """label, i, m, n: the mean of each component over a label's vectors."""
    each = vectors.filter(F.col(label).isNotNull()).select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    return each.groupBy(label, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))


def nearest_centre(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """vectors with cluster: the label whose mean vector has the largest dot product, of equal ones the smaller label.
    The centres are one array of one row per label, sent to all tasks: more than 10,000 labels are an error."""
    if vectors.select(label).distinct().limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 labels; cluster by near pairs instead")
    parts = vectors.select(F.col(label).alias("_l"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy("_l", "i").agg(F.avg("x").alias("m"))
    centres = parts.groupBy("_l").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m"))
    one = centres.agg(F.array_sort(F.collect_list(F.struct(F.col("_l").alias("l"), "m"))).alias("_centres"))
    scored = F.transform("_centres", lambda c: F.struct(dot(F.col(vector), c["m"]).alias("s"), (-c["l"]).alias("l")))
    return vectors.join(F.broadcast(one)).withColumn("cluster", -F.array_max(scored)["l"]).drop("_centres")


def kmeans(vectors: DataFrame, vector: str, k: int = 10, seed: int = 7, rounds: int = 20) -> DataFrame:
    """cluster: by Spark's own k-means on the vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v", predictionCol="cluster").fit(v).transform(v).drop("_v")


def decide(ideas: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status after decisions (idea_id, action): approve, hold, discard or rerun (back to pending, from phase 5)."""
    d = decisions.select(F.col("idea_id").alias("_i"), "action")
    a = F.col("action")
    status = F.when(a == "approve", "APPROVED").when(a == "hold", "HELD").when(a == "discard", "DISCARDED").when(a == "rerun", "PENDING").otherwise(F.col("status"))
    out = ideas.join(d, F.col("idea_id") == F.col("_i"), "left")
    return out.select("idea_id", status.alias("status"), F.when(a == "rerun", 5).alias("rerun_from"), F.coalesce(a == "approve", F.lit(False)).alias("in_moderation"))


def report(clusters: DataFrame, cluster: str) -> DataFrame:
    """One JSON document per cluster."""
    body = F.to_json(F.struct("frequency", "affected", "sources", "quadrant"))
    return clusters.select(cluster, body.alias("report"))
