"""Signal mining on whole tables: authors, demand, estimates, clusters by vectors, near matches in a window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import signals as S
from brindle.plans.stream_queries import PRE, pre
from brindle.sources.tables import table

DAY_S = 86_400
AUTHORS = {"assistant": ["here is", "i can"], "asker": ["?", "how ", "please"], "reporter": ["error", "fail", "broken"]}


def topics(s: SparkSession, d: str) -> DataFrame:
    """Vectors of topics asked for at a time: one every ten minutes, the label as the field."""
    e = table(s, d, "embeddings")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id") * 600)
    return e.select("vec_id", "embedding", "label", at.alias("at"))


def near_topics(s: SparkSession, d: str, least: float) -> DataFrame:
    """Pairs of a topic and an earlier one of its field within a day."""
    t = topics(s, d)
    return S.near_in_window(t, t, "vec_id", "embedding", "at", "label", DAY_S, least)


def reuse(s: SparkSession, d: str) -> DataFrame:
    """A topic costs 5 credits where a near one was answered within a day, of which the most similar is offered, else 50."""
    best = near_topics(s, d, 0.4).groupBy("new_id").agg(F.max_by("old_id", F.struct(F.round("similarity", 9), -F.col("old_id"))).alias("offered"))
    out = topics(s, d).join(best, F.col("vec_id") == F.col("new_id"), "left")
    return out.select("vec_id", "offered", F.when(F.col("offered").isNotNull(), 5).otherwise(50).alias("credits"))


NEAR = """np as (select a.vec_id as new_id, b.vec_id as old_id, list_dot_product(a.embedding::double[], b.embedding::double[]) as sim from embeddings a join embeddings b on a.label = b.label and b.vec_id < a.vec_id and (a.vec_id - b.vec_id) * 600 <= 86400 where list_dot_product(a.embedding::double[], b.embedding::double[]) >= 0.4)"""


def findings(s: SparkSession, d: str) -> DataFrame:
    """Per source: evidence, demand and estimates together, as one JSON text."""
    signals = pre(s, d)
    rolled = S.rollup(signals, "source").select("source", "frequency", "affected")
    tags = S.demand(signals, "source").groupBy(F.col("source").alias("_t")).agg(F.array_sort(F.collect_list(F.struct("tag", "n"))).alias("demand"))
    out = rolled.join(tags, F.col("source").eqNullSafe(F.col("_t")), "left")
    return out.select("source", F.to_json(F.struct("frequency", "affected", F.coalesce("demand", F.array().cast("array<struct<tag:string,n:bigint>>")).alias("demand"))).alias("report"))


TAGS = ", tg as (select source, unnest(string_split(demand_tags, ',')) as tag from pre where demand_tags <> '')"

QUERIES = {
    "J16_near_in_window": (lambda s, d: near_topics(s, d, 0.4).select("new_id", "old_id"), "with " + NEAR + " select new_id, old_id from np"),
    "E12_near_reuse": (reuse, "with " + NEAR + " select vec_id, o as offered, case when o is null then 50 else 5 end as credits from embeddings left join (select new_id, first(old_id order by round(sim, 9) desc, old_id) as o from np group by 1) on new_id = vec_id"),
    "U2_distinct_url": (lambda s, d: table(s, d, "pages").groupBy("url").agg(F.min("page_id").alias("page_id")), "select url, min(page_id) as page_id from pages group by 1"),
    "X19_author_class": (
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", S.author_class(F.col("text"), AUTHORS).alias("author")),
        "select conv_id, turn, case when contains(lower(text), 'here is') or contains(lower(text), 'i can') then 'assistant' when contains(lower(text), '?') or contains(lower(text), 'how ') or contains(lower(text), 'please') then 'asker' when contains(lower(text), 'error') or contains(lower(text), 'fail') or contains(lower(text), 'broken') then 'reporter' else 'unknown' end as author from conversations",
    ),
    "A15_demand": (lambda s, d: S.demand(pre(s, d), "source").select("source", "tag", "n", F.round("share", 9).alias("share")), "with " + PRE + TAGS + " select source, tag, n, round(n / total, 9) as share from (select source, tag, count(*) as n from tg group by 1, 2) join (select source, count(*) as total from pre group by 1) using (source)"),
    "E16_estimates": (
        lambda s, d: S.estimates(pre(s, d), "source").select("source", F.round("market", 9).alias("market"), F.round("competition", 9).alias("competition"), F.round("opportunity", 9).alias("opportunity")),
        "with " + PRE + ", c as (select source, count(*) / (select count(*) from pre) as market, avg(case when demand_tags <> '' then 1.0::double else 0 end) as competition from pre group by 1) select source, round(market, 9) as market, round(competition, 9) as competition, round(market * (1 - competition), 9) as opportunity from c",
    ),
    "E15_nearest_centre": (
        lambda s, d: S.nearest_centre(table(s, d, "embeddings"), "embedding", "label").select("vec_id", "cluster"),
        "with x as (select label, i, avg(embedding[i]::double) as m from embeddings, unnest(range(1, len(embedding) + 1)) t(i) group by 1, 2), c as (select label as centre, list(m order by i) as m from x group by 1) select vec_id, first(centre order by list_dot_product(embedding::double[], m) desc, centre) as cluster from embeddings, c group by 1",
    ),
    "E18_findings": (
        findings,
        "with " + PRE + TAGS + """, r as (select source, count(*) as frequency, list_sort(list(distinct lang)) as affected from pre group by 1), t as (select source, list({'tag': tag, 'n': n} order by tag) as demand from (select source, tag, count(*) as n from tg group by 1, 2) group by 1) select source, to_json({'frequency': frequency, 'affected': affected, 'demand': coalesce(demand, [])})::varchar as report from r left join t using (source)""",
    ),
}
