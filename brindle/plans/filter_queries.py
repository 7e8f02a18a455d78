"""Filter algebra queries over orders, order lists and event properties."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.predicates import ANY_NULL, DB_NULL, JSON_NULL, UNSET, Field, Json, unique_where, where
from brindle.sources.tables import table

DAY = datetime(1996, 6, 1)


def orders_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a nullable priority, the text low for the lowest."""
    o = table(spark, sf_dir, "orders")
    return o.withColumn("pri", F.nullif("o_orderpriority", F.lit("5-LOW")))


O = "with o as (select *, nullif(o_orderpriority, '5-LOW') as pri from orders) select o_orderkey, o_custkey from o where "


def _orders(spec: dict):
    return lambda spark, d: orders_base(spark, d).filter(where(spec)).select("o_orderkey", "o_custkey")


def lists_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every order the sorted list of its distinct ship flags; empty for those without a line over 45 units."""
    li = table(spark, sf_dir, "lineitem").filter("l_quantity > 30")
    tags = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("tags"))
    o = table(spark, sf_dir, "orders")
    return o.join(tags, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


L = """with l as (select o_orderkey, coalesce(tags, []) as tags from orders left join (select l_orderkey as k, list_sort(list(distinct l_returnflag)) as tags from lineitem where l_quantity > 30 group by 1) on o_orderkey = k)
select o_orderkey from l where """


def _lists(ops):
    return lambda spark, d: lists_base(spark, d).filter(where({"tags": ops})).select("o_orderkey")


def json_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a JSON column that also holds SQL nulls, JSON nulls, nesting and arrays."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    doc = (
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 7 == 1, "null")
        .otherwise(F.concat(F.lit('{"k": '), k.cast("string"), F.lit(', "a": {"b": "'), F.col("event_type"), F.lit('"}, "l": ["'), F.col("event_type"), F.lit('", "x'), (k % 3).cast("string"), F.lit('"]}')))
    )
    return e.select("event_id", doc.alias("j"))


J = """with j as (select event_id, case when event_id % 7 = 0 then null when event_id % 7 = 1 then 'null' else '{"k": ' || (props->>'$.k') || ', "a": {"b": "' || event_type || '"}, "l": ["' || event_type || '", "x' || (cast(props->>'$.k' as int) % 3) || '"]}' end as j from events)
select event_id from j where """


def kinds_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a JSON column of values of many kinds: numbers and the same as texts, booleans, nulls and missing keys."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    k = F.get_json_object("props", "$.k")
    part = F.element_at(F.array(*[F.lit(x) for x in KINDS]), (i % len(KINDS) + 1).cast("int"))
    doc = F.when(i % 11 == 0, F.lit(None).cast("string")).when(i % 11 == 1, "null").otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "s": "'), k, F.lit('", "o": {'), part, F.lit('}, "l": ['), k, F.lit(', "'), k, F.lit('", '), F.when(i % 3 == 0, "true").otherwise('"x", null'), F.lit("]}")))
    return e.select("event_id", doc.alias("j"))


KINDS = ['"f": true', '"f": false', '"f": "true"', '"f": null', "", '"f": 1', '"f": 1.0', '"f": "1"', '"f": [1, "a"]', '"f": {"b": 1, "a": 2}']
V = f"""with v as (select event_id, props->>'$.k' as k, list_extract(['{"', '".join(KINDS)}'], cast(event_id % {len(KINDS)} + 1 as int)) as p from events),
j as (select event_id, case when event_id % 11 = 0 then null when event_id % 11 = 1 then 'null' else
  '{{"k": ' || k || ', "s": "' || k || '", "o": {{' || p || '}}, "l": [' || k || ', "' || k || '", ' || case when event_id % 3 = 0 then 'true' else '"x", null' end || ']}}' end::json as j from v),
x as (select event_id, j, j->'$.o.f' as f, j->'$.l' as l, json_type(j, '$.o.f') as t from j)
select event_id from x where """


def _json(*specs: Json, base=json_base):
    def run(spark, d):
        out = base(spark, d)
        for s in specs:
            out = out.filter(where({"j": s}))
        return out.select("event_id")

    return run


QUERIES = {
    "F1_equals": (_orders({"o_orderstatus": "F"}), O + "o_orderstatus = 'F'"),
    "F1_equals_null": (_orders({"pri": None}), O + "pri is null"),
    "F2_not": (_orders({"pri": {"not": "1-URGENT"}}), O + "not (pri = '1-URGENT')"),
    "F2_not_null": (_orders({"pri": {"not": None}}), O + "pri is not null"),
    "F2_not_nested": (_orders({"o_totalprice": {"not": {"gt": 200000.0}}}), O + "not (o_totalprice > 200000)"),
    "F3_in": (_orders({"pri": {"in": ["1-URGENT", "2-HIGH"]}}), O + "pri in ('1-URGENT', '2-HIGH')"),
    "F3_in_empty": (_orders({"pri": {"in": []}}), O + "false"),
    "F4_not_in": (_orders({"pri": {"notIn": ["1-URGENT", "2-HIGH"]}}), O + "pri not in ('1-URGENT', '2-HIGH')"),
    "F5_range": (_orders({"o_totalprice": {"gte": 100000.0, "lt": 150000.0}, "o_orderdate": {"gt": DAY}}), O + "o_totalprice >= 100000 and o_totalprice < 150000 and o_orderdate > timestamp '1996-06-01'"),
    "F5_text_range": (_orders({"pri": {"lte": "2-HIGH", "gt": "1-URGENT"}}), O + "pri <= '2-HIGH' and pri > '1-URGENT'"),
    "F6_contains": (_orders({"pri": {"contains": "-H"}}), O + "contains(pri, '-H')"),
    "F6_contains_wildcard": (_orders({"pri": {"contains": "_"}}), O + "contains(pri, '_')"),
    "F7_starts_ends": (_orders({"OR": [{"pri": {"startsWith": "3"}}, {"pri": {"endsWith": "GH"}}]}), O + "(starts_with(pri, '3') or ends_with(pri, 'GH'))"),
    "F8_insensitive": (_orders({"pri": {"contains": "urg", "mode": "insensitive"}}), O + "contains(lower(pri), 'urg')"),
    "F8_insensitive_equals": (_orders({"pri": {"equals": "2-high", "mode": "insensitive"}}), O + "lower(pri) = '2-high'"),
    "F9_combinators": (
        _orders({"AND": [{"o_orderstatus": {"in": ["F", "O"]}}, {"NOT": [{"pri": "1-URGENT"}]}], "OR": [{"o_totalprice": {"lt": 50000.0}}, {"o_totalprice": {"gt": 300000.0}}]}),
        O + "o_orderstatus in ('F', 'O') and not (pri = '1-URGENT') and (o_totalprice < 50000 or o_totalprice > 300000)",
    ),
    "F9_empty_or": (_orders({"OR": []}), O + "false"),
    "F9_empty_and_not": (_orders({"AND": [], "NOT": [], "o_orderstatus": "P"}), O + "o_orderstatus = 'P'"),
    "F10_field_ref": (
        lambda s, d: table(s, d, "lineitem").filter(where({"l_discount": {"lt": Field("l_tax")}})).select("l_orderkey", "l_linenumber"),
        "select l_orderkey, l_linenumber from lineitem where l_discount < l_tax",
    ),
    "F11_list_equals": (_lists(["A", "N"]), L + "tags = ['A', 'N']"),
    "F12_list_has": (_lists({"has": "R"}), L + "list_contains(tags, 'R')"),
    "F13_list_has_every": (_lists({"hasEvery": ["A", "R"]}), L + "list_has_all(tags, ['A', 'R'])"),
    "F14_list_has_some": (_lists({"hasSome": ["N", "A"]}), L + "list_has_any(tags, ['N', 'A'])"),
    "F15_list_is_empty": (_lists({"isEmpty": True}), L + "len(tags) = 0"),
    "F15_list_not_empty": (_lists({"isEmpty": False}), L + "len(tags) > 0"),
    "F16_json_path": (_json(Json({"equals": "click"}, ("a", "b"))), J + "j->>'$.a.b' = 'click'"),
    "F16_json_not": (_json(Json({"not": "click"}, ("a", "b"))), J + "not (j->>'$.a.b' = 'click')"),
    "F17_json_string": (_json(Json({"string_starts_with": "P", "mode": "insensitive"}, ("a", "b")), Json({"string_contains": "ur"}, ("a", "b")), Json({"string_ends_with": "se"}, ("a", "b"))), J + "starts_with(j->>'$.a.b', 'p') and contains(j->>'$.a.b', 'ur') and ends_with(j->>'$.a.b', 'se')"),
    "F18_json_array_contains": (_json(Json({"array_contains": "x1"}, ("l",))), J + "list_contains(cast(j->'$.l' as varchar[]), 'x1')"),
    "F19_json_array_ends": (_json(Json({"array_starts_with": "view"}, ("l",)), Json({"array_ends_with": "x2"}, ("l",))), J + "j->>'$.l[0]' = 'view' and j->>'$.l[1]' = 'x2'"),
    "F20_json_range": (_json(Json({"gte": 10, "lt": 40}, ("k",))), J + "cast(j->>'$.k' as double) >= 10 and cast(j->>'$.k' as double) < 40"),
    "F16_json_boolean": (_json(Json({"equals": True}, ("o", "f")), base=kinds_base), V + "f = 'true'"),
    "F16_json_not_boolean": (_json(Json({"not": True}, ("o", "f")), base=kinds_base), V + "f is not null and f <> 'true'"),
    "F16_json_number": (_json(Json({"equals": 1}, ("o", "f")), base=kinds_base), V + "t in ('UBIGINT', 'BIGINT', 'DOUBLE') and cast(f as double) = 1"),
    "F16_json_number_as_text": (_json(Json({"equals": "1"}, ("o", "f")), base=kinds_base), V + "t = 'VARCHAR' and f = '\"1\"'"),
    "F16_json_object": (_json(Json({"equals": {"a": 2, "b": 1}}, ("o", "f")), base=kinds_base), V + "t = 'OBJECT' and cast(f->'$.a' as int) = 2 and cast(f->'$.b' as int) = 1"),
    "F17_json_string_kind": (_json(Json({"string_contains": "1"}, ("o", "f")), base=kinds_base), V + "t = 'VARCHAR' and contains(f->>'$', '1')"),
    "F18_json_array_number": (_json(Json({"array_contains": 7}, ("l",)), base=kinds_base), V + "cast(l->'$[0]' as int) = 7"),
    "F18_json_array_text": (_json(Json({"array_contains": "7"}, ("l",)), base=kinds_base), V + "l->>'$[1]' = '7'"),
    "F18_json_array_several": (_json(Json({"array_contains": ["x", None]}, ("l",)), Json({"array_contains": 7}, ("l",)), base=kinds_base), V + "l->>'$[2]' = 'x' and cast(l->'$[0]' as int) = 7"),
    "F18_json_array_boolean": (_json(Json({"array_contains": True}, ("l",)), base=kinds_base), V + "(l->'$[2]') = 'true'"),
    "F19_json_array_ends_null": (_json(Json({"array_ends_with": None}, ("l",)), base=kinds_base), V + "json_type(l, '$[3]') = 'NULL'"),
    "F20_json_text_range": (_json(Json({"gte": "10", "lt": "40"}, ("s",)), Json({"gte": 10}, ("k",)), base=kinds_base), V + "j->>'$.s' >= '10' and j->>'$.s' < '40' and cast(j->'$.k' as int) >= 10"),
    "F20_json_number_range_of_texts": (_json(Json({"gte": 0}, ("o", "f")), base=kinds_base), V + "t in ('UBIGINT', 'BIGINT', 'DOUBLE') and cast(f as double) >= 0"),
    "F21_json_null_at_path_db": (_json(Json({"equals": DB_NULL}, ("o", "f")), base=kinds_base), V + "t is null"),
    "F21_json_null_at_path_json": (_json(Json({"equals": JSON_NULL}, ("o", "f")), base=kinds_base), V + "t = 'NULL'"),
    "F21_json_null_at_path_any": (_json(Json({"equals": ANY_NULL}, ("o", "f")), base=kinds_base), V + "coalesce(t, 'NULL') = 'NULL'"),
    "F21_json_not_null_at_path": (_json(Json({"not": ANY_NULL}, ("o", "f")), base=kinds_base), V + "t <> 'NULL'"),
    "F21_json_null_db": (_json(Json({"equals": DB_NULL})), J + "j is null"),
    "F21_json_null_json": (_json(Json({"equals": JSON_NULL})), J + "j = 'null'"),
    "F21_json_null_any": (_json(Json({"equals": ANY_NULL})), J + "j is null or j = 'null'"),
    "F22_unique": (
        lambda s, d: orders_base(s, d).filter(unique_where({"o_orderkey": 7, "o_orderstatus": {"in": ["F", "O", "P"]}}, [("o_orderkey",)])).select("o_orderkey", "o_custkey"),
        O + "o_orderkey = 7 and o_orderstatus in ('F', 'O', 'P')",
    ),
    "F23_active_row": (lambda s, d: table(s, d, "part").filter(where({"p_partkey": 11, "p_size": {"gte": 1}})).select("p_partkey", "p_name"), "select p_partkey, p_name from part where p_partkey = 11 and p_size >= 1"),
    "F26_presence": (lambda s, d: table(s, d, "events").filter(where({"event_type": {"notIn": ["error", "signup"]}})).select("event_id"), "select event_id from events where event_type not in ('error', 'signup')"),
    "F27_pattern": (lambda s, d: table(s, d, "conversations").filter(F.col("text").rlike("(?i)error|the")).select("conv_id", "turn"), "select conv_id, turn from conversations where regexp_matches(text, '(?i)error|the')"),
    "F28_unset": (_orders({"pri": UNSET, "o_orderstatus": {"equals": "F", "not": UNSET}}), O + "o_orderstatus = 'F'"),
}
