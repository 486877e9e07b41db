"""A registered query for each operator, on the given tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..dtypes import nan_to_null, py_literal
from ..operators import aggregate, by_example as examples, calendar, clean, cube, diff, encode, filters, incremental, joins, json_profile, ordering, profile, rolling
from ..operators.filters import FilterSpec
from ..session import shared_folder as scratch
from ..sources import files
from ..streaming import sessions as streamed
from . import recipe
from .recipe import Step

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def add(name: str, f, sql: str | None = None) -> None:
    query(sql, name)(f)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on(name: str, step: Callable[[DataFrame], DataFrame]):
    """A query that applies a step to a table."""
    return lambda spark, sf_dir: step(table(spark, sf_dir, name))


# ---- flagship

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = filters.apply_filters(table(spark, sf_dir, "lineitem"), [FilterSpec("l_shipdate", "gt", "1996-01-01")])
    return aggregate.group_by_agg(items, ["l_returnflag"], "l_quantity", "sum")


add("flagship", flagship, "SELECT l_returnflag, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-01-01' GROUP BY 1")

# ---- view filters

_ITEM = "SELECT * FROM lineitem WHERE "
for _name, _table, _spec, _sql in (
    ("eq", "lineitem", FilterSpec("l_quantity", "eq", "17"), _ITEM + "l_quantity = 17"),
    ("ne", "lineitem", FilterSpec("l_returnflag", "ne", "N"), _ITEM + "l_returnflag <> 'N'"),
    ("gt", "lineitem", FilterSpec("l_shipdate", "gt", "852076800000"), _ITEM + "l_shipdate > TIMESTAMP '1997-01-01'"),
    ("gte", "lineitem", FilterSpec("l_linenumber", "gte", "5"), _ITEM + "l_linenumber >= 5"),
    ("lt", "lineitem", FilterSpec("l_discount", "lt", "0.05"), _ITEM + "l_discount < 0.05"),
    ("lte", "part", FilterSpec("p_brand", "lte", "Brand#22"), "SELECT * FROM part WHERE p_brand <= 'Brand#22'"),
    ("contains", "part", FilterSpec("p_name", "contains", "RE", True), "SELECT * FROM part WHERE contains(lower(p_name), 're')"),
    ("starts_with", "pages", FilterSpec("url", "starts_with", "https://m."), "SELECT * FROM pages WHERE starts_with(url, 'https://m.')"),
    ("ends_with", "pages", FilterSpec("url", "ends_with", "#TOP", True), "SELECT * FROM pages WHERE ends_with(lower(url), '#top')"),
    ("regex", "pages", FilterSpec("url", "regex", r"/EN/\d+(/|$)", True), r"SELECT * FROM pages WHERE regexp_matches(url, '/EN/\d+(/|$)', 'i')"),
    ("is_duplicated", "orders", FilterSpec("o_totalprice", "is_duplicated"), "SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY o_totalprice) AS n FROM orders) WHERE n > 1"),
    ("is_unique", "orders", FilterSpec("o_totalprice", "is_unique"), "SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY o_totalprice) AS n FROM orders) WHERE n = 1"),
):
    add(f"filter_{_name}", on(_table, lambda df, s=_spec: filters.apply_filters(df, [s])), _sql)

_GAPPED = "(SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority) FROM orders)"


def _gapped(df: DataFrame) -> DataFrame:
    return df.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))


add("filter_is_missing", on("orders", lambda df: filters.apply_filters(_gapped(df), [FilterSpec("o_orderpriority", "is_missing")])), f"SELECT * FROM {_GAPPED} WHERE o_orderpriority IS NULL")
add("filter_is_not_missing", on("orders", lambda df: filters.apply_filters(_gapped(df), [FilterSpec("o_orderpriority", "is_not_missing")])), f"SELECT * FROM {_GAPPED} WHERE o_orderpriority IS NOT NULL")
_LIST = [FilterSpec("o_orderstatus", "ne", "F"), FilterSpec("o_custkey", "is_duplicated"), FilterSpec("o_totalprice", "gt", "100000")]
_LIST_SQL = "(SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1 AND o_orderstatus <> 'F' AND o_totalprice > 100000)"
add("apply_filters", on("orders", lambda df: filters.apply_filters(df, _LIST)), f"SELECT * FROM {_LIST_SQL}")
add("filter_quick_merge", on("orders", lambda df: filters.apply_filters(df, filters.quick_merge(filters.quick_merge(_LIST, FilterSpec("o_custkey", "is_unique")), _LIST[0]))), "SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n = 1 AND o_orderstatus <> 'F' AND o_totalprice > 100000")
add("filter_step_equals", on("part", lambda df: filters.filter_step(df, "p_size", "equals", "7")), "SELECT * FROM part WHERE p_size = 7")
add("filter_step_not_equals", on("orders", lambda df: filters.filter_step(_gapped(df), "o_orderpriority", "not_equals", "1-URGENT")), f"SELECT * FROM {_GAPPED} WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'")
add("filter_step_greater_than", on("orders", lambda df: filters.filter_step(df, "o_totalprice", "greater_than", "250000.5")), "SELECT * FROM orders WHERE o_totalprice > 250000.5")
add("filter_step_less_than", on("orders", lambda df: filters.filter_step(df, "o_custkey", "less_than", "20")), "SELECT * FROM orders WHERE o_custkey < 20")
add("filter_step_contains", on("part", lambda df: filters.filter_step(df, "p_name", "contains", "e")), "SELECT * FROM part WHERE contains(p_name, 'e')")
add("filter_step_starts_with", on("part", lambda df: filters.filter_step(df, "p_type", "starts_with", "S")), "SELECT * FROM part WHERE starts_with(p_type, 'S')")
add("filter_step_ends_with", on("part", lambda df: filters.filter_step(df, "p_type", "ends_with", "L")), "SELECT * FROM part WHERE ends_with(p_type, 'L')")
add("filter_step_is_missing", on("orders", lambda df: filters.filter_step(_gapped(df), "o_orderpriority", "is_missing")), f"SELECT * FROM {_GAPPED} WHERE o_orderpriority IS NULL")
add("filter_step_is_not_missing", on("orders", lambda df: filters.filter_step(_gapped(df), "o_orderpriority", "is_not_missing")), f"SELECT * FROM {_GAPPED} WHERE o_orderpriority IS NOT NULL")
add("filter_step_is_duplicated", on("orders", lambda df: filters.filter_step(_gapped(df), "o_orderpriority", "is_duplicated")), f"SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM {_GAPPED}) WHERE n > 1")
add("filter_step_is_unique", on("documents", lambda df: filters.filter_step(df, "text", "is_unique")), "SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1")

# ---- order, pages, positions, search

_POS = "(row_number() OVER (ORDER BY {}) - 1)"


def _placed(df: DataFrame, keys) -> DataFrame:
    return ordering.row_position(df, keys)


add("sort_rows", on("orders", lambda df: _placed(ordering.sort_rows(_gapped(df), [("o_orderpriority", True)], ["o_orderkey"]), [("o_orderpriority", True), "o_orderkey"]).select("o_orderkey", "o_orderpriority", "row_position")), f"SELECT o_orderkey, o_orderpriority, {_POS.format('o_orderpriority DESC NULLS LAST, o_orderkey')} AS row_position FROM {_GAPPED}")
add("sort_step", on("part", lambda df: ordering.page(ordering.sort_step(df, ["p_brand", "p_size"], False, ["p_partkey"]), [("p_brand", True), ("p_size", True), "p_partkey"], 0, 100)), "SELECT * FROM part ORDER BY p_brand DESC, p_size DESC, p_partkey LIMIT 100")
add("view", on("orders", lambda df: ordering.view(df, _LIST, ["o_totalprice"], ["o_orderkey"])), f"SELECT * FROM {_LIST_SQL}")
add("page", on("events", lambda df: ordering.page(df, [("value", True), "event_id"], 500)), "SELECT * FROM events ORDER BY value DESC, event_id LIMIT 500 OFFSET 500")
add("page_deep", on("events", lambda df: ordering.page_by_position(df, ["ts"], 700, 950)), "SELECT * FROM events ORDER BY ts LIMIT 250 OFFSET 700")
add("with_row_id", on("orders", lambda df: ordering.with_row_id(df, ["o_orderkey"], "row_id").select("o_orderkey", "row_id")), f"SELECT o_orderkey, {_POS.format('o_orderkey')} AS row_id FROM orders")
add("row_position", on("part", lambda df: _placed(df, [("p_retailprice", True), "p_partkey"]).select("p_partkey", "row_position")), f"SELECT p_partkey, {_POS.format('p_retailprice DESC, p_partkey')} AS row_position FROM part")
add("search_values", on("part", lambda df: ordering.search_values(df, "p_name", "An", ["p_partkey"])), f"SELECT row_position FROM (SELECT p_name, {_POS.format('p_partkey')} AS row_position FROM part) WHERE contains(lower(p_name), 'an')")
add("search_values_date", on("orders", lambda df: ordering.search_values(df, "o_orderdate", "1995-03", ["o_orderkey"])), f"SELECT row_position FROM (SELECT o_orderdate, {_POS.format('o_orderkey')} AS row_position FROM orders) WHERE contains(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '1995-03')")
add("view_row_count", on("orders", lambda df: ordering.view_row_count(df, _LIST)), f"SELECT (SELECT count(*) FROM {_LIST_SQL}) AS rows, (SELECT count(*) FROM orders) AS total_rows")

# ---- rows and columns

_EVENTS = "(SELECT * REPLACE (CASE WHEN value >= 20 THEN value END AS value) FROM events)"


def _holes(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.when(F.col("value") >= 20, F.col("value")))


add("py_literal", on("part", lambda df: df.filter(F.col("p_size") > F.lit(py_literal("25"))).select("p_partkey", F.lit(py_literal("1e2")).alias("number"), F.lit(py_literal("True")).alias("flag"), F.lit(py_literal(" 5")).alias("padded"))), "SELECT p_partkey, 100.0::DOUBLE AS number, true AS flag, ' 5' AS padded FROM part WHERE p_size > 25")
add("select_columns", on("orders", lambda df: clean.select_columns(df, ["o_totalprice", "o_orderkey"])), "SELECT o_totalprice, o_orderkey FROM orders")
add("drop_column", on("orders", lambda df: clean.drop_column(df, ["o_orderstatus", "o_orderdate"])), "SELECT * EXCLUDE (o_orderstatus, o_orderdate) FROM orders")
add("rename_column", on("orders", lambda df: clean.rename_column(df, "o_custkey", "customer")), "SELECT * RENAME (o_custkey AS customer) FROM orders")
add("clone_column", on("orders", lambda df: clean.clone_column(df, "o_totalprice")), "SELECT *, o_totalprice AS o_totalprice_copy FROM orders")
add("formula_column", on("lineitem", lambda df: clean.formula_column(df, "net", "l_extendedprice * (1 - l_discount)").select("l_orderkey", "l_linenumber", "net")), "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
add("change_type_int64", on("lineitem", lambda df: clean.change_type(df, "l_discount", "int64").select("l_orderkey", "l_linenumber", "l_discount")), "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = floor(l_discount) THEN l_discount::BIGINT END AS l_discount FROM lineitem")
add("change_type_float64", on("customer", lambda df: clean.change_type(df.withColumn("c_name", F.right("c_name", F.lit(6))), "c_name", "float64")), "SELECT * REPLACE (try_cast(right(c_name, 6) AS DOUBLE) AS c_name) FROM customer")
add("change_type_string", on("orders", lambda df: clean.change_type(df, "o_orderkey", "string")), "SELECT * REPLACE (o_orderkey::VARCHAR AS o_orderkey) FROM orders")
add("change_type_boolean", on("events", lambda df: clean.change_type(df.withColumn("event_type", F.when(F.col("event_type") == "click", "yes").when(F.col("event_type") == "view", "0").otherwise(F.col("event_type"))), "event_type", "boolean")), "SELECT * REPLACE (CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS event_type) FROM events")
add("change_type_datetime", on("orders", lambda df: clean.change_type(df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")), "o_orderdate", "datetime")), "SELECT * FROM orders")
add("drop_missing", on("events", lambda df: clean.drop_missing(_holes(df), ["value"])), f"SELECT * FROM {_EVENTS} WHERE value IS NOT NULL")
add("drop_missing_all", on("events", lambda df: clean.drop_missing(_holes(df).withColumn("props", F.when(F.col("user_id") > 75, F.col("props"))), ["value", "props"], "all")), f"SELECT * FROM (SELECT * REPLACE (CASE WHEN user_id > 75 THEN props END AS props) FROM {_EVENTS}) WHERE value IS NOT NULL OR props IS NOT NULL")
for _keep, _sql in (("first", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1"), ("last", "row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1"), ("none", "count(*) OVER (PARTITION BY user_id, event_type) = 1")):
    add(f"drop_duplicates_{_keep}", on("events", lambda df, k=_keep: clean.drop_duplicates(df, ["user_id", "event_type"], k, "event_id")), f"SELECT * FROM events QUALIFY {_sql}")
add("fill_missing_value", on("events", lambda df: clean.fill_missing(_holes(df), "value", "value", "0")), f"SELECT * REPLACE (coalesce(value, 0) AS value) FROM {_EVENTS}")
add("fill_missing_mean", on("events", lambda df: clean.fill_missing(_holes(df), "value", "mean").withColumn("value", F.round("value", 4))), f"SELECT * REPLACE (round(coalesce(value, (SELECT avg(value) FROM {_EVENTS})), 4) AS value) FROM {_EVENTS}")
add("fill_missing_median", on("events", lambda df: clean.fill_missing(_holes(df), "value", "median").withColumn("value", F.round("value", 4))), f"SELECT * REPLACE (round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {_EVENTS})), 4) AS value) FROM {_EVENTS}")
add("fill_missing_mode", on("orders", lambda df: clean.fill_missing(_gapped(df), "o_orderpriority", "mode")), f"SELECT * REPLACE (coalesce(o_orderpriority, (SELECT o_orderpriority FROM {_GAPPED} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority) FROM {_GAPPED}")
add("fill_missing_ffill", on("events", lambda df: clean.fill_missing(_holes(df), "value", "ffill", order_by="ts")), f"SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value) FROM {_EVENTS}")
add("fill_missing_bfill", on("events", lambda df: clean.fill_missing(_holes(df), "value", "bfill", order_by="ts")), f"SELECT * REPLACE (first_value(value IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value) FROM {_EVENTS}")
add("fill_missing_ffill_by_user", on("events", lambda df: clean.fill_missing(_holes(df), "value", "ffill", order_by="ts", partition_by=["user_id"])), f"SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value) FROM {_EVENTS}")
add("find_replace", on("part", lambda df: clean.find_replace(df, "p_name", "a", "(.)")), "SELECT * REPLACE (replace(p_name, 'a', '(.)') AS p_name) FROM part")
add("find_replace_regex", on("pages", lambda df: clean.find_replace(df, "url", r"^(https?)://([^/]+)", r"\2 by \1", True).select("page_id", "url")), r"SELECT page_id, regexp_replace(url, '^(https?)://([^/]+)', '\2 by \1', 'g') AS url FROM pages")

# ---- text, numbers, encodings

_PAD = "chr(9) || ' ' || p_name || chr(160) || chr(10)"


def _padded(df: DataFrame) -> DataFrame:
    return df.select("p_partkey", F.concat(F.lit("\t "), F.col("p_name"), F.lit("\xa0\n")).alias("p_name"))


for _name, _step, _sql in (
    ("strip_whitespace", clean.strip_whitespace, "p_name"),
    ("lowercase", clean.lowercase, "lower(p_name)"),
    ("uppercase", clean.uppercase, "upper(p_name)"),
    ("capitalize", clean.capitalize, "upper(p_name[1]) || lower(p_name[2:])"),
    ("title_case", clean.title_case, "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"),
):
    add(_name, on("part", lambda df, s=_step: s(_padded(df), "p_name")), f"SELECT p_partkey, {_sql} AS p_name FROM part")
add("calc_text_length", on("documents", lambda df: clean.calc_text_length(df, "text").select("doc_id", "text_length")), "SELECT doc_id, length(text) AS text_length FROM documents")
add("split_text", on("part", lambda df: clean.split_text(df, "p_name", " ").select("p_partkey", "p_name_1", "p_name_2")), "SELECT p_partkey, string_split(p_name, ' ')[1] AS p_name_1, string_split(p_name, ' ')[2] AS p_name_2 FROM part")
add("split_text_limited", on("documents", lambda df: clean.split_text(df, "text", ".", 1).select("doc_id", "text_1", "text_2")), "SELECT doc_id, split_part(text, '.', 1) AS text_1, CASE WHEN contains(text, '.') THEN substr(text, instr(text, '.') + 1) END AS text_2 FROM documents")
add("scale_min_max", on("lineitem", lambda df: clean.scale_min_max(df, "l_extendedprice", -1, 1).select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 6).alias("scaled"))), "SELECT l_orderkey, l_linenumber, round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / ((SELECT max(l_extendedprice) FROM lineitem) - (SELECT min(l_extendedprice) FROM lineitem)) * 2 - 1, 6) AS scaled FROM lineitem")
add("round", on("lineitem", lambda df: clean.round_column(df, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")), "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice, 0) AS l_extendedprice FROM lineitem")
add("floor", on("lineitem", lambda df: clean.floor_column(df, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")), "SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS l_extendedprice FROM lineitem")
add("ceiling", on("lineitem", lambda df: clean.ceiling_column(df, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")), "SELECT l_orderkey, l_linenumber, ceil(l_extendedprice) AS l_extendedprice FROM lineitem")
for _name, _step in (("floor", clean.floor_column), ("ceiling", clean.ceiling_column)):
    add(f"{_name}_large", on("lineitem", lambda df, f=_step: f(df.withColumn("l_extendedprice", F.col("l_extendedprice") * F.pow(F.lit(10.0), 4 * F.col("l_linenumber"))), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice")), f"SELECT l_orderkey, l_linenumber, {_name.replace('ceiling', 'ceil')}(l_extendedprice * pow(10.0, 4 * l_linenumber)) AS l_extendedprice FROM lineitem")
add("one_hot_encode", on("orders", lambda df: encode.one_hot_encode(_gapped(df).select("o_orderkey", "o_orderpriority"), "o_orderpriority")), f"""SELECT o_orderkey, coalesce(o_orderpriority = '1-URGENT', false) AS "o_orderpriority_1-URGENT", coalesce(o_orderpriority = '2-HIGH', false) AS "o_orderpriority_2-HIGH", coalesce(o_orderpriority = '3-MEDIUM', false) AS "o_orderpriority_3-MEDIUM", coalesce(o_orderpriority = '4-NOT SPECIFIED', false) AS "o_orderpriority_4-NOT SPECIFIED" FROM {_GAPPED}""")
add("multi_label_binarizer", on("lineitem", lambda df: encode.multi_label_binarizer(df.select("l_orderkey", "l_linenumber", F.concat_ws(",", "l_returnflag", "l_linestatus").alias("tags")), "tags")), """SELECT l_orderkey, l_linenumber, l_returnflag || ',' || l_linestatus AS tags, (l_returnflag = 'A')::INT AS "A", (l_linestatus = 'F')::INT AS "F", (l_returnflag = 'N')::INT AS "N", (l_linestatus = 'O')::INT AS "O", (l_returnflag = 'R')::INT AS "R" FROM lineitem""")
add("by_example", on("customer", lambda df: examples.by_example(df, "c_name", "number", [("Customer#000000001", "00000001"), ("Customer#123456789", "23456789")]).select("c_custkey", "number")), "SELECT c_custkey, right(c_name, 8) AS number FROM customer")
add("by_example_lower", on("nation", lambda df: examples.by_example(df, "n_name", "small", [("FRANCE", "france"), ("PERU", "peru")])), "SELECT *, lower(n_name) AS small FROM nation")
add("by_example_part", on("part", lambda df: examples.by_example(df, "p_name", "last", [("a bc", "bc"), ("de f", "f")]).select("p_partkey", "last")), "SELECT p_partkey, string_split(p_name, ' ')[-1] AS last FROM part")

# ---- aggregates

for _how, _sql in (("sum", "round(sum(l_extendedprice), 2)"), ("mean", "round(avg(l_extendedprice), 4)"), ("median", "round(quantile_cont(l_extendedprice, 0.5), 4)"), ("count", "count(l_extendedprice)"), ("min", "min(l_extendedprice)"), ("max", "max(l_extendedprice)"), ("std", "round(stddev_samp(l_extendedprice), 4)")):
    _digits = {"sum": 2, "mean": 4, "median": 4, "std": 4}.get(_how)
    _round = (lambda df, d=_digits: df.withColumn("l_extendedprice", F.round("l_extendedprice", d))) if _digits else (lambda df: df)
    add(f"group_by_agg_{_how}", on("lineitem", lambda df, h=_how, r=_round: r(aggregate.group_by_agg(df, ["l_returnflag", "l_linestatus"], "l_extendedprice", h))), f"SELECT l_returnflag, l_linestatus, {_sql} AS l_extendedprice FROM lineitem GROUP BY 1, 2")
add("group_by_agg_median_datetime", on("orders", lambda df: aggregate.group_by_agg(df, ["o_orderstatus"], "o_orderdate", "median")), "SELECT o_orderstatus, make_timestamp(quantile_cont(epoch_us(o_orderdate), 0.5)::BIGINT) AS o_orderdate FROM orders GROUP BY 1")
add("count_distinct", on("events", lambda df: aggregate.count_distinct(_holes(df), "value")), f"SELECT count(DISTINCT value) AS distinct_count FROM {_EVENTS}")

# ---- profile

_NUMBERS = [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"), ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float")]
_STATS = ("min", "max", "mean", "std_pop", "std_samp", "sum", "p25", "p50", "p75")


def _stats_sql() -> str:
    """SQL for the rounded ``column_stats`` of lineitem."""
    rows = []
    for c, kind in _NUMBERS:
        v = f"{c}::DOUBLE"
        rows.append(f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count({c}) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", round(min({v}), 3) AS min, round(max({v}), 3) AS max, round(avg({v}), 3) AS mean, round(stddev_pop({v}), 3) AS std_pop, round(stddev_samp({v}), 3) AS std_samp, round(sum({v}), 1) AS sum, round(quantile_cont({v}, 0.25), 3) AS p25, round(quantile_cont({v}, 0.5), 3) AS p50, round(quantile_cont({v}, 0.75), 3) AS p75, NULL AS top_value, NULL::BIGINT AS top_count FROM lineitem")
    for c in ("l_returnflag", "l_linestatus"):
        top = f"(SELECT {{}} FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        rows.append(f"SELECT '{c}', 'string', count({c}), count(*) - count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {top.format(c)}, {top.format('count(*)')} FROM lineitem")
    rows.append("SELECT 'l_shipdate', 'datetime', count(l_shipdate), count(*) - count(l_shipdate), count(DISTINCT l_shipdate), epoch_ms(min(l_shipdate))::DOUBLE, epoch_ms(max(l_shipdate))::DOUBLE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem")
    return " UNION ALL ".join(rows)


add("column_stats", on("lineitem", lambda df: profile.column_stats(df).withColumns({c: F.round(c, 1 if c == "sum" else 3) for c in _STATS})), _stats_sql())
add("top_n", on("events", lambda df: profile.top_n(df, "user_id", 10)), "SELECT user_id::VARCHAR AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10")


def _bins_sql(source: str, value: str, column: str | None = None) -> str:
    named = f"'{column}' AS \"column\", " if column else ""
    return f"""(WITH v AS (SELECT ({value})::DOUBLE AS v FROM {source} WHERE {value} IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
c AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 12)), 11) END::INT AS bin, count(*) AS n FROM v, e GROUP BY 1)
SELECT {named}b.bin, round(lo + b.bin * ((hi - lo) / 12), 3) AS lower, round(CASE WHEN hi = lo OR b.bin = 11 THEN hi ELSE lo + (b.bin + 1) * ((hi - lo) / 12) END, 3) AS upper, coalesce(n, 0) AS n
FROM e, (SELECT unnest(range(12))::INT AS bin) b LEFT JOIN c ON c.bin = b.bin WHERE hi > lo OR b.bin = 0)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 3) for c in ("lower", "upper")})


add("histogram", on("lineitem", lambda df: _rounded(profile.histogram(df, "l_extendedprice"))), f"SELECT * FROM {_bins_sql('lineitem', 'l_extendedprice')}")
add("histogram_datetime", on("orders", lambda df: _rounded(profile.histogram(df, "o_orderdate"))), f"SELECT * FROM {_bins_sql('orders', 'epoch_ms(o_orderdate)')}")


def _insights_sql() -> str:
    """SQL for the rounded ``quick_insights`` of orders with gaps."""
    out = []
    for c, kind, value in (("o_orderkey", "integer", "o_orderkey"), ("o_custkey", "integer", "o_custkey"), ("o_totalprice", "float", "o_totalprice"), ("o_orderdate", "datetime", "epoch_ms(o_orderdate)")):
        out.append(f"SELECT '{c}' AS \"column\", '{kind}' AS kind, (SELECT count(*) - count({c}) FROM {_GAPPED}) AS missing, (SELECT count(DISTINCT {c}) FROM {_GAPPED}) AS \"distinct\", bin AS slot, NULL::VARCHAR AS value, lower, upper, n FROM {_bins_sql(_GAPPED, value)}")
    for c in ("o_orderstatus", "o_orderpriority"):
        out.append(f"SELECT * FROM (SELECT '{c}', 'string', (SELECT count(*) - count({c}) FROM {_GAPPED}), (SELECT count(DISTINCT {c}) FROM {_GAPPED}), (row_number() OVER (ORDER BY count(*) DESC, {c}) - 1)::INT AS slot, {c} AS value, NULL::DOUBLE, NULL::DOUBLE, count(*) AS n FROM {_GAPPED} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE slot < 5")
    return " UNION ALL ".join(out)


add("quick_insights", on("orders", lambda df: _rounded(profile.quick_insights(_gapped(df)))), _insights_sql())
add("value_domain", on("orders", lambda df: profile.value_domain(_gapped(df))), f"SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM {_GAPPED} WHERE o_orderpriority IS NOT NULL GROUP BY 2")
add("completeness", on("orders", lambda df: profile.completeness(_gapped(df)).withColumn("complete_pct", F.round("complete_pct", 4))), f"SELECT count(*) * 6 AS cells, count(*) - count(o_orderpriority) AS missing_cells, round(100.0 * (count(*) * 6 - (count(*) - count(o_orderpriority))) / (count(*) * 6), 4) AS complete_pct, CASE WHEN complete_pct >= 95 THEN 'high' WHEN complete_pct >= 80 THEN 'medium' ELSE 'low' END AS band FROM {_GAPPED}")


def _quality_sql() -> str:
    out = []
    for c, kind in (("event_id", "integer"), ("user_id", "integer"), ("value", "float"), ("event_type", "string")):
        miss, uniq = f"100.0 * (count(*) - count({c})) / count(*)", f"100.0 * count(DISTINCT {c}) / count({c})"
        top = f"(SELECT {c} FROM {_EVENTS} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" if kind == "string" else "NULL"
        head = "avg(" + c + ")" if kind != "string" else uniq
        out.append(f"SELECT '{c}' AS \"column\", '{kind}' AS kind, round({miss}, 3) AS missing_pct, round({uniq}, 3) AS unique_pct, {miss} >= 10 AS missing_10, {miss} >= 20 AS missing_20, count({c}) = 0 AS all_missing, CASE WHEN {miss} >= 20 THEN 'missing' WHEN '{kind}' <> 'string' THEN 'mean' ELSE 'unique' END AS headline, round(CASE WHEN {miss} >= 20 THEN {miss} ELSE {head} END, 3) AS headline_value, {top} AS top_value FROM {_EVENTS}")
    return " UNION ALL ".join(out)


add("quality_report", on("events", lambda df: profile.quality_report(_holes(df).select("event_id", "user_id", "value", "event_type")).withColumns({c: F.round(c, 3) for c in ("missing_pct", "unique_pct", "headline_value")})), _quality_sql())

# ---- diff, preview, recipe


def _marked(df: DataFrame) -> DataFrame:
    return clean.fill_missing(clean.lowercase(df, "o_orderstatus"), "o_orderpriority", "value", "none").withColumn("extra", F.lit(1))


add("diff_summary", on("orders", lambda df: diff.diff_summary(_gapped(df), clean.drop_column(_marked(_gapped(df)), "o_orderdate"), ["o_orderkey"])), f"SELECT 0::BIGINT AS rows_added, 0::BIGINT AS rows_removed, (SELECT count(*) FROM orders) + (SELECT count(*) FROM {_GAPPED} WHERE o_orderpriority IS NULL) AS cells_changed, 'extra' AS columns_added, 'o_orderdate' AS columns_removed")
add("diff_summary_rows", on("orders", lambda df: diff.diff_summary(df, filters.apply_filters(df, _LIST), ["o_orderkey"])), f"SELECT 0::BIGINT AS rows_added, (SELECT count(*) FROM orders) - (SELECT count(*) FROM {_LIST_SQL}) AS rows_removed, 0::BIGINT AS cells_changed, '' AS columns_added, '' AS columns_removed")
add("diff_of_row_step", on("part", lambda df: diff.diff_of_row_step(df, {"p_type": F.lower("p_type"), "p_brand": F.replace("p_brand", F.lit("#1"), F.lit("-1")), "new": F.lit(0)})), "SELECT 0::BIGINT AS rows_added, 0::BIGINT AS rows_removed, count(*) FILTER (p_type <> lower(p_type)) + count(*) FILTER (contains(p_brand, '#1')) AS cells_changed, 'new' AS columns_added, '' AS columns_removed FROM part")
add("changed_cells", on("orders", lambda df: diff.changed_cells(_gapped(df), _marked(_gapped(df)), ["o_orderkey"])), f"SELECT o_orderkey, 'o_orderstatus' AS \"column\", o_orderstatus AS old_value, lower(o_orderstatus) AS new_value FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', NULL, 'none' FROM {_GAPPED} WHERE o_orderpriority IS NULL")


def _preview(df: DataFrame) -> DataFrame:
    rows, summary = diff.preview(df, lambda d: clean.lowercase(d, "o_orderstatus"), ["o_orderkey"], ["o_orderkey"], 0, 50)
    return rows.select("o_orderkey", "o_orderstatus").crossJoin(F.broadcast(summary.select("cells_changed")))


add("preview", on("orders", _preview), "SELECT o_orderkey, lower(o_orderstatus) AS o_orderstatus, (SELECT count(*) FROM orders) AS cells_changed FROM orders ORDER BY o_orderkey LIMIT 50")
_STEPS = [Step("drop_missing", {"columns": ["value"]}, "a"), Step("uppercase", {"columns": "event_type"}, "b"), Step("round", {"column": "value"}, "c"), Step("filter", {"column": "user_id", "condition": "less_than", "value": "50"}, "d")]
add("apply_recipe", on("events", lambda df: recipe.apply_recipe(_holes(df), recipe.from_json(recipe.to_json(_STEPS)))), f"SELECT * REPLACE (upper(event_type) AS event_type, round_even(value, 0) AS value) FROM {_EVENTS} WHERE value IS NOT NULL AND user_id < 50")
add("undo_step", on("events", lambda df: recipe.apply_recipe(_holes(df), recipe.undo_step(_STEPS, "b"))), f"SELECT * REPLACE (round_even(value, 0) AS value) FROM {_EVENTS} WHERE value IS NOT NULL AND user_id < 50")
add("custom", on("events", lambda df: recipe.custom(df, "SELECT event_type, count(*) AS n FROM {df} GROUP BY event_type")), "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
add("custom_callable", on("events", lambda df: recipe.custom(df, lambda d: d.filter(F.col("value") > 50).select("event_id"))), "SELECT event_id FROM events WHERE value > 50")

# ---- differences without a key, joins by time and overlap, sliding frames


def _copied(df: DataFrame) -> DataFrame:
    """Orders by customer and priority, some of them again, some changed, some gone."""
    few = df.select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return few.unionByName(few.filter("o_custkey % 10 = 0")).withColumn("o_orderstatus", F.when(F.col("o_custkey") % 7 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))).filter("o_custkey % 11 <> 0")


_PLAIN_SQL = "SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders"
_COPIED_SQL = f"SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM (FROM ({_PLAIN_SQL}) UNION ALL SELECT * FROM ({_PLAIN_SQL}) WHERE o_custkey % 10 = 0) WHERE o_custkey % 11 <> 0"
add("row_difference", on("orders", lambda df: diff.row_difference(df.select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority")), _copied(df))), f"SELECT o_custkey, o_orderstatus, o_orderpriority, sum(a)::BIGINT AS n_before, sum(1 - a)::BIGINT AS n_after FROM (SELECT *, 1 AS a FROM ({_PLAIN_SQL}) UNION ALL SELECT *, 0 FROM ({_COPIED_SQL})) GROUP BY 1, 2, 3 HAVING sum(a) <> sum(1 - a)")
_SIDES = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts"


def _as_of(**options):
    """Purchases beside a view of the same user."""
    return on("events", lambda df: joins.as_of_join(df.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), df.filter("event_type = 'view'").select("event_id", "user_id", "ts", "value"), "ts", by=["user_id"], **options))


add("as_of_join", _as_of(), f"SELECT l.*, r.event_id AS event_id_right, r.ts AS ts_right, r.value FROM {_SIDES} >= r.ts")
add("as_of_join_forward", _as_of(direction="forward", exact=False, tolerance=86400.0), f"SELECT event_id, user_id, ts, CASE WHEN near THEN event_id_right END AS event_id_right, CASE WHEN near THEN ts_right END AS ts_right, CASE WHEN near THEN value END AS value FROM (SELECT l.*, r.event_id AS event_id_right, r.ts AS ts_right, r.value, epoch_us(r.ts) - epoch_us(l.ts) <= 86400000000 AS near FROM {_SIDES} < r.ts)")


@query("SELECT o.o_orderkey, o.o_custkey, p.o_orderkey AS o_orderkey_right, p.o_orderdate AS o_orderdate_right FROM orders o LEFT JOIN LATERAL (SELECT o_orderkey, o_orderdate FROM orders q WHERE q.o_custkey = o.o_custkey AND q.o_orderdate < o.o_orderdate ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) p ON TRUE")
def as_of_join_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order beside the customer's last one of an earlier day; of several on that day the one of the largest key."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return joins.as_of_join(df, df, "o_orderdate", by=["o_custkey"], exact=False, ties=["o_orderkey"]).drop("o_orderdate")


@query("SELECT a.o_orderkey, b.o_orderkey AS o_orderkey_right FROM orders a JOIN orders b ON a.o_orderpriority = b.o_orderpriority AND a.o_orderdate < b.o_orderdate + INTERVAL 1 DAY * (1 + b.o_custkey % 3) AND b.o_orderdate < a.o_orderdate + INTERVAL 1 DAY * (CASE WHEN a.o_orderkey % 500 = 0 THEN 900 ELSE 1 + a.o_custkey % 2 END) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P'")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders of a priority that run while others do: days, and a few that run for years."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate", "o_custkey")
    days = lambda n: F.col("o_orderdate") + F.make_dt_interval(n)
    a = df.filter("o_orderstatus = 'F'").withColumn("until", days(F.when(F.col("o_orderkey") % 500 == 0, 900).otherwise(1 + F.col("o_custkey") % 2).cast("int")))
    b = df.filter("o_orderstatus = 'P'").withColumn("until", days((1 + F.col("o_custkey") % 3).cast("int")))
    a, b = (x.select("o_orderkey", "o_orderpriority", "o_orderdate", "until") for x in (a, b))
    return joins.overlap_join(a, b, ("o_orderdate", "until"), by=["o_orderpriority"]).select("o_orderkey", "o_orderkey_right")


add("rolling_median_rows", on("events", lambda df: rolling.rolling_quantiles(_holes(df).select("event_id", "user_id", "ts", "value"), "value", "ts", [0.5, 0.9], ["user_id"], rows=20).withColumns({c: F.round(c, 6) for c in ("value_q50", "value_q90")})), 'SELECT event_id, user_id, ts, value, round(quantile_cont(value, 0.5) OVER w, 6) AS "value_q50", round(quantile_cont(value, 0.9) OVER w, 6) AS "value_q90" FROM ' + _EVENTS + " WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
add("rolling_median_time", on("events", lambda df: rolling.rolling_quantiles(_holes(df).select("event_id", "ts", "value"), "value", "ts", within=6 * 3600).withColumn("value_q50", F.round("value_q50", 6))), 'SELECT event_id, ts, value, round(quantile_cont(value, 0.5) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW), 6) AS "value_q50" FROM ' + _EVENTS)

# ---- profiles by parts, grids of time, grouping sets


@query("SELECT \"column\", count(*)::BIGINT AS parts, sum(c)::BIGINT AS count, sum(n - c)::BIGINT AS missing, min(lo) AS min, max(hi) AS max, TRUE AS near FROM (SELECT 'value' AS \"column\", ts::DATE AS day, count(value) AS c, count(*) AS n, min(value) AS lo, max(value) AS hi FROM " + _EVENTS + " GROUP BY 2 UNION ALL SELECT 'user_id', ts::DATE, count(*), count(*), min(user_id)::DOUBLE, max(user_id)::DOUBLE FROM events GROUP BY 2 UNION ALL SELECT 'event_type', ts::DATE, count(*), count(*), NULL, NULL FROM events GROUP BY 2) GROUP BY 1")
def incremental_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days come in three times, one of them again; near: the estimates are within their errors of the exact figures."""
    path = scratch(spark, "profile")
    df = _holes(table(spark, sf_dir, "events")).select("value", "user_id", "event_type", F.to_date("ts").alias("day"))
    for days in ("day < '2024-01-10'", "day between '2024-01-10' and '2024-01-20'", "day > '2024-01-20'", "day = '2024-01-10'"):
        incremental.update_profile(df.filter(days), path, "day")
    merged = incremental.merged_profile(incremental.stored_sketches(spark, path))
    exact = profile.column_stats(df.drop("day")).select("column", *[F.col(c).alias(f"exact_{c}") for c in ("distinct", "mean", "std_pop", "p50", "top_count")])
    # ranks of numbers may be off by 1.3 %: the median lies between the quantiles of 47 and 53 %
    ends = df.agg(*[F.percentile_approx(c, [0.47, 0.53], 10_000).alias(c) for c in ("value", "user_id")]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.get(c, F.lit(0)).cast("double").alias("lo"), F.get(c, F.lit(1)).cast("double").alias("hi")) for c in ("value", "user_id")])))
    close = lambda a, b, share: F.abs(F.col(a) - F.col(b)) <= share * F.abs(F.col(b))
    near = close("distinct", "exact_distinct", 0.06) & F.coalesce(close("mean", "exact_mean", 1e-9) & close("std_pop", "exact_std_pop", 1e-9) & F.col("p50").between(F.col("lo"), F.col("hi")), F.lit(True)) & ((F.col("column") != "event_type") | (F.get("top", F.lit(0))["count"] == F.col("exact_top_count")))
    return merged.join(exact, "column").join(ends, "column", "left").select("column", "parts", "count", "missing", "min", "max", near.alias("near"))


_HOURS = "(SELECT user_id, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events WHERE event_type <> 'view' GROUP BY 1, 2)"


def _hours(df: DataFrame) -> DataFrame:
    return df.filter("event_type <> 'view'").groupBy("user_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("value"))


_GRID = f"(SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 6 HOUR)) AS ts FROM (SELECT user_id, to_timestamp(0)::TIMESTAMP + INTERVAL 6 HOUR * ceil(epoch(min(ts)) / 21600)::INT AS ts FROM {_HOURS} GROUP BY 1 UNION ALL SELECT user_id, to_timestamp(0)::TIMESTAMP + INTERVAL 6 HOUR * floor(epoch(max(ts)) / 21600)::INT FROM {_HOURS} GROUP BY 1) GROUP BY 1)"
_FILLED = f"(SELECT * FROM {_HOURS} UNION ALL SELECT user_id, ts, NULL FROM {_GRID} WHERE (user_id, ts) NOT IN (SELECT (user_id, ts) FROM {_HOURS}))"
add("fill_gaps", on("events", lambda df: calendar.fill_gaps(_hours(df), "ts", 6 * 3600, ["user_id"]).withColumn("value", F.round("value", 6))), f"SELECT * REPLACE (round(value, 6) AS value) FROM {_FILLED}")
add("interpolate", on("events", lambda df: calendar.interpolate(calendar.fill_gaps(_hours(df), "ts", 6 * 3600, ["user_id"]), "value", "ts", ["user_id"]).withColumn("value", F.round("value", 8))), f"SELECT user_id, ts, round(coalesce(value, a + (b - a) * (epoch(ts) - epoch(ta)) / (epoch(tb) - epoch(ta))), 8) AS value FROM (SELECT *, last_value(value IGNORE NULLS) OVER w AS a, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS ta, first_value(value IGNORE NULLS) OVER v AS b, first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER v AS tb FROM {_FILLED} WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
_SET_COLUMNS = "grouping(event_type, day)::INT AS grouping_id, count(*) AS n, count(value) AS count, round(sum(value), 4) AS sum, count(DISTINCT value) AS \"distinct\", round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.9), 6) AS q90"


def _grouped(sets) -> Callable[[SparkSession, str], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        rows = _holes(df).withColumn("day", F.when(F.dayofmonth("ts") != 5, F.dayofmonth("ts")))
        found = cube.grouping_sets(rows, sets(["event_type", "day"]), "value", [0.5, 0.9])
        return found.withColumns({"sum": F.round("sum", 4), "q50": F.round("q50", 6), "q90": F.round("q90", 6)})

    return on("events", run)


_BY_DAY = f"(SELECT *, CASE WHEN day(ts) <> 5 THEN day(ts)::INT END AS day FROM {_EVENTS})"
add("grouping_sets_cube", _grouped(cube.cube_sets), f"SELECT event_type, day, {_SET_COLUMNS} FROM {_BY_DAY} GROUP BY CUBE (event_type, day)")
add("grouping_sets_rollup", _grouped(cube.rollup_sets), f"SELECT event_type, day, {_SET_COLUMNS} FROM {_BY_DAY} GROUP BY ROLLUP (event_type, day)")

# ---- nested JSON, sessions


def _nested(df: DataFrame) -> DataFrame:
    """Lines with an object in an object, an array, and a key that holds numbers, texts or nothing."""
    mixed = F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("user_id") % 3 == 1, F.lit('"x"')).otherwise("null")
    more = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(',"tags":["a",'), F.col("value").cast("string"), F.lit("]"))).otherwise("")
    return df.select(F.concat(F.lit('{"props":'), "props", F.lit(',"m.n":'), mixed, more, F.lit("}")).alias("line"))


_EVEN = "count(*) FILTER (user_id % 2 = 0)"
add("json_profile", on("events", lambda df: json_profile.json_profile(json_profile.path_counts(_nested(df), "line")).drop("kinds").withColumn("presence", F.round("presence", 9))), f"""
SELECT '$' AS path, 'object' AS type, FALSE AS conflict, count(*) AS n, 0::BIGINT AS nulls, 1.0::DOUBLE AS presence FROM events UNION ALL SELECT '$.props', 'object', FALSE, count(*), 0, 1.0 FROM events UNION ALL SELECT '$.props.k', 'integer', FALSE, count(*), 0, 1.0 FROM events
UNION ALL SELECT '$."m.n"', 'mixed', TRUE, count(*), count(*) FILTER (user_id % 3 = 2), 1.0 FROM events
UNION ALL SELECT '$.tags', 'array', FALSE, {_EVEN}, 0, round({_EVEN} / count(*), 9) FROM events UNION ALL SELECT '$.tags[]', 'mixed', TRUE, 2 * {_EVEN}, 0, 2.0 FROM events""")
_SESSIONS = "SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS events, round(sum(value), 6) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"
add("sessions", on("events", lambda df: streamed.sessions(df, "ts", 4 * 3600, ["user_id"], "value").withColumn("total", F.round("total", 6))), _SESSIONS)


@query(_SESSIONS)
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of ten files in no order; an event of long after closes all sessions."""
    path = scratch(spark, "arrivals")
    df = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    last = df.agg(F.lit(-1).cast("bigint").alias("user_id"), (F.max("ts") + F.expr("interval 200 days")).alias("ts"), F.lit(0.0).alias("value"))
    df.repartition(10).write.parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    found = streamed.all_available(streamed.sessions(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(path), "ts", 4 * 3600, ["user_id"], "value", delay=90 * 86400))
    return found.filter("user_id >= 0").withColumn("total", F.round("total", 6))


# ---- exact values

_EXACT = "(SELECT *, (o_orderkey::DECIMAL(38,2) + 12345678901234567890.12) AS d, 9007199254740993 + o_orderkey AS n FROM orders)"


def _exact(df: DataFrame) -> DataFrame:
    return df.withColumns({"d": (F.col("o_orderkey").cast("decimal(38,2)") + F.expr("12345678901234567890.12BD")).cast("decimal(38,2)"), "n": F.col("o_orderkey") + F.lit(9007199254740993)})


add("filter_decimal", on("orders", lambda df: filters.apply_filters(_exact(df), [FilterSpec("d", "gt", "12345678901234567990.12"), FilterSpec("d", "ne", "12345678901234568000.12")]).select("o_orderkey")), f"SELECT o_orderkey FROM {_EXACT} WHERE d > 12345678901234567990.12 AND d <> 12345678901234568000.12")
add("filter_step_large", on("orders", lambda df: filters.filter_step(filters.filter_step(_exact(df), "n", "greater_than", "9007199254741000.0"), "n", "not_equals", "9007199254741003").select("o_orderkey")), f"SELECT o_orderkey FROM {_EXACT} WHERE n > 9007199254741000 AND n <> 9007199254741003")
add("fill_missing_large", on("orders", lambda df: clean.fill_missing(clean.fill_missing(_exact(df).select("o_orderkey", *[F.when(F.col("o_orderkey") % 5 != 0, F.col(c)).alias(c) for c in ("d", "n")]), "n", "value", "-1.0"), "d", "value", "0.25").withColumn("d", F.col("d").cast("string"))), f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN d ELSE 0.25 END::DECIMAL(38,2)::VARCHAR AS d, CASE WHEN o_orderkey % 5 <> 0 THEN n ELSE -1 END AS n FROM {_EXACT}")


@query("SELECT event_id, 'ts' AS \"column\", strftime(ts, '%Y-%m-%d %H:%M:%S') AS old_value, strftime(ts + INTERVAL 10 MILLISECOND, '%Y-%m-%d %H:%M:%S') AS new_value FROM (SELECT *, CASE WHEN event_id <> 7 THEN event_id END AS event_id FROM events) WHERE user_id % 3 = 0".replace("SELECT *, CASE", "SELECT * EXCLUDE (event_id), CASE"))
def changed_cells_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments moved by 10 milliseconds; one key is missing."""
    df = table(spark, sf_dir, "events").withColumn("event_id", F.when(F.col("event_id") != 7, F.col("event_id")))
    moved = df.withColumn("ts", F.when(F.col("user_id") % 3 == 0, F.col("ts") + F.expr("interval 10 milliseconds")).otherwise(F.col("ts")))
    return diff.changed_cells(df, moved, ["event_id"])


add("value_domain_moments", on("events", lambda df: profile.value_domain(df.select("event_type", F.timestamp_millis(F.col("user_id") % 12).alias("moment")))), "SELECT 'event_type' AS \"column\", event_type AS value, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'moment', '1970-01-01 00:00:00', count(*) FROM events GROUP BY user_id % 12")
add("top_n_moments", on("events", lambda df: profile.top_n(df.select(F.timestamp_millis(F.col("user_id") % 12).alias("moment")), "moment", 4)), "SELECT '1970-01-01 00:00:00' AS value, count(*) AS count FROM events GROUP BY user_id % 12 ORDER BY count DESC LIMIT 4")
add("drop_duplicates_maps", on("events", lambda df: clean.drop_duplicates(df.select(F.create_map(F.lit("type"), "event_type", F.lit("user"), (F.col("user_id") % 20).cast("string")).alias("m"))).select(F.col("m")["type"].alias("event_type"), F.col("m")["user"].cast("bigint").alias("u"))), "SELECT DISTINCT event_type, user_id % 20 AS u FROM events")

# ---- sources and sinks


@query("SELECT * REPLACE (CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus || ', \"' || o_orderpriority END AS o_orderstatus) FROM orders")
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.col("o_orderstatus"), F.lit(', "'), F.col("o_orderpriority")))
    path = scratch(spark, "csv")
    files.write_csv(table(spark, sf_dir, "orders").withColumn("o_orderstatus", odd), path)
    return files.read_csv(spark, path)


@query("SELECT * REPLACE (p_name || chr(13) || chr(10) || '\"' || p_type || '\",' || chr(10) AS p_name, p_size::BIGINT AS p_size) FROM part")
def read_csv_quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends of both kinds, quotes and delimiters in one field of every row."""
    path = scratch(spark, "csv")
    text = F.concat("p_name", F.lit('\r\n"'), "p_type", F.lit('",\n'))
    files.write_csv(table(spark, sf_dir, "part").withColumn("p_name", text), path)
    return files.read_csv(spark, path)


@query("SELECT * REPLACE (c_name || chr(9) || chr(10) AS c_name) FROM customer")
def read_tsv_quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tsv")
    named = table(spark, sf_dir, "customer").withColumn("c_name", F.concat("c_name", F.lit("\t\n")))
    named.write.option("sep", "\t").option("header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_tsv(spark, path).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("SELECT * FROM customer")
def read_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tsv")
    table(spark, sf_dir, "customer").write.option("sep", "\t").option("header", True).csv(path)
    return files.read_tsv(spark, path, multi_line=False).withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query("SELECT * REPLACE (p_size::BIGINT AS p_size) FROM part")
def read_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    table(spark, sf_dir, "part").write.json(path)
    return files.read_jsonl(spark, path)


@query("SELECT * REPLACE (l_linenumber::BIGINT AS l_linenumber, date_trunc('millisecond', l_shipdate) AS l_shipdate) FROM lineitem")
def read_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_parquet(spark, f"{sf_dir}/lineitem.parquet")


add("normalize_types", on("events", lambda df: files.normalize_types(df.withColumn("value", F.col("value").cast("float").cast("double")))), "SELECT * REPLACE (value::FLOAT::DOUBLE AS value, date_trunc('millisecond', ts) AS ts) FROM events")
_AS_TEXT = "(SELECT o_orderkey::VARCHAR AS k, o_totalprice, CASE WHEN o_custkey % 2 = 0 THEN 'yes' ELSE 'FALSE' END AS b, o_orderdate AS d, o_orderpriority AS s FROM orders)"


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(F.when(F.col("o_orderkey") % 5 == 0, " N/A ").otherwise(F.col("o_orderkey").cast("string")).alias("k"), F.format_string("%.2f", "o_totalprice").alias("p"), F.when(F.col("o_custkey") % 2 == 0, "yes").otherwise("FALSE").alias("b"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("d"), F.col("o_orderpriority").alias("s"))


_TYPED_SQL = "SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS k, round(o_totalprice, 2) AS p, o_custkey % 2 = 0 AS b, o_orderdate AS d, o_orderpriority AS s FROM orders"
add("infer_types", on("orders", lambda df: files.infer_types(_as_text(df), None)), _TYPED_SQL)
add("cast_inferred", on("orders", lambda df: files.cast_inferred(_as_text(df), {"k": "bigint", "p": "double", "b": "boolean", "d": "timestamp", "s": "bigint"})), _TYPED_SQL.replace("o_orderpriority AS s", "NULL::BIGINT AS s"))
add("parse_datetime", on("orders", lambda df: df.select("o_orderkey", files.parse_datetime(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).alias("at"), files.parse_datetime(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), files.parse_datetime(F.col("o_orderpriority")).alias("none"))), "SELECT o_orderkey, o_orderdate - INTERVAL 2 HOUR AS at, date_trunc('day', o_orderdate)::TIMESTAMP AS day, NULL::TIMESTAMP AS none FROM orders")
add("null_tokens", on("orders", lambda df: df.select("o_orderkey", files.null_tokens(F.when(F.col("o_orderstatus") == "F", " nan").when(F.col("o_orderstatus") == "O", "-").otherwise(F.concat(F.lit(" "), F.col("o_orderstatus")))).alias("status"))), "SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN ' ' || o_orderstatus END AS status FROM orders")
add("nan_to_null", on("events", lambda df: nan_to_null(df.withColumn("value", F.when(F.col("value") < 20, F.lit(float("nan"))).otherwise(F.col("value"))))), f"SELECT * FROM {_EVENTS}")
add("dataset_info", on("events", files.dataset_info), "SELECT position::INT AS position, name AS \"column\", dtype, label, (SELECT count(*) FROM events) AS row_count, 6 AS column_count FROM (VALUES (0, 'event_id', 'int64', 'integer'), (1, 'ts', 'datetime', 'datetime'), (2, 'user_id', 'int64', 'integer'), (3, 'event_type', 'utf8', 'string'), (4, 'value', 'float64', 'float'), (5, 'props', 'utf8', 'string')) t(position, name, dtype, label)")


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM " + _GAPPED)
def write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    files.write_csv(_gapped(table(spark, sf_dir, "orders")).select("o_orderkey", "o_orderpriority", "o_orderdate"), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT * FROM orders")
def write_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "parquet")
    files.write_parquet(table(spark, sf_dir, "orders"), path)
    return spark.read.parquet(path).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
