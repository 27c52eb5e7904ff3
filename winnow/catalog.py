"""Queries over the test tables, each a JSON request that goes through the engine, and the SQL that says the same.

Paths and codes of errors in them are fixed values of the wire format."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import parsers
from .model import Dir, FilterRequest, FilterValidationError, Group, Leaf, Settings, SortItem
from .operators import profiles as P
from .operators.profiles import enum_profile, infer
from .operators.templates import unary_op, value_op
from .plans.engine import FilterDefinition
from .plans.schema import Hop, SchemaBuilder, prop, rule
from .sources import builder as b
from .sources import wire

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, key: str, **own: Any) -> SchemaBuilder:
    """Every column with the profile of its type, sortable. ``own``: profiles of single columns."""
    out = SchemaBuilder(key)
    for f in df.schema.fields:
        if f.name in own or not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            out.add(prop(f.name, own.get(f.name) or infer(f.dataType)).sort())
    return out


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FilterDefinition]:
    """Documents with their labels, null where a document has none."""
    df = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")
    like = df.withColumn("quality", F.col("quality").cast("int"))
    schema = plain(like.drop("toxic"), "labelled").add(
        prop("flag", P.BOOL, lambda s: s["toxic"] == 1), prop("grade", P.STRING, lambda s: F.concat(F.lit("q"), s["quality"].cast("string"))),
        prop("ratio", P.DOUBLE, lambda s: s["quality"].cast("double") / 2), rule("rank", lambda s: F.coalesce(s["quality"], F.lit(0)), unary_op("isEven", lambda c: c % 2 == 0)).sort(),
    )
    return df, FilterDefinition(schema)


def simple(name: str, **own: Any) -> Callable[[SparkSession, str], tuple[DataFrame, FilterDefinition]]:
    def make(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FilterDefinition]:
        df = table(spark, sf_dir, name)
        return df, FilterDefinition(plain(df, name, **own))

    return make


def typed(name: str, **columns: tuple[P.Profile, Callable[[Column], Column]]):
    """A table with computed properties of other types: name of the property to (profile, cast), on the column ``of``."""

    def make(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FilterDefinition]:
        df = table(spark, sf_dir, name)
        schema = SchemaBuilder(name)
        for field, (profile, accessor) in columns.items():
            schema.add(prop(field, profile, accessor).sort())
        return df, FilterDefinition(schema)

    return make


CUSTOMER = Hop("customer", "customer", ("o_custkey",), ("c_custkey",))
NATION = Hop("nation", "nation", ("c_nationkey",), ("n_nationkey",))
REGION = Hop("region", "region", ("n_regionkey",), ("r_regionkey",))
LABEL = Hop("label", "labels", ("doc_id",), ("doc_id",))


def navigation(spark: SparkSession, sf_dir: str, **options: Any) -> tuple[DataFrame, FilterDefinition]:
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    region = plain(t["region"], "region")
    nation = plain(t["nation"], "nation").nest(REGION, region)
    customer = plain(t["customer"], "customer").nest(NATION, nation)
    return t["orders"], FilterDefinition(plain(t["orders"], "orders").nest(CUSTOMER, customer, **options), t)


def optional(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FilterDefinition]:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf_dir, "labels")
    return docs, FilterDefinition(plain(docs, "documents").nest(LABEL, plain(labels, "labels")), {"labels": labels})


def parents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FilterDefinition]:
    nation = table(spark, sf_dir, "nation")
    schema = plain(nation, "nation")
    schema.nest(Hop("manager", "nation", ("n_regionkey",), ("n_nationkey",)), lambda: schema, max_depth=2)
    return nation, FilterDefinition(schema, {"nation": nation})


def custom(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FilterDefinition]:
    orders = table(spark, sf_dir, "orders")
    text = P.STRING.extend(
        "TextFilter", value_op("fuzzy", lambda c, v: F.lower(c).contains(v.lower()), parse=parsers.string), value_op("ilike", lambda c, v: c.ilike(v), parse=parsers.string),
    )
    number = P.DOUBLE.extend("NumberFilter", value_op("between", lambda c, v: c.between(v[0], v[1]), type=list[float]))
    listed = [
        unary_op("isEmpty", lambda c: F.size(c) == 0),
        value_op("containsAny", lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, v))), type=list[str]),
        value_op("containsAll", lambda c, v: F.size(F.array_except(F.array(*map(F.lit, v)), c)) == 0, type=list[str]),
    ]
    schema = plain(orders.drop("o_orderpriority", "o_totalprice"), "orders").add(
        prop("o_orderpriority", text).sort(), prop("o_totalprice", number).alias("price").sort(default=Dir.DESC),
        rule("year", lambda s: F.year(s["o_orderdate"]), value_op("eq", lambda c, v: c == v, parse=parsers.int32)).sort(),
        rule("label", lambda s: F.concat(s["o_orderstatus"], F.lit(" "), s["o_orderpriority"]), value_op("contains", lambda c, v: c.contains(v), parse=parsers.string)),
        rule("words", lambda s: F.split(s["o_orderpriority"], "-"), *listed), rule("open", lambda s: F.when(s["o_orderstatus"] == "O", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), *listed), rule("key", lambda s: s["o_orderkey"], unary_op("isEven", lambda c: c % 2 == 0)),
        prop("priority", P.STRING, lambda s: s["o_orderpriority"]).intercept(scalar=lambda v, c: v.upper(), array=lambda v, c: sorted(set(v))),
        prop("status", P.STRING, lambda s: s["o_orderstatus"]).intercept(raw=lambda v, c: str(v)[:1]),
    )
    return orders, FilterDefinition(schema)


def run(source: Callable, request: dict[str, Any], spark: SparkSession, sf_dir: str) -> DataFrame:
    df, definition = source(spark, sf_dir)
    return definition.apply(df, wire.decode(json.dumps(request)))


def _leaf(field: str, op: str, *value: Any) -> dict[str, Any]:
    return {"field": field, "op": op} | ({"value": value[0]} if value else {})


def _where(node: dict[str, Any], **rest: Any) -> dict[str, Any]:
    return {"where": node} | rest


#: name: (query, SQL or None)
_ALL: dict[str, tuple[Callable, str | None]] = {}


def _add(name: str, source: Callable, request: dict[str, Any], sql: str) -> None:
    _ALL[name] = (partial(run, source, request), sql)


def _comparisons(prefix: str, source: Callable, field: str, expression: str, frame: str, value: Any, sql: str, several: list | None = None, several_sql: str = "") -> None:
    """The operators of an ordered type."""
    for op, sign in (("eq", "is not distinct from"), ("ne", "is distinct from"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
        _add(f"{prefix}_{op}", source, _where(_leaf(field, op, value)), f"select {frame} where {expression} {sign} {sql}")
    if several:
        _add(f"{prefix}_in", source, _where(_leaf(field, "in", several)), f"select {frame} where {expression} in ({several_sql})")
    if prefix == "null_int":  # the other types' nulls are below
        _add(f"{prefix}_is_null", source, _where(_leaf(field, "isNull")), f"select {frame} where {expression} is null")


LABELLED = "d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic from documents d left join labels l using (doc_id)"

_LINE = simple("lineitem")
_add("and_tree", _LINE, _where({"and": [_leaf("l_quantity", "gte", 30), _leaf("l_returnflag", "eq", "R"), _leaf("l_shipdate", "gte", "1997-01-01")]}), "select * from lineitem where l_quantity >= 30 and l_returnflag = 'R' and l_shipdate >= timestamp '1997-01-01'")
_add("or_tree", _LINE, _where({"or": [_leaf("l_quantity", "lt", 3), _leaf("l_returnflag", "eq", "A")]}), "select * from lineitem where l_quantity < 3 or l_returnflag = 'A'")
_add("not_tree", _LINE, _where({"not": [{"or": [_leaf("l_quantity", "gt", 5), _leaf("l_returnflag", "in", ["A", "R"])]}]}), "select * from lineitem where not (l_quantity > 5 or l_returnflag in ('A', 'R'))")


def _deep() -> dict[str, Any]:
    node = _leaf("l_quantity", "gte", 10)
    for i in range(4):
        node = {"not": [{"and": [node, _leaf("l_linenumber", "ne", i)]}]}
    return node


_add("deep_tree", _LINE, _where(_deep()), "select * from lineitem where not (not (not (not (l_quantity >= 10 and l_linenumber <> 0) and l_linenumber <> 1) and l_linenumber <> 2) and l_linenumber <> 3)")
_PART = simple("part")
for _op, _value, _sql in (("eq", "Brand#13", "p_brand = 'Brand#13'"), ("ne", "Brand#13", "p_brand <> 'Brand#13'"), ("contains", "and#1", "contains(p_brand, 'and#1')"), ("startsWith", "Brand#2", "starts_with(p_brand, 'Brand#2')"), ("endsWith", "3", "suffix(p_brand, '3')"), ("in", ["Brand#13", "Brand#21"], "p_brand in ('Brand#13', 'Brand#21')")):
    _add("str_" + _op.replace("sW", "s_w"), _PART, _where(_leaf("p_brand", _op, _value)), f"select * from part where {_sql}")
_add("str_percent_is_literal", typed("part", offer=(P.STRING, lambda s: F.when(s["p_partkey"] % 3 == 0, F.concat(s["p_brand"], F.lit(" 5%"))).otherwise(s["p_brand"]))), _where(_leaf("offer", "contains", "5%")), "select * from part where p_partkey % 3 = 0")
_comparisons("int", typed("lineitem", n=(P.INT32, lambda s: s["l_linenumber"].cast("int"))), "n", "l_linenumber", "* from lineitem", 4, "4", [1, 7], "1, 7")
_comparisons("long", typed("orders", n=(P.INT64, lambda s: s["o_custkey"].cast("bigint"))), "n", "o_custkey", "* from orders", "370", "370", [1, "2"], "1, 2")
_comparisons("short", typed("lineitem", n=(P.INT16, lambda s: s["l_linenumber"].cast("smallint"))), "n", "l_linenumber", "* from lineitem", 3, "3", [2, 3], "2, 3")
_comparisons("byte", typed("lineitem", n=(P.BYTE, lambda s: s["l_linenumber"].cast("smallint"))), "n", "l_linenumber", "* from lineitem", 3, "3", [2, 255], "2, 255")
_comparisons("double", simple("lineitem"), "l_quantity", "l_quantity", "* from lineitem", 25, "25", [1, 2.5, "3e0"], "1, 2.5, 3")
_comparisons("float", typed("lineitem", n=(P.SINGLE, lambda s: s["l_discount"].cast("float"))), "n", "l_discount::float", "* from lineitem", 0.05, "0.05::float", [0.1, 0.05], "0.1::float, 0.05::float")
_comparisons("decimal", typed("orders", n=(P.DECIMAL, lambda s: (s["o_orderkey"] % 1000 + F.lit("0.25").cast("decimal(3,2)")).cast("decimal(18,2)"))), "n", "(o_orderkey % 1000 + 0.25)", "* from orders", 150.25, "150.25", ["100.25", 7, 8.250], "100.25, 7, 8.25")
_HOURS = typed("events", t=(P.DATE_TIME, lambda s: F.date_trunc("hour", s["ts"]).cast("timestamp_ntz")))
_comparisons("ts", _HOURS, "t", "date_trunc('hour', ts)", "* from events", "2024-01-15T12:00:00", "timestamp '2024-01-15 12:00:00'")
_comparisons("tsz", typed("events", t=(P.DATE_TIME_OFFSET, lambda s: F.to_timestamp_ltz(F.date_format(s["ts"], "yyyy-MM-dd HH:00:00'Z'"), F.lit("yyyy-MM-dd HH:mm:ssX")))), "t", "date_trunc('hour', ts)", "* from events", "2024-01-15T14:00:00+02:00", "timestamp '2024-01-15 12:00:00'")
_comparisons("date", typed("orders", d=(P.DATE_ONLY, lambda s: s["o_orderdate"].cast("date"))), "d", "o_orderdate::date", "* from orders", "1996-06-01", "date '1996-06-01'")
_comparisons("null_int", labelled, "quality", "quality", LABELLED, 1, "1", [0, 1], "0, 1")
_add("null_int_gt", labelled, _where(_leaf("quality", "gt", 0)), f"select {LABELLED} where quality > 0")
_add("bool_eq", labelled, _where(_leaf("flag", "eq", True)), f"select {LABELLED} where toxic = 1")
_GUID = typed("orders", id=(P.GUID, lambda s: F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(s["o_orderkey"].cast("string"), 12, "0"))))
_add("guid_eq", _GUID, _where(_leaf("id", "eq", "00000000-0000-0000-0000-000000000007")), "select * from orders where o_orderkey = 7")
_add("guid_ne", _GUID, _where(_leaf("id", "ne", "00000000-0000-0000-0000-000000000007")), "select * from orders where o_orderkey <> 7")
_add("guid_in", _GUID, _where(_leaf("id", "in", [f"00000000-0000-0000-0000-{i:012}" for i in (1, 2, 3)])), "select * from orders where o_orderkey in (1, 2, 3)")
_ENUM = simple("orders", o_orderpriority=enum_profile("Priority", PRIORITIES))
_add("enum_eq", _ENUM, _where(_leaf("o_orderpriority", "eq", "1-urgent")), "select * from orders where o_orderpriority = '1-URGENT'")
_add("enum_ne", _ENUM, _where(_leaf("o_orderpriority", "ne", 4)), "select * from orders where o_orderpriority <> '5-LOW'")
_add("enum_in", _ENUM, _where(_leaf("o_orderpriority", "in", [0, "2-High", 99])), "select * from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
_add("enum_sort", _ENUM, {"sort": [{"field": "o_orderpriority", "dir": "desc"}, {"field": "o_orderkey"}], "pageSize": 20}, "select * from orders order by o_orderpriority desc nulls last, o_orderkey nulls first limit 20")
for _name, _node, _sql in (
    ("ne_keeps_null", _leaf("quality", "ne", 1), "quality is distinct from 1"),
    ("not_eq_keeps_null", {"not": [_leaf("quality", "eq", 1)]}, "not coalesce(quality = 1, false)"),
    ("not_ne_drops_null", {"not": [_leaf("quality", "ne", 1)]}, "quality = 1"),
    ("not_gt_keeps_null", {"not": [_leaf("quality", "gt", 0)]}, "not coalesce(quality > 0, false)"),
    ("not_in_keeps_null", {"not": [_leaf("quality", "in", [1])]}, "not coalesce(quality in (1), false)"),
    ("not_contains_keeps_null", {"not": [_leaf("grade", "contains", "1")]}, "not coalesce(quality = 1, false)"),
    ("not_double_keeps_null", {"not": [_leaf("ratio", "gte", 0.5)]}, "not coalesce(quality / 2.0 >= 0.5, false)"),
    ("not_custom_keeps_null", {"not": [_leaf("flag", "eq", False)]}, "not coalesce(toxic = 0, false)"),
    ("in_empty", _leaf("quality", "in", []), "false"),
    ("not_in_empty", {"not": [_leaf("quality", "in", [])]}, "true"),
    ("not_is_null", {"not": [_leaf("quality", "isNull")]}, "quality is not null"),
    ("double_negation", {"not": [{"not": [_leaf("quality", "eq", 1)]}]}, "quality = 1"),
    ("nested_negation", {"not": [{"and": [_leaf("quality", "eq", 1), {"not": [_leaf("lang", "eq", "en")]}]}]}, "not (coalesce(quality = 1, false) and not lang = 'en')"),
):
    _add(_name, labelled, _where(_node), f"select {LABELLED} where {_sql}")
_add("is_null_non_nullable", _LINE, _where(_leaf("l_orderkey", "isNull")), "select * from lineitem where l_orderkey is null")
_CUSTOMERS = simple("customer")
_add("sort_page", _CUSTOMERS, {"sort": [{"field": "c_acctbal", "dir": "Desc"}, {"field": "c_custkey"}], "page": 3, "pageSize": 25}, "select * from customer order by c_acctbal desc nulls last, c_custkey nulls first limit 25 offset 50")
_add("sort_nulls_page", labelled, {"sort": [{"field": "quality"}, {"field": "doc_id"}], "page": 24, "pageSize": 25}, f"select {LABELLED} order by quality nulls first, doc_id limit 25 offset 575")
_add("sort_string_page", _CUSTOMERS, {"sort": [{"field": "c_name", "dir": 1}], "page": 2, "pageSize": 10}, "select * from customer order by c_name desc nulls last limit 10 offset 10")
_add("sort_computed", labelled, {"sort": [{"field": "rank", "dir": "desc"}, {"field": "doc_id"}], "pageSize": 50}, f"select {LABELLED} order by coalesce(quality, 0) desc, doc_id limit 50")
_add("sort_default_dir", custom, {"sort": [{"field": "price"}, {"field": "o_orderkey"}], "pageSize": 30}, "select * from orders order by o_totalprice desc nulls last, o_orderkey limit 30")
_add("page_only_default_size", _CUSTOMERS, {"sort": [{"field": "c_custkey"}], "page": 2}, "select * from customer order by c_custkey limit 50 offset 50")
_add("page_beyond_end", _CUSTOMERS, {"sort": [{"field": "c_custkey"}], "page": 1000000}, "select * from customer limit 0")
_add("size_only", _CUSTOMERS, {"sort": [{"field": "c_custkey"}], "pageSize": 7}, "select * from customer order by c_custkey limit 7")
_add("no_where", _CUSTOMERS, {}, "select * from customer")
_add("nav_one_hop", navigation, _where(_leaf("customer.c_mktsegment", "eq", "BUILDING")), "select o.* from orders o left join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
_add("nav_two_hop", navigation, _where({"and": [_leaf("customer.nation.region.r_name", "eq", "ASIA"), _leaf("customer.c_acctbal", "gt", 0)]}), "select o.* from orders o left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey where r_name = 'ASIA' and c_acctbal > 0")
_add("nav_sort", navigation, {"sort": [{"field": "customer.c_name", "dir": "desc"}, {"field": "o_orderkey"}], "page": 2, "pageSize": 15}, "select o.* from orders o left join customer on o_custkey = c_custkey order by c_name desc nulls last, o_orderkey limit 15 offset 15")
_add("nav_filter_sort", navigation, _where(_leaf("customer.c_mktsegment", "eq", "BUILDING"), sort=[{"field": "customer.c_acctbal", "dir": "desc"}, {"field": "o_orderkey"}], pageSize=40), "select o.* from orders o left join customer on o_custkey = c_custkey where c_mktsegment = 'BUILDING' order by c_acctbal desc nulls last, o_orderkey limit 40")
_DOCS = "d.doc_id, d.lang, d.n_chars from documents d left join labels l using (doc_id)"
_add("nav_optional", optional, _where(_leaf("label.quality", "eq", 1)), f"select {_DOCS} where quality = 1")
_add("nav_optional_ne", optional, _where(_leaf("label.quality", "ne", 1)), f"select {_DOCS} where quality is distinct from 1")
_add("nav_optional_sort", optional, {"sort": [{"field": "label.quality"}, {"field": "doc_id"}], "page": 3, "pageSize": 40}, f"select {_DOCS} order by quality nulls first, doc_id limit 40 offset 80")
_add("self_join_two_hop", parents, _where(_leaf("manager.manager.n_name", "contains", "A")), "select a.* from nation a left join nation b on a.n_regionkey = b.n_nationkey left join nation c on b.n_regionkey = c.n_nationkey where contains(c.n_name, 'A')")
_NESTED = "select o.* from orders o left join customer on o_custkey = c_custkey"
_add("nested_prefix", partial(navigation, prefix="buyer"), _where(_leaf("buyer.c_mktsegment", "in", ["MACHINERY"])), f"{_NESTED} where c_mktsegment in ('MACHINERY')")
_add("nested_only", partial(navigation, only=["c_acctbal"]), _where(_leaf("customer.c_acctbal", "lt", 0)), f"{_NESTED} where c_acctbal < 0")
_add("nested_except", partial(navigation, except_=["c_name"]), _where(_leaf("customer.c_acctbal", "gte", 9000)), f"{_NESTED} where c_acctbal >= 9000")
for _name, _node, _sql in (
    ("rule_concat_contains", _leaf("label", "contains", "O 1-U"), "contains(o_orderstatus || ' ' || o_orderpriority, 'O 1-U')"),
    ("rule_typed_between", _leaf("price", "between", [1000, 50000.5]), "o_totalprice between 1000 and 50000.5"),
    ("op_year", _leaf("year", "eq", 1997), "year(o_orderdate) = 1997"),
    ("op_fuzzy", _leaf("o_orderpriority", "fuzzy", "Urg"), "contains(lower(o_orderpriority), 'urg')"),
    ("op_ilike", _leaf("o_orderpriority", "ilike", "%hi_h"), "o_orderpriority ilike '%hi_h'"),
    ("op_is_even", _leaf("key", "isEven"), "o_orderkey % 2 = 0"),
    ("op_not_even", {"not": [_leaf("key", "isEven")]}, "o_orderkey % 2 <> 0"),
    ("op_is_empty", _leaf("open", "isEmpty"), "o_orderstatus <> 'O'"),
    ("op_contains_any", _leaf("words", "containsAny", ["URGENT", "LOW"]), "o_orderpriority in ('1-URGENT', '5-LOW')"),
    ("op_contains_all", _leaf("words", "containsAll", ["1", "URGENT"]), "o_orderpriority = '1-URGENT'"),
    ("intercept_scalar", _leaf("priority", "eq", "5-low"), "o_orderpriority = '5-LOW'"),
    ("intercept_array", _leaf("priority", "in", ["5-low", "5-low", "2-high"]), "o_orderpriority in ('5-LOW', '2-HIGH')"),
    ("intercept_raw", _leaf("status", "eq", "Open"), "o_orderstatus = 'O'"),
):
    _add(_name, custom, _where(_node), f"select * from orders where {_sql}")


def time_query(op: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.timeType.enabled", "true")
    source = typed("events", t=(P.TIME_ONLY, lambda s: F.date_format(s["ts"], "HH:mm:00").cast("time(6)")))
    return run(source, _where(_leaf("t", op, "12:30:00")), spark, sf_dir)


for _op, _sign in (("eq", "="), ("ne", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _ALL[f"time_{_op}"] = (partial(time_query, _op), f"select * from events where date_trunc('minute', ts)::time {_sign} time '12:30:00'")


def _day(x: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), x.cast("int"))


#: Each type's values, null for documents without a label, rising with x = doc_id % 20: (profile, value of x, what x = 10 is on the wire).
NULLABLE: dict[str, tuple[P.Profile, Callable[[Column], Column], Any]] = {
    "str": (P.STRING, lambda x: F.concat(F.lit("v"), x.cast("string"), F.lit(".")), "v10."),
    "int": (P.INT32, lambda x: x.cast("int"), 10),
    "long": (P.INT64, lambda x: x.cast("bigint"), "10"),
    "short": (P.INT16, lambda x: x.cast("smallint"), 10),
    "byte": (P.BYTE, lambda x: x.cast("smallint"), 10),
    "decimal": (P.DECIMAL, lambda x: x.cast("decimal(18,2)") / 4, "2.5"),
    "double": (P.DOUBLE, lambda x: x / F.lit(4.0), 2.5),
    "float": (P.SINGLE, lambda x: (x / F.lit(4.0)).cast("float"), 2.5),
    "bool": (P.BOOL, lambda x: x == 10, True),
    "guid": (P.GUID, lambda x: F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(x.cast("string"), 12, "0")), "00000000-0000-0000-0000-000000000010"),
    "ts": (P.DATE_TIME, lambda x: _day(x).cast("timestamp_ntz"), "2024-01-11T00:00:00"),
    "tsz": (P.DATE_TIME_OFFSET, lambda x: F.timestamp_seconds(F.lit(1704067200) + x * 86400), "2024-01-11T02:00:00+02:00"),
    "date": (P.DATE_ONLY, _day, "2024-01-11"),
    "time": (P.TIME_ONLY, lambda x: F.concat(F.lpad(x.cast("string"), 2, "0"), F.lit(":30:00")).cast("time(6)"), "10:30"),
    "enum": (enum_profile("Step", [f"S{i}" for i in range(20)]), lambda x: F.concat(F.lit("S"), x.cast("string")), "s10"),
}


def null_query(name: str, node: dict[str, Any], spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.timeType.enabled", "true")
    profile, value, _ = NULLABLE[name]
    df, _ = labelled(spark, sf_dir)
    schema = SchemaBuilder("nullable").add(prop("x", profile, lambda s: value(F.when(s["quality"].isNotNull(), s["doc_id"] % 20))))
    return run(lambda *_: (df, FilterDefinition(schema)), _where(node), spark, sf_dir)


_X = "case when quality is not null then d.doc_id % 20 end"
for _name, (_profile, _, _ten) in NULLABLE.items():
    _nodes = {"is_null": (_leaf("x", "isNull"), f"{_X} is null"), "not_null": ({"not": [_leaf("x", "isNull")]}, f"{_X} is not null"), "null_eq": (_leaf("x", "eq", _ten), f"{_X} = 10"), "null_not_eq": ({"not": [_leaf("x", "eq", _ten)]}, f"{_X} is distinct from 10")}
    if "ne" in _profile.names:
        _nodes |= {"null_ne": (_leaf("x", "ne", _ten), f"{_X} is distinct from 10"), "null_not_ne": ({"not": [_leaf("x", "ne", _ten)]}, f"{_X} = 10")}
    if "in" in _profile.names:
        _nodes |= {"null_not_in": ({"not": [_leaf("x", "in", [_ten])]}, f"{_X} is distinct from 10")}
    if "gt" in _profile.names:
        _nodes |= {"null_gt": (_leaf("x", "gt", _ten), f"{_X} > 10")} | {f"null_not_{op}": ({"not": [_leaf("x", op, _ten)]}, f"not coalesce({_X} {sign} 10, false)") for op, sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="))}
    if "contains" in _profile.names:
        _nodes |= {f"null_not_{op.lower()}": ({"not": [_leaf("x", op, text)]}, f"{_X} is distinct from 10") for op, text in (("contains", "v10"), ("startsWith", "v10"), ("endsWith", "10."))}
    for _op, (_node, _sql) in _nodes.items():
        _ALL[f"{_name}_{_op}"] = (partial(null_query, _name, _node), f"select {LABELLED} where {_sql}")

_ENVELOPE = {"where": _leaf("c_acctbal", "gt", 0), "sort": [{"field": "c_custkey"}], "page": 2, "pageSize": 40}


def paged_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, definition = _CUSTOMERS(spark, sf_dir)
    r = definition.apply_paged(df, wire.decode(json.dumps(_ENVELOPE)))
    row = (len(r.items), r.total_count, r.page, r.page_size, r.total_pages, r.has_previous, r.has_next)
    return spark.createDataFrame([row], "n_items long, total_count long, page long, page_size long, total_pages long, has_previous boolean, has_next boolean")


_ALL["paged_envelope"] = (paged_envelope, "select least(40, greatest(0, n - 40))::bigint as n_items, n as total_count, 2::bigint as page, 40::bigint as page_size, ceil(n / 40.0)::bigint as total_pages, true as has_previous, 2 < ceil(n / 40.0) as has_next from (select count(*) as n from customer where c_acctbal > 0)")


def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, definition = _CUSTOMERS(spark, sf_dir)
    request = {
        "where": {"and": [_leaf("nope", "eq", 1), _leaf("c_name", "gt", "a"), _leaf("c_acctbal", "eq", "x"), _leaf("c_name", "isNull", 1), {"or": []}]},
        "sort": [{"field": "nope"}, {"field": "c_name", "dir": 7}], "page": 0, "pageSize": 500,
    }
    found = definition.validate(wire.decode(json.dumps(request))).errors
    return spark.createDataFrame([(e.path, e.code.name, e.field, e.operator) for e in found], "path string, code string, field string, operator string")


_ALL["validation_errors"] = (validation_errors, """select * from (values ('where.and[0]', 'UnknownField', 'nope', 'eq'), ('where.and[1].op', 'OperatorNotAllowed', 'c_name', 'gt'),
 ('where.and[2].value', 'InvalidValueType', 'c_acctbal', 'eq'), ('where.and[3].value', 'InvalidValueType', 'c_name', 'isNull'), ('where.and[4]', 'GroupEmpty', null, null),
 ('sort[0].field', 'NotSortable', 'nope', null), ('sort[1].dir', 'InvalidSortDirection', 'c_name', null), ('page', 'PageInvalid', null, null), ('pageSize', 'PageSizeTooLarge', null, null)) t(path, code, field, operator)""")

_BUILT = b.request(b.and_(b.field("c_acctbal").gte(1000.5), b.not_(b.field("c_mktsegment").in_(["BUILDING"])), None), b.with_tiebreakers([b.desc("c_acctbal")], b.asc("c_custkey")), 2, 20)
_BUILT_SQL = "select * from customer where c_acctbal >= 1000.5 and not c_mktsegment in ('BUILDING') order by c_acctbal desc nulls last, c_custkey limit 20 offset 20"


def builder_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, definition = _CUSTOMERS(spark, sf_dir)
    return definition.apply(df, wire.decode(wire.encode(_BUILT)))


def query_string_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, definition = _CUSTOMERS(spark, sf_dir)
    return definition.apply(df, wire.from_query_string("?" + wire.to_query_string(_BUILT)))


def _errors(spark: SparkSession, definition: FilterDefinition, request: FilterRequest) -> DataFrame:
    found = definition.validate(request).errors
    return spark.createDataFrame([(e.path, e.code.name, e.field, e.operator) for e in found], "path string, code string, field string, operator string")


def _refuse(value: Any, context: Any) -> Any:
    if value == "refused":
        raise FilterValidationError("refused")
    return value


def limits_and_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that a request read from JSON can't all have."""
    schema = SchemaBuilder("customer", Settings(max_nesting_depth=3, max_leaf_conditions=4)).add(prop("c_name", P.STRING).intercept(scalar=_refuse).sort(), prop("c_acctbal", P.DOUBLE).sort())
    leaf = Leaf("c_acctbal", "gt", 1)
    deep = Group("not", (Group("and", (Group("or", (leaf,)),)),))
    where = Group("and", (deep, Group("xor", (leaf,)), Group("not", (leaf, leaf)), Group("or"), Leaf("c_name", "eq", "refused"), Leaf("c_name", "in", ["a", "refused"]), leaf, leaf, Leaf(None, "eq", 1)))
    return _errors(spark, FilterDefinition(schema), FilterRequest(where, (None, SortItem("c_name", 2)), 3, 0))


_ALL["limits_and_shapes"] = (limits_and_shapes, """select * from (values ('where.and[0].not[0].and[0]', 'NestingTooDeep', null, null), ('where.and[1]', 'InvalidNodeShape', null, null), ('where.and[2]', 'InvalidNodeShape', null, null),
 ('where.and[3]', 'GroupEmpty', null, null), ('where.and[4].value', 'InterceptorRejected', 'c_name', 'eq'), ('where.and[5].value', 'InterceptorRejected', 'c_name', 'in'), ('where.and[8]', 'UnknownField', null, 'eq'),
 ('where', 'TooManyConditions', null, null), ('sort[0].field', 'NotSortable', null, null), ('sort[1].dir', 'InvalidSortDirection', 'c_name', null), ('pageSize', 'PageSizeInvalid', null, null)) t(path, code, field, operator)""")


def page_too_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, definition = _CUSTOMERS(spark, sf_dir)
    return _errors(spark, definition, FilterRequest(page=2**31 - 1, page_size=200))


_ALL["page_too_far"] = (page_too_far, "select 'page' as path, 'PageInvalid' as code, null::varchar as field, null::varchar as operator")


def nested_without_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, definition = navigation(spark, sf_dir, disable_sorting=True)
    return _errors(spark, definition, FilterRequest(Leaf("customer.c_name", "isNull"), (SortItem("customer.c_name"), SortItem("customer.nation.n_name"), SortItem("o_orderkey"))))


_ALL["nested_without_sorting"] = (nested_without_sorting, "select * from (values ('sort[0].field', 'NotSortable', 'customer.c_name', null), ('sort[1].field', 'NotSortable', 'customer.nation.n_name', null)) t(path, code, field, operator)")


def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorting alone does not validate: a page below 1 and a size above the limit are brought inside."""
    df, definition = _CUSTOMERS(spark, sf_dir)
    return definition.apply_sorting(df, FilterRequest(None, (SortItem("c_custkey"),), -4, 100_000))


_ALL["clamped"] = (clamped, "select * from customer order by c_custkey limit 200")


def lifted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, FilterDefinition]:
    """Rules, interceptors and operators of its own go with a schema wherever it is nested."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    customer = SchemaBuilder("customer").add(
        prop("c_mktsegment", P.STRING).alias("segment").intercept(scalar=lambda v, c: v.upper(), array=lambda v, c: sorted(v)),
        rule("rich", lambda s: s["c_acctbal"], unary_op("isRich", lambda c: c > 5000), value_op("near", lambda c, v: F.abs(c - v[0]) <= v[1], type=list[float])).sort(),
        prop("c_acctbal", P.DOUBLE.extend("Near", value_op("near", lambda c, v: F.abs(c - v[0]) <= v[1], type=list[float]))).intercept(scalar=lambda v, c: v * 2),
    )
    return orders, FilterDefinition(SchemaBuilder("orders").add(prop("o_orderkey", P.INT64).sort()).nest(CUSTOMER, customer, prefix="buyer"), {"customer": customers}, verify_keys=True)


for _name, _node, _sql in (
    ("lifted_interceptor", _leaf("buyer.segment", "eq", "building"), "c_mktsegment = 'BUILDING'"),
    ("lifted_array_interceptor", {"not": [_leaf("buyer.segment", "in", ["machinery", "Building"])]}, "c_mktsegment not in ('BUILDING', 'MACHINERY')"),
    ("lifted_rule", _leaf("customer.rich", "isRich"), "c_acctbal > 5000"),
    ("lifted_rule_negated", {"not": [_leaf("buyer.rich", "near", [1000, 500.5])]}, "not (abs(c_acctbal - 1000) <= 500.5)"),
    ("intercept_leaves_typed_values", _leaf("buyer.c_acctbal", "near", [1000, 500]), "abs(c_acctbal - 1000) <= 500"),
    ("intercept_scalar_number", _leaf("buyer.c_acctbal", "gt", 2000), "c_acctbal > 4000"),
):
    _add(_name, lifted, _where(_node), f"{_NESTED} where {_sql}")


def struct_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dotted path reads a member of a struct, without a join."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance")).alias("account"))).alias("person"))
    schema = SchemaBuilder("customer").add(prop("c_custkey", P.INT64).sort(), prop("person.name", P.STRING), prop("person.account.balance", P.DOUBLE).sort())
    request = {"where": {"not": [{"and": [_leaf("person.account.balance", "gt", 1000), _leaf("person.name", "endsWith", "1")]}]}, "sort": [{"field": "person.account.balance"}, {"field": "c_custkey"}], "pageSize": 150}
    return run(lambda *_: (df, FilterDefinition(schema)), request, spark, sf_dir).select("c_custkey")


_ALL["struct_path"] = (struct_path, """select c_custkey from (select c_custkey, case when c_custkey % 3 > 0 then c_name end as name, case when c_custkey % 3 > 0 then c_acctbal end as balance from customer)
 where not (coalesce(balance > 1000, false) and coalesce(suffix(name, '1'), false)) order by balance nulls first, c_custkey limit 150""")
_add("export_filtered_sorted", _CUSTOMERS, _where({"or": [_leaf("c_acctbal", "lt", -500), _leaf("c_mktsegment", "startsWith", "A")]}, sort=[{"field": "c_name"}]), "select * from customer where c_acctbal < -500 or c_mktsegment like 'A%' order by c_name")


def schema_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, definition = simple("region")(spark, sf_dir)
    return definition.schema.describe(spark).select("field", F.size("operators").alias("n_operators"), "sortable").filter(F.col("field") == "r_name")


_ALL["builder_request"] = (builder_request, _BUILT_SQL)
_ALL["query_string_round_trip"] = (query_string_round_trip, _BUILT_SQL)
_ALL["schema_describe"] = (schema_describe, "select 'r_name' as field, 7 as n_operators, true as sortable")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}
