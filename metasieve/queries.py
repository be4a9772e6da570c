"""The registered queries on filters, bags and schemas, each with its SQL."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bag
from .operators.filtering import apply_filter, filter_column
from .operators.layouts import Bag, Flat
from .operators.validation import error_column, split_valid
from .plans.dtypes import DataType
from .plans.filters import And, Condition, FilterMatchOptions, MetadataFilter, MissingKeyPolicy, Never, Not, NumberComparisonPolicy, Or
from .plans.errors import MetadataError
from .plans.schema import MetadataSchema, UnknownFieldPolicy
from .plans.values import Value, json_value, string_map, typed
from .plans.wire import condition_from_wire, condition_to_wire, schema_from_json, schema_to_json
from .sources.folders import shared_root
from .sources.records import bag_from_columns, bag_from_json, bag_to_json, bags_of_rows, columns_from_bag, overlay, rows_of_bag

D = DataType
B = MetadataFilter.builder
NO_MATCH = MissingKeyPolicy.NO_MATCH
APPROXIMATE = NumberComparisonPolicy.APPROXIMATE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; those without have no such key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED_SQL = "(SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
BAG_KEYS = ["lang", "n_chars", "quality", "toxic"]


def labelled_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a typed bag."""
    df = labelled(spark, sf_dir)
    return df.select("doc_id", bag_from_columns(df, BAG_KEYS).alias("bag"))


def register(name: str, sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


def filtered(name: str, source: str | Callable, columns: list[str], make: Callable[[], MetadataFilter], sql_from: str, where: str, layout: Callable | None = None) -> None:
    """A query that filters a table, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source) if isinstance(source, str) else source(spark, sf_dir)
        return apply_filter(df, make(), layout(df) if layout else None).select(*columns)

    register(name, f"SELECT {', '.join(columns)} FROM {sql_from} WHERE {where}")(run)


DOC = ["doc_id", "lang", "n_chars"]
LAB = ["doc_id", "lang"]


def _documents(name: str, make: Callable, where: str) -> None:
    filtered(name, "documents", DOC, make, "documents", where)


def _labelled(name: str, make: Callable, where: str) -> None:
    filtered(name, labelled, LAB, make, LABELLED_SQL, where)


def _in_bag(name: str, make: Callable, where: str) -> None:
    filtered(name, labelled_bag, ["doc_id"], make, LABELLED_SQL, where, lambda df: Bag("bag"))


# predicates
_documents("eq_string", lambda: B().eq("lang", "en").build(), "lang = 'en'")
_documents("ne_string", lambda: B().ne("lang", "en").build(), "lang <> 'en'")
_documents("lt_int", lambda: B().lt("n_chars", 1000).build(), "n_chars < 1000")
_documents("le_int", lambda: B().le("n_chars", 1000).build(), "n_chars <= 1000")
_documents("gt_int", lambda: B().gt("n_chars", 5000).build(), "n_chars > 5000")
_documents("ge_int", lambda: B().ge("n_chars", 5000).build(), "n_chars >= 5000")
filtered("gt_double", "events", ["event_id", "value"], lambda: B().gt("value", 100.0).build(), "events", "value > 100")
filtered("gt_string_lex", "part", ["p_partkey", "p_name"], lambda: B().gt("p_name", "m").build(), "part", "p_name > 'm'")
filtered("in_set", "customer", ["c_custkey"], lambda: B().in_set("c_mktsegment", ["BUILDING", "MACHINERY"]).build(), "customer", "c_mktsegment IN ('BUILDING', 'MACHINERY')")
filtered("not_in_set", "customer", ["c_custkey"], lambda: B().not_in_set("c_mktsegment", ["BUILDING", "MACHINERY"]).build(), "customer", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
filtered("in_empty", "customer", ["c_custkey"], lambda: B().in_set("c_mktsegment", []).build(), "customer", "false")
filtered("not_in_empty", "customer", ["c_custkey"], lambda: B().not_in_set("c_mktsegment", []).build(), "customer", "true")
filtered("in_mixed_types", "part", ["p_partkey"], lambda: B().in_set("p_size", [1, 2.0, 3.5, "4", True]).build(), "part", "p_size IN (1, 2)")
_labelled("exists", lambda: B().exists("quality").build(), "quality IS NOT NULL")
_labelled("not_exists", lambda: B().not_exists("quality").build(), "quality IS NULL")
_labelled("exists_unknown_key", lambda: B().exists("nowhere").or_not_exists("quality").build(), "quality IS NULL")

# missing keys
_labelled("ne_missing_match", lambda: B().ne("quality", 1).build(), "coalesce(quality <> 1, true)")
_labelled("ne_missing_nomatch", lambda: B().ne("quality", 1).missing_key_policy(NO_MATCH).build(), "coalesce(quality <> 1, false)")
_labelled("not_in_missing_match", lambda: B().not_in_set("quality", [1, 7]).build(), "coalesce(quality NOT IN (1, 7), true)")
_labelled("not_in_missing_nomatch", lambda: B().not_in_set("quality", [1, 7]).missing_key_policy(NO_MATCH).build(), "coalesce(quality NOT IN (1, 7), false)")
_labelled("not_in_empty_missing_nomatch", lambda: B().not_in_set("quality", []).missing_key_policy(NO_MATCH).build(), "quality IS NOT NULL")
_labelled("not_over_missing_range", lambda: B().gt("quality", 0).not_().build(), "NOT coalesce(quality > 0, false)")
_labelled("with_options", lambda: B().ne("toxic", 0).build().with_options(FilterMatchOptions(NO_MATCH, APPROXIMATE)), "coalesce(toxic <> 0, false)")
_labelled("with_missing_key_policy", lambda: B().ne("toxic", 0).build().with_missing_key_policy(NO_MATCH), "coalesce(toxic <> 0, false)")


@register("matches_with_options", f"SELECT doc_id, coalesce(toxic <> 0, true) AS own, coalesce(toxic <> 0, false) AS given FROM {LABELLED_SQL}")
def _matches_with_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filter, with its own options and with others for one call."""
    df, f = labelled(spark, sf_dir), B().ne("toxic", 0).build()
    layout = Flat.of(df)
    return df.select("doc_id", f.matches(layout).alias("own"), f.matches(layout, FilterMatchOptions(NO_MATCH)).alias("given"))


# combinators
ORD = ["o_orderkey", "o_totalprice"]


def _orders(name: str, make: Callable, where: str) -> None:
    filtered(name, "orders", ORD, make, "orders", where)


_orders("and_chain", lambda: B().eq("o_orderstatus", "O").and_gt("o_totalprice", 1000.0).and_lt("o_totalprice", 200000.0).build(), "o_orderstatus = 'O' AND o_totalprice > 1000 AND o_totalprice < 200000")
_orders("or_chain", lambda: B().eq("o_orderstatus", "F").or_lt("o_totalprice", 2000.0).or_ge("o_totalprice", 300000.0).build(), "o_orderstatus = 'F' OR o_totalprice < 2000 OR o_totalprice >= 300000")
_orders("left_fold_or_and", lambda: B().eq("o_orderstatus", "F").or_eq("o_orderstatus", "O").and_gt("o_totalprice", 100000.0).build(), "(o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 100000")
_labelled("group_and", lambda: B().eq("lang", "en").and_(lambda g: g.eq("quality", 0).or_eq("toxic", 1)).build(), "lang = 'en' AND coalesce(quality = 0 OR toxic = 1, false)")
_labelled("group_or", lambda: B().eq("lang", "fr").or_(lambda g: g.eq("quality", 0).and_eq("toxic", 0)).build(), "lang = 'fr' OR coalesce(quality = 0 AND toxic = 0, false)")
_labelled("group_and_not", lambda: B().eq("lang", "en").and_not(lambda g: g.eq("quality", 1).or_eq("toxic", 1)).build(), "lang = 'en' AND NOT coalesce(quality = 1 OR toxic = 1, false)")
_labelled("group_or_not", lambda: B().eq("lang", "es").or_not(lambda g: g.exists("quality").and_eq("toxic", 0)).build(), "lang = 'es' OR NOT coalesce(quality IS NOT NULL AND toxic = 0, false)")
_labelled("nested_groups", lambda: B().and_(lambda g: g.eq("lang", "de").or_(lambda h: h.eq("lang", "fr").and_exists("quality"))).or_not(lambda g: g.ne("toxic", 1)).build(), "lang = 'de' OR (lang = 'fr' AND quality IS NOT NULL) OR NOT coalesce(toxic <> 1, true)")
_orders("and_in_set", lambda: B().gt("o_totalprice", 1000.0).and_in_set("o_orderstatus", ["F", "P"]).build(), "o_totalprice > 1000 AND o_orderstatus IN ('F', 'P')")
_orders("and_not_in_set", lambda: B().gt("o_totalprice", 1000.0).and_not_in_set("o_orderstatus", ["F", "P"]).build(), "o_totalprice > 1000 AND o_orderstatus NOT IN ('F', 'P')")
_orders("or_in_set", lambda: B().gt("o_totalprice", 300000.0).or_in_set("o_orderstatus", ["F", "P"]).build(), "o_totalprice > 300000 OR o_orderstatus IN ('F', 'P')")
_orders("or_not_in_set", lambda: B().gt("o_totalprice", 300000.0).or_not_in_set("o_orderstatus", ["F", "P"]).build(), "o_totalprice > 300000 OR o_orderstatus NOT IN ('F', 'P')")
_orders("or_ne_or_le", lambda: B().gt("o_totalprice", 300000.0).or_ne("o_orderstatus", "F").or_le("o_totalprice", 2000.0).build(), "o_totalprice > 300000 OR o_orderstatus <> 'F' OR o_totalprice <= 2000")
_labelled("or_exists", lambda: B().eq("lang", "en").or_exists("quality").build(), "lang = 'en' OR quality IS NOT NULL")
_orders("quirk_and_not_match_all", lambda: B().eq("o_orderstatus", "F").and_not(lambda g: g.not_().and_lt("o_totalprice", 5000.0).not_()).build(), "o_orderstatus = 'F'")
_orders("quirk_or_not_match_all", lambda: B().or_not(lambda g: g.not_().and_lt("o_totalprice", 5000.0).not_()).build(), "true")
for _name, _make, _where in (
    ("match_all", lambda: MetadataFilter.all(), "true"),
    ("match_none", lambda: MetadataFilter.none(), "false"),
    ("not_all", lambda: ~MetadataFilter.all(), "false"),
    ("not_none", lambda: ~MetadataFilter.none(), "true"),
    ("double_not", lambda: B().eq("n_regionkey", 1).not_().not_().build(), "n_regionkey = 1"),
):
    filtered(_name, "nation", ["n_nationkey"], _make, "nation", _where)
_orders("quirk_or_match_all", lambda: B().eq("o_orderstatus", "F").or_not(lambda g: g.not_().and_eq("o_orderstatus", "O")).build(), "o_orderstatus = 'F'")
_orders("quirk_not_first", lambda: B().not_().or_lt("o_totalprice", 5000.0).build(), "o_totalprice < 5000")
_orders("quirk_not_then_and", lambda: B().not_().and_lt("o_totalprice", 5000.0).build(), "false")

# JSON form
EVENT_FILTER = '{"version":1,"expr":{"type":"or","children":[{"type":"condition","condition":{"op":"eq","key":"event_type","value":{"String":"error"}}},{"type":"not","expr":{"type":"condition","condition":{"op":"le","key":"value","value":{"Int64":50}}}}]},"options":{"missing_key_policy":"Match","number_comparison_policy":"Conservative"}}'
filtered("wire_roundtrip_filter", "events", ["event_id"], lambda: MetadataFilter.from_json(MetadataFilter.from_json(EVENT_FILTER).to_json()), "events", "event_type = 'error' OR value > 50")
filtered("wire_unnormalised", "events", ["event_id"], lambda: MetadataFilter(And((Not(Never()), Or((Condition("ge", "user_id", (Value(D.UINT32, 5),)),))))), "events", "user_id >= 5")



def _conditions_by_json() -> MetadataFilter:
    found = [condition_from_wire(json.loads(json.dumps(condition_to_wire(c)))) for c in B().ge("value", 20).and_in_set("event_type", ["error", "click"]).build().conditions()]
    return MetadataFilter(And(tuple(found)))


filtered("wire_conditions", "events", ["event_id"], _conditions_by_json, "events", "value >= 20 AND event_type IN ('error', 'click')")


# numbers
LINE = ["l_orderkey", "l_linenumber"]


def _lines(name: str, make: Callable, where: str) -> None:
    filtered(name, "lineitem", LINE, make, "lineitem", where)


_lines("mixed_int_vs_float_lit", lambda: B().gt("l_orderkey", 100.0).build(), "l_orderkey > 100")
_lines("int_vs_nonintegral", lambda: B().lt("l_orderkey", 100.5).and_ne("l_linenumber", 2.5).build(), "l_orderkey <= 100")
_lines("int_vs_decimal", lambda: B().ge("l_orderkey", Decimal("99.5")).and_eq("l_linenumber", Decimal("1.0")).build(), "l_orderkey >= 100 AND l_linenumber = 1")
_lines("float_vs_int", lambda: B().ge("l_quantity", 25).and_lt("l_quantity", Value(D.UINT8, 30)).build(), "l_quantity >= 25 AND l_quantity < 30")
_lines("int_vs_infinity", lambda: B().lt("l_orderkey", math.inf).and_not(lambda g: g.gt("l_linenumber", -math.inf)).build(), "false")
_lines("type_mismatch_eq", lambda: B().eq("l_orderkey", "1").or_eq("l_returnflag", 1).build(), "false")
_lines("type_mismatch_ne", lambda: B().ne("l_orderkey", "1").and_eq("l_linenumber", 1).build(), "l_linenumber = 1")
_lines("type_mismatch_range", lambda: B().gt("l_returnflag", 0).or_gt("l_shipdate", typed(D.STRING, "1995")).build(), "false")


def _big_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") + (1 << 53) - 100).alias("x"))


BIG_SQL = "(SELECT l_orderkey, l_linenumber, l_orderkey + 9007199254740992 - 100 AS x FROM lineitem)"
filtered("large_int_conservative", _big_keys, LINE, lambda: B().gt("x", 0.5).build(), BIG_SQL, "x <= 9007199254740992")
filtered("large_int_approx", _big_keys, LINE, lambda: B().gt("x", 0.5).number_comparison_policy(APPROXIMATE).build(), BIG_SQL, "true")
filtered("large_int_integral", _big_keys, LINE, lambda: B().gt("x", float(1 << 53)).build(), BIG_SQL, "x > 9007199254740992")


def _events_with_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nan = F.when(F.col("event_id") % 7 == 0, F.lit(math.nan)).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", nan.alias("v"))


NAN_SQL = "(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events)"
filtered("float_nan_guard", _events_with_nan, ["event_id"], lambda: B().gt("v", 50.0).build(), NAN_SQL, "coalesce(v > 50, false)")
filtered("float_nan_negated", _events_with_nan, ["event_id"], lambda: B().gt("v", 50.0).not_().build(), NAN_SQL, "NOT coalesce(v > 50, false)")
filtered("float_nan_ne", _events_with_nan, ["event_id"], lambda: B().ne("v", math.nan).build(), NAN_SQL, "true")


def _decimal_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


DEC_SQL = "(SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders)"
filtered("decimal_vs_int", _decimal_orders, ["o_orderkey"], lambda: B().gt("price", 150000).build(), DEC_SQL, "price > 150000")
filtered("decimal_vs_decimal", _decimal_orders, ["o_orderkey"], lambda: B().le("price", Decimal("99999.995")).build(), DEC_SQL, "price <= 99999.99")
filtered("decimal_vs_float_conservative", _decimal_orders, ["o_orderkey"], lambda: B().gt("price", 150000.0).build(), DEC_SQL, "false")
filtered("decimal_vs_float_approx", _decimal_orders, ["o_orderkey"], lambda: B().gt("price", 150000.0).number_comparison_policy(APPROXIMATE).build(), DEC_SQL, "price::DOUBLE > 150000")


def _unsigned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("decimal(20,0)").alias("u"))


def _as_u64(df: DataFrame) -> Flat:
    return Flat.of(df, tags={"u": D.UINT64})


U_SQL = "(SELECT p_partkey, p_partkey AS u FROM part)"
filtered("u64_vs_signed", _unsigned_parts, ["p_partkey"], lambda: B().gt("u", -1).and_le("u", 500).build(), U_SQL, "u <= 500", _as_u64)
filtered("u64_vs_negative_float", _unsigned_parts, ["p_partkey"], lambda: B().gt("u", -0.5).and_lt("u", Value(D.UINT128, 1 << 100)).build(), U_SQL, "true", _as_u64)


def _wide_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    zeros = F.concat(F.col("p_partkey").cast("string"), F.lit("0" * 40), F.lit(".50"))
    return table(spark, sf_dir, "part").select("p_partkey", zeros.alias("w"))


filtered("wide_numbers", _wide_parts, ["p_partkey"], lambda: B().gt("w", Decimal(500 * 10**40)).and_lt("w", Value(D.BIG_INTEGER, 600 * 10**40)).build(), "part", "p_partkey BETWEEN 500 AND 599", lambda df: Flat.of(df, tags={"w": D.BIG_DECIMAL}))


filtered("in_double", "lineitem", LINE, lambda: B().in_set("l_quantity", [1.5 * k for k in range(2000)]).build(), "lineitem", "l_quantity % 3 = 0")
filtered("not_in_double", "lineitem", LINE, lambda: B().not_in_set("l_quantity", [*(3 * k for k in range(2000)), math.nan, -0.0, 0.5, "3"]).build(), "lineitem", "l_quantity % 3 <> 0")


def _decimal_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("decimal(18,1)").alias("n"))


filtered("in_decimal", _decimal_lengths, ["doc_id"], lambda: B().in_set("n", [Decimal(7 * k) for k in range(2000)]).build(), "documents", "n_chars % 7 = 0 AND n_chars < 14000")
filtered("in_wide", _wide_parts, ["p_partkey"], lambda: B().in_set("w", [Decimal(f"{3 * k}{'0' * 40}.5") for k in range(700)]).build(), "part", "p_partkey % 3 = 0 AND p_partkey < 2100", lambda df: Flat.of(df, tags={"w": D.BIG_DECIMAL}))


def _int128_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys on both sides of zero, and keys far beyond 64 bits."""
    key = F.col("p_partkey") - 1000
    return table(spark, sf_dir, "part").select("p_partkey", key.cast("string").alias("i"), F.concat(F.col("p_partkey").cast("string"), F.lit("0" * 30)).alias("u"))


def _as_128(df: DataFrame) -> Flat:
    return Flat.of(df, tags={"i": D.INT128, "u": D.UINT128})


filtered("i128_vs_float", _int128_parts, ["p_partkey"], lambda: B().gt("i", -10.5).and_le("i", 20.0).build(), "part", "p_partkey BETWEEN 990 AND 1020", _as_128)
filtered("u128_vs_float_conservative", _int128_parts, ["p_partkey"], lambda: B().gt("u", 5e32).build(), "part", "false", _as_128)
filtered("u128_vs_float_approx", _int128_parts, ["p_partkey"], lambda: B().gt("u", 5.005e32).build().with_number_comparison_policy(APPROXIMATE), "part", "p_partkey > 500", _as_128)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", (F.col("quality") == 1).alias("good"), F.col("lang").alias("link"))


FLAG_SQL = "(SELECT doc_id, quality = 1 AS good, lang AS link FROM documents LEFT JOIN labels USING (doc_id))"
filtered("bool_eq", _flags, ["doc_id"], lambda: B().eq("good", True).build(), FLAG_SQL, "coalesce(good, false)")
filtered("bool_range", _flags, ["doc_id"], lambda: B().ge("good", False).or_gt("good", 0).build(), FLAG_SQL, "false")
filtered("url_is_no_string", _flags, ["doc_id"], lambda: B().eq("link", "en").or_eq("link", typed(D.URL, "fr")).build(), FLAG_SQL, "link = 'fr'", lambda df: Flat.of(df, tags={"link": D.URL}))


def _struct_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", "n_chars").alias("md"))


filtered("struct_layout", _struct_docs, ["doc_id"], lambda: B().eq("lang", "de").and_gt("n_chars", 3000).build(), "documents", "lang = 'de' AND n_chars > 3000", lambda df: Flat.of(df, inside="md"))


# streams
def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter on a stream of ``events``, run to its end."""
    import uuid

    from .streaming.frames import filter_stream, read_stream, write_available

    like = table(spark, sf_dir, "events")
    root = f"{shared_root(spark)}/metasieve-stream-{uuid.uuid4().hex}"
    stream = read_stream(spark, f"{sf_dir}/events.parquet*", like)
    write_available(filter_stream(stream, B().eq("event_type", "error").or_gt("value", 150).build(), Flat.of(like)), f"{root}/out", f"{root}/state")
    return spark.read.schema(like.schema).parquet(f"{root}/out").select("event_id", "event_type")


register("stream_filter", "SELECT event_id, event_type FROM events WHERE event_type = 'error' OR value > 150")(_streamed)


# bags
def _props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events.props`` as a bag of one Int64 ``k`` where it is a number, with a String ``kind``."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", bag.bag_of({"k": bag.entry(k, D.INT64), "kind": bag.entry(F.col("event_type"), D.STRING)}).alias("bag"))


PROPS_SQL = "(SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"

def the_bag() -> Column:
    return F.col("bag")



def _bag_query(name: str, source: Callable, columns: Callable[[], list], sql: str) -> None:
    register(name, sql)(lambda spark, sf_dir: source(spark, sf_dir).select(*columns()))


_bag_query("get_typed", _props, lambda: ["event_id", bag.get(the_bag(), "k", D.INT64).alias("k"), bag.get(the_bag(), "k", D.FLOAT64).alias("as_double"), bag.get(the_bag(), "kind", D.INT64).isNull().alias("none")], f"SELECT event_id, k, k::DOUBLE AS as_double, true AS none FROM {PROPS_SQL}")


def _statuses() -> list:
    got = {n: bag.try_get(the_bag(), k, D.INT64) for n, k in (("k", "k"), ("kind", "kind"), ("nokey", "absent"))}
    return ["event_id", got["k"]["value"].alias("value"), *[F.coalesce(g["error"]["code"], F.lit("ok")).alias(f"{n}_status") for n, g in got.items()], got["nokey"]["error"]["message"].alias("message")]


_bag_query("try_get_status", _props, _statuses, f"SELECT event_id, k AS value, 'ok' AS k_status, 'TypeMismatch' AS kind_status, 'MissingKey' AS nokey_status, 'Metadata key not found: absent' AS message FROM {PROPS_SQL}")
_bag_query("get_or_default", labelled_bag, lambda: ["doc_id", bag.get_or(the_bag(), "quality", -1).alias("quality"), bag.get_or(the_bag(), "lang", -1).alias("lang_number")], f"SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality, -1::BIGINT AS lang_number FROM {LABELLED_SQL}")
_bag_query("data_type_tag", labelled_bag, lambda: ["doc_id", bag.data_type(the_bag(), "n_chars").alias("a"), bag.data_type(the_bag(), "quality").alias("b"), bag.data_type(the_bag(), "lang").alias("c")], f"SELECT doc_id, 'int64' AS a, CASE WHEN quality IS NOT NULL THEN 'int32' END AS b, 'string' AS c FROM {LABELLED_SQL}")
_bag_query("bag_len", labelled_bag, lambda: ["doc_id", bag.length(the_bag()).alias("n"), bag.is_empty(the_bag()).alias("empty"), bag.contains_key(the_bag(), "toxic").alias("has")], f"SELECT doc_id, CASE WHEN quality IS NULL THEN 2 ELSE 4 END AS n, false AS empty, toxic IS NOT NULL AS has FROM {LABELLED_SQL}")
_bag_query("bag_keys_sorted", labelled_bag, lambda: ["doc_id", F.concat_ws(",", bag.keys(the_bag())).alias("keys")], f"SELECT doc_id, CASE WHEN quality IS NULL THEN 'lang,n_chars' ELSE 'lang,n_chars,quality,toxic' END AS keys FROM {LABELLED_SQL}")
_bag_query("bag_values", labelled_bag, lambda: ["doc_id", F.concat_ws(",", F.transform(bag.values(the_bag()), lambda e: F.coalesce(e["s"], e["i"].cast("string")))).alias("vals")], f"SELECT doc_id, concat_ws(',', lang, n_chars, quality, toxic) AS vals FROM {LABELLED_SQL}")


def _set() -> list:
    m = bag.set_value(bag.set_value(the_bag(), "quality", 9), "new", "x")
    return ["doc_id", bag.get(m, "quality", D.INT64).alias("q"), bag.get(m, "new", D.STRING).alias("new"), bag.length(m).alias("n"), F.coalesce(bag.get(the_bag(), "quality", D.INT64), F.lit(-1)).alias("old")]


_bag_query("bag_set", labelled_bag, _set, f"SELECT doc_id, 9::BIGINT AS q, 'x' AS new, CASE WHEN quality IS NULL THEN 4 ELSE 5 END AS n, coalesce(quality, -1)::BIGINT AS old FROM {LABELLED_SQL}")
_bag_query("bag_remove", labelled_bag, lambda: ["doc_id", bag.length(bag.remove(the_bag(), "lang")).alias("n"), bag.length(bag.clear(the_bag())).alias("cleared"), bag.length(bag.set_raw(the_bag(), "x", bag.get_raw(the_bag(), "lang"))).alias("more")], f"SELECT doc_id, CASE WHEN quality IS NULL THEN 1 ELSE 3 END AS n, 0 AS cleared, CASE WHEN quality IS NULL THEN 3 ELSE 5 END AS more FROM {LABELLED_SQL}")


def _merge() -> list:
    other = bag.bag_of({"lang": bag.literal_entry("xx"), "extra": bag.literal_entry(1.5)})
    m = bag.merge(the_bag(), other)
    return ["doc_id", bag.get(m, "lang", D.STRING).alias("lang"), bag.get(m, "extra", D.FLOAT64).alias("extra"), bag.length(m).alias("n"), bag.equal(bag.merge(other, the_bag()), the_bag()).alias("same")]


_bag_query("bag_merge", labelled_bag, _merge, f"SELECT doc_id, 'xx' AS lang, 1.5::DOUBLE AS extra, CASE WHEN quality IS NULL THEN 3 ELSE 5 END AS n, false AS same FROM {LABELLED_SQL}")
_bag_query("bag_retain", labelled_bag, lambda: ["doc_id", F.concat_ws(",", bag.keys(bag.retain(the_bag(), lambda k, e: e["i"] > 0))).alias("kept")], f"SELECT doc_id, concat_ws(',', CASE WHEN n_chars > 0 THEN 'n_chars' END, CASE WHEN quality > 0 THEN 'quality' END, CASE WHEN toxic > 0 THEN 'toxic' END) AS kept FROM {LABELLED_SQL}")


@register("bag_iter", f"""SELECT doc_id, pos, key, val FROM (SELECT doc_id, unnest(CASE WHEN quality IS NULL THEN [0, 1] ELSE [0, 1, 2, 3] END) AS pos,
  unnest(CASE WHEN quality IS NULL THEN ['lang', 'n_chars'] ELSE ['lang', 'n_chars', 'quality', 'toxic'] END) AS key,
  unnest(CASE WHEN quality IS NULL THEN [lang, n_chars::VARCHAR] ELSE [lang, n_chars::VARCHAR, quality::VARCHAR, toxic::VARCHAR] END) AS val FROM {LABELLED_SQL})""")
def _bag_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of_bag(labelled_bag(spark, sf_dir), "doc_id", "bag")
    return rows.select("doc_id", "pos", "key", F.coalesce(F.col("value.s"), F.col("value.i").cast("string")).alias("val"))


@register("bag_from_rows", f"SELECT doc_id, CASE WHEN quality IS NULL THEN 2 ELSE 4 END AS n, coalesce(quality, -1)::BIGINT AS quality FROM {LABELLED_SQL}")
def _bag_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of_bag(labelled_bag(spark, sf_dir), "doc_id", "bag")
    return bags_of_rows(rows, "doc_id", "pos").select("doc_id", bag.length(the_bag()).alias("n"), F.coalesce(bag.get(the_bag(), "quality", D.INT64), F.lit(-1)).alias("quality"))


@register("bag_overlay", "SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM (SELECT doc_id, lang FROM documents) FULL JOIN (SELECT doc_id, quality::BIGINT AS quality FROM labels) USING (doc_id)")
def _bag_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    a = docs.select("doc_id", bag_from_columns(docs, ["lang"]).alias("bag"))
    b = labels.select("doc_id", bag_from_columns(labels, ["quality"]).alias("bag"))
    return overlay(a, b, "doc_id", "bag").select("doc_id", bag.get(the_bag(), "lang", D.STRING).alias("lang"), F.coalesce(bag.get(the_bag(), "quality", D.INT64), F.lit(-1)).alias("quality"))


_bag_query("record_to_json", labelled_bag, lambda: ["doc_id", bag_to_json(the_bag()).alias("js")], f"""SELECT doc_id, '{{"lang":{{"String":"' || lang || '"}},"n_chars":{{"Int64":' || n_chars || '}}' || CASE WHEN quality IS NULL THEN '' ELSE ',"quality":{{"Int32":' || quality || '}},"toxic":{{"Int32":' || toxic || '}}' END || '}}' AS js FROM {LABELLED_SQL}""")
_bag_query("record_json_roundtrip", labelled_bag, lambda: ["doc_id", bag.equal(bag_from_json(bag_to_json(the_bag())), the_bag()).alias("same")], "SELECT doc_id, true AS same FROM documents")


@register("columns_from_bag", f"SELECT doc_id, lang, n_chars, true AS other_type FROM {LABELLED_SQL}")
def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = MetadataSchema.builder().required("lang", D.STRING).required("n_chars", D.INT64).optional("quality", D.INT64).build()
    out = columns_from_bag(labelled_bag(spark, sf_dir), "bag", schema)
    return out.select("doc_id", "lang", "n_chars", F.col("quality").isNull().alias("other_type"))


_in_bag("bag_filter_eq", lambda: B().eq("lang", "en").and_eq("quality", 1.0).build(), "lang = 'en' AND coalesce(quality = 1, false)")
_in_bag("bag_filter_range", lambda: B().gt("n_chars", 2000.5).and_le("n_chars", Value(D.UINT64, 9000)).build(), "n_chars > 2000 AND n_chars <= 9000")
_in_bag("bag_filter_ne_missing", lambda: B().ne("quality", 1).build(), "coalesce(quality <> 1, true)")
_in_bag("bag_filter_ne_missing_nomatch", lambda: B().ne("quality", 1).missing_key_policy(NO_MATCH).build(), "coalesce(quality <> 1, false)")
_in_bag("bag_in_long", lambda: B().in_set("n_chars", [7 * k for k in range(2000)]).build(), "n_chars % 7 = 0 AND n_chars < 14000")
_in_bag("bag_in_long_mixed", lambda: B().in_set("n_chars", [Decimal(7 * k) if k % 2 else float(7 * k) for k in range(200)]).build(), "n_chars % 7 = 0 AND n_chars < 1400")
_in_bag("bag_filter_in", lambda: B().in_set("lang", ["fr", "es", 3]).build(), "lang IN ('fr', 'es')")
_in_bag("bag_filter_not_in", lambda: B().not_in_set("quality", [Decimal(1), "1"]).build(), "coalesce(quality <> 1, true)")
_in_bag("bag_filter_exists", lambda: B().exists("toxic").and_not_exists("nowhere").build(), "toxic IS NOT NULL")
_in_bag("bag_filter_not_range", lambda: B().lt("quality", 1).not_().build(), "NOT coalesce(quality < 1, false)")
_in_bag("bag_filter_mismatch", lambda: B().gt("lang", 0).or_eq("n_chars", "1").build(), "false")


def _special(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"j": bag.literal_entry(json_value({"b": 1, "a": [True, None]})), "m": bag.literal_entry(string_map({"k": "v", "a": "b"})), "id": bag.entry(F.col("n_nationkey"), D.INT32)}
    return table(spark, sf_dir, "nation").select("n_nationkey", bag.bag_of(fields).alias("bag"))


filtered("bag_json_and_map", _special, ["n_nationkey"], lambda: B().eq("j", json_value({"a": [True, None], "b": 1})).and_ne("j", json_value({"a": [True, None], "b": 1.0})).and_eq("m", string_map({"a": "b", "k": "v"})).and_gt("id", 3).build(), "nation", "n_nationkey > 3", lambda df: Bag("bag"))


# schemas
def _checked(name: str, make: Callable[[], MetadataSchema], code: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = error_column(make(), Bag("bag"))
        return labelled_bag(spark, sf_dir).select("doc_id", e["code"].alias("code"), e["key"].alias("key"), e["message"].alias("message"))

    register(name, f"SELECT doc_id, {code} FROM {LABELLED_SQL}")(run)


S = MetadataSchema.builder
_ALL = lambda: S().required("lang", D.STRING).required("n_chars", D.INT64).optional("quality", D.INT32)
_checked("validate_required", lambda: _ALL().optional("toxic", D.INT32).required("quality", D.INT32).build(), "CASE WHEN quality IS NULL THEN 'MissingRequiredField' END AS code, CASE WHEN quality IS NULL THEN 'quality' END AS key, CASE WHEN quality IS NULL THEN 'Required metadata key ''quality'' is missing (expected int32)' END AS message")
_checked("validate_type", lambda: S().required("lang", D.STRING).required("n_chars", D.FLOAT64).unknown_field_policy(UnknownFieldPolicy.ALLOW).build(), "'TypeMismatch' AS code, 'n_chars' AS key, 'expected float64, got int64' AS message")
_checked("validate_unknown_reject", lambda: _ALL().build(), "CASE WHEN toxic IS NOT NULL THEN 'UnknownField' END AS code, CASE WHEN toxic IS NOT NULL THEN 'toxic' END AS key, CASE WHEN toxic IS NOT NULL THEN 'Metadata key ''toxic'' is not defined in schema' END AS message")
_checked("validate_unknown_allow", lambda: _ALL().unknown_field_policy(UnknownFieldPolicy.ALLOW).build(), "NULL::VARCHAR AS code, NULL::VARCHAR AS key, NULL::VARCHAR AS message")
_checked("validate_first_error", lambda: S().required("zz", D.BOOL).required("quality", D.STRING).build(), "'MissingRequiredField' AS code, CASE WHEN quality IS NULL THEN 'quality' ELSE 'zz' END AS key, CASE WHEN quality IS NULL THEN 'Required metadata key ''quality'' is missing (expected string)' ELSE 'Required metadata key ''zz'' is missing (expected bool)' END AS message")
_checked("validate_empty_schema", lambda: MetadataSchema(), "'UnknownField' AS code, 'lang' AS key, 'Metadata key ''lang'' is not defined in schema' AS message")


@register("validate_flat", f"SELECT doc_id, CASE WHEN quality IS NULL THEN 'MissingRequiredField' ELSE 'TypeMismatch' END AS code, CASE WHEN quality IS NULL THEN 'quality' ELSE 'toxic' END AS key FROM {LABELLED_SQL}")
def _validate_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = S().required("quality", D.INT32).optional("toxic", D.BOOL).unknown_field_policy(UnknownFieldPolicy.ALLOW).build()
    df = labelled(spark, sf_dir)
    e = error_column(schema, Flat.of(df))
    return df.select("doc_id", e["code"].alias("code"), e["key"].alias("key"))


@register("quarantine_split", f"SELECT doc_id, quality IS NOT NULL AS valid FROM {LABELLED_SQL}")
def _quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = S().required("quality", D.INT32).unknown_field_policy(UnknownFieldPolicy.ALLOW).build()
    good, bad = split_valid(labelled(spark, sf_dir), schema)
    return good.select("doc_id", F.lit(True).alias("valid")).unionByName(bad.select("doc_id", F.lit(False).alias("valid")))


@register("build_checked", "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 1000")
def _build_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = S().required("lang", D.STRING).required("n_chars", D.INT64).build()
    f = B().eq("lang", "en").and_ge("n_chars", 1000.0).build_checked(schema)
    return apply_filter(table(spark, sf_dir, "documents"), f).select("doc_id")


@register("match_column", f"SELECT doc_id, coalesce(quality = 1, false) AS good, coalesce(toxic <> 0, true) AS doubtful FROM {LABELLED_SQL}")
def _match_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    layout = Flat.of(df)
    return df.select("doc_id", filter_column(B().eq("quality", 1).build(), layout).alias("good"), filter_column(B().ne("toxic", 0).build(), layout).alias("doubtful"))


# errors, by what each says
def _said(make: Callable[[], object]) -> str:
    try:
        make()
    except MetadataError as e:
        return str(e)
    return "no error"


def _errors(name: str, cases: Callable[[], dict[str, Callable]], want: dict[str, str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        said = {k: _said(make) for k, make in cases().items()}
        return table(spark, sf_dir, "region").select("r_regionkey", *[F.lit(v).alias(k) for k, v in said.items()])

    quoted = ", ".join("'" + v.replace("'", "''") + f"' AS {k}" for k, v in want.items())
    register(name, f"SELECT r_regionkey, {quoted} FROM region")(run)


_DOCUMENT = lambda: S().required("lang", D.STRING).required("n_chars", D.INT64).optional("clean", D.BOOL).build()
_errors("filter_errors", lambda: {
    "unknown": lambda: B().eq("language", "en").build_checked(_DOCUMENT()),
    "bool_range": lambda: B().ge("clean", True).build_checked(_DOCUMENT()),
    "other_type": lambda: B().in_set("lang", ["en", 5]).build_checked(_DOCUMENT()),
    "empty_group": lambda: B().eq("lang", "en").or_not(lambda g: g).build(),
    "fine": lambda: B().gt("n_chars", 2.5).and_lt("lang", "f").and_eq("clean", True).build_checked(_DOCUMENT()),
}, {
    "unknown": "Metadata filter references key 'language' not defined in schema",
    "bool_range": "Metadata filter operator 'ge' is invalid for key 'clean' with type bool: range operators require a numeric or string field",
    "other_type": "Metadata filter operator 'in_set' is invalid for key 'lang' with type string: filter value type int64 is not compatible with field type string",
    "empty_group": "Metadata filter expression is invalid: empty 'or_not' filter group is not allowed",
    "fine": "no error",
})
_errors("set_checked_errors", lambda: {
    "wrong_type": lambda: bag.set_checked(_DOCUMENT(), the_bag(), "n_chars", "many"),
    "unknown": lambda: bag.set_checked(_DOCUMENT(), the_bag(), "pages", 3),
}, {
    "wrong_type": "Metadata key 'n_chars' expected int64 but actual string: expected int64, got string",
    "unknown": "Metadata key 'pages' is not defined in schema",
})
_bag_query("bag_set_checked", labelled_bag, lambda: ["doc_id", bag.get(bag.set_checked(_DOCUMENT(), the_bag(), "n_chars", 12), "n_chars", D.INT64).alias("n_chars"), bag.get(the_bag(), "n_chars", D.INT64).alias("before")], "SELECT doc_id, 12::BIGINT AS n_chars, n_chars AS before FROM documents")


@register("schema_json", "SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'MissingRequiredField' ELSE 'UnknownField' END AS code FROM documents")
def _schema_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by a schema that has been to JSON and back."""
    df = table(spark, sf_dir, "documents")
    e = error_column(schema_from_json(schema_to_json(_DOCUMENT())), Flat.of(df))
    return df.select("doc_id", e["code"].alias("code"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of high value among the events."""
    return apply_filter(table(spark, sf_dir, "events"), B().eq("event_type", "error").and_gt("value", 100.0).build())


register("flagship", "SELECT * FROM events WHERE event_type = 'error' AND value > 100")(flagship)
