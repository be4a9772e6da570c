"""Filters, bags and validation on small tables; plans; every registered query against its SQL."""

import glob
import math
import os
import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from metasieve import Bag, DataType, Flat, MetadataFilter, MetadataSchema, TypeMismatch, UnknownField, UnknownFieldPolicy, Value, apply_filter, filter_column, require_valid, split_valid, value_of
from metasieve.functions import bag
from metasieve.plans.filters import And, Condition, FilterMatchOptions, MissingKeyPolicy, Not, NumberComparisonPolicy, Or
from metasieve.queries import ORACLE_SQL, QUERIES
from metasieve.sources.records import bag_from_json, bag_to_json
from metasieve.streaming.frames import read_stream, write_split

from .model import matches

B = MetadataFilter.builder
D = DataType
DATA = "/root/testdata/sf0.001"


def pushed(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("PushedFilters") :].split("ReadSchema")[0]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    spark.range(100).select(F.col("id").alias("n"), (F.col("id") % 3).cast("string").alias("s"), F.col("id").cast("double").alias("f")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_pushdown(events):
    assert "GreaterThan(n,10)" in pushed(apply_filter(events, B().gt("n", 10).build()))
    assert "GreaterThan(n,100)" in pushed(apply_filter(events, B().gt("n", 100.5).build()))
    assert "LessThanOrEqual(n,10)" in pushed(apply_filter(events, B().gt("n", 10).not_().build()))
    assert "In(s" in pushed(apply_filter(events, B().in_set("s", ["0", "1"]).build()))
    assert "GreaterThan(f,1.0)" in pushed(apply_filter(events, B().gt("f", 1).build()))
    assert "ReadSchema: struct<n:bigint>" in apply_filter(events, B().gt("n", 10).build()).select("n")._jdf.queryExecution().executedPlan().toString()


def random_expr(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        op = rng.choice(("eq", "ne", "lt", "ge", "in", "not_in", "exists", "not_exists"))
        key = rng.choice("abx")
        pool = [value_of(x) for x in (0, 1, 2.5, "p", "q", True)]
        n = 0 if "exists" in op else rng.randint(0, 3) if "in" in op else 1
        return Condition(op, key, tuple(rng.choice(pool) for _ in range(n)))
    if rng.random() < 0.3:
        return Not(random_expr(rng, depth - 1))
    return rng.choice((And, Or))(tuple(random_expr(rng, depth - 1) for _ in range(rng.randint(1, 3))))


def test_random_trees(spark):
    rng = random.Random(7)
    records = [{"a": a, "b": b} for a in (None, 0, 1, 3) for b in (None, "p", "q")]
    df = spark.createDataFrame([(i, r["a"], r["b"]) for i, r in enumerate(records)], "i int, a long, b string").coalesce(1)
    df = df.withColumn("bag", Flat.of(df).to_bag(["a", "b"]))
    typed = [{k: value_of(v) for k, v in r.items() if v is not None} for r in records]
    cases = []
    for _ in range(12):
        options = FilterMatchOptions(rng.choice(list(MissingKeyPolicy)))
        cases.append((random_expr(rng, 2), options, rng.choice((Flat.of(df), Bag("bag")))))
    got = df.select("i", F.array(*[filter_column(MetadataFilter(e, o), layout) for e, o, layout in cases]).alias("got")).collect()
    for r in got:
        for (e, o, layout), g in zip(cases, r.got, strict=True):
            assert g == matches(e, typed[r.i], o), (e, o, layout, records[r.i])


@pytest.mark.parametrize("policy", list(NumberComparisonPolicy))
def test_long_lists(spark, policy):
    """Thousands of values of all types against every kind of column, and the same as bags."""
    edge = [0, -1, 3, 255, 1 << 53, (1 << 53) + 1, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, 1 << 64, 1 << 100]
    longs, doubles = [-1, 0, 3, (1 << 53) + 1, (1 << 63) - 1, None], [-0.0, 0.5, 2.0**63, math.nan, math.inf, None]
    rows = [(i, longs[i], doubles[i], doubles[i], Decimal(x) if x is not None else None, w, bool(i % 2), f"{i}") for i, (x, w) in enumerate(zip(("0.5", "3", "-1", "18446744073709551615", "7.25", None), ("3", "1e2", "18446744073709551616", "0.50", "-1", None), strict=True))]
    df = spark.createDataFrame(rows, "i int, l long, d double, f float, x decimal(22,2), w string, b boolean, s string").coalesce(1)
    tags = {"w": D.BIG_DECIMAL, "x": D.BIG_DECIMAL}
    flat = Flat.of(df, tags=tags)
    keys = ["l", "d", "f", "x", "w", "b", "s"]
    records = [{k: value_of(v) if k not in ("f", "w") else Value(D.FLOAT32, v) if k == "f" else Value(D.BIG_DECIMAL, Decimal(v)) for k, v in zip(df.columns[1:], r[1:], strict=True) if v is not None} for r in rows]
    rng = random.Random(2)
    noise = [value_of(rng.choice((k * 7 + 10_000, k + 0.25, Decimal(k) / 8 + 10_000, f"t{k}"))) for k in range(15)]
    lists = [noise + [value_of(x) for x in (*edge, True, "4", Decimal("0.5"))], noise + [value_of(float(x)) for x in edge] + [value_of(x) for x in (math.nan, math.inf, 0.5, -0.0)], noise + [Value(D.UINT64, 3), Value(D.INT128, 1 << 63), Value(D.FLOAT32, 0.5), Value(D.UINT64, (1 << 64) - 1)]]
    df = df.withColumn("bag", flat.to_bag(keys))
    options = FilterMatchOptions(number_comparison_policy=policy)
    cases = [(Condition("in", k, tuple(values)), flat) for values in lists for k in keys] + [(Condition("in", k, tuple(lists[1] + lists[0][-13:])), Bag("bag")) for k in "ldw"]
    got = df.select("i", F.array(*[filter_column(MetadataFilter(c, options), layout) for c, layout in cases]).alias("got")).collect()
    for r in got:
        for (c, layout), g in zip(cases, r.got, strict=True):
            assert g == matches(c, records[r.i], options), (c.key, layout, records[r.i])


def test_wide_groups(spark):
    b = B()
    for k in range(150):
        b.or_eq(f"k{k}", 1).or_eq("i", k) if k % 2 else b.or_gt("i", 5000 + k)
    df = spark.range(3).select(F.col("id").alias("i"))
    assert apply_filter(df, b.build()).count() == 1


def test_split_with_an_error_column(spark):
    schema = MetadataSchema.builder().required("n", D.INT64).unknown_field_policy(UnknownFieldPolicy.ALLOW).build()
    good, bad = split_valid(spark.createDataFrame([(1, "a"), (None, "b")], "n long, Error string"), schema)
    assert [tuple(r) for r in good.collect()] == [(1, "a")] and good.columns == ["n", "Error"]
    (r,) = bad.collect()
    assert bad.columns == ["n", "Error", "_error"] and r.Error == "b" and r._error.code == "MissingRequiredField"
    assert error_of_empty(spark, schema) == (0, 0)


def error_of_empty(spark, schema):
    good, bad = split_valid(spark.createDataFrame([], "n long, error string"), schema)
    return good.count(), bad.count()


def test_repeated_batches_leave_no_row_twice(spark, tmp_path):
    schema = MetadataSchema.builder().required("n", D.INT64).unknown_field_policy(UnknownFieldPolicy.ALLOW).build()
    like = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "n long, error string")
    like.write.parquet(f"{tmp_path}/in")
    for state in ("s1", "s2"):  # without the first one's progress, its batches come again
        write_split(read_stream(spark, f"{tmp_path}/in", like), schema, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/{state}")
    assert sorted(r.n for r in spark.read.parquet(f"{tmp_path}/good").collect()) == [1, 3]
    assert [r._error.key for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["n"]


def test_null_bag_is_an_empty_record(spark):
    df = spark.createDataFrame([(1,)], "i int").select(F.lit(None).cast(bag.BAG).alias("bag"))
    cols = [B().eq("k", 1).build(), B().ne("k", 1).build(), B().exists("k").build(), B().not_exists("k").build()]
    assert df.select(*[filter_column(c, Bag("bag")) for c in cols]).first() == (False, True, False, True)


def test_bag_functions(spark):
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), bag.literal_entry(x).alias("value")) for k, x in (("z", 1), ("a", "é"), ("z", 2.5))])
    df = spark.range(1).select(bag.from_pairs(pairs).alias("m"))
    m = F.col("m")
    r = df.select(bag.length(m), bag.get(m, "z", D.FLOAT64), bag.keys(m), bag.get(m, "a", D.INT64), bag.equal(m, bag.canonical(m)), bag.length(bag.empty())).first()
    assert tuple(r) == (2, 2.5, ["a", "z"], None, True, 0)
    text = df.select(bag_to_json(m).alias("j")).first().j
    assert text == '{"a":{"String":"é"},"z":{"Float64":2.5}}'
    assert df.select(bag.equal(bag_from_json(F.lit(text)), m)).first()[0]
    schema = MetadataSchema.builder().required("n", D.INT64).build()
    assert df.select(bag.get(bag.set_checked(schema, m, "n", 4), "n", D.INT64)).first()[0] == 4
    with pytest.raises(TypeMismatch):
        bag.set_checked(schema, m, "n", "x")
    with pytest.raises(UnknownField):
        bag.set_checked(schema, m, "other", 1)
    with pytest.raises(Exception, match="Metadata key not found: none"):
        df.select(bag.get_or_fail(m, "none", D.INT64)).collect()


def test_failing_mode(spark):
    schema = MetadataSchema.builder().required("id", D.INT64).build()
    assert require_valid(spark.range(2), schema).count() == 2
    with pytest.raises(Exception, match="is missing"):
        require_valid(spark.createDataFrame([(None,)], "id long"), schema).collect()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    columns = sorted(QUERIES[name](spark, DATA).columns)
    got = sorted(map(repr, (tuple(r) for r in QUERIES[name](spark, DATA).select(*columns).collect())))
    want = sorted(map(repr, duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()))
    assert got == want
