"""Every number type against every other, over flat columns and the bag, against the plain model."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from metasieve import Bag, DataType, FilterMatchOptions, Flat, NumberComparisonPolicy, Value, filter_column
from metasieve.functions import bag
from metasieve.functions.wide import literal_key, wide_key
from metasieve.plans.dtypes import FLOATS, NUMERIC, SPARK_TYPES, integer_bounds
from metasieve.plans.filters import Condition, MetadataFilter, Not

from .model import matches

D = DataType
P53, P63, P64 = 1 << 53, 1 << 63, 1 << 64
INTS = [0, 1, -1, 2, 5, 10, 127, 200, P53, P53 + 1, -P53, -P53 - 1, P63 - 1, -P63, P63, P63 + 123, P64 - 1, P64, (1 << 127) - 1, -(1 << 127), (1 << 128) - 1, 10**40]
FLOAT_VALUES = [0.0, -0.0, 0.5, -0.5, 2.0, 4.5, 10.0, float(P53), float(P53 + 2), float(P63), -float(P63), float(P64), 1e30, 1e300, math.inf, -math.inf, math.nan]
DECIMALS = [Decimal(x) for x in ("0", "10", "10.5", "-0.25", "9007199254740993", "1e45", "-123.456", "18446744073709551615.5")]


def samples(tag):
    if tag in FLOATS:
        return [Value(tag, x) for x in FLOAT_VALUES if tag == D.FLOAT64 or abs(x) < 1e38 or not math.isfinite(x)]
    if tag == D.BIG_DECIMAL:
        return [Value(tag, x) for x in DECIMALS]
    low, high = integer_bounds(tag) or (-(10**50), 10**50)
    return [Value(tag, x) for x in INTS if low <= x <= high]


LITERALS = [v for t in (D.INT64, D.UINT64, D.INT128, D.UINT128, D.FLOAT32, D.FLOAT64, D.BIG_INTEGER, D.BIG_DECIMAL) for v in samples(t)]


def text(v):
    return f"{v.data:f}" if isinstance(v.data, Decimal) else str(v.data)


def stored_column(tag):
    return F.col("text").cast(SPARK_TYPES[tag]) if tag not in FLOATS else F.col("text").cast("double").cast(SPARK_TYPES[tag])


def cases_for(tag, n, rng):
    """A sample of predicates on ``k``, some negated."""
    near = [v for v in LITERALS if v.tag in FLOATS] + LITERALS
    out = []
    for _ in range(n):
        c = Condition(rng.choice(("eq", "ne", "lt", "le", "gt", "ge")), "k", (rng.choice(near),))
        out.append(Not(c) if rng.random() < 0.3 else c)
    many = Condition(rng.choice(("in", "not_in")), "k", tuple(rng.sample(LITERALS, 4)))
    return [*out, many]


@pytest.mark.parametrize("tag", sorted(NUMERIC, key=lambda t: t.value), ids=str)
def test_sampled_matrix(spark, tag):
    # many small expressions: interpreting them is quicker than compiling them
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    rng = random.Random(str(tag))
    stored = samples(tag)
    rows = [(i, repr(v.data) if tag in FLOATS else text(v)) for i, v in enumerate(stored)]
    rows = [(i, {"inf": "Infinity", "-inf": "-Infinity", "nan": "NaN"}.get(t, t)) for i, t in rows]
    df = spark.createDataFrame(rows, "i int, text string").select("i", stored_column(tag).alias("k")).coalesce(1)
    df = df.withColumn("bag", bag.bag_of({"k": bag.entry(F.col("k"), tag)}))
    columns, want = [], []
    for layout, n in ((Flat.of(df, tags={"k": tag}), 6), (Bag("bag"), 1)):
        for policy in NumberComparisonPolicy:
            options = FilterMatchOptions(number_comparison_policy=policy)
            for c in cases_for(tag, n, rng):
                columns.append(filter_column(MetadataFilter(c, options), layout))
                want.append((c, policy, type(layout).__name__, [matches(c, {"k": v}, options) for v in stored]))
    got = {r.i: r.got for r in df.select("i", F.array(*columns).alias("got")).collect()}
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")
    for k, (c, policy, layout, expected) in enumerate(want):
        bad = [(v, w) for i, (v, w) in enumerate(zip(stored, expected, strict=True)) if got[i][k] != w]
        assert not bad, (c, policy, layout, bad[:3])


def test_wide_keys_sort(spark):
    texts = ["0", "-0.0", "1", "1.0", "0.5", "0.05", "-0.05", "10", "9", "99", "100", "-1", "-10", "-9.99", "1e40", "12e-3", "-1E+40", "123456789012345678901234567890123456789012345", "000.100"]
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", wide_key(F.col("t")).alias("k")).collect()}
    from fractions import Fraction

    assert got == {t: literal_key(Fraction(Decimal(t))) for t in texts}
    by_key = sorted(texts, key=lambda t: got[t])
    assert [Decimal(t) for t in by_key] == sorted(Decimal(t) for t in texts)
