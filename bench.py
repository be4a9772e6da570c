"""Times the headline queries; prints one line of JSON.

Each query is written to a sink that keeps nothing, once to warm up and then
``BENCH_RUNS`` times; the median counts. A name ending in ``_sql`` is the same
rows by hand-written SQL, the baseline of the query named before it.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metasieve import Bag, Flat, FilterMatchOptions, MetadataFilter, MetadataSchema, NumberComparisonPolicy, apply_filter, error_column
from metasieve.plans.dtypes import DataType
from metasieve.queries import labelled, labelled_bag, table
from metasieve.streaming.frames import filter_stream, read_stream, write_available

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
B = MetadataFilter.builder


def pairs(spark: SparkSession) -> dict[str, DataFrame]:
    line, docs, bags = table(spark, SF_DIR, "lineitem"), labelled(spark, SF_DIR), labelled_bag(spark, SF_DIR)
    flat = Flat.of(line)
    apply = lambda f, options=None: apply_filter(line, f, flat, options)
    out = {
        "range": apply(B().ge("l_quantity", 10.0).and_lt("l_quantity", 20.0).build()),
        "range_sql": line.filter("l_quantity >= 10 AND l_quantity < 20"),
        "negated_group": apply(B().and_not(lambda g: g.eq("l_returnflag", "R").and_gt("l_linenumber", 3)).build()),
        "negated_group_sql": line.filter("NOT coalesce(l_returnflag = 'R' AND l_linenumber > 3, false)"),
        "ten_leaves": apply(B().gt("l_orderkey", 1000).and_le("l_linenumber", 5).and_ne("l_returnflag", "R").and_in_set("l_linestatus", ["O", "F"]).and_lt("l_discount", 0.09).and_ge("l_tax", 0.01).and_exists("l_shipdate").and_(lambda g: g.lt("l_quantity", 40).or_eq("l_linenumber", 1)).and_not_exists("nowhere").build()),
        "ten_leaves_sql": line.filter("l_orderkey > 1000 AND l_linenumber <= 5 AND l_returnflag <> 'R' AND l_linestatus IN ('O', 'F') AND l_discount < 0.09 AND l_tax >= 0.01 AND l_shipdate IS NOT NULL AND (l_quantity < 40 OR l_linenumber = 1)"),
        "int_vs_float": apply(B().gt("l_orderkey", 1000.5).build()),
        "int_vs_float_approximate": apply(B().gt("l_orderkey", 1000.5).build(), FilterMatchOptions(number_comparison_policy=NumberComparisonPolicy.APPROXIMATE)),
        "int_vs_float_sql": line.filter("l_orderkey > 1000"),
        "flat": apply_filter(docs, B().ne("quality", 1).and_gt("n_chars", 500).build()),
        "flat_sql": docs.filter("coalesce(quality <> 1, true) AND n_chars > 500"),
        "bag": apply_filter(bags, B().ne("quality", 1).and_gt("n_chars", 500).build(), Bag("bag")),
    }
    for n in (1, 100, 10_000):
        keys = [7 * k for k in range(n)]
        out[f"in_{n}"] = apply(B().in_set("l_orderkey", keys).build())
        out[f"in_{n}_sql"] = line.filter(line.l_orderkey.isin(keys))
    prices = [0.01 * k for k in range(10_000)]
    out["in_double_10000"] = apply(B().in_set("l_tax", prices).build())
    out["in_double_10000_sql"] = line.filter(line.l_tax.isin(prices))
    exact = line.select("l_orderkey", line.l_quantity.cast("decimal(12,2)").alias("q"))
    amounts = [Decimal(k) / 4 for k in range(2000)]
    out["in_decimal_2000"] = apply_filter(exact, B().in_set("q", amounts).build())
    out["in_decimal_2000_sql"] = exact.filter(exact.q.isin(amounts))
    lengths = [7 * k for k in range(2000)]
    out["bag_in_2000"] = apply_filter(bags, B().in_set("n_chars", lengths).build(), Bag("bag"))
    out["bag_in_2000_sql"] = bags.filter(F.col("bag")["n_chars"]["i"].isin(lengths))
    schema = MetadataSchema.builder()
    for f in line.schema.fields[:10]:
        schema.required(f.name, flat.tag(f.name) if f.name != "l_tax" else DataType.INT64)
    checked = error_column(schema.build(), flat)
    out["validation"] = line.select(checked.alias("error"))
    return out


def timed(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def streamed(spark: SparkSession) -> tuple[float, float]:
    """Seconds of a filter over ``events`` written as a stream that ends, and as a batch."""
    like = table(spark, SF_DIR, "events")
    f, flat = B().eq("event_type", "error").or_gt("value", 150).build(), Flat.of(like)
    with tempfile.TemporaryDirectory() as folder:
        began = time.perf_counter()
        write_available(filter_stream(read_stream(spark, f"{SF_DIR}/events.parquet*", like), f, flat), f"file://{folder}/stream", f"file://{folder}/state")
        middle = time.perf_counter()
        apply_filter(like, f, flat).write.parquet(f"file://{folder}/batch")
        return middle - began, time.perf_counter() - middle


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = pairs(spark)
    for df in found.values():
        timed(df)
    # the runs of all queries are interleaved, so that a slow moment does not fall on one
    times: dict[str, list[float]] = {k: [] for k in found}
    for _ in range(RUNS):
        for k, df in found.items():
            times[k].append(timed(df))
    for _ in range(RUNS):
        for k, v in zip(("stream", "stream_batch_sql"), streamed(spark), strict=True):
            times.setdefault(k, []).append(v)
    median = {k: round(statistics.median(v), 4) for k, v in times.items()}
    own = {k: v for k, v in median.items() if not k.endswith("_sql")}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(own.values()), 3), "unit": "sec", "queries": median, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
