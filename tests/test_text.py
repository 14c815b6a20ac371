"""Report text, against Python's own formatting."""

import random

import pytest
from pyspark.sql import functions as F

from counterscope.functions.names import dsn_host, dsn_user, server_name, short_name
from counterscope.functions.text import (
    clock,
    fixed,
    float_number,
    float_time,
    metric_cell,
    padded,
    picosecond_time,
    significant,
    steady,
)


def texts(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.t for r in df.select("i", make.alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize("decimals", [0, 1, 2, 3, 4, 6])
def test_fixed_rounds_the_binary_value_half_to_even(spark, decimals):
    rng = random.Random(decimals)
    values = [0.0, 0.125, 0.375, 0.5, 1.5, 2.5, 2.675, 3.625, 12.25, 12.75, 102.5, 103.5, 0.0625, 999.5, 9.995]
    values += [rng.randrange(1, 10**7) / 2 ** rng.randrange(1, 12) for _ in range(4000)]
    values += [rng.random() * 10 ** rng.randrange(-6, 5) for _ in range(4000)]
    values += [round(rng.random() * 1000, rng.randrange(1, 8)) for _ in range(4000)]
    values += [-v for v in values[1:200]]
    got = texts(spark, values, "double", fixed(F.col("v"), decimals))
    assert got == [f"{v:.{decimals}f}" for v in values]


def test_number_vectors(spark):
    values = [0.0, 0.001, 0.0123, 0.25, 2.5, 25.0, 250.0, 999.6, 1000.0, 92250.0, -3.0]
    want = ["0", "0.001000", "0.0123", "0.250", "2.50", "25.0", "250", "1000", "1.00 k", "92.25 k", "-3.000000"]
    assert texts(spark, values, "double", float_number("v")) == want


def test_time_vectors(spark):
    values = [1000.0, 100.0, 10.0, 1.0, 0.1, 0.01, 0.001, 0.0001, 0.00001, 0.000001, 0.0000001, 0.00000001, 0.000000001, 0.0]
    want = [
        "1000 s", "100 s", "10 s", "1 s", "100.0 ms", "10.00 ms", "1.000 ms", "100.0 µs", "10.00 µs", "1.000 µs",
        "100.0 ns", "10.00 ns", "1.000 ns", "0.000000 s",
    ]
    assert texts(spark, values, "double", float_time("v")) == want


def test_picosecond_vectors(spark):
    values = [10**i for i in range(15)]
    want = [
        "1 ps", "10 ps", "100 ps", "1.00 ns", "10.00 ns", "100.00 ns", "1.00 µs", "10.00 µs", "100.00 µs", "1.00 ms",
        "10.00 ms", "100.00 ms", "1.00 s", "10.00 s", "00:01:40",
    ]
    assert texts(spark, values, "bigint", picosecond_time("v")) == want
    more = [0, 999, 123_999, 125_000, 135_000, 995_000, 59_999_999_999_999, 60 * 10**12, 3_725 * 10**12]
    got = texts(spark, more, "bigint", picosecond_time("v"))
    assert got == ["0 ps", "999 ps", "120.00 ns", "120.00 ns", "140.00 ns", "1000.00 ns", "59.00 s", "00:01:00", "01:02:05"]


def test_significant_and_clock(spark):
    assert texts(spark, [7, 42, 123, 128, 4567], "bigint", significant(F.col("v"), 2)) == [
        "7.00", "42.00", "120.00", "130.00", "4600.00",
    ]
    assert texts(spark, [0, 59, 3600, 90061], "bigint", clock(F.col("v"))) == [
        "00:00:00", "00:00:59", "01:00:00", "25:01:01",
    ]


def test_padding_keeps_long_text(spark):
    assert texts(spark, ["ab", "µσ", "abcdef"], "string", padded(F.col("v"), 4)) == ["ab  ", "µσ  ", "abcdef"]


def test_cells(spark):
    rows = [(m, 84.1, 0.0021) for m in ("queries", "QPS", "Latency")]
    df = spark.createDataFrame(rows, "metric string, a double, s double")
    cells = df.select(metric_cell("a", "s").alias("c")).collect()
    assert [r.c for r in cells] == ["84.1, σ 0.002100", "84.1 qps, σ 0.002100", "84 s, σ 2.100 ms"]


def test_names(spark):
    rows = {
        "user:password@tcp(server1.example.com:3306)/performance_schema": ("user", "server1.example.com"),
        "user:password@tcp(server1.example.com:3307)/x": ("user", "server1.example.com:3307"),
        "root:secret@host5:3306": ("root", "host5"),
        "admin@tcp(db.example.com)/x": ("", "db.example.com"),
        "root:secret": ("root", ""),
        "plain": ("", ""),
        "u:p@tcp(x:3306)": ("u", "x"),
        "u:p@tcp(:3306)": ("u", ":3306"),
    }
    df = spark.createDataFrame([(i, d) for i, d in enumerate(rows)], "i int, dsn string")
    got = df.select("i", dsn_user().alias("u"), dsn_host().alias("h")).orderBy("i").collect()
    assert [(r.u, r.h) for r in got] == list(rows.values())
    assert not any("secret" in r.h or "password" in r.h for r in got)


def test_short_name(spark):
    long = "'reporting'@'a-rather-long-host-name.internal.example.com'"
    name = server_name(F.lit("user"), F.lit("h"))
    assert texts(spark, ["x"], "string", name) == ["'user'@'h'"]
    got = texts(spark, [long, "y" * 40, "y" * 41], "string", short_name(F.col("v")))
    assert got == [long[:18] + "..." + long[-19:], "y" * 40, "y" * 18 + "..." + "y" * 19]
    assert len(got[0]) == 40


def test_steady_drops_noise_only(spark):
    values = [0.0, 0.030165000000000004, 0.030164999999999997, 123456789.125, -2.5e-7, 1e300]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.v for r in df.select("i", steady(F.col("v")).alias("v")).orderBy("i").collect()]
    assert got == [0.0, 0.030165, 0.030165, 123456789.125, -2.5e-7, 1e300]


@pytest.mark.parametrize("digits", [10, 12])
def test_steady_is_exact(spark, digits):
    rng = random.Random(digits)
    values = [rng.random() * 10 ** rng.randrange(-9, 9) for _ in range(4000)]
    values += [rng.randrange(1, 10**15) / 2 ** rng.randrange(1, 30) for _ in range(4000)]
    values += [float(rng.randrange(1, 10**9)) for _ in range(1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.v for r in df.select("i", steady(F.col("v"), digits).alias("v")).orderBy("i").collect()]
    assert got == [float(f"{v:.{digits - 1}e}") for v in values]
