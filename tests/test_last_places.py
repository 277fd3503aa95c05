"""Rows whose values lie beside a rounding half, so the last place of exp or pow decides."""

import math

import duckdb

from tallyspark.functions import libm
from tallyspark.plans import catalog


def agrees(spark, tmp_path, name, keys):
    spark.createDataFrame([(k, 1, "1-URGENT", "O") for k in keys], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    cursor = con.execute(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, str(tmp_path)).select(*[c[0] for c in cursor.description]).collect()
    assert sorted(map(tuple, got)) == sorted(cursor.fetchall()) != []


def test_tempered_beside_a_half(spark, tmp_path):
    agrees(spark, tmp_path, "o213_tempered", [*range(3805300, 3805330)])  # 3805316: the scores are 0.5000005, more or less


def test_null_synth_beside_a_half(spark, tmp_path):
    agrees(spark, tmp_path, "o168_null_synth", [*range(2453130, 2453160)])  # 2453145: shares of 0.5000025 and 0.4999975, more or less


def test_functions_of_the_c_library(spark):
    rows = [(1, [0.0, -1.5, -0.25]), (2, None), (3, []), (4, [0.5, None, float("nan")]), (5, [710.0, -800.0])]
    df = spark.createDataFrame(rows, "k int, x array<double>").coalesce(1)
    e, p = ({r["k"]: r["x"] for r in libm.mapped(df, "x", f).collect()} for f in (libm.c_exp, lambda x: libm.c_pow(x, 2 / 3)))
    assert e[1] == [1.0, math.exp(-1.5), math.exp(-0.25)] and (e[2], p[2], e[3], p[3]) == (None, None, [], [])
    assert e[4][:2] == [math.exp(0.5), None] and math.isnan(e[4][2]) and e[5] == [math.inf, 0.0]
    assert p[1][0] == 0.0 and math.isnan(p[1][1]) and p[5][0] == math.pow(710, 2 / 3)
    assert [libm.c_pow(0.0, -1.0), libm.c_pow(-0.0, -1.0), libm.c_pow(0.0, -2.0), libm.c_pow(-1e300, 3.0), libm.c_pow(1e300, 2.0)] == [math.inf, -math.inf, math.inf, -math.inf, math.inf]
    plain = {i: [i / 7.0] * (i % 4) for i in range(40)}
    got = libm.mapped(spark.createDataFrame(list(plain.items()), "k int, x array<double>").coalesce(1), "x", libm.c_exp).collect()
    assert {r["k"]: r["x"] for r in got} == {k: [math.exp(v) for v in x] for k, x in plain.items()}
