"""Texts are tried as numbers only where they look like one, with the results of a plain try; headers are tried before the join."""

import datetime

import pytest
from pyspark.sql import functions as F

from solvara import sources
from solvara.functions import expr
from solvara.plans import QUERIES

DAY = datetime.date(2020, 1, 31)
ODD = [
    None, "", " ", "1", "+1", "-1", " 1 ", "\t1\n", "\x7f1", "1\x7f", "\xa01", "1.", "1.5", ".5", "1e3", "1.e5", "1e", "1e+", "-", "+", "--1", "abc", "O", "0x10", "0x1p3", "0x.8p1", "0x1p", "1d", "1F", "1L",
    "1dd", "NaN", "nan", "+nan", "-NaN", "inf", "+inf", " inf ", "\x7finf", "-Infinity", "INFINITY", "infinit", "300", "99999999999", "9" * 30, "1e400", "١", "1_000", "1,5", "1 ", "1\x85", "\x001", "1 2", "00012", "\x1f1.5\x1f", "1.5\x7f",
]


@pytest.mark.parametrize("kind", [*expr.NUMBER_PATTERNS, "date", "boolean"])
def test_tried_is_a_plain_try(spark, kind):
    df = spark.createDataFrame([(x,) for x in ODD], "x string").select("x", F.col("x").try_cast(kind).cast("string").alias("plain"), expr.tried("x", kind).cast("string").alias("ours"))
    rows = df.collect()
    assert len(rows) == len(ODD) and [(r.x, r.plain) for r in rows] == [(r.x, r.ours) for r in rows]


def test_typed_takes_other_columns_too(spark):
    df = spark.createDataFrame([("7", 1.5), ("x", 2.5)], "a string, b double")
    assert [tuple(r) for r in sources.typed(df, {"a": "int", "b": "int"}).collect()] == [(7, 1), (None, 2)]


def test_headers_are_tried_before_the_join(spark):
    header = spark.createDataFrame([("07", "1", "O", "20200131"), ("7", "2", "3", "20200230"), ("k", "x", None, None)], "adsh string, priority string, status string, filed string")
    values = spark.createDataFrame([("07", "1", "1.5"), ("07", "2", "."), ("7", "3", "4"), ("k", "y", "nan"), ("gone", "1", "1")], "adsh string, line string, value string")
    types = {"adsh": "bigint", "priority": "int", "status": "int", "line": "int", "value": "double"}
    out = sources.joined_facts(header, values, "adsh", types, {"filed": "yyyyMMdd"})
    assert out.columns == ["adsh", "priority", "status", "filed", "line", "value"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [
        (7, 1, None, DAY, 1, 1.5), (7, 1, None, DAY, 2, None), (7, 2, 3, None, 3, 4.0), (None, None, None, None, None, float("nan")),
    ]))
    with pytest.raises(Exception, match="nowhere"):
        sources.joined_facts(header, values, "adsh", {"nowhere": "int"}, {}).collect()
    plan = QUERIES["src04_header_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("Join Inner")]
    assert "RLIKE" in plan and "gettimestamp" not in top.lower() and "priority" in top
