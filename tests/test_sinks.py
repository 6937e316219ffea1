"""Files written by name: whole ones only, once each, whatever fails."""

import os

import pytest
from pyspark.sql import functions as F

from cloakwork import sinks


def save(rows, path):
    rows.write.format("masked_files").option("path", path).mode("append").save()


def found(path):
    return {n: (path / n).read_bytes() for n in os.listdir(path)}


def test_files_by_name(spark, tmp_path):
    sinks.register(spark)
    out = tmp_path / "out"
    given = [(f"a/b {i}.csv", bytearray(f"text {i}".encode() * i)) for i in range(50)] + [("..", bytearray(b"x")), (None, bytearray(b"y")), ("gone", None), ("größe.csv", bytearray(b"u"))]
    rows = spark.createDataFrame(given, sinks.SCHEMA).repartition(5)
    save(rows, str(out))
    want = {f"a_b_{i}.csv": f"text {i}".encode() * i for i in range(50)} | {"gr__e.csv": b"u"}
    got = found(out)
    assert {k: v for k, v in got.items() if k in want} == want and not [k for k in got if k.startswith(".") or "staging" in k]
    save(rows.where("name LIKE 'a/b%'"), f"file://{out}")  # again: the same files
    assert found(out) == got


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    sinks.register(spark)
    out = tmp_path / "out"
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") < 39, F.lit("x").cast("binary")).otherwise(F.raise_error(F.lit("broken")).cast("binary")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        save(rows, str(out))
    assert not out.exists() or not [n for n in os.listdir(out) if n.startswith("f")]
    same = spark.createDataFrame([("n", bytearray(b"1")), ("n", bytearray(b"2"))], sinks.SCHEMA)
    with pytest.raises(Exception, match="name of another"):
        save(same, str(out))
    assert not out.exists() or os.listdir(out) == []


def test_two_names_in_one(spark, tmp_path):
    assert [sinks.harmless(n) for n in ("..", "a/b", ".x", "", "é")] == ["_", "a_b", "x", "_", "_"]
