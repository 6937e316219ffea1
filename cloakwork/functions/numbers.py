"""Numbers inside sensitive values, and cells that hold one of them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.text import js_trim
from cloakwork.patterns import JS_WS, TOKENS


def extract_numbers(value: Column) -> Column:
    """Distinct positive numbers of a value, as they stand and times their scale."""
    bodies, scales = F.regexp_extract_all(value, F.lit(TOKENS), F.lit(1)), F.regexp_extract_all(value, F.lit(TOKENS), F.lit(2))

    def both(body: Column, scale: Column) -> Column:
        n = F.replace(body, F.lit(","), F.lit("")).cast("double")
        first = F.lower(F.substring(scale, 1, 1))
        times = F.when(scale == "", F.lit(None)).when(first == "k", 1e3).when(F.lower(scale) == "thousand", 1e3).when(first == "m", 1e6).when(first == "b", 1e9).otherwise(1e12)
        return F.array(n, n * times)

    return F.array_distinct(F.filter(F.flatten(F.zip_with(bodies, scales, both)), lambda n: n.isNotNull() & (n > 0)))


def percent_like(value: Column) -> Column:
    return value.contains("%") | js_trim(value).rlike(rf"\A(?:[\d.,]|{JS_WS})+\z")


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), F.abs(b) * tolerance)


def number_matches_value(number: Column, value: Column) -> Column:
    """Whether a cell's number is one of a value's: as it is, or as a share where the value is a percentage."""
    share = percent_like(value) & (value.contains("%") | ((number > 0) & (number < 1)))
    return F.exists(extract_numbers(value), lambda t: near(number, t, 1e-9) | (share & near(number * 100, t, 1e-6)))


def sweep_tokens(values: Column) -> Column:
    """struct(all, percent): the numbers of all values, and those of values with a percent sign."""
    numbers = lambda vs: F.array_distinct(F.flatten(F.transform(vs, extract_numbers)))
    return F.struct(numbers(values).alias("all"), numbers(F.filter(values, lambda v: v.contains("%"))).alias("percent"))


def numeric_sweep(number: Column, tokens: Column) -> Column:
    share = (number > 0) & (number < 1) & F.exists(tokens["percent"], lambda t: (t <= 100) & (F.abs(number * 100 - t) <= 1e-6))
    return F.exists(tokens["all"], lambda t: near(number, t, 1e-9)) | share


def number_tokens(spark: SparkSession, values: list[str]) -> list[tuple[float, bool, bool]]:
    """(number, whether its value is a percentage, whether it shows the sign) of all numbers of a few given values."""
    table = spark.range(1).select(F.explode(F.array(*map(F.lit, values)).cast("array<string>")).alias("v"))
    found = table.select(F.explode(extract_numbers(F.col("v"))).alias("n"), percent_like(F.col("v")).alias("share"), F.col("v").contains("%").alias("sign"))
    return sorted({tuple(r) for r in found.collect()})


def number_hit(number: Column, tokens: list[tuple[float, bool, bool]]) -> Column:
    """number_matches_value or numeric_sweep for any of the values behind tokens, all of them constants."""
    hit, part = F.lit(False), (number > 0) & (number < 1)
    for n, share, sign in tokens:
        hit = hit | near(number, F.lit(n), 1e-9)
        if share:
            hit = hit | (near(number * 100, F.lit(n), 1e-6) if sign else part & near(number * 100, F.lit(n), 1e-6))
        if sign and n <= 100:
            hit = hit | (part & (F.abs(number * 100 - n) <= 1e-6))
    return hit
