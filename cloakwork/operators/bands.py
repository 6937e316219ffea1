"""Cells whose number is one of a document's values, by a join on bands of numbers.

Two numbers are near when they differ by at most the tolerance, or by that share of the second. On a scale that is
linear up to 1 and logarithmic beyond, near numbers are near everywhere; the scale is cut into bands far wider than any
tolerance, a value's number stands in its own band and both neighbours, and a cell's number in its own. So cells and
values meet by equality of document and band, and every pair that meets is tested exactly. Values are a table of any
size: nothing is collected and no plan grows with them. A band with very many cells, as that of 0 or 1, is met by the
distinct numbers of its values, one row each, so that the join's hot side can be split.

A null number or value matches nothing; a null key matches a null key; repeated cells are cells of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.numbers import extract_numbers, near, percent_like

WIDTH = 1e-5
EXACT, SHARE = 1e-9, 1e-6


def band(x: Column) -> Column:
    size = F.abs(x)
    scale = F.when(size < 1, size).otherwise(1 + F.log(size))
    return F.floor(F.signum(x) * scale / WIDTH).cast("long")


def _tokens(values: DataFrame, keys: list[str]) -> DataFrame:
    """Each distinct number of the values of a key, with the values it is in: keys, token, share, sign, vis."""
    v = F.col("value")
    each = values.select(*keys, "vi", percent_like(v).alias("share"), v.contains("%").alias("sign"), F.explode(extract_numbers(v)).alias("token"))
    return each.groupBy(*keys, "token", "share", "sign").agg(F.collect_set("vi").alias("vis"))


def _met(cells: DataFrame, tokens: DataFrame, keys: list[str], number: str, forms: Column, test: Column) -> DataFrame:
    """cells x tokens of the same keys that stand in one band and pass a test over number, form, x, token, share, sign."""
    n = F.col(number)
    at = cells.where(n.isNotNull() & ~F.isnan(n)).withColumn("_form", F.explode(forms)).withColumn("_x", F.col("_form.x")).withColumn("_band", band(F.col("_x")))
    b = band(F.col("token"))
    near_bands = tokens.withColumn("_token_band", F.explode(F.array(b - 1, b, b + 1)))
    named = near_bands.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_token_band", "token", "share", "sign", "vis")
    same = F.col("_band") == F.col("_token_band")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return at.join(named, same).where(test)


def _forms(number: Column, scaled: Column) -> Column:
    """A number as it is and, where a share may be meant, times 100."""
    form = lambda x, share: F.struct(x.alias("x"), F.lit(share).alias("percent"))
    return F.when(scaled, F.array(form(number, False), form(number * 100, True))).otherwise(F.array(form(number, False)))


def number_matches(cells: DataFrame, values: DataFrame, keys: list[str], number: str = "num_value") -> DataFrame:
    """cells(…, number) and values(keys, vi, value) → the columns of cells, and vis: the values of the same keys that have
    its number, as it is or, for percentages, as a share (functions.numbers.number_matches_value). Cells without stay out.

    cells need a column that tells rows apart only where equal rows should stay two rows: add one, as `cell_no`.
    """
    n, x, token = F.col(number), F.col("_x"), F.col("token")
    part = (n > 0) & (n < 1)
    share = F.col("share") & (F.col("sign") | part)
    test = F.when(F.col("_form.percent"), share & near(x, token, SHARE)).otherwise(near(x, token, EXACT))
    return _of_cells(cells, _met(cells, _tokens(values, keys), keys, number, _forms(n, n != 0), test))


def sweep_matches(cells: DataFrame, values: DataFrame, keys: list[str], number: str = "num_value") -> DataFrame:
    """The same by the wider rule for cells that no plan names: any number, and percentages of up to 100 as shares."""
    n, x, token = F.col(number), F.col("_x"), F.col("token")
    part = (n > 0) & (n < 1)
    test = F.when(F.col("_form.percent"), part & F.col("sign") & (token <= 100) & (F.abs(x - token) <= SHARE)).otherwise(near(x, token, EXACT))
    return _of_cells(cells, _met(cells, _tokens(values, keys), keys, number, _forms(n, part), test))


def _of_cells(cells: DataFrame, met: DataFrame) -> DataFrame:
    names = [F.col(f"`{c}`") for c in cells.columns]
    return met.groupBy(*names).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("vis")))).alias("vis"))
