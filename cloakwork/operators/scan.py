"""The pattern scan: all hits of all patterns in one reading of each text, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.text import let, norm
from cloakwork.patterns import PATTERNS


def _hit(category: str):
    return lambda m: F.struct(F.lit(category).alias("category"), m.alias("value"), norm(m).alias("key"))  # no pattern begins or ends with white space


def hits_of(text: Column) -> Column:
    """array(struct(category, value, key)) in the order of patterns and matches, doubles included."""
    per_pattern = [F.transform(F.regexp_extract_all(text, F.lit(p.java), F.lit(0)), _hit(p.category)) for p in PATTERNS]
    return F.flatten(F.array(*per_pattern))


def first_of_each(items: Column, keys) -> Column:
    """The items whose key comes for the first time; keys(items): strings, one for each item.

    Keys are sorted with their places, so that equal ones are neighbours: no item is compared with all others.
    """

    def firsts(all_: Column) -> Column:
        order = F.sort_array(F.transform(keys(all_), lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        runs = lambda s: F.filter(s, lambda x, j: (j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(x["k"]))
        places = F.sort_array(F.transform(let(order, runs), lambda x: x["i"]))
        return F.transform(places, lambda i: F.get(all_, i))

    return let(items, firsts)


def distinct_hits(text: Column) -> Column:
    """The first hit of each category and key, in order."""
    return first_of_each(hits_of(F.coalesce(text, F.lit(""))), lambda hs: F.transform(hs, lambda h: F.concat_ws("::", h["category"], h["key"])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, seq (from 1), category, value, key for every hit."""
    return docs.select("doc_id", F.posexplode(distinct_hits(F.col("text"))).alias("pos", "hit")).select("doc_id", (F.col("pos") + 1).cast("long").alias("seq"), "hit.*")
