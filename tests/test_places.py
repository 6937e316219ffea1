"""Places of many values in a text against the plain functions for one value, and findings against plain rules."""

import random
import time

from pyspark.sql import functions as F

from cloakwork.functions import places
from cloakwork.functions.text import locate, snippet
from cloakwork.operators.reconcile import findings_array, reconcile

SUGGESTIONS = "doc_id long, ai_seq int, field_name string, original_value string, reason string, sensitivity string"


def test_places_equal_the_function_for_one_value(spark):
    r = random.Random(4)
    signs = [*"aAbBkK1,2. \n\t%$  éÉßſİσςΣ😀", "  ", "USD 1", "ab", "1,500", "K"]
    rows = []
    for _ in range(400):
        text = "".join(r.choices(signs, k=r.randint(0, 60)))
        at = r.randrange(len(text) + 1)
        value = places.collapsed(text[at : at + r.randint(1, 6)].swapcase() if r.random() < 0.7 else "".join(r.choices(signs, k=3))).strip()
        if value:
            rows.append((text, value))
    table = spark.createDataFrame(rows, "text string, value string").withColumn("loc", locate(F.col("text"), F.col("value")))
    some = 0
    for row in table.withColumn("context", snippet(F.col("text"), F.col("loc.index"), F.length("loc.exact"))).collect():
        _, (got,) = places.located(row["text"], [], [{"value": row["value"], "key": row["value"].lower()}])
        assert got[:4] == (row["loc"]["count"], row["loc"]["exact"], row["loc"]["index"], row["context"]), (row, got)
        some += got[0] > 0
    assert some > 100


def plain_alone(text, hits, given):
    """Which hits stay, each against each."""
    low = lambda s: places.collapsed(s).lower()
    sure = [g for g in given if places.fold(places.collapsed(g["value"])) in places.Text(text).folded]
    return [
        h["key"] not in [g["key"] for g in given] and not any(h["key"] in low(g["value"]) for g in sure) and not any(h["key"] in e["key"] for e in hits[:i])
        for i, h in enumerate(hits)
    ]


def test_containment_equals_each_against_each():
    r = random.Random(6)
    for _ in range(300):
        words = ["".join(r.choices("12,", k=r.randint(1, 4))) for _ in range(12)]
        text = " ".join(words)
        hits = [{"value": w, "key": w} for w in dict.fromkeys(words)]
        given = [{"value": w, "key": w} for w in dict.fromkeys(r.choices(words, k=2) + ["9"])]
        found, ai = places.located(text, hits, given)
        assert [f[4] for f in found] == plain_alone(text, hits, given)
        assert [a[4] for a in ai] == [any(h["key"] in g["value"] for h in hits) for g in given]


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "   "), (4, "SG-01"), (None, "15% of SG-02"), (2**53 + 1, "x SG-03"), (4, "SG-01 again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("suggested", F.lit(None).cast("array<struct<ai_seq:int,field_name:string,value:string,reason:string,level:string>>"))
    found = {(r["doc_id"], r["text"]): [f["original_value"] for f in r["findings"]] for r in findings_array(docs.coalesce(1)).collect()}
    assert found == {(1, None): [], (2, ""): [], (3, "   "): [], (4, "SG-01"): ["SG-01"], (None, "15% of SG-02"): ["SG-02", "15%"], (2**53 + 1, "x SG-03"): ["SG-03"], (4, "SG-01 again"): ["SG-01"]}
    assert reconcile(docs.limit(0), spark.createDataFrame([], SUGGESTIONS)).count() == 0


def test_two_hundred_thousand_hits_in_one_document(spark):
    text = "\n".join(f"line {i} of vendor TH-{i % 9000} at {i // 1000 + 1},{i % 1000:03d}.{i % 97:02d} and {i}  MW" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    given = spark.createDataFrame([(1, i, "Price", f"{i // 1000 + 1},{i % 1000:03d}", None, None) for i in range(2_000)], SUGGESTIONS)
    began = time.time()
    found = {r["source"]: r["n"] for r in reconcile(docs, given).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert found["pattern"] > 100_000 and sum(found.values()) == found["pattern"] + 2_000
    assert time.time() - began < 60
