"""SQL functions against the functions of columns, on odd texts."""

import random

from pyspark.sql import functions as F

from cloakwork import sql
from cloakwork.functions import text as T
from cloakwork.operators import mask
from cloakwork.operators.scan import distinct_hits


def test_sql_functions_equal_those_of_columns(spark):
    sql.register(spark)
    r = random.Random(13)
    parts = ["USD 1,500", "sg-01", "SG-01", "15%", "7.5 %", " ", "  ", "\n", "Vendor SG-02", "10 MW", "é", "\\d+", "'q'", "a.b", "$ 7K-12K/MW", "2,500–3,000", "x"]
    texts = [None, "", *("".join(r.choices(parts, k=r.randint(1, 12))) for _ in range(200))]
    rows = [(i, t, r.choice(parts), r.choices(parts, k=3)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "i long, text string, value string, vals array<string>").createOrReplaceTempView("odd_rows")
    t, v = F.col("text"), F.col("value")
    loc = T.locate(t, v)
    want = spark.table("odd_rows").select("i", T.collapse(t).alias("a"), T.norm(t).alias("b"), T.guess_category(v).alias("c"), F.transform(distinct_hits(t), lambda h: h["value"]).alias("d"), mask.mask_flexible(t, F.col("vals")).alias("e"), F.when(t.isNotNull(), F.struct(loc["count"].alias("n"), loc["exact"].alias("x"), loc["index"].alias("p"))).alias("f"))
    got = spark.sql("""SELECT i, collapse_text(text) AS a, norm_text(text) AS b, guess_category(value) AS c, transform(text_hits(text), h -> h.value) AS d, mask_values(text, vals) AS e,
        if(text IS NULL, NULL, place_of(text, value)) AS f FROM odd_rows""")
    key = lambda row: {k: (tuple(x) if k == "f" and x else x) for k, x in row.asDict().items()}
    assert sorted(map(key, got.collect()), key=lambda x: x["i"]) == sorted(map(key, want.collect()), key=lambda x: x["i"])
    by_table = spark.sql("SELECT i, h.* FROM odd_rows, LATERAL scan_hits(text) h")
    assert by_table.count() == got.select(F.explode("d")).count() > 200
    plan = by_table._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Window" not in plan
