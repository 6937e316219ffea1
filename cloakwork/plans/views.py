"""Derived views: order lines as pricing documents, grids, page items and text runs. Each in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SORT = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, l_linenumber, vendor, price, pct, qty, net, line and the sort columns."""
    money = lambda c: F.format_number(c, 2)
    country = F.element_at(F.array(*[F.lit(x) for x in ("SG", "MY", "IDN", "TH")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), *_SORT)
    t = t.withColumns({
        "vendor": F.concat(country, F.lit("-"), F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0")), "price": money(F.col("l_extendedprice")), "pct": F.concat(F.floor(F.col("l_discount") * 100 + 0.5).cast("string"), F.lit("%")),
        "qty": F.col("l_quantity").cast("int").cast("string"), "net": money(F.floor(F.col("l_extendedprice") * 90 + 0.5) / 100),
    })
    fee = F.when(F.col("l_linenumber") % 3 == 0, " Fee $ 7K-12K/MW.").otherwise("")
    line = F.concat(F.lit("Vendor "), F.col("vendor"), F.lit(" quoted USD "), F.col("price"), F.lit(" less "), F.col("pct"), F.lit(" for "), F.col("qty"), F.lit(" MW, net "), F.col("net"), F.lit(" total."), fee)
    return t.withColumn("line", line)


def vdoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a pricing summary for each order."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "line"))), lambda s: s["line"])
    head = F.concat(F.lit("Pricing summary of order "), F.col("doc_id").cast("string"))
    return order_lines(spark, sf_dir).groupBy("doc_id").agg(lines.alias("lines")).select("doc_id", F.concat_ws("\n", head, "lines").alias("text"))


def vsug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for each document: a vendor in lower case, an exact price, one that isn't there, and a double."""
    first = order_lines(spark, sf_dir).groupBy("doc_id").agg(F.min(F.struct("l_linenumber", "line", "vendor", "price")).alias("f"))
    one = lambda k, name, value: F.struct(F.lit(k).alias("ai_seq"), F.lit(name).alias("field_name"), value.alias("original_value"))
    price = F.concat(F.lit("USD "), F.col("f.price"))
    rows = F.array(one(0, "Vendor Name", F.concat(F.lit(" vendor  "), F.lower("f.vendor"))), one(1, "Price", price), one(2, "Price", F.lit("EUR 999,999,999")), one(3, "Price", price))
    return first.select("doc_id", F.inline(rows)).withColumns({"reason": F.lit(None).cast("string"), "sensitivity": F.lit(None).cast("string")})


def vdec(found: DataFrame) -> DataFrame:
    """Decisions on findings: some accepted after a rejection, some rejected, some left, and one that names nothing."""
    turn = (F.col("doc_id") + F.col("position")) % 3
    d = lambda field, at, yes: F.struct(field.alias("field_id"), F.lit(yes).alias("accepted"), F.lit(at).alias("decided_at"))
    own, none = F.col("field_id"), F.array().cast("array<struct<field_id:string,accepted:boolean,decided_at:int>>")
    some = F.when(turn == 0, F.array(d(own, 0, False), d(own, 1, True))).when(turn == 1, F.array(d(own, 0, False))).otherwise(none)
    unknown = F.when(F.col("position") == 1, F.array(d(F.lit("vendor_name_99"), 0, False))).otherwise(none)
    return found.select("doc_id", F.inline(F.concat(some, unknown)))  # in one reading of the findings


SHEET_ORDERS, HEADER_EVERY = 100, 50
HEADERS = ("Item", "Vendor", "Price", "Discount", "Qty", "Net")


def vgrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, r, c, value: a sheet for every SHEET_ORDERS orders; a title, and headers repeated every HEADER_EVERY rows."""
    t = order_lines(spark, sf_dir).withColumn("si", F.floor(F.col("doc_id") / SHEET_ORDERS).cast("long"))
    rn = F.row_number().over(Window.partitionBy("si").orderBy("doc_id", *_SORT)) - 1
    t = t.withColumn("rn", rn).withColumn("r", F.col("rn") + F.floor(F.col("rn") / HEADER_EVERY) + 2)
    price = F.when(F.col("l_quantity") == 1, "$ -").otherwise(F.concat(F.lit("$ "), F.col("price")))
    cell = lambda up, values: F.transform(F.array(*values), lambda v, c: F.struct((F.col("r") - up).cast("long").alias("r"), c.cast("long").alias("c"), v.alias("value")))
    data = cell(0, [F.concat(F.lit("P"), F.col("l_partkey").cast("string")), F.col("vendor"), price, F.col("pct"), F.col("qty"), F.col("net")])
    heads = F.when(F.col("rn") % HEADER_EVERY == 0, cell(1, [F.lit(h) for h in HEADERS])).otherwise(F.array().cast("array<struct<r:bigint,c:bigint,value:string>>"))
    title = F.when(F.col("rn") == 0, F.array(F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"), F.lit("Quarter report").alias("value")))).otherwise(F.array().cast("array<struct<r:bigint,c:bigint,value:string>>"))
    return t.select(F.concat(F.lit("O"), F.col("si").cast("string")).alias("sheet"), F.inline(F.concat(title, heads, data)))


def vplan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A plan with an entry for every sheet of vgrid: columns, values, sheets."""
    s = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / SHEET_ORDERS).cast("long").alias("si")).distinct()
    s = s.select("si", F.concat(F.lit("O"), F.col("si").cast("string")).alias("sheet"))
    label = lambda ci, text: F.struct(F.lit(ci).alias("ci"), F.lit(text).alias("label"))
    columns = s.select("si", "sheet", F.inline(F.when(F.col("si") % 2 == 0, F.array(label(0, "Vendor"), label(1, " price "))).otherwise(F.array(label(0, "Discount"), label(1, "Nowhere")))))
    value = lambda vi, text: F.struct(F.lit(vi).alias("vi"), F.lit(text).alias("value"))
    return columns, s.select("si", "sheet", F.inline(F.array(value(0, "17"), value(1, "SG-04"), value(2, "4%")))), s.select("si", "sheet", (F.col("si") % 3 != 0).alias("sweep"))


def vitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positioned items: four on each order line, prices parted from their currency."""
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy(*_SORT)) - 1
    t = order_lines(spark, sf_dir).withColumn("rn", rn)
    strs = F.array(F.concat(F.lit("Vendor "), F.col("vendor")), F.lit("USD"), F.col("price"), F.col("pct"))
    t = t.select("doc_id", (F.floor(F.col("rn") / 5)).cast("long").alias("page"), "rn", F.posexplode(strs).alias("k", "str"))
    return t.select(
        "doc_id", "page", (F.col("rn") * 4 + F.col("k")).cast("long").alias("item_no"), "str", (F.col("k") * 128.0 + 50).alias("x"),
        (F.lit(800.0) - (F.col("rn") % 5) * 14 + F.col("k") * 0.25).alias("y"), (F.length("str") * 5.5).alias("width"), F.lit(10.0).alias("font_size"),
    )


def vvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, vi, value: a vendor code, a price over two items, and one that only its number finds."""
    first = order_lines(spark, sf_dir).groupBy("doc_id").agg(F.min(F.struct("l_linenumber", "line", "vendor", "price")).alias("f"))
    v = lambda k, value: F.struct(F.lit(k).alias("vi"), value.alias("value"))
    return first.select("doc_id", F.inline(F.array(v(0, F.col("f.vendor")), v(1, F.concat(F.lit("USD "), F.col("f.price"))), v(2, F.concat(F.lit("total "), F.col("f.price"), F.lit(" net"))))))


RUN_CHARS = 12


def vruns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Runs of RUN_CHARS characters of each order line, and the spans of its vendor code and prices."""
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy(*_SORT)) - 1
    t = order_lines(spark, sf_dir).withColumn("para_no", rn).withColumn("part", F.lit("document"))
    n = F.floor((F.length("line") - 1) / RUN_CHARS)
    runs = t.select("doc_id", "part", "para_no", "line", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("run_no"))
    runs = runs.select("doc_id", "part", "para_no", "run_no", F.expr(f"substring(line, run_no * {RUN_CHARS} + 1, {RUN_CHARS})").alias("text"))
    span = lambda v: F.struct((F.instr("line", v) - 1).alias("s"), (F.instr("line", v) - 1 + F.length(v)).alias("e"))
    spans = t.select("doc_id", "part", "para_no", F.inline(F.array(span(F.col("vendor")), span(F.concat(F.lit("USD "), F.col("price"))), span(F.col("price")))))
    return runs, spans


SHEETS_A_BOOK = 10


def vcells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vgrid as the cells of workbooks: doc_id, si, sheet, r, c, value, num_value and the number's format."""
    bare = F.regexp_replace("value", "[$ ,%]", "")
    number = F.when(F.col("value").rlike(r"\A(?:\$ )?[0-9][0-9.,]*%?\z"), F.when(F.col("value").endswith("%"), bare.cast("double") / 100).otherwise(bare.cast("double")))
    code = F.when(F.col("value").startswith("$"), '"$ "#,##0.00').when(F.col("value").endswith("%"), "0%").when(F.col("c") == 5, "#,##0.00").otherwise("General")
    n = F.substring("sheet", 2, 20).cast("long")
    return vgrid(spark, sf_dir).select(F.floor(n / SHEETS_A_BOOK).alias("doc_id"), (n % SHEETS_A_BOOK).cast("int").alias("si"), "sheet", "r", "c", "value", number.alias("num_value"), code.alias("code"))


def vlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sheet, lines: the CSV lines of each sheet of vgrid, in order."""
    quoted = F.when(F.col("value").contains(","), F.concat(F.lit('"'), F.col("value"), F.lit('"'))).otherwise(F.col("value"))
    rows = vgrid(spark, sf_dir).groupBy("sheet", "r").agg(F.sort_array(F.collect_list(F.struct("c", quoted.alias("v")))).alias("cells"))
    line = F.array_join(F.concat(F.transform("cells", lambda x: x["v"]), F.array_repeat(F.lit(""), 6 - F.size("cells"))), ",")
    return rows.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct("r", line.alias("line"), (F.size("cells") > 1).alias("full")))).alias("lines"))


def vmasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, masked: the lines of vdoc, and a copy in which vendor, price and percentage stand masked."""
    t = order_lines(spark, sf_dir)
    copy = F.concat(F.lit("Vendor XXXX quoted USD XXXX less XXXX for "), F.col("qty"), F.lit(" MW, net "), F.col("net"), F.lit(" total."), F.when(F.col("l_linenumber") % 3 == 0, " Fee $ 7K-12K/MW.").otherwise(""))
    rows = t.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "line", copy.alias("copy")))).alias("rows"))
    return rows.select("doc_id", *[F.array_join(F.transform("rows", lambda x: x[c]), "\n").alias(n) for c, n in (("line", "text"), ("copy", "masked"))])  # noqa: B023


#: The same views for SQL engines.
SQL = r"""
ol AS (
  SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate,
    (['SG','MY','IDN','TH'])[l_suppkey % 4 + 1] || '-' || lpad((l_suppkey % 100)::VARCHAR, 2, '0') AS vendor,
    format('{:,.2f}', l_extendedprice) AS price, (floor(l_discount * 100 + 0.5)::BIGINT)::VARCHAR || '%' AS pct,
    (l_quantity::INT)::VARCHAR AS qty, format('{:,.2f}', floor(l_extendedprice * 90 + 0.5) / 100) AS net
  FROM lineitem
), olines AS (
  SELECT *, 'Vendor ' || vendor || ' quoted USD ' || price || ' less ' || pct || ' for ' || qty || ' MW, net ' || net || ' total.' || CASE WHEN l_linenumber % 3 = 0 THEN ' Fee $ 7K-12K/MW.' ELSE '' END AS line FROM ol
), vdoc AS (
  SELECT doc_id, 'Pricing summary of order ' || doc_id || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, line) AS text FROM olines GROUP BY doc_id
), firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, line, vendor, price) AS k FROM olines) WHERE k = 1
), vsug AS (
  SELECT doc_id, 0 AS ai_seq, 'Vendor Name' AS field_name, ' vendor  ' || lower(vendor) AS original_value FROM firsts
  UNION ALL SELECT doc_id, 1, 'Price', 'USD ' || price FROM firsts UNION ALL SELECT doc_id, 2, 'Price', 'EUR 999,999,999' FROM firsts UNION ALL SELECT doc_id, 3, 'Price', 'USD ' || price FROM firsts
), numbered AS (
  SELECT *, doc_id // 100 AS si, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS rn,
    row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS dn FROM olines
), vgrid AS (
  SELECT 'O' || si AS sheet, r, unnest(generate_series(0, len(vs) - 1)) AS c, unnest(vs) AS value FROM (
    SELECT si, rn + rn // 50 + 2 AS r, ['P' || l_partkey, vendor, CASE WHEN l_quantity = 1 THEN '$ -' ELSE '$ ' || price END, pct, qty, net] AS vs FROM numbered
    UNION ALL SELECT si, rn + rn // 50 + 1, ['Item', 'Vendor', 'Price', 'Discount', 'Qty', 'Net'] FROM numbered WHERE rn % 50 = 0
    UNION ALL SELECT si, 0, ['Quarter report'] FROM numbered WHERE rn = 0)
), sheets AS (
  SELECT substr(sheet, 2)::BIGINT AS si, sheet FROM vgrid WHERE r = 0
), plan_columns AS (
  SELECT si, sheet, 0 AS ci, CASE WHEN si % 2 = 0 THEN 'Vendor' ELSE 'Discount' END AS label FROM sheets UNION ALL SELECT si, sheet, 1, CASE WHEN si % 2 = 0 THEN ' price ' ELSE 'Nowhere' END FROM sheets
), plan_values AS (
  SELECT si, sheet, unnest([0, 1, 2]) AS vi, unnest(['17', 'SG-04', '4%']) AS value FROM sheets
), plan_sheets AS (
  SELECT si, sheet, si % 3 <> 0 AS sweep FROM sheets
), vitems AS (
  SELECT doc_id, dn // 5 AS page, dn * 4 + k AS item_no, s AS str, k * 128.0::DOUBLE + 50 AS x, 800.0::DOUBLE - (dn % 5) * 14 + k * 0.25::DOUBLE AS y, length(s) * 5.5::DOUBLE AS width, 10.0::DOUBLE AS font_size
  FROM (SELECT doc_id, dn, unnest([0, 1, 2, 3]) AS k, unnest(['Vendor ' || vendor, 'USD', price, pct]) AS s FROM numbered)
), vvalues AS (
  SELECT doc_id, unnest([0, 1, 2]) AS vi, unnest([vendor, 'USD ' || price, 'total ' || price || ' net']) AS value FROM firsts
), vruns AS (
  SELECT doc_id, 'document' AS part, dn AS para_no, run_no, substr(line, (run_no * 12 + 1)::INT, 12) AS text FROM (SELECT *, unnest(generate_series(0, (length(line) - 1) // 12)) AS run_no FROM numbered)
), vspans AS (
  SELECT doc_id, 'document' AS part, dn AS para_no, instr(line, v) - 1 AS s, instr(line, v) - 1 + length(v) AS e FROM (SELECT *, unnest([vendor, 'USD ' || price, price]) AS v FROM numbered)
), vcells AS (
  SELECT si // 10 AS doc_id, (si % 10)::INT AS si, sheet, r, c, value FROM vgrid JOIN sheets USING (sheet)
), vrows AS (
  SELECT sheet, r, string_agg(CASE WHEN contains(value, ',') THEN '"' || value || '"' ELSE value END, ',' ORDER BY c) || repeat(',', (6 - count(*))::INT) AS line FROM vgrid GROUP BY ALL
)
"""
