"""Queries over files made from the tables: workbooks, CSV and Word texts, detector answers; and the SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import text as T
from cloakwork.operators import answers as A
from cloakwork.operators import detect
from cloakwork.operators import documents as D
from cloakwork.operators import grid as G
from cloakwork.operators import mask as M
from cloakwork.operators import pages as P
from cloakwork.operators import review as R
from cloakwork.plans import views as V
from cloakwork.plans.queries import _AUDITED, _SENSITIVE, _decided, _log, query
from cloakwork.sources import csv_spans, parse, sheets, word
from cloakwork.sources.kept import kept


def _books(spark, sf_dir) -> DataFrame:
    return sheets.write_books(V.vcells(spark, sf_dir))


def _cells(files: DataFrame) -> DataFrame:
    return sheets.read_cells(files).select("doc_id", "si", "sheet", "r", "c", "value")


@query("SELECT doc_id, si, sheet, r, c, value FROM vcells")
def q_book_cells(spark, sf_dir):
    """Workbooks written and read back: shown texts of numbers by their formats."""
    return _cells(_books(spark, sf_dir))


@query("""SELECT doc_id, md5(string_agg('=== Sheet: ' || sheet || ' ===' || chr(10) || body, chr(10) ORDER BY si)) AS text_md5 FROM (
SELECT si // 10 AS doc_id, si, sheet, string_agg(line, chr(10) ORDER BY r) AS body FROM vrows JOIN sheets USING (sheet) GROUP BY ALL) GROUP BY doc_id""")
def q_book_text(spark, sf_dir):
    return _books(spark, sf_dir).select("doc_id", F.md5(sheets.book_text(F.col("content"))).alias("text_md5"))


@query("SELECT v.doc_id, v.si, sheet, r, c, CASE WHEN k.kind IS NULL THEN v.value ELSE 'XXXX' END AS value FROM vcells v LEFT JOIN claims k USING (sheet, r, c)")
def q_book_by_plan(spark, sf_dir):
    """Workbooks masked by a plan, written and read back."""
    books = kept(_books(spark, sf_dir))
    cells = kept(sheets.read_cells(books))
    claimed = G.claims(cells.select("sheet", "r", "c", "value"), *V.vplan(spark, sf_dir)).select("sheet", "r", "c")
    targets = cells.join(claimed, ["sheet", "r", "c"], "left_semi").withColumn("put", F.lit("XXXX"))
    return _cells(sheets.mask_books(books, targets))


@query("""SELECT doc_id, si, sheet, r, c, CASE WHEN n IS NULL THEN CASE WHEN value = 'SG-01' THEN 'XXXX' ELSE value END WHEN n IN (17, 4, 150, 150000000) OR abs(n - 1254.40) <= 1254.40e-9 OR abs(n * 100 - 4) <= 4e-6 THEN 'XXXX' ELSE value END AS value FROM (
SELECT *, CASE WHEN regexp_full_match(value, '(?:[$] )?[0-9][0-9.,]*%?') THEN regexp_replace(value, '[$ ,%]', '', 'g')::DOUBLE / CASE WHEN contains(value, '%') THEN 100 ELSE 1 END END AS n FROM vcells)""")
def q_book_by_values(spark, sf_dir):
    books = kept(_books(spark, sf_dir))
    return _cells(sheets.mask_books(books, sheets.masked_values(G.mask_cells(sheets.read_cells(books), list(_SENSITIVE)))))


def _csv_copy(rows: Column, before: Column) -> Column:
    """Lines of a detector's copy: vendors and prices of the rows below the header masked, before put first."""
    fields = lambda s: D.csv_fields(s)
    again = lambda v: F.when(v.contains(","), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
    masked = lambda s: F.array_join(F.transform(fields(s), lambda v, c: F.when(c.isin(1, 2), "XXXX").otherwise(again(v))), ",")
    return F.transform(rows, lambda x: F.concat(before, F.when(x["full"] & (x["r"] > 1), masked(x["line"])).otherwise(x["line"])))


@query("SELECT doc_id, si, sheet, r, c, CASE WHEN c IN (1, 2) AND r > 1 THEN 'XXXX' ELSE value END AS value FROM vcells")
def q_book_from_copy(spark, sf_dir):
    """Workbooks masked like a detector's CSV copy of all their sheets, which has a column too many."""
    n = F.substring("sheet", 2, 20).cast("long")
    copied = _csv_copy(F.col("lines"), F.lit("7,"))
    part = F.concat(F.lit("===SHEET:"), F.col("sheet"), F.lit("===\n"), F.array_join(copied, "\n"))
    texts = V.vlines(spark, sf_dir).groupBy(F.floor(n / V.SHEETS_A_BOOK).alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(part)), "\n").alias("text"))
    books = kept(_books(spark, sf_dir))
    return _cells(sheets.mask_books_like_copies(books, texts))


def _csv_docs(spark, sf_dir) -> DataFrame:
    lines = V.vlines(spark, sf_dir)
    return lines.select(F.substring("sheet", 2, 20).cast("long").alias("doc_id"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), "lines")


_MASKED_LINES = """SELECT s.si AS doc_id, md5(string_agg(line, chr(10) ORDER BY r)) AS masked_md5 FROM (
SELECT sheet, r, string_agg(CASE WHEN hit THEN 'XXXX' WHEN contains(value, ',') THEN '"' || value || '"' ELSE value END, ',' ORDER BY c) || repeat(',', (6 - count(*))::INT) AS line FROM ({cells}) GROUP BY ALL) JOIN sheets s USING (sheet) GROUP BY s.si"""


@query(_MASKED_LINES.format(cells="SELECT v.*, k.kind IS NOT NULL AS hit FROM vgrid v LEFT JOIN claims k USING (sheet, r, c)"))
def q_csv_by_plan(spark, sf_dir):
    docs = _csv_docs(spark, sf_dir).select("doc_id", "text")
    first = [t.withColumns({"sheet": F.col("si").cast("string"), "si": F.lit(0).cast("long")}) for t in V.vplan(spark, sf_dir)]
    return csv_spans.mask_by_plan(docs, *first).select("doc_id", F.md5("masked").alias("masked_md5"))


@query(_MASKED_LINES.format(cells="SELECT *, c IN (1, 2) AND r > 1 AND r <= max(r) OVER (PARTITION BY sheet) - 3 AS hit FROM vgrid"))
def q_csv_like_copy(spark, sf_dir):
    """CSV texts masked like copies with a marker, a fence, a row too many after the header and the last three rows missing."""
    docs = _csv_docs(spark, sf_dir)
    kept = F.slice(_csv_copy(F.col("lines"), F.lit("")), F.lit(1), F.size("lines") - 3)
    head, tail = F.slice(kept, F.lit(1), F.lit(2)), F.slice(kept, F.lit(3), F.greatest(F.lit(0), F.size(kept) - 2))
    copy = F.concat(F.array(F.lit("```csv"), F.lit("===SHEET:all===")), head, F.array(F.lit("a,b,c,d,e,f")), tail, F.array(F.lit("```")))
    masked, _ = csv_spans.mask_like_copy(docs.select("doc_id", "text"), docs.select("doc_id", F.array_join(copy, "\n").alias("text")))
    return masked.select("doc_id", F.md5("masked").alias("masked_md5"))


@query("""SELECT si AS doc_id, value, min((r, c)) AS first FROM (SELECT s.si, r - 0 AS r, c, value FROM vgrid JOIN sheets s USING (sheet) WHERE c IN (1, 2) AND r > 1) GROUP BY si, value""".replace("min((r, c)) AS first", "min(r)::BIGINT AS row"))
def q_review_detections(spark, sf_dir):
    docs = _csv_docs(spark, sf_dir)
    marked = F.concat(F.lit("=== Sheet: a ===\n"), F.col("text"))
    copy = F.concat(F.lit("===SHEET:a===\n"), F.array_join(_csv_copy(F.col("lines"), F.lit("7,")), "\n"))
    return G.review_detections(docs.select("doc_id", marked.alias("text"), copy.alias("copy"))).select("doc_id", "value", F.col("first.r").cast("long").alias("row"))


@query("""SELECT doc_id, value, min(n)::BIGINT AS line FROM (SELECT doc_id, unnest([vendor, price, pct]) AS value, n FROM (
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, line) - 1 AS n FROM olines)) WHERE length(value) > 1 GROUP BY ALL""")
def q_recovered_values(spark, sf_dir):
    return D.recovered_values(V.vmasked(spark, sf_dir)).select("doc_id", "value", F.col("first.line").cast("long").alias("line"))


def _answers(spark, sf_dir) -> DataFrame:
    """doc_id, form and a detector's answer: a list, a list in prose, one cut short, one in an object, and none."""
    item = F.to_json(F.struct(F.col("field_name").alias("fieldName"), F.col("original_value").alias("originalValue"), F.lit('a "quoted" {word}').alias("reason")))
    lists = V.vsug(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ai_seq", item.alias("j")))), lambda x: x["j"]).alias("items"))
    body, form = F.array_join("items", ","), F.col("doc_id") % 5
    text = (
        F.when(form == 0, F.concat(F.lit(" ["), body, F.lit("]\n"))).when(form == 1, F.concat(F.lit("Here it is:\n```json\n["), body, F.lit("]\n```\nDone.")))
        .when(form == 2, F.regexp_replace(F.concat(F.lit("["), body), ".{9}\\z", "")).when(form == 3, F.concat(F.lit('{"suggestions":['), body, F.lit("]}"))).otherwise("[]")
    )
    return lists.select("doc_id", text.alias("answer"))


@query("SELECT doc_id, ai_seq::INT AS seq, field_name, original_value FROM vsug WHERE doc_id % 5 <> 4 AND (doc_id % 5 <> 2 OR ai_seq < 3)")
def q_answers(spark, sf_dir):
    found = _answers(spark, sf_dir).select("doc_id", F.posexplode(A.suggestions_of(F.col("answer"))).alias("seq", "s"))
    return found.select("doc_id", "seq", F.col("s.fieldName").alias("field_name"), F.col("s.originalValue").alias("original_value"))


@query("""SELECT si // 10 AS doc_id, (row_number() OVER (PARTITION BY si // 10 ORDER BY si) - 1)::BIGINT AS si, CASE WHEN si % 2 = 0 THEN sheet END AS name, CASE WHEN si % 2 = 0 THEN 'Vendor| price ' ELSE 'Discount|Nowhere' END AS columns, CASE WHEN si % 3 = 0 THEN '' ELSE '17|SG-04|4%' END AS vals, si % 3 <> 0 AS sweep FROM sheets""")
def q_plan_answers(spark, sf_dir):
    """Plans of workbooks out of detectors' answers."""
    columns, _, sheets_ = V.vplan(spark, sf_dir)
    labels = columns.groupBy("si").agg(F.transform(F.sort_array(F.collect_list(F.struct("ci", "label"))), lambda x: x["label"]).alias("maskColumns"))
    values = F.when(F.col("si") % 3 != 0, F.array(F.lit("17"), F.lit("SG-04"), F.lit("4%")))
    name = F.when(F.col("si") % 2 == 0, F.col("sheet")).when(F.col("si") % 3 == 0, "").otherwise("null")
    one = F.struct(name.alias("name"), "maskColumns", values.alias("maskValues"), F.when(~F.col("sweep"), F.lit(False)).alias("sweepNumbers"))
    answers = sheets_.join(labels, "si").groupBy(F.floor(F.col("si") / V.SHEETS_A_BOOK).alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("si", one.alias("p")))), lambda x: x["p"]).alias("sheets"))
    text = F.concat(F.lit("The plan: "), F.to_json(F.struct("sheets")), F.lit(" as asked."))
    plan = answers.select("doc_id", F.inline(A.plan_of(text)))
    return plan.select("doc_id", "si", "name", F.array_join("columns", "|").alias("columns"), F.array_join("values", "|").alias("vals"), "sweep")


@query("""SELECT doc_id, md5(list_reduce(list_prepend(text, coalesce(vs, [])), lambda a, v: replace(a, v, 'XXXX'))) AS masked_md5, coalesce(n, 0) AS total, coalesce(rate, 0) AS masked_rate, coalesce(cats, 0) AS categories, first_id FROM vdoc LEFT JOIN vals USING (doc_id) LEFT JOIN (
SELECT doc_id, count(*) AS n, floor(count(*) FILTER (action <> 'skipped') * 100.0::DOUBLE / count(*) + 0.5)::BIGINT AS rate, count(DISTINCT field_name) AS cats, min_by(field_id, position) AS first_id FROM audit GROUP BY doc_id) USING (doc_id)""")
def q_exports(spark, sf_dir):
    out, at = R.exports(V.vdoc(spark, sf_dir), _log(spark, sf_dir, *_AUDITED)), lambda p: F.get_json_object("export", p)
    return out.select(
        "doc_id", F.md5(at("$.masked_document")).alias("masked_md5"), at("$.stats.total").cast("long").alias("total"), at("$.stats.masked_rate").cast("long").alias("masked_rate"),
        F.json_array_length(at("$.stats.by_category")).cast("long").alias("categories"), at("$.audit_log[0].field_id").alias("first_id"),
    )


@query("SELECT doc_id, field_name, count(*) AS total, count(*) FILTER (accepted IS DISTINCT FROM false) AS masked, count(*) FILTER (NOT accepted) AS skipped FROM findings LEFT JOIN lastdec USING (doc_id, field_id) GROUP BY ALL")
def q_confirm_categories(spark, sf_dir):
    return R.confirm_category_stats(*_decided(spark, sf_dir, "field_name"))


@query("SELECT sheet, count(*) AS masked FROM claims GROUP BY sheet")
def q_masked_total(spark, sf_dir):
    return G.masked_total(G.claims(V.vgrid(spark, sf_dir), *V.vplan(spark, sf_dir)))


@query("SELECT sheet, count(*) AS total, count(*) AS masked, 0::BIGINT AS skipped, 0::BIGINT AS pending, 100::BIGINT AS masked_rate, 'AI-Masked' AS category FROM claims GROUP BY sheet")
def q_run_stats(spark, sf_dir):
    stats = R.run_stats(G.claims(V.vgrid(spark, sf_dir), *V.vplan(spark, sf_dir)), "sheet")
    return stats.select("sheet", "total", "masked", "skipped", "pending", "masked_rate", F.col("by_category")[0]["category"].alias("category"))


@query(r"""SELECT doc_id, md5(list_reduce(list_prepend(text, list_transform(coalesce(vs, []), lambda v: '(?i)' || replace(replace(regexp_escape(v), '\ ', '\s*'), '\-', '[-–—]'))), lambda a, p: regexp_replace(a, p, 'XXXX', 'g'))) AS masked_md5
FROM vdoc LEFT JOIN (SELECT doc_id, list(value ORDER BY seq) AS vs FROM hits WHERE length(value) >= 2 GROUP BY doc_id) USING (doc_id)""")
def q_detect_texts(spark, sf_dir):
    return detect.masked_texts(V.vdoc(spark, sf_dir)).select("doc_id", F.md5("masked").alias("masked_md5"))


@query("SELECT doc_id, seq, category AS field_name, value AS original_value, CASE WHEN category = 'Percentage' THEN 'medium' ELSE 'high' END AS sensitivity FROM hits")
def q_detect_values(spark, sf_dir):
    return detect.suggest(V.vdoc(spark, sf_dir)).select("doc_id", F.col("ai_seq").cast("long").alias("seq"), "field_name", "original_value", "sensitivity")


@query("SELECT sheet, r, c, CASE WHEN (c IN (1, 2, 3) AND r > 1 OR money) AND lower(trim(value)) NOT IN ('vendor', 'price', 'discount') THEN 'XXXX' ELSE value END AS value FROM sweepable")
def q_detect_grid(spark, sf_dir):
    cells = V.vgrid(spark, sf_dir).withColumn("si", F.substring("sheet", 2, 20).cast("long"))
    return detect.masked_grid(cells).select("sheet", "r", "c", "value")


@query("SELECT doc_id, md5(replace(replace(replace(text, ' quoted ', chr(9)), chr(10), chr(10) || chr(10)), chr(9), chr(10) || chr(10))) AS text_md5 FROM vdoc")
def q_new_word(spark, sf_dir):
    """Texts as new Word packages, lines with a tab as rows of a table; and the packages' texts."""
    docs = V.vdoc(spark, sf_dir).select("doc_id", F.replace("text", F.lit(" quoted "), F.lit("\t")).alias("text"))
    return word.new_documents(docs).select("doc_id", F.md5(word.document_text(F.col("content"))).alias("text_md5"))


@query("""SELECT doc_id, md5(replace(list_reduce(list_prepend(text, [f.vendor, 'USD ' || f.price]), lambda a, v: replace(a, v, 'XXXX')), chr(10), chr(10) || chr(10))) AS text_md5 FROM vdoc JOIN firsts f USING (doc_id)""")
def q_word_by_values(spark, sf_dir):
    """New Word packages masked run by run by a vendor and a price, and their texts."""
    files = word.new_documents(V.vdoc(spark, sf_dir))
    values = V.vvalues(spark, sf_dir).where("vi < 2").groupBy("doc_id").agg(F.collect_list("value").alias("values"))
    return word.mask_values(files, values).select("doc_id", F.md5(word.document_text(F.col("content"))).alias("text_md5"))


@query("SELECT event_id, props AS delta FROM events")
def q_event_delta(spark, sf_dir):
    """Texts of streamed lines of a detector."""
    said = F.replace(F.replace("props", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    line = F.concat(F.lit("data: {'contentBlockDelta': {'delta': {'text': '"), said, F.lit("'}}}"))
    return V.table(spark, sf_dir, "events").select("event_id", T.event_delta(line).alias("delta"))


@query("SELECT conv_id, turn, role, md5(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS xml_md5, true AS back FROM conversations")
def q_xml_codec(spark, sf_dir):
    body = F.coalesce("text", F.lit(""))
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.md5(T.encode_xml(body)).alias("xml_md5"), (T.decode_xml(T.encode_xml(body)) == body).alias("back"))


@query("SELECT page_id, lower(regexp_replace(url, '[^0-9A-Za-z_]+', '_', 'g')) AS field_id, coalesce(nullif(lower(regexp_replace(CASE WHEN page_id % 2 = 0 THEN '' ELSE 'A b' END, '[^0-9A-Za-z_]+', '_', 'g')), ''), 'pdf_' || page_id) AS other_id FROM pages")
def q_field_ids(spark, sf_dir):
    name = F.when(F.col("page_id") % 2 == 0, "").otherwise("A b")
    return V.table(spark, sf_dir, "pages").select("page_id", T.field_id(F.col("url"), F.col("page_id")).alias("field_id"), T.field_id(name, F.col("page_id")).alias("other_id"))


@query("SELECT doc_id, (length(text) - length(replace(text, chr(10), ''))) * 3 AS masks FROM vdoc")
def q_mask_count(spark, sf_dir):
    rows = V.vmasked(spark, sf_dir)
    return rows.select("doc_id", T.mask_count(F.col("masked")).alias("masks"))


@query("SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS body_md5 FROM documents WHERE NOT contains(coalesce(text, ''), '`')".replace("\\\\", "\\"))
def q_fences(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").where(~F.coalesce("text", F.lit("")).contains("`"))
    fenced = F.concat(F.lit("```csv\n"), F.coalesce("text", F.lit("")), F.lit("\n```\n"))
    return docs.select("doc_id", F.md5(T.strip_fence(fenced)).alias("body_md5"))


@query("SELECT si, CASE WHEN si % 2 = 0 THEN ' o' || si || ' ' END AS name, 'O' || si AS sheet FROM sheets")
def q_resolve_sheets(spark, sf_dir):
    """Plan sheets by name in any case, or by place."""
    plan = V.vplan(spark, sf_dir)[2].select("si", F.when(F.col("si") % 2 == 0, F.concat(F.lit(" o"), F.col("si").cast("string"), F.lit(" "))).alias("name"))
    return G.resolve_sheets(plan, V.vplan(spark, sf_dir)[2].select(F.col("si").alias("idx"), "sheet"))


@query(r"""SELECT si AS doc_id, md5(chr(65279) || regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY r), 'SG[-–—]04', 'XXXX', 'g'), '(?i)quarter\s*report', 'XXXX', 'g')) AS masked_md5 FROM vrows JOIN sheets USING (sheet) GROUP BY si""")
def q_csv_values(spark, sf_dir):
    values = F.array(F.lit("SG-04"), F.lit("quarter report"), F.lit("x"))
    return _csv_docs(spark, sf_dir).select("doc_id", F.md5(M.mask_csv_text(F.concat(F.lit("﻿"), F.col("text")), values)).alias("masked_md5"))


@query("""SELECT count(*) FILTER (ext IN ('csv', 'docx') AND strlen(text) <= 3000) AS accepted, count(*) FILTER (ext NOT IN ('csv', 'docx')) AS unsupported, count(*) FILTER (ext IN ('csv', 'docx') AND strlen(text) > 3000) AS too_large, count(DISTINCT CASE WHEN ext IN ('csv', 'docx') AND strlen(text) <= 3000 THEN doc_id END) AS ids
FROM (SELECT doc_id, coalesce(text, '') AS text, (['csv', 'docx', 'txt'])[doc_id % 3 + 1] AS ext FROM documents)""")
def q_ingest(spark, sf_dir):
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    ext = F.element_at(F.array(*map(F.lit, ("csv", "DOCX", "txt"))), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    files = V.table(spark, sf_dir, "documents").select(path.alias("path"), F.octet_length(content).alias("length"), content.alias("content"))
    accepted, rejected = D.ingest(files, D.EngineConfig(max_upload_bytes=3000))
    none = F.lit(None).cast("string")
    both = accepted.select("doc_id", none.alias("reason")).unionByName(rejected.select(none.alias("doc_id"), "reason"))
    rejects = lambda reason: F.count_if(F.col("reason") == reason)
    return both.agg(F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_distinct("doc_id").alias("ids"), rejects("unsupported file type").alias("unsupported"), rejects("file too large").alias("too_large"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, sum(floor(size * 1000 + 0.5)::BIGINT)::BIGINT AS sizes, sum(floor(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE size * length(l_returnflag) * 0.55::DOUBLE END * 1000 + 0.5)::BIGINT)::BIGINT AS widths
FROM (SELECT *, CASE WHEN l_discount = 0 AND l_tax = 0 THEN 10 ELSE sqrt(l_discount * l_discount + l_tax * l_tax) END AS size FROM lineitem) GROUP BY ALL""")
def q_item_metrics(spark, sf_dir):
    width = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(0.0)
    items = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("str"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), width.alias("width"))
    milli = lambda c: F.sum(F.floor(F.col(c) * 1000 + 0.5))
    return P.with_metrics(items).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), milli("font_size").alias("sizes"), milli("width").alias("widths"))


@query("""SELECT 'w' || doc_id AS doc_id, 'docx' AS file_type, md5(replace(text, chr(10), chr(10) || chr(10))) AS text_md5 FROM vdoc
UNION ALL SELECT 'c' || si, 'csv', md5(string_agg(line, chr(10) ORDER BY r)) FROM vrows JOIN sheets USING (sheet) GROUP BY si
UNION ALL SELECT 'b' || doc_id, 'xlsx', md5(string_agg('=== Sheet: ' || sheet || ' ===' || chr(10) || body, chr(10) ORDER BY si)) FROM (SELECT si // 10 AS doc_id, si, sheet, string_agg(line, chr(10) ORDER BY r) AS body FROM vrows JOIN sheets USING (sheet) GROUP BY ALL) GROUP BY doc_id
UNION ALL SELECT 'p' || page_id, 'pdf', NULL FROM pages""")
def q_parse(spark, sf_dir):
    """Texts of Word, CSV and spreadsheet files, each by its type; types without a reader have none."""
    named = lambda df, letter, kind: df.select(F.concat(F.lit(letter), F.col("doc_id").cast("string")).alias("doc_id"), F.lit(kind).alias("file_type"), "content")
    lines = _csv_docs(spark, sf_dir).select("doc_id", F.encode(F.concat(F.lit("﻿"), F.col("text"), F.lit("\n")), "UTF-8").alias("content"))
    pages = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.encode(F.col("html"), "UTF-8").alias("content"))
    files = named(word.new_documents(V.vdoc(spark, sf_dir)), "w", "docx").unionByName(named(lines, "c", "csv")).unionByName(named(_books(spark, sf_dir), "b", "xlsx")).unionByName(named(pages, "p", "pdf"))
    return parse.texts(files).select("doc_id", "file_type", F.md5("text").alias("text_md5"))
