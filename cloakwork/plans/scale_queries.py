"""Queries over what needs state, order or numbers across rows: job runs, files in pieces, bands of numbers; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork import sql
from cloakwork.config import EngineConfig
from cloakwork.operators import detect
from cloakwork.operators import documents as D
from cloakwork.operators.bands import number_matches, sweep_matches
from cloakwork.operators.line_chunks import line_chunks
from cloakwork.operators.policy import mask_columns, profiled_columns, profiles
from cloakwork.plans import views as V
from cloakwork.plans.file_queries import _MASKED_LINES, _csv_docs
from cloakwork.plans.queries import ORACLE_SQL, QUERIES, query
from cloakwork.sources import sheets, word
from cloakwork.sources.csv_blocks import block_cells
from cloakwork.sources.masking import mask_files
from cloakwork.sources.parse import with_text
from cloakwork.streaming.jobs import runs_of_table

PIECE_CHARS = 53


@query("""job_starts AS (
  SELECT user_id, min(ts) AS at FROM events GROUP BY user_id
  UNION ALL SELECT s.user_id, min(e.ts) FROM job_starts s JOIN events e ON e.user_id = s.user_id AND e.ts > s.at + INTERVAL 1 HOUR GROUP BY s.user_id
), job_firsts AS (SELECT s.user_id, s.at, arg_min(e.event_id, e.event_id) AS first_run, arg_min(e.event_type, e.event_id) AS result FROM job_starts s JOIN events e ON e.user_id = s.user_id AND e.ts = s.at GROUP BY ALL)
SELECT e.user_id AS doc_id, e.event_id AS run_id, f.first_run, f.at AS first_at, f.result, e.event_id <> f.first_run AS replayed FROM events e ASOF JOIN job_firsts f ON e.user_id = f.user_id AND e.ts >= f.at""", recursive=True)
def q_job_runs(spark, sf_dir):
    """Every event as a run of its user's job: the first of an hour does the work, the others get its result."""
    events = V.table(spark, sf_dir, "events")
    runs = runs_of_table(events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("result")))
    return runs.select("doc_id", "run_id", "first_run", F.col("first_at").cast("timestamp_ntz").alias("first_at"), "result", "replayed")


@query("""SELECT doc_id, r, c, value, begins AS start, begins + length(raw) AS "end" FROM (
SELECT *, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY r, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM (
SELECT s.si AS doc_id, l.r, k.c, coalesce(v.value, '') AS value, CASE WHEN contains(v.value, ',') THEN '"' || v.value || '"' ELSE coalesce(v.value, '') END AS raw
FROM (SELECT DISTINCT sheet, r FROM vgrid) l JOIN sheets s USING (sheet) JOIN (SELECT unnest(generate_series(0, 5)) AS c) k ON true LEFT JOIN vgrid v ON v.sheet = l.sheet AND v.r = l.r AND v.c = k.c))""")
def q_csv_pieces(spark, sf_dir):
    """Cells and spans of CSV files that are cut into pieces anywhere, inside quotes too."""
    docs = _csv_docs(spark, sf_dir)
    begins = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE_CHARS).cast("int"))
    pieces = docs.select("doc_id", F.posexplode(F.transform(begins, lambda k: F.substring(F.col("text"), k * PIECE_CHARS + 1, F.lit(PIECE_CHARS)))).alias("seq", "text"))
    return block_cells(pieces).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("r", "c")], "value", "start", "end")


def _numbers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Number cells of all workbooks, and as each one's values the prices and percentages of one row of every sheet."""
    cells = V.vcells(spark, sf_dir)
    values = cells.where("r = 5 AND c IN (2, 3)").select("doc_id", (F.col("si") * 2 + F.col("c") - 2).alias("vi"), "value")
    return cells.where("num_value IS NOT NULL").select("doc_id", "sheet", "r", "c", "num_value"), values


_BANDS = """SELECT n.doc_id, sheet, r, c, string_agg(DISTINCT vi, ',' ORDER BY vi) AS vis FROM (
SELECT doc_id, sheet, r, c, regexp_replace(value, '[$ ,%]', '', 'g')::DOUBLE / CASE WHEN contains(value, '%') THEN 100 ELSE 1 END AS n FROM vcells WHERE regexp_full_match(value, '(?:[$] )?[0-9][0-9.,]*%?')) n
JOIN (SELECT doc_id, si * 2 + c - 2 AS vi, regexp_replace(value, '[$ ,%]', '', 'g')::DOUBLE AS t, contains(value, '%') AS pct FROM vcells WHERE r = 5 AND c IN (2, 3) AND regexp_matches(value, '[1-9]')) v USING (doc_id)
WHERE abs(n - t) <= greatest(1e-9, t * 1e-9) OR (pct AND {share}) GROUP BY ALL"""


@query(_BANDS.format(share="abs(n * 100 - t) <= greatest(1e-6, t * 1e-6)"))
def q_number_bands(spark, sf_dir):
    return number_matches(*_numbers(spark, sf_dir), ["doc_id"]).select("doc_id", "sheet", "r", "c", F.array_join("vis", ",").alias("vis"))


@query(_BANDS.format(share="t <= 100 AND n > 0 AND n < 1 AND abs(n * 100 - t) <= 1e-6"))
def q_number_sweep(spark, sf_dir):
    return sweep_matches(*_numbers(spark, sf_dir), ["doc_id"]).select("doc_id", "sheet", "r", "c", F.array_join("vis", ",").alias("vis"))


@query("SELECT doc_id, value, any_value(category) AS field_name FROM hits WHERE length(value) >= 2 GROUP BY doc_id, value")
def q_detect_chunks(spark, sf_dir):
    """Texts in chunks of some lines each, detected chunk by chunk and put together."""
    return detect.detect_text(V.vdoc(spark, sf_dir), EngineConfig(chunk_chars=300)).select("doc_id", "value", "field_name")


@query("""SELECT doc_id, 'auto_' || row_number() OVER (PARTITION BY doc_id ORDER BY vi) AS field_id, CASE WHEN regexp_matches(value, '[0-9,]{5,}|USD') THEN 'Price' ELSE 'Vendor Name' END AS field_name, value AS original_value, 90 AS confidence, 1::BIGINT AS occurrences, true AS verified FROM vvalues""")
def q_direct_findings(spark, sf_dir):
    """A detector's values taken at its word."""
    values = V.vvalues(spark, sf_dir)
    twice = values.withColumn("ord", F.col("vi")).unionByName(values.withColumn("ord", F.col("vi") + 10))
    return detect.direct_findings(twice).select("doc_id", "field_id", "field_name", "original_value", "confidence", "occurrences", "verified")


_OVER = "replace(replace(replace({text}, {v}, repeat('X', length({v}))), upper({v}), repeat('X', length({v}))), lower({v}), repeat('X', length({v})))"


@query(f"""SELECT doc_id, strlen(masked) AS n_bytes, md5(masked) AS masked_md5 FROM (SELECT doc_id, {_OVER.format(text="once", v="'USD ' || price")} AS masked FROM (
SELECT d.doc_id, price, {_OVER.format(text="text", v="vendor")} AS once FROM vdoc d JOIN firsts USING (doc_id)))""")
def q_legacy_masked(spark, sf_dir):
    """Bytes of legacy files overwritten in place."""
    files = V.vdoc(spark, sf_dir).select("doc_id", F.encode("text", "ISO-8859-1").alias("content"))
    values = V.vvalues(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("vi", "value"))), lambda x: x["value"]).alias("values"))
    return word.mask_legacy_files(files, values).select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("masked_md5"))


_PLANNED = _MASKED_LINES.format(cells="SELECT v.*, k.kind IS NOT NULL AS hit FROM vgrid v LEFT JOIN claims k USING (sheet, r, c)")


@query(f"""SELECT 'c' || p.doc_id AS doc_id, 'in_' || p.doc_id || '-masked.csv' AS file_name, 'A-plan' AS track, coalesce(n, 0) AS masked, NULL AS error, masked_md5 FROM ({_PLANNED}) p LEFT JOIN (SELECT s.si AS doc_id, count(*) AS n FROM claims JOIN sheets s USING (sheet) GROUP BY s.si) USING (doc_id)
UNION ALL SELECT 'w' || doc_id, 'in_' || doc_id || '-masked.docx', 'B-detect', 2, NULL, md5(replace(list_reduce(list_prepend(text, [f.vendor, 'USD ' || f.price]), lambda a, v: replace(a, v, 'XXXX')), chr(10), chr(10) || chr(10))) FROM vdoc JOIN firsts f USING (doc_id)
UNION ALL SELECT 'd' || doc_id, 'in_' || doc_id || '-masked.doc', 'B-detect', 2, NULL, md5(masked) FROM (SELECT doc_id, {_OVER.format(text="once", v="'USD ' || price")} AS masked FROM (SELECT d.doc_id, price, {_OVER.format(text="text", v="vendor")} AS once FROM vdoc d JOIN firsts USING (doc_id)))
UNION ALL SELECT 'p' || page_id, 'in_' || page_id || '-masked.pdf', 'C', NULL, 'no writer of this type', NULL FROM pages""")
def q_mask_files(spark, sf_dir):
    """A masking run over CSV, Word, legacy Word and PDF files with what a detector answered, each by its own track."""
    named = lambda df, letter, kind: df.select(F.concat(F.lit(letter), F.col("doc_id").cast("string")).alias("doc_id"), F.concat(F.lit("in "), F.col("doc_id").cast("string"), F.lit(f".{kind}")).alias("file_name"), F.lit(kind).alias("file_type"), "content")
    said = lambda df, letter, answer: df.select(F.concat(F.lit(letter), F.col("doc_id").cast("string")).alias("doc_id"), answer.alias("answer"))
    docs, pages = V.vdoc(spark, sf_dir), V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.encode("html", "UTF-8").alias("content"))
    lines = _csv_docs(spark, sf_dir).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    files = named(lines, "c", "csv").unionByName(named(word.new_documents(docs), "w", "docx")).unionByName(named(docs.select("doc_id", F.encode("text", "ISO-8859-1").alias("content")), "d", "doc")).unionByName(named(pages, "p", "pdf"))

    columns, values, plan = V.vplan(spark, sf_dir)
    listed = lambda t, at, v, name: t.groupBy("si").agg(F.transform(F.sort_array(F.collect_list(F.struct(at, v))), lambda x: x[v]).alias(name))
    sheet = F.struct("maskColumns", "maskValues", F.col("sweep").alias("sweepNumbers"))
    plans = plan.join(listed(columns, "ci", "label", "maskColumns"), "si").join(listed(values, "vi", "value", "maskValues"), "si").withColumn("doc_id", F.col("si"))
    item = F.struct(F.lit("Value").alias("fieldName"), F.col("value").alias("originalValue"))
    found = V.vvalues(spark, sf_dir).where("vi < 2").groupBy("doc_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("vi", item.alias("v")))), lambda x: x["v"])).alias("found"))
    answers = said(plans, "c", F.to_json(F.struct(F.array(sheet).alias("sheets"))))
    for letter in "wd":
        answers = answers.unionByName(said(found, letter, F.col("found")))
    answers = answers.unionByName(said(pages, "p", F.lit("[]")))

    masked = mask_files(files, answers, EngineConfig(single_pass_chars=40))
    digest = F.when(F.col("file_type") == "doc", F.md5("content")).when(F.col("error").isNull(), F.md5("text"))
    return with_text(masked).select("doc_id", "file_name", "track", "masked", "error", digest.alias("masked_md5"))


@query("SELECT doc_id, sheet, r, c, value, 3::BIGINT AS r0, 2::BIGINT AS c0 FROM vcells")
def q_grid_origin(spark, sf_dir):
    """Sheets that begin at C4, counted from their own first cell, and the way back."""
    moved = V.vcells(spark, sf_dir).select("doc_id", "sheet", (F.col("r") + 3).alias("r"), (F.col("c") + 2).alias("c"), "value")
    return sheets.from_origin(moved).select("doc_id", "sheet", "r", "c", "value", "r0", "c0")


@query("""SELECT doc_id % 5 AS kind, count(*) AS files, count(*) FILTER (doc_id % 5 < 4) AS accepted FROM documents GROUP BY ALL""")
def q_ingest_mime(spark, sf_dir):
    """Files without an extension, told apart by their MIME type."""
    kinds = ("text/csv", "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword", "text/html")
    docs = V.table(spark, sf_dir, "documents")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    mime = F.element_at(F.array(*map(F.lit, kinds)), (F.col("doc_id") % 5 + 1).cast("int"))
    files = docs.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(content).alias("length"), content.alias("content"), mime.alias("mime"))
    accepted, rejected = D.ingest(files, EngineConfig(max_upload_bytes=1 << 40))
    number = lambda path: F.element_at(F.split(path, "/"), -1).cast("long") % 5
    both = accepted.select(number("file_name").alias("kind"), F.lit(1).alias("ok")).unionByName(rejected.select(number("path").alias("kind"), F.lit(0).alias("ok")))
    return both.groupBy("kind").agg(F.count("*").alias("files"), F.sum("ok").alias("accepted"))


def q_line_chunks(spark, sf_dir):
    """The chunks of q_chunks, of texts whose lines are rows."""
    docs = V.table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    return line_chunks(lines, 4000).select("doc_id", F.col("chunk_no").cast("int").alias("chunk_no"), "n_lines", "n_chars")


QUERIES["q_line_chunks"], ORACLE_SQL["q_line_chunks"] = q_line_chunks, ORACLE_SQL["q_chunks"]  # the same rows


def _silent(spark, sf_dir) -> DataFrame:
    """vgrid with headers that say nothing, but for one that has a word inside another."""
    heads = F.when(F.col("value") == "Item", "Separate").otherwise(F.concat(F.lit("Column "), F.col("c").cast("string")))
    cells = V.vgrid(spark, sf_dir).withColumn("si", F.substring("sheet", 2, 20).cast("long"))
    return cells.withColumn("value", F.when(F.col("value").isin(*V.HEADERS), heads).otherwise(F.col("value")))


@query("""SELECT sheet, c, count(*) AS n, count(*) FILTER (regexp_full_match(value, '[0-9]+%')) AS percent, count(*) FILTER (regexp_full_match(value, '[A-Z]{2,3}-[0-9]{1,4}')) AS code,
count(*) FILTER (regexp_full_match(value, '[0-9,]+([.][0-9]+)?')) AS number, min(CASE WHEN regexp_full_match(value, '[0-9,]+([.][0-9]+)?') THEN replace(value, ',', '')::DOUBLE END) AS low,
max(CASE WHEN regexp_full_match(value, '[0-9,]+([.][0-9]+)?') THEN replace(value, ',', '')::DOUBLE END) AS high FROM vgrid WHERE r > 1 GROUP BY ALL""")
def q_column_profiles(spark, sf_dir):
    return profiles(_silent(spark, sf_dir)).select("sheet", "c", "n", "percent", "code", "number", "low", "high")


@query("SELECT sheet, r, c, CASE WHEN r > 1 AND c IN (1, 2, 3, 5) THEN 'XXXX' WHEN value = 'Item' THEN 'Separate' WHEN value IN ('Vendor', 'Price', 'Discount', 'Qty', 'Net') THEN 'Column ' || c ELSE value END AS value FROM vgrid")
def q_profiled_grid(spark, sf_dir):
    """Grids masked by what their columns look like."""
    cells = _silent(spark, sf_dir)
    return mask_columns(cells, profiled_columns(cells), "XXXX").select("sheet", "r", "c", "value")


def q_sql_hits(spark, sf_dir):
    """The hits of q_scan_hits, in SQL."""
    sql.register(spark)
    return spark.sql("SELECT d.doc_id, h.seq, h.category, h.value, h.key FROM {docs} d, LATERAL scan_hits(d.text) h", docs=V.vdoc(spark, sf_dir))


def q_sql_places(spark, sf_dir):
    """The places of q_locate, in SQL."""
    sql.register(spark)
    text = """WITH given AS (SELECT doc_id, collapse_text(original_value) AS value, min(ai_seq) AS ai_seq FROM {suggestions} GROUP BY doc_id, collapse_text(original_value)),
    found AS (SELECT d.doc_id, ai_seq, place_of(text, value) AS p FROM {docs} d JOIN given g ON d.doc_id = g.doc_id)
    SELECT doc_id, ai_seq, p.occurrences AS count, p.exact, CAST(p.place AS BIGINT) AS index FROM found"""
    return spark.sql(text, docs=V.vdoc(spark, sf_dir), suggestions=V.vsug(spark, sf_dir))


def q_sql_masked(spark, sf_dir):
    """The masked texts of q_detect_texts, in SQL."""
    sql.register(spark)
    return spark.sql("SELECT doc_id, md5(mask_values(text, transform(text_hits(text), h -> h.value))) AS masked_md5 FROM {docs}", docs=V.vdoc(spark, sf_dir))


for _made, _same in ((q_sql_hits, "q_scan_hits"), (q_sql_places, "q_locate"), (q_sql_masked, "q_detect_texts")):
    QUERIES[_made.__name__], ORACLE_SQL[_made.__name__] = _made, ORACLE_SQL[_same]
