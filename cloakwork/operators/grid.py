"""Spreadsheet grids in long form: plans of columns, values and a numeric sweep; shifts and differences of two grids.

cells(sheet, r, c, value), one row for each cell, r and c from 0. A plan is three small tables:
plan_columns(si, ci, sheet, label), plan_values(si, vi, sheet, value), plan_sheets(si, sheet, sweep).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.config import MASK
from cloakwork.functions.numbers import number_hit, number_tokens
from cloakwork.functions.text import collapse, guess_category, guess_category_from_header, js_trim, let, matches_sweep, norm
from cloakwork.operators.mask import mask_flexible
from cloakwork.patterns import WHITE_SIGNS


def header_cells(cells: DataFrame, plan_columns: DataFrame) -> DataFrame:
    """Cells whose text is a plan's label, on any row: si, ci, sheet, r, c. Blank labels find nothing."""
    labels = plan_columns.select("si", "ci", "sheet", norm(F.col("label")).alias("want")).where("want <> ''")
    return cells.withColumn("want", norm(F.col("value"))).join(labels, ["sheet", "want"]).select("si", "ci", "sheet", "r", "c")


def _maskable(value: Column) -> Column:
    return (js_trim(value) != "") & (F.upper(js_trim(value)) != MASK)


def _plans(plan_columns: DataFrame, plan_values: DataFrame, plan_sheets: DataFrame) -> DataFrame:
    """One row a sheet: cols (si, ci, label), vals (si, vi, want) and sweeps (si), as arrays."""
    cols = plan_columns.select("sheet", F.struct("si", "ci", norm(F.col("label")).alias("label")).alias("col"))
    vals = plan_values.select("sheet", F.struct("si", "vi", js_trim(F.col("value")).alias("want")).alias("val"))
    sweeps = plan_sheets.where("sweep").select("sheet", F.col("si").alias("sweep"))
    every = cols.unionByName(vals, True).unionByName(sweeps, True)
    plans = every.groupBy("sheet").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("col", "val", "sweep")])
    named = lambda s: F.exists("cols", lambda k: k["si"] == s) | F.exists("vals", lambda k: k["si"] == s)
    return plans.withColumn("sweeps", F.filter("sweeps", named)).withColumn("vals", F.filter("vals", lambda v: v["want"] != ""))


def _claimants(cells: DataFrame, plan_columns: DataFrame, plan_values: DataFrame, plan_sheets: DataFrame) -> tuple[DataFrame, Column]:
    """Plans by sheet, and for cells joined with them an array of the cell's first claimant (si, kind, idx), or of none.

    A sheet's plan is one row of arrays, with the topmost header of each label in each column, as only that matters for
    what lies below. Cells meet it in one join by sheet, and the claimant is chosen inside the row.
    """
    plans = _plans(plan_columns, plan_values, plan_sheets)
    heads = cells.join(plans.select("sheet", "cols"), "sheet").select("sheet", "r", "c", F.explode(F.filter("cols", lambda k: (k["label"] != "") & (k["label"] == norm(F.col("value"))))).alias("k"))
    tops = heads.groupBy("sheet", "k.si", "k.ci", "c").agg(F.min("r").alias("top")).groupBy("sheet").agg(F.collect_list(F.struct("c", "top", "si", "ci")).alias("tops"))
    claim = lambda si, kind, idx: F.struct(si.cast("long").alias("si"), F.lit(kind).alias("kind"), idx.cast("int").alias("idx"))
    none = F.array().cast("array<struct<si:bigint,kind:int,idx:int>>")

    def first(x: Column) -> Column:
        label = lambda si: F.exists("cols", lambda k: (k["si"] == si) & (k["label"] == x["label"]))
        below = F.filter("tops", lambda t: (t["c"] == F.col("c")) & (F.col("r") > t["top"]) & ~label(t["si"]))
        equal = F.filter("vals", lambda v: (v["want"] == x["want"]) & (F.col("r") >= 1))
        swept = F.filter("sweeps", lambda s: ~label(s) & x["shaped"])
        every = [F.transform(below, lambda t: claim(t["si"], 0, t["ci"])), F.transform(equal, lambda v: claim(v["si"], 1, v["vi"])), F.transform(swept, lambda s: claim(s, 2, F.lit(0)))]
        return F.filter(F.array(F.array_min(F.concat(*[F.coalesce(e, none) for e in every]))), lambda c: c.isNotNull())

    shaped = F.when(F.size("sweeps") > 0, matches_sweep(F.col("value"))).otherwise(F.lit(False))
    known = F.struct(norm(F.col("value")).alias("label"), js_trim(F.col("value")).alias("want"), shaped.alias("shaped"))
    return plans.join(tops, "sheet", "left"), let(known, first)


def claims(cells: DataFrame, plan_columns: DataFrame, plan_values: DataFrame, plan_sheets: DataFrame) -> DataFrame:
    """Each masked cell with its first claimant: sheet, r, c, value, si, kind (column, value, sweep) and idx; and what other
    columns cells have between value and si."""
    plans, first = _claimants(cells.select("sheet", "r", "c", "value"), plan_columns, plan_values, plan_sheets)
    others = [c for c in cells.columns if c not in ("sheet", "r", "c", "value", "si")]
    body = cells.select("sheet", "r", "c", "value", *others).where(_maskable(F.col("value"))).join(plans, "sheet")
    found = body.select("sheet", "r", "c", "value", *others, F.inline(first))  # a generator, as a filter would work the claim out twice
    kind = F.element_at(F.array(F.lit("column"), F.lit("value"), F.lit("sweep")), F.col("kind") + 1)
    return found.select("sheet", "r", "c", "value", *others, "si", kind.alias("kind"), "idx")


def masked_claims(cells: DataFrame, plan_columns: DataFrame, plan_values: DataFrame, plan_sheets: DataFrame) -> DataFrame:
    """cells with a mask for each value that claims() has, without a join back to them."""
    plans, first = _claimants(cells.select("sheet", "r", "c", "value"), plan_columns, plan_values, plan_sheets)
    put = F.when(_maskable(F.col("value")) & (F.size(first) > 0), MASK).otherwise(F.col("value"))
    return cells.join(plans, "sheet", "left").select(*[put.alias("value") if c == "value" else F.col(f"`{c}`") for c in cells.columns])


def claim_counts(claimed: DataFrame, plan_columns: DataFrame, plan_values: DataFrame, plan_sheets: DataFrame) -> DataFrame:
    """si, kind, idx, sheet, label and count for all entries of a plan, those without a cell too."""
    entries = (
        plan_columns.select("si", F.lit("column").alias("kind"), F.col("ci").alias("idx"), "sheet", "label")
        .unionByName(plan_values.select("si", F.lit("value").alias("kind"), F.col("vi").alias("idx"), "sheet", F.col("value").alias("label")))
        .unionByName(plan_sheets.where("sweep").select("si", F.lit("sweep").alias("kind"), F.lit(0).alias("idx"), "sheet", F.lit("").alias("label")))
    )
    found = claimed.groupBy("si", "kind", "idx").agg(F.count("*").alias("found"))
    return entries.join(found, ["si", "kind", "idx"], "left").withColumn("count", F.coalesce("found", F.lit(0)).cast("long")).drop("found")


def plan_review(counts: DataFrame) -> DataFrame:
    """A finding for each column and value of a plan, and for each sweep that found something."""
    number = F.when(F.col("kind") == "sweep", F.concat_ws("_", F.lit("plansweep"), "si")).otherwise(F.concat_ws("_", F.when(F.col("kind") == "column", "plancol").otherwise("planval"), "si", "idx"))
    name = F.when(F.col("kind") == "column", guess_category_from_header(F.lit(""), F.col("label"))).when(F.col("kind") == "value", guess_category(F.col("label"))).otherwise("Price")
    where = F.coalesce(F.concat(F.lit(" of sheet "), F.col("sheet")), F.lit(""))
    shown = F.when(F.col("kind") == "column", F.concat(F.lit("Column "), F.col("label"), where)).when(F.col("kind") == "value", F.col("label")).otherwise(F.concat(F.lit("Further amounts and percentages"), where))
    sweep = F.col("kind") == "sweep"
    return counts.where(~sweep | (F.col("count") > 0)).select(
        number.alias("field_id"), name.alias("field_name"), shown.alias("original_value"), F.when(sweep, "pattern").otherwise("ai").alias("source"),
        F.when(sweep, 75).otherwise(90).alias("confidence"), F.col("count").alias("occurrences"), (F.col("count") > 0).alias("verified"),
    )


def plan_without(plan_columns: DataFrame, plan_values: DataFrame, plan_sheets: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan's tables without what rejected(field_id) names."""
    left = lambda df, *parts: df.withColumn("field_id", F.concat_ws("_", *parts)).join(rejected, "field_id", "left_anti").drop("field_id")
    columns, values = left(plan_columns, F.lit("plancol"), "si", "ci"), left(plan_values, F.lit("planval"), "si", "vi")
    gone = rejected.select(F.col("field_id").alias("gone"))
    sheets = plan_sheets.join(gone, F.concat_ws("_", F.lit("plansweep"), "si") == F.col("gone"), "left").withColumn("sweep", F.col("sweep") & F.col("gone").isNull()).drop("gone")
    return columns, values, sheets


def resolve_sheets(plan_sheets: DataFrame, sheets: DataFrame, book: str | None = None) -> DataFrame:
    """plan_sheets(si, name) and sheets(idx, sheet) → si, name, sheet: by name in any case, or by position.

    book names a column of both that tells workbooks apart, and is in the result.
    """
    plain = lambda c: F.lower(js_trim(c))
    own = [book] if book else []
    by_name = sheets.groupBy(*own, plain(F.col("sheet")).alias("key")).agg(F.min(F.struct("idx", "sheet")).alias("named"))
    by_place = sheets.select(*own, F.col("idx").alias("si"), F.col("sheet").alias("placed"))
    both = plan_sheets.withColumn("key", plain(F.col("name"))).join(by_name, [*own, "key"], "left").join(by_place, [*own, "si"], "left")
    return both.select(*own, "si", "name", F.coalesce("named.sheet", "placed").alias("sheet")).where("sheet IS NOT NULL")


def plan_sample(rows: DataFrame, head: int = 30) -> DataFrame:
    """rows(sheet, r, line) → the first `head` rows that aren't blank and about as many spread over the rest."""
    filled = rows.where(js_trim(F.col("line")) != "")
    w = Window.partitionBy("sheet").orderBy("r")
    n = filled.groupBy("sheet").agg(F.count("*").alias("n"))
    numbered = filled.withColumn("rn", F.row_number().over(w) - 1).join(n, "sheet")
    step = F.greatest(F.lit(1), F.floor((F.col("n") - head) / head))
    return numbered.where((F.col("rn") < head) | ((F.col("rn") - head) % step == 0)).select("sheet", "r", "line")


def mask_cells(cells: DataFrame, values: list[str]) -> DataFrame:
    """cells(…, value, num_value) with masked: texts keep what surrounds a value, numbers that are one go whole."""
    hit = number_hit(F.col("num_value"), number_tokens(cells.sparkSession, values))
    texts = mask_flexible(F.col("value"), F.array(*map(F.lit, values)).cast("array<string>"))
    return cells.withColumn("masked", F.when(F.col("num_value").isNotNull(), F.when(hit, MASK).otherwise(F.col("value"))).otherwise(texts))


def column_shift(original: DataFrame, other: DataFrame, shifts: int = 3) -> DataFrame:
    """For each sheet the shift of columns under which most header cells of two grids agree; the least of equals."""
    heads = lambda df, name: df.where("r = 0").select("sheet", F.col("c").alias(f"c_{name}"), F.lower(js_trim(F.col("value"))).alias(f"v_{name}"))
    a, b = heads(original, "a"), heads(other, "b")
    tried = b.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1)))).withColumn("c_a", F.col("c_b") - F.col("shift"))
    agree = tried.join(a, ["sheet", "c_a"]).groupBy("sheet", "shift").agg(F.count_if((F.col("v_a") == F.col("v_b")) & (F.col("v_a") != "")).alias("score"))
    return agree.groupBy("sheet").agg(F.max_by("shift", F.struct("score", -F.col("shift"))).alias("shift"), F.max("score").alias("score"))


def grid_diff(original: DataFrame, masked: DataFrame) -> DataFrame:
    """Cells that a detector's copy of a grid has masked, at their place in the original: sheet, r, c, value, header."""
    shift = column_shift(original, masked)
    there = masked.where(F.upper(js_trim(F.col("value"))) == MASK).join(shift.select("sheet", "shift"), "sheet").select("sheet", "r", (F.col("c") - F.col("shift")).alias("c"), F.col("value").alias("seen"))
    header = original.where("r = 0").select("sheet", "c", F.col("value").alias("header"))
    found = original.join(there, ["sheet", "r", "c"]).where(_maskable(F.col("value")) & ~F.col("value").eqNullSafe(F.col("seen")))
    return found.join(header, ["sheet", "c"], "left").select("sheet", "r", "c", "value", F.coalesce("header", F.lit("")).alias("header"))


def detections(diff: DataFrame) -> DataFrame:
    """Distinct values of a diff with the header of the first."""
    return diff.where(F.length(js_trim(F.col("value"))) >= 2).groupBy("value").agg(F.min_by("header", F.struct("sheet", "r", "c")).alias("header"), F.count("*").alias("cells")).withColumn("field_name", guess_category_from_header(F.col("value"), F.col("header")))


def alignment_scores(original: DataFrame, other: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(sheet, r, ro) of rows → how many cells agree, differ and are masked; empty cells count for nothing."""
    a = original.select("sheet", "r", "c", collapse(F.col("value")).alias("va"))
    b = other.select("sheet", F.col("r").alias("ro"), "c", collapse(F.col("value")).alias("vb"))
    both = pairs.join(a, ["sheet", "r"]).join(b, ["sheet", "ro", "c"])
    masked, filled = F.upper("vb") == MASK, (F.col("va") != "") & (F.col("vb") != "")
    return both.groupBy("sheet", "r", "ro").agg(
        F.count_if(filled & ~masked & (F.col("va") == F.col("vb"))).alias("eq"), F.count_if(filled & ~masked & (F.col("va") != F.col("vb"))).alias("neq"), F.count_if(masked & ~F.upper("va").isin("", MASK)).alias("masked"),
    )


def sheet_lines(cells: DataFrame) -> DataFrame:
    """Rows of a grid as CSV lines: sheet, r, line. Rows are padded to the sheet's width; a row is one group."""
    width = cells.groupBy("sheet").agg((F.max("c") + 1).alias("width"))
    quoted = F.when(F.col("value").rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("value"))
    rows = cells.groupBy("sheet", "r").agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), quoted))).alias("at"))
    line = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("width") - 1).cast("int")), lambda c: F.coalesce(F.element_at("at", c), F.lit(""))), ",")
    return rows.join(width, "sheet").select("sheet", "r", line.alias("line"))


def sheet_blocks(docs: DataFrame) -> DataFrame:
    """Sheets of texts with marker lines: doc_id, block, name (null before the first marker), header and rows (count).

    Split and folded inside the row, so nothing is shuffled.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s, i: F.struct(i.alias("i"), s.alias("s"), F.nullif(F.regexp_extract(s, r"\A===\s*Sheet:\s*(.+?)\s*===\z", 1), F.lit("")).alias("name")))
    marks = F.filter(lines, lambda x: x["name"].isNotNull())
    starts = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast("string").alias("name"))), F.transform(marks, lambda x: F.struct(x["i"].alias("i"), x["name"].alias("name"))))
    out = docs.select("doc_id", lines.alias("lines"), starts.alias("starts")).select("doc_id", "lines", F.posexplode("starts").alias("block", "start"), F.col("starts"))
    end = F.coalesce(F.get("starts", F.col("block") + 1)["i"], F.size("lines"))
    body = F.filter(F.transform(F.slice("lines", F.col("start.i") + 2, F.greatest(F.lit(0), end - F.col("start.i") - 1)), lambda x: x["s"]), lambda s: js_trim(s) != "")
    return out.withColumn("body", body).where("block > 0 OR size(body) > 0").select("doc_id", "block", F.col("start.name").alias("name"), F.coalesce(F.get("body", F.lit(0)), F.lit("")).alias("header"), F.greatest(F.lit(0), F.size("body") - 1).alias("rows"))


def masked_total(claimed: DataFrame) -> DataFrame:
    """How many cells a plan masks on each sheet."""
    return claimed.groupBy("sheet").agg(F.count("*").alias("masked"))


def review_fields(line: Column) -> Column:
    """Cells of one line as a review shows them: a quote turns quoting on or off and is dropped, cells are trimmed."""
    parts = F.regexp_extract_all(line, F.lit(r'\G((?:[^",]++|"[^"]*+(?:"|\z))*+)(,|\z)'), F.lit(0))
    whole = F.slice(parts, F.lit(1), F.size(F.filter(parts, lambda p: p.endswith(",") & (F.regexp_count(p, F.lit('"')) % 2 == 0))) + 1)
    return F.transform(whole, lambda p: js_trim(F.replace(F.regexp_replace(p, ",\\z", ""), F.lit('"'), F.lit(""))))


_MARKER = re.compile(r"[ \t\n\x0b\f\r]*===")


def review_cells(line: str) -> list[str]:
    """review_fields() of one line."""
    cells = [""]
    for i, part in enumerate(line.split('"')):
        first, *rest = [part] if i % 2 else part.split(",")
        cells[-1] += first
        cells += rest
    return [c.strip(WHITE_SIGNS) for c in cells]


def _reviewed(text: str, copy: str, shifts: int) -> dict[str, tuple[int, int, str]]:
    """Row, column and header of the first cell of each value that the copy has masked."""
    a, b = ([s for s in t.split("\n") if not _MARKER.match(s)] for t in (text, copy))
    found: dict[str, tuple[int, int, str]] = {}
    if not a or not b:
        return found
    heads, seen = review_cells(a[0]), [c.lower() for c in review_cells(b[0])]
    agree = lambda k: sum(h != "" and h.lower() == (seen[c + k] if c + k < len(seen) else "") for c, h in enumerate(heads))
    shift = max(range(shifts), key=agree)  # the first of the best
    for r, (own, other) in enumerate(zip(a, b)):
        if MASK not in other.upper().replace('"', ""):
            continue
        marks = review_cells(other)[shift:]
        for c, (value, mark) in enumerate(zip(review_cells(own), marks)):
            if mark.upper() == MASK and value.upper() not in ("", MASK) and value not in found:
                found[value] = (r, c, heads[c] if c < len(heads) else "")
    return found


def review_detections(docs: DataFrame, shifts: int = 3) -> DataFrame:
    """docs(doc_id, text, copy): a sheet's text and a detector's masked copy → doc_id, value, header, first, once a value.

    Lines meet by number, marker lines left out; the copy's columns may be shifted, as its first line tells. A text and its
    copy are gone through once, in their row; of a value only its first cell leaves it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owners = [], []
            for i, (text, copy) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "copy")))):
                found = _reviewed(text or "", copy or "", shifts)
                rows += [(value, *at) for value, at in found.items()]
                owners += [i] * len(found)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owners, pa.int64())), *columns], names=["doc_id", "value", "r", "c", "header"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = docs.select("doc_id", "text", "copy").mapInArrow(run, f"doc_id {kind}, value string, r int, c int, header string")
    first = F.min(F.struct("r", "c", "header"))
    return hit.groupBy("doc_id", "value").agg(first.alias("first")).select("doc_id", "value", "first.header", F.struct("first.r", "first.c").alias("first"))
