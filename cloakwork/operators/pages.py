"""Page geometry: lines from positioned items, places of values in them, merged spans and redaction boxes; and runs.

items(doc_id, page, item_no, str, x, y, width, font_size); values(doc_id, vi, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.functions.text import js_trim, let, masker, running
from cloakwork.operators.page_index import Y_TOLERANCE

# Widths of Helvetica's characters, in thousandths of an em; all others are 556.
WIDTHS = {
    " ": 278, "!": 278, '"': 355, "%": 889, "&": 667, "'": 191, "(": 333, ")": 333, "*": 389, "+": 584, ",": 278, "-": 333, ".": 278, "/": 278,
    ":": 278, ";": 278, "<": 584, "=": 584, ">": 584, "@": 1015, "A": 667, "B": 667, "C": 722, "D": 722, "E": 667, "F": 611, "G": 778, "H": 722,
    "I": 278, "J": 500, "K": 667, "M": 833, "N": 722, "O": 778, "P": 667, "Q": 778, "R": 722, "S": 667, "T": 611, "U": 722, "V": 667, "W": 944,
    "X": 667, "Y": 667, "Z": 611, "[": 278, "\\": 278, "]": 278, "^": 469, "c": 500, "f": 278, "i": 222, "j": 222, "k": 500, "l": 222, "m": 833,
    "r": 333, "s": 500, "t": 278, "v": 500, "w": 722, "x": 500, "y": 500, "z": 500,
}
DEFAULT_WIDTH = 556


def text_lines(items: DataFrame) -> DataFrame:
    """Lines of each page by rounded height, top down: doc_id, page, line_y, line."""
    kept = items.where(js_trim(F.col("str")) != "").withColumn("line_y", F.floor(F.col("y") / 3 + 0.5) * 3)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("x", "item_no", js_trim(F.col("str")).alias("s")))), lambda p: p["s"])
    return kept.groupBy("doc_id", "page", "line_y").agg(F.array_join(parts, " ").alias("line"))


def cluster_lines(items: DataFrame) -> DataFrame:
    """items with line_no: a new line starts where the height differs by more than Y_TOLERANCE from the item before."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x", "item_no")
    jump = F.coalesce((F.abs(F.lag("y").over(w) - F.col("y")) > Y_TOLERANCE).cast("int"), F.lit(0))
    return items.withColumn("jump", jump).withColumn("line_no", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("jump")


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans [s, e) of each key that overlap or touch, as one."""
    w = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.withColumn("before", before).withColumn("new", F.coalesce((F.col("s") > F.col("before")).cast("int"), F.lit(0)))
    grouped = starts.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def char_offsets(text: Column, width: Column) -> Column:
    """Left edges of all characters and the right end, scaled to the item's width."""
    table = F.create_map(*[F.lit(x) for pair in WIDTHS.items() for x in pair])
    each = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(table[c], F.lit(DEFAULT_WIDTH)))
    return let(let(each, running), lambda e: F.transform(e, lambda x: x * F.when(F.element_at(e, -1) > 0, width / F.element_at(e, -1)).otherwise(0.0)))


def redaction_boxes(items: DataFrame, spans: DataFrame) -> DataFrame:
    """spans(doc_id, page, item_no, s, e), merged → bars: x, y, w, h and whether the label fits in."""
    both = spans.join(items, ["doc_id", "page", "item_no"]).withColumn("offsets", char_offsets(F.col("str"), F.col("width")))
    n = F.greatest(F.lit(1), F.length("str"))
    start, end = F.greatest(F.lit(0), F.col("s")), F.least(n, F.col("e"))
    pad = F.when((start <= 0) & (end >= n), 0.0).otherwise(F.col("width") / n * 0.35)
    left = F.greatest(F.col("x"), F.col("x") + F.get("offsets", start) - pad)
    right = F.least(F.col("x") + F.col("width"), F.col("x") + F.get("offsets", end) + pad)
    size = F.greatest(F.lit(5.0), F.least(F.col("font_size") * 0.7, F.lit(10.0)))
    return both.where(start < end).select("doc_id", "page", "item_no", "s", "e", left.alias("bx"), (F.col("y") - F.col("font_size") * 0.24).alias("by"), (right - left).alias("bw"), (F.col("font_size") * 1.16).alias("bh"), (size * 2.4 <= right - left).alias("label"))


def with_starts(runs: DataFrame) -> DataFrame:
    """runs(doc_id, part, para_no, run_no, text) with start: where each begins in its paragraph."""
    w = Window.partitionBy("doc_id", "part", "para_no").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("int"))


def run_edits(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """What masking spans(doc_id, part, para_no, s, e) does to each run: s, e in the run and put (the mask, or nothing).

    Spans are merged first, so that no edit eats into the next; the first run of a span gets the mask.
    """
    keys = ["doc_id", "part", "para_no"]
    hit = with_starts(runs).join(merge_spans(spans, keys), keys).where((F.col("start") < F.col("e")) & (F.col("start") + F.length("text") > F.col("s")))
    return hit.select(*keys, "run_no", F.greatest(F.lit(0), F.col("s") - F.col("start")).alias("s"), F.least(F.length("text"), F.col("e") - F.col("start")).alias("e"), F.when(F.col("s") >= F.col("start"), "XXXX").otherwise("").alias("put"))


def pattern_spans(text: Column, pattern: Column) -> Column:
    """array(struct(s, e)) of a pattern's matches in a text, one after the other: by the pieces that stand between them."""

    def places(x: Column) -> Column:
        sizes = F.transform(x["hit"], lambda h, i: F.length(F.get(x["gap"], i)) + F.length(h))
        return let(running(sizes), lambda ends: F.transform(x["hit"], lambda h, i: F.struct((F.get(ends, i) + F.length(F.get(x["gap"], i))).alias("s"), F.get(ends, i + 1).alias("e"))))

    return let(F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit")), places)


def value_spans(runs: DataFrame, values: DataFrame) -> DataFrame:
    """runs(doc_id, part, para_no, run_no, text), values(doc_id, values) → spans of the values in each paragraph's whole text."""
    keys = ["doc_id", "part", "para_no"]
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_no", "text"))), lambda x: x["text"]), "")
    texts = runs.groupBy(*keys).agg(whole.alias("text")).join(values, "doc_id")
    long = F.filter("values", lambda v: F.length(js_trim(v)) >= 2)
    return texts.select(*keys, F.inline(F.flatten(F.transform(long, lambda v: pattern_spans(F.col("text"), masker(v))))))


def with_metrics(items: DataFrame) -> DataFrame:
    """items(…, str, a, b, width) with font_size, by the first column of a transformation matrix (10 where that is nothing),
    and width, or 0.55 of the size for each character where none is given."""
    size = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    known = F.when(size > 0, size).otherwise(10.0)
    return items.withColumn("font_size", known).withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(F.col("font_size") * F.length("str") * 0.55))
