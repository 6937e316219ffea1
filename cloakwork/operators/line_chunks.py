"""Chunks of texts whose lines are rows, so that a text may be larger than any task.

lines(doc_id, line_no, text). As in documents.chunks, a chunk takes lines in order until one more would make it longer
than the budget; a longer line is a chunk of its own. Where the chunk of a line that begins one would end depends on
lengths alone: running sums say how much stands before each line, and the first line whose end lies beyond that and the
budget begins the next chunk. It is found among lines and questions sorted together within bands of the text's length, or
is the first line of a later band. Which lines do begin chunks follows by doubling: of the lines reached from the first,
and of every line's jump over 1, 2, 4 … chunks. Rounds grow with the logarithm of a text's chunks, each a join by line.

A null text is an empty line; line_no are distinct whole numbers in a text, in order; a null doc_id is a text of its own;
other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cloakwork.config import DEFAULT
from cloakwork.operators.prefix import BUCKET, before
from cloakwork.sources.kept import kept


def _jumps(placed: DataFrame, budget: int) -> DataFrame:
    """doc, i, next: the line that begins the chunk after one that begins at line i; lines with no later chunk are left out."""
    lines = placed.select("doc", F.col("i").alias("line"), F.lit(None).cast("long").alias("asks"), (F.col("p") + F.col("n")).alias("key"))
    asks = placed.select("doc", F.lit(None).cast("long").alias("line"), F.col("i").alias("asks"), (F.col("p") + budget).alias("key"))
    both = lines.unionByName(asks).withColumn("band", F.floor(F.col("key") / budget))
    down = Window.partitionBy("doc", "band").orderBy(F.desc("key"), F.col("asks").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("beyond", F.min("line").over(down)).where("asks IS NOT NULL")
    later = Window.partitionBy("doc").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = both.groupBy("doc", "band").agg(F.min("line").alias("first")).select(F.col("doc").alias("b_doc"), F.col("band").alias("b_band"), F.min("first").over(later).alias("later"))
    met = inside.join(bands, F.col("doc").eqNullSafe(F.col("b_doc")) & (F.col("band") == F.col("b_band")))
    found = F.coalesce("beyond", "later")
    return met.where(found.isNotNull()).select("doc", F.col("asks").alias("i"), F.greatest(found, F.col("asks") + 1).alias("next"))


def _begins(jumps: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, i of the lines that begin chunks: all that jumps lead to from each text's first line."""
    over = lambda left, right: F.col(f"{left}_doc").eqNullSafe(F.col(f"{right}_doc"))
    reached = docs.select("doc", F.lit(0).cast("long").alias("i"))
    while True:
        a = reached.select(F.col("doc").alias("a_doc"), F.col("i").alias("a_i"))
        b = jumps.select(F.col("doc").alias("b_doc"), F.col("i").alias("b_i"), F.col("next").alias("b_next"))
        new = kept(a.join(b, over("a", "b") & (F.col("a_i") == F.col("b_i"))).select(F.col("a_doc").alias("doc"), F.col("b_next").alias("i")))
        if new.isEmpty():
            return reached
        reached = kept(reached.unionByName(new))
        c = jumps.select(F.col("doc").alias("c_doc"), F.col("i").alias("c_i"), F.col("next").alias("c_next"))
        jumps = kept(c.join(b, over("c", "b") & (F.col("c_next") == F.col("b_i"))).select(F.col("c_doc").alias("doc"), F.col("c_i").alias("i"), F.col("b_next").alias("next")))


def with_chunks(lines: DataFrame, budget: int = DEFAULT.chunk_chars, bucket: int = BUCKET) -> DataFrame:
    """lines(doc_id, line_no, text) → doc_id, line_no, n (its characters and line end) and chunk_no."""
    sized = lines.select(F.col("doc_id").alias("doc"), F.col("line_no").cast("long").alias("line_no"), (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("n"))
    placed = kept(before(sized, "doc", "line_no", {"p": F.col("n"), "i": F.lit(1).cast("long")}, None, bucket))
    begins = _begins(kept(_jumps(placed, budget)), placed.where("i = 0").select("doc"))
    marks = begins.select(F.col("doc").alias("m_doc"), F.col("i").alias("m_i"), F.lit(1).cast("long").alias("mark"))
    marked = placed.join(marks, F.col("doc").eqNullSafe(F.col("m_doc")) & (F.col("i") == F.col("m_i")), "left").withColumn("mark", F.coalesce("mark", F.lit(0).cast("long")))
    numbered = before(marked.select("doc", "line_no", "n", "i", "mark"), "doc", "i", {"earlier": F.col("mark")}, None, bucket)
    return numbered.select(F.col("doc").alias("doc_id"), "line_no", "n", (F.col("earlier") + F.col("mark") - 1).alias("chunk_no"))


def line_chunks(lines: DataFrame, budget: int = DEFAULT.chunk_chars) -> DataFrame:
    """doc_id, chunk_no, first_line, n_lines and n_chars of every chunk."""
    found = with_chunks(lines, budget).groupBy("doc_id", "chunk_no")
    return found.agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), (F.sum("n") - 1).alias("n_chars"))
