"""Language identification by compression.

For each learned language there is a zstandard raw-content dictionary of sampled text; a text belongs to the language
whose dictionary compresses it to the fewest bytes; case, digits and punctuation are left out of both. Where the second-best
size is larger by no more than `narrow` of the best, a slower level with shorter matches decides, and in a tie the
language with more learned rows. Texts are compressed whole, in blocks of BLOCK bytes that each start afresh from the
dictionary, so that the margin doesn't fall with a text's length. A text of any length whose margin is still below
`narrow` is rejected; so are texts of a few letters that all dictionaries compress alike.

A null text, or one without a letter (Unicode category L), is `und`, score 0, rejected; so is any text where nothing
could be learned. Repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from cloakwork.llm.common import columns_of, free_name
from cloakwork.llm.memory import bound_batches, tidy

#: Learning takes whole texts of at most SAMPLE_TEXTS labelled rows of a language, in the order of a hash, as far as they
#: fit into LEARN_BYTES; of labelled texts that are all longer, the shortest. All languages together have LEARN_TOTAL.
SAMPLE_TEXTS, LEARN_BYTES, LEARN_TOTAL = 128, 1 << 18, 1 << 26
LEVEL, TIE_LEVEL = 3, 19
BLOCK = 65_536
SLICE_ROWS = 256
#: Compressors of so many languages are held at a time; where there are more, a batch meets them group by group.
GROUP = 64
#: Labelled rows of so many languages are learned from, those with the most rows.
MOST_LANGUAGES = 10_000
#: Share of the best size by which the second-best must be larger.
NARROW = 0.005
UNDETERMINED = "und"
_OTHER = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its doc_id as text leaves 2 when divided by 4."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % 4) == 2, F.lit(False))


def plain(text: str) -> bytes:
    """Lower-case letters, words parted by single spaces; nothing of a text without a letter."""
    body = _OTHER.sub(" ", text.lower()).strip()
    return body.encode() if any(map(str.isalpha, body)) else b""


def learn(docs: DataFrame) -> dict[str, bytes]:
    """The dictionary of each language, those with more rows first, from a bounded sample of rows that aren't held out.

    Rows are dealt to slots of each language by a hash; a slot takes its row of least hash among those that fit, or else
    its shortest. Only (language, slot) minima and counts are shuffled, one for each task and slot.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    many = rows.select("lang").distinct().limit(MOST_LANGUAGES).count()
    room = min(LEARN_BYTES, LEARN_TOTAL // max(1, many))
    slots_each = max(1, min(SAMPLE_TEXTS, room // 2_000))
    hashed = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"), F.octet_length("text").alias("size"))
    order = F.struct(F.when(F.col("size") > room, F.col("size")).otherwise(0).alias("over"), "h", "size")
    slots = hashed.groupBy("lang", F.pmod(F.col("h"), F.lit(slots_each)).alias("slot")).agg(F.min(order).alias("one"), F.count("*").alias("n"))
    langs = slots.groupBy("lang").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("one")).alias("ones")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    picked = []
    for r in langs:
        left = room
        for one in r["ones"]:
            if left == room or one["size"] <= left and not one["over"]:
                picked.append((r["lang"], one["h"]))
                left -= one["size"]
    if not langs:
        return {}
    wanted = docs.sparkSession.createDataFrame(picked, "lang string, h long")
    part = hashed.join(F.broadcast(wanted), ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.min("text").alias("text"))
    found: dict[str, list[bytes]] = {r["lang"]: [] for r in langs}
    for r in part.orderBy("lang", "h").toLocalIterator():
        found[r["lang"]].append(plain(r["text"]))
    return {g: b"\n".join(texts) for g, texts in found.items()}


def _coder(dictionary: bytes, level: int):
    prepared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    prepared.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=prepared, write_content_size=False, write_checksum=False, write_dict_id=False).compress


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], narrow: float = NARROW):
        self.langs, self.narrow = list(dictionaries), narrow
        self.groups = [list(dictionaries.values())[i : i + GROUP] for i in range(0, len(dictionaries), GROUP)]
        self.ready: dict[int, list] = {}

    def _coders(self, group: int, level: int) -> list:
        """Of one group, those of each level are kept; of several, those in use alone."""
        if len(self.groups) > 1:
            return [_coder(d, level) for d in self.groups[group]]
        if level not in self.ready:
            self.ready[level] = [_coder(d, level) for d in self.groups[group]]
        return self.ready[level]

    def _sizes(self, bodies: list[bytes], level: int) -> list[list[tuple[int, int]]]:
        """For each text, compressed size and number of each language, the smallest first."""
        sizes: list[list[tuple[int, int]]] = [[] for _ in bodies]
        for g in range(len(self.groups) if bodies else 0):
            coders = self._coders(g, level)
            for own, body in zip(sizes, bodies):
                blocks = [body[at : at + BLOCK] for at in range(0, len(body), BLOCK)]
                own += [(sum(len(code(b)) for b in blocks), g * GROUP + i) for i, code in enumerate(coders)]
        return [sorted(own) for own in sizes]

    @staticmethod
    def _margin(sizes: list[tuple[int, int]]) -> float:
        return (sizes[1][0] - sizes[0][0]) / sizes[0][0] if len(sizes) > 1 else 1.0

    def classify(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """Of each text: language, score in 0 to 1, relative margin and whether it is rejected."""
        bodies = [plain(t or "") if self.langs else b"" for t in texts]
        some = [i for i, body in enumerate(bodies) if body]
        sizes = dict(zip(some, self._sizes([bodies[i] for i in some], LEVEL)))
        close = [i for i in some if self._margin(sizes[i]) <= self.narrow]
        sizes |= dict(zip(close, self._sizes([bodies[i] for i in close], TIE_LEVEL)))
        out = [(UNDETERMINED, 0.0, 0.0, True)] * len(texts)
        for i, own in sizes.items():
            best, margin = own[0][0], self._margin(own)
            score = 1 / sum(math.exp(-min(50.0, (s - best) / 4)) for s, _ in own)
            out[i] = (self.langs[own[0][1]], score, margin, margin < self.narrow)
        return out


def classifier_udf(spark: SparkSession, dictionaries: dict[str, bytes], narrow: float = NARROW):
    """text → struct(lang_pred, score, margin, rejected); compressors are made once for each task."""
    bound_batches(spark)

    def classify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = Classifier(dictionaries, narrow)
        for texts in batches:
            found = [f for at in range(0, len(texts), SLICE_ROWS) for f in c.classify(texts.slice(at, SLICE_ROWS).to_pylist())]
            yield pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), (pa.string(), pa.float64(), pa.float64(), pa.bool_()))], names=["lang_pred", "score", "margin", "rejected"])

    @arrow_udf("lang_pred string, score double, margin double, rejected boolean")
    def task(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return tidy(classify)(batches)

    return task


def identify(docs: DataFrame, narrow: float = NARROW) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin and rejected for every row."""
    found = classifier_udf(docs.sparkSession, learn(docs), narrow)(F.col("text"))
    return docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.*")


def accepted(docs: DataFrame, narrow: float = NARROW) -> DataFrame:
    """The rows whose language is found by no narrow margin, with their columns."""
    found = classifier_udf(docs.sparkSession, learn(docs), narrow)(F.col("text"))
    at = free_name(docs)
    return docs.withColumn(at, found).where(~F.col(at)["rejected"]).select(*columns_of(docs))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
