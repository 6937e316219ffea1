"""Shared pieces of the training-data operators: scratch tables, checked broadcasts, distributed cuts."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: What separates words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only when a count shows it has at most this many keys: 16 MB in each executor.
BROADCAST_IDS = 200_000

_dirs: dict[str, str] = {}
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_scopes: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver ends.

    Only a local session may leave that setting out; it then gets a temporary folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _dirs:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{named.rstrip('/')}/cloakwork-{app}" if named else tempfile.mkdtemp(prefix="cloakwork-")
        files, place = _file_system(spark, root)
        files.mkdirs(place)
        files.deleteOnExit(place)
        _dirs[app] = root
    return _dirs[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def materialize(df: DataFrame, label: str) -> DataFrame:
    """written(), for a table that an operator makes for itself: it goes with the scratch() around it, if there is one."""
    out = written(df, label)
    if _scopes:
        _scopes[-1].append(_written[out])
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a table of written() or materialize() that nothing reads any more."""
    if path := _written.pop(table, None):
        files, place = _file_system(table.sparkSession, path)
        files.delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What materialize() writes inside goes at the end: for work whose result is written somewhere else by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            files, place = _file_system(spark, path)
            files.delete(place, True)


def free_name(*tables: DataFrame, wanted: str = "_extra") -> str:
    """A column name that none of the tables has, in any case."""
    taken, k = {c.lower() for t in tables for c in t.columns}, 0
    while (name := f"{wanted}{k}") in taken:
        k += 1
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def columns_of(table: DataFrame) -> list[Column]:
    """All columns of a table, whatever signs their names have."""
    return [F.col(quoted(c)) for c in table.columns]


def with_ids(docs: DataFrame, ids: DataFrame, keys: list[str], how: str) -> DataFrame:
    """left_semi or left_anti join of docs with ids on null-safe keys; ids are broadcast only when counted small."""
    names = [free_name(docs, wanted=f"_id{i}_") for i in range(len(keys))]
    ids = ids.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)])
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(quoted(k)).eqNullSafe(F.col(n))
    return docs.join(F.broadcast(ids) if small else ids, same, how)


def words_of(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def utf8_length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of integers as SQL VALUES: a local relation, no Python at run time."""
    fields = T._parse_datatype_string(schema)
    names = ", ".join(f"`{f.name}`" for f in fields)
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in fields) + " WHERE false")
    lit = lambda v, f: "NULL" if v is None else f"CAST('{v}' AS {f.dataType.simpleString()})"
    body = ", ".join("(" + ", ".join(lit(v, f) for v, f in zip(row, fields)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


@dataclass
class _Search:
    """Where the search for one group's cut stands: values fixed so far, the open interval and the weight before it."""

    target: float
    fixed: list[int]
    low: int | None
    high: int | None
    before: float = 0.0
    rows: int = -1


def weighted_cuts(rows: DataFrame, group: str, keys: list[str], weight: str, targets: dict[int, float], ranges: dict[int, tuple[int, int, int]] | None = None, bins: int = 1024, in_one_task: int = 50_000) -> dict[int, tuple | None]:
    """For each group, the last row of the prefix, in the order of keys, whose weight comes nearest to its target.

    rows has a long group column, long key columns without nulls and a long weight; it should be a written table, as it
    is read a few times. Every pass adds up the weights in `bins` equal intervals of the undecided key range, with
    map-side aggregation, and goes on in the interval in which the target lies; once that holds at most `in_one_task`
    rows, a running sum over just those rows ends the search. The driver holds one small record for each group.
    ranges, where known, has each group's least and greatest first key and its rows; groups without rows are left out.
    A result of None stands for the empty prefix. Rows equal in all keys stay together.
    """
    spark = rows.sparkSession
    last = {}
    if not targets:
        return last
    state: dict[int, _Search] = {}
    if ranges is None:
        members = rows.join(F.broadcast(values(spark, [(g,) for g in targets], "g long")), F.col(group) == F.col("g"), "left_semi")
        bounds = members.groupBy(group).agg(F.min(keys[0]).alias("lo"), F.max(keys[0]).alias("hi"), F.count("*").alias("n"))
        ranges = {r[0]: tuple(r)[1:] for r in bounds.collect()}
    for g, (low, high, n) in ranges.items():
        state[g] = _Search(float(targets[g]), [], low, high, rows=n)
    last = {g: None for g in targets}

    def inside(active: dict[int, _Search]) -> DataFrame:
        fixed = [f"f{i} long" for i in range(len(keys) - 1)]
        table = [(g, len(s.fixed), s.low, s.high, repr(s.before), repr(s.target), *(s.fixed + [0] * len(keys))[: len(keys) - 1]) for g, s in active.items()]
        where = values(spark, table, ", ".join(["g long", "depth int", "lo long", "hi long", "before double", "target double", *fixed]))
        joined = rows.join(F.broadcast(where), F.col(group) == F.col("g"))
        ok = F.lit(False)
        for d in range(len(keys)):
            at = (F.col("depth") == d) & F.col(keys[d]).between(F.col("lo"), F.col("hi"))
            for i in range(d):
                at = at & (F.col(keys[i]) == F.col(f"f{i}"))
            ok = ok | at
        return joined.where(ok)

    while state:
        wide = {g: s for g, s in state.items() if s.rows > in_one_task}
        narrow = {g: s for g, s in state.items() if g not in wide}
        state = {}
        if wide:
            df = inside(wide)
            key = F.coalesce(*[F.when(F.col("depth") == d, F.col(k)) for d, k in enumerate(keys)])
            span = (F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1).cast("double")
            bin_no = F.floor((key.cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")).cast("double") / span * bins)
            sums = df.groupBy("g", bin_no.alias("bin")).agg(
                F.sum(weight).alias("w"), F.count("*").alias("n"), F.max("before").alias("before"), F.max("target").alias("target"),
                *[f(k).alias(f"{f.__name__}{i}") for i, k in enumerate(keys) for f in (F.min, F.max)],
            )
            upto = F.sum("w").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
            left = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("bin")))
            hit = sums.withColumn("upto", F.col("before") + upto).withColumn("left", left).where((F.col("upto") >= F.col("target")) | (F.col("left") == 1))
            first = F.row_number().over(Window.partitionBy("g").orderBy("bin"))
            for r in hit.withColumn("k", first).where("k = 1").collect():
                s = wide[r["g"]]
                d = len(s.fixed)
                s.before, s.rows = float(r["upto"] - r["w"]), r["n"]
                if r[f"min{d}"] < r[f"max{d}"]:
                    s.low, s.high = r[f"min{d}"], r[f"max{d}"]
                elif d + 1 < len(keys):
                    s.fixed.append(r[f"min{d}"])
                    s.low, s.high = r[f"min{d + 1}"], r[f"max{d + 1}"]
                else:  # rows equal in all keys: take them or leave them
                    whole = abs(s.before + r["w"] - s.target) <= abs(s.before - s.target)
                    last[r["g"]] = (*s.fixed, r[f"min{d}"] - (not whole))
                    continue
                state[r["g"]] = s
        if narrow:
            w = Window.partitionBy("g").orderBy(*keys)
            near = (
                inside(narrow).groupBy("g", *keys).agg(F.sum(weight).alias("w"), F.max("before").alias("before"), F.max("target").alias("target"))
                .withColumn("upto", F.col("before") + F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("off", F.abs(F.col("upto") - F.col("target")))
            )
            # the prefix before the interval counts as a choice too: then the cut lies just below the first row here
            pick = near.groupBy("g").agg(F.min_by(F.struct(*keys, "off"), F.struct("off", *keys)).alias("best"), F.min(F.struct(*keys)).alias("least"), F.max(F.abs(F.col("before") - F.col("target"))).alias("off0"))
            for r in pick.collect():
                if r["off0"] < r["best"]["off"]:
                    below = list(r["least"])
                    last[r["g"]] = (*below[:-1], below[-1] - 1)
                else:
                    last[r["g"]] = tuple(r["best"])[:-1]
    return last


def up_to(keys: list[str], cut: tuple | None) -> Column:
    """Whether a row's keys are at or before a cut of weighted_cuts."""
    if cut is None:
        return F.lit(False)
    *head, end = keys
    out = F.col(end) <= F.lit(cut[-1])
    for k, v in reversed(list(zip(head, cut))):
        out = (F.col(k) < F.lit(v)) | ((F.col(k) == F.lit(v)) & out)
    return out
