"""A sample that is the same in every run and keeps what it held as data grow.

Records get persistent sequence numbers in the order of arrival, stored load by load: a record
keeps its number whatever comes later, late or tied or is deleted. Each fixed block
of numbers has its chosen positions, given by a keyed permutation of the block's positions
whose key is a hash of the block's number; whether the block is full yet makes no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sequence import global_sequence

#: Positions in a block (32 x 32, for the two halves of the permutation) and rounds.
BLOCK, HALF, ROUNDS = 1024, 32, 6


def _hash(*parts: Column | str | int, digits: int = 8) -> Column:
    """The first hex digits of an MD5, as a number; engines agree on it."""
    text = F.concat_ws("|", *[(F.lit(p) if isinstance(p, (int, str)) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _units(df: DataFrame, unit: Column, loaded_at: str) -> DataFrame:
    """Each unit with its first arrival ``at``; null, the earliest, if one of its rows has none."""
    rows = df.select(unit.cast("string").alias("unit"), F.col(loaded_at).alias("at")).where("unit <> ''")
    return rows.groupBy("unit").agg(F.when(F.count("at") == F.count("*"), F.min("at")).alias("at"))


def _sequence(units: DataFrame, start: int = 0) -> DataFrame:
    """``unit``, ``seq`` from ``start`` on: by arrival, then by a hash, then by name."""
    numbered = global_sequence(units.withColumn("h", F.md5("unit")), ["at", "h", "unit"])
    return numbered.select("unit", (F.col("seq") + F.lit(start)).alias("seq"))


def stored_numbers(spark: SparkSession, path: str) -> DataFrame | None:
    """``unit``, ``seq`` of all loads that were finished at ``path``; None before the first."""
    loads = [folder for folder, done in _loads(spark, path) if done]
    return spark.read.schema("unit string, seq long").parquet(*loads) if loads else None


def _loads(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    folders = sorted(str(f.getPath()) for f in files.listStatus(root) if f.getPath().getName().startswith("load-"))
    return [(f, files.exists(hadoop.Path(f, "_SUCCESS"))) for f in folders]


def extend_numbers(df: DataFrame, unit: Column, loaded_at: str, path: str) -> DataFrame:
    """The stored numbers at ``path`` after those of ``df``'s units that had none were added, from the largest on.

    Only new units are sorted. A load is a folder of its own that counts once it is finished, so one that failed is done
    again without a trace. One writer at a time.
    """
    spark = df.sparkSession
    known, units = stored_numbers(spark, path), _units(df, unit, loaded_at)
    new, start = units, 0
    if known is not None:
        new = units.join(known.select("unit"), "unit", "left_anti")
        last = known.agg(F.max("seq").alias("m")).first().m
        start = 0 if last is None else last + 1
    done = sum(d for _, d in _loads(spark, path))
    _sequence(new, start).write.mode("overwrite").parquet(f"{path}/load-{done:08d}")
    return stored_numbers(spark, path)


def stable_sample(df: DataFrame, unit: Column, loaded_at: str, rate: float, seed: int = 7, numbers: str | None = None) -> DataFrame:
    """``unit``, ``seq`` (its persistent number) of the sampled units.

    A unit is a record's id, or an entity whose records are sampled together; it arrives with its
    first record. ``rate`` is rounded to whole positions of a block. Rows whose unit is null or
    '' are never sampled; repeated rows count once.

    ``numbers`` is a folder in shared storage that keeps the numbers between runs: what was sampled stays, whatever
    rows come or go. Without it units are numbered from the start by arrival (those without a load time
    first), then by a hash, then by name: what was sampled stays while only rows loaded later are added.
    """
    per_block = min(BLOCK, max(0, round(rate * BLOCK)))
    if numbers:
        first = not any(d for _, d in _loads(df.sparkSession, numbers))
        numbered = extend_numbers(df, unit, loaded_at, numbers)
        if not first:
            here = df.select(unit.cast("string").alias("unit")).where("unit <> ''").distinct()
            numbered = numbered.join(here, "unit", "left_semi")
    else:
        numbered = _sequence(_units(df, unit, loaded_at))
    # The rounds refer to each other twice; a column of its own for each half keeps the expression small.
    state = numbered.withColumn("blk", F.floor(F.col("seq") / BLOCK).cast("long")).withColumn("a", F.floor(F.col("seq") % BLOCK / HALF).cast("long")).withColumn("b", F.col("seq") % HALF)
    for r in range(ROUNDS):
        state = state.select("unit", "seq", "blk", F.col("b").alias("a"), ((F.col("a") + _hash(seed, F.col("blk"), r, F.col("b"))) % HALF).alias("b"))
    return state.where(F.col("a") * HALF + F.col("b") < per_block).select("unit", "seq")
