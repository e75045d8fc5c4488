"""Reading and writing tables."""

from __future__ import annotations

import fnmatch
import hashlib
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import fingerprint

#: Quotes are doubled and blanks at the ends of a value are kept.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def load_splits(spark: SparkSession, folder: str, names: list[str], columns: list[str] | None = None, pinned: str | None = None) -> DataFrame:
    """The named splits as one table with a ``split`` column; only the given columns are read. With ``pinned``, a revision() of
    these splits, other files than those it was made of are an error."""
    if pinned is not None and (found := revision(spark, folder, names)) != pinned:
        raise ValueError(f"revision {found} instead of {pinned}")
    out = None
    for name in names:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        df = (df.select(*columns) if columns else df).withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def revision(spark: SparkSession, folder: str, names: list[str]) -> str:
    """A digest of the splits' files: their names, sizes and contents."""
    parts = [file_hashes(spark, f"{folder}/{n}.parquet").select(F.lit(n).alias("n"), F.substring_index("path", "/", -1).alias("f"), "bytes", "sha256") for n in sorted(names)]
    rows = sorted(tuple(r) for p in parts for r in p.where("substring(f, 1, 1) not in ('.', '_')").collect())  # one row a file
    return hashlib.sha256(repr(rows).encode()).hexdigest()


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV file with a header. A list of names reads all columns as strings; without a schema, types are inferred by a pass over
    the file. ``multi_line`` allows quoted line breaks, at the price of one task a file. A web address is fetched to all workers first."""
    if isinstance(schema, list):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in schema])
    if path.split("://")[0] in ("http", "https", "ftp"):
        spark.sparkContext.addFile(path)
        path = "file://" + SparkFiles.get(path.rsplit("/", 1)[1])
    reader = spark.read.options(**_CSV, multiLine=multi_line)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def _at(spark: SparkSession, path: str):
    """Hadoop's path and file system, so shared storage works as local folders do."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with zstd. A table that is replaced stays until the new one is written whole beside it; then they change
    places by renaming. If writing fails the old table is untouched, and so it is if it is read by ``df`` itself."""
    spark = df.sparkSession
    target, files = _at(spark, path)
    if mode != "overwrite" or not files.exists(target):
        df.write.mode(mode).option("compression", "zstd").parquet(path)
        return
    mark = uuid.uuid4().hex
    new, old = (_at(spark, f"{path.rstrip('/')}.{kind}-{mark}")[0] for kind in ("new", "old"))
    try:
        df.write.mode("error").option("compression", "zstd").parquet(new.toString())
    except Exception:
        files.delete(new, True)
        raise
    if not files.rename(target, old) or not files.rename(new, target):
        if not files.exists(target):
            files.rename(old, target)
        raise OSError(f"{path} could not be replaced")
    files.delete(old, True)


def read_grid(spark: SparkSession, paths: dict[tuple, str], names: list[str]) -> DataFrame:
    """One table from a file for each cell of a grid, with the cell's keys as columns ``names``.

    A missing cell of the full grid and a path that is used twice are errors."""
    axes = [sorted({k[i] for k in paths}, key=str) for i in range(len(names))]
    expected = int(np.prod([len(a) for a in axes]))
    if len(paths) != expected or len(set(paths.values())) != len(paths):
        raise ValueError(f"{len(paths)} files for {expected} cells")
    out = None
    for key, path in sorted(paths.items(), key=str):
        df = spark.read.parquet(path).withColumns({n: F.lit(v) for n, v in zip(names, key)})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def find_file(spark: SparkSession, folder: str, *parts: str) -> str:
    """The only file below ``folder`` whose name has all ``parts``; none or several are an error."""
    found = [f for f in discover(spark, folder) if all(p.lower() in f.rsplit("/", 1)[-1].lower() for p in parts)]
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files with {parts} below {folder}")
    return found[0]


def discover(spark: SparkSession, folder: str, pattern: str = "*", exclude: Iterable[str] = ()) -> list[str]:
    """Files below ``folder``, on any storage, whose names fit ``pattern`` and whose paths have none of the excluded terms, sorted."""
    root, files = _at(spark, folder)
    listed, out = files.listFiles(root, True), []
    while listed.hasNext():
        path = listed.next().getPath()
        if fnmatch.fnmatch(path.getName(), pattern):
            out.append(path.toUri().getPath() if path.toUri().getScheme() in (None, "file") else path.toString())
    return sorted(f for f in out if not any(x.lower() in f.lower() for x in exclude))


def bridged(spark: SparkSession, path: str, moves: dict[str, str]) -> str:
    """``path``, or where it is now: if nothing is there, the first of ``moves`` (old prefix -> new) that leads to something.

    Stands for links at old places, which shared storage doesn't have; nowhere is an error."""
    for old, new in [("", ""), *moves.items()]:
        if path.startswith(old):
            there, files = _at(spark, new + path[len(old) :])
            if files.exists(there):
                return new + path[len(old) :]
    raise FileNotFoundError(path)


def read_npz_logits(spark: SparkSession, path: str, keys: tuple[str, ...] = ("logits", "scores", "arr_0"), classes: int | None = None) -> DataFrame:
    """``row_pos``, ``l0``, ``l1``, ...: an array of logits from an NPZ file, which fits one machine by its nature.

    The first of ``keys`` that the file has is taken; a vector x becomes the columns -x and x. Another
    number of columns than ``classes`` and values that aren't finite are errors."""
    with np.load(path) as z:
        key = next((k for k in keys if k in z.files), None)
        if key is None:
            raise KeyError(f"none of {keys} in {path}")
        a = np.asarray(z[key], dtype=np.float64)
    a = np.stack([-a, a], axis=1) if a.ndim == 1 else a
    if a.ndim != 2 or (classes and a.shape[1] != classes):
        raise ValueError(f"logits of shape {a.shape}")
    if not np.isfinite(a).all():
        raise ValueError("logits that aren't finite")
    frame = pd.DataFrame(a, columns=[f"l{i}" for i in range(a.shape[1])])
    frame.insert(0, "row_pos", np.arange(len(a), dtype=np.int64))
    return spark.createDataFrame(frame)


def parquet_schema(spark: SparkSession, path: str) -> DataFrame:
    """``name``, ``type`` of a Parquet table's columns, from its footers."""
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema], "name string, type string")


def file_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path``, ``bytes``, ``sha256`` of each file below a folder, or of one file. A file is read in pieces by one task, whatever its size."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            told = []
            for name in batch["path"]:
                at, place = fs.FileSystem.from_uri(name)
                h = hashlib.sha256()
                with at.open_input_stream(place) as stream:
                    while piece := stream.read(8 << 20):
                        h.update(piece)
                told.append(h.hexdigest())
            yield batch.assign(sha256=told)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    named = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("length").alias("bytes"))
    return named.mapInPandas(digest, "path string, bytes long, sha256 string")


def to_report(df: DataFrame, digits: int = 6) -> DataFrame:
    """``json``: each row as JSON with floats rounded and NaN or infinity as null."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.round(c, digits))
        cols.append(c.alias(name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def cached(df_maker, spark: SparkSession, path: str, rows: int | None = None, finite: Sequence[str] = ()) -> DataFrame:
    """The Parquet table at ``path`` if it was written whole, has ``rows`` rows, if given, and only finite values in the columns
    ``finite``; else ``df_maker()``, written there first. What is made is held to the same checks."""

    def fault(df: DataFrame) -> str | None:
        bad = [F.count_if(F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(True))) for c in finite]
        if rows is None and not bad:
            return None
        n, *b = df.agg(F.count("*"), *bad).first()
        return f"{n} rows, not finite: {dict(zip(finite, b))}" if (rows is not None and n != rows) or any(b) else None

    done, files = _at(spark, f"{path}/_SUCCESS")
    if files.exists(done) and fault(spark.read.parquet(path)) is None:
        return spark.read.parquet(path)
    write_parquet(df_maker(), path)
    made = spark.read.parquet(path)
    if (wrong := fault(made)) is not None:
        raise ValueError(wrong)
    return made


def content_key(df: DataFrame, columns: list[str], order: str, *parts: str) -> str:
    """A name for a table made from these rows: it changes with any value (see hashing.fingerprint) and with ``parts``, such as
    a model's name."""
    told = fingerprint(df, columns, order).first()
    return hashlib.sha256("\x1f".join([str(told.rows), told.fingerprint, *columns, *parts]).encode()).hexdigest()[:32]
