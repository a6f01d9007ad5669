"""Helpers that several operators share: table access, stable intermediate results, word rules."""

from __future__ import annotations

import atexit
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One is made only on a single machine (tests); on a
    cluster a folder of the driver would be seen by nobody else."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lakeloom-"))
    return context.getCheckpointDir().get()


#: Folders of intermediate tables that have not been deleted, oldest first.
_made: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: the lineage is cut, the
    rows are compressed and columnar, and a lost executor loses nothing. The folder stays until it is
    discarded, or the process ends."""
    return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lakeloom-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_discard_all)
    _made[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _discard(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _discard_all() -> None:
    for path in list(_made):
        try:
            _discard(path)
        except Exception:  # the session has ended already: its folders go with the shared folder
            return


class Scratch:
    """Intermediate tables that are deleted as soon as a later one has taken their place."""

    def __init__(self):
        self.held: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.held.append(_stored(df))
        return self.held[-1][0]

    def alone(self, build: Callable[[], DataFrame]) -> DataFrame:
        """Keeps what ``build`` returns and deletes the tables that were stored on the way to it."""
        before = set(_made)
        result = self.keep(build())
        for path in [p for p in _made if p not in before and p != self.held[-1][1]]:
            _discard(path)
        return result

    def drop(self, *frames: DataFrame) -> None:
        for frame, path in list(self.held):
            if any(frame is f for f in frames):
                self.held.remove((frame, path))
                _discard(path)

    def clear(self) -> None:
        self.drop(*[frame for frame, _ in self.held])


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after making sure that Python workers can import this package: it goes to them as a
    file of the job, so it does not matter where executors run or what their paths are."""
    context = df.sparkSession.sparkContext
    if not getattr(context, "_lakeloom_shipped", False):
        here = pathlib.Path(__file__).parent
        packed = pathlib.Path(tempfile.mkdtemp(prefix="lakeloom-")) / "lakeloom.zip"
        with zipfile.ZipFile(packed, "w") as out:
            for source in [here.parent / "__init__.py", *sorted(here.glob("*.py"))]:
                out.write(source, str(pathlib.Path("lakeloom") / source.relative_to(here.parent)))
        context.addPyFile(str(packed))
        context._lakeloom_shipped = True
    return df


#: Stands for a missing integer id on the way through pandas, which would make such ids floats.
NO_ID = -(1 << 63)


def masked(df: DataFrame, key: str) -> DataFrame:
    """Integer ids without nulls, for Python workers."""
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return df.withColumn(key, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)))
    return df


def unmasked(df: DataFrame, key: str, kind: T.DataType) -> DataFrame:
    if isinstance(kind, T.IntegralType):
        return df.withColumn(key, F.nullif(F.col(key), F.lit(NO_ID)).cast(kind))
    return df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: projections that Catalyst merges would
    otherwise repeat it for each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text: maximal runs of anything but ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def shingle_hashes(words: Column, size: int) -> Column:
    """XXH64 of each run of ``size`` words, by position; none if the text has fewer words."""
    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - size
        return F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)
