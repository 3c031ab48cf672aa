"""Shared helpers of the training-data operators.

Every operator takes a DataFrame and the names of the columns it works on.  The other columns are
carried along untouched, whatever their names: inside an operator all input columns go by position
(`Carried`), so a column that has the name of an output, or differs from another only in case, does
no harm.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import reachable

#: The six ASCII white-space characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Carried:
    """A DataFrame whose columns go by position: `col(name)` is an input column, `restore` the output."""

    def __init__(self, df: DataFrame):
        reachable(df.sparkSession)
        self.names = df.columns
        self.df = df.toDF(*[f"__c{i}" for i in range(len(self.names))])

    def key(self, name: str) -> str:
        if name not in self.names:
            raise ValueError(f"no column {name!r}; there are {', '.join(self.names)}")
        return f"__c{self.names.index(name)}"

    def col(self, name: str) -> Column:
        return F.col(self.key(name))

    def restore(self, df: DataFrame, **new: Column | str) -> DataFrame:
        """The input columns, those named in `new` replaced in place, the others of `new` behind them."""
        new = {k: F.col(v) if isinstance(v, str) else v for k, v in new.items()}
        kept = [(new.pop(n) if n in new else F.col(f"__c{i}")).alias(n) for i, n in enumerate(self.names)]
        return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, even where `body` has it in a lambda that runs for each element.

    A column of its own would not do: the optimizer puts its expression back into the lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shared(spark: SparkSession) -> str:
    """The folder for intermediate results, which the cluster names in `spark.checkpoint.dir`.

    Where none is named, as in tests, and all tasks run in the driver's process, a temporary one is set, which goes when the
    process ends.  On a cluster that names none this raises: a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            named = tempfile.mkdtemp(prefix="tallyspark-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Rows, of a few numbers each, that one task of a shuffle gets in `sized`.
ROWS_EACH = 200_000


@contextmanager
def sized(spark: SparkSession, rows: int, least: int = 4):
    """Inside, shuffles have as many partitions as `rows` short rows need: for loops over a table whose size is known."""
    with setting(spark, "spark.sql.shuffle.partitions", max(least, -(-rows // ROWS_EACH))):
        yield


@contextmanager
def setting(spark: SparkSession, name: str, value: int | str):
    """Inside, a setting of the session has another value."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark)}/{kind}-{uuid.uuid4().hex}"


#: With this setting the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder, its lineage cut; a lost executor takes nothing of it along.

    Unlike a checkpoint, a table has the size that it has.  A checkpoint keeps the estimate of its plan, a product over all
    joins before it, which in a loop of joins grows until the driver does nothing but multiply.
    """
    path = scratch(df.sparkSession, "table")
    if _made:
        _made[-1].append(path)
    with setting(df.sparkSession, CLEANUP, "true"):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: The tables that each running `settled` has made so far.
_made: list[list[str]] = []


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns as a table in the shared folder; the tables that `stored` wrote on the way to it are deleted."""
    _made.append([])
    try:
        out = stored(make())
    finally:
        made = _made.pop()
    if _made:
        _made[-1].append(out.stored_at)
    for path in made:
        if path != out.stored_at:
            _delete(out.sparkSession, path)
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table of `stored` that no later step reads."""
    _delete(df.sparkSession, df.stored_at)


def removed(spark: SparkSession) -> None:
    """Deletes all intermediate results of this session.  To be called when its results are written."""
    _delete(spark, _shared(spark))


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
