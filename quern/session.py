"""Session settings and table access shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Adaptive execution re-plans joins and splits skewed partitions at run time; UTC keeps dates comparable with the SQL oracles.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(master).appName("quern")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory; Spark alone opens the path, so any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: where PYTHONPATH doesn't name it, Spark's own file server sends it to every executor."""
    root = Path(__file__).resolve().parents[1]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or any(f.endswith("quern_package.zip") for f in context._python_includes):
        return
    file = Path(tempfile.mkdtemp()) / "quern_package.zip"
    with zipfile.ZipFile(file, "w") as out:
        for p in root.glob("quern/**/*"):
            if p.suffix in (".py", ".npz"):
                out.write(p, p.relative_to(root))
    context.addPyFile(str(file))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir. Only where all run in this
    process, as in tests, a folder of this machine stands in."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
    return (found or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="quern-checkpoints-")


class Staging:
    """The frames that one run stages while it is open. release() deletes them and no frame of another run; a frame belongs to
    the innermost run that was open when it was staged.

        with scratch():
            query(spark, sf_dir).write.parquet(path)
    """

    def __init__(self) -> None:
        self.written: dict[str, SparkSession] = {}

    def __enter__(self) -> Staging:
        _runs.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _runs.remove(self)

    def release(self) -> None:
        while self.written:
            path, spark = self.written.popitem()
            try:
                _delete(spark, path)
            except Exception:  # the session has gone already
                return


#: Runs that are open, the innermost last. The first has what is staged in none: what a lazy frame reads lasts as long as the process.
_runs: list[Staging] = [Staging()]
atexit.register(_runs[0].release)


@contextmanager
def scratch() -> Iterator[Staging]:
    """A run whose frames are deleted at its end: all that is read of them is to be written or collected in it."""
    with Staging() as run:
        try:
            yield run
        finally:
            run.release()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: the lineage is cut and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _runs[-1].written[path] = spark
    spark.sparkContext._jvm.System.gc()  # the shuffle files of what is written now go when their plan is collected
    return spark.read.schema(df.schema).parquet(path)


def own(spark: SparkSession, path: str) -> None:
    """Let the innermost open run own a folder that is written by other means."""
    _runs[-1].written[path] = spark


def discard(df: DataFrame) -> None:
    """Delete what stage() wrote for a frame that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        for run in _runs:
            for path in [p for p in run.written if folder.endswith(p.rsplit("/", 1)[1])]:
                _delete(run.written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan that don't lie evenly enough for the session's cores, before costly work on each row. A file is split between its row groups only, so that most of a scan's
    partitions may be empty; rows of each are counted, for which no column is read. A scan whose largest partition has its share of rows at most twice is never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).head()
    return df.repartition(4 * cores) if (rows[0] or 0) * cores > 2 * (rows[1] or 0) else df


def small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast a frame whose counted rows are at most `most`; a larger one stays for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def sorted_groups(df: DataFrame, by: str, order: list[Column], run: Callable[[object, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """What run(key, rows) gives for the rows of each `by`, in order, without a frame for each group: groups are many and small, and a task meets them one after the other in
    batches. Rows are tuples of the other columns."""
    columns = [c for c in df.columns if c != by]
    kept = to_arrow_schema(StructType.fromDDL(schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), kept)], schema=kept)
            out.clear()
            return made

        for batch in batches:
            keys, values = batch.column(by).to_pylist(), zip(*[batch.column(c).to_pylist() for c in columns])
            for k, row in zip(keys, values):
                if rows and k != key:
                    out.extend(run(key, rows))
                    rows = []
                    if len(out) >= 10_000:
                        yield full()
                key = k
                rows.append(row)
        if rows:
            out.extend(run(key, rows))
        if out:
            yield full()

    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(walk, schema)
