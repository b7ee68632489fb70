"""A ledger of runs and the tables they keep: a batch that is replayed changes nothing, a source that comes again replaces what hangs on it.

A run has one partition of the ledger, written anew at its start and its end. A batch of a stream has one partition of its
target, named by run and batch number, so writing it twice is writing it once. Tables by key are dealt into buckets; a
batch rewrites the buckets of its keys, and Spark replaces those partitions together when the job commits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.session import kept

LEDGER = "name string, started string, finished string, status string, notes string, error string, run string"


def _replace(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Ledger:
    """Runs in the table ``path``: name, start, finish, status (running, done or error), notes and error."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], str] = lambda: datetime.now(UTC).isoformat(timespec="seconds")):
        self.spark, self.path, self.clock = spark, path, clock

    def _write(self, run: str, *values: str | None) -> None:
        _replace(self.spark.createDataFrame([(*values, run)], LEDGER), self.path, ["run"])

    @contextmanager
    def run(self, run: str, name: str, notes: str = "") -> Iterator[str]:
        """Note down a run: that it started, and whether it was done or what went wrong, which is raised again. A run of the same id takes the old one's place."""
        started = self.clock()
        self._write(run, name, started, None, "running", notes, None)
        try:
            yield run
        except Exception as e:
            self._write(run, name, started, self.clock(), "error", notes, f"{type(e).__name__}: {e}")
            raise
        self._write(run, name, started, self.clock(), "done", notes, None)

    def runs(self) -> DataFrame:
        found = _read(self.spark, self.path, LEDGER)
        return self.spark.createDataFrame([], LEDGER) if found is None else found


def write_batch(df: DataFrame, path: str, run: str, batch: int) -> None:
    """Write ``df`` as the rows of one batch; whatever the batch had written before goes."""
    _replace(df.withColumns({"run": F.lit(run), "batch": F.lit(batch).cast("long")}), path, ["run", "batch"])


def replace_keys(df: DataFrame, path: str, key: str, buckets: int = 64, keys: DataFrame | None = None) -> None:
    """Make ``df`` the rows of its keys in the table ``path``; rows of other keys stay. ``keys`` names keys that may have no rows any more.

    Only the buckets of those keys are read and written, staged first, as Spark does not overwrite what it reads."""
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    new = kept(df.withColumn("bucket", bucket), "replacing")
    named = kept((df if keys is None else keys.select(key).union(df.select(key))).select(key).distinct().withColumn("bucket", bucket), "replaced-keys")
    touched = [r[0] for r in named.select("bucket").distinct().collect()]  # ``buckets`` at most
    old = _read(spark, path, new.schema)
    rest = new.limit(0) if old is None else old.filter(F.col("bucket").isin(touched)).join(named.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    whole = kept(rest.select(new.columns).unionByName(new), "rewritten")
    _replace(whole, path, ["bucket"])
    # A bucket whose last rows went has no partition of its own in what is written.
    emptied = set(touched) - {r[0] for r in whole.select("bucket").distinct().collect()}
    for b in emptied:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ingest(ledger: Ledger, run: str, name: str, source: str, schema: str, checkpoint: str, work: Callable[[DataFrame, int], None], fmt: str = "json", notes: str = "") -> None:
    """One run over all files not seen before: ``work`` gets each batch and its number, and must write with ``write_batch`` or ``replace_keys``.

    Structured Streaming gives every batch at least once, and those writers make of that exactly once."""
    with ledger.run(run, name, notes):
        stream = ledger.spark.readStream.format(fmt).schema(schema).load(source)
        stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
