"""What the operators of this subpackage share: table reading, tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the session is local, as in a test, a
    temporary folder of this machine stands in for it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="trendspan-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


#: Ids that are broadcast at most; 8 bytes each.
BROADCAST_IDS = 500_000


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is not among the distinct, stored ``ids``; rows without a key stay.

    Few ids are broadcast, so that the texts stay where they are; more are joined by a shuffle.
    """
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, so that the join is a sort-merge join.

    Spark sizes a plan by the files it reads and the width of its columns, an exploded constant array as if it had one
    element. What it sizes too low it would broadcast, whole through the driver, and adaptive execution doesn't take that back.
    """
    return df.hint("merge")


#: A key with more than this part of all rows is hot.
HOT_SHARE = 256


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with a row for each key, which has the number of the key's rows in ``c``.

    Of ``total`` rows no more than ``HOT_SHARE`` keys can have more than that part each. These few are broadcast, so that
    no task gets all rows of a hot key; all other keys are joined by a shuffle.
    """
    hot = F.broadcast(keyed.where(F.col("c") > total // HOT_SHARE))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(keyed.where(F.col("c") <= total // HOT_SHARE), keys))


class Scratch:
    """Parquet tables in the shared folder, which cut lineage and survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._live: set[str] = set()
        self._dropped = 0
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        """A new place for a table, which goes when the session ends."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        self._live.add(path)
        return path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def release(self) -> None:
        """Let Spark's cleaner drop the shuffle files and broadcast tables of plans that nothing refers to any more.

        The cleaner acts on what the driver's collector finds, and a driver that does little hardly ever collects, while
        executors hold the hash tables of every small join until then. Loops of many steps would fill their memory.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more; every few times what their plans left goes too."""
        for t in tables:
            self._delete(t._scratch_path)
        self._dropped += 1
        if self._dropped % 3 == 0:
            self.release()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self._live.discard(path)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is None:  # the session has ended
            return
        for path in list(self._live):
            self._delete(path)
