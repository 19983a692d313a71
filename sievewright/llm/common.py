"""What the operators share: reading inputs, cutting lineage in the shared folder, bounded broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many narrow rows; else both sides shuffle.
BROADCAST_ROWS = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session may do without the setting."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def free(names: list[str], *wanted: str) -> list[str]:
    """``wanted``, with underscores added until they are none of ``names`` in any case."""
    held, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in held:
            w += "_"
        held.add(w.lower())
        out.append(w)
    return out


#: Texts handed to Python at a time. A batch is held several times over (JVM, socket, worker), so it bounds memory.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """No Arrow batch of this session has more than BATCH_ROWS rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


_left: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone; its folder is then the cluster's to clean
            return


class Scratch:
    """Tables written to the shared folder, so that a lost executor never costs more than one stage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        small_batches(spark)
        _left.append((spark, self.root))

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and read it back: the result has no lineage."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)


def without(docs: DataFrame, out: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """``docs`` less the rows whose id and ``mark`` (a hash of what the verdict rests on) are in ``out(id, mark)``, a written table.

    Names in ``docs`` may be any; nulls match nulls. Where ``out`` is large both sides shuffle by a hash of the row.
    """
    i, m = free(docs.columns, "id", "mark")
    out = out.select(F.col("id").alias(i), F.col("mark").alias(m))
    return docs.join(small(out), docs[id_col].eqNullSafe(out[i]) & mark.eqNullSafe(out[m]), "left_anti")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small; ``df`` as it is (a shuffled join) if not.

    Call it on written tables only: the count then reads file footers.
    """
    return F.broadcast(df) if df.count() <= rows else df
