"""Files that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a few numbers each that may be broadcast, or settled in one task: some megabytes
FEW = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that spark.checkpoint.dir names.

    A folder of our own is made only where the session names none and all runs on one machine, as in tests.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith(("local[", "local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


@dataclass
class Table:
    """A written table and its number of rows."""

    df: DataFrame
    rows: int
    path: str

    @property
    def hinted(self) -> DataFrame:
        """For one side of a join: broadcast if the rows are few."""
        return F.broadcast(self.df) if self.rows <= FEW else self.df


@dataclass
class Scratch:
    """Tables of one run in the shared folder, which cut the lineage: each is read back from its files.

    A file knows its size, so later joins are planned for it; a lost executor costs no table; and a
    superseded table's files can be deleted, which drop does.
    """

    spark: SparkSession
    folder: str = ""
    written: int = field(default=0)

    def __post_init__(self) -> None:
        self.folder = f"{shared_folder(self.spark)}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> Table:
        path = f"{self.folder}/{self.written}"
        self.written += 1
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        return Table(back, back.count(), path)

    def drop(self, *tables: Table | None) -> None:
        for t in tables:
            if t is not None:
                remove(self.spark, t.path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, whatever store that is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
