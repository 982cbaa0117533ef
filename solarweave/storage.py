"""Tables, and intermediate results that survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a session on one machine gets a temporary folder (tests); any other
    raises, as executors that write to their own disks would lose rows.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="solarweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/solarweave/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored; call it only when no result that is still wanted reads from there."""
    _delete(spark, _own_dir(spark))


class Stored:
    """A result written once as Parquet in the shared folder: it cuts lineage and is read many times."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{_own_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self._schema()).parquet(self.path)

    def _schema(self):
        if not hasattr(self, "_read"):
            self._read = self.spark.read.parquet(self.path).schema
        return self._read

    def drop(self) -> None:
        """Delete the files; call it only when nothing lazy still reads them."""
        _delete(self.spark, self.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    return Stored(df, name).df


def joined_back(df: DataFrame, summary: DataFrame, on, how: str = "inner") -> DataFrame:
    """df joined with a summary that has one row for each key, so that a hot key of df is no hot task.

    An aggregate's rows lie by key already, so a join right after it gets no shuffle of its own
    on that side, and adaptive execution splits only joins whose sides both have one. The
    summary is therefore written first: then a small one is broadcast, and beside a large one
    the rows of a hot key are dealt to several tasks, each with its copy of the one row.
    """
    return df.join(stored(summary, "summary"), on, how)
