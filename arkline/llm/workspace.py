"""Tables that cut lineage, kept in the folder the cluster shares.

The folder is the session's ``spark.checkpoint.dir``; only a local session that names none
(a test) gets one of its own, under the warehouse, elsewhere that is an error. Nothing is ever
written to a machine-local temporary folder, so a lost executor loses no table.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


#: While a table is written: its plan's shuffle files go when it is done, and Arrow batches are
#: small, so that what Python holds of them is too.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Workspace:
    """A folder of written tables; ``release`` deletes it, at the latest when Python ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/arkline-{label}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self.release)

    def subdir(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it again; later plans start from the files."""
        self._count += 1
        target = f"{self.path}/t{self._count}"
        with _writing(self.spark):
            df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in tables:
            for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is then the cluster's to clean
            pass
        atexit.unregister(self.release)
