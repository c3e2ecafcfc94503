"""What the operators of this folder share: table access and tables kept between jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..operators.kept import delete, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The shelves opened inside the innermost ``owned`` of this thread or task, if there is one.
SCOPE: ContextVar[list[Shelf] | None] = ContextVar("shelves", default=None)


@contextmanager
def owned() -> Iterator[list[Shelf]]:
    """A list of the shelves that are opened inside, by this thread alone: what runs them may delete them once their results are no longer read."""
    mine: list[Shelf] = []
    token = SCOPE.set(mine)
    try:
        yield mine
    finally:
        SCOPE.reset(token)


class Shelf:
    """Tables written into the shared folder: they cut the lineage and outlive lost executors.

    What an operator returns may read its shelf, so the shelf stays until its owner deletes it (see ``owned``).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if (mine := SCOPE.get()) is not None:
            mine.append(self)

    def delete(self) -> None:
        delete(self.spark, self.path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return what reads it back."""
        df.write.option("compression", "zstd").mode("error").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop_all_but(self, name: str) -> None:
        """Delete the other tables of this shelf, once ``name`` no longer needs them."""
        here = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        for x in here.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(here):
            if x.getPath().getName() != name:
                self.drop(x.getPath().getName())

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")
