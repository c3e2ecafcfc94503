"""Tables kept between jobs in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Temporary folders by application, where Spark runs on this machine alone and names none.
FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a temporary folder, if all of Spark runs on this machine; else an error,
    as executors would write to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get().rstrip("/")
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        app = spark.sparkContext.applicationId
        if app not in FOLDERS:
            FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        found = FOLDERS[app]
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete what ``keep`` wrote for these; nothing may read them any more. Other DataFrames are left alone."""
    for t in tables:
        if t is not None and (path := t.__dict__.pop("kept_at", None)):
            delete(t.sparkSession, path)


def keep_counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """``keep``, and how many rows there are (for which ``what`` holds), counted while they are written."""
    seen = Observation()
    value = F.count(F.lit(1)) if what is None else F.count_if(F.coalesce(what, F.lit(False)))
    out = keep(df.observe(seen, value.alias("n")))
    return out, seen.get["n"]


def kept_as(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which only selects from the kept ``table``, in its place: forgetting it deletes the table."""
    df.kept_at = table.__dict__.pop("kept_at", None)
    return df


class Latest:
    """The latest row of each key, over a table and tables of changes, which are merged once they are about as large as what is below them:
    a row is written again a logarithmic number of times, however many rounds there are."""

    def __init__(self, keys: list[str], base: DataFrame, n: int):
        self.keys, self.tables = keys, [(base, n)]
        self.base, self.spent = base, []

    def add(self, changes: DataFrame, n: int) -> None:
        """Keep ``changes`` (of the base's columns, a row a key). They belong to this object, and can be read until the next ones are added."""
        forget(*self.spent)
        self.spent = []
        self.tables.append((changes, n))
        while len(self.tables) > 1 and self.tables[-2][1] <= 2 * self.tables[-1][1]:
            self.merge()

    def merge(self) -> None:
        newer, older = self.tables.pop(), self.tables.pop()
        merged = keep(older[0].join(newer[0], self.keys, "left_anti").unionByName(newer[0].select(older[0].columns)))
        self.spent += [t for t in (older[0], newer[0]) if t is not self.base]
        self.tables.append((merged, older[1] + newer[1]))

    def of(self, wanted: DataFrame | None = None) -> DataFrame:
        """The latest rows, of the keys in ``wanted`` only."""
        names = self.tables[0][0].columns
        rest = [c for c in names if c not in self.keys]
        out = None
        for age, (t, _) in enumerate(self.tables):
            t = t.select(*self.keys, F.struct(F.lit(age).alias("age"), *rest).alias("row"))
            out = t if out is None else out.unionByName(t)
        #: One join over all tables: Spark 4.1 takes a union of joins for partitioned like them, and can't plan joins above it once it merges partitions.
        if wanted is not None:
            out = out.join(wanted, self.keys, "left_semi")
        if len(self.tables) > 1:
            out = out.groupBy(*self.keys).agg(F.max_by("row", "row.age").alias("row"))
        return out.select(*self.keys, *(F.col("row")[c].alias(c) for c in rest)).select(names)

    def close(self) -> DataFrame:
        """All latest rows as one kept table; nothing that was added may be read any more."""
        while len(self.tables) > 1:
            self.merge()
        forget(*self.spent)
        return self.tables[0][0]
