"""Tables written between the steps of an operator, and connected components over them.

Tables go to a fresh folder under the session's spark.checkpoint.dir, which all executors share, so a lost
executor costs only the tasks it ran. Where the setting is empty (local sessions), a folder of this machine
is made and set. A Scratch block deletes what it wrote when it ends, all of it after a failure, except the tables
that its result reads; those go when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="caselight-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Rows and bytes in an Arrow batch while a table is written; a batch ends at the first row that passes either.
ARROW_ROWS = 500
ARROW_BYTES = 16_000_000
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most ARROW_ROWS rows and about ARROW_BYTES bytes in the block; the session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in _ARROW}
    for k, v in _ARROW.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Written tables of one run of an operator; a context that deletes those that aren't kept."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/caselight-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        self.kept: set[int] = set()
        path, fs = self._path(self.base)
        fs.deleteOnExit(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, failed, *_) -> None:
        for i in [i for i in self.paths if failed or i not in self.kept]:
            self._delete(self.paths.pop(i))

    def write(self, df: DataFrame) -> DataFrame:
        """The table, written and read again, in small Arrow batches."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = self.n  # keeps the id from being used again while the table lives
        return out

    def _path(self, path: str):
        """The path and its file system."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                self._delete(path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes all tables but these, which outlive the block."""
        self.kept = {id(t) for t in tables}
        for i in [i for i in self.paths if i not in self.kept]:
            self._delete(self.paths.pop(i))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every end of an edge (a, b).

    Each round hooks every vertex to its smallest neighbour if that is smaller, follows the hooks to their roots
    by doubling, and goes on with the edges between different roots, until none is left. Hooks lead to smaller ids,
    so they end, and a root is the smallest id of its tree. Every edge's larger end hooks, so each round that leaves
    edges leaves fewer vertices; there is no cap on rounds. Joins are on vertices, with the minima combined before
    the shuffle; a hub's rows are split by the skew join.
    """
    # A vertex with several smaller neighbours keeps the smallest; the others are tied to that one, which many edges say alike.
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    few = low.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
    live = scratch.write(few)
    named = None
    while True:
        root = _roots(scratch, live)
        if named is None:
            named = root
        else:
            above = root.select(F.col("id").alias("u"), F.col("component").alias("up"))
            both = scratch.write(named.join(above, named.component == above.u, "left").select("id", F.coalesce("up", "component").alias("component")))
            scratch.drop(named)
            named = both
        ra, rb = (root.select(F.col("id").alias(x), F.col("component").alias(f"r{x}")) for x in "ab")
        apart = live.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        left = scratch.write(apart)
        scratch.drop(live, *([] if root is named else [root]))
        live = left
        if not live.limit(1).count():
            scratch.drop(live)
            return named


def _roots(scratch: Scratch, live: DataFrame) -> DataFrame:
    """id, component: the end of every vertex's way along smallest neighbours, of edges (a, b) with a > b."""
    ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "b"), F.struct(F.col("b").alias("id"), "b"))).alias("e"))
    label = scratch.write(ends.groupBy("e.id").agg(F.min("e.b").alias("component")))
    while True:
        up = label.select(F.col("id").alias("u"), F.col("component").alias("up"))
        jumped = scratch.write(label.join(up, label.component == up.u).select("id", F.col("component").alias("old"), F.col("up").alias("component")))
        changed = jumped.where("component <> old").limit(1).count()
        scratch.drop(label)
        label = jumped.select("id", "component")
        scratch.paths[id(label)] = scratch.paths.pop(id(jumped))
        if not changed:
            return label
