"""Intermediate tables in the folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one is set only where none is configured (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="sessionloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of an Arrow batch in sessions that run these operators: whole texts travel in them, and the batch bounds what they
#: take in a worker and in the executor beside it.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000


#: Written tables after which an operator tidies up the driver.
TIDY = 8
#: Characters of a plan's description, which the driver keeps for each of the last thousand steps.
PLAN_TEXT, PLAN_LENGTH = "spark.sql.maxPlanStringLength", 10_000
#: Stands for a null id where ids travel as plain integers; no document has it.
NO_ID = -(1 << 63)
#: Copies of a row that one array element stands for where repeated rows are written out again.
COPIES = 100_000
#: Folders of the workspaces made in each ``discarding`` block that is open.
_made: list[list[str]] = []


class Workspace:
    """A folder of its own below the shared root, for the tables one operator writes and reads again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        root = str(Path(__file__).resolve().parents[2])  # so that workers on this machine find the package; clusters install it
        paths = spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in paths.split(":"):
            spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, (paths, root)))
        for setting, most in ((BATCH, BATCH_ROWS), (PLAN_TEXT, PLAN_LENGTH)):
            if int(spark.conf.get(setting).rstrip("b")) > most:
                spark.conf.set(setting, str(most))
        self.saved = 0
        self.tidy()
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if _made:
            _made[-1].append(self.path)

    def tidy(self) -> None:
        """Lets the driver give back what finished steps left there: plans, listings, broadcast handles, generated classes."""
        self.spark._jvm.System.gc()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: cuts the lineage and survives lost executors."""
        path = f"{self.path}/{name}"
        self.saved += 1
        if self.saved % TIDY == 0:
            self.tidy()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.path}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving the folders of the workspaces made inside: what is returned from there has to be written by then."""
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.pop()
        for folder in made:
            _delete(spark, folder)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def semi_by_id(docs: DataFrame, ids: DataFrame, key: str, n_ids: int, bound: int = 500_000) -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids``: a broadcast for at most ``bound`` ids, else a shuffled join."""
    return docs.join(F.broadcast(ids) if n_ids <= bound else ids, key, "left_semi")


_routes: dict[int, list[int]] = {}


def routes(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions an int that ``repartition(n, column)`` sends there: buckets dealt out evenly, one each."""
    if n not in _routes:
        found = spark.range(40 * n).select(F.col("id").cast("int").alias("k")).groupBy(F.expr(f"pmod(hash(k), {n})").alias("p")).agg(F.min("k").alias("k")).collect()
        keys = {r.p: r.k for r in found}
        _routes[n] = [keys.get(p, p) for p in range(n)]
    return _routes[n]


def numbered(rows: DataFrame, order: list[str], work: Workspace, name: str, within: str | None = None) -> DataFrame:
    """Adds ``number``, from 0 in the order given (in each value of ``within``), by ranges: no task sees more than its range."""
    group = [within] if within else []
    parts = work.save(rows.repartitionByRange(shuffle_width(work.spark), *group, *order).withColumn("_part", F.spark_partition_id()), name)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*(F.col(g).alias("_group") for g in group), F.col("_part").alias("_of"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    on = F.col("_part") == F.col("_of")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col("_group"))
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    out = parts.withColumn("_own", own).join(F.broadcast(offsets) if not within else offsets, on)
    return out.withColumn("number", (F.col("_offset") + F.col("_own") - 1).cast("long")).drop("_part", "_of", "_group", "_own", "_offset")


def by_document(documents: DataFrame, id_col: str, text_col: str, work: Workspace, apply: Callable[[DataFrame], DataFrame], refer: tuple[str, ...] = ()) -> DataFrame:
    """``apply`` on (doc, text) with one row for each ``doc``; its result's ``doc``, and the columns ``refer``, name ids.

    Where an id repeats or is null, rows of one id and text count as one document, which stands in order of id (null
    first) and then of its text's digest; the result has a row for each of its copies.
    """
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc is null").isEmpty():
        return apply(docs)
    texts = docs.select(F.col("doc").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    texts = numbered(texts.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text")), ["id", "digest"], work, "texts")
    texts = work.save(texts.select(F.col("number").alias("doc"), "id", "copies", "text"), "numbered")
    out = apply(texts.select("doc", "text"))
    for column in refer:
        names = texts.select(F.col("doc").alias(column), F.col("id").alias("_id"))
        out = out.join(names, column).select(*(F.col("_id").alias(c) if c == column else F.col(c) for c in out.columns))
    names = texts.select("doc", F.col("id").alias("_id"), "copies")
    out = out.join(names, "doc").withColumn("_k", F.explode(F.expr(f"sequence(0, cast((copies - 1) div {COPIES} as int))")))
    out = out.withColumn("_j", F.explode(F.expr(f"sequence(1, cast(least({COPIES}, copies - {COPIES} * _k) as int))")))
    return out.select(*(F.col("_id").alias(c) if c == "doc" else F.col(c) for c in out.columns if c not in ("_id", "copies", "_k", "_j")))
