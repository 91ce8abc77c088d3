"""The memory's tables on disk: versioned Parquet folders, JSON exports, results and metrics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Memory:
    """Named tables below one folder; each version is a folder of its own, a pointer file names the current one.

    A version is written whole before the pointer moves, so a failed or repeated batch leaves the last state.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self, table: str) -> int | None:
        """The greatest complete version: Parquet's success marker is written last."""
        if not self._fs().exists(self._path(table)):
            return None
        found = [f.getPath().getName() for f in self._fs().listStatus(self._path(table))]
        done = [int(n[2:]) for n in found if n.startswith("v=") and self._fs().exists(self._path(f"{table}/{n}/_SUCCESS"))]
        return max(done, default=None)

    def read(self, table: str) -> DataFrame | None:
        version = self.version(table)
        return None if version is None else self.spark.read.parquet(f"{self.root}/{table}/v={version:012d}")

    def write(self, table: str, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/v={version:012d}")


def write_ndjson(rows: DataFrame, path: str, *by: str) -> None:
    """JSON lines, replacing what is there; folders by the given columns."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def summaries_json(summaries: DataFrame) -> DataFrame:
    """One JSON object for each summary, themes as numbered keys."""
    titles = F.map_from_entries(F.transform("themes", lambda t: F.struct(F.concat(F.lit("theme_"), t["i"].cast("string")), t["title"])))
    texts = F.map_from_entries(F.transform("themes", lambda t: F.struct(F.concat(F.lit("summary_"), t["i"].cast("string")), t["summary"])))
    return summaries.select(F.to_json(F.struct("session_id", "session_time", "keys", F.map_concat(titles, texts).alias("context"))).alias("value"))


def write_metrics(row: DataFrame, path: str) -> None:
    """A one-row table as a JSON file of the driver."""
    with open(path, "w") as file:
        json.dump(row.first().asDict(recursive=True), file, indent=2, default=str)


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Summaries (session_id, session_time, keys, themes) from the JSON lines of ``summaries_json``."""
    rows = spark.read.schema("session_id string, session_time string, keys string, context map<string, string>").json(path)
    numbered = F.filter(F.map_keys("context"), lambda k: k.startswith("theme_"))
    theme = lambda k: F.struct(F.substr(k, F.lit(7)).cast("int").alias("i"), F.try_element_at("context", k).alias("title"), F.try_element_at("context", F.concat(F.lit("summary_"), F.substr(k, F.lit(7)))).alias("summary"))
    return rows.select("session_id", "session_time", "keys", F.array_sort(F.transform(numbered, theme)).alias("themes"))


def write_results(results: DataFrame, path: str) -> None:
    """The answers (id, question, answer, output, question_type, origin, top_session_ids) as JSON lines in order of id."""
    results.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)
