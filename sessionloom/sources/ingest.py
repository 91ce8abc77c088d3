"""Benchmark dumps and corpora to sessions and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import answer_or_default, build_context, date_prefix, evidence_prefix, parse_long_date
from ..operators.topk import number_rows

#: Folder suffixes of question types.
SUFFIXES = {"single-session-user": "ssu", "single-session-assistant": "ssa", "single-session-preference": "ssp", "multi-session": "ms", "temporal-reasoning": "tr", "knowledge-update": "ku"}


def starts_with_array(spark: SparkSession, path: str) -> bool:
    """Whether the first character that is no space is a bracket, read through Spark from the first lines only."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0].value.lstrip().startswith("[")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of family A: a JSON array; other content is an error."""
    if not starts_with_array(spark, path):
        raise ValueError("not a JSON array")
    return spark.read.schema(schemas.RAW_ITEMS).json(path, multiLine=True)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Groups of family B: a JSON array of conversations with numbered sessions."""
    return spark.read.schema(schemas.RAW_GROUPS).json(path, multiLine=True)


def suffix(c) -> Column:
    """The folder suffix of a question type."""
    table = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.col(c) if isinstance(c, str) else c), F.lit("unknown"))


def item_sessions(items: DataFrame) -> DataFrame:
    """(question_id, pos, session_id, session_time, context): three parallel lists cut to the shortest."""
    n = F.least(F.size("haystack_dates"), F.size("haystack_session_ids"), F.size("haystack_sessions"))
    zipped = F.slice(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions"), F.lit(1), F.greatest(n, F.lit(0)))
    rows = items.select("question_id", F.posexplode(zipped).alias("pos", "z"))
    return rows.select("question_id", "pos", F.col("z.haystack_session_ids").alias("session_id"), date_prefix("z.haystack_dates").alias("session_time"), build_context("z.haystack_sessions").alias("context"))


def item_questions(items: DataFrame) -> DataFrame:
    """(question_id, question, answer, question_type, question_time, origin, label) of known types, as the dump has them; the label is the answer."""
    known = items.filter(F.col("question_type").isin(*SUFFIXES))
    return known.select("question_id", "question", "answer", "question_type", F.col("question_date").alias("question_time"), F.col("answer_session_ids").alias("origin"), F.col("answer").alias("label"))


def group_sessions(groups: DataFrame) -> DataFrame:
    """(group_id, n, session_id, session_time, context): sessions 1, 2, .. up to the first gap."""
    entries = groups.select("group_id", "conversation", F.explode(F.map_entries("conversation")).alias("e")).filter(F.col("e.key").rlike(r"^session_\d+$"))
    rows = entries.select("group_id", F.regexp_extract("e.key", r"(\d+)$", 1).cast("int").alias("n"), F.col("e.value").alias("raw"), F.try_element_at("conversation", F.concat("e.key", F.lit("_date_time"))).alias("stamp"))
    gapless = rows.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy("n"))).filter("n = k")
    context = build_context(F.from_json("raw", schemas.MESSAGES), caption=True)
    return gapless.select("group_id", "n", F.concat(F.lit("D"), F.col("n").cast("string")).alias("session_id"), parse_long_date("stamp").alias("session_time"), context.alias("context"))


def group_questions(groups: DataFrame) -> DataFrame:
    """(group_id, pos, question, answer, question_type, origin, label) of family B; the label is the answer."""
    rows = groups.select("group_id", F.posexplode("qa").alias("pos", "q"))
    return rows.select("group_id", "pos", "q.question", answer_or_default("q.answer").alias("answer"), F.col("q.category").alias("question_type"), evidence_prefix("q.evidence").alias("origin"), answer_or_default("q.answer").alias("label"))


def scalar_origin(questions: DataFrame) -> DataFrame:
    """``origin`` as JSON text for export: one id alone as a string, several as a list."""
    return questions.withColumn("origin", F.when(F.size("origin") == 1, F.concat(F.lit('"'), F.get("origin", F.lit(0)), F.lit('"'))).otherwise(F.to_json("origin")))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, session_id, session_time, context, title) of a JSON array or of JSON lines, one line included."""
    rows = spark.read.schema(schemas.CORPUS).json(path, multiLine=starts_with_array(spark, path))
    stamp = F.translate(F.split_part(F.coalesce("session_time", F.lit("")), F.lit(" "), F.lit(1)), "-", "/")
    return number_rows(rows.select("session_id", stamp.alias("session_time"), "context", "title"), "doc_id")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answer, question_type, question_time, origin, label) of JSON lines; origin is always a list."""
    rows = spark.read.schema(schemas.QUESTIONS).json(path)
    origin = F.coalesce(F.from_json("origin", "array<string>"), F.array("origin"))
    return number_rows(rows.withColumn("origin", origin), "id")


def folder_index(rows: DataFrame, kind: str, order: str, taken: int = 0) -> DataFrame:
    """Adds ``item_index``: the place of each item among those of its kind, after those taken."""
    return rows.withColumn("item_index", (F.row_number().over(Window.partitionBy(kind).orderBy(order)) + taken).cast("bigint"))


def merge_session_docs(docs: DataFrame) -> DataFrame:
    """(session_id, session_time, context) of (doc_id, session_id, session_time, context).

    Documents of a session in order, joined by an empty line, each left out if what is there contains it already.
    """
    rows = docs.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "session_time", "context"))).alias("d"))
    joined = F.aggregate(F.col("d"), F.lit(""), lambda acc, x: F.when(acc == "", x["context"]).when(F.contains(acc, x["context"]), acc).otherwise(F.concat(acc, F.lit("\n\n"), x["context"])))
    return rows.select("session_id", F.get("d", F.lit(0))["session_time"].alias("session_time"), joined.alias("context"))
