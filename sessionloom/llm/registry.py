"""The opN_ queries: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import contaminated
from .license_scan import oracle_sql as license_sql
from .license_scan import scan_licenses
from .ngram_join import near_duplicate_classes
from .packing import packed_buckets
from .pii import replace_pii
from .quality import oracle_sql as quality_sql
from .quality import quality
from .quotes import link_quotations
from .suffix_dedup import repeated_passages
from .token_files import token_files
from .warc import MIN_REVISIT, archive_round_trip

#: Where the public tokenizer files lie; the package that installs them knows, this is the documented place.
TOKENIZERS = Path("/opt/tokenizers")


def tokenizer_path(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return str(TOKENIZERS / name)
    return str(public_tokenizers.path(name))


def pii_key(spark: SparkSession) -> str:
    """The surrogates' key: the setting ``spark.sessionloom.pii.key``, which every real run sets; a stated one for tests."""
    return spark.conf.get("spark.sessionloom.pii.key", None) or "not-a-secret: set spark.sessionloom.pii.key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(_table(spark, sf_dir, "conversations"))


def op7_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_buckets(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_simple8b_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(_table(spark, sf_dir, "documents"), pii_key(spark), count_col="n_mentions").select("doc_id", "text", "n_mentions")


def op5_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_ngram_jaccard_join,
            op2_suffix_array_dedup,
            op3_license_scan,
            op4_pii_surrogates,
            op5_robust_quality,
            op6_quotation_linking,
            op7_power_of_two_packing,
            op8_simple8b_token_files,
            op9_seekable_warc,
            op10_simhash_decontamination,
        )
    }


WARC_SQL = f"""WITH named AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM named WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, n.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM named n LEFT JOIN firsts f ON n.payload_digest = f.payload_digest AND payload_bytes >= {MIN_REVISIT}"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries it can express; the others are tested against brute force or a round trip."""
    return {"op3_license_scan": license_sql(), "op5_robust_quality": quality_sql(), "op9_seekable_warc": WARC_SQL}
