"""The corpus queries: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_and_decode
from .collocations import mine_collocations
from .common import read
from .html_text import extract_text
from .licenses import scan_licenses
from .minhash import near_duplicates
from .negatives import mine_negatives
from .packing import pack_documents
from .quality import judge_quality
from .secret_scan import scan_secrets
from .sketches import fingerprints
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_suffixes
from .warc import archive_pages


def op1_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents")).drop("rejected_by")


def op2_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), with_ids=False)


def op3_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(read(spark, sf_dir, "pages"), payloads=False)
    c = F.col("capture")
    return found.select("page_id", c["payload_bytes"].alias("payload_bytes"), c["payload_digest"].alias("payload_digest"), c["record_type"].alias("record_type"), c["refers_to_page"].alias("refers_to"))


def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op5_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_and_decode(read(spark, sf_dir, "documents"), digests_only=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("detections")


def op10_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(read(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents")).drop("findings")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_negatives(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_cascade,
        op2_ffd_packing,
        op3_warc_transactions,
        op4_html_layout,
        op5_bpe_pair_index,
        op6_substring_dedup,
        op7_circulant_minhash,
        op8_suffix_dedup,
        op9_license_signatures,
        op10_bottom_k,
        op11_collocations,
        op12_secret_scan,
        op13_hard_negatives,
    )
}
