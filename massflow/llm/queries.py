"""The queries of this subpackage and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from massflow.llm import html_extract as _html_extract
from massflow.llm import mixing as _mixing
from massflow.llm import near_dup as _near_dup
from massflow.llm import nearest as _nearest
from massflow.llm import piece_codec as _piece_codec
from massflow.llm import prefix_trie as _prefix_trie
from massflow.llm import quality_rules as _quality_rules
from massflow.llm import secret_scan as _secret_scan
from massflow.llm import site_quality as _site_quality
from massflow.llm import token_store as _token_store
from massflow.llm import toxicity as _toxicity
from massflow.llm import vector_codes as _vector_codes
from massflow.llm import warc as _warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mixing(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = _piece_codec.load(_tokenizer("piece_bpe_32k.model"))
    return _piece_codec.encode(_table(spark, sf_dir, "documents"), pieces, chunk_bytes=_piece_codec.LARGE_CHUNK_BYTES, lattice_bytes=_piece_codec.LARGE_LATTICE_BYTES)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_store.token_ids(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest.search(_table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site_quality.quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc.archive_pages(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_html_extraction": op2_html_extraction,
        "op3_quality_rules": op3_quality_rules,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_token_ids": op6_token_ids,
        "op7_nearest": op7_nearest,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_warc": op9_warc,
        "op10_toxicity": op10_toxicity,
        "op11_secret_scan": op11_secret_scan,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": _near_dup.ORACLE, "op9_warc": _warc.ORACLE, "op12_prefix_trie": _prefix_trie.ORACLE, "op13_vector_codes": _vector_codes.ORACLE}
