"""The registered queries of this subpackage and their SQL. Each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewell.llm.common import new_path
    from tidewell.llm.records import read_records, write_records

    path = new_path(spark, "records")
    shards = write_records(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1, words=True)
    return read_records(spark, path, shards)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewell.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.langid import learn, predict

    docs = _table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.media import digest

    return digest(_table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.html_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.neardup import near_duplicate_groups

    return near_duplicate_groups(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.quality import assess, learn

    docs = _table(spark, sf_dir, "documents")
    return assess(docs, learn(docs, _table(spark, sf_dir, "labels")))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("blocks")


def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.mixing import mix_documents

    return mix_documents(_table(spark, sf_dir, "documents"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.runs import digest, periodic_runs, with_periodic_tails

    return digest(periodic_runs(with_periodic_tails(_table(spark, sf_dir, "documents"))))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.spelling import spelling_variants

    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.llm.privacy import personal_spans, report

    return report(personal_spans(_table(spark, sf_dir, "documents")))


def _sql() -> dict[str, str]:
    from tidewell.llm.mixing import SQL

    return {"op10_mixture": SQL}


_FUNCTIONS = (
    op1_language, op2_records, op3_packing, op4_media, op5_main_text, op6_near_duplicates, op7_quality, op8_shards, op9_licenses, op10_mixture,
    op11_runs, op12_spelling, op13_personal,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}
ORACLE_SQL = _sql()
