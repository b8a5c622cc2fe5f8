"""The registered queries of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lensgraph.llm import alignment, embedding_dedup, exact_dedup, lm_scoring, media_gif, mixing, ngram_join, packing, pii, quality, spelling, token_codes, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    documents = lambda spark, sf_dir: _table(spark, sf_dir, "documents")
    return {
        "op1_lm_scoring": lambda spark, sf_dir: lm_scoring.op1(documents(spark, sf_dir)),
        "op2_token_codes": lambda spark, sf_dir: token_codes.op2(documents(spark, sf_dir)),
        "op3_mixing": lambda spark, sf_dir: mixing.op3(documents(spark, sf_dir)),
        "op4_quality": lambda spark, sf_dir: quality.op4(documents(spark, sf_dir), _table(spark, sf_dir, "labels")),
        "op5_pii": lambda spark, sf_dir: pii.op5(documents(spark, sf_dir)),
        "op6_toxicity": lambda spark, sf_dir: toxicity.op6(documents(spark, sf_dir), _table(spark, sf_dir, "labels")),
        "op7_packing": lambda spark, sf_dir: packing.op7(documents(spark, sf_dir)),
        "op8_media_gif": lambda spark, sf_dir: media_gif.op8(documents(spark, sf_dir)),
        "op9_ngram_join": lambda spark, sf_dir: ngram_join.op9(documents(spark, sf_dir)),
        "op10_embedding_dedup": lambda spark, sf_dir: embedding_dedup.op10(_table(spark, sf_dir, "embeddings")),
        "op11_spelling": lambda spark, sf_dir: spelling.op11(documents(spark, sf_dir)),
        "op12_alignment": lambda spark, sf_dir: alignment.op12(documents(spark, sf_dir)),
        "op13_exact_dedup": lambda spark, sf_dir: exact_dedup.op13(spark, f"{sf_dir}/documents.parquet"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.ORACLE_SQL, "op13_exact_dedup": exact_dedup.ORACLE_SQL}
