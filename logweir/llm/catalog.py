"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logweir.llm import collocations, fim, hnsw, lang_id, lm_score, lsh_forest, mixing, nbsvm, oracle, packing, rp_forest, sharding, token_files, url_filter
from logweir.llm.common import remove_path, shared_path, stored, table
from logweir.plans.registry import Query


def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return hnsw.groups(table(spark, folder, "embeddings"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.labelled(spark)).select("page_id", "host", "path", "rule", "verdict", "probability")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return lm_score.score(table(spark, folder, "documents"), good)


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.assign(table(spark, folder, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    documents, path = table(spark, folder, "documents"), shared_path(spark, "token-files")
    token_files.write(documents, path)
    index = stored(token_files.read(spark, path), "token-index")
    remove_path(spark, path)
    return index


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return rp_forest.search(table(spark, folder, "embeddings"), 50)


def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = lsh_forest.join(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "group_id", "n_links", F.col("doc_id").eqNullSafe(F.col("group_id")).alias("kept"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return nbsvm.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    return lang_id.classify(table(spark, folder, "documents"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fim.transform(table(spark, folder, "documents"))
    output = F.sha2("output", 256).alias("output_sha256")
    restored = F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", output, restored)


QUERIES = {
    "op1_embedding_dedup": Query(op1_embedding_dedup, oracle.VECTOR_GROUPS),
    "op2_url_filter": Query(op2_url_filter),
    "op3_packing": Query(op3_packing),
    "op4_lm_scoring": Query(op4_lm_scoring),
    "op5_sharding": Query(op5_sharding),
    "op6_token_files": Query(op6_token_files),
    "op7_mixing": Query(op7_mixing),
    "op8_nearest": Query(op8_nearest),
    "op9_ngram_join": Query(op9_ngram_join, oracle.TEXT_GROUPS),
    "op10_quality": Query(op10_quality),
    "op11_language": Query(op11_language),
    "op12_collocations": Query(op12_collocations, oracle.COLLOCATIONS),
    "op13_fill_in_middle": Query(op13_fill_in_middle, oracle.FILL_IN_MIDDLE),
}
