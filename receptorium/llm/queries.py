"""Named queries of the operators in this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from receptorium.llm import decontaminate, html_text, language, minhash, packing, quality, quotes, ranked, repair, secrets, set_join, url_tree, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quotes.link(_table(spark, sf_dir, "conversations"))
    return found.withColumn("reply_path", F.array_join(F.transform("reply_path", lambda t: t.cast("string")), "/"))


def op2_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(_table(spark, sf_dir, "documents"))


def op3_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op4_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op5_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op6_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = minhash.near_classes(_table(spark, sf_dir, "documents"))
    return members.select("doc_id", "class_id", "class_size")


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), added=True)


def op9_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_tree.judge(_table(spark, sf_dir, "pages"), unfitted=0)  # the rules are the only labels: what they don't name is clean


def op10_block_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_pipelined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join(_table(spark, sf_dir, "documents"))[0]


def op13_ida_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damage(_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_quotation_linking, op2_trigram_secrets, op3_gru_language, op4_fm_decontaminate, op5_rule_ledger, op6_probminhash_classes, op7_warc_round_trip,
                                   op8_large_item_packing, op9_template_tree, op10_block_tree, op11_pipelined_search, op12_set_relation_join, op13_ida_repair)}
