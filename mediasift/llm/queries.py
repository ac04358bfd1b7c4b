"""Queries p1_ to p8_ over the project's tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import components, copies, hamming, leakage, mixing, names, sentences, survivors

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.link_contacts(table(spark, d, "contact_matches"), table(spark, d, "contacts"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "contact_matches").select(F.nullif(F.upper(F.trim("a")), F.lit("")).alias("a"), F.nullif(F.upper(F.trim("b")), F.lit("")).alias("b"))
    return components.group_pairs(m).groupBy("group_id").agg(F.count("*").alias("members"))


COPIES = {"fields": ["kind", "label"], "split": {"value": r"[;|/]"}}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.link_copies(table(spark, d, "labeled_values"), "value_id", **COPIES).select("first_id", F.col("id").alias("value_id"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse_copies(table(spark, d, "labeled_values"), "value_id", **COPIES)


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(*(table(spark, d, t) for t in ("contacts", "contact_groups", "merge_conflicts", "stores")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).where("decided = 'unanimous'").select("group_id", "field", "contact_id").distinct()


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(table(spark, d, "contacts"), table(spark, d, "contact_groups"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(table(spark, d, "contacts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hamming.near_assets(table(spark, d, "phash_entries"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return hamming.near_classes(table(spark, d, "phash_entries"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    return hamming.near_texts(table(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), edited=False).where("verbatim").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    sized = table(spark, d, "documents").select("doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens"))
    return Scratch(spark, "mix").write(sized)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.plan_mix(_sized(spark, d), table(spark, d, "mix_targets")).where("NOT reachable").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    docs = _sized(spark, d)
    return mixing.mix_report(docs, mixing.plan_mix(docs, table(spark, d, "mix_targets")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = _sized(spark, d)
    return mixing.draw_mix(docs, mixing.plan_mix(docs, table(spark, d, "mix_targets")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents")).select("doc_id", "end_pos")


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}
