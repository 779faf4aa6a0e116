"""The registered queries of the training-data operators: thin selections of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.oracles import ORACLES  # noqa: F401  registered beside the queries


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.decontaminate import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.mixing import weighted_mix

    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return weighted_mix(docs, carry=False).select(
        F.col("lw_id").alias("doc_id"),
        F.col("lw_size").alias("size"),
        F.col("lw_source_size").alias("source_size"),
        F.col("lw_target").alias("target"),
        F.col("lw_taken").alias("taken"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.simhash import near_duplicate_classes

    classes = near_duplicate_classes(_read(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("lw_print")), 16, "0").alias("fingerprint"), F.col("lw_class").alias("component_id"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.chat import format_conversations, read_back

    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{says}'), (-7L, 1L, 'assistant', '{says}') AS v(conv_id, turn, role, text)")
    out = format_conversations(turns.unionByName(planted)).withColumn("turns", read_back(F.col("lw_formatted")))
    said = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("lw_formatted").cast("long").alias("formatted_chars"),
        F.col("lw_valid").alias("valid"),
    )


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.ctw import score_texts

    return score_texts(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        F.col("lw_held").alias("held_out"),
        F.col("lw_tokens").alias("n_tokens"),
        F.col("lw_known").alias("n_known"),
        F.col("lw_train_tokens").alias("train_tokens"),
        F.col("lw_base").alias("base_score"),
        F.col("lw_score").alias("score"),
        F.col("lw_bits_per_byte").alias("bits_per_byte"),
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.pii import KINDS, find_personal_data, span_list

    found = find_personal_data(_read(spark, sf_dir, "documents"))
    counts = [F.col(f"lw_n_{k}").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.col("lw_base_sha256").alias("base_sha256"), span_list("lw_spans").alias("spans"), F.size("lw_spans").cast("long").alias("n_spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.toxicity import toxicity_scores

    scored = toxicity_scores(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))
    predicted = (F.col("lw_score") >= 0.7).cast("int").alias("predicted")
    return scored.select("doc_id", F.col("lw_held").alias("held_out"), F.col("lw_score").alias("score"), predicted)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.langid import identify_languages

    found = identify_languages(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.col("lw_held").alias("held_out"), F.col("lw_lang").alias("lang_pred"), F.col("lw_score").alias("score"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.sharding import balanced_shards

    docs = _read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return balanced_shards(docs).select(
        "doc_id",
        F.col("lw_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("lw_shard").alias("shard"),
        F.col("lw_slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.quality import quality_report

    report = quality_report(_read(spark, sf_dir, "documents"))
    measures = [F.col(f"lw_{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return report.select("doc_id", *measures, F.col("lw_base_failed").alias("base_failed"), F.col("lw_kept").alias("kept"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.urls import UrlPlan, UrlRule, judge_urls

    rules = (
        UrlRule("allow", "org", "/"),
        UrlRule("block", "example.org", "/es/"),
        UrlRule("block", "example.org", "/en/1"),
        UrlRule("allow", "com", "/fr/"),
        UrlRule("block", "com", "/de/"),
    )
    pages = _read(spark, sf_dir, "pages")
    judged = judge_urls(pages.select("page_id", "url"), pages.select("html"), plan=UrlPlan(rules=rules))
    given = [F.col(f"lw_{c}").alias(c) for c in ("host", "path", "rule", "verdict")]
    return judged.select("lw_own.page_id", *given, F.array_join("lw_words", " ").alias("host_words"), F.col("lw_score").alias("score"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.whitening import whiten

    names = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    return whiten(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("lw_own.vec_id", *[F.col(f"lw_{c}").alias(c) for c in names])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from listwright.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return hard_negatives(_read(spark, sf_dir, "embeddings"), label).select(*[F.col(f"lw_{c}").alias(c) for c in names])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_source_mix,
        op3_simhash,
        op4_chat_format,
        op5_sharding,
        op6_context_tree,
        op7_personal_data,
        op8_toxicity,
        op9_language,
        op10_host_quality,
        op11_url_filter,
        op12_whitening,
        op13_hard_negatives,
        pipeline,
    )
}
