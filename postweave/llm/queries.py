"""Registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postweave.llm import (
    byte_encoding, conversation_repair, decontamination, labelled_lines, language, line_dedup, line_quality, ngram_join,
    packing, periodic_runs, personal_data, piece_encoding, sharding, url_lists)
from postweave.sources.derive import table


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality.judge(table(spark, folder, "documents"))


# Times that the lines labelled by hand count in the training of the field.
BY_HAND = 3


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    field = personal_data.train(BY_HAND * labelled_lines.labelled_lines() + personal_data.weak_labels(docs))
    return personal_data.find_spans(docs, field, checked=True).select(
        "doc_id", *(f"n_{kind}" for kind in personal_data.KINDS),
        F.sha2("base_spans", 256).alias("base_sha256"), "spans")


# The shards that documents are placed on.
SHARDS = [f"shard-{i:03d}" for i in range(256)]


def op3_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, SHARDS)


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))
    return packed.select(
        "pack_group", "pack_row", "n_tokens", "doc_ids", "parts", "cu_seqlens",
        F.sha2("input_ids", 256).alias("ids_sha256"),
        F.sha2("position_ids", 256).alias("positions_sha256"))


def _dated(step: int) -> Column:
    """A time of the year 2024 for every page."""
    return F.timestamp_seconds(F.lit(FIRST_SECOND) + (F.col("page_id") * step) % MINUTES * 60)


# The captures and list entries derived from the pages fall into one year.
FIRST_SECOND, MINUTES = 1_704_067_200, 366 * 24 * 60


def url_captures(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", "url", _dated(7919).alias("fetched"))


def url_entries(spark: SparkSession, folder: str) -> DataFrame:
    """One dated entry per page: its host, or the domain above it, is listed or unlisted."""
    keys = url_lists.keys_of(url_lists.host_of(F.col("url")))
    digit = F.substring(F.md5("url"), 1, 1)
    chosen = F.when(F.substring(F.md5("url"), 2, 1) < "8", F.get(keys, F.lit(0))).otherwise(
        F.coalesce(F.get(keys, F.size(keys) - 2), F.get(keys, F.lit(0))))
    return table(spark, folder, "pages").select(
        chosen.alias("key"), (digit < "8").alias("listed"), _dated(104_729).alias("at"))


def op6_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    return url_lists.evaluate(url_captures(spark, folder), url_entries(spark, folder))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    profiles = language.learn_profiles(language.learning_rows(docs))
    return language.identify(docs.select("doc_id", "text"), profiles).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_piece_encoding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = vocabulary("piece_bpe_32k.model")
    return piece_encoding.round_trip(docs, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        "agrees")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.decontaminate_rows(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, folder, "documents"))


def damaged_rows(rows: DataFrame) -> DataFrame:
    """Rows of conversations with one in four damaged, by checksum; dropped rows are not ``present``."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fate = F.crc32(key) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (fate != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = damaged_rows(table(spark, folder, "conversations"))
    return conversation_repair.summaries(conversation_repair.repair(rows)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: in every tenth document by checksum, the words from some place on repeat."""
    space = "[\\x20\\x09-\\x0D]+"
    planted = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn(
        "words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", space), lambda w: w != "")))
    # One operand per row, so that no word list is made twice.
    counted = planted.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    sized = counted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    sized = sized.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    rest = (F.col("n") - F.col("a")).cast("int")
    block = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    repeated = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), repeated), " ")
    return sized.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def periodic_rows(docs: DataFrame) -> DataFrame:
    """Runs of every document after periods were planted, as counts and digests."""
    found = periodic_runs.collapse_runs(with_planted_periods(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    chosen = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return chosen.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
        length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("bigint").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_rows(table(spark, folder, "documents"))


def op13_byte_encoding(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    return byte_encoding.round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_quality": op1_line_quality,
    "op2_personal_data": op2_personal_data,
    "op3_sharding": op3_sharding,
    "op4_line_dedup": op4_line_dedup,
    "op5_packing": op5_packing,
    "op6_url_lists": op6_url_lists,
    "op7_language_id": op7_language_id,
    "op8_piece_encoding": op8_piece_encoding,
    "op9_decontamination": op9_decontamination,
    "op10_ngram_join": op10_ngram_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_encoding": op13_byte_encoding,
}
