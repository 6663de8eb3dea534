"""The registered queries: each operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenlight.llm import (
    exact_dedup,
    language,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    periodic,
    quality,
    secrets,
    spelling,
    substring_dedup,
    syncmers,
    tokenizer,
)
from wrenlight.llm.common import held_out_fold, ship_package


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = held_out_fold(F.col("doc_id"))
    filters = language.train(docs.where(~held_out))
    return language.identify(docs, filters).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.deduplicated(docs)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = held_out_fold(F.col("doc_id"))
    model = quality.train(docs, labels.where(~held_out))
    return quality.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compared(documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(documents(spark, sf_dir))

    def listed(spans):
        texts = F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
        )
        return F.concat_ws(",", texts)

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def vocabulary_path() -> str:
    """The vocabulary file that the registered query reads."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = tokenizer.read_spec(vocabulary_path())
    encoded = tokenizer.encode(documents(spark, sf_dir), spec)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).select(
        "doc_id",
        F.array_join("licenses", ",").alias("licenses"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size("licenses").alias("n_licenses"),
        F.col("unknown").alias("n_unknown"),
    )


def looped(doc_id: Column, text: Column) -> Column:
    """The text of op11: of every tenth document the words from one on repeat, by its id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        found = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))
        )
        return F.array_join(found, " ")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # Binds the words once.
    edited = F.get(
        F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(text)), 0
    )
    return F.when((h % 10 == 0) & text.isNotNull(), edited).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    edited = docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.runs(edited)
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    )
    best = found.withColumn("best", longest).select(
        "*",
        F.col("best.length").alias("length"),
        (-F.col("best.col2")).alias("start"),
        (-F.col("best.col3")).alias("period"),
    )
    listed = F.transform(
        "runs",
        lambda r: F.concat(
            F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))),
            F.lit("\n"),
        ),
    )
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "start",
        "length",
        "period",
        F.floor(1000 * F.col("length") / F.col("period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def misspelt(doc_id: str | None, words: Counter) -> Iterator[tuple[str, int]]:
    """The words of op13: one in 199, by the CRC-32 of id and word, loses a letter."""
    if doc_id is None:
        yield from words.items()
        return
    start = zlib.crc32(f"{doc_id}:".encode())
    for word, n in words.items():
        h = zlib.crc32(word.encode(), start)
        if h % 199:
            yield word, n
        else:
            at = h % len(word)
            yield word[:at] + word[at + 1 :], n


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir), edit=misspelt))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_mixing": op6_mixing,
    "op7_secrets": op7_secrets,
    "op8_near_dedup": op8_near_dedup,
    "op9_tokenize": op9_tokenize,
    "op10_licenses": op10_licenses,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}
