"""The queries of the training-data operators over a data folder, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captionmill.llm import chunks, collocations, conversations, ctw, decontaminate, hostrules, langid, linededup, neardup, oracles, quality, records, rollups, toxicity
from captionmill.llm.common import fold_of, scratch, stored, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return records.read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_copies", "n_near", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def tokenizer_versions() -> dict:
    """Two tokenizer versions: file, and split pattern where the file has none."""
    import public_tokenizers as own

    return {"byte_bpe_50k": (own.path("byte_bpe_50k.json"), None), "byte_bpe_multi_50k": (own.path("byte_bpe_multi_50k.tiktoken"), own.PATTERN)}


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of batches over all documents: inserts under the first
    tokenizer; deletes of documents under ten tokens, committed twice; a change
    to the second tokenizer, which deletes what is left under the first and
    inserts all documents with the first one's counts for the time being; and a
    revision that puts in the second one's counts, replayed after compaction."""
    path = scratch(spark, "rollup")
    old, new = sorted(tokenizer_versions())
    counts = stored(rollups.counted(table(spark, sf_dir, "documents"), tokenizer_versions()), "token-counts")
    n_old, n_new = F.col("counts")[old], F.col("counts")[new]
    change = lambda op, version, n, prev=F.lit(None).cast("long"), rows=counts: rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), n.alias("n_tokens"), prev.alias("prev_n_tokens"))
    rollups.commit(change("insert", old, n_old), path, "1")
    for _ in range(2):
        rollups.commit(change("delete", old, n_old, rows=counts.where(n_old < 10)), path, "2")
    rollups.commit(change("delete", old, n_old, rows=counts.where(n_old >= 10)).unionByName(change("insert", new, n_old)), path, "3")
    revised = change("revise", new, n_new, n_old)
    rollups.commit(revised, path, "4")
    rollups.compact(spark, path)
    rollups.commit(revised, path, "4")
    return rollups.totals(spark, path)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ctw.score(table(spark, sf_dir, "documents"), lambda doc_id: fold_of(doc_id, 7) != 2)
    return done.select("doc_id", (fold_of(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = hostrules.apply_rules(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = langid.predict(docs, langid.train(langid.training_rows(docs)))
    return told.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chunks.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), outputs=())
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    index = toxicity.fit(docs, labels.where(fold_of(labels["doc_id"], 5) != 0))
    told = toxicity.score(docs, index)
    return told.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), min_count=10, longest=3, top=2000)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold_of(labels["doc_id"], 4) != 2))
    told = quality.score(docs, model, least=0.7)
    return told.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage, with the digest of its repaired turns; one
    that lost all its rows has zeros, an empty audit and the empty string's digest."""
    given = table(spark, sf_dir, "conversations")
    rows = conversations.damage(given)
    seen = stored(conversations.inspect(rows), "inspected")
    sha = conversations.digests(conversations.repaired(rows, seen))
    out = conversations.one_row_each(given.select("conv_id").distinct(), seen, sha)
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = out.na.fill(0, figures).na.fill("", ["audit"]).na.fill(hashlib.sha256().hexdigest(), ["repaired_sha256"])
    return whole.select("conv_id", *figures, "audit", "repaired_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_records, op2_line_dedup, op3_token_rollup, op4_lm_scores, op5_decontamination, op6_host_rules, op7_language_id, op8_bpe_chunks, op9_near_duplicates, op10_toxicity, op11_collocations, op12_quality, op13_conversation_repair, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": oracles.OP5, "op6_host_rules": oracles.OP6, "op9_near_duplicates": oracles.OP9, "op11_collocations": oracles.OP11, "op13_conversation_repair": oracles.OP13}
