"""The registered queries of the operators for training data: each over its whole table."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm import ctw
from mixspark.llm import decontaminate as dc
from mixspark.llm import exact_dedup as dd
from mixspark.llm import jaccard_join as jj
from mixspark.llm import language as lg
from mixspark.llm import merkle as mk
from mixspark.llm import packing as pk
from mixspark.llm import periodic_runs as pr
from mixspark.llm import quality as ql
from mixspark.llm import secrets as se
from mixspark.llm import token_counts as tc
from mixspark.llm import toxicity as tx
from mixspark.llm import warc as wc
from mixspark.llm.common import fold


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_ctw_scores(spark, d):
    return ctw.ctw_scores(table(spark, d, "documents"))


def op2_best_fit_pack(spark, d):
    """A token is a UTF-8 byte, with one end a document."""
    return pk.best_fit_pack(table(spark, d, "documents"), F.coalesce(F.octet_length("text"), F.lit(0)) + 1)


def op3_toxicity(spark, d):
    return tx.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op4_decontaminate(spark, d):
    found = dc.find_hits(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id", F.col("_dc_words").alias("n_words"), dc.hit_words(F.col("_dc_hits")).alias("n_hit"),
        F.size("_dc_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_dc_items").cast("binary"), 256).alias("items_sha256"),
        dc.contaminated().alias("contaminated"))


def op5_jaccard_join(spark, d):
    return jj.jaccard_join(table(spark, d, "documents"))


def op6_token_counts(spark, d):
    return tc.count_tokens(table(spark, d, "documents"), tc.drawn_edits())


def op7_exact_dedup(spark, d):
    return dd.exact_dedup(table(spark, d, "documents"))


def op8_secret_scan(spark, d):
    found = se.scan(table(spark, d, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in se.KINDS[:3]],
        F.sha2(se.named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        se.named(F.concat("base", "added")).alias("spans"))


def op9_language_id(spark, d):
    return lg.language(table(spark, d, "documents"))


def op10_quality(spark, d):
    scored = ql.quality_scores(table(spark, d, "documents"), table(spark, d, "labels"))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "_quality.*",
                         (F.col("_quality.score") >= ql.KEEP_AT).alias("kept"))


def op11_merkle_manifest(spark, d):
    """Rows of an even crc32 of the id (a null id is the empty text) are tampered with: the line feeds of
    their text are deleted."""
    docs = table(spark, d, "documents")
    head = [mk.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = mk.digest(*head, mk.field(F.col("text")))
    bare = mk.digest(*head, mk.field(F.replace("text", F.lit("\n"), F.lit(""))))
    changed = (fold(F.col("doc_id"), 2) == 0) & F.contains("text", F.lit("\n"))
    found = mk.build_manifest(
        docs, leaf, F.col("source"), F.col("doc_id"),
        {"doc_id": F.col("doc_id"), "tampered": F.when(changed, bare)}).proofs()
    found = found.withColumn("folded_root", mk.folded(F.coalesce("tampered", "digest"), F.col("steps")))
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", mk.proof_digest(F.col("steps")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def repeated_places(doc_id, n: int):
    """Where the words of a text come from: of every tenth text, by the crc32 of its id (null: empty), the
    words from some place on repeat a stretch of their beginning."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def op12_periodic_runs(spark, d):
    found = pr.find_runs(table(spark, d, "documents"), rewrite=repeated_places)
    line = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    # The longest run, of these the first by start and period, which is the order of the array.
    first = F.aggregate(
        "runs", F.lit(None).cast(pr.RUNS[6:-1]),
        lambda best, r: F.when(best.isNull() | (r["length"] > best["length"]), r).otherwise(best))
    return found.withColumn("first", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "first.start", "first.length", "first.period",
        F.expr("1000 * first.length div first.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_warc(spark, d):
    pages = table(spark, d, "pages")
    found = wc.read_archives(wc.write_archives(pages), payloads=False)
    like = pages.schema["page_id"].dataType
    return found.select(
        wc.page_of(F.col("row"), like).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        wc.page_of(F.col("refers"), like).alias("refers_to"))


QUERIES = {f.__name__: f for f in (
    op1_ctw_scores, op2_best_fit_pack, op3_toxicity, op4_decontaminate, op5_jaccard_join, op6_token_counts,
    op7_exact_dedup, op8_secret_scan, op9_language_id, op10_quality, op11_merkle_manifest,
    op12_periodic_runs, op13_warc)}
QUERIES["pipeline"] = corpus_pipeline.run
