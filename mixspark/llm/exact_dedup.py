"""Exact deduplication in three merges: inside each task, per salted digest group, over all salts.

Digests only propose groups. The texts of digests that occur more than once are compared whole: copies
are combined inside each task, then per digest and salt, then over all salts, always by the text itself. So
a digest shared by different texts never joins them. A bitmap of the repeated digests, of bounded size, tells
which texts must move at all.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.llm.common import body, joined, lowered, maybe_among, values
from mixspark.sources.scratch import stored

#: Salts of a digest: so many tasks share the copies of a text.
SALTS = 64


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _digests(rows: DataFrame, digest: Callable[[bytes], bytes], keep: bool) -> DataFrame:
    """(doc_id, digest) of rows (doc_id, body) and, if kept, the lower-case body."""
    names = ["doc_id", "digest"] + ["body"] * keep

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.lower() for t in values(batch["body"]))
            if keep:
                texts = list(texts)
                columns = [pa.array(map(digest, texts), pa.binary()), pa.array(texts, pa.binary())]
            else:
                columns = [pa.array(map(digest, texts), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names)

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {id_type}, digest binary" + ", body binary" * keep)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (the digest, in hex).

    Texts are equal when identical after lower-casing A-Z; a null text equals the empty one. The
    largest id of a group stays (null ids rank lowest). Of rows that repeat both the id and
    the text exactly one is kept. An empty table gives an empty result. Only the id and the text
    are read, so other columns may have any name.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), body(F.col(text_col)).alias("body"))
    # The row number only tells repeated rows apart. It is written, so every later use sees the same.
    members = stored(_digests(rows, digest, False).withColumn("row", F.monotonically_increasing_id())
                     .withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))), "dedup")
    best = F.max(F.struct("doc_id", "row")).alias("best")  # nulls rank lowest
    groups = stored(
        members.groupBy("digest", "salt").agg(best, F.count("*").alias("n"))
        .groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n")), "dedup-groups")
    repeated = groups.where("n > 1")
    n = repeated.count()
    shared = None
    if n:
        # The salt comes from the task: it sends each of its texts once, to one of the digest's groups.
        texts = maybe_among(_digests(rows, digest, True), repeated, "digest", n)
        texts = texts.groupBy("digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "body").agg(
            F.count("*").alias("copies")).groupBy("digest", "body").agg(F.sum("copies").alias("copies"))
        shared = stored(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"), "dedup-shared")
    if shared is None or not shared.take(1):
        found = joined(members, groups, "digest", "n")
    else:
        found = joined(members.join(shared, "digest", "left_anti"),
                       groups.join(shared, "digest", "left_anti"), "digest", "n").select(
            "doc_id", "digest", "row", "best", "n").unionByName(_by_text(rows, shared, digest))
    return found.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _by_text(rows: DataFrame, shared: DataFrame, digest) -> DataFrame:
    """The groups of the rows whose digest several texts share, by those texts."""
    rows = maybe_among(_digests(rows, digest, True), shared, "digest", shared.count()).join(shared, "digest", "left_semi")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "dedup-texts")
    groups = rows.groupBy("digest", "body").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n"))
    return rows.join(groups, ["digest", "body"]).select("doc_id", "digest", "row", "best", "n")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows are told apart by id and text,
    so an id that repeats with another text loses neither; rows that repeat both come once."""
    sha, gone_id, gone_sha, twin = (f"{c}_{uuid.uuid4().hex}" for c in ("sha", "id", "gone", "twin"))
    decided = stored(exact_dedup(docs, id_col, text_col), "dedup-decided").where("not kept").select(
        F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha),
        F.expr("doc_id <=> keep_id").alias(twin))
    keyed = docs.withColumn(sha, F.sha2(lowered(F.col(text_col)).cast("binary"), 256))
    same = (F.col(sha) == F.col(gone_sha)) & F.col(id_col).eqNullSafe(F.col(gone_id))
    stay = keyed.join(decided.where(~F.col(twin)), same, "left_anti")
    twins = decided.where(twin).distinct()
    if twins.take(1):  # rare, and each branch reads everything once more
        stay = stay.join(twins, same, "left_anti").unionByName(
            stay.join(twins, same, "left_semi").dropDuplicates([id_col, sha]))
    return stay.drop(sha)
