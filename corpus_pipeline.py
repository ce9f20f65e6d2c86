"""A corpus pipeline: each stage takes the documents that the one before kept, and the last packs them.

Stages may get columns of any names, repeated ids and null values; rows are told apart by a number that a
stage writes beside them once, as the place of a row in a scan changes with the plan that reads it. A
stage's result reads tables that the stage has written, so it is to be stored before the next stage begins,
which deletes them.
"""

from __future__ import annotations

import threading
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likegraph.llm import language_id, minhash, packing, secrets, tiling
from likegraph.llm.shared import drop_written, table, written
from likegraph.stored import drop_paths, recorded
from likegraph.workers import let_workers_import

#: Rows whose places are broadcast to leave them out; more are joined by a shuffle.
MOST_BROADCAST = 500_000


_LEFT = threading.local()


def _stage(function):
    """function, after what the stage before it in this thread has left is deleted; what docs itself reads stays."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        stage, paths = getattr(_LEFT, "by", ("", []))
        if stage != function.__name__:  # one stage may be asked for several tables before any is stored
            paths = drop_paths(spark, paths, docs)
        with recorded() as own:
            out = function(spark, docs, sf_dir)
        _LEFT.by = function.__name__, [*paths, *own]
        return out

    return run


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a table with a number for each row, and that column's name, which docs doesn't have."""
    at, taken = "_place", {c.lower() for c in docs.columns}
    while at in taken:
        at = "_" + at
    return written(docs.withColumn(at, F.monotonically_increasing_id()), "numbered"), at


def _placed(docs: DataFrame, at: str) -> DataFrame:
    """What operators read, by the row's number: _place, doc_id, text. No column of docs can clash with theirs."""
    return docs.select(F.col(at).alias("_place"), "doc_id", "text")


def _without(docs: DataFrame, at: str, places: DataFrame, name: str) -> DataFrame:
    """docs less their number at and the rows whose number is in places (_place): texts don't move unless very many rows go."""
    gone = written(places.select("_place"), name)
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    rows = docs.select(F.col(at).alias("_place"), F.struct(*[c for c in docs.columns if c != at]).alias("_row"))
    return rows.join(gone, "_place", "left_anti").select("_row.*")


@_stage
def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that have a language; rejects those in which it finds none (null text, no letters).

    Without any language to learn from, nothing can be rejected for lacking one but text without letters,
    so then all documents with a letter stay.
    """
    let_workers_import(spark)
    model = language_id.learn(docs)
    if not model:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    rows, at = _numbered(docs)
    found = language_id.predict(_placed(rows, at), model, keep=["_place"])
    return _without(rows, at, found.filter(F.col("lang_pred") == language_id.UNKNOWN), "rejected")


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at similarity 0.8 or more, the document of the least id (then place) stays.

    Documents with null text or without words are in no group and stay. Null ids come after all others.
    """
    let_workers_import(spark)
    rows, at = _numbered(docs)
    keys = _placed(rows, at).select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_place").alias("key"), "text")
    groups = minhash.near_duplicates(keys, k=5, num=80, den=100, doc_id="key")
    return _without(rows, at, groups.filter(~F.col("kept")).select(F.col("doc_id._place").alias("_place")), "copies")


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold at least 0.8 of a benchmark item's words in common runs of five words or more, in any order.

    Null and empty texts stay, as do texts and items of fewer words; repeated rows go or stay together.
    """
    let_workers_import(spark)
    rows, at = _numbered(docs)
    found = tiling.contamination(_placed(rows, at), table(spark, sf_dir, "benchmark"), keep=["_place"])
    return _without(rows, at, found.filter("contaminated"), "contaminated")


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated and null ones too; its secrets, overlapping ones as one, are replaced by a mark and n_chars is counted anew. Null text stays null."""
    return secrets.redacted(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as sequences of at most 2048 tokens. Null text is a document of the end id alone; null and equal ids stay apart as rows; an empty table gives no rows."""
    let_workers_import(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]

#: Neither mixtures of languages nor tokens can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_written(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
