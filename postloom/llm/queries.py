"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import (
    capfilters,
    chat_sql,
    chatwindows,
    collocations,
    covering,
    hashtree,
    line_sql,
    mixing,
    paragraphs,
    phrase_sql,
    piecebpe,
    prefixfree,
    repair,
    supervision,
    templates,
    warc,
)
from postloom.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@_query("op7_covering_simhash")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return covering.near_duplicates(_table(spark, folder, "documents"))


def tokens(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    coded = piecebpe.encode_decode(docs, piecebpe.read_ranks(ranks_path), pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op10_piece_bpe")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return tokens(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)


@_query("op2_hash_tree")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return hashtree.shard(_table(spark, folder, "documents"), hashtree.tree(8), hashtree.tree(9))


@_query("op4_weak_supervision")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    judged = supervision.label(_table(spark, folder, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", "kept", "quality")


@_query("op1_cap_filters")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return capfilters.near_duplicates(_table(spark, folder, "embeddings"))


@_query("op3_paragraph_minhash")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    whole, found = paragraphs.repeats_and_passages(docs)
    # a whole line has no word to start at
    whole = whole.withColumns({"word": F.lit(None).cast("int"), "first_word": F.lit(None).cast("int")})
    return whole.select(*found.columns).unionByName(found)


@_query("op6_log_templates", line_sql.DROPPED_LINES)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    marked = templates.with_dropped(_table(spark, folder, "documents"))
    return marked.select(
        "row.doc_id",
        F.size(F.split("row.text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(templates.cut(F.col("row.text"), F.col("dropped")), 256).alias("kept_sha256"),
    )


#: Wanted shares of tokens, and the domain whose tokens stay as they are.
WEIGHTS, ANCHOR = {"clean": 0.98, "junk": 0.01, "toxic": 0.01}, "clean"


@_query("op9_soft_mixing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    labels = mixing.domain_of(_table(spark, folder, "labels"))
    rates = mixing.mix(_table(spark, folder, "documents"), labels, WEIGHTS, ANCHOR)
    shares = [F.round(f"p_{d}", 6).alias(f"p_{d}") for d in sorted(WEIGHTS)]
    return rates.select("doc_id", "tokens", *shares, F.round("rate", 6).alias("rate"), "copies")


@_query(
    "op5_warc_writer",
    """WITH facts AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    first AS (SELECT payload_digest, min(page_id) AS page FROM facts GROUP BY payload_digest)
    SELECT f.page_id, f.payload_bytes, f.payload_digest,
      CASE WHEN f.payload_bytes >= 100 AND f.page_id > r.page THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN f.payload_bytes >= 100 AND f.page_id > r.page THEN r.page END AS refers_to
    FROM facts f JOIN first r USING (payload_digest)""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    archive = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write(_table(spark, folder, "pages"), archive)
    return warc.read(manifest, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op8_prefix_free_parsing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    cut = prefixfree.remove_repeats(_table(spark, folder, "documents"))
    # bytes of a character that was cut through are replaced; the digest is of the bytes themselves
    kept = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return cut.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"), kept
    )


@_query("op11_parallel_viterbi")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    return repair.summary(repair.damaged(rows), rows)


@_query("op12_budgeted_windows", chat_sql.WINDOWS)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return chatwindows.digests(chatwindows.with_control_strings(_table(spark, folder, "conversations")))


@_query("op13_collocations", phrase_sql.COLLOCATIONS)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))
