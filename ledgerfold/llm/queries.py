"""Registered queries of this subpackage (thin bindings to the operators)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm import alignment, ann, bpe, chains, chat, decontaminate, minhash, ngram_lm, packing, periodic, quality, suffixes, warc
from ledgerfold.llm.common import id_remainder, table, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ngram_lm.lm_scores(docs, id_remainder("doc_id", 7) == 2)


@query
def op5_bpe(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(table(spark, sf_dir, "documents"), path, ["doc_id"])


@query
def op9_chat_formatting(spark, sf_dir):
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    back = chat.read_back(chat.examples(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


@query
def op10_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


@query
def op3_nearest_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLES["op3_nearest_neighbours"] = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op4_warc(spark, sf_dir):
    uri = workspace(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), uri)
    return warc.read(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query
def op7_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality.fit(docs, labels.where(id_remainder("doc_id", 3) != 1))
    marked = docs.withColumn("held_out", id_remainder("doc_id", 3) == 1)
    return quality.score(marked, machine, ["doc_id", "held_out"])


@query
def op2_decontamination(spark, sf_dir):
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


@query
def op6_suffix_dedup(spark, sf_dir):
    return suffixes.without_repeats(table(spark, sf_dir, "documents"), length=200)


@query
def op8_substring_dedup(spark, sf_dir):
    return chains.repeats(table(spark, sf_dir, "documents")).drop("uid")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth text (by its id's crc32) with words that repeat from some
    place on, as op11's contract says."""
    n, rest = F.col("_n"), F.col("_n") - F.col("_a")
    return (docs.withColumn("_h", F.crc32(F.col("doc_id").cast("string")))
            .withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
            .withColumn("_n", F.when(F.size("_words") > 0, F.size("_words")))
            .withColumn("_g", F.floor(F.col("_h") / 10)).withColumn("_a", (F.col("_g") % n).cast("int"))
            .withColumn("_p", (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int"))
            .withColumn("text", F.when(n.isNull(), F.col("text")).otherwise(F.array_join(F.concat(
                F.slice("_words", 1, F.col("_a")),
                F.slice(F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)), " ")))
            .select(docs.columns))


@query
def op11_periodic_runs(spark, sf_dir):
    docs = with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.reduce("runs", none, lambda a, r: F.when(
        a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return (periodic.periodic_runs(docs, ["doc_id"]).withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*",
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.when(F.size("runs") == 0, "").otherwise(F.concat(lines, F.lit("\n"))), 256).alias("runs_sha256"),
                    F.sha2("collapsed", 256).alias("collapsed_sha256")))


@query
def op12_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])


@query
def op13_alignment(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.alignments(table(spark, sf_dir, "documents"), *paths, ["doc_id"])
