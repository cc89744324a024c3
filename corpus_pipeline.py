"""The corpus pipeline: each stage applies one operator of critiq.llm to all documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.llm.common import cut, few, free_name, table
from critiq.llm.queries import _ranks

BROADCAST_IDS = 1_000_000  # 16 bytes each
TOXIC = 0.7  # documents that score as much go
ODD = 1 << 62  # keys of documents without an id of their own begin here
KEY = "critiq"  # of the surrogates; a deployment passes its own secret


def plainly_named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under the names c0, c1, ..., which clash with nothing, and the new name of each column."""
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*name.values()), name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each document as one more column, and that column's name.

    The key is the doc_id where it is given and unique. Other rows, of null or repeated ids, get a hash of id and text
    of ODD or more, so that ids come before them and rows alike in both share a key. A table without such rows stays as
    it is.
    """
    odd = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1").select("doc_id"))
    if odd.isEmpty():
        return docs, "doc_id"
    key, own = free_name(docs, "key"), free_name(docs, "odd_id")
    own_key = F.lit(ODD) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(ODD))
    odd = few(odd.select(F.col("doc_id").alias(own), F.lit(True).alias(key)), own)
    marked = docs.join(odd, F.col("doc_id").eqNullSafe(F.col(own)), "left")
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.col(key), own_key).otherwise(F.col("doc_id")).alias(key)), key


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """docs but for the keys in ids' one column. As few as BROADCAST_IDS are broadcast; more are joined by a shuffle."""
    ids = cut(ids.toDF(key).distinct())
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(small, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of TOXIC or more go; the model learns from the labels of all documents.

    Null, empty and blank texts have the model's bias as score and stay. Rows are judged one by one, whatever their
    ids, repeated and null ones included. An empty table gives an empty result. Other columns, whatever their names, are kept.
    """
    from critiq.llm.toxicity import toxicity_scores, train

    rows, name = plainly_named(docs)
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity_scores(rows, model, text_col=name["text"]).filter(F.col("score") < TOXIC).select(*name.values()).toDF(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8) the document of least doc_id stays.

    Null, empty and blank texts link with nothing: all of them stay. Rows without an id, or whose id repeats, come after
    all others in a group; of rows alike in id and text the least, by all columns, stays. An empty table gives an empty
    result. Other columns, whatever their names, are kept.
    """
    from critiq.llm.minhash_dedup import minhash_groups

    rows, key = keyed(docs)
    groups = minhash_groups(rows.select(F.col(key).alias("doc_id"), "text"), width=5, similarity_pct=80)
    rest = without(rows, groups.filter(~F.col("kept")).select("doc_id"), key)
    own = [F.col(f"`{c}`") for c in docs.columns]
    if key == "doc_id":
        return rest
    double = (F.col(key) >= ODD) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = rest.filter(double).groupBy(key).agg(F.min(F.struct(*own)).alias("row")).select("row.*")
    return rest.filter(~double).select(*own).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whether or not they have an id of their own.

    Null, empty and blank texts hold nothing and stay. Every row is judged by its text; rows alike in id and text go or
    stay together. An empty table gives an empty result. Other columns, whatever their names, are kept.
    """
    from critiq.llm.decontaminate import overlaps

    rows, key = keyed(docs)
    found = overlaps(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, found.select("doc_id"), key).select(*[F.col(f"`{c}`") for c in docs.columns])


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates, no two the same; n_chars follows the new text.

    Null texts stay null, with a null n_chars; empty ones stay empty. Rows are changed one by one, whatever their ids. An
    empty table gives an empty result. Other columns, whatever their names, are kept as they are.
    """
    from critiq.llm.pii import distinct_key, pseudonymise

    rows, name = plainly_named(docs)
    out = pseudonymise(rows, distinct_key(rows, KEY, name["text"]), text_col=name["text"])
    length = F.length(name["text"]).cast(docs.schema["n_chars"].dataType)
    return out.withColumn(name["n_chars"], length).select(*name.values()).toDF(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes that they decode to by their offsets, as digests.

    Null and empty texts have no ids. Every row gives a row, repeated and null ids included. An empty table gives an
    empty result; other columns are left out, whatever their names.
    """
    from critiq.llm.byte_bpe import bpe_round_trip

    back = bpe_round_trip(docs, _ranks())
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", minhash_near_dedup), ("decontamination", decontamination), ("pii", pii), ("byte_bpe", byte_bpe)]
ORACLE_SQL = None  # the toxicity model and the tokenizer are no SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
