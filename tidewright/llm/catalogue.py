"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, digest, idfiles, lengths, lines, lm, mixing, neardup, topk, toxicity
from tidewright.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.against_edited(_table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "op3").path("files")
    manifest = idfiles.write(_table(spark, sf_dir, "documents"), folder)
    return idfiles.read(manifest, folder, lambda ids: zlib.crc32(ids.tobytes()), "long", "ids_crc32")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("text_hash")


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(lengths.lengths(_table(spark, sf_dir, "documents")))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2("text", 256).alias("text_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op8_bigram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(_table(spark, sf_dir, "documents"))


def op9_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_norm_sorted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_duplicates": op1_minhash_near_duplicates,
    "op2_improbable_features": op2_improbable_features,
    "op3_token_files": op3_token_files,
    "op4_mixing": op4_mixing,
    "op5_length_histogram": op5_length_histogram,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_bigram_trie": op8_bigram_trie,
    "op9_toxic_spans": op9_toxic_spans,
    "op10_norm_sorted_search": op10_norm_sorted_search,
}
ORACLES: dict[str, str] = {
    "op10_norm_sorted_search": """
        with parts as (
            select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i
            from embeddings where vec_id is not null and embedding is not null
        ),
        sound as (
            select vec_id from parts group by vec_id having bool_and(x is not null and isfinite(cast(x as double)))
        ),
        ints as (
            select vec_id, i, cast(floor(1024 * cast(x as double)) as bigint) as x
            from parts where vec_id in (select vec_id from sound)
        ),
        scores as (
            select q.vec_id as query_id, c.vec_id as vec_id, cast(sum(q.x * c.x) as bigint) as score
            from ints q join ints c on q.i = c.i and q.vec_id <> c.vec_id
            where q.vec_id % 100 = 0 group by q.vec_id, c.vec_id
        ),
        ranked as (
            select query_id, row_number() over (partition by query_id order by score desc, vec_id) as r, vec_id, score
            from scores
        )
        select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 10
    """,
}
