"""One thin query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import shared_dir
from . import alignment, decontaminate, idfiles, langid, negatives, packing, quality, simhash, substring, suffix, textkit, tokencount, toxicity, wordlm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The others cannot be written in SQL that runs on whole tables: tests hold each against brute force.
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    textkit.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int = 3) -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 1, F.lit(False))


@query
def op1_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query
def op2_toxicity_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train_classifier(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_packing_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_idfiles_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/idfiles-{uuid.uuid4().hex}"
    idfiles.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return idfiles.read_ids(spark, path, digests_only=True)


@query
def op6_substring_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated(table(spark, sf_dir, "documents"))


@query
def op7_langid_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.predict_languages(table(spark, sf_dir, "documents"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query
def op8_suffix_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeated_bytes(table(spark, sf_dir, "documents"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_tokencount_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op12_wordlm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return wordlm.score(docs, wordlm.train(docs.filter(~held_out(5))), F.col("doc_id"), held_out(5).alias("held_out"))


@query
def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), F.col("doc_id"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, "vec_id % 100 = 0")


ORACLES["op11_hard_negatives"] = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as alike, list_inner_product(a.e, b.e)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::integer as "rank",
  s.other_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.alike and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify "rank" <= 10
"""
