"""Language identification with interpolated Kneser-Ney character models, one for each language.

A text's language is that of the model with the lowest cross-entropy per character. Its score is the model's posterior among the
languages, times a rejection factor: how likely a text of that language has so high a cross-entropy. The factor is calibrated on
a part of the training texts that the models do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..plans.durable import durable
from .charlm import codes, count_grams, estimate, text_log_probs
from .textkit import slices

UNKNOWN = "und"


def predict_languages(docs: DataFrame, train: Column, *, lang: str = "lang", max_chars: int = 60, calibrate: int = 10) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for every whole text; doc_id of any type.

    docs: doc_id, text and a language column, read only where `train` is true; other columns are ignored. Null texts and those
    without a letter get 'und' and score 0, as does everything where no language is learned. Of the training texts one in
    `calibrate`, by a hash of the text, is left out of the models and gives each language the usual cross-entropy, its deviation and
    the limit above which a prediction is `rejected`: the 0.999 quantile of these texts, at least 4 deviations. A language without
    such texts rejects nothing. Repeated rows each give a row; an empty table gives an empty result. max_chars bounds the evidence
    that the posterior counts, never what is read. Every language value that is learned has a model, however many there are.
    """
    learned = F.when(train, F.col(lang).cast("string"))
    aside = F.coalesce(F.pmod(F.xxhash64("text"), F.lit(calibrate)) == 0, F.lit(False))
    rows = docs.select("doc_id", F.when(aside, learned).alias("learned"), "text")
    counts, cells = count_grams(docs.select(F.when(~aside, learned).alias("grp"), "text"))
    model = estimate(durable(counts), cells, modified=False)
    names = sorted(model.entries)
    schema = StructType([docs.schema["doc_id"], StructField("learned", StringType()), StructField("n", LongType()), StructField("known", BooleanType()), StructField("logs", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            code, begins, letter = codes(s)
            known = np.diff(np.concatenate([[0], np.cumsum(letter)])[begins]) > 0
            logs = text_log_probs(model, names, code, begins)
            logs = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * len(names)), pa.array(logs.ravel()))
            yield pa.RecordBatch.from_arrays([*s.rows.columns[:2], pa.array(np.diff(begins)), pa.array(known), logs], schema.names)

    scored = durable(rows.mapInArrow(run, schema))
    best, chars = F.array_max("logs"), F.greatest("n", F.lit(1))
    place = F.array_position("logs", best).cast("int")
    odds = F.aggregate(F.transform("logs", lambda x: F.exp((x - best) / chars * F.least(chars, F.lit(max_chars)))), F.lit(0.0), lambda a, x: a + x)
    sure = F.col("known") & (F.size("logs") > 0)
    told = scored.select(
        "doc_id", "learned", chars.alias("n"),
        F.when(sure, F.get(F.array(*map(F.lit, names)).cast("array<string>"), place - 1)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(sure, 1 / odds).otherwise(0.0).alias("posterior"),
        F.when(sure, -best / chars).otherwise(0.0).alias("cross_entropy"),
    )
    # One row a language.
    right = told.filter("lang_pred = learned and n >= 20")
    usual = F.broadcast(right.groupBy("lang_pred").agg(F.avg("cross_entropy").alias("mean"), F.greatest(F.stddev_pop("cross_entropy"), F.lit(0.02)).alias("sd")))
    z = (F.col("cross_entropy") - F.col("mean")) / (F.col("sd") * F.sqrt(1 + 200 / F.col("n")))
    limits = F.broadcast(right.join(usual, "lang_pred").groupBy("lang_pred").agg(F.greatest(F.percentile_approx(z, 0.999, 10_000), F.lit(4.0)).alias("limit")))
    placed = told.join(usual, "lang_pred", "left").join(limits, "lang_pred", "left").withColumn("z", z)
    above = F.col("z") - F.col("limit")
    fits = F.when(above.isNull(), 1.0).otherwise(1 / (1 + F.exp(F.least(above, F.lit(50.0)))))
    return placed.select("doc_id", "lang_pred", (F.col("posterior") * fits).alias("score"), "cross_entropy", F.coalesce(F.col("z") > F.col("limit"), F.lit(False)).alias("rejected"))
