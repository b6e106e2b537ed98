"""Quality rules: base text statistics, and perplexity bands of language-specific modified Kneser-Ney models.

A language's documents are dealt into two halves by a hash of the text, and a document is scored by the model of its own language's
other half alone, so neither it nor its exact copies make it look usual. It passes if its base rules do and its log perplexity lies in
its language's bands, per character and per word (run of letters): the median plus and minus a number of robust deviations, wider for
short texts, whose perplexity varies more. Signs after each word and table bars cost little a character, as each foretells the next,
but they are no words, so their texts cost more a word than prose does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..plans.durable import durable
from .charlm import codes, count_grams, estimate, own_log_probs
from .substring import Words
from .textkit import Slice, per_text, quoted, range_hashes, slices

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The group of documents without a language; no language value can be it.
NO_LANGUAGE = "\0"


def _within(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of a text `of`, whether it equals an earlier one of the same text, and whether it occurs again in it at all."""
    order = np.lexsort((np.arange(len(values)), values, of))
    v, o = values[order], of[order]
    same = np.zeros(len(v), bool)
    same[1:] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    either = same.copy()
    either[:-1] |= same[1:]
    earlier, again = np.empty(len(v), bool), np.empty(len(v), bool)
    earlier[order], again[order] = same, either
    return earlier, again


def text_stats(s: Slice, window: int = 8) -> dict[str, np.ndarray]:
    """The base statistics of each whole text of a slice."""
    w, data = Words(s), s.data
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[w.start] = 1
    in_word[w.end] -= 1
    head = (data & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    # Lines end at line feeds; a text's last line ends with it. Those with a word count.
    cut = np.zeros(len(data) + 1, bool)
    cut[s.off] = True
    cut[1:] |= data[: len(data)] == 10
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    end = np.where((end > start) & (data[np.maximum(end, 1) - 1] == 10), end - 1, end) if len(start) else end
    words_before = np.searchsorted(w.start, edge)
    full = np.diff(words_before) > 0
    start, end = start[full], end[full]
    line_of = np.searchsorted(s.off, start, "right") - 1
    earlier, _ = _within(range_hashes(data, start, end), line_of) if len(start) else (np.zeros(0, bool),) * 2
    at = np.flatnonzero(w.left >= window)
    _, again = _within(w.runs.of(window)[at], w.doc[at]) if len(at) else (None, np.zeros(0, bool))
    spread = np.zeros(w.n + 1, np.int64)
    np.add.at(spread, at[again], 1)
    np.add.at(spread, at[again] + window, -1)
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_text(head & (np.cumsum(in_word[:-1]) > 0), s.off),
        "n_symbols": per_text(symbol[data], s.off),
        "n_dup_lines": np.bincount(line_of[earlier], minlength=len(s)),
        "n_repeat_words": per_text(np.cumsum(spread[:-1]) > 0, w.first),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _runs(begins: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The runs of letters of each text."""
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    at = begins[begins < len(letter)]
    opens[at] = letter[at]
    return per_text(opens, begins)


def half() -> Column:
    """The half of its language that a text is counted in."""
    return F.pmod(F.xxhash64("text"), F.lit(2))


def _model(group: Column, of: Column) -> Column:
    return F.concat(group, F.lit("\1"), of.cast("string"))


def score(docs: DataFrame, lang: str, carry: tuple[str, ...]) -> DataFrame:
    """(c0, .., grp, statistics, n_chars, n_runs, log_prob) of every document; c0.. are the `carry` columns.

    log_prob is the text's under the model of its language's other half; 0 where that half has no text. Texts are read twice, to be counted
    and to be scored, and never shuffled.
    """
    group = F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE))
    counts, cells = count_grams(docs.select(_model(group, half()).alias("grp"), "text"))
    model = estimate(durable(counts), cells, modified=True)
    carried = [StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(carry)]
    schema = StructType([StructField("grp", StringType()), *carried, *(StructField(c, LongType()) for c in (*STATS, "n_chars", "n_runs")), StructField("log_prob", DoubleType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            stats, (code, begins, letter) = text_stats(s), codes(s)
            logs = own_log_probs(model, s.rows.column(2).to_pylist(), code, begins)
            arrays = [pa.array(x.astype(np.int64)) for x in (*(stats[c] for c in STATS), np.diff(begins), _runs(begins, letter))]
            yield pa.RecordBatch.from_arrays([s.rows.column(0), *s.rows.columns[3:], *arrays, pa.array(logs)], names)

    return durable(docs.select(group.alias("grp"), "text", _model(group, 1 - half()).alias("model"), *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(carry)]).mapInArrow(run, schema))


def bands(scored: DataFrame) -> DataFrame:
    """(grp, m0, d0, m1, d1): median and robust deviation of log perplexity a character, and a word, of each language's documents
    that pass the base rules; alike for few and many documents. A table of its own, so joins see that it has one row a language."""
    q = [F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000) for x in _values()]
    found = scored.filter(~base_failed()).groupBy("grp").agg(q[0].alias("q0"), q[1].alias("q1"))
    spread = [[F.col(f"q{k}")[1].alias(f"m{k}"), F.greatest((F.col(f"q{k}")[2] - F.col(f"q{k}")[0]) / 1.349, F.lit(0.01)).alias(f"d{k}")] for k in (0, 1)]
    return durable(found.select("grp", *spread[0], *spread[1]).coalesce(1))


def _values() -> tuple[Column, Column]:
    return -F.col("log_prob") / F.greatest("n_chars", F.lit(1)), -F.col("log_prob") / F.greatest("n_runs", F.lit(1))


def _judged(docs: DataFrame, lang: str, low: float, high: float, short: float, carry: tuple[str, ...]) -> DataFrame:
    scored = score(docs, lang, carry)
    kept = ~base_failed()
    for k, value in enumerate(_values()):
        z = (value - F.col(f"m{k}")) / (F.col(f"d{k}") * F.sqrt(1 + short / F.greatest("n_chars", F.lit(1))))
        kept &= F.coalesce(z.between(-low, high), F.lit(True))
    return scored.join(bands(scored), "grp", "left").withColumns({"base_failed": base_failed(), "kept": kept, "log_perplexity": _values()[0]})


def judge(docs: DataFrame, *, lang: str = "lang", low: float = 5.0, high: float = 5.0, short: float = 300.0) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity) of every document.

    docs: doc_id, text and a language column; other columns are ignored. Null and empty texts have no words and fail the base
    rules; documents without a language have models and bands of their own, as every language value has, however rare. low and
    high are the bands in robust deviations of log perplexity per character and per word; `short` is the length at which a text's own
    variance equals that of its language. Repeated rows each give a row; an empty table gives an empty result.
    """
    found = _judged(docs, lang, low, high, short, ("doc_id",))
    return found.select(F.col("c0").alias("doc_id"), *STATS, "base_failed", "kept", "log_perplexity")


def keep(docs: DataFrame, *, lang: str = "lang", low: float = 5.0, high: float = 5.0, short: float = 300.0) -> DataFrame:
    """The documents that judge() keeps, all columns. Texts are scored once and travel with their scores."""
    found = _judged(docs, lang, low, high, short, tuple(docs.columns)).filter("kept")
    return found.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
