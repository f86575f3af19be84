"""Language of slide texts by interpolated Kneser-Ney character models.

One model for each language, of order four: sorted arrays of packed n-grams with their discounted
shares, and of packed contexts with what they leave to the next lower order. A text gets the
language of least cross-entropy for a character. A text whose cross-entropy lies above the bound
calibrated for that language is marked as rejected.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import give_back, kept, packed, unpacked

#: Expected characters of each language that models are fitted on, and bounds calibrated on: slides
#: are drawn by a hash of their id at the rate that gives so many. The model is thus bounded as well.
SAMPLE_CHARS = 20_000_000
#: A text is rejected beyond so many deviations of its language's cross-entropy.
DEVIATIONS = 10.0
#: Least deviation between texts of a language, as a part of its mean: few slides to calibrate on show little of it.
LEAST_SPREAD = 0.05
#: Alphabet size of the uniform share below single characters.
ALPHABET = 1 << 16
#: Languages that are learned at most, those with the most characters.
MOST_LANGUAGES = 1000
#: Characters whose n-grams are handled at once, and characters of the texts that are scored together.
SLICE, TOGETHER = 1 << 18, 1 << 20
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_MASKS = [np.uint64((1 << 16 * n) - 1) for n in range(5)]
_STEP = np.uint64(16)


def normal(text: str) -> str:
    """Lower case, every run of characters that are no letters as one space, three spaces ahead."""
    return "   " + _OTHER.sub(" ", text.lower()).lstrip(" ")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed 4-grams, one for each character, and the number of the text each belongs to; in slices."""
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    n = 0
    for i, text in enumerate(texts):
        for start in range(3, len(text), SLICE):
            part = text[start - 3:start + SLICE].encode("utf-32-le", "surrogatepass")
            codes = np.frombuffer(part, "<u4").astype(np.uint64) & _MASKS[1]
            grams = codes[3:] | codes[2:-1] << _STEP | codes[1:-2] << np.uint64(32) | codes[:-3] << np.uint64(48)
            held.append(grams)
            owner.append(np.full(len(grams), i, np.int32))
            n += len(grams)
            if n >= SLICE:
                yield np.concatenate(held), np.concatenate(owner)
                held, owner, n = [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owner)


def fit_arrays(grams: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """The Kneser-Ney model of distinct 4-grams (sorted) and their counts."""
    arrays: dict[str, np.ndarray] = {}
    for order in (4, 3, 2, 1):
        once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
        discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        contexts, inverse = np.unique(grams >> _STEP, return_inverse=True)
        totals = np.bincount(inverse, counts)
        arrays[f"gram{order}"] = grams
        arrays[f"share{order}"] = (counts - discount) / totals[inverse]
        arrays[f"context{order}"] = contexts
        arrays[f"left{order}"] = discount * np.bincount(inverse) / totals
        # A lower order counts the different characters seen before its n-grams.
        grams, counts = np.unique(grams & _MASKS[order - 1], return_counts=True)
    return arrays


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def log_shares(model: dict[str, np.ndarray], grams: np.ndarray) -> np.ndarray:
    """Natural logarithm of each 4-gram's last character given the three before."""
    p = np.full(len(grams), 1.0 / ALPHABET)
    for order in (1, 2, 3, 4):
        own = grams & _MASKS[order]
        left = _look_up(model[f"context{order}"], model[f"left{order}"], own >> _STEP, 1.0)
        p = _look_up(model[f"gram{order}"], model[f"share{order}"], own, 0.0) + left * p
    return np.log(p)


def score_texts(models: list[dict[str, np.ndarray]], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For normal texts: sums and square sums of negative logarithms, text by model, and characters."""
    sums = np.zeros((len(texts), len(models)))
    squares, n = np.zeros_like(sums), np.zeros(len(texts), dtype=np.int64)
    for grams, owner in pieces(texts):
        distinct, inverse = np.unique(grams, return_inverse=True)
        n += np.bincount(owner, minlength=len(texts))
        for k, model in enumerate(models):
            costs = -log_shares(model, distinct)[inverse]
            sums[:, k] += np.bincount(owner, costs, minlength=len(texts))
            squares[:, k] += np.bincount(owner, costs * costs, minlength=len(texts))
    return sums, squares, n


def training_part(slide_id: Column) -> Column:
    """The remainder that parts slides: 0 is held out, 1 calibrates, the others fit."""
    return F.crc32(F.coalesce(slide_id.cast("string"), F.lit("")).cast("binary")) % 5


def _sample(slides: DataFrame, sample_chars: int) -> DataFrame:
    """Slides that are not held out, drawn at the rate that gives about ``sample_chars`` of each language."""
    known = slides.select("slide_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("_part", training_part(F.col("slide_id"))).where(
        "_part <> 0")
    sizes = known.groupBy("lang").agg(F.sum(F.length("text")).alias("_chars"))
    # Few rows, so that texts are drawn where they are read: no exchange by language, which would be uneven.
    largest = sizes.orderBy(F.desc("_chars"), "lang").limit(MOST_LANGUAGES)
    rates = largest.select("lang", F.least(F.lit(1.0), F.lit(float(sample_chars)) / F.greatest(
        F.col("_chars"), F.lit(1))).alias("_rate"))
    drawn = F.pmod(F.xxhash64("slide_id", "lang"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return known.join(F.broadcast(rates), "lang").where(drawn < F.col("_rate")).select("lang", "text", "_part")


def _count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for lang, part in frame.groupby("lang"):
            for grams, _ in pieces([normal(t) for t in part["text"]]):
                distinct, counts = np.unique(grams, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": distinct.view(np.int64), "n": counts})


def _fit_one(frame: pd.DataFrame) -> pd.DataFrame:
    grams = frame["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    held = io.BytesIO()
    np.savez(held, **fit_arrays(grams[order], frame["n"].to_numpy(np.int64)[order]))
    return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "model": [held.getvalue()]})


def load(model: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(model)) as arrays:
        return {name: arrays[name] for name in arrays.files}


class LanguageModels:
    """Fitted models, broadcast to the executors, and the bounds for rejection."""

    def __init__(self, spark, langs: list[str], models: list[bytes], bounds: list[tuple[float, float, float]] | None):
        self.spark, self.langs, self.models, self.bounds = spark, langs, models, bounds
        self.shared = spark.sparkContext.broadcast(models)

    def entropies(self) -> Column:
        """Struct of pandas columns for ``text``: best language, its place, cross-entropy, spread, characters."""
        shared, langs, bounds = self.shared, self.langs, self.bounds
        key = hashlib.sha256(b"".join(self.models)).digest()

        @F.pandas_udf("lang_pred string, score double, cross_entropy double, square double, n long, rejected boolean")
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            # Also lets go what another operator kept in this worker.
            models = kept(key, lambda: [load(m) for m in shared.value])
            for texts in batches:
                part = (texts.str.len().fillna(0).cumsum() // TOGETHER).to_numpy()
                own = [texts[part == n] for n in range(int(part.max(initial=0)) + 1)]
                yield pd.concat([predict_batch(models, langs, bounds, t) for t in own])
                give_back()

        return predict(F.col("text"))


def predict_batch(models, langs, bounds, texts: pd.Series) -> pd.DataFrame:
    known = np.array([has_letter(t) for t in texts], dtype=bool) & bool(langs)
    out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "cross_entropy": np.nan, "square": np.nan, "n": 0,
                        "rejected": True}, index=texts.index)
    if not known.any():
        return out
    sums, squares, n = score_texts(models, [normal(t) for t in texts[known]])
    means = sums / n[:, None]
    best = means.argmin(axis=1)
    row = np.arange(len(best))
    least = means[row, best]
    out.loc[known, "lang_pred"] = np.array(langs, dtype=object)[best]
    out.loc[known, "score"] = 1.0 / np.exp(least[:, None] - means).sum(axis=1)
    out.loc[known, "cross_entropy"], out.loc[known, "n"] = least, n
    out.loc[known, "square"] = squares[row, best] / n
    if bounds is not None:
        mean, between, within = np.array(bounds)[best].T
        out.loc[known, "rejected"] = least > mean + DEVIATIONS * np.sqrt(
            np.maximum(between, (LEAST_SPREAD * mean) ** 2) + within / n)
    return out


def fit_languages(slides: DataFrame, sample_chars: int = SAMPLE_CHARS) -> LanguageModels:
    """Learn the languages of ``slides`` (``slide_id, text, lang``).

    Only slides with a language whose ``crc32`` of the id, as text, does not leave 0 when divided by 5 are
    learned from: remainder 1 calibrates, the others fit. Of each language, slides are drawn by a
    hash of their id so that about ``sample_chars`` characters are expected. Slides without text or language teach
    nothing; with no slide to learn from there are no languages, and all texts are unknown.
    """
    spark = slides.sparkSession
    sample = _sample(slides, sample_chars)
    counts = sample.where("_part > 1").mapInPandas(_count_grams, "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    fitted = counts.groupBy("lang").applyInPandas(_fit_one, "lang string, model binary").collect()
    fitted = sorted((r["lang"], bytes(r["model"])) for r in fitted)
    models = LanguageModels(spark, [lang for lang, _ in fitted], [m for _, m in fitted], None)
    scored = sample.where("_part = 1").select("lang", models.entropies().alias("_p")).where("lang = _p.lang_pred")
    found = {r["lang"]: r for r in scored.groupBy("lang").agg(
        F.avg("_p.cross_entropy").alias("mean"), F.var_pop("_p.cross_entropy").alias("between"),
        F.avg(F.col("_p.square") - F.col("_p.cross_entropy") ** 2).alias("within")).collect()}
    # A language without a slide to calibrate on rejects nothing.
    models.bounds = [(r["mean"], r["between"], r["within"]) if (r := found.get(lang)) else (np.inf, 0.0, 0.0)
                     for lang in models.langs]
    return models


def detect_language(slides: DataFrame, models: LanguageModels) -> DataFrame:
    """``slides`` with all their columns and, in the struct ``language``: ``lang_pred, score, cross_entropy, rejected``.

    ``lang_pred`` is the language of least cross-entropy (the first by name among equals), ``score`` its
    part of all languages' likelihood for a character. Null texts and texts without a letter are
    ``und``, with score 0, and rejected. Repeated rows are judged alike; an empty table stays empty;
    a column ``language`` that was there before is replaced.
    """
    return unpacked(packed(slides, "text").withColumn("language", models.entropies()), slides.columns, "language")
