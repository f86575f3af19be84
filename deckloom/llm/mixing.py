"""Mixing slide sources to target weights by weighted sampling without replacement.

Each slide draws the key ``-ln(u) / quality`` (Efraimidis and Spirakis), where ``u`` comes from a
digest of its id, so that reruns agree. A source whose target is ``e`` whole times its size and a
rest takes every slide ``e`` times; the rest goes to the slides of smallest key, summed up in key
order until the budget of words is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.llm.common import packed, stored, unpacked, word_count
from deckloom.operators.skew import running_sum

#: Weights dealt to the sources in their order, again and again.
WEIGHTS = (3, 1, 2)
#: All targets together, and the most of any source, as multiples of the words there are.
SHARE, MOST = 1.5, 2.0
#: Ranges that the keys of a source are cut into, so that a large source is summed by many tasks.
RANGES = 1024
#: A slide without a quality of its own weighs less the more of these signs stand between its words.
SYMBOLS = "[#*$%&|<>]"
#: Places where a source's rows are joined with its target.
SALTS = 32
#: Hexadecimal digits of the digest that make ``u``.
DIGITS = 13


def draw(seed: int, slide_id: Column, size: Column) -> Column:
    """Uniform number in (0, 1) from seed, id and size of a slide."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(slide_id.cast("string"), F.lit("")), size.cast("string"))
    whole = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint")
    return (whole.cast("double") + F.lit(0.5)) / F.lit(float(16 ** DIGITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """Words that each source should give: ``source, source_size, target``.

    ``sizes`` has one row for each source (``source, source_size``). A target is the source's part of
    ``share`` times all words by weight, but ``most`` times the source's size at most; what is
    over goes to the others by weight. That sharing has a closed form: sources fill up in the
    order of their limit for each unit of weight, so one pass over the sources finds who is full.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    limits = sizes.withColumn("_weight", weight).withColumn("_limit", F.col("source_size") * F.lit(most)).withColumn(
        "_fills", F.col("_limit") / F.col("_weight"))
    full = Window.orderBy("_fills", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(
        Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    before, lighter = (F.coalesce(F.sum(c).over(full), F.lit(0.0)) for c in ("_limit", "_weight"))
    # The words for each unit of weight, were this source and all that fill later not full.
    level = (F.sum("source_size").over(everything) * F.lit(share) - before) / (
        F.sum("_weight").over(everything) - lighter)
    levels = limits.withColumn("_level", level)
    # It rises up to the first source that is not full, and falls from there on.
    final = F.max(F.when(F.col("_level") <= F.col("_fills"), F.col("_level"))).over(everything)
    capped = F.coalesce(F.least("_limit", final * F.col("_weight")), F.col("_limit"))
    return levels.select("source", "source_size", capped.alias("target"))


def _sized(slides: DataFrame, seed: int) -> DataFrame:
    """Adds ``_size``, ``_key`` and ``_source``, the source's name with nulls marked, so that joins find them."""
    quality = F.col("quality").cast("double") if "quality" in slides.columns else F.lit(None)
    symbols = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(SYMBOLS))
    plain = (F.col("_size") + F.lit(1.0)) / (F.col("_size") + F.lit(1.0) + symbols)
    weight = F.when(quality > 0, quality).otherwise(plain)
    return slides.withColumn("_size", word_count(F.col("text"))).withColumn(
        "_key", -F.log(draw(seed, F.col("slide_id"), F.col("_size"))) / weight).withColumn("_source", _named("source"))


def _named(column: str) -> Column:
    return F.concat(F.when(F.col(column).isNull(), "-").otherwise("+"), F.coalesce(column, F.lit("")))


def _decided(slides: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int) -> DataFrame:
    """Every slide row with its source's target, its whole epochs and if it is picked for the rest."""
    sized = _sized(slides, seed).select("slide_id", "source", "_source", "_size", "_key")
    rows = stored(sized.withColumn("_row", F.monotonically_increasing_id()), "mix-sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, most)
    # A source may hold a third of all rows: its rows meet its target in many places.
    cut = F.floor((F.lit(1.0) - F.exp(-F.col("_key"))) * F.lit(RANGES))
    spread = targets.select(_named("source").alias("_source"), "source_size", "target",
                            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    joined = rows.withColumn("_salt", F.pmod(cut, F.lit(SALTS)).cast("int")).join(spread, ["_source", "_salt"]).drop("_salt")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    joined = joined.withColumn("_epochs", epochs).withColumn(
        "_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    summed = running_sum(joined, ["_source"], ["_key", "_row"], "_size", "_upto", cut=cut)
    return summed.withColumn("_picked", (F.col("_rest") > 0) & (F.col("_size") > 0) & (
        F.col("_upto") - F.col("_size") / 2.0 <= F.col("_rest")))


def mix_sources(slides: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
                seed: int = 7) -> DataFrame:
    """How many words of each slide the mix takes.

    ``slides``: ``slide_id, text, source`` and, if wanted, ``quality`` (a positive weight; without it,
    null, or not above zero: words, plus one, to words, symbols, plus one). More columns are left aside. Returns one row for each slide row:
    ``slide_id, source, size, source_size, target, copies, taken``. A slide is taken whole: ``taken``
    is ``copies`` times ``size``, and ``copies`` is at most ``most`` rounded up. The last slide of a
    budget is the one whose middle word still lies in it. Empty and null texts have size 0 and come
    once for each whole epoch. A null source is a source of its own, the last. Rows that agree in
    id, size and quality share one key and are taken in any order among themselves (the words taken
    are the same); an empty table gives an empty result.
    """
    decided = _decided(slides, weights, share, most, seed)
    copies = (F.col("_epochs") + F.col("_picked").cast("int")).cast("bigint")
    return decided.select("slide_id", "source", F.col("_size").alias("size"), "source_size", "target",
                          copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def mixed_rows(slides: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
               seed: int = 7) -> DataFrame:
    """The slides of the mix, each as often as it is taken, with the columns they came with.

    The choice of ``mix_sources``, applied as one bound for the key of each source: texts are never shuffled.
    Rows that agree in id, size and quality are taken together.
    """
    decided = _decided(slides, weights, share, most, seed)
    bounds = decided.groupBy("_source").agg(
        F.max("_epochs").alias("_epochs"), F.max(F.when(F.col("_picked"), F.col("_key"))).alias("_bound"))
    picked = F.coalesce((F.col("_key") <= F.col("_bound")) & (F.col("_size") > 0), F.lit(False)).cast("int")
    needed = ["slide_id", "text", "source", *(["quality"] if "quality" in slides.columns else [])]
    taken = _sized(packed(slides, *needed), seed).join(bounds, "_source").withColumn(
        "_copies", (F.col("_epochs") + picked).cast("int")).where("_copies > 0")
    return unpacked(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), slides.columns)
