"""Quality rules for slide texts: counts, and the likelihood ratio of hashed n-grams.

Words, and pairs of the forms of neighbouring words, are hashed into a fixed number of buckets. Two multinomials over the buckets, one of
trusted slides and one of all slides, give each bucket the logarithm of their ratio; a text's ratio
is the mean over its n-grams, and a text below a fixed threshold is rejected. All of it is
column expressions; no rows leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.llm.common import BLANK, let, packed, unpacked, word_list

#: Buckets of the hashed n-grams, and the count added to each bucket on both sides.
BUCKETS, ADDED = 1 << 16, 10.0
#: Texts whose mean logarithm of the ratio is lower are rejected.
THRESHOLD = -0.5
#: The trusted multinomial is fitted on so many trusted slides at most, those of the least hash.
TRUSTED_SLIDES = 20_000
#: Base rules: least number of words, and percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "[#*$%&|<>]"
#: What the form of a word puts for runs of characters.
FORMS = (("[\\p{Ll}\\p{Lo}\\p{M}]+", "a"), ("\\p{Lu}+", "A"), ("\\p{Nd}+", "0"), ("([^aA0\\x20\\x09-\\x0D])\\1+", "$1"))


def _forms(text: Column) -> Column:
    """The words of a text with runs of letters, capitals, digits and of one symbol cut to one sign."""
    short = F.coalesce(text, F.lit(""))
    for pattern, sign in FORMS:
        short = F.regexp_replace(short, pattern, sign)
    return word_list(short)


def _bucket(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def gram_buckets(words: Column, text: Column) -> Column:
    """The buckets of a text's words, then those of the pairs of forms that each word begins (the last one alone), as one array of numbers."""
    pairs = let(_forms(text), lambda forms: F.zip_with(
        forms, F.slice(forms, 2, F.greatest(F.size(forms), F.lit(1))), lambda form, then: _bucket(form, then, F.lit(2))))
    return F.concat(F.transform(words, lambda word: _bucket(word)), pairs)


def trusted_sample(trusted: DataFrame, most: int = TRUSTED_SLIDES) -> DataFrame:
    """Ids of at most ``most`` trusted slides, the same ones in every run."""
    ids = trusted.select("slide_id").where(F.col("slide_id").isNotNull()).distinct()
    return ids.orderBy(F.xxhash64("slide_id"), "slide_id").limit(most)


def fit_ratios(slides: DataFrame, trusted: DataFrame, most: int = TRUSTED_SLIDES) -> DataFrame:
    """One row with ``ratios``, an array of ``BUCKETS`` doubles.

    ``slides``: ``slide_id, text``, all of which count for the corpus; ``trusted``: ``slide_id`` of slides known to be
    good, of which at most ``most`` count (so their ids may be broadcast). Without any the ratios
    are near zero and nothing is rejected by them.
    """
    marks = F.broadcast(trusted_sample(trusted, most).withColumn("_trusted", F.lit(1)))
    grams = slides.select("slide_id", "text").join(marks, "slide_id", "left").select(
        "_trusted", F.explode(gram_buckets(word_list(F.col("text")), F.col("text"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count("_trusted").alias("n_trusted"))
    every = slides.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_trusted", F.lit(0)).alias("n_trusted"))
    rows = filled.agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "n_trusted"))).alias("b"),
                      F.sum("n").alias("all"), F.sum("n_trusted").alias("all_trusted"))
    share = F.col("all_trusted") / F.greatest(F.col("all"), F.lit(1))
    # What is added keeps the share of trusted n-grams: a rare bucket says nothing.
    return rows.withColumn("_share", share).select(F.transform("b", lambda x: F.when(F.col("_share") > 0, F.log(
        (x["n_trusted"] + F.col("_share") * ADDED) / ((x["n"] + F.lit(ADDED)) * F.col("_share")))).otherwise(
            F.lit(0.0))).alias("ratios"))


def mean_ratio(buckets: Column, ratios: Column) -> Column:
    """Mean of the ratios of a text's n-grams; zero without words."""
    total = let(ratios, lambda held: F.aggregate(buckets, F.lit(0.0), lambda t, bucket: t + F.element_at(held, bucket + 1)))
    return total / F.greatest(F.size(buckets), F.lit(1))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more.

    Windows are compared by 64-bit hashes. The hashes that occur again are found by sorting and
    parted by remainder, so that the look-up of each window stays short in long texts as well.
    """
    def windows(hashes: Column) -> Column:
        n = F.greatest(F.size(hashes) - 2, F.lit(0))
        first, second, third = (F.slice(hashes, i, n) for i in (1, 2, 3))
        return F.zip_with(F.zip_with(first, second, lambda a, b: F.xxhash64(a, b)), third, lambda ab, c: F.xxhash64(ab, c))

    def again(hashes: Column) -> Column:
        less = F.greatest(F.size(hashes) - 1, F.lit(0))
        return F.array_distinct(F.array_compact(F.zip_with(
            F.slice(hashes, 1, less), F.slice(hashes, 2, less), lambda a, b: F.when(a == b, a))))

    def covered(hashes: Column, twice: Column) -> Column:
        parts = F.greatest(F.sqrt(F.size(twice)).cast("int"), F.lit(1))
        parted = F.transform(F.sequence(F.lit(0), parts - 1), lambda r: F.filter(twice, lambda x: F.pmod(x, parts) == r))
        starts = let(parted, lambda held: F.array_compact(F.transform(
            hashes, lambda x, i: F.when(F.array_contains(held[F.pmod(x, parts).cast("int")], x), i))))
        # A window covers three words, less those that the next repeated window covers.
        return let(starts, lambda s: F.aggregate(
            F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.least(b - a, F.lit(3))), F.lit(0), lambda t, x: t + x))

    held = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    # Most texts have no window twice: that much is found without sorting.
    return let(held, lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(again(F.sort_array(hashes)), lambda twice: covered(hashes, twice)))).cast("bigint")


def quality_rules(slides: DataFrame, ratios: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``slides`` with all their columns and, in the struct ``quality``, counts and verdict.

    ``slides`` needs ``text``; ``ratios`` is a result of ``fit_ratios``. ``quality`` holds ``n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, ratio, kept``. A null text has no words and fails the base
    rules, as does an empty one. Texts are read whole; repeated rows get the same verdict; an empty
    table stays empty; a column ``quality`` that was there before is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANK}]"))
    rows = packed(slides, "text").withColumn("_words", word_list(F.col("text"))).withColumn("_lines", lines)
    n_words = F.size("_words").cast("bigint")
    rows = rows.withColumn("_repeat", repeated_words(F.col("_words"))).withColumn("_ratios", ratios.select("ratios").scalar())
    rows = rows.withColumn("_buckets", gram_buckets(F.col("_words"), F.col("text"))).withColumn("_ratio", mean_ratio(F.col("_buckets"), F.col("_ratios")))
    failed = (n_words < LEAST_WORDS) | (100 * F.col("_repeat") > MOST_REPEATED * n_words)
    counts = F.struct(
        n_words.alias("n_words"), F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"), failed.alias("base_failed"), F.col("_ratio").alias("ratio"),
        (~failed & (F.col("_ratio") >= threshold)).alias("kept"))
    return unpacked(rows.withColumn("quality", counts), slides.columns, "quality")
