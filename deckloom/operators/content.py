"""Content safety: what an edit may not change, and what must not be published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deckloom.functions import text as tx
from deckloom.operators.skew import first_by

c = F.col

# Keywords of production notes (English and French).
NOTE_WORDS = (r"(?i)\b(please|add|remove|replace|move|change|update|delete|insert|duplicate|"
              r"merci|ajoute[rz]?|supprime[rz]?|remplace[rz]?|d[ée]place[rz]?|modifie[rz]?|"
              r"placeholder|dummy|production note|instruction)\b")
GRAPH_NOTE_WORDS = r"(?i)\b(please|add|remove|replace|move|change|update|placeholder|dummy)\b"

# Files and secrets that must not be published.
FORBIDDEN_SUFFIXES = [".pptx", ".pptm", ".pdf", ".png", ".jpg", ".jpeg", ".webp", ".zip"]
REQUIRED_IGNORES = [".env", ".env.*", "*.pptx", "*.pptm", "benchmarks/cache/", "benchmarks/results/",
                    "artifacts/", "out/"]
SECRET_PATTERNS = {
    "api_key": r"\bsk-(?!example|test|your)[A-Za-z0-9_-]{20,}",
    "access_token": r"\bgh[opsu]_[A-Za-z0-9]{30,}",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
}

# Violation code of each compared fact.
FACT_CODES = {
    "word": "words_changed", "number": "numbers_changed", "table": "table_data_changed",
    "chart": "chart_data_changed", "image": "images_changed",
    "logo_state": "logo_geometry_or_effect_changed", "table_count": "native_table_count_changed",
    "chart_count": "native_chart_count_changed", "relationship_hash": "protected_relationship_changed",
    "animation_hash": "animation_changed",
}
# Named checks and the code fragments that fail them.
CHECKS = {
    "slide_count": ["slide_count_changed"], "words": ["words_changed"], "numbers": ["numbers_changed"],
    "tables": ["table"], "charts": ["chart"], "assets": ["asset", "image", "logo"],
    "relationships": ["relationship"], "animations": ["animation"],
}


def tokens(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per word and number token: (keys, fact, value)."""
    both = F.array(*[F.struct(F.lit(fact).alias("fact"), values.alias("values")) for fact, values in (
        ("word", tx.words(c(text))), ("number", tx.numbers(c(text))))])
    return texts.select(*keys, F.explode(both).alias("_t")).select(*keys, "_t.fact", F.explode("_t.values").alias("value"))


def paired_tokens(pairs: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Word and number tokens of texts that stand beside their edit: (keys, fact, value, _b, _a), with 1 for the side that a row is of.

    Texts that are equal, and what the tokens of two texts begin with in common, cancel out where they are read, so that only the rest of them is
    sent on: enough for comparing how often each token is used, not for counting its uses.
    """
    none = F.array().cast("array<string>")
    split = pairs.filter(~c(before).eqNullSafe(c(after))).select(*keys, *[
        F.coalesce(read(c(side)), none).alias(f"_{fact}_{n}") for fact, read in (("word", tx.words), ("number", tx.numbers))
        for n, side in enumerate((before, after))])
    rest = [F.struct(F.lit(fact).alias("fact"), F.lit(1 - n).alias("_b"), F.lit(n).alias("_a"), values.alias("values"))
            for fact in ("word", "number") for n, values in enumerate(tx.rests(c(f"_{fact}_0"), c(f"_{fact}_1")))]
    return split.select(*keys, F.explode(F.array(*rest)).alias("_t")).select(
        *keys, "_t.fact", F.explode("_t.values").alias("value"), "_t._b", "_t._a")


def token_counts(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    return tokens(texts, keys, text).groupBy(*keys, "fact", "value").agg(F.count("*").alias("uses"))


def multiset_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose multiplicity differs, with ``change`` = after − before.

    A signed union and one combining sum: no join, and a slide with very many rows is spread
    over its values.
    """
    signed = before.select(*keys, F.lit(-1).alias("_s")).unionByName(after.select(*keys, F.lit(1).alias("_s")))
    return signed.groupBy(*keys).agg(F.sum("_s").alias("change")).filter(c("change") != 0)


def invariant_pairs(before: DataFrame, after: DataFrame, before_slides: DataFrame, after_slides: DataFrame,
                    deck: str = "deck_id", slide: str = "slide_index", paired: DataFrame | None = None) -> DataFrame:
    """Violations of a deck edit as (deck, slide, code).

    Facts are rows (deck, slide, fact, value): words, numbers and images as plain multisets,
    ordered data (tables, charts, logo states, counts, hashes) with the position inside the
    value. Logos of the source must still be among the images. Slides present on one side only
    give nothing but the deck's slide-count violation. ``paired`` has more words and numbers, of both sides (see ``paired_tokens``).
    """
    keys = [deck, slide]
    common = before_slides.select(*keys).join(after_slides.select(*keys), keys, "left_semi")

    # An image of the edit also answers for the logos of the source.
    def counted_as(side: str) -> Column:
        if side == "before":
            return F.array(c("fact"))
        return F.when(c("fact") == "image", F.array(F.lit("image"), F.lit("logo"))).when(
            c("fact") != "logo", F.array(c("fact")))

    def sided(df: DataFrame, side: str, b: int, a: int) -> DataFrame:
        return df.select(*keys, "value", F.explode(counted_as(side)).alias("fact"), F.lit(b).alias("_b"), F.lit(a).alias("_a"))

    # One signed pass over both sides, combined before the shuffle.
    sides = sided(before, "before", 1, 0).unionByName(sided(after, "after", 0, 1))
    uses = (sides if paired is None else sides.unionByName(paired)).groupBy(*keys, "fact", "value").agg(
        F.sum("_b").alias("_b"), F.sum("_a").alias("_a"))
    code = F.create_map(*[F.lit(v) for pair in FACT_CODES.items() for v in pair])
    rule = F.when(c("fact") == "logo", F.when((c("_b") > 0) & (c("_a") == 0), F.lit("logos_changed"))).when(
        c("_b") != c("_a"), F.try_element_at(code, c("fact")))
    found = uses.select(*keys, rule.alias("code")).filter(c("code").isNotNull()).distinct()
    slides = found.join(common, keys, "left_semi")

    def counted(df: DataFrame, side: int) -> DataFrame:
        return df.select(deck, F.lit(side).alias("_s"))

    counts = counted(before_slides, -1).unionByName(counted(after_slides, 1)).groupBy(deck).agg(
        F.sum("_s").alias("_d")).filter(c("_d") != 0)
    slide_type = dict(before_slides.dtypes)[slide]
    decks = counts.select(deck, F.lit(None).cast(slide_type).alias(slide), F.lit("slide_count_changed").alias("code"))
    return slides.unionByName(decks)


def check_rollup(decks: DataFrame, violations: DataFrame, deck: str = "deck_id") -> DataFrame:
    """One row per deck: each named check, and ``passed`` when there is no violation at all."""

    def broken(fragments: list[str]) -> Column:
        hit = F.lit(False)
        for f in fragments:
            hit = hit | c("code").contains(f)
        return F.bool_or(hit)

    failed = violations.groupBy(deck).agg(*[broken(f).alias(f"_{n}") for n, f in CHECKS.items()],
                                          F.count("*").alias("_all"))
    joined = decks.select(deck).distinct().join(failed, deck, "left")
    return joined.select(deck, *[(~F.coalesce(c(f"_{n}"), F.lit(False))).alias(n) for n in CHECKS],
                         c("_all").isNull().alias("passed"))


def check_map(rollup: DataFrame) -> DataFrame:
    """The named checks as one map column."""
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), c(n).alias("v")) for n in CHECKS])
    return rollup.withColumn("checks", F.map_from_entries(pairs))


def content_preserved(before: DataFrame, after: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of ``before`` missing from ``after`` with the missing count.

    Texts whose normalised form is in ``removed`` (executed notes) are not expected any more.
    """
    gone = removed.select(tx.normalize_text(c("text")).alias("_n")).distinct()
    expected = before.withColumn("_n", tx.normalize_text(c("text"))).join(gone, "_n", "left_anti")
    return multiset_changes(expected, after, [*keys, "text"]).filter(c("change") < 0).select(
        *keys, "text", (-c("change")).alias("missing"))


def missing_assets(before: DataFrame, after: DataFrame, deck: str = "deck_id") -> DataFrame:
    """Asset hashes of a deck that its edited version no longer has."""
    return before.select(deck, "sha256").subtract(after.select(deck, "sha256"))


def changed_ids(before: DataFrame, after: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Ids on one side only, and ids on both whose content differs; keys must be unique."""
    a = before.select(*keys, F.struct(*content).alias("_a"))
    b = after.select(*keys, F.struct(*content).alias("_b"))
    change = (F.when(c("_a").isNull(), "added").when(c("_b").isNull(), "removed")
              .when(~c("_a").eqNullSafe(c("_b")), "modified"))
    return a.join(b, keys, "full_outer").withColumn("change", change).filter(
        c("change").isNotNull()).select(*keys, "change")


def production_notes(shapes: DataFrame, name: str = "name", text: str = "text", bold: str = "bold",
                     minimum: int = 15) -> DataFrame:
    """Shapes that hold authoring notes: a keyword, and bold or named as an instruction."""
    identity = F.lower(F.concat(F.coalesce(c(name), F.lit("")), F.lit(" "), c(text)))
    named = identity.contains("instruction") | identity.contains("production note")
    worded = c(text).rlike(NOTE_WORDS)
    return shapes.filter((F.length(text) >= minimum) & (named | (worded & c(bold))))


def graph_notes(elements: DataFrame) -> DataFrame:
    """The same for text elements of a slide graph: id or name says so, or bold note language."""
    identity = F.lower(F.concat_ws(" ", "id", "name"))
    named = identity.contains("instruction") | identity.contains("production note")
    worded = c("bold") & c("text").rlike(GRAPH_NOTE_WORDS) & (F.length("text") >= 20)
    return elements.filter((c("kind") == "text") & (named | worded))


def first_instructions(rows: DataFrame, order: list[str], slide: str = "slide_id") -> DataFrame:
    """First instruction per (slide, source, normalised text), by priority within the slide."""
    keyed = rows.withColumn("normalized", F.lower(tx.normalize_text(c("raw_text"))))
    unique = first_by(keyed, [slide, "source", "normalized"], order)
    return unique.orderBy(slide, c("priority").desc(), *order)


def secret_scan(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Forbidden files and likely secrets as (path, rule) rows; null content is only checked by path."""
    suffix = F.lower(F.regexp_extract(c(path), r"(\.[^./]+)$", 1))
    env = F.regexp_extract(c(path), r"([^/]*)$", 1)
    rules = [("forbidden_suffix", suffix.isin(FORBIDDEN_SUFFIXES)),
             ("environment_file", (env == ".env") | (env.startswith(".env.") & (env != ".env.example")))]
    rules += [(name, c(content).rlike(pattern)) for name, pattern in SECRET_PATTERNS.items()]
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))
    return files.select(path, F.explode(hits).alias("rule"))


def missing_rules(lines: DataFrame, required: list[str] | None = None, line: str = "line") -> DataFrame:
    """Required ignore entries that no (trimmed, uncommented) line has."""
    wanted = lines.sparkSession.createDataFrame([(r,) for r in required or REQUIRED_IGNORES], "rule string")
    have = lines.select(F.trim(c(line)).alias("rule"), c(line).alias("_raw")).filter(
        (c("rule") != "") & ~F.ltrim(c("_raw")).startswith("#")).select("rule")
    return wanted.subtract(have)
