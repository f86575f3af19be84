"""Text and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns shared with the reference behaviour.
NUMBER_PATTERN = r"(?U)((?<!\w)[+-]?(?:\d{1,3}(?:[ ,.']\d{3})+|\d+)(?:[.,]\d+)?%?(?!\w))"
WORD_PATTERN = r"(\p{L}+(?:['’]\p{L}+)*)"


def normalize_text(value: Column) -> Column:
    """Non-breaking space to space, runs of white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(value, " ", " "), r"(?U)\s+", " "))


def casefold(value: Column) -> Column:
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def words(value: Column) -> Column:
    """Case-folded words in reading order.

    Texts are folded whole; only those with a letter whose small form hangs on its neighbours (Σ) or is no single letter (İ) word by word.
    """
    def found(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(1))

    return F.when(value.rlike("[Σİ]"), F.transform(found(value), casefold)).otherwise(found(casefold(value)))


def numbers(value: Column) -> Column:
    """Number tokens; only white space inside a number is dropped, so 1,5 and 1.5 differ."""
    found = F.regexp_extract_all(value, F.lit(NUMBER_PATTERN), F.lit(1))
    return F.transform(found, lambda n: F.translate(n, "  ", ""))


def rests(before: Column, after: Column) -> tuple[Column, Column]:
    """Two arrays, neither null, without the elements that they begin with in common."""
    # A longer array differs from the nulls that the shorter one is filled up with.
    differ = F.array_position(F.zip_with(before, after, lambda b, a: b.eqNullSafe(a)), F.lit(False)).cast("int")
    left, right = (F.when(differ > 0, F.slice(side, differ, F.size(side))).otherwise(F.slice(side, 1, 0)) for side in (before, after))
    return left, right


def resolve_target(source_part: Column, target: Column) -> Column:
    """Relationship target joined to the folder of its source part, dots resolved."""
    folder = F.regexp_extract(source_part, r"^(.*/)?[^/]*$", 1)
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    steps = F.filter(F.split(joined, "/"), lambda s: (s != "") & (s != "."))
    # At the package root ".." has nowhere to go up to; a relative path keeps it.
    rooted = joined.startswith("/")

    def step(done: Column, part: Column) -> Column:
        can_pop = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        popped = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        up = F.when(can_pop, popped).when(rooted, done).otherwise(F.array_append(done, part))
        return F.when(part == "..", up).otherwise(F.array_append(done, part))

    folded = F.aggregate(steps, F.array().cast("array<string>"), step)
    return F.array_join(folded, "/")


def rels_source_part(rels_name: Column) -> Column:
    """``ppt/slides/_rels/slide1.xml.rels`` → ``ppt/slides/slide1.xml``; package root → ''."""
    return F.when(rels_name == "_rels/.rels", F.lit("")).otherwise(
        F.regexp_replace(rels_name, r"^(.*/)?_rels/([^/]+)\.rels$", "$1$2")
    )


def safe_name(value: Column) -> Column:
    """Base name limited to letters, digits, dot, underscore, dash and space."""
    base = F.regexp_extract(value, r"([^/]*)/*$", 1)
    kept = F.regexp_replace(base, r"[^\p{L}\p{N}._\- ]", "")
    return F.regexp_replace(kept, r"^[ .]+|[ .]+$", "")


def payload_field(payload: Column, field: str) -> Column:
    return F.get_json_object(payload, f"$.{field}")


def iso_to_ts(value: Column) -> Column:
    """ISO-8601 text to timestamp; malformed text becomes null."""
    return F.try_to_timestamp(value)


def age_days(now: Column, then: Column) -> Column:
    """Whole days between two timestamps."""
    return F.timestamp_diff("DAY", then, now)
