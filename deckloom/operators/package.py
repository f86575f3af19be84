"""Package audits over part, relationship and slide-markup rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# Mandatory parts, portable fonts, protected relationship markers.
REQUIRED_PARTS = ["[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels"]
PORTABLE_FONTS = ["aptos", "aptos display", "arial", "arial narrow", "calibri", "cambria", "courier new",
                  "georgia", "tahoma", "times new roman", "trebuchet ms", "verdana"]
PROTECTED_MARKERS = ["/oleObject", "/audio", "/video", "/diagram", "/package"]
# Markup counted by the audit.
AUDIT_TAGS = {
    "native_shape_objects": "<p:sp>", "native_text_runs": "<a:t>", "picture_objects": "<p:pic>",
    "custom_geometry_paths": "<a:custGeom>", "cubic_bezier_segments": "<a:cubicBezTo>",
    "native_gradient_fills": "<a:gradFill",
}
SLIDE_PART = r"^ppt/slides/slide[^/]*\.xml$"


def tag_count(text: Column, tag: str) -> Column:
    """Non-overlapping occurrences of a literal tag."""
    cut = F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit("")))
    return F.coalesce(F.floor(cut / F.lit(len(tag))), F.lit(0))


def package_audit(parts: DataFrame, overflow: DataFrame | None = None, deck: str = "deck_id") -> DataFrame:
    """Per deck: slides, native objects, text runs, pictures, media, paths, curves, gradients, overflow."""
    slide = c("part_name").rlike(SLIDE_PART)
    sums = [F.sum(F.when(slide, tag_count(c("xml"), tag)).otherwise(0)).alias(name)
            for name, tag in AUDIT_TAGS.items()]
    audit = parts.groupBy(deck).agg(F.count_if(slide).alias("slides"), *sums,
                                    F.count_if(c("part_name").startswith("ppt/media/")).alias("media_files"))
    if overflow is None:
        return audit.withColumn("canvas_overflow_count", F.lit(0).cast("bigint"))
    over = overflow.groupBy(deck).agg(F.count("*").alias("_o"))
    return audit.join(over, deck, "left").withColumn(
        "canvas_overflow_count", F.coalesce(c("_o"), F.lit(0))).drop("_o")


def roundtrip_stability(before: DataFrame, after: DataFrame, structure: DataFrame, deck: str = "deck_id",
                        minimum: float = 0.98) -> DataFrame:
    """Object counts unchanged, text kept, no overflow and structure score high after a round trip."""
    counts = ["native_shape_objects", "picture_objects", "custom_geometry_paths", "native_text_runs"]
    a = before.select(deck, *[c(n).alias(f"before_{n}") for n in counts])
    b = after.select(deck, *[c(n).alias(f"after_{n}") for n in counts], "canvas_overflow_count")
    out = a.join(b, deck).join(structure.select(deck, "structural_score"), deck, "left")
    deltas = {f"delta_{n}": c(f"after_{n}") - c(f"before_{n}") for n in counts}
    out = out.withColumns(deltas)
    stable = (c("delta_native_shape_objects") == 0) & (c("delta_picture_objects") == 0) & (
        c("delta_custom_geometry_paths") == 0)
    text = (c("before_native_text_runs") == 0) | (c("after_native_text_runs") > 0)
    ok = stable & text & (c("canvas_overflow_count") == 0) & (
        F.coalesce(c("structural_score"), F.lit(0.0)) >= minimum)
    return out.withColumns({"object_count_stable": stable, "text_preserved": text, "compatible": ok})


def broken_relationships(rels: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Internal relationships whose target part is absent; ``keys`` name the target in both tables."""
    return rels.filter(~c("is_external")).join(parts.select(*keys), keys, "left_anti")


def required_parts(parts: DataFrame, deck: str = "deck_id", required: list[str] | None = None) -> DataFrame:
    """Mandatory parts absent per deck: the list is unrolled per deck, then matched by key."""
    names = F.explode(F.array(*[F.lit(r) for r in required or REQUIRED_PARTS]))
    wanted = parts.select(deck).distinct().withColumn("part_name", names)
    return wanted.join(parts.select(deck, "part_name"), [deck, "part_name"], "left_anti")


def rebuild_blockers(parts: DataFrame, deck: str = "deck_id") -> DataFrame:
    """Sorted reasons per deck why it cannot be rebuilt: embedded objects, diagrams, animations."""
    name = c("part_name")
    timeline = name.rlike(SLIDE_PART) & c("xml").contains("<p:timing")
    reasons = F.array_compact(F.array(
        F.when(name.startswith("ppt/embeddings/"), "embedded_or_ole_object"),
        F.when(name.startswith("ppt/diagrams/"), "smartart_or_diagram"),
        F.when(timeline, "animation_timeline")))
    rows = parts.select(deck, F.explode(reasons).alias("reason")).distinct()
    # Three reasons at most.
    return rows.groupBy(deck).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def markup_violations(slides: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """Broken markup values per slide as (keys, rule, count): extents, auto-fit, gradient stops, alpha.

    A path is only evaluated where a pattern finds a value that is not plainly right (and, for the order of stops, places that
    do not rise through the whole text), which spares most parsing.
    """
    percent = "@{0} >= 0 and @{0} <= 100000 and floor(@{0}) = number(@{0})"
    plain = r'"(?:\d{1,5}|100000)"'
    stop = r"<a:gs(?=[\s/>])"

    def odd(pattern: str) -> Column:
        return c(xml).rlike(pattern)

    # Stops whose places stand first, in a text where nothing else has a place.
    places = F.regexp_extract_all(xml, F.lit(r'<a:gs\s+pos="(\d{1,9})"'), F.lit(1)).cast("array<bigint>")
    stops = F.regexp_count(xml, F.lit(stop))
    sorted_out = (F.size(places) == stops) & (F.regexp_count(xml, F.lit(r"\bpos\b")) == stops) & (F.array_sort(places) == places)
    rules = [
        ("invalid_extent", odd(r'<a:ext(?=[\s/>])(?!\s+cx="\d{1,15}"\s+cy="\d{1,15}"\s*/?>)'),
         "//*[name()='a:ext'][@cx or @cy][not(@cx >= 0 and @cy >= 0 and floor(@cx) = number(@cx) and floor(@cy) = number(@cy))]"),
        ("invalid_font_scale", odd(rf"\bfontScale\b(?!={plain})"),
         f"//*[name()='a:normAutofit'][@fontScale][not({percent.format('fontScale')})]"),
        ("invalid_line_reduction", odd(rf"\blnSpcReduction\b(?!={plain})"),
         f"//*[name()='a:normAutofit'][@lnSpcReduction][not({percent.format('lnSpcReduction')})]"),
        ("invalid_stop_position", odd(rf"{stop}(?!\s+pos={plain}\s*/?>)"), f"//*[name()='a:gs'][not({percent.format('pos')})]"),
        ("invalid_stop_alpha", odd(rf"<a:alpha(?=[\s/>])(?!\s+val={plain}\s*/?>)"),
         f"//*[name()='a:gs']//*[name()='a:alpha'][not({percent.format('val')})]"),
        ("stops_out_of_order", odd(stop) & ~sorted_out, "//*[name()='a:gradFill'][.//*[name()='a:gs'][@pos < preceding-sibling::*/@pos]]"),
    ]
    found = F.array(*[F.struct(F.lit(code).alias("rule"), F.when(
        asked, F.xpath_int(c(xml), F.lit(f"count({path})"))).alias("uses")) for code, asked, path in rules])
    return slides.select(*keys, F.explode(F.filter(found, lambda r: r.uses > 0)).alias("_r")).select(
        *keys, "_r.rule", "_r.uses")


def fonts_used(runs: DataFrame, deck: str = "deck_id", font: str = "typeface") -> DataFrame:
    """Distinct typefaces per deck with a portable flag; theme references (+mn-lt) are not fonts."""
    name = F.trim(c(font))
    return (runs.select(deck, name.alias(font)).filter((c(font) != "") & ~c(font).startswith("+")).distinct()
            .withColumn("portable", F.lower(font).isin(PORTABLE_FONTS)))


def portable_font(font: Column) -> Column:
    """A portable replacement, or the font itself when it is portable."""
    low = F.lower(font)
    return (F.when(F.trim(low).isin(PORTABLE_FONTS), font)
            .when(low.rlike("serif|times|georgia|cambria"), "Times New Roman")
            .when(low.rlike("mono|code|courier"), "Courier New").otherwise("Arial"))


def portable_fonts(runs: DataFrame, font: str = "font_family") -> DataFrame:
    """Runs with a portable ``font_family`` and the requested one, null where nothing changed."""
    new = portable_font(c(font))
    return runs.withColumns({"requested_font": F.when(new != c(font), c(font)), font: new})


def fingerprint(rows: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Order-free hash of the rows of each key.

    The row digests are summed in eight 28-bit words (no overflow below 2^35 rows), so a key with
    very many rows combines before the shuffle in place of being collected and sorted. Equal
    multisets, equal hash.
    """
    digest = F.sha2(F.to_json(F.struct(*parts)), 256)
    hashed = rows.select(*keys, digest.alias("_d"))
    words = [F.conv(F.substring("_d", 1 + 8 * i, 7), 16, 10).cast("bigint") for i in range(8)]
    sums = hashed.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)])
    return sums.select(*keys, F.sha2(F.concat_ws(
        ":", c("_n").cast("string"), *[c(f"_w{i}").cast("string") for i in range(8)]), 256).alias("fingerprint"))


def protected_relationships(rels: DataFrame, parts: DataFrame, deck: str = "deck_id") -> DataFrame:
    """Embedded, media and diagram relationships with the digest of their target part."""
    marked = F.lit(False)
    for m in PROTECTED_MARKERS:
        marked = marked | c("rel_type").contains(m)
    digests = parts.select(deck, c("part_name").alias("target"), "sha256")
    return rels.filter(~c("is_external") & marked).join(digests, [deck, "target"], "left").withColumn(
        "sha256", F.coalesce("sha256", F.lit("missing")))
