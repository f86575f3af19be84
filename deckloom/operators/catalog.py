"""Template catalogue: hashes, duplicates, families and slide matching."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.operators import matching
from deckloom.operators.matching import best_matches, candidate_pairs, closest_counts, micro
from deckloom.operators.shapes import FEATURES
from deckloom.operators.skew import first_by
from deckloom.operators.stored import materialize, numbered

c = F.col

# Thresholds and archetypes.
FAMILY_THRESHOLD, NEAR_BITS, MATCH_THRESHOLD = 0.72, 4, 0.75
ARCHETYPES = ["chart", "table", "visual", "title", "dense_content", "process", "content"]


def dhash(pixels: DataFrame, image: str = "image_id", width: int = 9, height: int = 8) -> DataFrame:
    """Gradient hash per image: each pixel against its left neighbour, row by row, 16 hex digits.

    Bits are summed into two 32-bit halves, so images combine before the shuffle and nothing
    is collected into lists.
    """
    row = Window.partitionBy(image, "y").orderBy("x")
    bits = (pixels.withColumn("_left", F.lag("gray").over(row)).filter(c("x") > 0)
            .withColumn("_bit", (c("gray") >= c("_left")).cast("bigint")))
    total = height * (width - 1)
    place = F.lit(total - 1) - (c("y") * (width - 1) + c("x") - 1)
    weight = F.pow(F.lit(2.0), place % 32).cast("bigint")

    def half(high: bool) -> Column:
        mine = (place >= 32) if high else (place < 32)
        return F.sum(F.when(mine, c("_bit") * weight).otherwise(0))

    sums = bits.groupBy(image).agg(half(True).alias("_hi"), half(False).alias("_lo"))
    return sums.select(image, F.lower(F.concat(F.lpad(F.hex("_hi"), 8, "0"), F.lpad(F.hex("_lo"), 8, "0")))
                       .alias("phash"))


def _half(hash_hex: Column, high: bool) -> Column:
    return F.conv(F.substring(hash_hex, 1 if high else 9, 8), 16, 10).cast("bigint")


def majority_hash(hashes: DataFrame, keys: list[str], hash_col: str = "phash") -> DataFrame:
    """Bitwise vote of the hashes of each key; a tie sets the bit. 64 combining sums, no explode."""
    halves = hashes.select(*keys, _half(c(hash_col), True).alias("_h1"), _half(c(hash_col), False).alias("_h0"))
    votes = halves.groupBy(*keys).agg(F.count("*").alias("_n"), *[
        F.sum(F.shiftright(c(f"_h{i // 32}"), i % 32).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"_v{i}")
        for i in range(64)])

    def packed(first: int) -> Column:
        word = F.lit(0).cast("bigint")
        for i in range(32):
            word = word + F.when(c(f"_v{first + i}") * 2 >= c("_n"), F.lit(2**i)).otherwise(0)
        return F.lpad(F.hex(word), 8, "0")

    return votes.select(*keys, F.lower(F.concat(packed(32), packed(0))).alias("phash"))


def exact_duplicates(items: DataFrame, id_col: str, digest: Column) -> DataFrame:
    """Items whose content already exists under a lower id, with that id.

    The first id of each digest is a combining aggregate; the join back leaves a digest that
    holds very many items to the adaptive skew join.
    """
    keyed = items.select(id_col, digest.alias("digest"))
    first = keyed.groupBy("digest").agg(F.min(id_col).alias("existing_id"))
    return keyed.join(first, "digest").filter(c("existing_id") < c(id_col)).select(id_col, "existing_id", "digest")


def near_duplicates(items: DataFrame, id_col: str, hash_col: str = "phash", block: str | None = None,
                    radius: int = NEAR_BITS, shared_bands: int = 2, bits: int = 64,
                    catalog: DataFrame | None = None) -> DataFrame:
    """For each item the first existing id whose hash is within ``radius`` bits (same ``block``).

    Existing are the rows of ``catalog`` and the items with a lower id, in that order; a missing
    hash matches nothing. ``bits`` is the number of hash bits in use, counted from the right.

    Pigeonhole banding, exact for any radius: with radius + m bands at least m of them are equal,
    so every set of m bands is a join key (``shared_bands`` = m; a larger m makes rarer keys).
    Only distinct hashes are joined: copies of one hash are one row with its first id, and the
    join result is reduced to one minimum per hash before the items come back in.
    """
    return first_near(items, id_col, hash_col, block, radius, shared_bands, bits, catalog).drop("in_catalog")


def first_near(items: DataFrame, id_col: str, hash_col: str, block: str | None, radius: int, shared_bands: int = 2,
               bits: int = 64, catalog: DataFrame | None = None) -> DataFrame:
    """``near_duplicates`` with ``in_catalog``: whether the existing id is one of the catalogue."""
    blocks = [block] if block else []
    cols = [*blocks, id_col, hash_col]
    known = items.filter(c(hash_col).isNotNull() & (c(hash_col) != "")).select(*cols, F.lit(1).alias("_age"))
    everyone = known if catalog is None else known.unionByName(
        catalog.filter(c(hash_col).isNotNull() & (c(hash_col) != "")).select(*cols, F.lit(0).alias("_age")))
    hashes = everyone.groupBy(*blocks, c(hash_col).alias("h")).agg(
        F.min(F.struct("_age", c(id_col).alias("id"))).alias("low"))
    n = radius + shared_bands
    edges = [64 - bits + round(i * bits / n) for i in range(n + 1)]
    padded = F.concat(*[F.lpad(F.conv(F.substring(c("h"), i, 8), 16, 2), 32, "0") for i in (1, 9)])
    banded = hashes.withColumns({
        "bands": F.array(*[F.substring(padded, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(n)]),
        "hi": _half(c("h"), True), "lo": _half(c("h"), False)})
    sets = F.lit([list(s) for s in combinations(range(n), shared_bands)])
    keys = F.transform(sets, lambda s, k: F.concat_ws(":", k.cast("string"), F.transform(s, lambda i: c("bands")[i])))
    spread = banded.select(*blocks, "hi", "lo", "low", F.explode(keys).alias("band"))
    left = spread.select(*blocks, "band", "hi", "lo")
    right = spread.select(*blocks, "band", c("hi").alias("hi2"), c("lo").alias("lo2"), "low")
    gap = F.bit_count(c("hi").bitwiseXOR(c("hi2"))) + F.bit_count(c("lo").bitwiseXOR(c("lo2")))
    close = left.join(right, [*blocks, "band"]).withColumn("gap", gap).filter(c("gap") <= radius)
    earliest = close.groupBy(*blocks, "hi", "lo").agg(F.min(F.struct("low", "gap")).alias("hit"))
    placed = known.withColumns({"hi": _half(c(hash_col), True), "lo": _half(c(hash_col), False)})
    return (placed.join(earliest, [*blocks, "hi", "lo"])
            .filter(c("hit.low") < F.struct("_age", c(id_col).alias("id")))
            .select(*blocks, id_col, c("hit.low.id").alias("existing_id"), c("hit.gap").alias("distance"),
                    (c("hit.low._age") == 0).alias("in_catalog")))


def active_template_slides(slides: DataFrame, templates: DataFrame, families: DataFrame) -> DataFrame:
    """Slides whose template and family are both live."""
    live_t = templates.filter(c("active") & c("deleted_at").isNull()).select("template_id")
    live_f = families.filter("active").select("family_id")
    return slides.join(live_t, "template_id", "left_semi").join(live_f, "family_id", "left_semi")


def family_counts(families: DataFrame, templates: DataFrame) -> DataFrame:
    """Live templates per family; families without any stay with zero."""
    live = templates.filter(c("active") & c("deleted_at").isNull()).groupBy("family_id").agg(
        F.count("*").alias("_n"))
    return families.join(live, "family_id", "left").withColumn(
        "template_count", F.coalesce(c("_n"), F.lit(0))).drop("_n")


# ---- slide matching ------------------------------------------------------------------------


def _signature() -> Column:
    return F.concat_ws("|", *[c(f).cast("string") for f in FEATURES], "archetype",
                       F.array_join("dominant_colors", ","))


def template_candidates(source: DataFrame, catalog: DataFrame, source_keys: list[str], k: int = 5) -> DataFrame:
    """The k best template slides of every family for every source slide.

    ``source`` has ``source_keys``, FEATURES (none negative), archetype and dominant_colors (six at most);
    ``catalog`` has family_id, template_slide_id (bigint) and the same features. Ties go to the
    lower id. Equal slides share one signature on both sides, and of each catalogue signature at
    most k members can matter, so hot copies shrink before anything is compared. Which signatures
    are compared at all is left to the bounds of ``matching``; what was found is stored there or here.
    """
    carried = [*FEATURES, "archetype", "colors"]
    src, cat = (df.withColumn("colors", F.array_distinct("dominant_colors")).withColumn("signature", _signature()) for df in (source, catalog))
    src = materialize(src.select(*source_keys, *carried, "signature"), "match-slides")
    cat = materialize(cat.select("family_id", "template_slide_id", *carried, "signature"), "match-slides")
    src_sigs = numbered(src.groupBy("signature").agg(*[F.first(n).alias(n) for n in carried]), "source_sig",
                        "match-signatures")
    cat_sigs = numbered(cat.groupBy("family_id", "signature").agg(
        F.min("template_slide_id").alias("first_id"), *[F.first(n).alias(n) for n in carried]), "sig",
        "match-signatures")
    low = Window.partitionBy("family_id", "signature").orderBy("template_slide_id")
    members = cat.select("family_id", "signature", "template_slide_id").withColumn("_n", F.row_number().over(low)).filter(c("_n") <= k)
    known = src.select(*source_keys, "signature").join(src_sigs.select("signature", "source_sig"), "signature")
    shown = [*source_keys, "family_id", "template_slide_id", "match_rank", "structural_score", "style_score", "confidence"]
    if src_sigs.count() * cat_sigs.count() > matching.JOINED_PAIRS:
        lists = members.groupBy("family_id", "signature").agg(F.array_sort(F.collect_list("template_slide_id")).alias("members"))
        top = best_matches(src_sigs, cat_sigs.join(lists, ["family_id", "signature"]), k)
        # Lists of matches meet their slides before they are unrolled, each field as a list of its own: callers that read one carry no other.
        fields = ["template_slide_id", "structure", "style"]
        lists = top.select("source_sig", "family_id", c("matches.confidence").alias("_confidence"), *[c(f"matches.{f}").alias(f) for f in fields])
        unrolled = known.join(lists, "source_sig").select(
            *source_keys, c("family_id").cast(cat.schema["family_id"].dataType), *fields, F.posexplode("_confidence").alias("_n", "_score"))
        return unrolled.withColumns({
            "template_slide_id": F.get("template_slide_id", "_n"), "match_rank": c("_n") + 1, "structural_score": F.get("structure", "_n") / 1e6,
            "style_score": F.get("style", "_n") / 1e6, "confidence": c("_score") / 1e6}).select(*shown)
    best_sigs = Window.partitionBy("source_sig", "family_id").orderBy(c("confidence").desc(), "first_id")
    ranked = candidate_pairs(src_sigs.drop("signature"), cat_sigs.drop("signature"), k).withColumn(
        "_n", F.row_number().over(best_sigs)).filter(c("_n") <= k).drop("_n", "first_id").withColumns({
            "structural_score": micro(c("structure")) / 1e6, "style_score": micro(c("style")) / 1e6, "confidence": c("confidence") / 1e6})
    best = Window.partitionBy("source_sig", "family_id").orderBy(c("confidence").desc(), "template_slide_id")
    placed = members.join(cat_sigs.select("family_id", "signature", "sig"), ["family_id", "signature"]).select("sig", "template_slide_id")
    top = materialize(ranked.join(placed, "sig").withColumn("match_rank", F.row_number().over(best)).filter(
        c("match_rank") <= k), "match-found")
    return known.join(top, "source_sig").select(*shown)


def top_matches(candidates: DataFrame, deck: str, slide: str) -> DataFrame:
    """Candidates of each deck's best family, the first of every slide flagged ``selected``.

    The family score is the mean of the best confidences, compared as exact integer sums
    (every family has a best for every slide of the deck); ties go to the lower family.
    """
    micro = F.round(c("confidence") * 1e6).cast("bigint")
    scores = candidates.filter(c("match_rank") == 1).groupBy(deck, "family_id").agg(F.sum(micro).alias("_s"))
    # Stored, so that the join knows how small it is; and so is the answer, since callers read it several times.
    winner = materialize(scores.groupBy(deck).agg(F.min(F.struct((-c("_s")).alias("s"), "family_id")).alias("_w")).select(
        deck, c("_w.family_id").alias("family_id")), "match-winners")
    return materialize(candidates.join(winner, [deck, "family_id"]), "match-candidates").withColumn("selected", c("match_rank") == 1)


def nth_match(matches: DataFrame, keys: list[str], rank: int, threshold: float = MATCH_THRESHOLD,
              force: bool = False) -> DataFrame:
    """The rank-th (0-based) eligible match of each slide, or its last eligible one."""
    eligible = matches if force else matches.filter(c("confidence") >= threshold)
    order = Window.partitionBy(*keys).orderBy(c("confidence").desc(), "template_slide_id")
    whole = Window.partitionBy(*keys)
    numbered = eligible.withColumns({"_rn": F.row_number().over(order), "_n": F.count("*").over(whole)})
    return numbered.filter(c("_rn") == F.least(F.lit(rank + 1), c("_n"))).drop("_rn", "_n")


def rerank(matches: DataFrame, desired: DataFrame, fallback: DataFrame, keys: list[str],
           threshold: float = MATCH_THRESHOLD, forced: bool = False) -> DataFrame:
    """One pick per slide: the proposed template if eligible, else the previous pick, else the best.

    ``desired`` and ``fallback`` have ``keys`` and desired_id / fallback_id.
    """
    eligible = matches if forced else matches.filter(c("confidence") >= threshold)
    joined = eligible.join(desired, keys, "left").join(fallback, keys, "left")
    proposed = F.coalesce(c("template_slide_id") == c("desired_id"), F.lit(False))
    previous = F.coalesce(c("template_slide_id") == c("fallback_id"), F.lit(False))
    scored = joined.withColumns({"_p": F.when(proposed, 0).when(previous, 1).otherwise(2),
                                 "_c": -c("confidence")})
    picked = first_by(scored, keys, ["_p", "_c", "template_slide_id"])
    return picked.withColumn("rationale", F.when(c("_p") == 0, "proposed layout among the best candidates")
                             .otherwise("fallback after an absent or invalid proposal")
                             ).drop("_p", "_c", "desired_id", "fallback_id")


def _archetype_counts(slides: DataFrame, key: str) -> DataFrame:
    counts = slides.groupBy(key).agg(*[F.count_if(c("archetype") == a).alias(a) for a in ARCHETYPES])
    return counts.withColumn("signature", F.concat_ws("|", *[c(a).cast("string") for a in ARCHETYPES]))


def family_match(decks: DataFrame, families: DataFrame, deck: str,
                 threshold: float = FAMILY_THRESHOLD) -> DataFrame:
    """Best family of each deck by the multiset overlap of slide archetypes.

    Both inputs are slide rows with ``archetype``; ``families`` also has family_id. Below the
    threshold family_id is null and ``new_family`` holds the deck's signature: unmatched decks
    with equal signatures form one new family. ``score`` is that of the best family, if any has a slide in common.
    """
    deck_rows, fam = _archetype_counts(decks, deck), _archetype_counts(families, "family_id")
    deck_rows = materialize(deck_rows, "family-decks")
    sigs = numbered(deck_rows.groupBy("signature", *ARCHETYPES).count().drop("count"), "source_sig", "family-signatures")
    fam_sigs = numbered(fam.groupBy("signature", *ARCHETYPES).agg(F.min("family_id").alias("family_id")), "sig",
                        "family-signatures")
    best = closest_counts(sigs.drop("signature"), fam_sigs.drop("signature"), ARCHETYPES).join(
        sigs.select("source_sig", "signature"), "source_sig")
    fits = -c("_b.s") >= threshold
    return deck_rows.select(deck, "signature").join(best, "signature", "left").select(
        deck, F.when(fits, c("_b.family_id")).alias("family_id"), F.round(-c("_b.s"), 6).alias("score"),
        F.when(fits, F.lit(None)).otherwise(c("signature")).alias("new_family"))


# ---- catalogue updates: every function returns the new table ---------------------------------


def merge_families(templates: DataFrame, families: DataFrame, target, sources: DataFrame, now: Column
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move the templates of the source families to ``target`` and switch the sources off.

    Returns (templates, families, rejected ids). ``sources`` has a family_id column; the target
    itself is ignored, unknown ids are rejected.
    """
    wanted = sources.select("family_id").distinct().filter(c("family_id") != F.lit(target))
    rejected = wanted.join(families.select("family_id"), "family_id", "left_anti")
    valid = wanted.join(families.select("family_id"), "family_id", "left_semi").withColumn("_hit", F.lit(True))
    moved = templates.join(valid, "family_id", "left").withColumns({
        "family_id": F.when(c("_hit"), F.lit(target)).otherwise(c("family_id")),
        "updated_at": F.when(c("_hit"), now).otherwise(c("updated_at"))}).drop("_hit")
    switched = families.join(valid, "family_id", "left").withColumns({
        "active": F.when(c("_hit"), F.lit(False)).otherwise(c("active")),
        "updated_at": F.when(c("_hit"), now).otherwise(c("updated_at"))}).drop("_hit")
    return moved, switched, rejected


def split_family(templates: DataFrame, family, chosen: DataFrame, new_id, now: Column) -> tuple[DataFrame, DataFrame]:
    """Move ``chosen`` templates of a family to a new one; ids outside the family are rejected."""
    wanted = chosen.select("template_id").distinct()
    own = templates.filter(c("family_id") == F.lit(family)).select("template_id")
    rejected = wanted.join(own, "template_id", "left_anti")
    hits = wanted.join(own, "template_id", "left_semi").withColumn("_hit", F.lit(True))
    moved = templates.join(hits, "template_id", "left").withColumns({
        "family_id": F.when(c("_hit"), F.lit(new_id)).otherwise(c("family_id")),
        "updated_at": F.when(c("_hit"), now).otherwise(c("updated_at"))}).drop("_hit")
    return moved, rejected


def _flag(table: DataFrame, ids: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    hits = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return table.join(hits, key, "left").withColumns(
        {n: F.when(c("_hit"), v).otherwise(c(n)) for n, v in changes.items()}).drop("_hit")


def soft_delete(templates: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return _flag(templates, ids, "template_id", {"active": F.lit(False), "deleted_at": now, "updated_at": now})


def restore(templates: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return _flag(templates, ids, "template_id",
                 {"active": F.lit(True), "deleted_at": F.lit(None).cast("timestamp"), "updated_at": now})


def rename_family(families: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """New names by family_id (column new_name), trimmed; a null name only touches the stamp."""
    joined = families.join(names.select("family_id", "new_name", F.lit(True).alias("_hit")), "family_id", "left")
    return joined.withColumns({
        "name": F.coalesce(F.trim("new_name"), c("name")),
        "updated_at": F.when(c("_hit"), now).otherwise(c("updated_at"))}).drop("new_name", "_hit")


def reindex_report(templates: DataFrame, version: int) -> DataFrame:
    return templates.agg(
        F.count_if(c("index_version") < version).alias("reindexed"),
        F.count_if(c("index_version") >= version).alias("skipped"),
    ).withColumn("index_version", F.lit(version))


def stale_templates(templates: DataFrame, version: int) -> DataFrame:
    """Templates whose features must be recomputed."""
    return templates.filter(c("index_version") < version)
