"""Best matches between slide signatures, found by joins that score bounds keep small.

Few signatures are matched by joins of columns (``candidate_pairs``), many by ``best_matches``: slides and templates meet on sets of
common colours, and of all that meet only the best of each slide and family leave the task.

Catalogue signatures lie in cells of like features; of every cell the least and most of each feature are known. No match of
a slide in a cell can score more than its nearest point of that box allows, and no match with ``i`` colours in common more
than ``i`` common colours allow. A first join of sets of equal colours gives each slide and family scores that are reached for
certain; after that only the cells and numbers of common colours whose bound reaches these are joined, on the cell and a set of so
many colours, and scored as columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.functions.values import numeric_similarity
from deckloom.operators.scoring import MATCH, SAME_ARCHETYPE, STRUCTURE_WEIGHT, STYLE_WEIGHT, answering
from deckloom.operators.shapes import FEATURES
from deckloom.operators.stored import materialize

c = F.col

#: Steps of a cell: for counts a doubling, for mean sizes a half of one; what lies beyond the last step shares it.
STEPS_OF = {f: 24 if f.startswith("mean_") else 6 if f in ("shape_count", "text_count") else 2 for f in FEATURES}
#: Room for what the arithmetic of a bound may lose against that of a score.
LEEWAY = 1e-9
#: So many catalogue signatures at most (64 rows of about 200 bytes each) are sent to all executors; more are joined by a shuffle.
BROADCAST_SIGNATURES = 2000
#: So many pairs of signatures at most are left to joins of columns.
JOINED_PAIRS = 1_000_000
#: Families of so many signatures at most are compared whole, so many of these signatures at a time.
WHOLE, AT_ONCE = 2000, 20_000
#: Pairs of a unit at most: slides of a larger one are dealt to several. Pairs of a task.
UNIT_PAIRS, TASK_PAIRS = 200_000_000, 100_000_000
#: Steps of a quarter that the largest total is away from the least.
STEPS = 200
#: Colours of a signature.
MOST_COLORS = 6
CARRIED = [*FEATURES, "archetype", "colors"]


def micro(score: Column) -> Column:
    """Scores in millionths, rounded half up: whole numbers, so that ties are ties."""
    return F.floor(score * 1e6 + 0.5)


def cell_of() -> Column:
    """The cell of a signature: its archetype and the step of each feature."""
    steps = [F.least(F.floor(F.log2(c(f) + 1.0) * (2 if f.startswith("mean_") else 1)), F.lit(most)) for f, most in STEPS_OF.items()]
    return F.concat_ws("|", "archetype", *[s.cast("string") for s in steps])


def subsets(colors: Column) -> Column:
    """All sets of an array of distinct colours (six at most) in order, each with its size and a hash of its colours."""
    start = F.array(F.array().cast("array<bigint>"))
    sets = F.aggregate(colors, start, lambda held, color: F.concat(held, F.transform(held, lambda s: F.array_append(s, color))))
    return F.transform(sets, lambda s: F.struct(F.size(s).alias("size"), F.xxhash64(s).alias("key"), s.alias("colors")))


def scored(pairs: DataFrame, common: Column) -> DataFrame:
    """Adds structure, style and, in millionths, confidence to pairs of the structs ``src`` and ``tpl`` with so many ``common`` colours.

    The two parts are made as a row of their own: what reads them does not compute them again.
    """
    base = numeric_similarity([(c(f"src.{f}"), c(f"tpl.{f}")) for f in FEATURES])
    bonus = F.when(c("src.archetype") == c("tpl.archetype"), F.lit(SAME_ARCHETYPE)).otherwise(F.lit(0.0))
    union = F.size("src.colors") + F.size("tpl.colors") - common
    parts = F.struct(F.least(F.lit(1.0), base + bonus).alias("structure"), F.when(union == 0, F.lit(1.0)).otherwise(common / union).alias("style"))
    return pairs.withColumn("_parts", F.explode(F.array(parts))).withColumn("_confidence", micro(
        F.lit(STRUCTURE_WEIGHT) * c("_parts.structure") + F.lit(STYLE_WEIGHT) * c("_parts.style")))


def structure_bound(own: str, box: str, least: str = "", most: str = "") -> Column:
    """The most that the structure score of a struct ``own`` (a signature, or a box with prefixes of its edges) can be within a box."""
    total = F.lit(0.0)
    for f in FEATURES:
        a_low, a_high, low, high = c(f"{own}.{least}{f}"), c(f"{own}.{most}{f}"), c(f"{box}.least_{f}"), c(f"{box}.most_{f}")
        total = total + F.when(a_high < low, F.lit(1.0) - (low - a_high) / F.greatest(low, F.lit(1.0))).when(
            a_low > high, F.lit(1.0) - (a_low - high) / F.greatest(a_low, F.lit(1.0))).otherwise(F.lit(1.0))
    base = total / F.lit(float(len(FEATURES)))
    return F.when(c(f"{own}.archetype") == c(f"{box}.archetype"), F.least(F.lit(1.0), base + SAME_ARCHETYPE)).otherwise(base)


def style_bound(common: Column, own_size: Column, least: Column) -> Column:
    """The most that the style score can be with ``common`` colours shared, where the other side has at least ``least``."""
    other = F.greatest(common, least)
    return F.when((own_size == 0) & (other == 0), F.lit(1.0)).otherwise(common / F.greatest(own_size + other - common, F.lit(1)))


def _lookup(df: DataFrame, small: bool) -> DataFrame:
    """A side that grows with the catalogue, marked for all executors if small, else for a shuffle.

    Spark judges a stored table by its compressed files and an exploded one by its rows before, and would send gigabytes through the driver.
    """
    return F.broadcast(df) if small else df.hint("merge")


def _may_reach(structure: Column, style: Column, reached: Column) -> Column:
    return micro(F.lit(STRUCTURE_WEIGHT) * structure + F.lit(STYLE_WEIGHT) * style + LEEWAY) >= reached


def _reached(source: DataFrame, catalog: DataFrame, cell_bounds: DataFrame, k: int, small: bool) -> DataFrame:
    """``source_sig, family_id, reached``: a score (millionths) that k catalogue signatures of the family reach (all, if it has fewer).

    Of each family two lists of signatures are scored: the first ones that have the largest set of the slide's colours that
    k signatures have, and the first ones of the cells whose bound is highest for the slide's cell. The worst of either counts.
    """
    first = Window.partitionBy("family_id", "place").orderBy("sig")
    heads = catalog.select("family_id", "sig", F.explode(F.transform(subsets(c("colors")), lambda s: s["key"])).alias("place")).withColumn(
        "_n", F.row_number().over(first)).where(c("_n") <= k)
    colored = materialize(heads.groupBy("family_id", "place").agg(F.collect_list("sig").alias("sigs")).where(
        (F.size("sigs") >= k) | (c("place") == F.xxhash64(F.array().cast("array<bigint>")))), "match-seeds")
    sets = source.select("colors_key", "colors").dropDuplicates(["colors_key"]).select("colors_key", F.explode(subsets(c("colors"))).alias("s"))
    if not small:
        colored = _lookup(colored, False)
    places = colored.select("family_id", "place")
    by_color = sets.join(places, c("s.key") == c("place")).groupBy("colors_key", "family_id").agg(
        F.max(F.struct(c("s.size").alias("size"), c("place").alias("place")))["place"].alias("place"))
    tries = source.join(by_color, "colors_key").join(colored, ["family_id", "place"])

    # Every cell has a member, so the nearest few cells have enough of them.
    nearest = Window.partitionBy("own_cell", "family_id").orderBy(c("bound").desc(), "cell")
    by_cell = cell_bounds.withColumn("_n", F.row_number().over(nearest)).where(c("_n") <= k).select("own_cell", "family_id", "cell", "_n")
    members = catalog.select("family_id", "cell", "sig").withColumn("_m", F.row_number().over(
        Window.partitionBy("family_id", "cell").orderBy("sig"))).where(c("_m") <= k)
    listed = by_cell.join(members, ["family_id", "cell"]).withColumn("_n", F.row_number().over(
        Window.partitionBy("own_cell", "family_id").orderBy("_n", "_m"))).where(c("_n") <= k)
    near = materialize(listed.groupBy("own_cell", "family_id").agg(F.collect_list("sig").alias("sigs")), "match-near")
    by_place = source.withColumn("own_cell", c("cell")).join(near, "own_cell")

    def chosen(lists: DataFrame, no: int) -> DataFrame:
        return lists.select("source_sig", F.struct(*CARRIED).alias("src"), "family_id", F.lit(no).alias("list"), F.explode("sigs").alias("sig"))

    bodies = catalog.select("sig", F.struct(*CARRIED).alias("tpl"))
    pairs = chosen(tries, 0).union(chosen(by_place, 1)).join(_lookup(bodies, small), "sig")
    worst = scored(pairs, F.size(F.array_intersect("src.colors", "tpl.colors"))).groupBy("source_sig", "family_id", "list").agg(
        F.min("_confidence").alias("reached"))
    return worst.groupBy("source_sig", "family_id").agg(F.max("reached").alias("reached"))


def candidate_pairs(source: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """``source_sig, family_id, sig, first_id, structure, style, confidence`` (millionths) of every pair that may be among the best k.

    ``source``: ``source_sig``, FEATURES, archetype, ``colors`` (distinct, six at most); ``catalog``: ``family_id, sig, first_id`` and the same. Both
    are stored tables of distinct signatures; colours are compared by 64-bit hashes. Pairs that cannot reach what k others reach are left out before they are scored.
    """
    source, catalog = (df.withColumn("colors", F.array_sort(F.transform("colors", lambda x: F.xxhash64(x)))) for df in (source, catalog))
    source = materialize(source.withColumns({"cell": cell_of(), "colors_key": F.xxhash64("colors"),
                                             "sets": subsets(c("colors"))}), "match-source")
    small = catalog.count() <= BROADCAST_SIGNATURES
    catalog = materialize(catalog.withColumn("cell", cell_of()), "match-catalog")
    edges = [f(n).alias(f"{name}_{n}") for n in FEATURES for f, name in ((F.min, "least"), (F.max, "most"))]
    boxes = catalog.groupBy("family_id", "cell").agg(F.first("archetype").alias("archetype"), *edges, F.min(F.size("colors")).alias("least_colors"),
                                                     F.max(F.size("colors")).alias("most_colors"))
    boxes = boxes.select("family_id", "cell", F.struct(*[n for n in boxes.columns if n not in ("family_id", "cell")]).alias("box"))
    own_boxes = source.groupBy("cell").agg(F.first("archetype").alias("archetype"), *edges)
    own_boxes = own_boxes.select(c("cell").alias("own_cell"), F.struct(*own_boxes.columns[1:]).alias("own"))
    # Cells against the cells of each family: a grid of steps, however many rows lie in it.
    families = boxes.select("family_id").distinct()
    asked = own_boxes.withColumn("family_id", F.explode(families.agg(F.collect_list("family_id")).scalar()))
    cell_bounds = materialize(asked.join(boxes, "family_id").select(
        "own_cell", "family_id", "cell", "box", structure_bound("own", "box", "least_", "most_").alias("bound")), "match-cells")

    reached = materialize(_reached(source, catalog, cell_bounds.drop("box"), k, small), "match-reached")
    slides = source.select("source_sig", c("cell").alias("own_cell"), "sets", F.struct(*CARRIED).alias("src")).join(reached, "source_sig")
    near = slides.join(cell_bounds, ["own_cell", "family_id"]).where(_may_reach(c("bound"), F.lit(1.0), c("reached"))).select(
        "source_sig", "family_id", "cell", "src", "reached", "sets", structure_bound("src", "box").alias("_bound"),
        c("box.least_colors").alias("_least"), c("box.most_colors").alias("_most"))
    # The fewest common colours with which a match in the cell may still count: the more there are, the higher the bound.
    few = F.least(*[F.when(_may_reach(c("_bound"), style_bound(F.lit(i), F.size("src.colors"), c("_least")), c("reached")), i).otherwise(
        MOST_COLORS + 1) for i in range(MOST_COLORS + 1)])
    asking = near.withColumn("_few", F.explode(F.array(few))).where(c("_few") <= c("_most")).select(
        "source_sig", "family_id", "cell", "src", "reached", "_few", F.explode("sets").alias("_set")).where(c("_set.size") == c("_few"))
    index = catalog.select("family_id", "cell", "sig", "first_id", F.struct(*CARRIED).alias("tpl"), F.explode(
        F.transform(subsets(c("colors")), lambda s: s["key"])).alias("_key"))
    found = asking.withColumn("_key", c("_set.key")).join(_lookup(index, small), ["family_id", "cell", "_key"])
    # A pair meets at several sets if it has more colours in common; the set of the first ones counts.
    both = F.array_intersect("src.colors", "tpl.colors")
    met = found.withColumn("_common", F.explode(F.array(F.when(F.slice(both, 1, c("_few")) == c("_set.colors"), F.size(both))))).where("_common IS NOT NULL")
    return scored(met, c("_common")).where(c("_confidence") >= c("reached")).select(
        "source_sig", "family_id", "sig", "first_id", c("_parts.structure").alias("structure"), c("_parts.style").alias("style"),
        c("_confidence").alias("confidence"))


# ---- many signatures ---------------------------------------------------------------------------


def _plain(df: DataFrame, no_archetype: int, *more: str) -> DataFrame:
    """Rows as numbers: features, archetype and colours by their hashes. Rows without all features match nothing."""
    archetype = F.coalesce(F.when(c("archetype").isNotNull(), F.xxhash64("archetype")), F.lit(no_archetype).cast("bigint"))
    return df.where(" AND ".join(f"{f} IS NOT NULL" for f in FEATURES)).select(
        *more, *[c(f).cast("double").alias(f) for f in FEATURES], archetype.alias("archetype"),
        F.array_sort(F.transform("colors", lambda x: F.xxhash64(x))).alias("colors"))


def _answered(asks: DataFrame, templates: DataFrame, k: int) -> DataFrame:
    """Rows that ask (``key``, a slide, ``wanted`` families and what they ``held``) with their best ``matches`` for each wanted family.

    ``templates`` are rows by ``key``. One exchange brings both together; a key with many pairs is parted by its slides.
    """
    spark = asks.sparkSession
    sizes = asks.groupBy("key").agg(F.count(F.lit(1)).alias("n_asks")).join(
        templates.groupBy("key").agg(F.count(F.lit(1)).alias("n_templates")), "key")
    pairs = c("n_asks") * c("n_templates")
    sizes = materialize(sizes.select("key", pairs.alias("pairs"), F.ceil(pairs / UNIT_PAIRS).cast("int").alias("parts")), "match-units")
    total = sizes.agg(F.sum("pairs")).first()[0] or 0
    tasks = int(min(max(total // TASK_PAIRS, int(spark.conf.get("spark.sql.shuffle.partitions"))), 10_000))
    # A row for each unit that has pairs for several tasks.
    large = F.broadcast(sizes.where("parts > 1").select("key", "parts"))
    asking = asks.join(large, "key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("source_sig"), c("parts")), F.lit(0)).cast("int"))
    offered = templates.join(sizes, "key").withColumn("part", F.explode(F.sequence(F.lit(0), c("parts") - 1)))
    both = offered.select("key", "part", F.lit(0).alias("asks"), "family_id", "sig", "first_id", "members", *FEATURES, "archetype", "colors").unionByName(
        asking.select("key", "part", F.lit(1).alias("asks"), "source_sig", "wanted", "held", *FEATURES, "archetype", "colors", "level", "turn"),
        allowMissingColumns=True)
    match = ", ".join(f"{n}: {t}" for n, t in MATCH.items())
    carried = ", ".join(f"{f} double" for f in FEATURES)
    return both.repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "asks", "family_id", "first_id").mapInArrow(
        answering(FEATURES, k), f"source_sig bigint, {carried}, archetype bigint, colors array<bigint>, level int, turn int, family_id bigint, "
                                f"matches array<struct<{match}>>")


def _turns(level: Column) -> Column:
    """Groups that a slide's colours are parted in, so that a template with ``level`` of them has all colours of some group."""
    return F.when(level == 0, 1).otherwise(F.size("colors") - level + 1)


def _group_key(level: Column, turn: Column) -> Column:
    start, end = (F.floor(n * F.size("colors") / _turns(level)).cast("int") for n in (turn, turn + 1))
    return F.xxhash64(F.when(level == 0, F.array().cast("array<bigint>")).otherwise(F.slice("colors", start + 1, end - start)))


def best_matches(source: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """``source_sig, family_id, matches``: the k best template slides of every family for each slide signature, by confidence and then id.

    ``source`` is as in ``candidate_pairs``, ``catalog`` as well, with ``members``: the k lowest template slides of each signature. Families are numbers.
    Families of few signatures are compared whole. For the others a slide first meets the templates that have all of its colours (``level``), and goes on to
    those with one colour less as long as their bound reaches its k-th best score. Templates with at least ``level`` of its colours have all
    colours of one of ``_turns`` groups: the slide asks for one group after the other. Every row keeps what it found, so all that is
    exchanged is one row for each slide and family that still asks, and the templates asked for.
    """
    source = materialize(_plain(source, -1, "source_sig"), "match-source")
    catalog = materialize(_plain(catalog, -2, c("family_id").cast("bigint").alias("family_id"), "sig", "first_id", "members").where(
        "family_id IS NOT NULL"), "match-catalog")
    edges = [f(n).alias(f"{name}_{n}") for n in FEATURES for f, name in ((F.min, "least"), (F.max, "most"))]
    families = materialize(catalog.groupBy("family_id").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("archetype").alias("archetypes"), F.min(F.size("colors")).alias("least_colors"), *edges), "match-families")
    whole = c("n") <= max(WHOLE, k)
    kinds = families.select("family_id", whole.alias("whole"))
    nothing = F.array().cast(f"array<struct<{', '.join(f'{n}: {t}' for n, t in MATCH.items())}>>")
    unasked = [F.lit(0).alias("level"), F.lit(0).alias("turn"), nothing.alias("held")]
    done = []

    small = catalog.join(kinds, "family_id").where("whole").drop("whole")
    chunks = -(-(families.where(whole).agg(F.sum("n")).first()[0] or 0) // AT_ONCE)
    if chunks or families.isEmpty():
        asks = source.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(chunks, 1) - 1).cast("bigint"))).alias("key"),
                             F.lit(None).cast("array<bigint>").alias("wanted"), *unasked)
        offered = small.withColumn("key", F.pmod(F.xxhash64("family_id"), F.lit(max(chunks, 1))).cast("bigint"))
        done.append(materialize(_answered(asks, offered, k).select("source_sig", "family_id", "matches"), "match-found"))

    if families.where(~whole).isEmpty():
        return _all(done)
    large = catalog.join(kinds, "family_id").where("NOT whole").drop("whole")
    offered = large.withColumn("key", F.explode(F.transform(subsets(c("colors")), lambda s: s["key"])))
    named = families.where(~whole).agg(F.collect_list("family_id"))
    asks = source.withColumns({"wanted": named.scalar(), "level": F.size("colors"), "turn": F.lit(0), "held": nothing})
    while True:
        found = _answered(asks.withColumn("key", _group_key(c("level"), c("turn"))), offered, k).join(families, "family_id")
        own = F.struct(*FEATURES, "archetype", "colors")
        box = F.struct(F.when(F.array_contains("archetypes", c("archetype")), c("archetype")).alias("archetype"),
                       *[f"{name}_{n}" for n in FEATURES for name in ("least", "most")])
        found = found.withColumns({"own": own, "box": box, "reached": F.coalesce(F.get("matches", F.lit(k - 1))["confidence"], F.lit(-1))})
        found = found.withColumn("_bound", F.explode(F.array(structure_bound("own", "box"))))

        def reaches(level: Column) -> Column:
            return _may_reach(c("_bound"), style_bound(level, F.size("colors"), c("least_colors")), c("reached"))

        again = (c("turn") + 1 < _turns(c("level"))) & reaches(c("level"))
        lower = (c("level") > 0) & reaches(c("level") - 1)
        step = F.when(again, F.struct(c("level"), (c("turn") + 1).alias("turn"))).when(lower, F.struct((c("level") - 1).alias("level"), F.lit(0).alias("turn")))
        # What a slide found at a level, it finds again at the next one.
        found = materialize(found.withColumn("step", step).select(
            "source_sig", "family_id", "step", F.when(c("step").isNotNull(), c("own")).alias("own"),
            F.when(c("step").isNull() | again, c("matches")).alias("matches")), "match-found")
        done.append(found.where("step IS NULL").select("source_sig", "family_id", "matches"))
        going = found.where("step IS NOT NULL")
        if going.isEmpty():
            return _all(done)
        asks = going.select("source_sig", "own.*", "step.*", F.array("family_id").alias("wanted"), F.coalesce("matches", nothing).alias("held"))


def _all(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


# ---- multisets of counted kinds ----------------------------------------------------------------


def _overlap(a: str, b: str, kinds: list[str], low: str = "", high: str = "") -> Column:
    """Multiset overlap of counts ``a`` with counts ``b``, or the most it can be with any between ``low`` and ``high``."""
    shared = sum((F.least(c(f"{a}.{k}"), c(f"{b}.{high}{k}")) for k in kinds), F.lit(0))
    union = sum((F.greatest(c(f"{a}.{k}"), c(f"{b}.{low}{k}")) for k in kinds), F.lit(0))
    return shared / F.greatest(union, F.lit(1))


def _step(total: Column) -> Column:
    """Steps of a quarter: two totals whose ratio is above 4/5 are one step apart at most."""
    return F.floor(F.log(F.greatest(total, F.lit(1)).cast("double")) / math.log(1.25)).cast("int")


def closest_counts(source: DataFrame, catalog: DataFrame, kinds: list[str]) -> DataFrame:
    """``source_sig`` and ``_b``, a struct of ``s`` (the overlap, negated) and ``family_id``, of the catalogue row closest to each source row.

    ``source``: ``source_sig`` and counts ``kinds``; ``catalog``: ``family_id`` and the same; both stored tables of distinct counts. A row and one that
    overlaps by at least ``s`` have totals that differ by a factor of 1/s at most, and share a kind. Each cell of like counts lends one row, and
    the best of those near in total gives ``s``; then the cells within that factor are looked up in the inverted list of kinds and
    totals, and only those whose box leaves room for ``s`` are compared row by row. Ties go to the lower family. A row that shares no kind with any
    is closest to the lowest family, by nothing.
    """
    total = sum((c(k) for k in kinds), F.lit(0))
    cell = F.concat_ws("|", *[_step(c(k) + 1).cast("string") for k in kinds])
    placed = materialize(catalog.withColumns({"cell": cell, "step": _step(total)}), "family-cells")
    held = F.struct(*kinds)
    edges = [f(k).alias(f"{name}_{k}") for k in kinds for f, name in ((F.min, "least"), (F.max, "most"))]
    cells = placed.groupBy("cell", "step").agg(F.min(F.struct("family_id", *kinds)).alias("lent"), *edges)
    cells = materialize(cells.select("cell", "step", "lent", F.struct(*[n for n in cells.columns if n.startswith(("least_", "most_"))]).alias("box"),
                                     F.array_compact(F.array(*[F.when(c(f"most_{k}") > 0, k) for k in kinds])).alias("kinds")), "family-boxes")
    own = F.array_compact(F.array(*[F.when(c(k) > 0, k) for k in kinds]))
    asked = source.select("source_sig", held.alias("own"), own.alias("kinds"), _step(total).alias("own_step"))
    listed = cells.withColumn("kind", F.explode("kinds"))
    near = asked.select("source_sig", "own", "own_step", F.explode(F.sequence(c("own_step") - 1, c("own_step") + 1)).alias("step"),
                        F.get("kinds", F.lit(0)).alias("kind"))
    seeds = near.join(listed.select("step", "kind", "lent"), ["step", "kind"]).groupBy("source_sig").agg(
        F.max(_overlap("own", "lent", kinds)).alias("reached"))
    reached = materialize(asked.join(seeds, "source_sig", "left").withColumn("reached", F.coalesce("reached", F.lit(0.0))), "family-seeds")
    # One step more on either side makes up for rounding.
    reach = F.when(c("reached") > 0, F.ceil(-F.log("reached") / math.log(1.25)) + 1).otherwise(F.lit(STEPS)).cast("int")
    wide = reached.select("source_sig", "own", "reached", "kinds", F.explode(F.sequence(
        F.greatest(c("own_step") - reach, F.lit(0)), F.least(c("own_step") + reach, F.lit(STEPS)))).alias("step"))
    wide = wide.withColumn("kind", F.explode("kinds"))
    # A cell meets a row once, at the first kind that both have.
    met = wide.join(listed.select("step", "kind", "cell", "box", c("kinds").alias("theirs")), ["step", "kind"]).where(
        (F.get(F.array_intersect("kinds", "theirs"), F.lit(0)) == c("kind"))
        & (_overlap("own", "box", kinds, "least_", "most_") + LEEWAY >= c("reached")))
    pairs = met.select("source_sig", "own", "cell", "step").join(
        placed.select("cell", "step", "family_id", held.alias("other")), ["cell", "step"])
    best = pairs.groupBy("source_sig").agg(F.min(F.struct((-_overlap("own", "other", kinds)).alias("s"), "family_id")).alias("_b"))
    lowest = placed.agg(F.min(F.struct(F.lit(-0.0).alias("s"), "family_id")).alias("_lowest"))
    return source.select("source_sig").join(best, "source_sig", "left").withColumn("_lowest", lowest.scalar()).select(
        "source_sig", F.coalesce("_b", "_lowest").alias("_b"))
