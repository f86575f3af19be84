"""Queries for the template catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import catalog as cat
from deckloom.operators import shapes as sh
from deckloom.plans.layout_queries import FEATURES_CTE, framed
from deckloom.plans.registry import query

c = F.col


@query("jn01_exact_duplicates", "documents", "d AS (SELECT doc_id, sha256(text) AS digest FROM documents)", """
SELECT doc_id, existing_id, digest FROM (SELECT doc_id, digest, min(doc_id) OVER (PARTITION BY digest) AS existing_id FROM d) WHERE existing_id < doc_id""")
def jn01(t):
    return cat.exact_duplicates(t.documents, "doc_id", F.sha2("text", 256))


HASH_CTE = """bt AS (SELECT image_id, x, y, gray, lag(gray) OVER (PARTITION BY image_id, y ORDER BY x) AS lft FROM fx_pixel),
ph AS (SELECT image_id, string_agg(CASE WHEN gray >= lft THEN '1' ELSE '0' END, '' ORDER BY y, x) AS bits FROM bt WHERE x > 0 GROUP BY 1),
hx AS (SELECT image_id, bits, lpad(lower(to_hex(bits::BIT::BIGINT)), 16, '0') AS phash FROM (SELECT image_id, lpad(bits, 64, '0') AS bits FROM ph))"""


@query("ag03_dhash", "fx_pixel", HASH_CTE, "SELECT image_id, phash FROM hx")
def ag03(t):
    return cat.dhash(t.fx_pixel, width=8, height=8)


def hashes(t):
    labels = t.embeddings.select(c("vec_id").alias("image_id"), "label")
    return cat.dhash(t.fx_pixel, width=8, height=8).join(labels, "image_id")


@query("ag04_majority_hash", "fx_pixel embeddings", HASH_CTE + """,
pos AS (SELECT label, p, count(*) AS n, sum(CAST(substr(bits, CAST(p AS INTEGER), 1) AS INTEGER)) AS v FROM hx JOIN embeddings ON image_id = vec_id, (SELECT unnest(range(1, 65)) AS p) GROUP BY 1, 2),
st AS (SELECT label, string_agg(CASE WHEN v * 2 >= n THEN '1' ELSE '0' END, '' ORDER BY p) AS bits FROM pos GROUP BY 1)""", """
SELECT label, lpad(lower(to_hex(bits::BIT::BIGINT)), 16, '0') AS phash FROM st""")
def ag04(t):
    return cat.majority_hash(hashes(t), ["label"])


@query("jn02_near_duplicates", "documents", """ph AS (SELECT doc_id AS template_id, CAST((doc_id // 3) % 5 AS BIGINT) AS slide_count, CASE WHEN doc_id % 11 <> 0 THEN
 substr(sha256('deck ' || CAST(doc_id // 3 AS VARCHAR)), 1, 14) || ['00', '01', '1f'][doc_id % 3 + 1] END AS phash FROM documents),
hb AS (SELECT *, ('0x' || phash)::UBIGINT AS bits FROM ph WHERE phash IS NOT NULL),
pr AS (SELECT a.slide_count, a.template_id, b.template_id AS existing_id, bit_count(xor(a.bits, b.bits)) AS distance
 FROM hb a JOIN hb b ON b.template_id < a.template_id AND a.slide_count = b.slide_count)""", """
SELECT slide_count, template_id, min(existing_id) AS existing_id, CAST(arg_min(distance, existing_id) AS INTEGER) AS distance FROM pr WHERE distance <= 4 GROUP BY 1, 2""")
def jn02(t):
    """Three documents in a row are one deck and two near copies: one and five bits from the first, four from each other."""
    deck = F.floor(c("doc_id") / 3)
    tail = F.element_at(F.array(F.lit("00"), F.lit("01"), F.lit("1f")), (c("doc_id") % 3 + 1).cast("int"))
    hashed = t.documents.select(c("doc_id").alias("template_id"), (deck % 5).alias("slide_count"), F.when(
        c("doc_id") % 11 != 0, F.concat(F.substring(F.sha2(F.concat(F.lit("deck "), deck.cast("string")), 256), 1, 14), tail)).alias("phash"))
    return cat.near_duplicates(hashed, "template_id", block="slide_count")


@query("jn04_active_template_slides", "fx_shape", "s AS (SELECT DISTINCT slide_id, deck_id AS template_id, deck_id % 20 AS family_id FROM fx_shape)", """
SELECT * FROM s WHERE template_id % 7 <> 0 AND template_id % 11 <> 0 AND family_id % 3 <> 0""")
def jn04(t):
    slides = t.fx_shape.select("slide_id", c("deck_id").alias("template_id"),
                               (c("deck_id") % 20).alias("family_id")).distinct()
    templates = slides.select("template_id").distinct().select(
        "template_id", (c("template_id") % 7 != 0).alias("active"),
        F.when(c("template_id") % 11 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    families = slides.select("family_id").distinct().withColumn("active", c("family_id") % 3 != 0)
    return cat.active_template_slides(slides, templates, families)


@query("jn05_family_counts", "nation customer", "", """
SELECT n_nationkey AS family_id, n_name AS name, count(c_custkey) AS template_count FROM nation
LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 AND n_regionkey <> 2 GROUP BY 1, 2""")
def jn05(t):
    families = t.nation.select(c("n_nationkey").alias("family_id"), c("n_name").alias("name"))
    live = t.customer.join(t.nation, c("c_nationkey") == c("n_nationkey")).select(
        c("c_nationkey").alias("family_id"), (c("c_acctbal") > 9000).alias("active"),
        F.when(c("n_regionkey") == 2, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    return cat.family_counts(families, live)


def with_colors(features, shapes, keys):
    colors = sh.color_lists(sh.dominant_colors(shapes, keys), keys)
    empty = F.array().cast("array<string>")
    return features.join(colors, keys, "left").withColumn(
        "dominant_colors", F.coalesce(c("dominant_colors"), empty))


def source_slides(t):
    shapes = framed(t)
    keys = ["deck_id", "slide_id"]
    return with_colors(sh.with_archetype(sh.slide_features(shapes, keys)), shapes, keys)


def template_slides(t):
    """One template slide per supplier, in the family of the supplier's region."""
    region = t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).select(
        c("s_suppkey").alias("l_suppkey"), c("n_regionkey").cast("bigint").alias("family_id"))
    shapes = t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select(
        "l_suppkey", F.lit("sp").alias("kind"), F.lit(None).cast("string").alias("frame_type"),
        F.when(c("l_linestatus") == "O", c("p_name")).otherwise("").alias("text"), "p_brand",
        (20 + c("l_quantity").cast("bigint") * 8).alias("w_pt"), (12 + (c("l_partkey") * 11) % 160).alias("h_pt"))
    shapes = shapes.withColumnRenamed("p_brand", "fill_color")
    features = with_colors(sh.with_archetype(sh.slide_features(shapes, ["l_suppkey"])), shapes, ["l_suppkey"])
    return features.join(region, "l_suppkey").withColumnRenamed("l_suppkey", "template_slide_id")


def _num(a: str, b: str) -> str:
    one = "1.0::DOUBLE"
    return f"greatest(0.0::DOUBLE, {one} - abs({a} - {b})::DOUBLE / greatest(abs({a})::DOUBLE, abs({b})::DOUBLE, {one}))"


MATCH_CTE = FEATURES_CTE + """,
sc1 AS (SELECT slide_id, fill_color, count(*) AS n FROM fx_shape GROUP BY ALL),
sc2 AS (SELECT slide_id, fill_color FROM sc1 QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY n DESC, fill_color) <= 6),
sc3 AS (SELECT slide_id, list(fill_color) AS colors FROM sc2 GROUP BY 1),
src AS (SELECT arch.*, colors FROM arch JOIN sc3 USING (slide_id)),
ts AS (SELECT l_suppkey, CASE WHEN l_linestatus = 'O' THEN p_name ELSE '' END AS text, p_brand, 20 + CAST(l_quantity AS BIGINT) * 8 AS w, 12 + (l_partkey * 11) % 160 AS h FROM lineitem JOIN part ON l_partkey = p_partkey),
tf AS (SELECT l_suppkey, count(*) AS shape_count, 0 AS picture_count, 0 AS group_count, count(*) FILTER (text <> '') AS text_count, 0 AS table_count, 0 AS chart_count, round(avg(w), 3) AS mean_width_pt, round(avg(h), 3) AS mean_height_pt FROM ts GROUP BY 1),
ta AS (SELECT *, CASE WHEN text_count <= 2 AND shape_count <= 4 THEN 'title' WHEN text_count >= 8 THEN 'dense_content' WHEN shape_count >= 12 THEN 'process' ELSE 'content' END AS archetype FROM tf),
tc1 AS (SELECT l_suppkey, p_brand, count(*) AS n FROM ts GROUP BY ALL),
tc2 AS (SELECT l_suppkey, p_brand FROM tc1 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) <= 6),
tc3 AS (SELECT l_suppkey, list(p_brand) AS colors FROM tc2 GROUP BY 1),
tpl AS (SELECT ta.*, colors, CAST(n_regionkey AS BIGINT) AS family_id FROM ta JOIN tc3 USING (l_suppkey) JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey),
s1 AS (SELECT s.deck_id, s.slide_id, t.family_id, t.l_suppkey AS template_slide_id, s.archetype = t.archetype AS same,
 (""" + " + ".join(_num(f"s.{f}", f"t.{f}") for f in sh.FEATURES) + """) / 8 AS base,
 CAST(len(list_intersect(s.colors, t.colors)) AS DOUBLE) / len(list_distinct(list_concat(s.colors, t.colors))) AS style FROM src s CROSS JOIN tpl t),
s2 AS (SELECT *, CASE WHEN same THEN least(1.0::DOUBLE, base + 0.08::DOUBLE) ELSE base END AS structure FROM s1),
s3 AS (SELECT deck_id, slide_id, family_id, template_slide_id, floor(structure * 1000000 + 0.5::DOUBLE) / 1000000 AS structural_score, floor(style * 1000000 + 0.5::DOUBLE) / 1000000 AS style_score,
 floor((0.78::DOUBLE * structure + 0.22::DOUBLE * style) * 1000000 + 0.5::DOUBLE) / 1000000 AS confidence FROM s2),
s4 AS (SELECT *, CAST(row_number() OVER (PARTITION BY slide_id, family_id ORDER BY confidence DESC, template_slide_id) AS INTEGER) AS match_rank FROM s3 QUALIFY match_rank <= 5),
fs AS (SELECT deck_id, family_id, sum(CAST(round(confidence * 1000000) AS BIGINT)) AS total FROM s4 WHERE match_rank = 1 GROUP BY ALL),
wf AS (SELECT deck_id, family_id FROM fs QUALIFY row_number() OVER (PARTITION BY deck_id ORDER BY total DESC, family_id) = 1),
tm AS (SELECT s4.*, match_rank = 1 AS selected FROM s4 JOIN wf USING (deck_id, family_id))"""
MATCH_VIEWS = "fx_shape lineitem part supplier nation"


def candidates(t, k=5):
    return cat.template_candidates(source_slides(t), template_slides(t), ["deck_id", "slide_id"], k)


@query("jn03_template_candidates", MATCH_VIEWS, MATCH_CTE, """
SELECT deck_id, slide_id, family_id, template_slide_id, structural_score, style_score, confidence FROM s4 WHERE match_rank = 1""")
def jn03(t):
    return candidates(t, 1).drop("match_rank")


@query("wn01_top_matches", MATCH_VIEWS, MATCH_CTE, "SELECT * FROM tm")
def wn01(t):
    return cat.top_matches(candidates(t), "deck_id", "slide_id")


@query("wn02_nth_match", MATCH_VIEWS, MATCH_CTE + """,
el AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY confidence DESC, template_slide_id) AS rn, count(*) OVER (PARTITION BY slide_id) AS n FROM tm WHERE confidence >= 0.4)""", """
SELECT deck_id, slide_id, template_slide_id, confidence FROM el WHERE rn = least(3, n)""")
def wn02(t):
    best = cat.top_matches(candidates(t), "deck_id", "slide_id")
    return cat.nth_match(best, ["deck_id", "slide_id"], 2, 0.4).select(
        "deck_id", "slide_id", "template_slide_id", "confidence")


@query("jn22_rerank", MATCH_VIEWS, MATCH_CTE + """,
rr AS (SELECT *, CASE WHEN slide_id % 3 = 0 AND match_rank = 2 THEN 0 WHEN slide_id % 3 = 1 AND match_rank = 3 THEN 1 ELSE 2 END AS p FROM tm WHERE confidence >= 0.4)""", """
SELECT deck_id, slide_id, template_slide_id, confidence, CASE WHEN p = 0 THEN 'proposed layout among the best candidates' ELSE 'fallback after an absent or invalid proposal' END AS rationale
FROM rr QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY p, confidence DESC, template_slide_id) = 1""")
def jn22(t):
    best = cat.top_matches(candidates(t), "deck_id", "slide_id")
    keys = ["deck_id", "slide_id"]
    desired = best.filter("slide_id % 3 = 0 AND match_rank = 2").select(
        *keys, c("template_slide_id").alias("desired_id"))
    fallback = best.filter("slide_id % 3 = 1 AND match_rank = 3").select(
        *keys, c("template_slide_id").alias("fallback_id"))
    return cat.rerank(best, desired, fallback, keys, 0.4).select(
        *keys, "template_slide_id", "confidence", "rationale")


def dated_archetypes(t):
    slides = sh.with_archetype(sh.slide_features(framed(t), ["deck_id", "slide_id"]))
    fortnight = F.floor(F.datediff("o_orderdate", F.lit("1992-01-01")) / 12)
    dates = t.orders.select(c("o_orderkey").alias("slide_id"), fortnight.alias("family_id"))
    return slides, slides.join(dates, "slide_id")


@query("ag05_family_match", "fx_shape orders", FEATURES_CTE + """,
dc AS (SELECT deck_id, archetype, count(*) AS n FROM arch GROUP BY ALL),
fc AS (SELECT CAST(floor(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) / 12.0) AS BIGINT) AS family_id, archetype, count(*) AS n FROM arch JOIN orders ON o_orderkey = slide_id GROUP BY ALL),
dt AS (SELECT deck_id, sum(n) AS n FROM dc GROUP BY 1), ft AS (SELECT family_id, sum(n) AS n FROM fc GROUP BY 1),
ii AS (SELECT deck_id, family_id, sum(least(dc.n, fc.n)) AS i FROM dc JOIN fc USING (archetype) GROUP BY ALL),
sx AS (SELECT deck_id, family_id, CAST(i AS DOUBLE) / (dt.n + ft.n - i) AS score FROM ii JOIN dt USING (deck_id) JOIN ft USING (family_id)),
bx AS (SELECT * FROM sx QUALIFY row_number() OVER (PARTITION BY deck_id ORDER BY score DESC, family_id) = 1)""", """
SELECT deck_id, CASE WHEN score >= 0.72 THEN family_id END AS family_id, round(score, 6) AS score FROM bx""")
def ag05(t):
    slides, dated = dated_archetypes(t)
    return cat.family_match(slides, dated, "deck_id").drop("new_family")


def catalog_tables(t):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    old = F.lit("2024-01-01 00:00:00").cast("timestamp")
    templates = t.customer.select(
        c("c_custkey").alias("template_id"), c("c_nationkey").alias("family_id"), F.lit(True).alias("active"),
        F.lit(None).cast("timestamp").alias("deleted_at"), old.alias("updated_at"),
        F.when(c("c_acctbal") > 5000, 2).otherwise(1).alias("index_version"))
    families = t.nation.select(c("n_nationkey").alias("family_id"), c("n_name").alias("name"),
                               F.lit(True).alias("active"), old.alias("updated_at"))
    return templates, families, now


@query("se08_merge_families", "customer nation", "", """
SELECT c_custkey AS template_id, CASE WHEN n_regionkey = 1 THEN 3 ELSE c_nationkey END AS family_id, n_regionkey = 1 AND n_nationkey <> 3 AS touched
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def se08(t):
    templates, families, now = catalog_tables(t)
    sources = t.nation.filter("n_regionkey = 1").select(c("n_nationkey").alias("family_id"))
    moved, _, _ = cat.merge_families(templates, families, 3, sources, now)
    return moved.select("template_id", c("family_id").cast("int").alias("family_id"),
                        (c("updated_at") == now).alias("touched"))


@query("se08_split_family", "customer", "", """
SELECT c_custkey AS template_id, CASE WHEN c_nationkey = 7 AND c_acctbal > 0 THEN 99 ELSE c_nationkey END AS family_id FROM customer""")
def se08b(t):
    templates, _, now = catalog_tables(t)
    chosen = t.customer.filter("c_nationkey = 7 AND c_acctbal > 0").select(c("c_custkey").alias("template_id"))
    moved, _ = cat.split_family(templates, 7, chosen, 99, now)
    return moved.select("template_id", c("family_id").cast("int").alias("family_id"))


@query("se09_soft_delete_restore", "customer", "", """
SELECT c_custkey AS template_id, NOT (c_acctbal < 0 AND c_mktsegment <> 'BUILDING') AS active, c_acctbal < 0 AND c_mktsegment <> 'BUILDING' AS deleted FROM customer""")
def se09(t):
    templates, _, now = catalog_tables(t)
    gone = t.customer.filter("c_acctbal < 0").select(c("c_custkey").alias("template_id"))
    back = t.customer.filter("c_acctbal < 0 AND c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("template_id"))
    out = cat.restore(cat.soft_delete(templates, gone, now), back, now)
    return out.select("template_id", "active", c("deleted_at").isNotNull().alias("deleted"))


@query("se09_rename_family", "nation", "", """
SELECT n_nationkey AS family_id, CASE WHEN n_regionkey = 0 THEN 'F' || n_nationkey ELSE n_name END AS name FROM nation""")
def se09b(t):
    _, families, now = catalog_tables(t)
    names = t.nation.filter("n_regionkey = 0").select(
        c("n_nationkey").alias("family_id"), F.concat(F.lit("  F"), c("n_nationkey").cast("string"), F.lit(" ")).alias("new_name"))
    return cat.rename_family(families, names, now).select("family_id", "name")


@query("ag37_reindex_report", "customer", "", """
SELECT count(*) FILTER (NOT c_acctbal > 5000) AS reindexed, count(*) FILTER (c_acctbal > 5000) AS skipped, 2 AS index_version FROM customer""")
def ag37(t):
    return cat.reindex_report(catalog_tables(t)[0], 2)
