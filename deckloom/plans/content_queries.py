"""Queries for content safety and package audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.operators import content as con
from deckloom.operators import package as pkg
from deckloom.plans.registry import query

c = F.col

WORD = r"regexp_extract_all({0}, '(\p{{L}}+(?:[''’]\p{{L}}+)*)', 1)"
NUM = (r"regexp_extract_all({0}, '((?:\B[+-]|\b)(?:\d{{1,3}}(?:[ ,.'']\d{{3}})+|\d+)(?:[.,]\d+)?(?:%\B|\b))', 1)")


def tok(text: str) -> str:
    return f"""SELECT doc_id, 'word' AS fact, replace(lower(w), 'ß', 'ss') AS value FROM (SELECT doc_id, unnest({WORD.format(text)}) AS w FROM fx_text_version)
UNION ALL SELECT doc_id, 'number', replace(replace(n, chr(160), ''), ' ', '') FROM (SELECT doc_id, unnest({NUM.format(text)}) AS n FROM fx_text_version)"""


@query("ag07_token_counts", "fx_text_version", f"tk AS ({tok('after_text')})", """
SELECT doc_id, fact, value, count(*) AS uses FROM tk GROUP BY ALL""")
def ag07(t):
    return con.token_counts(t.fx_text_version, ["doc_id"], "after_text")


# Facts of objects that every document is given: the edit changes those of every so-many-th document, which must give the codes.
OBJECT_FACTS = [
    ("table", 11, ["table_data_changed"]), ("chart", 13, ["chart_data_changed"]), ("image", 17, ["images_changed", "logos_changed"]),
    ("logo_state", 19, ["logo_geometry_or_effect_changed"]), ("relationship_hash", 23, ["protected_relationship_changed"]),
    ("animation_hash", 29, ["animation_changed"]), ("table_count", 31, ["native_table_count_changed"]),
    ("chart_count", 37, ["native_chart_count_changed"])]
INV_CTE = f"""tb AS ({tok('before_text')}), ta AS ({tok('after_text')}),
sg AS (SELECT doc_id, fact, value, sum(s) AS d FROM (SELECT *, -1 AS s FROM tb UNION ALL SELECT *, 1 AS s FROM ta) GROUP BY ALL HAVING sum(s) <> 0),
vi AS (SELECT DISTINCT doc_id AS deck_id, CASE fact WHEN 'word' THEN 'words_changed' ELSE 'numbers_changed' END AS code FROM sg
 UNION ALL SELECT doc_id, code FROM documents, (VALUES {", ".join(f"({step}, '{code}')" for _, step, codes in OBJECT_FACTS for code in codes)}) AS f(step, code) WHERE doc_id % step = 0)"""


def violations(t):
    v = t.fx_text_version.select(c("doc_id").alias("deck_id"), F.lit(1).alias("slide_index"), "before_text", "after_text")
    keys = ["deck_id", "slide_index"]
    slides = v.select(*keys)
    def objects(changed: bool):
        """Two values of every fact, the second another one in every so-many-th document of the edit; images are logos as well."""
        facts = [F.struct(F.lit(fact).alias("fact"), F.concat(F.lit("b"), F.when(
            F.lit(changed) & (c("deck_id") % step == 0), "new").otherwise("old")).alias("value")) for fact, step, _ in OBJECT_FACTS]
        facts += [F.struct(F.lit(fact).alias("fact"), F.lit("a").alias("value")) for fact, _, _ in OBJECT_FACTS]
        logo = F.struct(F.lit("logo").alias("fact"), F.lit("bold").alias("value"))
        return slides.select(*keys, F.explode(F.array(*facts, logo)).alias("_f")).select(*keys, "_f.*")

    return slides, con.invariant_pairs(
        objects(False), objects(True), slides, slides, paired=con.paired_tokens(v, keys, "before_text", "after_text"))


@query("jn16_invariant_pairs", "fx_text_version", INV_CTE, "SELECT deck_id, 1 AS slide_index, code FROM vi")
def jn16(t):
    return violations(t)[1]


@query("ag20_check_rollup", "fx_text_version", INV_CTE, """
SELECT doc_id AS deck_id, TRUE AS slide_count, NOT coalesce(bool_or(code = 'words_changed'), FALSE) AS words, NOT coalesce(bool_or(code = 'numbers_changed'), FALSE) AS numbers,
 NOT coalesce(bool_or(contains(code, 'table')), FALSE) AS tables, NOT coalesce(bool_or(contains(code, 'chart')), FALSE) AS charts,
 NOT coalesce(bool_or(contains(code, 'image') OR contains(code, 'logo')), FALSE) AS assets, NOT coalesce(bool_or(contains(code, 'relationship')), FALSE) AS relationships,
 NOT coalesce(bool_or(contains(code, 'animation')), FALSE) AS animations, count(code) = 0 AS passed
FROM fx_text_version LEFT JOIN vi ON doc_id = deck_id GROUP BY 1""")
def ag20(t):
    slides, found = violations(t)
    return con.check_rollup(slides, found)


LINES = "lines_{0} AS (SELECT doc_id, unnest(string_split({0}_text, chr(10))) AS text FROM fx_text_version)"


@query("se01_content_preserved", "fx_text_version", LINES.format("before") + ",\n" + LINES.format("after") + r""",
rm AS (SELECT DISTINCT trim(regexp_replace(replace(lines_before.text, chr(160), ' '), '\s+', ' ', 'g')) AS n FROM lines_before JOIN documents USING (doc_id) WHERE documents.lang = 'en'),
ex AS (SELECT doc_id, text FROM lines_before WHERE trim(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g')) NOT IN (SELECT n FROM rm)),
sg AS (SELECT doc_id, text, sum(s) AS d FROM (SELECT *, 1 AS s FROM ex UNION ALL SELECT *, -1 AS s FROM lines_after) GROUP BY ALL)""", """
SELECT doc_id, text, CAST(d AS BIGINT) AS missing FROM sg WHERE d > 0""")
def se01(t):
    v = t.fx_text_version

    def lines(col):
        return v.select("doc_id", "lang", F.explode(F.split(col, "\n")).alias("text"))

    before = lines("before_text")
    return con.content_preserved(before, lines("after_text"), before.filter("lang = 'en'"), ["doc_id"])


@query("se02_missing_assets", "fx_shape", "", """
SELECT DISTINCT deck_id, sha256(fill_color || font_pt) AS sha256 FROM fx_shape WHERE kind = 'pic'
EXCEPT SELECT deck_id, sha256(fill_color || font_pt) FROM fx_shape WHERE kind = 'sp' AND h_pt > 60""")
def se02(t):
    assets = t.fx_shape.withColumn("sha256", F.sha2(F.concat("fill_color", c("font_pt").cast("string")), 256))
    return con.missing_assets(assets.filter("kind = 'pic'"), assets.filter("kind = 'sp' AND h_pt > 60"))


@query("se03_changed_ids", "fx_shape_key", """b AS (SELECT slide_id, shape_id, x_pt, fill_color FROM fx_shape_key WHERE font_pt > 6),
a AS (SELECT slide_id, shape_id, CASE WHEN kind = 'pic' THEN x_pt + 1 ELSE x_pt END AS x_pt, fill_color FROM fx_shape_key WHERE font_pt < 23)""", """
SELECT slide_id, shape_id, CASE WHEN b.x_pt IS NULL THEN 'added' WHEN a.x_pt IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM b FULL OUTER JOIN a USING (slide_id, shape_id) WHERE b.x_pt IS DISTINCT FROM a.x_pt OR b.fill_color IS DISTINCT FROM a.fill_color""")
def se03(t):
    before = t.fx_shape_key.filter("font_pt > 6")
    after = t.fx_shape_key.filter("font_pt < 23").withColumn(
        "x_pt", F.when(c("kind") == "pic", c("x_pt") + 1).otherwise(c("x_pt")))
    return con.changed_ids(before, after, ["slide_id", "shape_id"], ["x_pt", "fill_color"])


@query("prj12_production_notes", "fx_instruction", "", r"""
SELECT slide_id, turn, source FROM fx_instruction WHERE length(raw_text) >= 15 AND (contains(lower(source || ' ' || raw_text), 'instruction') OR contains(lower(source || ' ' || raw_text), 'production note')
 OR (priority >= 80 AND regexp_matches(raw_text, '(?i)\b(please|add|remove|replace|move|change|update|delete|insert|duplicate|merci|ajoute[rz]?|supprime[rz]?|remplace[rz]?|d[ée]place[rz]?|modifie[rz]?|placeholder|dummy|production note|instruction)\b')))""")
def prj12(t):
    rows = t.fx_instruction.withColumn("bold", c("priority") >= 80)
    return con.production_notes(rows, "source", "raw_text").select("slide_id", "turn", "source")


@query("wn18_first_instructions", "fx_instruction", r"n AS (SELECT *, lower(trim(regexp_replace(replace(raw_text, chr(160), ' '), '\s+', ' ', 'g'))) AS normalized FROM fx_instruction)", """
SELECT slide_id, source, normalized, turn, priority FROM n QUALIFY row_number() OVER (PARTITION BY slide_id, source, normalized ORDER BY turn) = 1""")
def wn18(t):
    return con.first_instructions(t.fx_instruction, ["turn"]).select(
        "slide_id", "source", "normalized", "turn", "priority")


SECRET_SQL = r"""
SELECT path, unnest(list_filter([
 CASE WHEN regexp_extract(path, '(\.[^./]+)$', 1) IN ('.pptx', '.pptm', '.pdf', '.png', '.jpg', '.jpeg', '.webp', '.zip') THEN 'forbidden_suffix' END,
 CASE WHEN regexp_extract(path, '([^/]*)$', 1) = '.env' THEN 'environment_file' END,
 CASE WHEN len(list_filter(regexp_extract_all(content, '\bsk-[A-Za-z0-9_-]{20,}'), lambda k: NOT regexp_matches(k, '^sk-(example|test|your)'))) > 0 THEN 'api_key' END,
 CASE WHEN regexp_matches(content, '\bgh[opsu]_[A-Za-z0-9]{30,}') THEN 'access_token' END,
 CASE WHEN regexp_matches(content, '-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----') THEN 'private_key' END], lambda r: r IS NOT NULL)) AS rule FROM fx_text_file"""


@query("prj21_secret_scan", "fx_text_file", "", SECRET_SQL)
def prj21(t):
    return con.secret_scan(t.fx_text_file)


@query("se10_missing_rules", "fx_text_file", "have AS (SELECT DISTINCT regexp_extract(path, '(\\.[^./]+)$', 1) AS r FROM fx_text_file)", """
SELECT unnest(['.env', '*.pptx', '.md', '.zip', 'out/']) AS rule EXCEPT SELECT r FROM have""")
def se10(t):
    lines = t.fx_text_file.select(F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("line"))
    return con.missing_rules(lines, [".env", "*.pptx", ".md", ".zip", "out/"])


@query("jn06_broken_relationships", "fx_relationship fx_part", "", """
SELECT deck_id, source_part, rel_no, target_id FROM fx_relationship ANTI JOIN fx_part ON target_id = part_id WHERE NOT is_external""")
def jn06(t):
    parts = t.fx_part.select(c("part_id").alias("target_id"))
    return pkg.broken_relationships(t.fx_relationship, parts, ["target_id"]).select(
        "deck_id", "source_part", "rel_no", "target_id")


@query("jn07_required_parts", "fx_shape", "p AS (SELECT DISTINCT slide_id AS deck_id, kind AS part_name FROM fx_shape)", """
SELECT deck_id, unnest(['sp', 'pic', 'graphicFrame', 'cxnSp']) AS part_name FROM (SELECT DISTINCT deck_id FROM p) EXCEPT SELECT deck_id, part_name FROM p""")
def jn07(t):
    parts = t.fx_shape.select(c("slide_id").alias("deck_id"), c("kind").alias("part_name"))
    return pkg.required_parts(parts, required=["sp", "pic", "graphicFrame", "cxnSp"])


@query("jn08_dangling_components", "fx_component_instance fx_component_primitive", "", """
SELECT slide_id, shape_id, component_id FROM fx_component_instance ANTI JOIN fx_component_primitive USING (component_id)""")
def jn08(t):
    from deckloom.operators.components import dangling_components

    return dangling_components(t.fx_component_instance, t.fx_component_primitive).select(
        "slide_id", "shape_id", "component_id")


@query("ag26_fingerprint", "fx_relationship", """d AS (SELECT source_part, sha256('{"rel_no":' || rel_no || ',"target_id":' || target_id || '}') AS h FROM fx_relationship),
w AS (SELECT source_part, count(*) AS n, """ + ", ".join(
    f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 7) AS BIGINT)) AS w{i}" for i in range(8)) + " FROM d GROUP BY 1)", """
SELECT source_part, sha256(concat_ws(':', n, w0, w1, w2, w3, w4, w5, w6, w7)) AS fingerprint FROM w""")
def ag26(t):
    return pkg.fingerprint(t.fx_relationship, ["source_part"], ["rel_no", "target_id"])


FONT = "CASE font_pt % 6 WHEN 0 THEN 'Arial' WHEN 1 THEN ' Calibri ' WHEN 2 THEN '+mn-lt' WHEN 3 THEN 'Fira Code' WHEN 4 THEN 'PT Serif' ELSE fill_color END"


@query("ag27_fonts_used", "fx_shape", f"f AS (SELECT DISTINCT deck_id, trim({FONT}) AS typeface FROM fx_shape)", """
SELECT deck_id, typeface, lower(typeface) IN ('arial', 'calibri') AS portable FROM f WHERE typeface NOT LIKE '+%'""")
def ag27(t):
    return pkg.fonts_used(t.fx_shape.select("deck_id", F.expr(FONT).alias("typeface")))


@query("prj11_portable_fonts", "fx_shape", f"f AS (SELECT slide_id, shape_id, {FONT} AS f FROM fx_shape)", """
SELECT slide_id, shape_id, CASE WHEN lower(trim(f)) IN ('arial', 'calibri') THEN f WHEN f = 'PT Serif' THEN 'Times New Roman' WHEN f = 'Fira Code' THEN 'Courier New' ELSE 'Arial' END AS font_family,
 CASE WHEN lower(trim(f)) NOT IN ('arial', 'calibri') THEN f END AS requested_font FROM f""")
def prj11(t):
    return pkg.portable_fonts(t.fx_shape.select("slide_id", "shape_id", F.expr(FONT).alias("font_family")))


@query("ag09_tag_counts", "pages", "", """
SELECT page_id, CAST((length(html) - length(replace(html, '<li>', ''))) // 4 AS BIGINT) AS items, CAST((length(html) - length(replace(html, '<p>', ''))) // 3 AS BIGINT) AS paragraphs,
 CAST((length(html) - length(replace(html, '<a ', ''))) // 3 AS BIGINT) AS links FROM pages""")
def ag09(t):
    return t.pages.select("page_id", pkg.tag_count(c("html"), "<li>").alias("items"),
                          pkg.tag_count(c("html"), "<p>").alias("paragraphs"),
                          pkg.tag_count(c("html"), "<a ").alias("links"))
