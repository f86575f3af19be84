"""Queries for the scalar expressions (FN-01..13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.functions import text as tx
from deckloom.functions import values as vl
from deckloom.plans.registry import query


@query("fn01_normalize_text", "fx_instruction", "", r"""
SELECT slide_id, turn, trim(regexp_replace(replace(raw_text, chr(160), ' '), '\s+', ' ', 'g')) AS normalized
FROM fx_instruction""")
def fn01(t):
    return t.fx_instruction.select("slide_id", "turn", tx.normalize_text(F.col("raw_text")).alias("normalized"))


@query("fn02_normalize_hex", "part", "p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '#' || right('00000' || lower(to_hex(p_partkey)), 6) WHEN 1 THEN right('00' || to_hex(p_partkey), 3) WHEN 2 THEN ' #' || right('00' || to_hex(p_partkey), 3) || ' ' ELSE 'rgb' END AS raw FROM part),\nd AS (SELECT p_partkey, upper(ltrim(trim(raw), '#')) AS v FROM p)", """
SELECT p_partkey, CASE WHEN regexp_full_match(v, '[0-9A-F]{6}') THEN '#' || v
 WHEN regexp_full_match(v, '[0-9A-F]{3}') THEN '#' || v[1] || v[1] || v[2] || v[2] || v[3] || v[3] END AS color
FROM d""")
def fn02(t):
    six = F.expr("right(concat('00000', lower(hex(p_partkey))), 6)")
    three = F.expr("right(concat('00', hex(p_partkey)), 3)")
    kind = F.col("p_partkey") % 4
    raw = (F.when(kind == 0, F.concat(F.lit("#"), six)).when(kind == 1, three)
           .when(kind == 2, F.concat(F.lit(" #"), three, F.lit(" "))).otherwise("rgb"))
    return t.part.select("p_partkey", vl.normalize_hex(raw).alias("color"))


@query("fn03_words_numbers", "fx_text_version", "", r"""
SELECT doc_id,
 array_to_string(list_transform(regexp_extract_all(after_text, '(\p{L}+(?:[''’]\p{L}+)*)', 1), lambda x: replace(lower(x), 'ß', 'ss')), '|') AS words,
 array_to_string(list_transform(regexp_extract_all(after_text, '((?:\B[+-]|\b)(?:\d{1,3}(?:[ ,.'']\d{3})+|\d+)(?:[.,]\d+)?(?:%\B|\b))', 1), lambda x: replace(replace(x, chr(160), ''), ' ', '')), '|') AS numbers
FROM fx_text_version""")
def fn03(t):
    text = F.col("after_text")
    return t.fx_text_version.select(
        "doc_id", F.array_join(tx.words(text), "|").alias("words"),
        F.array_join(tx.numbers(text), "|").alias("numbers"))


@query("fn04_resolve_target", "pages", r"""parts AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS s FROM pages),
clean AS (SELECT page_id, list_filter(s, lambda x: x <> '' AND x <> '.') AS s, s AS raw FROM parts)""", r"""
SELECT page_id, array_to_string(list_concat(
 CASE WHEN len(list_filter(raw[1:len(raw)-1], lambda x: x <> '')) >= 1
  THEN list_filter(raw[1:len(raw)-1], lambda x: x <> '')[1:len(list_filter(raw[1:len(raw)-1], lambda x: x <> ''))-1] ELSE ['..'] END,
 ['media', 'image1.png']), '/') AS target FROM clean""")
def fn04(t):
    source = F.regexp_replace("url", r"^[a-z]+://", "")
    return t.pages.select("page_id", tx.resolve_target(source, F.lit("../media/./image1.png")).alias("target"))


@query("fn05_emu_to_pt", "lineitem", "", """
SELECT l_orderkey, l_linenumber, round(CAST(l_partkey * 977 AS DOUBLE) / 12700, 4) AS pt,
 CAST(l_suppkey * 12700 AS BIGINT) AS emu FROM lineitem""")
def fn05(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", vl.emu_to_pt(F.col("l_partkey") * 977).alias("pt"),
                             vl.pt_to_emu(F.col("l_suppkey").cast("double")).alias("emu"))


@query("fn06_hamming_hex", "documents", "h AS (SELECT doc_id, left(sha256(text), 16) AS a, left(sha256(lang), 16) AS b FROM documents)", """
SELECT doc_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 64 ELSE
 bit_count(xor(CAST('0x' || left(a, 8) AS BIGINT), CAST('0x' || left(b, 8) AS BIGINT))) +
 bit_count(xor(CAST('0x' || right(a, 8) AS BIGINT), CAST('0x' || right(b, 8) AS BIGINT))) END AS INTEGER) AS distance FROM h""")
def fn06(t):
    left = F.substring(F.sha2("text", 256), 1, 16)
    right = F.when(F.col("doc_id") % 7 != 0, F.substring(F.sha2("lang", 256), 1, 16))
    return t.documents.select("doc_id", vl.hamming_hex(left, right).alias("distance"))


@query("fn07_color_distance", "part", """c AS (SELECT p_partkey, (p_partkey * 7) % 256 AS r, (p_partkey * 31) % 256 AS g, (p_partkey * 101) % 256 AS b, p_size % 256 AS s FROM part)""", """
SELECT p_partkey, round(sqrt(CAST((r-s)*(r-s) + (g-s)*(g-s) + (b-128)*(b-128) AS DOUBLE)), 6) AS l2,
 CAST(greatest(abs(r-s), abs(g-s), abs(b-128)) AS BIGINT) AS linf, CAST((r*299 + g*587 + b*114 + 500) // 1000 AS BIGINT) AS luma FROM c""")
def fn07(t):
    hexa = F.format_string("#%02X%02X%02X", F.col("p_partkey") * 7 % 256, F.col("p_partkey") * 31 % 256,
                           F.col("p_partkey") * 101 % 256)
    base = t.part.select("p_partkey", hexa.alias("c"), (F.col("p_size") % 256).cast("bigint").alias("s"))
    rgb = [vl.channel(F.col("c"), i) for i in range(3)]
    other = [F.col("s"), F.col("s"), F.lit(128).cast("bigint")]
    return base.select("p_partkey", F.round(vl.color_distance(rgb, other), 6).alias("l2"),
                       vl.color_distance_max(rgb, other).alias("linf"), vl.luminance(*rgb).alias("luma"))


@query("fn08_box_measures", "fx_shape", """b AS (SELECT *, x_pt + w_pt AS x1, y_pt + h_pt AS y1 FROM fx_shape),
m AS (SELECT *, greatest(0, least(x1, 960) - greatest(x_pt, 100)) * greatest(0, least(y1, 540) - greatest(y_pt, 50)) AS inter FROM b)""", """
SELECT slide_id, shape_id, x_pt, round(CAST(inter AS DOUBLE) / (w_pt * h_pt + 860 * 490 - inter), 6) AS iou,
 round(CAST(inter AS DOUBLE) / least(w_pt * h_pt, 860 * 490), 6) AS overlap,
 round(w_pt * abs(cos(radians(rot_deg))) + h_pt * abs(sin(radians(rot_deg))), 6) AS extent_w FROM m""")
def fn08(t):
    x, y, w, h = (F.col(c) for c in ("x_pt", "y_pt", "w_pt", "h_pt"))
    box = [F.lit(v).cast("bigint") for v in (100, 50, 960, 540)]
    inter = vl.intersection_area(x, y, w, h, *[F.lit(v) for v in (100, 50, 860, 490)])
    return t.fx_shape.select(
        "slide_id", "shape_id", "x_pt",
        F.round(vl.bbox_iou(x, y, x + w, y + h, *box), 6).alias("iou"),
        F.round(inter / F.least(w * h, F.lit(860 * 490)), 6).alias("overlap"),
        F.round(vl.rotated_extent(w, h, F.col("rot_deg"))[0], 6).alias("extent_w"))


@query("fn09_numeric_similarity", "lineitem", """f AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, CAST(l_linenumber AS DOUBLE) AS b, l_tax * 100 AS c, l_discount * 100 AS d FROM lineitem)""", """
SELECT l_orderkey, l_linenumber, round((greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(a-b) / greatest(abs(a), abs(b), 1.0::DOUBLE))
 + greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(c-d) / greatest(abs(c), abs(d), 1.0::DOUBLE))) / 2, 6) AS similarity FROM f""")
def fn09(t):
    pairs = [(F.col("l_quantity"), F.col("l_linenumber").cast("double")),
             (F.col("l_tax") * 100, F.col("l_discount") * 100)]
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             F.round(vl.numeric_similarity(pairs), 6).alias("similarity"))


@query("fn10_safe_name", "part", "", r"""
SELECT p_partkey, trim(regexp_replace(regexp_extract('dir/' || p_name || '*?' || p_brand || '. ', '([^/]*)/*$', 1), '[^\p{L}\p{N}._\- ]', '', 'g'), ' .') AS name FROM part""")
def fn10(t):
    raw = F.concat(F.lit("dir/"), "p_name", F.lit("*?"), "p_brand", F.lit(". "))
    return t.part.select("p_partkey", tx.safe_name(raw).alias("name"))


@query("fn11_payload_field", "fx_job_event", "", """
SELECT sequence, json_extract_string(payload_json, '$.k') AS value FROM fx_job_event""")
def fn11(t):
    return t.fx_job_event.select("sequence", tx.payload_field(F.col("payload_json"), "k").alias("value"))


@query("fn12_event_age", "fx_job_event", "", """
SELECT sequence, CAST(floor((epoch(TIMESTAMP '2030-01-01 00:00:00') - epoch(created_at)) / 86400) AS BIGINT) AS age_days FROM fx_job_event""")
def fn12(t):
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    return t.fx_job_event.select(
        "sequence", tx.age_days(tx.iso_to_ts(F.lit("2030-01-01T00:00:00+00:00")), tx.iso_to_ts(stamp)).alias("age_days"))


@query("fn13_clamp", "lineitem", "", """
SELECT l_orderkey, l_linenumber, greatest(10.0::DOUBLE, least(40.0::DOUBLE, l_quantity)) AS clamped,
 greatest(0.0::DOUBLE, least(1.0::DOUBLE, l_quantity / 30)) AS unit FROM lineitem""")
def fn13(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", vl.clamp(q, 10.0, 40.0).alias("clamped"),
                             vl.clamp01(q / 30).alias("unit"))
