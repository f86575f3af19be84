"""Analysis views over the given tables.

Every view is one SQL text valid in Spark and in the checking engine; table names
stand in braces so that Spark can bind them to parquet scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {
    "fx_shape": """
SELECT l_orderkey % 200 AS deck_id, l_orderkey AS slide_id, CAST(l_linenumber AS BIGINT) AS shape_id,
 CASE l_returnflag WHEN 'A' THEN 'sp' WHEN 'N' THEN 'pic' ELSE 'graphicFrame' END AS kind, p_name AS name,
 CASE WHEN l_linestatus = 'O' THEN concat(p_name, ' ', p_type) ELSE '' END AS text,
 (l_partkey * 37) % 1200 AS x_pt, (l_suppkey * 53) % 680 AS y_pt, 20 + CAST(l_quantity AS BIGINT) * 8 AS w_pt,
 12 + (l_partkey * 11) % 160 AS h_pt, CAST((l_linenumber % 3) * 15 AS BIGINT) AS rot_deg,
 CAST(5 + p_size % 20 AS BIGINT) AS font_pt, p_brand AS fill_color
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "fx_job_event": """
SELECT user_id AS job_id, event_id AS sequence, ts AS created_at,
 CASE event_type WHEN 'signup' THEN 'job.created' WHEN 'view' THEN 'job.started' WHEN 'click' THEN 'job.updated'
  WHEN 'purchase' THEN 'agent.completed' ELSE 'job.exception' END AS event_type,
 CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 7) AS BIGINT) AS output_tokens,
 props AS payload_json FROM {events}""",
    "fx_eval_case": """
SELECT o_orderkey AS case_id, o_orderpriority AS endpoint,
 CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS passed,
 CAST(floor(o_totalprice) AS BIGINT) % 1001 AS score_milli,
 o_custkey % 3 + 1 AS candidate_index, o_custkey % 97 AS run_id, o_custkey AS customer_id FROM {orders}""",
    "fx_text_version": """
SELECT doc_id, lang, text AS before_text, CASE doc_id % 6 WHEN 0 THEN lower(text) WHEN 1 THEN concat(text, ' extra')
 WHEN 2 THEN concat(text, ' 1,250') WHEN 3 THEN replace(text, '.', ' .') ELSE text END AS after_text FROM {documents}""",
    "fx_instruction": """
SELECT conv_id AS slide_id, turn, CASE role WHEN 'system' THEN 'api' WHEN 'user' THEN 'comment' ELSE 'visible_callout' END AS source,
 CAST(CASE role WHEN 'system' THEN 100 WHEN 'user' THEN 80 ELSE 40 END AS BIGINT) AS priority,
 CASE WHEN turn % 3 = 0 THEN concat('Please move ', text)
  WHEN turn % 3 = 1 THEN concat('  please  move the logo ', text) ELSE text END AS raw_text FROM {conversations}""",
    "fx_review": """
SELECT d.doc_id AS slide_id, d.doc_id % 25 AS candidate_id, l.quality = 1 AS content_preserved, l.toxic = 0 AS layout_valid,
 (d.doc_id * 7) % 101 AS score_tenths FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    "fx_relationship": """
SELECT l_orderkey % 200 AS deck_id, l_orderkey AS source_part, CAST(l_linenumber AS BIGINT) AS rel_no, l_partkey AS target_id,
 l_shipdate < TIMESTAMP '1996-01-01 00:00:00' AS is_external FROM {lineitem}""",
    "fx_part": """
SELECT p_partkey AS part_id, p_name AS part_name, CAST(p_size AS BIGINT) AS size_bytes FROM {part} WHERE p_partkey % 10 <> 0""",
    "fx_component_instance": """
SELECT l_orderkey AS slide_id, CAST(l_linenumber AS BIGINT) AS shape_id, (l_partkey * 37) % 12 AS component_id,
 (l_partkey * 37) % 1200 AS x, (l_suppkey * 53) % 680 AS y, 20 + CAST(l_quantity AS BIGINT) * 8 AS width,
 12 + (l_partkey * 11) % 160 AS height FROM {lineitem}""",
    "fx_component_primitive": """
SELECT CAST(n_nationkey % 10 AS BIGINT) AS component_id, CAST(n_nationkey AS BIGINT) AS primitive_id,
 CAST(n_nationkey % 4 AS DOUBLE) / 4 AS ux, CAST(n_nationkey % 3 AS DOUBLE) / 4 AS uy,
 CAST(0.25 AS DOUBLE) AS uw, CAST(0.25 AS DOUBLE) AS uh FROM {nation}""",
    # One operation for each line, two for a shape; every 23rd part's operation names a shape that is not there.
    "fx_patch_op": """
SELECT l_orderkey AS slide_id, CAST(floor((rn + 1) / 2.0) AS BIGINT) + CASE WHEN l_partkey % 23 = 0 THEN 1000 ELSE 0 END AS target_shape_id, rn AS op_no,
 CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'move' WHEN 1 THEN 'resize' WHEN 2 THEN 'recolor'
  WHEN 3 THEN 'delete' ELSE 'align' END AS action,
 (l_partkey % 21) - 10 AS dx_pt, (l_suppkey % 21) - 10 AS dy_pt, 30 + l_partkey % 90 AS width_pt,
 20 + l_suppkey % 60 AS height_pt
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey) AS BIGINT) AS rn FROM {lineitem}) r""",
    "fx_text_file": """
SELECT doc_id, concat('f', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 8 WHEN 0 THEN '.pptx' WHEN 1 THEN '.png'
 WHEN 2 THEN '/.env' ELSE '.md' END) AS path,
 CASE WHEN doc_id % 50 = 3 THEN concat(text, ' ghp_', repeat('a', 36)) ELSE text END AS content FROM {documents}""",
    "fx_lineage": """
SELECT o_orderkey AS job_id, CASE WHEN o_orderkey > 0 THEN CAST(floor(o_orderkey / 2.0) AS BIGINT) END AS parent_job_id FROM {orders}""",
    # Ids repeat in fx_shape: here every row has one of its own, by a total order within its slide.
    "fx_shape_key": """
SELECT deck_id, slide_id, rn AS shape_id, kind, name, text, x_pt, y_pt, w_pt, h_pt, rot_deg, font_pt, fill_color
FROM (SELECT s.*, CAST(row_number() OVER (PARTITION BY slide_id
  ORDER BY shape_id, kind, name, text, x_pt, y_pt, w_pt, h_pt, rot_deg, font_pt, fill_color) AS BIGINT) AS rn FROM {fx_shape} s) r""",
}

# The pixel view differs only in how an array is unrolled.
PIXEL_SPARK = """
SELECT vec_id AS image_id, CAST(p AS BIGINT) % 8 AS x, CAST(p AS BIGINT) DIV 8 AS y,
 CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS BIGINT) AS gray
FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS p, v"""
PIXEL_DUCK = """
SELECT vec_id AS image_id, p % 8 AS x, p // 8 AS y, CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS BIGINT) AS gray
FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS p, unnest(embedding) AS v FROM {embeddings})"""


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or an analysis view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = PIXEL_SPARK if name == "fx_pixel" else VIEWS[name]
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in _names(text)})


def check_sql(views: str, ctes: str, final: str) -> str:
    """SQL for the checking engine: the named views, then ``ctes``, then ``final``."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in needed:
            return
        text = PIXEL_DUCK if name == "fx_pixel" else VIEWS[name]
        for other in _names(text):
            add(other)
        needed.append(name)

    for view in views.split():
        add(view)
    parts = []
    for name in needed:
        text = PIXEL_DUCK if name == "fx_pixel" else VIEWS[name]
        parts.append(f"{name} AS ({re.sub(r'[{}]', '', text)})")
    if ctes.strip():
        parts.append(ctes.strip())
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final.strip()
