"""Streaming queries: the stream's final table against the batch answer in SQL.

The events arrive in parts; their streams read what is there through the file source, run to the end and are started again for the next part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from deckloom.plans.eval_queries import BUDGET_CTE
from deckloom.plans.registry import query
from deckloom.session import shared_dir
from deckloom.streaming import events as st

c = F.col


#: Parts in which a table arrives; the stream is started anew for each.
PARTS = 4


def in_parts(t, table, key: str, run) -> None:
    """Let a table arrive in parts of rising key: each is added to a folder, and ``run`` gets the folder's stream."""
    path = shared_dir(t.spark, "arriving")
    least, most = table.agg(F.min(key), F.max(key)).first()
    part = F.floor((c(key) - least) * PARTS / (most - least + 1))
    for i in range(PARTS):
        table.filter(part == i).write.mode("append").parquet(path)
        run(t.spark.readStream.schema(table.schema).parquet(path))


def job_events(raw):
    """The events table's rows as job events."""
    kind = c("event_type")
    status = (F.when(kind == "signup", "queued").when(kind == "view", "running").when(kind == "click", "reviewing")
              .when(kind == "purchase", "succeeded").otherwise("failed"))
    return raw.select(
        c("user_id").alias("job_id"), c("event_id").alias("sequence"), c("ts").alias("created_at"),
        status.alias("status"), F.when(kind == "click", c("value") / 50).alias("progress"),
        F.when(kind != "view", kind).alias("stage"),
        F.floor(c("value") * 100).cast("bigint").alias("input_tokens"),
        F.floor(c("value") * 7).cast("bigint").alias("output_tokens"))


STATUS_CTE = """ev AS (SELECT user_id AS job_id, event_id AS sequence, ts AS created_at, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'reviewing' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status,
 CASE WHEN event_type = 'click' THEN value / 50 END AS progress, CASE WHEN event_type <> 'view' THEN event_type END AS stage FROM events)"""


@query("st01_tail_events", "events", STATUS_CTE + ", fi AS (SELECT job_id, min(sequence) AS last FROM ev WHERE status IN ('succeeded', 'failed') GROUP BY 1)", """
SELECT job_id, sequence, status FROM ev LEFT JOIN fi USING (job_id) WHERE sequence > 10 AND (last IS NULL OR sequence <= last)""")
def st01(t):
    path = shared_dir(t.spark, "tail")
    in_parts(t, t.events, "event_id", lambda raw: st.tail_stream(job_events(raw), f"{path}/log", f"{path}/checkpoint"))
    return st.tail_events(t.spark.read.parquet(f"{path}/log"), 10).select("job_id", "sequence", "status")


@query("st02_job_state", "events", STATUS_CTE, """
SELECT job_id, max(sequence) AS last_sequence, arg_max(status, sequence) AS status, CASE WHEN arg_max(status, sequence) = 'succeeded' THEN 1.0::DOUBLE ELSE coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, arg_max(progress, sequence) FILTER (progress IS NOT NULL))), 0.0::DOUBLE) END AS progress,
 arg_max(stage, sequence) FILTER (stage IS NOT NULL) AS stage, CAST(min(created_at) FILTER (status = 'running') AS VARCHAR) AS started_at FROM ev GROUP BY 1""")
def st02(t):
    path = shared_dir(t.spark, "job-state")
    in_parts(t, t.events, "event_id", lambda raw: st.job_state_stream(job_events(raw), f"{path}/state", f"{path}/checkpoint"))
    return st.read_job_state(t.spark, f"{path}/state").select(
        "job_id", "last_sequence", "status", "progress", "stage", c("started_at").cast("string").alias("started_at"))


@query("st03_spend_monitor", "fx_job_event", BUDGET_CTE, """
SELECT job_id, min(sequence) AS breach_at, CAST(min(spent) AS DOUBLE) / 1000000 AS spent_usd FROM rs WHERE spent > 100000 GROUP BY 1""")
def st03(t):
    path = shared_dir(t.spark, "spend")
    in_parts(t, t.events, "event_id", lambda raw: st.spend_monitor(job_events(raw), 0.1, f"{path}/spend", f"{path}/checkpoint"))
    return st.read_breaches(t.spark, f"{path}/spend")


@query("st05_ingest_templates", "documents", """d AS (SELECT doc_id, sha256(text) AS s, n_chars, lang FROM documents),
f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id) = 1),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) = 1)""", """
SELECT doc_id AS template_id, 'family-' || left(sha256(lang || ':1|' || min(doc_id) OVER (PARTITION BY lang)), 16) AS family_id FROM k""")
def st05(t):
    from deckloom.streaming.templates import ingest_templates

    path = shared_dir(t.spark, "templates")
    raw = t.spark.readStream.schema(t.documents.schema).parquet(f"{t.sf_dir}/documents*.parquet")
    # Equal lengths stand for equal renders: their hashes agree, others are far apart.
    decks = raw.select(c("doc_id").alias("template_id"), F.sha2("text", 256).alias("sha256"),
                       F.substring(F.sha2(c("n_chars").cast("string"), 256), 1, 16).alias("phash"),
                       (c("n_chars") % 5).alias("slide_count"), F.array("lang").alias("archetypes"))
    ingest_templates(decks, path, f"{path}/checkpoint")
    return t.spark.read.parquet(f"{path}/templates").select("template_id", "family_id")
