"""Queries for gates, candidate choice and evaluation roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from deckloom.operators import evaluation as ev
from deckloom.operators import gates as gt
from deckloom.plans.registry import query

c = F.col


def score():
    return c("score_milli")


@query("prj15_editable_contract", "fx_eval_case", "", """
SELECT case_id, coalesce(score_milli % 4 + candidate_index - 1, 0) > 0 AND NOT score_milli % 5 = 0 AND score_milli % 7 <> 0 AND coalesce(passed, FALSE) AS editable FROM fx_eval_case""")
def prj15(t):
    reports = t.fx_eval_case.select(
        "case_id", (score() % 4).alias("native_shape_objects"), (c("candidate_index") - 1).alias("picture_objects"),
        F.when(score() % 5 != 0, F.lit(False)).alias("flattened_slide"),
        F.when(score() % 7 == 0, 1).otherwise(0).alias("canvas_overflow_count"), c("passed").alias("compatible"))
    return gt.editable_contract(reports).select("case_id", "editable")


ERR = """CASE score_milli % 6 WHEN 0 THEN 'You exceeded your current quota' WHEN 1 THEN 'read timeout' WHEN 2 THEN 'status 503 from upstream' WHEN 3 THEN 'billing hard limit timeout' WHEN 4 THEN 'bad request' END"""


@query("prj16_classify_error", "fx_eval_case", "", """
SELECT case_id, CASE score_milli % 6 WHEN 0 THEN 'blocked_external' WHEN 1 THEN 'transient' WHEN 2 THEN 'transient' WHEN 3 THEN 'permanent' WHEN 4 THEN CASE WHEN candidate_index = 2 THEN 'transient' ELSE 'permanent' END END AS error_class FROM fx_eval_case""")
def prj16(t):
    rows = t.fx_eval_case.select("case_id", F.expr(ERR).alias("error"), F.when(
        c("candidate_index") == 2, "APITimeoutError").otherwise("ValueError").alias("error_type"))
    return gt.classify_error(rows).select("case_id", "error_class")


@query("prj17_review_approved", "fx_review", "", """
SELECT slide_id, content_preserved AND layout_valid AND score_tenths >= CASE WHEN slide_id % 2 = 0 THEN 60 ELSE 80 END AND (slide_id % 3 <> 0 OR score_tenths >= 80) AS approved FROM fx_review""")
def prj17(t):
    yes = F.lit(True)
    tenth = c("score_tenths") / 10
    reviews = t.fx_review.select(
        "slide_id", "content_preserved", "layout_valid", yes.alias("instruction_fulfilled"),
        yes.alias("production_notes_removed"), yes.alias("editability_preserved"), yes.alias("balanced_density"),
        tenth.alias("score"), F.create_map(F.lit(1), tenth).alias("slide_scores"),
        F.when(c("slide_id") % 3 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("selected_slides"),
        F.when(c("slide_id") % 2 == 0, "notes").otherwise("beautify").alias("operation"),
        yes.alias("operation_checks_passed"), yes.alias("notes_removed_gate"), yes.alias("ooxml_compatible"),
        yes.alias("content_gate"), F.lit(None).cast("boolean").alias("invariants_passed"))
    # Without selected slides every vote must be 8 or more; odd-numbered slides have no votes there.
    reviews = reviews.withColumn("slide_scores", F.when(c("slide_id") % 3 == 0, c("slide_scores")).otherwise(
        F.create_map().cast("map<int,double>")))
    return gt.review_approved(reviews).select("slide_id", "approved")


FIG = "score_milli / 1000.0::DOUBLE"


def figures(t):
    unit = score() / 1000
    return t.fx_eval_case.select(
        "case_id", "run_id", "candidate_index", "passed", score().alias("score_milli"), unit.alias("geometry_score"),
        (score() * 7 % 1001 / 1000).alias("worst_local_iou"), (score() * 11 % 1001 / 1000).alias("foreground_color_similarity"),
        (score() * 13 % 1001 / 1000).alias("gradient_profile_similarity"), F.lit(0.97).alias("review_geometry_score"),
        F.lit(0.95).alias("review_local_score"), F.lit(0.99).alias("review_style_score"),
        F.lit(0.98).alias("review_color_score"), unit.alias("review_gradient_score"), (score() % 3).alias("major_issues"))


@query("prj18_figure_acceptance", "fx_eval_case", "", """
SELECT case_id, score_milli >= 500 AS global_geometry, candidate_index = 1 OR score_milli * 11 % 1001 >= 960 AS foreground_color, score_milli % 3 = 0 AS no_major_issues,
 score_milli >= 500 AND score_milli * 7 % 1001 >= 300 AND (candidate_index = 1 OR score_milli * 11 % 1001 >= 960) AND (candidate_index = 1 OR score_milli * 13 % 1001 >= 200) AND score_milli >= 200 AND score_milli % 3 = 0 AS accepted FROM fx_eval_case""")
def prj18(t):
    out = gt.figure_acceptance(figures(t), {"geometry": 0.5, "local": 0.3, "gradient": 0.2}, c("candidate_index") != 1)
    return out.select("case_id", "global_geometry", "foreground_color", "no_major_issues", "accepted")


@query("prj23_quality_routing", "fx_eval_case", "", """
SELECT case_id, candidate_index >= 2 AND (score_milli < 860 OR score_milli * 7 % 1001 < 680 OR (score_milli * 11 % 1001 < 720 AND score_milli % 2 = 0)) AS escalate FROM fx_eval_case""")
def prj23(t):
    region = F.struct(F.when(score() % 2 == 0, "shape").otherwise("text").alias("kind"),
                      (score() * 11 % 1001 / 1000).alias("structural_score"), F.lit(0.1).alias("high_error_fraction"),
                      F.lit(0.0).alias("pixel_mae"))
    rows = t.fx_eval_case.select(
        "case_id", c("candidate_index").alias("correction_index"), (score() / 1000).alias("structural_score"),
        (score() * 7 % 1001 / 1000).alias("worst_significant_object_similarity"), F.array(region).alias("object_regions"))
    return gt.quality_routing(rows).select("case_id", "escalate")


@query("ag30_objective", "fx_eval_case", "", f"""
SELECT case_id, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - {FIG}) * 0.28::DOUBLE + greatest(0.0::DOUBLE, 1.0::DOUBLE - score_milli * 7 % 1001 / 1000.0::DOUBLE) * 0.28::DOUBLE
 + (score_milli * 3 % 1001 / 1000.0::DOUBLE * 0.70::DOUBLE + score_milli * 5 % 1001 / 1000.0::DOUBLE * 0.30::DOUBLE) * 0.24::DOUBLE + score_milli * 9 % 1001 / 1000.0::DOUBLE * 0.20::DOUBLE
 + greatest(0, score_milli - 32) / 1000.0::DOUBLE * 0.01::DOUBLE, 8) AS loss FROM fx_eval_case""")
def ag30(t):
    rows = figures(t).withColumns({
        "profile_mae": score() * 3 % 1001 / 1000, "profile_p95": score() * 5 % 1001 / 1000,
        "gradient_profile_mae": score() * 9 % 1001 / 1000, "command_count": score()})
    return gt.objective(rows).select("case_id", "loss")


@query("ag22_usage_cost", "fx_job_event", "", """
SELECT job_id, event_type, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
 CAST(sum(input_tokens * 5 + output_tokens * 30) AS DOUBLE) / 1000000 AS cost_usd FROM fx_job_event GROUP BY 1, 2""")
def ag22(t):
    return gt.usage_cost(t.fx_job_event, ["job_id", "event_type"])


BUDGET_CTE = """rs AS (SELECT job_id, sequence, sum(input_tokens * 5 + output_tokens * 30) OVER (PARTITION BY job_id ORDER BY sequence) AS spent FROM fx_job_event)"""


@query("wn05_budget_breach", "fx_job_event", BUDGET_CTE, """
SELECT job_id, min(sequence) AS pressure_at, min(sequence) FILTER (spent > 100000) AS breach_at, CAST(min(spent) FILTER (spent > 100000) AS DOUBLE) / 1000000 AS spent_usd
FROM rs WHERE spent * 10 >= 800000 GROUP BY 1""")
def wn05(t):
    return gt.budget_breach(t.fx_job_event, 0.1)


@query("wn06_early_accept", "fx_eval_case", """st AS (SELECT run_id, min(case_id) AS stop FROM fx_eval_case WHERE passed AND (score_milli >= 900 OR candidate_index = 3) GROUP BY 1)""", """
SELECT run_id, case_id, coalesce(case_id = stop, FALSE) AS stopped_here FROM fx_eval_case LEFT JOIN st USING (run_id) WHERE stop IS NULL OR case_id <= stop""")
def wn06(t):
    cands = t.fx_eval_case.select("run_id", "case_id", F.coalesce("passed", F.lit(False)).alias("approved"),
                                  (score() / 100).alias("score"), (c("candidate_index") == 3).alias("budget_pressure"))
    return gt.early_accept(cands, "run_id", "case_id").select("run_id", "case_id", "stopped_here")


@query("so03_best_candidate", "fx_eval_case", "", """
SELECT run_id, case_id, score_milli AS score FROM fx_eval_case WHERE passed QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY score_milli DESC, case_id) = 1""")
def so03(t):
    cands = t.fx_eval_case.select("run_id", "case_id", score().alias("score"),
                                  F.coalesce("passed", F.lit(False)).alias("gate_passed"))
    return gt.best_candidate(cands, "run_id", "case_id").select("run_id", "case_id", "score")


@query("wn08_lexicographic_best", "fx_eval_case", f"""f AS (SELECT run_id, case_id, {FIG} AS g, score_milli * 7 % 1001 / 1000.0::DOUBLE AS l, score_milli * 11 % 1001 / 1000.0::DOUBLE AS fc, score_milli * 13 % 1001 / 1000.0::DOUBLE AS gp FROM fx_eval_case)""", """
SELECT run_id, case_id, least(g, l, fc, gp) AS critical_quality FROM f QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY least(g, l, fc, gp) DESC, l DESC, g DESC, fc DESC, gp DESC, case_id) = 1""")
def wn08(t):
    return gt.lexicographic_best(figures(t), "run_id", "case_id").select("run_id", "case_id", "critical_quality")


@query("wn09_simplest_near_best", "fx_eval_case", f"""f AS (SELECT run_id, case_id, {FIG} AS q, score_milli * 7 % 1001 / 1000.0::DOUBLE AS l, case_id % 50 AS n, max({FIG}) OVER (PARTITION BY run_id) AS top FROM fx_eval_case)""", """
SELECT run_id, case_id, n AS command_count FROM f WHERE q >= top - 0.05::DOUBLE QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n, q DESC, l DESC, case_id) = 1""")
def wn09(t):
    cands = figures(t).select("run_id", "case_id", c("geometry_score").alias("quality"),
                              c("worst_local_iou").alias("local_score"), (c("case_id") % 50).alias("command_count"))
    return gt.simplest_near_best(cands, "run_id", "case_id", 0.05).select("run_id", "case_id", "command_count")


OK = "('first valid', 'global gain', 'structural gain', 'changed objects gain')"
BEST = ", ".join(f"CASE WHEN reason IN {OK} THEN {n} ELSE {b} END" for n, b in zip(
    ("sim", "st", "wo", "ra", "rb"), ("bs", "bt", "bw", "ba", "bb")))


@query("wn07_accepted_trail", "fx_eval_case", f"""r AS (SELECT run_id, case_id, coalesce(passed, TRUE) AS ed, {FIG} AS sim, score_milli * 7 % 1001 / 1000.0::DOUBLE AS st, score_milli * 11 % 1001 / 1000.0::DOUBLE AS wo,
 case_id % 50 / 50.0::DOUBLE AS ra, case_id % 40 / 40.0::DOUBLE AS rb, case_id % 3 AS ch, row_number() OVER (PARTITION BY run_id ORDER BY case_id) AS rn FROM fx_eval_case),
tr AS (SELECT run_id, case_id, rn, CASE WHEN ed THEN 'first valid' ELSE 'not editable' END AS reason, CASE WHEN ed THEN sim END AS bs, CASE WHEN ed THEN st END AS bt, CASE WHEN ed THEN wo END AS bw,
  CASE WHEN ed THEN ra END AS ba, CASE WHEN ed THEN rb END AS bb FROM r WHERE rn = 1
 UNION ALL SELECT run_id, case_id, rn, reason, {BEST}
 FROM (SELECT r.*, bs, bt, bw, ba, bb, CASE WHEN NOT ed THEN 'not editable' WHEN bs IS NULL THEN 'first valid' WHEN sim >= bs + 0.0005::DOUBLE THEN 'global gain'
   WHEN sim >= bs - 0.005::DOUBLE AND (st >= bt + 0.01::DOUBLE OR wo >= bw + 0.02::DOUBLE) THEN 'structural gain'
   WHEN sim >= bs - 0.005::DOUBLE AND (ch = 1 AND ra - ba >= 0.015::DOUBLE OR ch = 2 AND ((ra - ba + rb - bb) / 2 >= 0.015::DOUBLE AND least(ra - ba, rb - bb) >= -0.03::DOUBLE)) THEN 'changed objects gain' ELSE 'no gain' END AS reason FROM tr JOIN r ON r.run_id = tr.run_id AND r.rn = tr.rn + 1))""", f"""
SELECT run_id, case_id, reason IN {OK} AS accepted, reason FROM tr""")
def wn07(t):
    a, b = c("case_id") % 50 / 50, c("case_id") % 40 / 40
    changed = F.when(c("case_id") % 3 == 1, F.array(F.lit("a"))).when(c("case_id") % 3 == 2, F.array(F.lit("a"), F.lit("b")))
    cands = t.fx_eval_case.select(
        "run_id", "case_id", F.coalesce("passed", F.lit(True)).alias("editable"), (score() / 1000).alias("similarity_score"),
        (score() * 7 % 1001 / 1000).alias("structural_score"), (score() * 11 % 1001 / 1000).alias("worst_object"),
        F.coalesce(changed, F.array().cast("array<string>")).alias("changed_ids"), F.array(F.lit("a"), F.lit("b")).alias("region_ids"),
        F.array(a, b).alias("region_structure"), F.array(F.lit(0.5), F.lit(0.5)).alias("region_similarity"))
    return gt.accepted_trail(cands, "run_id", "case_id")


@query("ag21_average_reviews", "fx_review", "v AS (SELECT * FROM fx_review)", """
SELECT candidate_id, count(*) AS votes, bool_and(content_preserved) AS content_preserved, bool_and(layout_valid) AS layout_valid,
 round(CAST(sum(score_tenths) AS DOUBLE) / count(*), 4) AS score FROM v GROUP BY 1""")
def ag21(t):
    return ev.average_reviews(review_votes(t), ["candidate_id"]).drop("relative_improvement")


@query("ag21_review_issues", "fx_review", """fi AS (SELECT candidate_id, CASE WHEN score_tenths < 50 THEN 'low contrast' ELSE 'crowded ' || score_tenths % 50 END AS issue, min(slide_id) AS o FROM fx_review GROUP BY 1, 2)""", """
SELECT candidate_id, row_number() OVER (PARTITION BY candidate_id ORDER BY o, issue) AS rank, issue FROM fi""")
def ag21c(t):
    return ev.review_issues(review_votes(t), ["candidate_id"])


def review_votes(t):
    issue = F.when(c("score_tenths") < 50, "low contrast").otherwise(
        F.concat(F.lit("crowded "), (c("score_tenths") % 50).cast("string")))
    return t.fx_review.select("candidate_id", c("slide_id").alias("vote"), "content_preserved", "layout_valid",
                               c("score_tenths").alias("score"), F.lit(None).cast("double").alias("relative_improvement"),
                               F.array(issue).alias("issues"))


@query("ag21_average_scores", "fx_review", """m AS (SELECT candidate_id, unnest(['layout', CASE WHEN content_preserved THEN 'content' END]) AS name, score_tenths FROM fx_review),
n AS (SELECT candidate_id, count(*) AS n FROM fx_review GROUP BY 1)""", """
SELECT candidate_id, name, round(CAST(sum(score_tenths) AS DOUBLE) / any_value(n), 4) AS score FROM m JOIN n USING (candidate_id) WHERE name IS NOT NULL GROUP BY 1, 2""")
def ag21b(t):
    layout = F.create_map(F.lit("layout"), c("score_tenths"))
    both = F.create_map(F.lit("layout"), c("score_tenths"), F.lit("content"), c("score_tenths"))
    votes = t.fx_review.select("candidate_id", F.when(c("content_preserved"), both).otherwise(layout).alias("scores"))
    return ev.average_scores(votes, ["candidate_id"], "scores")


@query("ag23_pass_rates", "fx_eval_case", "", """
SELECT CASE WHEN grouping(endpoint) = 1 THEN 'total' ELSE endpoint END AS endpoint, count(*) AS cases, count(passed) AS evaluated, count(*) - count(passed) AS blocked,
 count(*) FILTER (passed) AS passed, CASE WHEN count(passed) > 0 THEN round(count(*) FILTER (passed) / count(passed)::DOUBLE, 4) END AS pass_rate FROM fx_eval_case GROUP BY GROUPING SETS ((endpoint), ())""")
def ag23(t):
    return ev.pass_rates(t.fx_eval_case)


@query("ag24_qualification", "fx_eval_case", "", """
SELECT count(*) AS total, count(*) FILTER (passed) AS accepted, CAST(coalesce(min(score_milli) FILTER (passed), 0) AS DOUBLE) AS minimum_score,
 round(count(*) FILTER (passed IS NOT NULL) / count(*)::DOUBLE, 4) AS hard_gate_rate, round(CAST(sum(candidate_index) AS DOUBLE) / count(*), 4) AS mean_improvement,
 count(*) FILTER (passed) >= 18 AND coalesce(min(score_milli) FILTER (passed), 0) >= 0 AND count(*) FILTER (passed IS NOT NULL) / count(*)::DOUBLE >= 0.9 AND CAST(sum(candidate_index) AS DOUBLE) / count(*) >= 1 AS passed FROM fx_eval_case""")
def ag24(t):
    rows = t.fx_eval_case.select(F.coalesce("passed", F.lit(False)).alias("accepted"), score().cast("double").alias("score"),
                                 c("passed").isNotNull().alias("hard_gate_passed"),
                                 c("candidate_index").alias("improvement"))
    return ev.qualification(rows, 18, 0.0, 0.9, 1.0)


@query("ag25_run_summary", "fx_eval_case", "", """
SELECT run_id, count(*) AS case_count, count(*) FILTER (passed IS NOT NULL) AS success_count, round(avg(score_milli), 6) AS mean_similarity,
 coalesce(bool_and(score_milli > 20) FILTER (passed IS NOT NULL), FALSE) AS all_native FROM fx_eval_case GROUP BY 1""")
def ag25(t):
    rows = t.fx_eval_case.select("run_id", F.when(c("passed").isNotNull(), "success").otherwise("failed").alias("status"),
                                 score().alias("similarity_score"), (score() > 20).alias("editable"))
    return ev.run_summary(rows, ["run_id"])


@query("jn17_run_delta", "fx_eval_case", """p AS (SELECT run_id, endpoint, candidate_index, sum(score_milli) AS s FROM fx_eval_case GROUP BY ALL)""", """
SELECT a.run_id, a.endpoint, CAST(a.s AS BIGINT) AS base_score, CAST(b.s AS BIGINT) AS candidate_score, CAST(b.s - a.s AS BIGINT) AS delta FROM p a JOIN p b USING (run_id, endpoint) WHERE a.candidate_index = 1 AND b.candidate_index = 2""")
def jn17(t):
    sums = t.fx_eval_case.groupBy("run_id", "endpoint", "candidate_index").agg(F.sum("score_milli").alias("score"))
    return ev.run_delta(sums.filter("candidate_index = 1"), sums.filter("candidate_index = 2"), ["run_id", "endpoint"])


@query("jn18_cache_hits", "fx_eval_case", "", """
SELECT case_id, run_id FROM fx_eval_case WHERE coalesce(passed, FALSE) AND score_milli % 5 <> 0 AND candidate_index <> 2""")
def jn18(t):
    reports = t.fx_eval_case.select(
        "case_id", F.lit("1").alias("engine_version"), F.when(c("candidate_index") == 1, "m").alias("model"),
        F.lit(1).alias("native_shape_objects"), F.lit(0).alias("picture_objects"), F.lit(False).alias("flattened_slide"),
        F.when(score() % 5 == 0, 1).otherwise(0).alias("canvas_overflow_count"), c("passed").alias("compatible"))
    requests = t.fx_eval_case.select(
        "case_id", "run_id", F.when(c("candidate_index") == 2, "2").otherwise("1").alias("engine_version"),
        F.when(c("candidate_index") == 1, "m").alias("model"))
    return ev.cache_hits(requests, reports, config=["engine_version", "model"]).select("case_id", "run_id")


@query("jn19_pending_cases", "fx_eval_case", "", """
SELECT endpoint, case_id FROM fx_eval_case WHERE NOT coalesce(passed, FALSE)""")
def jn19(t):
    e = t.fx_eval_case
    return ev.pending_cases(e.select("endpoint", "case_id"), e, ["endpoint", "case_id"])


@query("jn20_lineage", "fx_lineage", """up AS (SELECT job_id, job_id AS root_id, CAST(0 AS BIGINT) AS depth FROM fx_lineage l WHERE parent_job_id IS NULL OR parent_job_id NOT IN (SELECT job_id FROM fx_lineage)
 UNION ALL SELECT l.job_id, up.root_id, up.depth + 1 FROM fx_lineage l JOIN up ON l.parent_job_id = up.job_id)""", "SELECT * FROM up")
def jn20(t):
    return ev.lineage(t.fx_lineage).drop("reason")


@query("jn20_lineage_cycles", "orders", """g AS (SELECT o_orderkey AS job_id, o_custkey % 2 = 0 AS round, min(o_orderkey) OVER w AS least, max(o_orderkey) OVER w AS most,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 AS above FROM orders WINDOW w AS (PARTITION BY o_custkey))""", """
SELECT job_id, CASE WHEN round THEN least ELSE most END AS root_id, CASE WHEN NOT round THEN above END AS depth, CASE WHEN round THEN 'cycle' END AS reason FROM g""")
def jn20_cycles(t):
    """Each customer's orders are a chain of jobs; those of every other customer are closed to a cycle."""
    own = Window.partitionBy("o_custkey")
    later = F.lead("o_orderkey").over(own.orderBy("o_orderkey"))
    jobs = t.orders.select(c("o_orderkey").alias("job_id"), F.coalesce(
        later, F.when(c("o_custkey") % 2 == 0, F.min("o_orderkey").over(own))).alias("parent_job_id"))
    return ev.lineage(jobs)


@query("jn21_stale_plans", "orders customer", "", """
SELECT o_orderkey AS plan_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > -900 WHERE c_custkey IS NULL OR o_orderstatus <> 'F' AND c_mktsegment = 'BUILDING'""")
def jn21(t):
    plans = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select(
        c("o_orderkey").alias("plan_id"), c("o_custkey").alias("source_artifact_id"),
        F.when((c("o_orderstatus") != "F") & (c("c_mktsegment") == "BUILDING"), F.lit("old"))
        .otherwise(c("c_name")).alias("source_sha256"))
    artifacts = t.customer.filter("c_acctbal > -900").select(c("c_custkey").alias("artifact_id"), c("c_name").alias("sha256"))
    return ev.stale_plans(plans, artifacts).select("plan_id")


@query("so01_list_recent", "fx_job_event", "", """
SELECT sequence, job_id, event_type FROM fx_job_event WHERE event_type <> 'job.exception' ORDER BY created_at DESC, sequence DESC""")
def so01(t):
    return ev.list_recent(t.fx_job_event, live=c("event_type") != "job.exception").select(
        "sequence", "job_id", "event_type")


@query("st04_expire_jobs", "fx_job_event", """f AS (SELECT job_id, max(created_at) AS finished_at FROM fx_job_event WHERE event_type = 'job.exception' GROUP BY 1)""", """
SELECT job_id, sequence FROM fx_job_event WHERE job_id IN (SELECT job_id FROM f WHERE finished_at < TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 30 DAY)""")
def st04(t):
    jobs = t.fx_job_event.filter("event_type = 'job.exception'").groupBy("job_id").agg(
        F.max("created_at").alias("finished_at"))
    gone = ev.expire_jobs(jobs, F.lit("2024-02-20 00:00:00").cast("timestamp"), 30)
    return ev.expire_dependents(gone, t.fx_job_event.select("job_id", "sequence"))
