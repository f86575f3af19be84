"""Roll-ups of evaluation runs, reviews and job tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deckloom.operators.gates import editable_contract
from deckloom.operators.stored import materialize

c = F.col

# The configuration keys that must match for a cached report.
CACHE_KEYS = ["engine_version", "metric_version", "model", "quality_profile", "local_optimization",
              "powerpoint_validation_mode", "font_policy", "raster_policy", "requested_iterations", "target_score"]
COMPLETED_STATUSES = ["success", "cached", "rescored"]
REVIEW_FLAGS = ["instruction_fulfilled", "content_preserved", "production_notes_removed", "layout_valid",
                "editability_preserved", "balanced_density"]


def pass_rates(results: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """Cases, evaluated, blocked, passed and rate per endpoint, and ``total``; a null verdict is blocked."""
    rates = results.rollup(endpoint).agg(
        F.grouping(endpoint).alias("_g"), F.count("*").alias("cases"), F.count("passed").alias("evaluated"),
        F.count_if(c("passed").isNull()).alias("blocked"), F.count_if(c("passed")).alias("passed"))
    return rates.select(
        F.when(c("_g") == 1, "total").otherwise(c(endpoint)).alias(endpoint), "cases", "evaluated", "blocked",
        "passed", F.when(c("evaluated") > 0, F.round(c("passed") / c("evaluated"), 4)).alias("pass_rate"))


def qualification(results: DataFrame, minimum_accepted: int = 18, minimum_score: float = 8.0,
                  hard_gate_rate: float = 1.0, minimum_improvement: float = 1.0) -> DataFrame:
    """One row: accepted, least accepted score, hard-gate rate, mean improvement and ``passed``."""
    out = results.agg(
        F.count("*").alias("total"), F.count_if("accepted").alias("accepted"),
        F.coalesce(F.min(F.when(c("accepted"), c("score"))), F.lit(0.0)).alias("minimum_score"),
        F.count_if("hard_gate_passed").alias("_h"), F.coalesce(F.sum("improvement"), F.lit(0)).alias("_i"),
        F.count("improvement").alias("_n"))
    out = out.withColumns({"hard_gate_rate": c("_h") / F.greatest(F.lit(1), c("total")),
                           "mean_improvement": c("_i") / F.greatest(F.lit(1), c("_n"))})
    passed = ((c("accepted") >= minimum_accepted) & (c("minimum_score") >= minimum_score)
              & (c("hard_gate_rate") >= hard_gate_rate) & (c("mean_improvement") >= minimum_improvement))
    return out.select("total", "accepted", "minimum_score", F.round("hard_gate_rate", 4).alias("hard_gate_rate"),
                      F.round("mean_improvement", 4).alias("mean_improvement"), passed.alias("passed"))


def run_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cases, completed cases, mean similarity and whether every completed report is editable."""
    done = c("status").isin(COMPLETED_STATUSES)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("case_count"), F.count_if(done).alias("success_count"),
        F.avg("similarity_score").alias("_m"), F.bool_and(F.when(done, c("editable"))).alias("_a"))
    return out.select(*keys, "case_count", "success_count", F.round("_m", 6).alias("mean_similarity"),
                      F.coalesce(c("_a"), F.lit(False)).alias("all_native"))


def run_delta(base: DataFrame, candidate: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Score change of each case present in both runs."""
    a = base.select(*keys, c(score).alias("base_score"))
    b = candidate.select(*keys, c(score).alias("candidate_score"))
    return a.join(b, keys).withColumn("delta", c("candidate_score") - c("base_score"))


def delta_summary(deltas: DataFrame) -> DataFrame:
    return deltas.agg(F.count("*").alias("cases"), F.avg("delta").alias("mean_delta"), F.min("delta").alias("worst"),
                      F.count_if(c("delta") < 0).alias("regressions"))


def cache_hits(requests: DataFrame, reports: DataFrame, case: str = "case_id",
               config: list[str] | None = None) -> DataFrame:
    """Requests served by an existing report: same case, same configuration (null equals null), editable."""
    config = config or CACHE_KEYS
    usable = editable_contract(reports).filter("editable").select(case, *config).distinct()
    right = usable.select(*[c(n).alias(f"_{n}") for n in [case, *config]])
    same = c(case) == c(f"_{case}")
    for n in config:
        same = same & c(n).eqNullSafe(c(f"_{n}"))
    return requests.join(right, same, "left_semi")


def pending_cases(cases: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Cases without a passed result."""
    return cases.join(results.filter("passed").select(*keys), keys, "left_anti")


def stale_plans(plans: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Plans whose source artifact is gone or has another checksum now."""
    now = artifacts.select(c("artifact_id").alias("source_artifact_id"), c("sha256").alias("current_sha256"))
    return plans.join(now, "source_artifact_id", "left").filter(
        ~c("current_sha256").eqNullSafe(c("source_sha256")))


def average_reviews(votes: DataFrame, keys: list[str], order: str = "vote") -> DataFrame:
    """Flags that hold in every vote and the mean score; see ``review_issues`` for what the votes object to."""
    flags = [n for n in REVIEW_FLAGS if n in votes.columns]
    base = votes.groupBy(*keys).agg(
        F.count("*").alias("votes"), *[F.bool_and(n).alias(n) for n in flags], F.sum("score").alias("_s"),
        F.avg("relative_improvement").alias("_r"))
    return base.withColumns({"score": F.round(c("_s") / c("votes"), 4),
                             "relative_improvement": F.round("_r", 4)}).drop("_s", "_r")


def review_issues(votes: DataFrame, keys: list[str], order: str = "vote") -> DataFrame:
    """Every distinct issue of a key with its rank by first mention: (keys, rank, issue), in long form."""
    rows = votes.select(*keys, order, F.posexplode("issues").alias("_p", "issue"))
    first = rows.groupBy(*keys, "issue").agg(F.min(F.struct(order, "_p")).alias("_o"))
    return first.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "issue")).cast("bigint").alias("rank"),
                        "issue")


def average_scores(votes: DataFrame, keys: list[str], scores: str) -> DataFrame:
    """Mean of every score of a map column; a vote without the key counts as zero."""
    totals = votes.groupBy(*keys).agg(F.count("*").alias("_n"))
    long = votes.select(*keys, F.explode(scores).alias("name", "_v")).groupBy(*keys, "name").agg(
        F.sum("_v").alias("_s"))
    return long.join(totals, keys).select(*keys, "name", F.round(c("_s") / c("_n"), 4).alias("score"))


def list_recent(rows: DataFrame, created: str = "created_at", tie: str = "sequence",
                live: Column | None = None) -> DataFrame:
    """Live rows, newest first."""
    kept = rows.filter(live) if live is not None else rows
    return kept.orderBy(c(created).desc(), c(tie).desc())


def lineage(jobs: DataFrame, job: str = "job_id", parent: str = "parent_job_id") -> DataFrame:
    """Root and depth of every job, following parents; ``reason`` is null, or ``cycle`` for jobs that never reach a root.

    Pointer doubling: every round joins the jobs that have not reached a root with all jobs' last
    known ancestors and doubles the distance covered, so a chain of depth d takes log2(d) joins. Only unfinished jobs are
    carried on and written to the shared folder; finished ones stay where the round left them. A parent that is not in the table
    ends the chain at its child. As soon as a round brings no job to a root, all that are left lead into cycles: they come back with the
    least job of their cycle as ``root_id`` and no depth.
    """
    ids = jobs.select(c(job).alias("_known"))
    linked = jobs.select(job, parent).join(ids, c(parent) == c("_known"), "left")
    # ``_up`` is the ancestor ``depth`` steps above; a root stands above itself.
    start = linked.select(job, F.coalesce(c("_known"), c(job)).alias("_up"),
                          F.when(c("_known").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    start = materialize(start, "lineage")
    finished, left = start.filter(c("depth") == 0), start.filter(c("depth") > 0)
    done, n_left = [finished], left.count()
    roots = finished.select(c(job).alias("_up"), c("_up").alias("_root"), c("depth").alias("_above"))
    while n_left:
        step = left.select(c(job).alias("_up"), c("_up").alias("_next"), c("depth").alias("_d"))
        moved = materialize(left.join(roots, "_up", "left").join(step, "_up", "left").select(
            job, F.coalesce("_root", "_next", "_up").alias("_up"),
            (c("depth") + F.coalesce("_above", "_d", F.lit(0))).alias("depth"), c("_root").isNotNull().alias("_ended")), "lineage")
        ended = moved.filter("_ended").drop("_ended")
        left = moved.filter("NOT _ended").drop("_ended")
        before, n_left = n_left, left.count()
        if n_left == before:
            break
        done.append(ended)
        roots = roots.unionByName(ended.select(c(job).alias("_up"), c("_up").alias("_root"), c("depth").alias("_above")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = out.select(job, c("_up").alias("root_id"), "depth", F.lit(None).cast("string").alias("reason"))
    if not n_left:
        return out
    cyclic = _cycles(left.select(job).join(start.select(job, c("_up").alias(parent)), job), n_left, job, parent)
    return out.unionByName(cyclic.select(job, "root_id", F.lit(None).cast("bigint").alias("depth"), F.lit("cycle").alias("reason")))


def _cycles(links: DataFrame, n: int, job: str, parent: str) -> DataFrame:
    """``root_id``, the least job of the cycle that each of ``n`` jobs leads into; every parent is one of them.

    Doubling keeps the ancestor 2^k steps above and the least job on the way. It ends as soon as the ancestors are all on cycles (there are
    as many different ones as half the steps below: the step up then only turns them around) and a round lowers no least job (no later round
    can: each holds for the next as many steps as well). That takes as many rounds as the longest cycle and way to it, not as all jobs, ask for.
    """
    known = materialize(links.select(c(job).alias("_job"), c(parent).alias("_up"), c(job).alias("_least")).distinct(), "cycles")
    steps, ancestors, turning = 1, known.select("_job").distinct().count(), False
    while steps < n:
        if not turning:
            before, ancestors = ancestors, known.select("_up").distinct().count()
            turning = ancestors == before
        above = known.select(c("_job").alias("_up"), c("_up").alias("_next"), c("_least").alias("_there"))
        known = materialize(known.join(above, "_up").select(
            "_job", c("_next").alias("_up"), F.least("_least", "_there").alias("_least"), (c("_there") < c("_least")).alias("_lowered")), "cycles")
        steps *= 2
        if turning and known.filter("_lowered").isEmpty():
            break
    there = known.select(c("_job").alias("_up"), c("_least").alias("root_id"))
    return known.select(c("_job").alias(job), "_up").join(there, "_up").select(job, "root_id")


def expire_jobs(jobs: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    """Finished jobs older than the time to live; jobs with a missing or malformed stamp stay."""
    done = F.try_to_timestamp(c("finished_at").cast("string"))
    return jobs.filter(done.isNotNull() & (done < now - F.make_dt_interval(F.lit(ttl_days))))


def expire_dependents(expired: DataFrame, dependents: DataFrame, job: str = "job_id") -> DataFrame:
    """Artifacts, plans or events of expired jobs."""
    return dependents.join(expired.select(job), job, "left_semi")
