"""Runs and outcomes: counters, status, errors, repairs, walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRIGGERS, STATUSES = ("scheduled", "manual", "catch_up"), ("running", "success", "partial", "failed")


def run_status(ok: Column, failed: Column) -> Column:
    """No source is a success; none that worked, a failure; some that did not, partial."""
    return F.when((ok + failed) == 0, "success").when(ok == 0, "failed").when(failed > 0, "partial").otherwise("success")


def last_outcomes(outcomes: DataFrame, order: list[str]) -> DataFrame:
    """One row per (run_id, source): the last write wins."""
    row = F.struct(*[c for c in outcomes.columns if c not in ("run_id", "source")])
    return outcomes.groupBy("run_id", "source").agg(F.max_by(row, F.struct(*order)).alias("row")).select("run_id", "source", "row.*")


def succeeded_sources(outcomes: DataFrame) -> DataFrame:
    """(run_id, source, exhaustive) of outcomes that worked."""
    return outcomes.where("succeeded").groupBy("run_id", "source").agg(F.min(F.coalesce("exhaustive", F.lit(True))).alias("exhaustive"))


def of_succeeded(postings: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The postings whose source's outcome is a success; those of failed or unheard-of sources are skipped."""
    return postings.join(outcomes.where("succeeded").select("source"), "source", "left_semi")


def run_metrics(outcomes: DataFrame) -> DataFrame:
    """Per run: sources that worked or not, their status, and the failed ones with their errors, by name."""
    failed = F.when(~F.col("succeeded"), F.struct("source", F.coalesce("error", F.lit("unknown error")).alias("error")))
    rows = outcomes.groupBy("run_id").agg(
        F.count_if("succeeded").alias("n_sources_ok"), F.count_if(~F.col("succeeded")).alias("n_sources_err"), F.sum("n_fetched").alias("n_fetched"), F.array_sort(F.collect_list(failed)).alias("failed")
    )
    text = F.array_join(F.transform("failed", lambda x: F.concat(x["source"], F.lit(": "), x["error"])), "; ")
    return rows.withColumns({"status": run_status(F.col("n_sources_ok"), F.col("n_sources_err")), "error": F.nullif(text, F.lit("")), "source_errors": F.map_from_entries("failed")})


def upsert_metrics(judged: DataFrame, snapshot: DataFrame) -> DataFrame:
    """n_new counts uids, n_updated the other kept postings, repeats among them, n_filtered what the gates dropped."""
    uids = snapshot.select(F.col("job_uid").alias("_uid"))
    rows = judged.join(uids, F.col("job_uid") == F.col("_uid"), "left")
    new = F.count_distinct(F.when(F.col("keep") & F.col("_uid").isNull(), F.col("job_uid")))
    return rows.agg(new.alias("n_new"), (F.count_if("keep") - new).alias("n_updated"), F.count_if(~F.col("keep")).alias("n_filtered"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row: the current run (a running one first, else the newest), the last success, and the last that completed."""
    newest = lambda condition: F.max(F.when(condition, F.col("run_id")))
    return runs.agg(
        F.coalesce(newest(F.col("status") == "running"), F.max("run_id")).alias("current_run"),
        newest(F.col("status") == "success").alias("last_success"),
        newest(F.col("status").isin("success", "partial")).alias("last_completed"),
    )


def reconcile_orphans(runs: DataFrame, as_of: Column, error: str = "interrupted") -> DataFrame:
    """Runs still marked as running have failed."""
    lost = F.col("status") == "running"
    return runs.withColumns(
        {"error": F.when(lost, F.coalesce("error", F.lit(error))).otherwise(F.col("error")), "finished_at": F.when(lost, as_of).otherwise(F.col("finished_at")), "status": F.when(lost, "failed").otherwise(F.col("status"))}
    )


def start_run(runs: DataFrame, run_id: int, as_of: Column, trigger: str) -> DataFrame:
    if trigger not in TRIGGERS:
        raise ValueError(f"trigger: {trigger}")
    row = runs.sparkSession.range(1).select(F.lit(run_id).cast("long").alias("run_id"), as_of.alias("started_at"), F.lit("running").alias("status"), F.lit(trigger).alias("trigger"))
    return runs.unionByName(row, allowMissingColumns=True)


def finish_run(runs: DataFrame, run_id: int, as_of: Column, status: str, **counts: int) -> DataFrame:
    if status not in STATUSES[1:]:
        raise ValueError(f"status: {status}")
    mine = F.col("run_id") == run_id
    set_to = {"status": F.lit(status), "finished_at": as_of} | {c: F.lit(v) for c, v in counts.items()}
    types = dict(runs.dtypes)
    return runs.withColumns({c: F.when(mine, v).otherwise(F.col(c)).cast(types[c]) for c, v in set_to.items()})


def overdue_cycles(runs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Completed runs with the gap to the one before, whether that was over ``hours``, and whether the next is due at ``as_of``."""
    done = runs.where(F.col("status").isin("success", "partial"))
    by_time = W.orderBy("finished_at", "run_id")
    limit = F.make_dt_interval(F.lit(0), F.lit(hours))
    rows = done.withColumn("previous", F.lag("finished_at").over(by_time)).withColumn("following", F.lead("finished_at").over(by_time))
    return rows.select("run_id", "finished_at", "previous", F.coalesce(F.col("finished_at") - F.col("previous") > limit, F.lit(False)).alias("late"), (F.col("following").isNull() & (as_of - F.col("finished_at") >= limit)).alias("due"))


def run_history(runs: DataFrame, most: int = 20) -> DataFrame:
    return runs.orderBy(F.col("run_id").desc()).limit(most)


def with_outcomes(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Runs with their outcomes as a list, by source."""
    lists = outcomes.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("source", "succeeded", "n_fetched", "error"))).alias("outcomes"))
    return runs.join(lists, "run_id", "left")
