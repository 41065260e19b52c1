"""Backups of job collections: a folder of JSON lines, one envelope line, one line per setting, one per job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake import schemas
from cuelake.functions.checks import with_reasons
from cuelake.functions.rules import violations
from cuelake.operators.store import duplicate_identities, job_checks, normalize_jobs, setting_key_ok, upsert
from cuelake.operators.validation import JOB_RULES, NESTED, setting_violations

# Fixed values.
BACKUP_VERSIONS = [1, 2]

# a job line: the flat columns and the nested rows
JOB = f"{schemas.BACKUP_JOB[:-1]}, {NESTED}>"


def backup_lines(jobs: DataFrame, settings: DataFrame, exported_at: str, tag: str = "transcript-backup") -> DataFrame:
    """lines(kind, line). Version 2 as soon as there is a slides job; reserved settings stay out."""
    info = jobs.agg(
        F.max(F.when(F.col("processing_mode") == "slides", 2).otherwise(1)).alias("v"), F.count(F.lit(1)).alias("n"))
    envelope = info.select(
        F.lit("envelope").alias("kind"),
        F.to_json(F.struct(F.lit(tag).alias("format"), F.coalesce("v", F.lit(1)).alias("version"), F.lit(exported_at).alias("exportedAt"), F.col("n").alias("jobs"))).alias("line"))
    kept = settings.where(setting_key_ok(F.col("key"))).select(
        F.lit("setting").alias("kind"), F.to_json(F.struct("key", "value")).alias("line"))
    rows = jobs.select(F.lit("job").alias("kind"), F.to_json(F.struct(*jobs.columns)).alias("line"))
    return envelope.unionByName(kept).unionByName(rows)


def read_settings(lines: DataFrame) -> DataFrame:
    """key, value of the settings of a backup."""
    rows = lines.where(F.col("kind") == "setting")
    return rows.select(F.from_json("line", "STRUCT<key: STRING, value: STRING>").alias("s")).select("s.*")


def read_backup(lines: DataFrame, tag: str = "transcript-backup") -> tuple[DataFrame, DataFrame]:
    """(jobs, problems) from backup lines. Any problem rejects the whole backup: ``jobs`` is then
    empty. Problems: bad_envelope, invalid_job, slides_in_version_1, duplicate_id, lost_jobs,
    invalid_setting. Jobs are checked down to their nested rows (`job_violations` tells the places)."""
    env = lines.where(F.col("kind") == "envelope").select(
        F.from_json("line", "STRUCT<format: STRING, version: INT, jobs: BIGINT>").alias("e")).select("e.*")
    parsed = lines.where(F.col("kind") == "job").select(F.from_json("line", JOB).alias("j")).select("j.*")
    jobs = normalize_jobs(parsed)
    whole_row = F.struct(*[F.col(c) for c in parsed.columns])
    bad = with_reasons(parsed, job_checks()).withColumn("nested", violations(whole_row, JOB_RULES))
    bad = bad.where((F.size("reasons") > 0) | (F.size("nested") > 0)).agg(F.count(F.lit(1)).alias("n"))
    wrong = setting_violations(read_settings(lines)).agg(F.count(F.lit(1)).alias("n"))
    twice = duplicate_identities(jobs).agg(F.count(F.lit(1)).alias("n"))
    totals = jobs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("processing_mode") == "slides").alias("slides"))
    good = env.where((F.col("format") == tag) & F.col("version").isin(BACKUP_VERSIONS))
    head = good.agg(F.count(F.lit(1)).alias("envelopes"), F.max("version").alias("version"), F.max("jobs").alias("listed"))
    # Each side is one row of totals; stacking them keeps this free of joins.
    one = lambda df, name, ok: df.select(F.lit(name).alias("problem"), ok.alias("found"))
    sides = head.unionByName(totals.select(F.col("n").alias("got"), "slides"), allowMissingColumns=True)
    facts = sides.agg(*[F.max(c).alias(c) for c in sides.columns])
    problems = (
        one(facts, "bad_envelope", F.col("envelopes") != 1)
        .unionByName(one(facts, "lost_jobs", F.coalesce(F.col("listed") != F.col("got"), F.lit(False))))
        .unionByName(one(facts, "slides_in_version_1", F.coalesce((F.col("version") == 1) & (F.col("slides") > 0), F.lit(False))))
        .unionByName(one(bad, "invalid_job", F.col("n") > 0)).unionByName(one(twice, "duplicate_id", F.col("n") > 0))
        .unionByName(one(wrong, "invalid_setting", F.col("n") > 0))
    ).where("found").select("problem")
    blocked = not problems.limit(1).isEmpty()
    return (jobs.limit(0) if blocked else jobs), problems


def import_backup(existing: DataFrame, lines: DataFrame, tag: str = "transcript-backup") -> DataFrame:
    """Existing jobs with the backup's jobs on top, or unchanged when the backup is rejected."""
    jobs, _ = read_backup(lines, tag)
    fresh = jobs.select(*existing.columns).withColumn("ord", F.lit(0).cast("bigint"))
    return upsert(existing, fresh)


def import_all(
    jobs: DataFrame, settings: DataFrame, lines: DataFrame, tag: str = "transcript-backup"
) -> tuple[DataFrame, DataFrame]:
    """(jobs, settings): the backup's jobs and settings (key, value) on top of those there are, or both
    unchanged when anything of the backup is rejected."""
    fresh, problems = read_backup(lines, tag)
    if not problems.limit(1).isEmpty():
        return jobs, settings
    rank = F.lit(0).cast("bigint")
    return (
        upsert(jobs, fresh.select(*jobs.columns).withColumn("ord", rank)),
        upsert(settings, read_settings(lines).select(*settings.columns).withColumn("ord", rank), "key"),
    )
