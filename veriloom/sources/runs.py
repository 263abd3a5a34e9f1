"""Verified run folders: an index of runs, the files below each, and what a scan refuses.

``index(run_id, path, sha256, schema_version)`` names every file of every run with its digest; ``files(run_id, path, content)`` are the
files that are there.  Everything is one join of digests by run and path, so a run of any number of files is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ArtifactError

#: A run that has this file was not finished.
INCOMPLETE = ".INCOMPLETE"


def scan_findings(index: DataFrame, files: DataFrame, versions: tuple[int, ...] = (1,)) -> DataFrame:
    """``run_id, rule``, each once: missing, unlisted and changed files, unfinished runs, a file listed twice, one file digest under
    two runs' records, and schema versions that aren't supported."""
    there = files.filter(F.col("path") != INCOMPLETE).select("run_id", "path", F.sha2("content", 256).alias("found"))
    both = index.select("run_id", "path", "sha256").join(there, ["run_id", "path"], "full_outer")
    rule = F.when(F.col("found").isNull(), "file_missing").when(F.col("sha256").isNull(), "file_not_listed").when(F.col("sha256") != F.col("found"), "file_changed")
    parts = both.select("run_id", rule.alias("rule")).filter("rule is not null")
    parts = parts.unionByName(files.filter(F.col("path") == INCOMPLETE).select("run_id", F.lit("unfinished").alias("rule")))
    parts = parts.unionByName(index.groupBy("run_id", "path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run_id", F.lit("listed_twice").alias("rule")))
    parts = parts.unionByName(index.filter(~F.coalesce(F.col("schema_version").isin(*versions), F.lit(False))).select("run_id", F.lit("schema_not_supported").alias("rule")))
    return parts.distinct()


def repeated_digests(runs: DataFrame) -> DataFrame:
    """``run_id, rule`` of ``runs(run_id, run_digest)``: an id that comes twice, and a digest that two ids share."""
    ids = runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("run_id", F.lit("run_id_repeated").alias("rule"))
    shared = runs.groupBy("run_digest").agg(F.min("run_id").alias("low"), F.max("run_id").alias("high")).filter("low <> high").select("run_digest")
    return ids.unionByName(runs.join(shared, "run_digest", "left_semi").select("run_id", F.lit("run_digest_repeated").alias("rule")).distinct())


def verified_runs(index: DataFrame, files: DataFrame, versions: tuple[int, ...] = (1,)) -> DataFrame:
    """The files of runs that have no finding."""
    return files.join(scan_findings(index, files, versions).select("run_id").distinct(), "run_id", "left_anti")


def load_run(index: DataFrame, files: DataFrame, run_id: str) -> DataFrame:
    """``path, text`` of one run; an unfinished, damaged or unknown one is refused."""
    mine = [df.filter(F.col("run_id") == run_id) for df in (index, files)]
    bad = sorted(r["rule"] for r in scan_findings(*mine).select("rule").distinct().collect())  # one row per rule
    if bad or not mine[0].limit(1).collect():
        raise ArtifactError(f"{run_id}: {', '.join(bad) or 'unknown'}")
    return mine[1].select("path", F.col("content").cast("string").alias("text"))
