"""Commits, their history and their changed files, from tables ``commits`` and ``hunks``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.sources.tables import Tables


def all_commits(commits: DataFrame) -> DataFrame:
    """Every commit of every ref, once."""
    return commits.select("commit_id").distinct()


def commit_info(ids: DataFrame, commits: DataFrame) -> DataFrame:
    """Metadata of ``commit_id``s: parent, short id (seven characters), message, author, time; unknown ids have nulls."""
    known = commits.select("commit_id", "parent_id", F.substring("commit_id", 1, 7).alias("short_id"), "message", "author", "commit_time")
    return ids.join(known, "commit_id", "left")


def linear_history(commits: DataFrame, heads: DataFrame, depth: int) -> DataFrame:
    """``timeline, commit_id, depth``: of each head (``timeline, commit_id``) itself and up to ``depth`` first parents.

    Ancestors are found by doubling: a table of the 1st, 2nd, 4th, ... ancestor of each commit, and as many joins as ``depth`` has bits.
    """
    tables = Tables(commits.sparkSession, "history")
    jump = tables.write(commits.where("parent_id is not null").select("commit_id", F.col("parent_id").alias("up")).distinct(), "jump")
    found, size = tables.write(heads.select("timeline", "commit_id", F.lit(0).alias("depth")), "found"), 1
    while size <= depth:
        more = found.join(jump, "commit_id").select("timeline", F.col("up").alias("commit_id"), (F.col("depth") + size).alias("depth"))
        found = tables.write(found.union(more.where(F.col("depth") <= depth)), "found")
        if 2 * size <= depth:
            jump = tables.write(jump.join(jump.toDF("up", "next"), "up").select("commit_id", F.col("next").alias("up")), "jump")
        size *= 2
    return found


def timeline(history: DataFrame, commits: DataFrame) -> DataFrame:
    """Versions of each timeline, oldest first: ``ord`` from 0 and labels ``V0`` for the newest, ``V-k`` for the k-th before it."""
    label = F.when(F.col("depth") == 0, "V0").otherwise(F.concat(F.lit("V-"), F.col("depth").cast("string")))
    last = F.max("depth").over(Window.partitionBy("timeline"))
    rows = history.select("timeline", "commit_id", "depth", label.alias("label"), (last - F.col("depth")).alias("ord"))
    return commit_info(rows, commits)


def version_pairs(versions: DataFrame) -> DataFrame:
    """Neighbours of each timeline, newest pair first: ``timeline, older, newer, pair_ord`` (0 is the newest)."""
    w = Window.partitionBy("timeline").orderBy("depth")
    pairs = versions.select("timeline", F.lead("commit_id").over(w).alias("older"), F.col("commit_id").alias("newer"), F.col("depth").alias("pair_ord"))
    return pairs.where("older is not null")


def file_diffs(hunks: DataFrame, commits: DataFrame, suffix: str = ".java") -> DataFrame:
    """Changed files of each commit against its first parent: ``commit_id, old_path, new_path, n_hunks``.

    A first commit has none, and so has a file whose new path does not end with ``suffix`` (that of a deleted one is /dev/null).
    """
    later = commits.where("parent_id is not null").select("commit_id").distinct()
    own = hunks.where(F.endswith("new_path", F.lit(suffix))).join(later, "commit_id", "left_semi")
    return own.groupBy("commit_id", "old_path", "new_path").agg(F.count("*").alias("n_hunks"))


def edits(hunks: DataFrame, commits: DataFrame, suffix: str = ".java") -> DataFrame:
    """Hunks of `file_diffs` that change something (neither side's range is empty on both), with a kind told from the ranges where it is missing."""
    later = commits.where("parent_id is not null").select("commit_id").distinct()
    own = hunks.where(F.endswith("new_path", F.lit(suffix))).join(later, "commit_id", "left_semi")
    gone, come = F.col("end_a") - F.col("begin_a"), F.col("end_b") - F.col("begin_b")
    kind = F.when(gone <= 0, "INSERT").when(come <= 0, "DELETE").otherwise("REPLACE")
    return own.where((gone > 0) | (come > 0)).withColumn("type", F.coalesce("type", kind))
