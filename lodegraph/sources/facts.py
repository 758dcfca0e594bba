"""Readers of the record files that outside tools leave."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = "map<string, array<struct<element_name string, element_type string, start_line int, end_line int, version string>>>"
CHANGE_RECORD = f"commit_id string, changed_methods {ELEMENTS}, changed_classes {ELEMENTS}, changed_constructors {ELEMENTS}"
VALID_COMMIT = "commit struct<sha1 string>, focal_methods struct<new array<string>, old array<string>>, test_methods struct<new array<string>, old array<string>>"
PROGRESS = "project_name string, status string, processed_commits array<string>, current_index int, start_time double, last_update double, total_commits int, successful_commits int, end_time double, execution_time_seconds double, progress_percentage double"
REPORT_CLASS = "struct<_name string, method array<struct<_name string, _desc string, counter array<struct<_type string, _covered int>>>>>"


def read_json_records(spark: SparkSession, glob: str, schema: str, suffix: str = ".json") -> DataFrame:
    """JSON array files, one a project; the project is the file's name without its suffix."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), f"{suffix}$".replace(".", "\\."), "")
    return spark.read.schema(schema).option("multiLine", True).option("ignoreMissingFiles", True).json(glob).withColumn("project", name)


def changed_elements(records: DataFrame) -> DataFrame:
    """A row for each changed element of change records."""
    parts = [records.select("commit_id", F.explode(c).alias("path", "items")).select("commit_id", "path", F.explode("items").alias("e")) for c in ("changed_methods", "changed_classes", "changed_constructors")]
    out = parts[0].union(parts[1]).union(parts[2])
    return out.select("commit_id", "path", "e.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank trimmed lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def name_status(lines: DataFrame) -> DataFrame:
    """``status<TAB>path`` lines, split."""
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) >= 2).select(parts[0].alias("status"), parts[1].alias("path"))


def report_methods(reports: DataFrame, xml_col: str = "xml") -> DataFrame:
    """``class, method, descriptor, covered`` of coverage report classes: the first counter, if it counts instructions."""
    x = reports.withColumn("x", F.from_xml(F.col(xml_col), REPORT_CLASS.removeprefix("struct<").removesuffix(">").replace("_name string, method", "_name string, method", 1)))
    m = x.select("*", F.explode("x.method").alias("m"))
    first = F.try_element_at(F.col("m.counter"), F.lit(1))
    return m.select(*[c for c in reports.columns if c != xml_col], F.col("x._name").alias("class"), F.col("m._name").alias("method"), F.col("m._desc").alias("descriptor"), F.when(first["_type"] == "INSTRUCTION", first["_covered"]).otherwise(0).alias("covered"))


def read_properties(text: str) -> dict[str, str]:
    """``key=value`` lines; blank lines and lines that start with ``#`` are skipped."""
    pairs = (x.split("=", 1) for x in map(str.strip, text.splitlines()) if x and not x.startswith("#") and "=" in x)
    return {k.strip(): v.strip() for k, v in pairs}


def exclude_globs(builds: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Globs of source files that build files leave out: every ``testExclude``, and each ``exclude`` with a ``*`` or that ends with ``.java``."""
    found = builds.withColumn("t", F.expr(f"xpath({xml_col}, '//testExclude/text()')")).withColumn("e", F.expr(f"xpath({xml_col}, '//exclude/text()')"))
    trim = lambda c: F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    some = F.filter(trim("e"), lambda x: F.contains(x, F.lit("*")) | F.endswith(x, F.lit(".java")))
    rest = [c for c in builds.columns if c != xml_col]
    return found.select(*rest, F.explode(F.concat(trim("t"), some)).alias("glob"))


LOCATIONS = "array<struct<file_path string, code_element string, start_line int, end_line int>>"
REFACTORING = f"ref_id long, commit_id string, type string, description string, confidence double, left {LOCATIONS}, right {LOCATIONS}"
HUNK = "commit_id string, old_path string, new_path string, type string, begin_a int, end_a int, begin_b int, end_b int"


def read_refactorings(spark: SparkSession, path: str) -> DataFrame:
    """Refactoring records as JSON lines; a missing confidence is 1, missing sides are empty."""
    r = spark.read.schema(REFACTORING).json(path)
    none = F.array().cast(r.schema["left"].dataType)
    return r.withColumns({"confidence": F.coalesce("confidence", F.lit(1.0)), "left": F.coalesce("left", none), "right": F.coalesce("right", none)})


def refactorings_of(refactorings: DataFrame, commits: DataFrame) -> DataFrame:
    """Refactorings of some commits (``commit_id``)."""
    return refactorings.join(commits.select("commit_id").distinct(), "commit_id", "left_semi")


MODES = ("SINGLE_VERSION", "EVOLUTION", "MULTI_EVOLUTION")
#: A strategy by files is known by name and runs as the linear one.
STRATEGIES = ("LINEAR", "FILE_BASED", "REFACTORING_DRIVEN")


@dataclass
class Config:
    """Settings of a run, with their defaults."""

    mode: str = "SINGLE_VERSION"
    project_path: str = ""
    project_name: str = ""
    commit: str = ""
    history_window: int = 5
    strategy: str = "LINEAR"
    max_depth: int = 50
    max_days: int = 180
    export_dir: str = "./csv_export"
    batch_size: int = 2000
    max_retries: int = 3

    #: Names of the settings in a properties file.
    KEYS: ClassVar[dict[str, str]] = {
        "analysis.mode": "mode", "project.path": "project_path", "project.name": "project_name", "evolution.commit": "commit",
        "evolution.historyWindow": "history_window", "evolution.timeline.strategy": "strategy", "evolution.timeline.maxDepth": "max_depth",
        "evolution.timeline.maxDays": "max_days", "export.baseDir": "export_dir", "performance.batchSize": "batch_size", "performance.maxRetries": "max_retries",
    }

    @classmethod
    def read(cls, text: str = "", **overrides) -> Config:
        """Settings from a properties text; arguments win over it. Unknown keys and blank values are passed over."""
        found = {cls.KEYS[k]: v for k, v in read_properties(text).items() if k in cls.KEYS and v} | {k: v for k, v in overrides.items() if v not in (None, "")}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        out = cls(**{k: kinds[k](v) for k, v in found.items()})
        out.mode, out.strategy = out.mode.strip().upper(), out.strategy.strip().upper()
        if not out.project_name:
            out.project_name = out.project_path.rstrip("/").rpartition("/")[2]
        return out

    def problems(self) -> list[str]:
        """What keeps these settings from running; an empty list if nothing does."""
        later = self.mode != "SINGLE_VERSION"
        tests = [
            (self.mode not in MODES, f"unknown mode {self.mode}"),
            (self.strategy not in STRATEGIES, f"unknown timeline strategy {self.strategy}"),
            (not self.project_path, "no project path"),
            (later and not self.commit, "no commit to analyse"),
            (self.mode == "MULTI_EVOLUTION" and self.history_window < 1, "the history window must be 1 or more"),
        ]
        return [text for wrong, text in tests if wrong]

    @property
    def effective_strategy(self) -> str:
        return "LINEAR" if self.strategy == "FILE_BASED" else self.strategy
