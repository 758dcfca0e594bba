"""The commit funnel: classification, gates, coverage pairs, upserts, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions import exprs as X
from lodegraph.operators import locate as L


def classify(elements: DataFrame) -> DataFrame:
    """``group`` (test if path or name says so, else focal) and ``side`` (NEW is new, all else old) of changed elements."""
    test = F.contains(F.lower("path"), F.lit("test")) | F.contains(F.lower("element_name"), F.lit("test"))
    return elements.withColumn("group", F.when(test, "test").otherwise("focal")).withColumn("side", F.when(F.col("version") == "NEW", "new").otherwise("old"))


def commit_sets(elements: DataFrame) -> DataFrame:
    """Distinct names a commit by group and side: four sorted arrays."""
    pick = lambda g, s: F.sort_array(F.collect_set(F.when((F.col("group") == g) & (F.col("side") == s), F.col("element_name")))).alias(f"{g}_{s}")
    return elements.groupBy("commit_id").agg(*[pick(g, s) for g in ("focal", "test") for s in ("new", "old")])


def is_valid() -> Column:
    """Both groups are touched, and at least one of them twice; both sides count together."""
    focal, test = F.size("focal_new") + F.size("focal_old"), F.size("test_new") + F.size("test_old")
    return (focal > 0) & (test > 0) & ((focal >= 2) | (test >= 2))


def size_gate(limit: int = 40) -> Column:
    parts = [F.size(f"{g}_{s}").between(1, limit - 1) for g in ("focal", "test") for s in ("new", "old")]
    return parts[0] & parts[1] & parts[2] & parts[3]


def covered(report: DataFrame, methods: DataFrame, constructors: bool = False) -> DataFrame:
    """Methods ``method_id`` that a report covers: same class and name, the descriptor beginning as the parameters do, any covered overload.

    Reports call a constructor ``<init>``, which no id does, so constructors count as uncovered; with ``constructors`` an id whose
    class is unknown to the report but whose whole name is a class of it is taken for that class's constructor.
    """
    m = methods.withColumn("m", X.parse_method_id(F.col("method_id"))).where("m.class is not null")
    slash = lambda c: F.replace(c, F.lit("."), F.lit("/"))
    m = m.select(*methods.columns, slash(F.col("m.class")).alias("class"), F.col("m.method").alias("method"), X.descriptor_prefix(F.col("m.params")).alias("prefix"))
    hit = report.where("covered > 0").select(F.col("class"), "method", "descriptor")
    if constructors:
        made = hit.where("method = '<init>'").select(F.substring_index("class", "/", -1).alias("method"), F.expr("substr(class, 1, length(class) - length(substring_index(class, '/', -1)) - 1)").alias("class"), "descriptor")
        hit = hit.unionByName(made)
    on = (m["class"] == hit["class"]) & (m["method"] == hit["method"]) & F.startswith(hit["descriptor"], m["prefix"])
    return m.join(hit, on, "left_semi").select(*methods.columns)


def coverage_pairs(report: DataFrame, methods: DataFrame, accumulate: bool = True) -> DataFrame:
    """``commit_id, side, test_id, focal_id, covered``: each test with each focal method of its commit and side.

    ``report(commit_id, side, test_id, test_seq, class, method, descriptor, covered)``: a report after each test, in order of ``test_seq``.
    ``methods(commit_id, side, method_id)``. The build is cleaned before every test on the new side, but once on the old one, so
    there what one test covered may still stand for those after it; ``accumulate`` keeps to that.
    """
    slash = F.replace(F.col("m.class"), F.lit("."), F.lit("/"))
    own = methods.withColumn("m", X.parse_method_id(F.col("method_id"))).where("m.class is not null")
    own = own.select("commit_id", "side", F.col("method_id").alias("focal_id"), slash.alias("class"), F.col("m.method").alias("method"), X.descriptor_prefix(F.col("m.params")).alias("prefix"))
    hit = report.join(own, ["commit_id", "side", "class", "method"]).where(F.startswith("descriptor", F.col("prefix")))
    one = hit.groupBy("commit_id", "side", "focal_id", "test_id", "test_seq").agg((F.max("covered") > 0).alias("own"))
    before = Window.partitionBy("commit_id", "side", "focal_id").orderBy("test_seq", "test_id").rowsBetween(Window.unboundedPreceding, 0)
    still = F.when(F.col("side") == "old", F.max("own").over(before)).otherwise(F.col("own")) if accumulate else F.col("own")
    return one.select("commit_id", "side", "test_id", "focal_id", still.alias("covered"))


def coverage_status(pairs: DataFrame, switches: DataFrame | None = None, errors: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Status of each commit from its covered pairs; the new side fails first, and failed commits carry no pairs.

    ``switches(commit_id, side)``: checkouts that failed. Without the new commit there is no row at all; without the old one the commit
    failed unless its new side had already. ``errors(commit_id, error_message)``: commits that broke off.
    """
    pick = lambda s: F.sort_array(F.collect_set(F.when((F.col("side") == s) & F.col("covered"), F.struct("test_id", "focal_id"))))
    g = pairs.groupBy("commit_id").agg(pick("new").alias("n"), pick("old").alias("o"))
    if switches is not None:
        g = g.join(switches.where("side = 'new'").select("commit_id"), "commit_id", "left_anti")
        g = g.join(switches.where("side = 'old'").select("commit_id", F.lit(True).alias("stuck")).distinct(), "commit_id", "left")
    else:
        g = g.withColumn("stuck", F.lit(None).cast("boolean"))
    if errors is not None:
        g = g.join(errors.groupBy("commit_id").agg(F.min("error_message").alias("error_message")), "commit_id", "full_outer")
    else:
        g = g.withColumn("error_message", F.lit(None).cast("string"))
    few = lambda c: F.coalesce(F.size(c), F.lit(0)) < least
    reason = F.when(few("n"), f"new_coverage_less_than_{least}").when(F.col("stuck"), "failed_to_switch_to_prev_commit").when(few("o"), f"old_coverage_less_than_{least}")
    broken = F.col("error_message").isNotNull()
    status = F.when(broken, "error").when(reason.isNull(), "success").otherwise("failed")
    good = status == "success"
    empty = F.array().cast(g.schema["n"].dataType)
    return g.select("commit_id", status.alias("status"), F.when(~broken, reason).alias("reason"), "error_message", F.when(good, F.col("n")).otherwise(empty).alias("new_pairs"), F.when(good, F.col("o")).otherwise(empty).alias("old_pairs"))


def progress(results: DataFrame, total: int, start: float, now: float) -> DataFrame:
    """Progress of each project from ``project, commit_id, status``: processed, successful, elapsed seconds, percent of ``total``."""
    g = results.groupBy("project").agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "success").alias("successful"))
    return g.withColumns({"elapsed_seconds": F.lit(now - start), "percent": F.round(F.lit(100.0) * F.col("processed") / F.greatest(F.lit(total), F.lit(1)), 2)})


def remaining(commits: DataFrame, progress: DataFrame, parity: bool = True, done: DataFrame | None = None) -> DataFrame:
    """Commits ``project, idx, commit_id`` still to do after ``progress(project_name, current_index, processed_commits)``: from the cursor on.

    The one at the cursor is looked at again though it may be done, and counts as a success then, so a finished project that is
    resumed adds one success a run; ``parity`` keeps that commit in (``recount``), else it drops out like any other processed one.
    ``done(project, commit_id)`` may stand for the records' lists, which are long in a large project; it is joined, never searched a row.
    """
    if done is None:
        done = progress.select(F.col("project_name").alias("project"), F.explode("processed_commits").alias("commit_id"))
    cursor = progress.groupBy(F.col("project_name").alias("project")).agg(F.max("current_index").alias("current_index"))
    own = commits.join(cursor, "project", "left").where(F.col("idx") >= F.coalesce("current_index", F.lit(0))).select("project", "idx", "commit_id")
    known = done.select("project", "commit_id").distinct()
    if not parity:
        return own.join(known, ["project", "commit_id"], "left_anti").select("project", "idx", "commit_id", F.lit(False).alias("recount"))
    return own.join(known.withColumn("recount", F.lit(True)), ["project", "commit_id"], "left").select("project", "idx", "commit_id", F.coalesce("recount", F.lit(False)).alias("recount"))


def summary(results: DataFrame) -> DataFrame:
    """Over all projects: how many, processed commits, successes, and their share."""
    c = F.col
    g = results.agg(F.countDistinct("project").alias("projects"), F.count("*").alias("processed"), F.count_if(c("status") == "success").alias("successful"))
    return g.withColumn("pct", F.round(F.lit(100.0) * c("successful") / F.greatest(c("processed"), F.lit(1)), 2))


def affected_elements(hunks: DataFrame, elements: DataFrame) -> DataFrame:
    """Changed classes, methods and constructors: elements ``commit_id, path, element_name, element_type, version, start_line, end_line`` whose lines a hunk of their file touches.

    Line numbers of the new side decide, for elements of the old one too; a pure deletion counts as the line it stands before.
    """
    lo = F.col("begin_b") + 1
    at = hunks.select("commit_id", F.col("new_path").alias("path"), lo.alias("lo"), F.greatest(F.col("end_b"), lo).alias("hi"))
    hit = L.range_join(elements, at, ["commit_id", "path"], (F.col("start_line"), F.col("end_line")), (F.col("lo"), F.col("hi")))
    return hit.select(*elements.columns).distinct()


def upsert(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: one pre-aggregated maximum."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def change_record(elements: DataFrame) -> DataFrame:
    """Elements a commit and kind as a map of path to sorted elements."""
    by_path = elements.groupBy("commit_id", "element_type", "path").agg(F.sort_array(F.collect_set(F.struct("element_name", "start_line", "end_line", "version"))).alias("e"))
    return by_path.groupBy("commit_id", "element_type").agg(F.map_from_entries(F.collect_list(F.struct("path", "e"))).alias("changed"))


def revert_plan(changes: DataFrame) -> DataFrame:
    """What undoes a change: an added file is deleted, a modified or deleted one restored."""
    return changes.withColumn("action", F.when(F.col("status") == "A", "delete").when(F.col("status").isin("M", "D"), "restore").otherwise("none"))


def without_methods(methods: DataFrame, removed: DataFrame) -> DataFrame:
    """Methods whose ``signature`` is not exactly one of ``removed(signature)``."""
    return methods.join(removed.select("signature").distinct(), "signature", "left_anti")


#: Parts of annotation names that mark a test class.
TEST_ANNOTATIONS = ("RunWith", "ExtendWith", "SpringBootTest", "WebMvcTest", "DataJpaTest", "Test")


def test_classes(types: DataFrame, methods: DataFrame, inherited: DataFrame | None = None) -> DataFrame:
    """``node_id, reason`` of test classes among ``types(node_id, name, annotations, path)``: by name, annotation, or test methods in a test folder.

    ``methods(declaring_type, annotations)``: a test method has an annotation with "Test" in its name. A type's methods are its own, and those
    of its ancestors in ``inherited(node_id, ancestor)``. The first rule that holds is the reason; null names, paths and lists match nothing.
    """
    marked = lambda words: F.coalesce(F.exists("annotations", lambda a: F.greatest(*[F.contains(a, F.lit(w)) for w in (*words, words[0])])), F.lit(False))
    test = methods.where(marked(["Test"])).select(F.col("declaring_type").alias("node_id")).distinct()
    if inherited is not None:
        test = test.union(inherited.join(test.toDF("ancestor"), "ancestor", "left_semi").select("node_id")).distinct()
    own = types.join(test.withColumn("tested", F.lit(True)), "node_id", "left")
    there = F.contains("path", F.lit("src/test/")) | F.contains("path", F.lit("src\\test\\"))
    reason = F.when(X.is_test_class(F.col("name")), "name").when(marked(TEST_ANNOTATIONS), "annotation").when(there & F.col("tested"), "path")
    return own.select("node_id", reason.alias("reason")).where("reason is not null")
