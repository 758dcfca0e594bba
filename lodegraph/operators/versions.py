"""Matching, diffing, merging and rolling up versions of a graph."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions import exprs as X
from lodegraph.sources.tables import Tables, dealt

#: Refactoring type, its evolution edge type and sub type.
KINDS = [
    ("RENAME_CLASS", "RENAMED", "class"),
    ("RENAME_METHOD", "RENAMED", "method"),
    ("RENAME_ATTRIBUTE", "RENAMED", "field"),
    ("RENAME_PARAMETER", "RENAMED", "parameter"),
    ("RENAME_VARIABLE", "RENAMED", "variable"),
    ("RENAME_PACKAGE", "RENAMED", "package"),
    ("MOVE_CLASS", "MOVED", "class"),
    ("MOVE_METHOD", "MOVED", "method"),
    ("MOVE_ATTRIBUTE", "MOVED", "field"),
    ("MOVE_AND_RENAME_CLASS", "MOVED", "class"),
    ("MOVE_AND_RENAME_METHOD", "MOVED", "method"),
    ("MOVE_AND_RENAME_ATTRIBUTE", "MOVED", "field"),
    ("EXTRACT_METHOD", "EXTRACTED", "method"),
    ("EXTRACT_CLASS", "EXTRACTED", "class"),
    ("EXTRACT_INTERFACE", "EXTRACTED", "interface"),
    ("EXTRACT_SUPERCLASS", "EXTRACTED", "superclass"),
    ("EXTRACT_SUBCLASS", "EXTRACTED", "subclass"),
    ("EXTRACT_VARIABLE", "EXTRACTED", "variable"),
    ("EXTRACT_AND_MOVE_METHOD", "EXTRACTED", "method"),
    ("INLINE_METHOD", "INLINED", "method"),
    ("INLINE_VARIABLE", "INLINED", "variable"),
    ("MOVE_AND_INLINE_METHOD", "INLINED", "method"),
    ("CHANGE_PARAMETER_TYPE", "CHANGED_SIGNATURE", "parameter_type"),
    ("CHANGE_RETURN_TYPE", "CHANGED_SIGNATURE", "return_type"),
    ("ADD_PARAMETER", "CHANGED_SIGNATURE", "add_parameter"),
    ("REMOVE_PARAMETER", "CHANGED_SIGNATURE", "remove_parameter"),
    ("REORDER_PARAMETER", "CHANGED_SIGNATURE", "reorder_parameter"),
    ("ADD_THROWN_EXCEPTION_TYPE", "CHANGED_SIGNATURE", "add_exception"),
    ("REMOVE_THROWN_EXCEPTION_TYPE", "CHANGED_SIGNATURE", "remove_exception"),
    ("CHANGE_METHOD_ACCESS_MODIFIER", "CHANGED_SIGNATURE", "modifier"),
    ("CHANGE_ATTRIBUTE_ACCESS_MODIFIER", "CHANGED_SIGNATURE", "modifier"),
    ("PULL_UP_METHOD", "REFACTORED", "pull_up"),
    ("PULL_UP_ATTRIBUTE", "REFACTORED", "pull_up"),
    ("PUSH_DOWN_METHOD", "REFACTORED", "push_down"),
    ("PUSH_DOWN_ATTRIBUTE", "REFACTORED", "push_down"),
    ("REPLACE_VARIABLE_WITH_ATTRIBUTE", "REFACTORED", "replace"),
    ("PARAMETERIZE_VARIABLE", "REFACTORED", "parameterize"),
    ("MERGE_PARAMETER", "REFACTORED", "merge"),
    ("SPLIT_PARAMETER", "REFACTORED", "split"),
    ("MERGE_VARIABLE", "REFACTORED", "merge"),
    ("SPLIT_VARIABLE", "REFACTORED", "split"),
    ("MERGE_CLASS", "REFACTORED", "merge"),
    ("SPLIT_CLASS", "REFACTORED", "split"),
]


def match_key(columns: list[str]) -> Column:
    """What a node of each type is matched by: its qualified name or signature, a field with its type, a file's relative path, else the label."""
    c = lambda name: F.col(name) if name in columns else F.lit(None).cast("string")
    field = F.concat(c("qualified_name"), F.lit(":"), c("field_type"))
    by = F.when(F.col("node_type").isin("TYPE", "PACKAGE"), c("qualified_name")).when(F.col("node_type") == "METHOD", c("signature"))
    return by.when(F.col("node_type") == "FIELD", field).when(F.col("node_type") == "FILE", c("relative_path")).otherwise(c("label"))


def match_nodes(n1: DataFrame, n2: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact matches ``v1_id, v2_id, confidence, matcher`` within a node type (and ``by``, which comes first), k-th with k-th where a side repeats a key; a null key matches nothing."""
    def side(df: DataFrame, i: int) -> DataFrame:
        k = F.row_number().over(Window.partitionBy(*by, "node_type", "key").orderBy("node_id"))
        keyed = df.withColumn("key", match_key(df.columns)).where("key is not null")
        return keyed.select(*by, "node_type", "key", k.alias("k"), F.col("node_id").alias(f"v{i}_id"), F.col("source_code").alias(f"s{i}"))

    both = side(n1, 1).join(side(n2, 2), [*by, "node_type", "key", "k"])
    return both.select(*by, "v1_id", "v2_id", X.confidence(F.col("s1"), F.col("s2")).alias("confidence"), F.lit("ExactMatcher").alias("matcher"))


def match(v1: DataFrame, v2: DataFrame, key: str = "node_id") -> DataFrame:
    """Exact matches of equal keys, k-th with k-th where a side repeats one: ``key, source1, source2, confidence``."""
    def ranked(df: DataFrame, source: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("source")
        return df.select(key, F.col("source").alias(source), F.row_number().over(w).alias("k"))

    pairs = ranked(v1, "source1").join(ranked(v2, "source2"), [key, "k"])
    return pairs.select(key, "source1", "source2", X.confidence(F.col("source1"), F.col("source2")).alias("confidence"))


def ratio_score(a: Column, b: Column, weight: float) -> Column:
    """``weight`` times how near two sizes are; nothing unless both are positive."""
    return F.when((a > 0) & (b > 0), F.lit(weight) * (1 - F.abs(a - b) / F.greatest(a, b))).otherwise(F.lit(0.0))


def structural_score(left: str = "a", right: str = "b") -> Column:
    """Weighted likeness of two methods: lines 0.2, complexity 0.2, called methods 0.3, accessed fields 0.2, local variables 0.1.

    A feature counts only if both sides have one; the sum is not scaled to the features that count.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    lists = lambda name: (F.size(c(left, name)) > 0) & (F.size(c(right, name)) > 0)
    sets = lambda name, w: F.when(lists(name), F.lit(w) * X.jaccard(c(left, name), c(right, name))).otherwise(F.lit(0.0))
    sizes = [ratio_score(c(left, x), c(right, x), 0.2) for x in ("lines_of_code", "complexity")]
    variables = ratio_score(F.size(c(left, "local_variables")), F.size(c(right, "local_variables")), 0.1)
    return sizes[0] + sizes[1] + sets("called_methods", 0.3) + sets("accessed_fields", 0.2) + variables


class Matcher(Protocol):
    """A way to match nodes of two versions that no stronger matcher has matched.

    ``block`` names columns that both sides must share (never empty: it is what keeps the join from being all pairs);
    ``score`` gives a column over the joined sides ``a`` and ``b``; ``node_types`` those it is asked for.
    """

    name: str
    priority: int
    node_types: tuple[str, ...]
    block: tuple[str, ...]

    def score(self) -> Column: ...

    # A matcher may also bring ``candidates(a, b, threshold, by)``, scored pairs by other means than a block, and ``leftovers`` of
    # the same form, pairs for what no candidate has taken.


@dataclass
class StructuralMatcher:
    """Likeness of methods, within blocks."""

    block: tuple[str, ...] = ("node_type", "name")
    name: str = "StructuralMatcher"
    priority: int = 10
    node_types: tuple[str, ...] = ("METHOD",)

    def score(self) -> Column:
        return structural_score()


def match_all(n1: DataFrame, n2: DataFrame, matchers: list[Matcher] | None = None, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """1:1 matches (within ``by``): exact ones first, then those of each matcher, strongest priority first, among nodes still free."""
    spark = n1.sparkSession
    tables = Tables(spark, "match")
    one, two = [*by, "node_id"], [*by, "v1_id", "v2_id"]
    out = tables.write(match_nodes(n1, n2, by), "exact")
    for m in sorted(matchers or [], key=lambda m: (-m.priority, m.name)):
        free1 = n1.where(F.col("node_type").isin(*m.node_types)).join(out.select(*by, F.col("v1_id").alias("node_id")), one, "left_anti")
        free2 = n2.where(F.col("node_type").isin(*m.node_types)).join(out.select(*by, F.col("v2_id").alias("node_id")), one, "left_anti")
        if hasattr(m, "candidates"):
            scored = m.candidates(free1, free2, threshold, by)
        else:
            on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, *m.block)]
            scored = free1.alias("a").join(free2.alias("b"), on).select(*(F.col(f"a.{c}") for c in by), F.col("a.node_id").alias("v1_id"), F.col("b.node_id").alias("v2_id"), m.score().alias("score"))
        won = tables.write(best_mutual(scored, threshold, by), "won")
        if hasattr(m, "leftovers"):
            lone = lambda df, end: df.join(won.select(*by, F.col(end).alias("node_id")), one, "left_anti")  # noqa: E731, B023
            won = won.union(m.leftovers(lone(free1, "v1_id"), lone(free2, "v2_id"), threshold, by).select(*won.columns))
        out = tables.write(out.union(won.select(*two, F.col("score").alias("confidence"), F.lit(m.name).alias("matcher"))), "matched")
    return out


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """One row: pairs, exact ones, those of 0.8 or more and of less, the mean."""
    c = F.col("confidence")
    return mapping.agg(F.count("*").alias("total"), F.count_if(c == 1.0).alias("exact"), F.count_if(c >= 0.8).alias("high"), F.count_if(c < 0.8).alias("low"), F.round(F.avg(c), 6).alias("mean"))


def match_counts(mapping: DataFrame, n1: DataFrame) -> DataFrame:
    """``matcher, matched, pct``: what each matcher found, as a share of the first version's nodes."""
    total = n1.agg(F.count("*").alias("t"))
    return mapping.groupBy("matcher").agg(F.count("*").alias("matched")).crossJoin(F.broadcast(total)).select("matcher", "matched", F.round(F.lit(100.0) * F.col("matched") / F.col("t"), 2).alias("pct"))


def diff(v1: DataFrame, v2: DataFrame, key: str = "node_id") -> DataFrame:
    """Status of every key of either version, one row each, in one full outer join."""
    both = v1.select(key, F.col("source").alias("s1"), F.lit(True).alias("in1")).join(v2.select(key, F.col("source").alias("s2"), F.lit(True).alias("in2")), key, "full_outer")
    status = F.when(F.col("in1").isNull(), "ADDED").when(F.col("in2").isNull(), "DELETED").when(F.col("s1").eqNullSafe(F.col("s2")), "UNCHANGED").otherwise("MODIFIED")
    return both.select(key, "s1", "s2", status.alias("version_status"))


def materialise(status: DataFrame, first: str = "V1", second: str = "V2") -> DataFrame:
    """Node rows of the merged graph: changed nodes once a version, unchanged ones once with both labels."""
    one, two = F.array(F.lit(first)), F.array(F.lit(second))
    s = F.col("version_status")
    own = F.when(s == "ADDED", F.array(two)).when(s == "DELETED", F.array(one)).when(s == "UNCHANGED", F.array(F.concat(one, two))).otherwise(F.array(one, two))
    rows = status.withColumn("versions", F.explode(own))
    node = F.when(F.size("versions") == 2, F.col("node_id")).otherwise(X.versioned_id(F.col("node_id"), F.col("versions")[0]))
    return rows.select(node.alias("merged_id"), "node_id", "version_status", "versions")


def changed_pairs(mapping: DataFrame, changed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``mapping`` with ``forced``: whether either end is among ``changed`` (side V1 or V2, node_id), of the same ``by``."""
    side = lambda s: changed.where(F.col("side") == s).select(*by, F.col("node_id").alias(f"{s.lower()}_id"), F.lit(True).alias(s)).distinct()
    both = mapping.join(side("V1"), [*by, "v1_id"], "left").join(side("V2"), [*by, "v2_id"], "left")
    return both.withColumn("forced", F.coalesce("V1", "V2", F.lit(False))).drop("V1", "V2")


def merge_edges(e1: DataFrame, e2: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges of both versions, one for each (src, edge_type, dst) and ``by``, the first version's first line first."""
    both = e1.withColumn("side", F.lit(1)).unionByName(e2.withColumn("side", F.lit(2)))
    keys = [*by, "src", "edge_type", "dst"]
    return both.groupBy(*keys).agg(F.min(F.struct("side", "line")).alias("r")).select(*keys, "r.*")


def remap(edges: DataFrame, mapping: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges with both ends replaced through ``old, new`` (after the columns of ``by``) and all else copied; an edge with an unknown end is dropped."""
    return remap_sides(edges, mapping, mapping, by)


def remap_sides(edges: DataFrame, sources: DataFrame, targets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """As `remap`, with a mapping for each end."""
    out = edges.join(sources.toDF(*by, "src", "src_new"), [*by, "src"]).join(targets.toDF(*by, "dst", "dst_new"), [*by, "dst"])
    return out.drop("src", "dst").withColumnRenamed("src_new", "src").withColumnRenamed("dst_new", "dst")


def with_edge_type(refactorings: DataFrame) -> DataFrame:
    """Edge type and sub type of each refactoring; an unknown type is REFACTORED without a sub type."""
    dim = refactorings.sparkSession.createDataFrame(KINDS, "type string, edge_type string, sub_type string")
    return refactorings.join(F.broadcast(dim), "type", "left").withColumn("edge_type", F.coalesce("edge_type", F.lit("REFACTORED")))


def refactoring_edges(refactorings: DataFrame) -> DataFrame:
    """Edges of resolved refactorings ``ref_id, pos, type, left_id, right_id``: EXTRACT_ goes from the first left to
    every right, INLINE_ from every left to the first right, all others from first to first."""
    w = Window.partitionBy("ref_id")
    first_left, first_right = F.min_by("left_id", "pos").over(w), F.min_by("right_id", "pos").over(w)
    head = F.min("pos").over(w)
    x = refactorings.select("*", first_left.alias("l0"), first_right.alias("r0"), head.alias("p0"))
    extract, inline = F.startswith("type", F.lit("EXTRACT_")), F.startswith("type", F.lit("INLINE_"))
    x = x.where(extract | inline | (F.col("pos") == F.col("p0")))
    return x.select("ref_id", "pos", "type", F.when(inline, F.col("left_id")).otherwise(F.col("l0")).alias("src"), F.when(extract, F.col("right_id")).otherwise(F.col("r0")).alias("dst"), "confidence")


def sided_edges(refactorings: DataFrame) -> DataFrame:
    """As `refactoring_edges`, from sides of any length: ``left_ids`` and ``right_ids`` are arrays of resolved nodes in order.

    A refactoring with nothing on one side gives no edge. Adds ``left_pos`` and ``right_pos``; other columns stay.
    """
    extract, inline = F.startswith("type", F.lit("EXTRACT_")), F.startswith("type", F.lit("INLINE_"))
    some = refactorings.where((F.size("left_ids") > 0) & (F.size("right_ids") > 0))
    x = some.withColumn("l", F.when(inline, F.col("left_ids")).otherwise(F.slice("left_ids", 1, 1))).withColumn("r", F.when(extract, F.col("right_ids")).otherwise(F.slice("right_ids", 1, 1)))
    x = x.select(*refactorings.columns, F.posexplode("l").alias("left_pos", "src"), "r")
    return x.select(*refactorings.columns, "left_pos", "src", F.posexplode("r").alias("right_pos", "dst")).drop("left_ids", "right_ids")


def enriched(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evolution edges with what their type asks for, from ``nodes(node_id, node_type, name, place)``, null elsewhere.

    RENAMED: old and new name. MOVED: old and new place (signature or qualified name). CHANGED_SIGNATURE: both signatures, if both
    ends are methods. EXTRACTED, INLINED, CHANGED_SIGNATURE: the sub type. REFACTORED: the description.
    """
    end = lambda key, p: nodes.select(F.col("node_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("node_type", "name", "place")])
    x = edges.join(end("src", "o"), "src", "left").join(end("dst", "n"), "dst", "left")
    kind, methods = F.col("edge_type"), (F.col("o_node_type") == "METHOD") & (F.col("n_node_type") == "METHOD")
    on = lambda t, c, more=F.lit(True): F.when((kind == t) & more, F.col(c))
    cols = {
        "old_name": on("RENAMED", "o_name"), "new_name": on("RENAMED", "n_name"), "old_location": on("MOVED", "o_place"), "new_location": on("MOVED", "n_place"),
        "old_signature": on("CHANGED_SIGNATURE", "o_place", methods), "new_signature": on("CHANGED_SIGNATURE", "n_place", methods),
        "sub_kind": F.when(kind.isin("EXTRACTED", "INLINED", "CHANGED_SIGNATURE"), F.col("sub_type")),
        "details": F.when((kind == "REFACTORED") & (F.trim("description") != ""), F.col("description")),
    }
    return x.withColumns(cols).select(*edges.columns, *cols)


def propagate(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """A change of a member as a change of its type: REFACTORED edges between owners, self-loops included."""
    return remap(edges.select("src", "dst", "confidence"), owner).select("src", "dst", F.lit("REFACTORED").alias("edge_type"), F.lit("MEMBER_CHANGED").alias("type"), "confidence")


def owners(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``member, owner`` (after ``by``) from DECLARES edges; the smallest of several owners."""
    return edges.where("edge_type = 'DECLARES'").groupBy(*by, F.col("dst").alias("member")).agg(F.min("src").alias("owner"))


def roll_up(rows: DataFrame) -> DataFrame:
    """Timeline of each node from ``node_id, label, ord, status, seq``: versions in order, strongest status (earliest ``seq`` of equals), first and last label.

    Labels of unknown order (null) come first among the versions and are first or last only where no other is.
    """
    strength = F.expr("case status when 'ADDED' then 3 when 'DELETED' then 3 when 'MODIFIED' then 2 when 'UNCHANGED' then 1 else 0 end")
    labels = F.transform(F.sort_array(F.collect_set(F.struct("ord", "label"))), lambda r: r["label"])
    return rows.groupBy("node_id").agg(labels.alias("versions"), F.max_by("status", F.struct(strength, -F.col("seq"))).alias("status"), F.coalesce(F.min_by("label", "ord"), F.min("label")).alias("first_version"), F.coalesce(F.max_by("label", "ord"), F.min("label")).alias("last_version"))


def best_mutual(scores: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """1:1 matches (within ``by``) from ``v1_id, v2_id, score``: pairs that are each other's best, round by round, until nothing is left.

    Equal scores are ranked by a hash of the pair, then by its ids, so that large ties settle in a few rounds. The
    outcome is that of taking the best pair left, one at a time, in this order. Each round's tables are written.
    """
    tables = Tables(scores.sparkSession, "mutual")
    rank = lambda other: F.struct(-F.col("score"), "tie", other)
    left = tables.write(scores.where(F.col("score") >= threshold).withColumn("tie", F.xxhash64("v1_id", "v2_id")), "left")
    rounds = []
    while not left.isEmpty():
        one, two, pair = [*by, "v1_id"], [*by, "v2_id"], [*by, "v1_id", "v2_id"]
        a = left.groupBy(*one).agg(F.min_by("v2_id", rank("v2_id")).alias("v2_id"))
        b = left.groupBy(*two).agg(F.min_by("v1_id", rank("v1_id")).alias("v1_id"))
        won = tables.write(left.join(a, pair).join(b, pair).select(*pair, "score"), "won")
        rounds.append(won)
        left = tables.write(left.join(won.select(*one), one, "left_anti").join(won.select(*two), two, "left_anti"), "left")
    out = scores.select(*by, "v1_id", "v2_id", "score").limit(0)
    for won in rounds:
        out = out.union(won)
    return out


@dataclass
class Kinds:
    """Methods of two sides, ``one(v1_id, kind1)`` and ``two(v2_id, kind2)``, by what the structural score reads of them, and ``scores(kind1, kind2, score)``
    of kinds that agree in some columns: equal methods are scored once, however many there are."""

    one: DataFrame
    two: DataFrame
    scores: DataFrame

    def pairs(self) -> DataFrame:
        """``v1_id, v2_id, score`` of all pairs."""
        near = self.one.join(self.scores, "kind1").select("v1_id", "kind2", "score")
        return dealt(near, "kind2").join(dealt(self.two, "kind2"), "kind2").select("v1_id", "v2_id", "score")


def structural_kinds(a: DataFrame, b: DataFrame, on: list[str]) -> Kinds:
    """`Kinds` of two sides that must agree in the columns ``on`` (never empty)."""
    tables = Tables(a.sparkSession, "kinds")
    cols = list(dict.fromkeys([*on, "lines_of_code", "complexity", "called_methods", "accessed_fields"]))
    members, kinds = [], []
    for i, df in enumerate((a, b), 1):
        key = F.to_json(F.struct(*cols, F.size("local_variables").alias("variables")), {"ignoreNullFields": "false"})
        keyed = df.select(F.col("node_id").alias(f"v{i}_id"), *cols, "local_variables", key.alias("key"))
        own = tables.write(keyed.drop(f"v{i}_id").dropDuplicates(["key"]).withColumn(f"kind{i}", F.monotonically_increasing_id()), "kinds")
        members.append(tables.write(keyed.select(f"v{i}_id", "key").join(own.select("key", f"kind{i}"), "key").drop("key"), "members"))
        kinds.append(own)
    both = dealt(kinds[0], *on).alias("a").join(dealt(kinds[1], *on).alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
    return Kinds(*members, tables.write(both.select("kind1", "kind2", F.round(structural_score(), 6).alias("score")), "scores"))


def best_mutual_kinds(kinds: Kinds, threshold: float) -> DataFrame:
    """What `best_mutual` finds among all pairs of ``kinds``, which are never written.

    In each round a method meets only the free ones of those kinds that score best with its own, or that its own scores best with. Each side's
    smallest hash of a pair is a plain minimum; where both sides name the same one, the pair is each other's best.
    """
    tables = Tables(kinds.one.sparkSession, "mutual")
    one, two, scores = kinds.one, kinds.two, kinds.scores.where(F.col("score") >= threshold)
    rounds = []
    while True:
        live = scores.join(one.select("kind1").distinct(), "kind1").join(two.select("kind2").distinct(), "kind2")
        scores = tables.write(live, "scores")
        if scores.isEmpty():
            break
        top = scores.join(scores.groupBy("kind1").agg(F.max("score").alias("best1")), "kind1").join(scores.groupBy("kind2").agg(F.max("score").alias("best2")), "kind2")

        def nearest(side: int) -> DataFrame:
            """Each method's smallest hash with those it scores best with."""
            own = dealt(one.join(top.where(f"score = best{side}"), "kind1").select("v1_id", "kind2", "score"), "kind2")  # noqa: B023
            met = own.join(dealt(two, "kind2"), "kind2")  # noqa: B023
            return met.groupBy(f"v{side}_id", "score").agg(F.min(F.xxhash64("v1_id", "v2_id")).alias("tie"))

        both = nearest(1).join(nearest(2), ["tie", "score"]).where(F.xxhash64("v1_id", "v2_id") == F.col("tie"))
        # Of pairs with one hash, those of the smallest ids.
        first = lambda x, y: F.col(y) == F.min(y).over(Window.partitionBy(x))
        won = both.withColumn("kept", first("v1_id", "v2_id") & first("v2_id", "v1_id")).where("kept").select("v1_id", "v2_id", "score")
        won = tables.write(won, "won")
        rounds.append(won)
        one, two = (tables.write(df.join(won.select(c), c, "left_anti"), "free") for df, c in ((one, "v1_id"), (two, "v2_id")))
    out = kinds.scores.limit(0).select(F.lit("").alias("v1_id"), F.lit("").alias("v2_id"), "score") if not rounds else rounds[0]
    for won in rounds[1:]:
        out = out.union(won)
    return out


def _rule(tracked: Column, ref: Column) -> Column:
    """The tracked methods after one matched refactoring; the first rule whose word is in its type holds, and unless the new side is tracked nothing changes."""
    new, old, kind = ref["new"], ref["old"], ref["type"]
    replace = F.array_union(F.array_remove(tracked, new), F.array(old))
    add = F.array_union(tracked, F.array(old))
    known = new.isNotNull() & old.isNotNull() & F.array_contains(tracked, new)
    return F.when(known & kind.rlike("RENAME|MOVE|CHANGE"), replace).when(known & kind.rlike("EXTRACT|INLINE"), add).otherwise(tracked)


def _methods(elements: Column) -> Column:
    return F.transform(F.filter(elements, lambda x: X.is_method(x)), lambda x: F.trim(x))


def tracked_walk(commits: DataFrame, refactorings: DataFrame, keys: list[str], max_depth: int = 50, max_days: int = 180) -> DataFrame:
    """Walk back from the newest commit of each timeline, following methods through refactorings.

    ``commits(*keys, depth, commit_id, commit_time, is_root)``: depth 0 is the target, 1 its parent, and so on. ``refactorings(*keys,
    commit_id, pos, type, left, right)``: elements of both sides as arrays. The methods right of the target's refactorings are
    followed. Then at most ``max_depth`` commits are analysed, until a root or one more than ``max_days`` days older. A commit
    with a refactoring that touches a followed method on either side is kept, and its refactorings update what is followed: RENAME,
    MOVE and CHANGE replace new by old, EXTRACT and INLINE add old, in this order of words in the type.

    Returns ``*keys, seed, tracked, commits`` (kept ones, oldest first, the target last), ``analysed, relevant``. A timeline without
    a method to follow holds its target alone. The fold is one aggregate over each timeline's array of at most ``max_depth`` commits.
    """
    sides = refactorings.withColumn("l", _methods(F.col("left"))).withColumn("r", _methods(F.col("right")))
    ref = F.struct("pos", "type", "l", "r", F.try_element_at("r", F.lit(1)).alias("new"), F.try_element_at("l", F.lit(1)).alias("old"))
    per_commit = sides.groupBy(*keys, "commit_id").agg(F.sort_array(F.collect_list(ref)).alias("refs"))
    near = commits.where(F.col("depth") <= max_depth).join(per_commit, [*keys, "commit_id"], "left")
    step = F.struct("depth", "commit_id", "commit_time", "is_root", "refs")
    lines = near.groupBy(*keys).agg(F.sort_array(F.collect_list(step)).alias("c")).withColumn("target", F.col("c")[0])
    stops = F.transform(F.col("c"), lambda x: (x["depth"] > 0) & (x["is_root"] | X.outside_window(x["commit_time"], F.col("target.commit_time"), max_days)))
    stop = F.array_position(stops, F.lit(True))
    seed = F.array_distinct(F.flatten(F.transform(F.coalesce("target.refs", F.slice(F.col("target.refs"), 1, 0)), lambda r: r["r"])))
    lines = lines.withColumn("seed", F.coalesce(seed, F.array().cast("array<string>")))
    walk = F.slice("c", F.lit(2), F.when(stop > 0, stop - 2).otherwise(F.size("c") - 1).cast("int"))
    lines = lines.withColumn("walk", F.when(F.size("seed") > 0, walk).otherwise(F.slice("c", 1, 0)))
    start = F.struct(F.col("seed").alias("tracked"), F.array().cast("array<string>").alias("kept"))

    def fold(acc: Column, commit: Column) -> Column:
        hits = F.filter(commit["refs"], lambda r: F.arrays_overlap(r["r"], acc["tracked"]) | F.arrays_overlap(r["l"], acc["tracked"]))
        some = F.coalesce(F.size(hits) > 0, F.lit(False))
        after = F.when(some, F.aggregate(hits, acc["tracked"], _rule)).otherwise(acc["tracked"])
        return F.struct(after.alias("tracked"), F.when(some, F.array_append(acc["kept"], commit["commit_id"])).otherwise(acc["kept"]).alias("kept"))

    done = lines.withColumn("f", F.aggregate("walk", start, fold))
    kept = F.concat(F.reverse("f.kept"), F.array("target.commit_id"))
    return done.select(*keys, "seed", F.col("f.tracked").alias("tracked"), kept.alias("commits"), F.size("walk").alias("analysed"), F.size("f.kept").alias("relevant"))


def filter_ratio(walks: DataFrame) -> Column:
    """Share of analysed commits that a walk leaves out."""
    return (walks["analysed"] - walks["relevant"]) / F.greatest(F.lit(1), walks["analysed"])
