"""Occurrences to weighted edges, and keyed merges with a defined first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions import exprs as X
from lodegraph.functions import texts as T
from lodegraph.sources.tables import spread


def route(occurrences: DataFrame, nodes: DataFrame) -> DataFrame:
    """Occurrences whose both ends are known, with an edge type and the ends' kinds.

    TESTS leads from a test method to a method that is none, or to a constructor whose file lies in no test folder
    (``/test/``); everything else is CALLS, as is a constructor of unknown place.
    """
    path = F.col("absolute_path") if "absolute_path" in nodes.columns else F.lit(None).cast("string")
    src = nodes.select(F.col("node_id").alias("src"), F.col("kind").alias("src_kind"))
    dst = nodes.select(F.col("node_id").alias("dst"), F.col("kind").alias("dst_kind"), path.alias("dst_path"))
    inside = F.contains("dst_path", F.lit("/test/")) | F.contains("dst_path", F.lit("\\test\\"))
    made = F.col("occ_kind") == "CONSTRUCTOR" if "occ_kind" in occurrences.columns else F.lit(False)
    tested = F.when(made, ~inside).otherwise(F.col("dst_kind") != "TEST_METHOD")
    kind = F.when((F.col("src_kind") == "TEST_METHOD") & tested, "TESTS").otherwise("CALLS")
    known = spread(spread(occurrences, "src").join(src, "src"), "dst", like=occurrences)
    return known.join(dst, "dst").withColumn("edge_type", kind).drop("dst_path")


def collapse(occurrences: DataFrame, keys: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """One edge for each key: how often, first and last line, distinct lines and kinds, hotspot, frequency."""
    g = occurrences.groupBy(*keys).agg(
        F.count("*").alias("call_count"), F.min("line").alias("first_line"), F.max("line").alias("last_line"),
        F.sort_array(F.collect_set("line")).alias("lines"), F.sort_array(F.collect_set("occ_kind")).alias("kinds"),
    )
    return g.withColumn("is_hotspot", X.is_hotspot(F.col("call_count"))).withColumn("frequency", X.frequency(F.col("call_count")))


def first_only(occurrences: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """The first row of each key by ``order``, as one pre-aggregated minimum (no window, no sort)."""
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return occurrences.groupBy(*keys).agg(first.alias("r")).select(*keys, "r.*")


def calls(occurrences: DataFrame, keys: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """CALLS edges: :func:`collapse`, and what several calls add: their types, a description and a summary, each null for a single one."""
    g = collapse(occurrences, keys)
    many = F.col("call_count") > 1
    out = g.withColumn("call_types", F.when(many & (F.size("kinds") > 0), F.col("kinds"))).withColumn("description", F.when(many, T.call_description(F.col("call_count"), F.col("lines"))))
    return out.withColumn("semantic_summary", F.when(many, T.call_summary(F.col("call_count"))))


def accesses(occurrences: DataFrame, verb: str, keys: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """READS (``verb`` is read) or WRITES (written) edges; first and last line, types and texts only where there are several."""
    g = occurrences.groupBy(*keys).agg(F.count("*").alias("access_count"), F.sort_array(F.collect_set("line")).alias("lines"), F.sort_array(F.collect_set("occ_kind")).alias("kinds"))
    many = F.col("access_count") > 1
    more = {
        "first_line": F.element_at("lines", 1), "last_line": F.element_at("lines", -1), "access_types": F.when(F.size("kinds") > 0, F.col("kinds")),
        "description": T.access_description(verb, F.col("access_count"), F.col("lines")),
        "semantic_summary": T.access_summary({"read": "access", "written": "modification"}[verb], F.col("access_count")),
    }
    return g.withColumns({c: F.when(many, v) for c, v in more.items()}).drop("kinds")


#: Lists of an evolution edge that merging unites.
EVOLUTION_LISTS = ("left_locations", "right_locations", "left_elements", "right_elements", "refactoring_types", "descriptions")


def merge_evolution(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Evolution edges by (src, edge_type, dst), and ``by`` before them: occurrences, best confidence, and each list united in first-seen order of ``seq``.

    Lists that ``edges`` has (see ``EVOLUTION_LISTS``) are united, ``type`` and ``description`` count as lists of one.
    Other columns are those of the first edge.
    """
    keys = [*by, "src", "edge_type", "dst"]
    lists = {c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in EVOLUTION_LISTS if c in edges.columns}
    for one, many in (("type", "refactoring_types"), ("description", "descriptions")):
        if one in edges.columns:
            own = F.array(F.col(one))
            lists[many] = F.concat(lists[many], own) if many in lists else own
    first = [c for c in edges.columns if c not in (*keys, "confidence", *lists, "type", "description")]
    united = lambda c: X.trimmed_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", lists[c].alias("v")))), lambda r: r["v"])))
    aggs = [F.count("*").alias("occurrences"), F.max("confidence").alias("confidence"), F.min(F.struct("seq", *[c for c in first if c != "seq"])).alias("r")]
    merged = edges.groupBy(*keys).agg(*aggs, *[united(c).alias(c) for c in lists])
    return merged.select(*keys, "occurrences", "confidence", *lists, *[F.col(f"r.{c}").alias(c) for c in first])
