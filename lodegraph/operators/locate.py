"""Line ranges to elements: interval and nearest joins, by file and line bins.

A range is dealt to the bins of ``BIN`` lines that it touches, a long one (over ``MANY`` bins) to coarse bins. Short ranges go to coarse bins too,
but meet there only long ones of the other side, at a level of their own; two short ranges of a file meet in fine bins alone. A
pair counts in one bin: the first that both touch. Work in a file follows the pairs that are near each other, however many lines the
file has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines to a fine and a coarse bin, and fine bins up to which a range is dealt to them.
BIN, COARSE, MANY = 64, 1 << 16, 1024


#: Levels at which ranges meet: both short, the right one long, the left one alone long.
SHORT, RIGHT_LONG, LEFT_LONG = 0, 1, 2


def _first(at: Column, lines: int) -> Column:
    return F.floor(at / lines)


def _is_long(lo: Column, hi: Column) -> Column:
    return _first(hi, BIN) - _first(lo, BIN) >= MANY


def _some_long(rows: DataFrame, lo: Column, hi: Column) -> Column:
    """Whether any of ``rows`` is long: one value, found once before the join runs."""
    return F.coalesce(rows.agg(F.bool_or(_is_long(lo, hi))).scalar(), F.lit(False))


def _dealt(rows: DataFrame, lo: Column, hi: Column, side: str, far: Column | None = None) -> DataFrame:
    """``rows`` of side ``a`` (left) or ``b`` once a bin, with ``_level, _bin``; ``far`` says whether the other side has long ranges (unknown: it may)."""
    far = F.lit(True) if far is None else far
    bins = lambda lines, level: F.transform(F.sequence(_first(lo, lines), _first(hi, lines)), lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin")))
    if_far = lambda level: F.when(far, bins(COARSE, level)).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))
    short = F.concat(bins(BIN, SHORT), if_far(RIGHT_LONG if side == "a" else LEFT_LONG))
    long = F.concat(if_far(RIGHT_LONG), bins(COARSE, LEFT_LONG)) if side == "a" else bins(COARSE, RIGHT_LONG)
    every = F.when(_is_long(lo, hi), long).otherwise(short)
    return rows.withColumn("_at", F.explode(every)).withColumns({"_level": F.col("_at.level"), "_bin": F.col("_at.bin")}).drop("_at")


def range_join(left: DataFrame, right: DataFrame, on: list[str], left_range: tuple[Column, Column], right_range: tuple[Column, Column], look: bool = False) -> DataFrame:
    """Pairs of rows that agree on ``on`` and whose ranges (first and last, both included) overlap, each once.

    The columns of a range have names that the other side lacks. Null keys, null ends and ranges that end before they begin match nothing.
    ``look``: read both sides first for long ranges, without which nothing is dealt to coarse bins; for sides that cost a scan and no shuffle.
    Sides meet by sort and merge: a side that is dealt to paths and bins has many times the rows that the planner counts, too many to broadcast.
    """
    known = lambda rows, lo, hi: rows.where((lo <= hi) & lo.isNotNull() & hi.isNotNull())
    one, two = known(left, *left_range), known(right, *right_range)
    far = lambda rows, lo, hi: _some_long(rows, lo, hi) if look else None
    a, b = _dealt(one, *left_range, "a", far(two, *right_range)), _dealt(two, *right_range, "b", far(one, *left_range))
    start = F.greatest(left_range[0], right_range[0])
    both = a.hint("merge").join(b, [*on, "_level", "_bin"]).where(F.col("_bin") == F.when(F.col("_level") == SHORT, _first(start, BIN)).otherwise(_first(start, COARSE)))
    # Ranges that share a bin need not overlap in it.
    both = both.where((left_range[0] <= right_range[1]) & (right_range[0] <= left_range[1]))
    return both.drop("_level", "_bin")


def overlapping(elements: DataFrame, hunks: DataFrame, on: list[str], slack: int = 0) -> DataFrame:
    """Pairs of ``elements(start_line, end_line)`` and ``hunks(lo, hi)`` of the same file whose ranges, each widened by ``slack``, overlap."""
    start, end, lo, hi = (F.col(c) for c in ("start_line", "end_line", "lo", "hi"))
    near = F.greatest(start - slack, lo - slack) <= F.least(end + slack, hi + slack)
    return range_join(elements, hunks, on, (start - slack, end + slack), (lo - slack, hi + slack)).where(near)


def located(nodes: DataFrame, places: DataFrame, slack: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Nodes at ``places(path, lo, hi, ...)``: METHOD, TYPE and FIELD nodes whose lines lie there; ``by``: more columns that both sides share.

    A path is a node's relative path, or any whole-folder end of its absolute one (each end is an equality, so this is one
    hash join; a path that begins inside a folder's name does not count). Ranges are widened by ``slack`` on both sides; a field
    has one line, compared with the place's first. Lines that are null or 0 match nothing.
    """
    parts = F.split("absolute_path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    every = F.array_distinct(F.array_compact(F.concat(F.array("relative_path"), F.coalesce(ends, F.array().cast("array<string>")))))
    own = nodes.where("node_type in ('METHOD', 'TYPE', 'FIELD') and line_start > 0 and line_end > 0").withColumn("path", F.explode(every))
    field, start, end, lo, hi = F.col("node_type") == "FIELD", *(F.col(c) for c in ("line_start", "line_end", "lo", "hi"))
    near = F.when(field, F.abs(start - lo) <= slack).otherwise((lo - slack <= end + slack) & (hi + slack >= start - slack))
    lines = F.least(start, end) - slack, F.when(field, start).otherwise(F.greatest(start, end)) + slack
    found = range_join(own, places, [*by, "path"], lines, (F.least(lo, hi) - slack, F.greatest(lo, hi) + slack), look=True).where(near)
    # A field's distance is that of its one line.
    return found.withColumn("start_line", start).withColumn("end_line", F.when(field, hi).otherwise(end))


def changed_nodes(n1: DataFrame, n2: DataFrame, hunks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``side, node_id``: for each hunk of ``old_path`` and ``new_path`` the nearest node on each side it touches; /dev/null is skipped.

    A hunk is known by what it holds, so equal ones count once and a task that runs again names it the same.
    """
    path = F.when(F.col("side") == "V1", F.col("old_path")).otherwise(F.col("new_path"))
    at = hunk_sides(hunks).withColumn("path", path).where("path <> '/dev/null'").select(*by, "side", "path", "lo", "hi")
    one = lambda nodes, side: nearest(located(nodes, at.where(F.col("side") == side), by=by), [*by, "side", "path", "lo", "hi"], ["node_id"])
    return one(n1, "V1").union(one(n2, "V2")).select(*by, "side", "node_id").distinct()


def nearest(pairs: DataFrame, hunk_keys: list[str], columns: list[str]) -> DataFrame:
    """Of each hunk's elements the one whose ends are nearest to its own, then the smallest id: one pre-aggregated minimum."""
    distance = F.abs(F.col("start_line") - F.col("lo")) + F.abs(F.col("end_line") - F.col("hi"))
    return pairs.groupBy(*hunk_keys).agg(F.min_by(F.struct(distance.cast("int").alias("distance"), *columns), F.struct(distance, F.col("node_id"))).alias("r")).select(*hunk_keys, "r.*")


def hunk_sides(hunks: DataFrame) -> DataFrame:
    """Changed ranges by side: inserts touch the new one, deletes the old one, replacements both; a range reaches one line past its hunk."""
    sides = F.expr("case type when 'INSERT' then array('V2') when 'DELETE' then array('V1') else array('V1', 'V2') end")
    x = hunks.select("*", F.explode(sides).alias("side"))
    begin = F.when(F.col("side") == "V1", F.col("begin_a")).otherwise(F.col("begin_b"))
    end = F.when(F.col("side") == "V1", F.col("end_a")).otherwise(F.col("end_b"))
    return x.withColumn("lo", begin + 1).withColumn("hi", F.greatest(begin, end) + 1)
