"""Similarity joins of methods: candidates by shared tokens, bounded by sizes and bit masks before anything is scored.

Two methods meet at each token that both hold, with all that scoring needs in the rows that meet. A pair is looked at further only if what
their sizes and the bits of their sets allow reaches the threshold, and counts at the first of its common tokens alone: no table of pairs is
shuffled. Where one kind of set must have a similarity ``j``, two sets share one of each other's first ``n - ceil(j * n) + 1`` tokens, if both are
sorted the same way; rarest first, those keys meet seldom.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions import exprs as X
from lodegraph.operators import versions as R
from lodegraph.sources.tables import dealt

#: Weights of the structural score (fixed values): lines, complexity, called methods, accessed fields, local variables.
LINES, COMPLEXITY, CALLED, FIELDS, VARIABLES = 0.2, 0.2, 0.3, 0.2, 0.1
#: Weights of the design's likeness (fixed values): name, signature, code, calls.
NAME, SIGNATURE, CODE, CALLS = 0.3, 0.2, 0.3, 0.2


def by_rarity(sides: list[DataFrame], column: str, by: tuple[str, ...] = ()) -> list[DataFrame]:
    """For each side ``node_id`` (after ``by``) and ``column``, its distinct tokens, rarest over all sides first, then by token; no row for an empty set."""
    split = [df.select(*by, "node_id", F.explode(F.array_distinct(column)).alias("token")) for df in sides]
    every = split[0]
    for df in split[1:]:
        every = every.unionByName(df)
    often = every.groupBy("token").agg(F.count("*").alias("often"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("often", "token"))), lambda t: t["token"]).alias(column)
    return [df.join(often, "token").groupBy(*by, "node_id").agg(ordered) for df in split]


def prefix(tokens: Column, least: float) -> Column:
    """Of tokens in order those that a set of similarity ``least`` or more must share one of."""
    n = F.size(tokens)
    # A hair less than the bound, so that rounding makes a prefix longer, never shorter.
    return F.slice(tokens, F.lit(1), F.least(n, n - F.ceil(n * (least - 1e-9)) + 1).cast("int"))


def _mask(tokens: Column) -> Column:
    """A bit for each token, by its hash, of 64."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(t).bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(bit(t)))


def _tokens(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.coalesce(column, F.array().cast("array<string>")))))


def _once(df: DataFrame, columns: list[str], **values: Column) -> DataFrame:
    """``columns`` and ``once``, a struct of values that later conditions read: generated, so that they are neither computed again there nor drawn into the join."""
    return df.select(*columns, F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("once"))


def _bits(column: str) -> dict[str, Column]:
    """What `_most_alike` needs of a set: its size, its mask, and how many tokens share a bit with another."""
    bits = F.coalesce(_mask(F.col(column)), F.lit(0).cast("long"))
    return {f"{column}_n": F.size(column), f"{column}_bits": bits, f"{column}_hidden": F.size(column) - F.bit_count(bits)}


def _most_alike(column: str) -> Column:
    """A bound on the Jaccard similarity of two sets: shared tokens share their bits, but for hidden ones. Kept short, as it is computed for every two that meet."""
    a, b = (lambda x: F.col(f"a.{column}_{x}")), (lambda x: F.col(f"b.{column}_{x}"))
    shared = F.bit_count(a("bits").bitwiseAND(b("bits"))) + F.least(a("hidden"), b("hidden"))
    return shared / F.greatest(a("n") + b("n") - shared, a("n"), b("n"), F.lit(1))


def structural_candidates(a: DataFrame, b: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """``v1_id, v2_id, score`` (after ``by``): every pair of methods that share a called method or an accessed field and whose `versions.structural_score` reaches ``threshold``.

    Sizes alone add at most 0.5, so with a threshold of 0.5 or more (less is refused) a pair without a common token reaches it only
    with all sizes equal; those are `size_twins`. Null sizes, sets and tokens count as none; scores are rounded to six digits.
    """
    if threshold < 0.5:
        raise ValueError("below 0.5 sizes alone reach the threshold")
    kinds = ("called_methods", "accessed_fields")
    keyed = lambda kind, tokens: F.transform(tokens, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))
    sides = []
    for df, p in ((a, "a"), (b, "b")):
        full = df.select(*by, "node_id", "lines_of_code", "complexity", *[_tokens(c).alias(c) for c in kinds], F.coalesce(F.size("local_variables"), F.lit(0)).alias("variables"))
        full = full.withColumns({f"{c}_size": F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("double") for c in ("lines_of_code", "complexity", "variables")} | _bits(kinds[0]) | _bits(kinds[1]))
        own = [c for c in full.columns if c not in by]
        keys = F.concat(*[keyed(i, c) for i, c in enumerate(kinds)])
        sides.append(full.select(*by, F.explode(keys).alias("key"), F.struct(*own).alias(p)))
    near = [w * F.least(f"a.{c}_size", f"b.{c}_size") / F.greatest(f"a.{c}_size", f"b.{c}_size", F.lit(0.5)) for c, w in (("lines_of_code", LINES), ("complexity", COMPLEXITY), ("variables", VARIABLES))]
    bound = near[0] + near[1] + near[2] + CALLED * _most_alike("called_methods") + FIELDS * _most_alike("accessed_fields")
    met = dealt(sides[0], *by, "key").join(dealt(sides[1], *by, "key"), [*by, "key"]).where(bound >= threshold - 1e-6)
    met = _once(met, [*by, "key", "a", "b"], **{c: F.array_intersect(f"a.{c}", f"b.{c}") for c in kinds})
    common = [F.col(f"once.{c}") for c in kinds]
    first = F.when(F.col("key.kind") == 0, F.col("key.token") == F.array_min(common[0])).otherwise((F.size(common[0]) == 0) & (F.col("key.token") == F.array_min(common[1])))
    alike = [F.size(x) / F.greatest(F.col(f"a.{c}_n") + F.col(f"b.{c}_n") - F.size(x), F.lit(1)) for x, c in zip(common, kinds, strict=True)]
    size = lambda c, w: R.ratio_score(F.col(f"a.{c}"), F.col(f"b.{c}"), w)
    score = size("lines_of_code", LINES) + size("complexity", COMPLEXITY) + CALLED * alike[0] + FIELDS * alike[1] + size("variables", VARIABLES)
    scored = _once(met.where(first), [*by, "a", "b"], score=F.round(score, 6)).where(F.col("once.score") >= threshold)
    return scored.select(*by, F.col("a.node_id").alias("v1_id"), F.col("b.node_id").alias("v2_id"), "once.score")


def size_twins(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``v1_id, v2_id, score`` 0.5: methods of equal lines, complexity and number of local variables (none of them 0), k-th with k-th by id."""
    sizes = ["lines_of_code", "complexity", "variables"]

    def side(df: DataFrame, name: str) -> DataFrame:
        own = df.withColumn("variables", F.size("local_variables")).where("lines_of_code > 0 and complexity > 0 and variables > 0")
        return own.select(*by, *sizes, F.col("node_id").alias(name), F.row_number().over(Window.partitionBy(*by, *sizes).orderBy("node_id")).alias("k"))

    return side(a, "v1_id").join(side(b, "v2_id"), [*by, *sizes, "k"]).select(*by, "v1_id", "v2_id", F.lit(0.5).alias("score"))


@dataclass
class StructuralJoin:
    """A matcher of `versions.match_all`: likeness of methods whatever their names, so that a renamed method finds itself."""

    name: str = "StructuralMatcher"
    priority: int = 10
    node_types: tuple[str, ...] = ("METHOD",)
    block: tuple[str, ...] = ()

    def score(self) -> Column:
        return R.structural_score()

    def candidates(self, a: DataFrame, b: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
        return structural_candidates(a, b, threshold, by)

    def leftovers(self, a: DataFrame, b: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
        """Pairs at exactly 0.5 that share no token: of equal sizes, taken in order after all others, as every choice among them is as good."""
        return size_twins(a, b, by) if threshold <= 0.5 else size_twins(a, b, by).limit(0)


def similar_methods(a: DataFrame, b: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``v1_id, v2_id, score``: every pair of ``node_id, name, signature, code, calls`` (the last two arrays) whose likeness exceeds ``threshold``.

    0.3 name (one minus edit distance over the longer length) + 0.2 equal signature + 0.3 code + 0.2 calls (shared over all
    tokens; two empty sets are alike; null tokens count as none). What is missing to 1 must be less than ``1 - threshold`` in all: that requires equal
    signatures where it is at most 0.2, and a least similarity of calls, or else of code, by whose prefixes pairs meet. Code and calls are bounded by
    their bits, then scored; what they leave bounds the edit distance, first by lengths, then by shared two-letter pieces, and only then names are compared.
    """
    room = 1 - threshold
    if room >= CODE:
        raise ValueError("such a threshold is met without any common code")
    # Calls are the rarer tokens. A similarity of 0 exactly leaves a score of ``threshold`` at most, which does not exceed it.
    key, weight = ("calls", CALLS) if room <= CALLS + 1e-9 else ("code", CODE)
    least = max(1 - room / weight, 0.0)
    on = ["token", "signature"] if room <= SIGNATURE + 1e-9 else ["token"]
    c = F.col
    own = [df.select("node_id", "name", "signature", _tokens("code").alias("code"), _tokens("calls").alias("calls")) for df in (a, b)]
    some = [df.select("node_id", F.when(F.size(key) > 0, c(key)).otherwise(F.array(F.lit(""))).alias("keys")) for df in own]  # two empty ones share the empty token
    sides = []
    for df, tokens, p in zip(own, by_rarity(some, "keys"), "ab", strict=True):
        full = df.join(tokens, "node_id").withColumns(_bits("code") | _bits("calls"))
        sides.append(full.select(F.explode(prefix(c("keys"), least)).alias("token"), *on[1:], F.struct("*").alias(p)))
    alike = lambda x: F.when((c(f"a.{x}_n") == 0) & (c(f"b.{x}_n") == 0), 1.0).otherwise(_most_alike(x))
    longer = F.greatest(F.length("a.name"), F.length("b.name"), F.lit(1))
    signature = SIGNATURE * F.coalesce((c("a.signature") == c("b.signature")).cast("int"), F.lit(0))
    bound = signature + CODE * alike("code") + CALLS * alike("calls") + NAME * (1 - F.abs(F.length("a.name") - F.length("b.name")) / longer)
    met = dealt(sides[0], *on).join(dealt(sides[1], *on), on).where(bound > threshold - 1e-6)
    rest = signature + CODE * X.jaccard(c("a.code"), c("b.code")) + CALLS * X.jaccard(c("a.calls"), c("b.calls"))
    met = _once(met, ["token", "a", "b"], first=F.get(F.array_intersect("a.keys", "b.keys"), F.lit(0)), rest=rest)
    both = met.where("token = once.first").select("a", "b", longer.alias("longer"), "once.rest")
    # At most so many edits; each spoils two pieces of two letters.
    edits = ((c("rest") + NAME - threshold) / NAME + 1e-9) * c("longer")
    pieces = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    grams = lambda s: F.when(F.length(s) > 1, pieces(s)).otherwise(F.array().cast("array<string>"))
    kept = F.size(F.filter(grams(c("a.name")), lambda g: F.array_contains(grams(c("b.name")), g)))
    both = both.where(c("rest") + NAME > threshold - 1e-9).where(F.abs(F.length("a.name") - F.length("b.name")) <= edits)
    both = both.where(kept >= F.length("a.name") - 1 - 2 * edits)
    score = F.round(c("rest") + NAME * (1 - F.levenshtein("a.name", "b.name") / c("longer")), 6)
    return both.select(c("a.node_id").alias("v1_id"), c("b.node_id").alias("v2_id"), score.alias("score")).where(c("score") > threshold)
