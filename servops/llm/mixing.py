"""Mixing sources to target weights by hierarchical budgeting (operator 6).

The sources form a tree: domain, language, source. A token budget flows from the root to the leaves.
At each node the children's weights divide it; a child whose documents (times the allowed epochs) can't
fill its part gets all they hold, and what it leaves goes to its siblings by their weights, before any of it
reaches the next higher level. A leaf takes its documents in a seeded order, epoch after epoch,
and the last epoch's prefix that fits.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: rows that one window of the running sum should hold, about
ROWS_A_BIN = 20_000
#: bits of the seeded order (15 hexadecimal digits)
ORDER_BITS = 60


def tokens_of(text: Column) -> Column:
    """Default size of a document: its UTF-8 bytes by four, at least one for a text that isn't empty."""
    return F.coalesce(F.ceil(F.octet_length(text) / 4), F.lit(0)).cast("long")


def weight_of(levels: list[Column], weights: dict[tuple, int]) -> Column:
    """Weight of a node among its siblings: by its path, else by its own name at that depth, else 1."""
    out = F.lit(1)
    for path, w in sorted(weights.items(), key=lambda x: (len(x[0]), str(x[0]))):
        if len(path) == len(levels):
            hit = F.lit(True)
            for c, v in zip(levels, path):
                if v is not None:
                    hit = hit & c.eqNullSafe(F.lit(v))
            out = F.when(hit, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def divide(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget``: each child's part of its parent's ``given`` tokens.

    ``children``: the parent's columns, ``name``, ``weight``, ``held`` (what the child can fill) and ``given``.
    In the order of held / weight, a child is filled whole while it holds no more than its weight's
    part of what is left; the others share the rest by weight, rounded down. All in whole numbers.
    """
    big = lambda c: c.cast("decimal(20,0)")
    order = Window.partitionBy(*parent).orderBy(F.col("held") / F.col("weight"), F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    c = children.withColumn("_used", F.coalesce(F.sum("held").over(before), F.lit(0))) \
        .withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))) \
        .withColumn("_left", F.greatest(F.col("given") - F.col("_used"), F.lit(0)))
    # true for a first stretch of the order
    c = c.withColumn("_full", (F.col("held") == 0) | (big(F.col("held")) * big(F.col("_weights"))
                                                      <= big(F.col("_left")) * big(F.col("weight"))))
    c = c.withColumn("_rest", F.col("given") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("held"))).over(whole), F.lit(0))) \
        .withColumn("_open", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole), F.lit(0)))
    part = F.expr("cast(_rest as decimal(20,0)) * cast(weight as decimal(18,0)) div nullif(cast(_open as decimal(20,0)), 0)")
    return c.withColumn("budget", F.when(F.col("_full"), F.col("held")).otherwise(F.coalesce(part, F.lit(0))).cast("long")) \
        .drop("_used", "_weights", "_left", "_full", "_rest", "_open")


def leaf_budgets(leaves: DataFrame, levels: list[str], budget: Column, epochs: int, weights: dict[tuple, int]) -> DataFrame:
    """``leaves`` (levels and their ``tokens``) with each leaf's ``budget`` of the whole ``budget``."""
    nodes = leaves.withColumn("held", F.col("tokens") * epochs)
    given = None
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        level = nodes.groupBy(*path).agg(F.sum("held").alias("held"))
        level = level.withColumn("weight", weight_of([F.col(c) for c in path], weights))
        if given is None:
            level = level.withColumn("given", F.least(budget, F.sum("held").over(Window.partitionBy(F.lit(0)))))
            level = divide(level.withColumn("_root", F.lit(0)), ["_root"], path[-1]).drop("_root")
        else:
            up = given.select(*[F.col(c).alias(f"_{c}") for c in path[:-1]], F.col("budget").alias("given"))
            same = F.lit(True)
            for c in path[:-1]:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            level = divide(level.join(up, same).drop(*[f"_{c}" for c in path[:-1]]), path[:-1], path[-1])
        given = level.select(*path, "budget")
    return given


def seeded_order(seed: int, epoch: Column, id_col: Column, text: Column) -> Column:
    """60-bit order of a row in an epoch; a row without id goes by its text."""
    name = F.coalesce(id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, levels: dict[str, Column], budget_share: float = 0.5, epochs: int = 2,
        weights: dict[tuple, int] | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
        tokens: Column | None = None) -> DataFrame:
    """How often each row of ``docs`` is taken: ``docs`` with mix_tokens, mix_copies and a column mix_<level> a level.

    ``levels`` name the tree's levels from the top and give their columns (null is a node of its own);
    ``weights`` map a path (None in it: any name) to a positive whole number, 1 by default. The budget is
    ``budget_share`` of all tokens, rounded down; a leaf may be used ``epochs`` times. Of its budget a leaf
    takes as many whole epochs as fit, then the documents of one more in their seeded order as long as
    the running sum stays within the rest; rows of equal order (same id) go together. A leaf without any
    token is taken once. A null or empty text has no tokens. Input columns with the names of these are replaced, all others stay.

    A leaf can hold a third of all rows: its order is cut into bins, the bins' sums are added up first, and
    only the bin in which the budget ends is put in order. That gives each leaf the last order it takes, and
    rows are taken by comparing with it: texts are never shuffled.
    """
    names = [f"mix_{n}" for n in levels]
    size = tokens if tokens is not None else tokens_of(F.col(text_col))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*map(str.lower, names), "mix_tokens", "mix_copies"}]
    base = docs.select(F.struct(*kept).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       *[c.alias(n) for n, c in zip(names, levels.values())], size.cast("long").alias("mix_tokens"))
    leaves = cut_lineage(base.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    total = leaves.agg(F.sum("tokens").alias("tokens"), F.max("rows").alias("rows")).first()
    budget = int((total["tokens"] or 0) * budget_share)
    bits = max(4, (-(-(total["rows"] or 0) // ROWS_A_BIN)).bit_length())

    def same(table, cols=names):
        """Condition that a leaf's columns are those of ``table`` (there with a leading underscore)."""
        out = F.lit(True)
        for c in cols:
            out = out & F.col(c).eqNullSafe(table[f"_{c}"])
        return out
    renamed = {c: f"_{c}" for c in names}
    given = leaf_budgets(leaves, names, F.lit(budget).cast("long"), epochs, weights or {}).withColumnsRenamed(renamed)
    plan = leaves.join(given, same(given)).select(
        *names, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).alias("whole"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"))
    plan = cut_lineage(plan.withColumnsRenamed(renamed))
    turn = base.join(plan, same(plan)).drop(*renamed.values()) \
        .withColumn("_order", seeded_order(seed, F.col("whole"), F.col("id"), F.col("text")))

    # the bin in which each leaf's rest ends, and what the bins before it hold
    rows = turn.where(F.col("rest") > 0).select(*names, "rest", "mix_tokens", "_order",
                                                F.shiftright("_order", ORDER_BITS - bits).alias("_bin"))
    along = Window.partitionBy(*names).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*names, "rest", "_bin").agg(F.sum("mix_tokens").alias("t")) \
        .withColumn("before", F.coalesce(F.sum("t").over(along), F.lit(0)))
    last = sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")))
    last = cut_lineage(last.select(*names, F.col("_bin").alias("_last"), "before").withColumnsRenamed(renamed))
    inside = rows.join(last, same(last) & (F.col("_bin") == F.col("_last"))) \
        .groupBy(*names, "rest", "before", "_order").agg(F.sum("mix_tokens").alias("t"))
    running = Window.partitionBy(*names).orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = inside.withColumn("_sum", F.col("before") + F.sum("t").over(running)).where(F.col("_sum") <= F.col("rest")) \
        .groupBy(*names).agg(F.max("_order").alias("_cut")).withColumnsRenamed(renamed)
    # a leaf whose first row in that bin doesn't fit ends before the bin
    bound = last.withColumn("_start", F.shiftleft("_last", ORDER_BITS - bits) - 1)
    ends = bound.withColumnsRenamed({f"_{c}": c for c in names}).join(cuts, same(cuts), "left") \
        .select(*names, F.coalesce("_cut", "_start").alias("_end")).withColumnsRenamed(renamed)
    ends = cut_lineage(ends)
    taken = turn.join(ends, same(ends), "left") \
        .withColumn("mix_copies", F.col("whole") + F.coalesce(F.col("_order") <= F.col("_end"), F.lit(False)).cast("long"))
    return taken.select("row.*", *names, "mix_tokens", "mix_copies")
