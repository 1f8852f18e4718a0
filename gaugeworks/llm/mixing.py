"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels (domain, language, source) splits a token budget from the
root down. At every node the children share its budget by their weights; a
child that holds fewer tokens than its share gives the rest to its siblings,
again by weight, and only what all of them can't hold goes back to the
ancestors, as a node's capacity is the sum below it. Each leaf then takes its
budget from seeded epochs: whole epochs while the budget covers the leaf, then
a prefix of one more epoch's seeded order, as long as the tokens so far stay
within the budget.

All of it is DataFrame operations. Only the leaf table goes through per-node
windows. The prefix ends at a key of each leaf, which a search over sums finds:
a leaf's documents are summed by the next ``DIGITS`` hex digits of their order
keys, the sums tell in which of these buckets the budget ends, and only that
bucket's documents are looked at again, until one holds about ``FEW`` of them.
Then a document is taken or not by its own key alone. So no task sorts a leaf
or a bucket of many documents, and texts (columns of ``keep``) are never shuffled.

Defined results: a null level is a node of its own; a document with null or
no tokens is never taken; a null id is ordered like the text ``null``; rows that
repeat id and leaf have equal order keys and are taken together or not at
all; nodes without a weight have weight 1; nodes of weight 0 or less get
nothing, and neither they nor what lies below them count in any capacity; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Hex digits by which a leaf's documents are summed at a time.
DIGITS = 2
#: Documents of a leaf's bucket that are summed one by one, about.
FEW = 256


def _weight(level: int, names: Sequence[str], weights: Mapping[tuple, float]) -> Column:
    """weights: by path from the root, or by the name at its level as (None, ..., name)."""
    out = F.lit(1.0)
    for path, w in sorted(((p, w) for p, w in weights.items() if len(p) == level + 1), key=lambda x: sum(v is not None for v in x[0])):
        match = F.lit(True)
        for i, v in enumerate(path):
            if v is not None or i == level:
                match = match & F.col(names[i]).eqNullSafe(F.lit(v))
        out = F.when(match, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, names: Sequence[str], weights: Mapping[tuple, float], total: float, max_epochs: float) -> DataFrame:
    """leaves: the levels and ``tokens``. Adds ``budget``, in tokens."""
    nodes = leaves
    for level in range(len(names)):  # what hangs on a node without weight can't take what its ancestors are given
        nodes = nodes.filter(_weight(level, names, weights) > 0)
    nodes = nodes.withColumn("capacity", F.col("tokens") * F.lit(float(max_epochs)))
    held = nodes.agg(F.sum("capacity")).first()[0] or 0.0
    nodes = nodes.withColumn("budget", F.lit(min(float(total), held)))
    for level, name in enumerate(names):
        above, here = list(names[:level]), list(names[: level + 1])
        children = nodes.groupBy(*here).agg(F.sum("capacity").alias("_c"), F.first("budget").alias("_parent")).withColumn("_w", _weight(level, names, weights))
        children = children.withColumn("_ratio", F.col("_c") / F.col("_w"))
        family = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        order = family.orderBy("_ratio")
        # a child is full if, were its ratio the level for all, the budget would still do
        level_at = F.sum("_c").over(order) + (F.sum("_w").over(family) - F.sum("_w").over(order)) * F.col("_ratio")
        children = children.withColumn("_full", level_at <= F.col("_parent"))
        share = (F.col("_parent") - F.sum(F.when(F.col("_full"), F.col("_c")).otherwise(0.0)).over(family)) / F.sum(F.when(F.col("_full"), F.lit(0.0)).otherwise(F.col("_w"))).over(family)
        children = children.withColumn("_share", F.when(F.col("_full"), F.col("_c")).otherwise(share * F.col("_w")))
        children = children.select(*[F.col(n).alias(f"_k{i}") for i, n in enumerate(here)], "_share")
        same = F.lit(True)
        for i, n in enumerate(here):
            same = same & F.col(n).eqNullSafe(F.col(f"_k{i}"))
        nodes = nodes.join(children, same).drop("budget", *[f"_k{i}" for i in range(len(here))]).withColumnRenamed("_share", "budget")
    return nodes.drop("capacity")


def select(docs: DataFrame, levels: Sequence[str], *, id_col: str, token_col: str, weights: Mapping[tuple, float], total_share: float | None = None, total_tokens: float | None = None, max_epochs: float = 1.0, seed: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """The documents taken: id, the levels, tokens, ``epochs`` (times taken) and the columns of ``keep``.

    The budget is ``total_tokens``, or ``total_share`` of all tokens.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    kept = [f"_k_{i}" for i in range(len(keep))]
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(n) for c, n in zip(levels, names, strict=True)], F.col(token_col).cast("long").alias("tokens"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)])
    rows = rows.filter("tokens > 0")
    narrow = materialise(rows.select("_id", *names, "tokens"), "mix-rows")  # texts are read once, not for every pass
    leaves = materialise(narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "mix-leaves")
    tokens, most = leaves.agg(F.sum("tokens"), F.max("rows")).first()
    if total_tokens is None:
        total_tokens = float(tokens or 0) * float(total_share)
    plan = budgets(leaves.drop("rows"), names, weights, total_tokens, max_epochs)
    plan = plan.withColumn("_whole", F.floor(F.col("budget") / F.col("tokens"))).withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("tokens"))
    plan = plan.select(*[F.col(n).alias(f"_p{i}") for i, n in enumerate(names)], "_whole", "_rest", F.lit("").alias("_prefix"), F.lit(0).cast("long").alias("_before"))
    plan = materialise(plan, "mix-plan")

    def keyed(table: DataFrame, plan: DataFrame) -> DataFrame:
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))).cast("binary"))
        same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_p{i}")) for i, n in enumerate(names)])
        return table.join(plan, same).withColumn("_key", key)

    places, digits = [f"_p{i}" for i in range(len(names))], 0
    while True:
        step = 32 if (most or 0) <= FEW * 16**digits else digits + DIGITS
        plan = materialise(_narrowed(keyed(narrow, plan), plan, places, step), "mix-plan")
        if step == 32:
            break
        digits = step
    out = keyed(rows if keep else narrow, plan).drop(*places)
    taken = out.withColumn("_epochs", F.col("_whole") + F.when(F.col("_key") <= F.col("_prefix"), 1).otherwise(0)).filter("_epochs > 0")
    return taken.select(F.col("_id").alias(id_col), *[F.col(n).alias(c) for n, c in zip(names, levels, strict=True)], "tokens", F.col("_epochs").cast("long").alias("epochs"), *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)])


def _narrowed(rows: DataFrame, plan: DataFrame, places: Sequence[str], digits: int) -> DataFrame:
    """The plan with the prefix, of so many digits, of the key up to which a leaf's documents fit the rest of its budget.

    With all 32 digits, the prefix becomes the last key that fits; ``~`` stands for a leaf whose documents all fit.
    """
    rows = rows.filter(F.startswith("_key", "_prefix"))
    sums = rows.groupBy(*places, F.substring("_key", 1, digits).alias("_bucket")).agg(F.sum("tokens").alias("_sum"), F.first("_rest").alias("_r"), F.first("_before").alias("_b"))
    order = Window.partitionBy(*places).orderBy("_bucket")
    sums = sums.withColumn("_upto", F.col("_b") + F.sum("_sum").over(order))
    over = F.col("_upto") > F.col("_r")
    if digits < 32:
        ends = sums.groupBy(*places).agg(F.min(F.when(over, F.struct("_bucket", (F.col("_upto") - F.col("_sum")).alias("before")))).alias("_end"))
        prefix, before = F.coalesce("_end._bucket", F.lit("~")), F.coalesce("_end.before", F.col("_before"))
    else:  # no key is as small as a prefix of its own
        ends = sums.groupBy(*places).agg(F.max(F.when(~over, F.col("_bucket"))).alias("_end"))
        prefix, before = F.coalesce("_end", F.col("_prefix")), F.col("_before")
    named = ends.toDF(*[f"_q{i}" for i in range(len(places))], "_end")
    same = reduce(Column.__and__, [F.col(p).eqNullSafe(F.col(f"_q{i}")) for i, p in enumerate(places)])
    joined = plan.join(named, same, "left")
    # a leaf that has found its end has no documents left to sum
    return joined.select(*places, "_whole", "_rest", F.when(F.col("_prefix") == "~", "~").otherwise(prefix).alias("_prefix"), before.alias("_before"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \t\n\r]+"))


def domain_of(source: Column, domains: int = 4) -> Column:
    """Sources are numbered; a domain is the number's remainder. Without a number: ``other``."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", "other").otherwise(F.concat(F.lit("d"), F.pmod(number.cast("int"), F.lit(domains)).cast("string")))
