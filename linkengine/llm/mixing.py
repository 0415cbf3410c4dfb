"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A tree of domain, language and source carries weights. A token budget flows from the
root down: siblings share in proportion to their weights, a node takes at most what its
leaves hold over ``max_epochs``, and what it cannot take is shared among its siblings
first; only what a whole family cannot take reaches the family's own siblings. Each
leaf then takes every document once per full epoch its budget covers and, of the epoch
that is cut, the longest prefix of a seeded order that fits the rest of the budget.

The prefix is found without ordering a leaf in one task: token sums of 256 coarse hash
ranges, then of 4096 fine ranges of the one coarse range that the budget cuts, then the
documents of the one fine range left. Only sums and that last sliver are windowed.

Cases: null level values count as the value ``unknown``. Null or empty texts have no
tokens; they come with the epochs of their leaf. Repeated ids of a leaf share one place
in the order and come or stay together. A leaf of weight zero gets nothing; a value
without a given weight has weight 1. A budget beyond all capacity selects everything
``max_epochs`` times. Very long texts count whole; a document longer than what is left
of its leaf's budget ends the prefix. An empty table gives an empty result. Other columns pass
through, whatever their names; added columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup_join, materialize, quoted, remaining, unpacked

_COARSE, _FINE = 2, 3  # hex digits of the order


def count_words(text: Column) -> Column:
    """White-space delimited words, the token measure of the native path."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x09-\x0D\x20]+")).cast("long")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1.0)
    for value, weight in weights.items():
        out = F.when(F.col(column) == value, F.lit(float(weight))).otherwise(out)
    return out


def allocate(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]], budget: float, max_epochs: int) -> DataFrame:
    """Add ``budget`` to the leaf table (levels, tokens). ``weights[i]`` maps the values of
    level i to whole numbers, relative among siblings."""
    usable = F.lit(True)
    for level, of in zip(levels, weights):
        usable = usable & (_weight(level, of) > 0)
    plan = leaves.withColumn("_cap", F.when(usable, F.col("tokens") * float(max_epochs)).otherwise(0.0))
    above = None
    for i, (level, of) in enumerate(zip(levels, weights)):
        keys = levels[: i + 1]
        nodes = plan.groupBy(*keys).agg(F.sum("_cap").alias("cap")).withColumn("w", _weight(level, of))
        if above is None:
            nodes = nodes.withColumn("_b", F.lit(float(budget)))
        else:
            nodes = nodes.join(above, levels[:i])
        family = Window.partitionBy(*levels[:i])
        order = family.orderBy(F.col("_full"), F.col(level))
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumn("_full", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(float("inf")))
        left = F.col("_b") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
        nodes = nodes.withColumn("_sated", (F.col("w") > 0) & (F.col("_full") * F.sum("w").over(after) <= left))
        spent = F.sum(F.when(F.col("_sated"), F.col("cap")).otherwise(0.0)).over(family)
        open_w = F.sum(F.when(F.col("_sated"), 0.0).otherwise(F.col("w"))).over(family)
        share = F.when(open_w > 0, (F.col("_b") - spent) / open_w * F.col("w")).otherwise(0.0)
        take = F.when(F.col("_sated"), F.col("cap")).otherwise(F.least(share, F.col("cap")))
        above = nodes.select(*keys, take.alias("_b"))
    return leaves.join(above, levels).withColumnRenamed("_b", "budget")


def _order(seed: int, epoch: Column, doc_id: str) -> Column:
    """A document's place in the seeded order of an epoch, as 32 hex digits."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), name).cast("binary"))


def _cut(sums: DataFrame, levels: list[str], key: str) -> DataFrame:
    """Of ordered range sums (levels, key, t, rest): the range that the rest cuts, and what
    is left of the rest before it."""
    order = Window.partitionBy(*levels).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_upto", F.sum("t").over(order))
    inside = (F.col("_upto") > F.col("rest")) & (F.col("_upto") - F.col("t") <= F.col("rest"))
    return sums.filter(inside).select(*levels, key, (F.col("rest") - F.col("_upto") + F.col("t")).alias("rest"))


def mix(
    documents: DataFrame,
    levels: dict[str, Column],
    weights: list[dict[str, int]],
    budget_share: float,
    max_epochs: int = 1,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The selected documents with the levels, ``n_tokens`` and ``copies`` (epochs taken).

    ``levels`` names the tree's levels, root first, with the column each is read from;
    the budget is ``budget_share`` of all tokens of the table.
    """
    names = list(levels)
    known = {name: F.coalesce(c.cast("string"), F.lit("unknown")) for name, c in levels.items()}
    # The row travels as one column, so its names meet none of those below.
    row = F.struct(*quoted(documents.columns)).alias("_row")
    rows = documents.select(row, F.col(doc_id).alias("_id"), *(c.alias(name) for name, c in known.items()), count_words(F.col(text)).alias("n_tokens"))
    facts = materialize(rows.select("_id", *names, "n_tokens"), "facts")
    leaves = materialize(facts.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = allocate(leaves, names, weights, float(int(total * budget_share)), max_epochs)
    budget = F.floor(F.round("budget", 3))
    full = F.when(F.col("tokens") > 0, F.least(F.floor(budget / F.col("tokens")), F.lit(max_epochs))).otherwise(F.when(budget > 0, 1).otherwise(0))
    plan = plan.withColumn("epochs", full.cast("int"))
    rest = F.when(F.col("epochs") < max_epochs, budget - F.col("epochs") * F.col("tokens")).otherwise(0)
    plan = materialize(plan.select(*names, "epochs", rest.cast("long").alias("rest")), "plan")

    cutting = plan.filter("rest > 0")
    ordered = lookup_join(facts, cutting, names, "inner").withColumn("h", _order(seed, F.col("epochs"), "_id"))
    ordered = ordered.withColumn("_c", F.substring("h", 1, _COARSE))
    coarse = ordered.groupBy(*names, "_c", "rest").agg(F.sum("n_tokens").alias("t"))
    cut = materialize(_cut(coarse, names, "_c"), "coarse")
    inside = lookup_join(ordered.drop("rest"), cut, [*names, "_c"], "inner").withColumn("_f", F.substring("h", _COARSE + 1, _FINE))
    inside = materialize(inside.select(*names, "_c", "_f", "h", "n_tokens", "rest"), "inside")
    fine = inside.groupBy(*names, "_c", "_f", "rest").agg(F.sum("n_tokens").alias("t"))
    cut_fine = materialize(_cut(fine, names, "_f"), "fine")
    sliver = lookup_join(inside.drop("rest"), cut_fine, [*names, "_f"], "inner")
    upto = F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("h"))
    last = sliver.withColumn("_upto", upto).filter("_upto <= rest").groupBy(*names).agg(F.max("h").alias("_h"))
    # A leaf with a cut takes what lies before its cut range, and in it up to the last that fits.
    lower = lookup_join(cut.select(*names, "_c"), cut_fine.select(*names, "_f"), names)
    lower = lower.join(last, names, "left").select(*names, F.coalesce("_h", F.concat("_c", F.coalesce("_f", F.lit("")))).alias("bound"), F.col("_h").isNotNull().alias("incl"))
    final = materialize(plan.join(lower, names, "left"), "selection")

    taken = lookup_join(rows, final, names)
    place = _order(seed, F.col("epochs"), "_id")
    partial = F.when(F.col("bound").isNotNull(), (place < F.col("bound")) | (F.col("incl") & (place == F.col("bound")))).otherwise(F.col("rest") > 0)
    copies = F.col("epochs") + partial.cast("int")
    others = remaining(documents, [*names, "n_tokens", "copies"])
    return taken.select(*unpacked(others), *names, "n_tokens", copies.alias("copies")).filter("copies > 0")
