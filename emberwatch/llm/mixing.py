"""Mixing sources to target weights: budgets down a domain-language-source tree, then token prefixes of seeded epochs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.session import checkpointed

LEVELS = ("domain", "lang", "source")
#: Stands for a null value of a level.
NONE = "(none)"
#: Leading digits of the order key by which a leaf's running total is cut into pieces.
PIECE_DIGITS = 3
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Target weights by level and value (1 where not listed, none at 0) and what the mix is cut to.

    `budget_share` is the mix's size in tokens over that of the input; no leaf is repeated more than `max_epochs` times.
    """

    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    budget_share: float = 1.0
    max_epochs: int = 1
    seed: int = 0

    def weight(self, level: str) -> Column:
        out = F.lit(1.0)
        for value, weight in self.weights.get(level, {}).items():
            out = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(out)
        return out


def filled(children: DataFrame, parents: list[str], key: str, mix: Mix) -> DataFrame:
    """Adds each child's `budget` out of its parent's `parent_budget`: proportional to weight, at most its `cap`.

    What a capped child can't take goes to its siblings by weight. With children in order of cap / weight, the level
    after k capped ones is (budget - their caps) / (weight of the rest); it rises up to the first child that is not
    capped and falls after it, so its maximum is the level that all such children share.
    """
    at = Window.partitionBy(*parents).orderBy("ratio", key)
    weighed = children.withColumn("weight", mix.weight(key)).filter("weight > 0")
    steps = weighed.withColumn("ratio", F.col("cap") / F.col("weight")).withColumns({
        "capped": F.coalesce(F.sum("cap").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(at.rowsBetween(0, Window.unboundedFollowing))})
    level = F.max((F.col("parent_budget") - F.col("capped")) / F.col("open")).over(Window.partitionBy(*parents))
    return steps.withColumn("budget", F.least("cap", F.col("weight") * level)).drop("ratio", "capped", "open", "weight")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(levels, tokens, budget) from (levels, tokens): one small row per leaf, however large the leaf is.

    A node's capacity is the sum of its leaves', so a shortage is made up among siblings first, and only what a whole
    subtree can't give moves to the siblings of an ancestor.
    """
    sized = leaves.withColumn("cap", F.col("tokens") * float(mix.max_epochs))
    level = sized.groupBy().agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    level = level.select(F.least("cap", F.col("tokens") * mix.budget_share).alias("budget"))
    parents: list[str] = []
    for key in LEVELS:
        children = sized.groupBy(*parents, key).agg(F.sum("cap").alias("cap"))
        up = level.withColumnRenamed("budget", "parent_budget")
        children = children.join(up, parents) if parents else children.join(F.broadcast(up))
        level = filled(children, parents or [F.lit(0)], key, mix).select(*parents, key, "budget")
        parents.append(key)
    return sized.select(*LEVELS, "tokens").join(level, list(LEVELS))


def order_key(mix: Mix, epoch: Column) -> Column:
    """Place of a document in an epoch's seeded order; rows with the same doc_id share it and stay together."""
    return F.md5(F.concat_ws(":", F.lit(mix.seed), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def leaf_cuts(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(levels, budget, epochs, last_key): whole epochs of each leaf, then the documents up to last_key of the next.

    Running totals go over pieces of the order, then over the documents of the one piece in which a budget ends, so a
    leaf with a third of all rows is never sorted in one task.
    """
    keys = list(LEVELS)
    leaves = checkpointed(sizes.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"))
    budgets = checkpointed(leaf_budgets(leaves, mix).withColumn("target", F.floor(F.col("budget") + 0.5)).selectExpr(
        *keys, "target", "cast(floor(target / tokens) as int) as epochs", "target % tokens as rest"))
    placed = sizes.join(budgets.filter("rest > 0"), keys).withColumn("key", order_key(mix, F.col("epochs")))
    placed = placed.withColumn("piece", F.substring("key", 1, PIECE_DIGITS))
    pieces = placed.groupBy(*keys, "piece", "rest").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("piece")) - F.col("n")
    ends = pieces.withColumn("before", before).filter("before < rest and before + n >= rest")
    rows = placed.join(ends.select(*keys, "piece", "before"), [*keys, "piece"])
    rows = rows.groupBy(*keys, "key", "rest", "before").agg(F.sum("n_tokens").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys).orderBy("key")) - F.col("n")
    last = rows.withColumn("upto", upto).filter("upto < rest").groupBy(*keys).agg(F.max("key").alias("last_key"))
    return budgets.join(last, keys, "left").select(*keys, "target", "epochs", "last_key")


def counted(docs: DataFrame, domain: Column, mix: Mix) -> DataFrame:
    """`docs` with its levels, n_tokens, target and copies under names with two leading underscores.

    Only narrow rows are shuffled to find the cuts; the texts stay where they are unless the leaves are very many.
    """
    levels = [f"__{k}" for k in LEVELS]
    values = {"__domain": domain, "__lang": F.col("lang"), "__source": F.col("source")}
    rows = docs.withColumns({k: F.coalesce(v.cast("string"), F.lit(NONE)) for k, v in values.items()})
    rows = rows.withColumn("__n_tokens", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"))
    sizes = rows.select("doc_id", *(F.col(k).alias(k[2:]) for k in [*levels, "__n_tokens"]))
    cuts = checkpointed(leaf_cuts(checkpointed(sizes), mix))
    cuts = cuts.select(*(F.col(c).alias(f"__{c}") for c in cuts.columns))
    joined = rows.join(cuts, levels, "left").withColumn("__key", order_key(mix, F.col("__epochs")))
    part = F.coalesce(F.col("__key") <= F.col("__last_key"), F.lit(False)).cast("int")
    return joined.withColumns({"__copies": F.coalesce(F.col("__epochs") + part, F.lit(0)),
                               "__target": F.coalesce("__target", F.lit(0))})


def mixed(docs: DataFrame, domain: Column, mix: Mix) -> DataFrame:
    """doc_id, levels, n_tokens, target (of the leaf, in tokens) and copies (0: not in the mix) of every row.

    Tokens are words. A prefix ends with the document that reaches the budget, so a leaf exceeds its target by less
    than one document; documents without words come along if they lie in the prefix. A null level value is the value
    "(none)"; null doc_ids and repeated rows share one place in the order and stay together. A leaf without tokens has
    target and copies 0, as has one of weight 0; empty tables give no rows. Other columns are ignored.
    """
    rows = counted(docs.select("doc_id", "text", "lang", "source"), domain, mix)
    return rows.select("doc_id", *(F.col(f"__{c}").alias(c) for c in (*LEVELS, "n_tokens", "target", "copies")))


def draw(docs: DataFrame, domain: Column, mix: Mix) -> DataFrame:
    """The mix itself: rows of `docs` with its own columns, each as often as its copies say."""
    rows = counted(docs, domain, mix).filter("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)
