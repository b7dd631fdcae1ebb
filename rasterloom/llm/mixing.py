"""Mixing sources to target weights: hierarchical budgeting, DataFrame functions only.

Documents hang below a tree of domain, language and source. A token budget
runs down the tree by the weights of its nodes. A node that can't use its
share (its documents, repeated at most ``max_epochs`` times, have fewer
tokens) gives the rest to its siblings by their weights; only what the
siblings can't use either goes back to the parent's siblings. Each leaf then
takes whole epochs of its documents in a seeded order, and of the last epoch
the prefix whose tokens fit into what is left of its budget.

The prefix is found in two steps so that no task orders a whole leaf: tokens
are summed by leaf and by the first hexadecimal digits of the order's hash;
only the one bucket in which a leaf's budget ends is ordered by document. What
the plan says of a leaf reaches its documents by broadcast up to
``BROADCAST_LEAVES`` leaves, which are counted first, else by a salted join.

Defined results: null texts have no tokens and are in every epoch that is
reached; a null language or source is the node ``?``; weights default to 1 and
weights of absent nodes are ignored; a budget beyond all capacity takes all
epochs; repeated rows count as often as they occur, those with one id and text
are taken or left together; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.llm.common import text_or_empty, written

#: Leaves (rows of the plan, some hundred bytes each) that may be broadcast; beyond it rows are dealt by leaf and ``SALTS`` parts of it.
BROADCAST_LEAVES, SALTS = 1 << 16, 64
WORD = r"[^\x09-\x0D\x20]+"


def domain_of(source: Column) -> Column:
    """The supplied tables have no domain: sources go to four domains by their number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    return F.concat(F.lit("domain"), F.when(number == "", F.lit("?")).otherwise((number.cast("decimal(38,0)") % 4).cast("string")))


def tree_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with the tree's ``__domain, __language, __leaf`` and ``__tokens``."""
    return docs.withColumns(
        {
            "__domain": domain_of(F.col("source")),
            "__language": F.coalesce(F.col("lang"), F.lit("?")),
            "__leaf": F.coalesce(F.col("source"), F.lit("?")),
            "__tokens": F.regexp_count(text_or_empty("text"), F.lit(WORD)).cast("long"),
        }
    )


def _weight(names: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])
    return F.coalesce(table[names], F.lit(1.0))


def share(nodes: DataFrame, parents: list[str], node: str, weights: dict[str, float]) -> DataFrame:
    """Divide each parent's ``budget`` among its nodes by weight, none above its ``cap``.

    Nodes are taken by rising cap a weight: the first j fill up where their
    cap is below the even level of what is left for them and the later ones.
    The level is where that ends, so no step is repeated.
    """
    w = W.partitionBy(*parents).orderBy("ratio", node) if parents else W.partitionBy(F.lit(0)).orderBy("ratio", node)
    upto = w.rowsBetween(W.unboundedPreceding, -1)
    onward = w.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        nodes.withColumn("weight", _weight(F.col(node), weights))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        # the first node that doesn't fill up has the highest level of those that don't
        .withColumn("level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(whole))
        .withColumn("given", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("level")))
        .drop("budget", "weight", "ratio", "level")
        .withColumnRenamed("given", "budget")
    )


def budgets(docs: DataFrame, budget: float | None, fraction: float, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """``__domain, __language, __leaf, tokens, epochs, rest``: what each leaf takes.

    ``epochs`` whole passes over the leaf's documents and ``rest`` tokens of
    the next. ``docs`` has the columns of ``tree_columns``. One row a leaf.
    """
    leaves = docs.groupBy(*PATH).agg(F.sum("__tokens").alias("tokens")).withColumn("cap", (F.col("tokens") * max_epochs).cast("double"))
    total = F.sum("tokens").over(W.partitionBy(F.lit(0)))
    leaves = leaves.withColumn("target", F.lit(float(budget)) if budget is not None else F.floor(total * fraction).cast("double"))
    domains = leaves.groupBy("__domain").agg(F.sum("cap").alias("cap"), F.max("target").alias("budget"))
    domains = share(domains, [], "__domain", weights.get("domain", {}))
    languages = leaves.groupBy("__domain", "__language").agg(F.sum("cap").alias("cap")).join(domains.select("__domain", "budget"), "__domain")
    languages = share(languages, ["__domain"], "__language", weights.get("language", {}))
    sources = leaves.drop("target").join(languages.select("__domain", "__language", "budget"), ["__domain", "__language"])
    sources = share(sources, ["__domain", "__language"], "__leaf", weights.get("source", {}))
    # a share is rounded down to whole tokens; the small addition keeps sums in floating point from losing one
    taken = F.least(F.floor(F.col("budget") + 1e-3), F.col("tokens") * max_epochs).cast("long")
    epochs = F.when(F.col("tokens") > 0, (taken / F.greatest(F.col("tokens"), F.lit(1))).cast("long")).otherwise(F.lit(max_epochs).cast("long"))
    return sources.withColumn("epochs", epochs).select(*PATH, "tokens", "epochs", (taken - F.col("epochs") * F.col("tokens")).alias("rest"))


PATH = ["__domain", "__language", "__leaf"]


def _by_leaf(rows: DataFrame, leaves: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their leaf: broadcast if there are few, else dealt so that no task has a whole leaf."""
    if few:
        return rows.join(F.broadcast(leaves), PATH, how)
    salted = leaves.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*PATH, "__salt"], how).drop("__salt")


def decide(docs: DataFrame, *, budget: float | None = None, fraction: float = 0.5, max_epochs: int = 4, weights: dict[str, dict[str, float]] | None = None, seed: int = 17, id_col: str = "doc_id", digits: int = 3) -> DataFrame:
    """``id_col, __domain, __language, __leaf, __tokens, __times``: how often each row is taken.

    The texts are read once; what the later steps need of them (ids, places
    and counts) is written to the shared folder. ``digits`` sets 16**digits
    buckets of a leaf's order.
    """
    weights = weights or {}
    if any(not w > 0 for level in weights.values() for w in level.values()):
        raise ValueError("weights must be positive")
    rows = written(tree_columns(docs).select(id_col, *PATH, "__tokens"), "mixing")
    plan = written(budgets(rows, budget, fraction, max_epochs, weights).select(*PATH, "epochs", "rest"), "plan")
    few = plan.count() <= BROADCAST_LEAVES
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("?"))))
    keyed = _by_leaf(rows, plan, few).withColumn("__place", place).withColumn("__bucket", F.substring("__place", 1, digits))
    sums = keyed.filter("rest > 0").groupBy(*PATH, "__bucket").agg(F.sum("__tokens").alias("held"), F.max("rest").alias("rest"))
    upto = W.partitionBy(*PATH).orderBy("__bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumn("reached", F.sum("held").over(upto))
    # the first bucket that doesn't fit whole, and what is left for it
    last = sums.filter(F.col("reached") > F.col("rest")).groupBy(*PATH).agg(F.min("__bucket").alias("__last"), F.min_by(F.col("rest") - F.col("reached") + F.col("held"), "__bucket").alias("__left"))
    keyed = _by_leaf(keyed, last, few, "left")
    here = F.coalesce(F.col("__bucket") == F.col("__last"), F.lit(False))
    run = W.partitionBy(*PATH, "__bucket").orderBy("__place")  # ties are taken together
    inside = keyed.filter(here).withColumn("__fits", F.sum("__tokens").over(run) <= F.col("__left"))
    fits = (F.col("rest") > 0) & (F.col("__last").isNull() | (F.col("__bucket") < F.col("__last")))
    outside = keyed.filter(~here).withColumn("__fits", fits)
    taken = outside.unionByName(inside).withColumn("__times", F.col("epochs") + F.col("__fits").cast("long"))
    return taken.filter("__times > 0").select(id_col, *PATH, "__tokens", "__times")


def epochs(decisions: DataFrame) -> DataFrame:
    """A row for each epoch: ``mix_epoch`` counts from 0."""
    return decisions.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1))).drop("__times")


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with a row for each epoch in which a document is taken; adds ``mix_epoch``.

    Options are those of ``decide``: ``budget`` in tokens, else ``fraction``
    of the table's tokens; ``max_epochs``; ``weights`` with the maps
    ``domain``, ``language`` and ``source``; ``seed``.
    """
    chosen = decide(docs, id_col=id_col, **options).select(F.col(id_col).alias("__id"), *PATH, "__times").distinct()
    rows = tree_columns(docs).drop("__tokens")
    same = rows[id_col].eqNullSafe(chosen["__id"])
    for c in PATH:
        same = same & (rows[c] == chosen[c])
    return epochs(rows.join(chosen, same).select(*[rows[c] for c in docs.columns], "__times"))
