"""Mixing sources to target weights by hierarchical budgeting.

A domain - language - source tree gets a token budget. Each node hands its budget to its
children in proportion to their weights, none more than it can give (its supply times the
epochs allowed); what a child cannot take goes to its siblings, and only what a whole
subtree cannot take goes to the siblings of its parent. Budgets are whole tokens: the
remainder of the division goes to the largest fractions. A leaf with budget b and supply s
repeats b div s whole epochs and takes the token-prefix of b mod s tokens of one more, in an
order seeded anew for each epoch. The document on the border gives only its first tokens, so
every leaf takes its budget to the token.

The tree is a small aggregate of the documents and stays distributed. The border of a prefix
is found without sorting a leaf: token sums of hash buckets locate the bucket where it lies,
and only that bucket is ordered, equal rows counted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import WHITE, materialize, text_of

LEVELS = ["domain", "lang", "source"]
#: Target weights; a name that is not listed weighs 1.
WEIGHTS = {
    "domain": {"tier0": 4.0, "tier1": 3.0, "tier2": 2.0, "tier3": 1.0},
    "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
    "source": {},
}
BUCKETS = 4096


def tier_of_source() -> Column:
    """The default domain: sources fall in four tiers by the number at the end of their name."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS bigint)")
    return F.coalesce(F.concat(F.lit("tier"), F.pmod(number, F.lit(4)).cast("string")), F.lit("other"))


def count_words(text: Column) -> Column:
    """Tokens for the budget: runs without white space."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, f"[{WHITE}]+"))).cast("long")


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    listed = weights.get(level, {})
    known = F.create_map(*(F.lit(x) for kv in listed.items() for x in kv)) if listed else F.create_map().cast("map<string,double>")
    return F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.col(level))), F.lit(0)), F.lit(1.0))


def share_out(children: DataFrame, parents: list[str], level: str) -> DataFrame:
    """budget for each child: parent_budget by weight, no child above its capacity.

    The children of a parent are ordered by capacity over weight. Those at the front are
    filled; the first that need not be sets the rate for itself and all after it. Their
    shares are cut to whole tokens, and the tokens left go one each to the largest fractions,
    names deciding ties.
    """
    key = [F.col(p) for p in parents] or [F.lit(0)]
    group = Window.partitionBy(*key)
    ordered = group.orderBy("ratio", level)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    after = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = children.withColumn("ratio", F.col("capacity") / F.col("weight"))
    rated = ranked.withColumn("rate", (F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(after))
    rated = rated.withColumn("cut", F.min(F.when(F.col("ratio") > F.col("rate"), F.struct("ratio", level, "rate"))).over(group))
    filled = F.col("cut").isNull() | (F.struct("ratio", level) < F.struct("cut.ratio", f"cut.{level}"))
    exact = F.when(filled, F.col("capacity").cast("double")).otherwise(F.greatest(F.col("cut.rate") * F.col("weight"), F.lit(0.0)))
    shared = rated.withColumn("exact", exact).withColumn("budget", F.least("capacity", F.floor("exact")).cast("long"))
    left = F.least(F.first("parent_budget").over(group), F.sum("capacity").over(group)) - F.sum("budget").over(group)
    roomy = F.col("budget") < F.col("capacity")
    nth = F.row_number().over(group.orderBy((~roomy).cast("int"), (F.floor("exact") - F.col("exact")), level))
    shared = shared.withColumns({"left": left, "nth": nth})
    return shared.withColumn("budget", F.col("budget") + (roomy & (F.col("nth") <= F.col("left"))).cast("long")).drop("ratio", "rate", "cut", "exact", "left", "nth")


def leaf_budgets(leaves: DataFrame, weights, budget: int | None, share: float, max_epochs: int) -> DataFrame:
    """(domain, lang, source, supply, budget, epochs, rest) for each leaf that weighs more than 0."""
    supply = leaves.agg(F.sum("supply")).first()[0] or 0  # one row
    total = budget if budget is not None else int(supply * share)
    able = leaves.withColumn("capacity", F.col("supply") * max_epochs)
    for level in LEVELS:
        able = able.where(_weight(level, weights) > 0)
    granted = min(able.agg(F.sum("capacity")).first()[0] or 0, max(total, 0))
    shared = None
    for depth, level in enumerate(LEVELS):
        names = LEVELS[: depth + 1]
        nodes = able.groupBy(*names).agg(F.sum("capacity").alias("capacity"), F.sum("supply").alias("supply"))
        nodes = nodes.withColumn("weight", _weight(level, weights))
        joined = nodes.join(shared, names[:-1]) if depth else nodes.withColumn("parent_budget", F.lit(granted).cast("long"))
        shared = share_out(joined, names[:-1], level)
        if depth < 2:
            shared = shared.select(*names, F.col("budget").alias("parent_budget"))
    return shared.select(
        *LEVELS, "supply", "budget",
        F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(0).cast("long").alias("epochs"),
        F.when(F.col("supply") > 0, F.col("budget") % F.col("supply")).otherwise(0).cast("long").alias("rest"),
    )


def prefix_borders(placed: DataFrame) -> DataFrame:
    """(leaf, stop, n_tokens, m, left): the last rows of each leaf's partial epoch, and the tokens they give.

    placed has the leaf, place (its order in the epoch), n_tokens and rest. m equal rows stand
    at the border stop; they give the left tokens one after the other.
    """
    bucket = F.shiftright("place.h", 64 - (BUCKETS - 1).bit_length())
    some = placed.where("rest > 0 and n_tokens > 0").withColumn("bucket", bucket)
    sums = some.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    running = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("n"))
    ending = running.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest"))).select(*LEVELS, "bucket", "before")
    ending = materialize(ending, "ending")
    inside = some.join(ending, [*LEVELS, "bucket"]).groupBy(*LEVELS, "place", "n_tokens").agg(F.count("*").alias("m"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.col("before") + F.sum(F.col("n_tokens") * F.col("m")).over(Window.partitionBy(*LEVELS).orderBy("place"))
    reached = inside.withColumn("from", upto - F.col("n_tokens") * F.col("m"))
    border = reached.where((F.col("from") < F.col("rest")) & (F.col("from") + F.col("n_tokens") * F.col("m") >= F.col("rest")))
    return border.select(*LEVELS, F.col("place").alias("stop"), "n_tokens", "m", (F.col("rest") - F.col("from")).alias("left"))


def mix(
    docs: DataFrame,
    weights: dict[str, dict[str, float]] = WEIGHTS,
    budget: int | None = None,
    share: float = 0.8,
    max_epochs: int = 3,
    seed: int = 42,
    domain: Column | None = None,
    tokens: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """The selected rows of docs, one for each epoch that takes them.

    Columns: doc_id, domain, lang, source, n_tokens, epoch, from 0, and taken, the tokens that
    the epoch takes from the front of the row: n_tokens, or less for the last row of a partial
    epoch. budget is in tokens, by default share of all; leaves take min(budget, what leaves of
    a weight above 0 can give) exactly. With keep the columns named are returned instead, the
    last row of an epoch whole: a leaf is then over its budget by less than that row.

    Rows are ordered by a hash of seed, epoch, doc_id and text. Repeated rows tie; each counts,
    and with keep those at the border all stay. Null names are nodes called (null); a null text
    has no tokens; a null doc_id is ordered by the rest of its row. Texts of any length count
    whole. Columns of other names are not read and cannot clash. An empty table, or a budget
    of 0, gives an empty result.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(null)"))
    count = count_words(text_of()) if tokens is None else tokens
    tier = tier_of_source() if domain is None else domain
    kept = [F.struct(*keep).alias("kept_")] if keep else []
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_key"), F.coalesce(tier, F.lit("(null)")).alias("domain"),
        named("lang").alias("lang"), named("source").alias("source"), F.coalesce(count, F.lit(0)).cast("long").alias("n_tokens"), *kept,
    )
    counted = materialize(sized.drop("kept_"), "sizes")
    leaves = materialize(counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), "leaves")
    plan = materialize(leaf_budgets(leaves, weights, budget, share, max_epochs), "budgets").where("budget > 0").drop("supply", "budget")
    order = F.struct(F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"), F.col("text_key")).alias("h"), "doc_id", "text_key")
    border = materialize(prefix_borders(counted.join(plan, LEVELS).withColumn("place", order)), "borders")

    placed = (sized if keep else counted).join(plan, LEVELS).join(border.select(*LEVELS, "stop"), LEVELS, "left").withColumn("place", order)
    inside = F.coalesce((F.col("place") <= F.col("stop")) if keep else (F.col("place") < F.col("stop")), F.lit(False))
    copies = (F.col("epochs") + inside.cast("long")).cast("long")
    shown = placed.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    if keep:
        return shown.select("kept_.*")
    columns = ["doc_id", *LEVELS, "n_tokens", "epoch"]
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("m"), F.ceil(F.col("left") / F.col("n_tokens"))) - 1))
    last = border.join(plan, LEVELS).withColumn("i", step).select(
        F.col("stop.doc_id").alias("doc_id"), *LEVELS, "n_tokens", F.col("epochs").alias("epoch"),
        F.least(F.col("n_tokens"), F.col("left") - F.col("i") * F.col("n_tokens")).alias("taken"),
    )
    return shown.select(*columns, F.col("n_tokens").alias("taken")).unionByName(last)
