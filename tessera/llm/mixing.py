"""Operator 1, mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

Domains hold languages, languages hold sources. The budget of tokens flows down this tree: a node shares its own
among its children by weight, and a child gets at most what its leaves can give in ``MAX_EPOCHS`` epochs. What a
child can't use goes to its siblings by weight, and only what a whole subtree can't use goes to the siblings of its
root: since a node's own share is already capped by its subtree, shortages are settled among siblings before
ancestors. Shares are integers, rounded down.

A leaf with budget b and t tokens gives b div t whole epochs and then a prefix of one more, whose order is that of
md5(seed:epoch:doc_id). The prefix ends with the document that reaches the budget. Its end is found by descent: the
tokens of 256 ranges of the order, then of 256 ranges within the one that holds the end, until few documents are
left; no leaf is ever sorted whole or gathered. Documents then only compare their place with their leaf's end.

Tokens are runs of anything but ASCII white space. Edge cases: a null domain, language or source is a value of its
own (of weight 1 where none is stated); null and empty texts have no tokens and come with whole epochs only, or where
the prefix reaches past them; documents with the same doc_id, or none, stand at one place and are taken together; a
leaf without tokens, or of weight 0, gives nothing; an empty table gives an empty result. Other columns are kept;
columns that this operator adds get underscores in front where the input has their names.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, stored, words_of

#: Target weights of the production mix; what isn't named has weight 1.
WEIGHTS: dict[str, dict[str, float]] = {"domain": {"web": 5, "reference": 3, "forum": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {}}
#: Sources of each domain; any other source is of domain "other".
DOMAINS: dict[str, list[str]] = {
    "web": [f"src{i}" for i in range(10)],
    "reference": [f"src{i}" for i in range(10, 15)],
    "forum": [f"src{i}" for i in range(15, 20)],
}
#: Budget in percent of the corpus' tokens; epochs that a leaf gives at most; seed of the orders.
BUDGET_PERCENT, MAX_EPOCHS, SEED = 100, 4, 17
#: Hex digits that the descent takes at once; documents of a range at which it ends.
STEP, FEW = 2, 2000
#: Leaves whose ends are sent to every executor at most (some 100 bytes each).
BROADCAST_LEAVES = 100_000

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column, domains: dict[str, list[str]] = DOMAINS) -> Column:
    out = F.lit("other")
    for domain, sources in domains.items():
        out = F.when(source.isin(sources), F.lit(domain)).otherwise(out)
    return F.when(source.isNull(), F.lit("other")).otherwise(out)


def whole_weights(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """A level's weights as integers in the same ratios, and what weight 1 then is. Read as decimals: 0.1 is 1/10."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    one = math.lcm(*(w.denominator for w in exact.values()))
    whole = {k: int(w * one) for k, w in exact.items()}
    if min(whole.values(), default=0) < 0 or max(whole.values(), default=0) >= 10**9 or one >= 10**9:
        raise ValueError("weights must not be negative, and of fewer than ten digits as integers in their ratios")
    return whole, one


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    whole, one = whole_weights(weights.get(level, {}))
    out = F.lit(one)
    for value, weight in whole.items():
        out = F.when(F.col(level) == value, F.lit(weight)).otherwise(out)
    return out.cast("decimal(38,0)")


def share(children: DataFrame, parent: list[str], level: str, weights: dict[str, dict[str, float]]) -> DataFrame:
    """Replaces ``budget``, the parent's, by the child's: by weight, at most ``cap``, shortages to the siblings.

    In order of cap per weight the children that reach their cap come first, so one window finds them.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rows = children.withColumn("_w", _weight(level, weights))
    place = F.when(F.col("_w") > 0, F.col("cap").cast("double") / F.col("_w").cast("double")).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy(place, F.col(level).asc_nulls_first())
    before, siblings = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    left = wide("budget") - F.coalesce(F.sum(wide("cap")).over(before), F.lit(0))
    weight = F.sum("_w").over(siblings) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    rows = rows.withColumn("_full", wide("cap") * weight <= left * F.col("_w"))
    spent = F.coalesce(F.sum(F.when(F.col("_full"), wide("cap"))).over(siblings), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(siblings)
    rows = rows.withColumns({"_left": (wide("budget") - spent).cast("decimal(38,0)"), "_open": open_weight.cast("decimal(38,0)")})
    part = F.when(F.col("_open") > 0, F.expr("(cast(_left as decimal(20,0)) * cast(_w as decimal(9,0))) div _open")).otherwise(F.lit(0))
    return rows.withColumn("budget", F.when(F.col("_full"), F.col("cap")).otherwise(F.least(part, F.col("cap"))).cast("bigint")).drop("_w", "_full", "_left", "_open")


def leaf_budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, float]] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens) with each leaf's ``budget``."""
    of_leaf = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    languages = of_leaf.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domains = languages.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("budget", F.lit(budget).cast("bigint")).withColumn("_root", F.lit(0))
    domains = share(domains, ["_root"], "domain", weights).select("domain", "budget")
    languages = share(_under(languages, domains, ["domain"]), ["domain"], "lang", weights).select("domain", "lang", "budget")
    return share(_under(of_leaf, languages, ["domain", "lang"]), ["domain", "lang"], "source", weights)


def _under(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children with their parent's budget; null keys meet."""
    parents = parents.select(*(F.col(k).alias(f"_{k}") for k in keys), "budget")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return children.join(parents, on).drop(*(f"_{k}" for k in keys))


def _on_leaf(prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in LEVELS]


def place_of(doc_id: Column, epoch: Column, seed: int) -> Column:
    """A document's place in an epoch's order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def prefix_ends(places: DataFrame, leaves: DataFrame, step: int = STEP, few: int = FEW) -> DataFrame:
    """(domain, lang, source, end): the last place of each leaf's prefix of ``rest`` tokens.

    ``places``: leaf, place, tokens; ``leaves``: leaf, rest, at least 1 and at most the leaf's tokens, and docs.
    """
    keys = [f"_{c}" for c in LEVELS]
    to = leaves.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), "rest", F.lit("").alias("range"))
    most, depth, rows = leaves.agg(F.max("docs").alias("n")).first()["n"] or 0, 0, places
    while most > few and depth + step <= 30:
        rows = stored(rows.join(_small(to), _on_leaf("_") + [F.col("place").startswith(F.col("range"))]).select(*LEVELS, "place", "tokens", "rest"), "mix-range")
        depth += step
        sums = rows.groupBy(*LEVELS, "rest", F.substring("place", 1, depth).alias("range")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
        to = stored(_reaching(sums, "range").select(*(F.col(c).alias(f"_{c}") for c in LEVELS), (F.col("rest") - F.col("before")).alias("rest"), "range", "docs"), "mix-ends")
        most = to.agg(F.max("docs").alias("n")).first()["n"] or 0
        rows = rows.drop("rest")
        to = to.drop("docs")
    last = rows.join(_small(to), _on_leaf("_") + [F.col("place").startswith(F.col("range"))]).groupBy(*LEVELS, "rest", "place").agg(F.sum("tokens").alias("tokens"))
    return _reaching(last, "place").select(*LEVELS, F.col("place").alias("end")).drop(*keys)


def _reaching(sums: DataFrame, by: str) -> DataFrame:
    """Of each leaf, the row at which the running sum of tokens in order of ``by`` reaches ``rest``; adds ``before``."""
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy(by))
    out = sums.withColumn("_upto", upto).withColumn("before", F.col("_upto") - F.col("tokens"))
    return out.filter((F.col("before") < F.col("rest")) & (F.col("_upto") >= F.col("rest"))).drop("_upto")


def _small(leaves: DataFrame) -> DataFrame:
    """A table of leaves, to be broadcast if it has few rows."""
    return F.broadcast(leaves) if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else leaves


def mix(
    documents: DataFrame,
    weights: dict[str, dict[str, float]] = WEIGHTS,
    domains: dict[str, list[str]] = DOMAINS,
    budget_percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """``documents`` (doc_id, text, lang, source, ...) once for each epoch that takes them, with domain, n_tokens, epoch."""
    leaf = {"domain": domain_of(F.col("source"), domains), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string")}
    counted = documents.select(F.col("doc_id").alias("_doc"), *(c.alias(k) for k, c in leaf.items()), F.size(words_of(F.col("text"))).cast("bigint").alias("tokens"))
    counted = stored(counted, "mix-counted")
    leaves = counted.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = stored(leaves, "mix-leaves")
    budget = (leaves.agg(F.sum("tokens").alias("n")).first()["n"] or 0) * budget_percent // 100
    budgets = leaf_budgets(leaves, budget, weights, max_epochs)
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0))
    budgets = stored(budgets.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).select(*LEVELS, "docs", "epochs", "rest"), "mix-budgets")
    partial = budgets.filter(F.col("rest") > 0)
    of_doc = partial.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), "epochs")
    places = counted.join(_small(of_doc), _on_leaf("_")).select(*LEVELS, place_of(F.col("_doc"), F.col("epochs"), seed).alias("place"), "tokens")
    ends = stored(prefix_ends(places, partial.select(*LEVELS, "rest", "docs")), "mix-prefixes").select(*(F.col(c).alias(f"_{c}") for c in LEVELS), "end")
    tag = "_take"
    while any(c.lower().startswith(tag) for c in documents.columns):
        tag = f"_{tag}"
    given = {c: f"{tag}_{c}" for c in (*LEVELS, "epochs", "end", "copies")}
    some = budgets.filter((F.col("epochs") > 0) | (F.col("rest") > 0)).join(ends, _on_leaf("_"), "left")
    takes = some.select(*(F.col(c).alias(given[c]) for c in (*LEVELS, "epochs", "end")))
    takes = stored(takes, "mix-takes")

    names = {"domain": free_name(documents, "domain"), "n_tokens": free_name(documents, "n_tokens"), "epoch": free_name(documents, "epoch")}
    on = [leaf[c].eqNullSafe(F.col(given[c])) for c in LEVELS]
    epochs, end = F.col(given["epochs"]), F.col(given["end"])
    copies = epochs + F.when(end.isNotNull() & (place_of(F.col("doc_id"), epochs, seed) <= end), 1).otherwise(0)
    taken = documents.join(_small(takes), on).withColumn(given["copies"], copies).filter(F.col(given["copies"]) > 0)
    taken = taken.withColumns({names["domain"]: F.col(given["domain"]), names["n_tokens"]: F.size(words_of(F.col("text"))).cast("bigint")})
    return taken.withColumn(names["epoch"], F.explode(F.sequence(F.lit(0), F.col(given["copies"]) - 1))).drop(*given.values())
