"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a domain - language - source tree by weight. What a
node can't fill goes to its siblings first, in proportion to their weights, and
to the siblings of its ancestors only once its own are full: every node gets
``min(capacity, level * weight)`` with the one level among siblings that spends
their parent's budget. A leaf takes whole seeded epochs of its documents and
then a prefix of the next one, the longest whose tokens fit what is left.

Only sums by leaf, and by leaf and a 4096th of the hash range, are aggregated,
and documents are then kept by comparison with their leaf's last included hash:
texts are never shuffled, and a hot leaf has no task of its own.

Defined cases: names that the tree doesn't list, nulls included, share one
``(other)`` child of their parent; null and empty texts have no tokens and come
with any epoch whose prefix reaches their hash; rows that share an id come
together or not at all; extra columns of any name pass through in row; no rows give no rows. Rows
with a null id order first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_row

OTHER = "(other)"
#: Hexadecimal digits of the hash by which sums are taken before the exact cut.
DIGITS = 3
LEAF = ["domain", "language", "origin"]


@dataclass
class MixTree:
    """Weights of domains, of languages in each domain and of sources in each language; sources belong to domains."""

    domain_weights: dict[str, float]
    domain_sources: dict[str, list[str]]
    language_weights: dict[str, float]
    source_weights: dict[str, float] = field(default_factory=dict)
    other_weight: float = 0.05

    def domain(self, source: Column) -> Column:
        out = F.lit(OTHER)
        for name, sources in self.domain_sources.items():
            out = F.when(source.isin(sources), F.lit(name)).otherwise(out)
        return out

    def leaf(self, lang: Column, source: Column) -> list[Column]:
        listed = [s for sources in self.domain_sources.values() for s in sources]
        return [
            self.domain(source).alias("domain"),
            F.when(lang.isin(list(self.language_weights)), lang).otherwise(OTHER).alias("language"),
            F.when(source.isin(listed), source).otherwise(OTHER).alias("origin"),
        ]

    def weight(self, path: tuple[str, ...]) -> float:
        name = path[-1]
        if name == OTHER:
            return self.other_weight
        return [self.domain_weights, self.language_weights, self.source_weights][len(path) - 1].get(name, 1.0)


def fill(budget: float, children: dict[str, tuple[float, float]]) -> dict[str, float]:
    """children: weight and capacity. Each gets min(capacity, level * weight); the sum is the budget, if they hold it."""
    order = sorted(children, key=lambda k: (children[k][1] / children[k][0], k))
    left, weight, out = budget, sum(w for w, _ in children.values()), {}
    for i, k in enumerate(order):
        w, capacity = children[k]
        if capacity > left / weight * w:
            return out | {j: left / weight * children[j][0] for j in order[i:]}
        out[k] = capacity
        left, weight = left - capacity, weight - w
    return out


def leaf_budgets(tokens: dict[tuple[str, str, str], int], tree: MixTree, budget: float, max_epochs: int) -> dict[tuple[str, str, str], int]:
    """Whole tokens for each leaf."""
    capacity: dict[tuple[str, ...], float] = {}
    for leaf, n in tokens.items():
        for depth in range(4):
            capacity[leaf[:depth]] = capacity.get(leaf[:depth], 0) + n * max_epochs
    given: dict[tuple[str, ...], float] = {(): min(budget, capacity.get((), 0))}
    for depth in range(3):
        for node in [p for p in given if len(p) == depth]:
            children = {p[-1]: (tree.weight(p), c) for p, c in capacity.items() if len(p) == depth + 1 and p[:-1] == node}
            given |= {(*node, k): v for k, v in fill(given[node], children).items()}
    return {p: int(v + 1e-6) for p, v in given.items() if len(p) == 3}


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+"))


def draw(doc_id: Column, seed: int, epoch: Column) -> Column:
    """The document's place in an epoch's order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed)), epoch.cast("string")))


def mix_sources(docs: DataFrame, tree: MixTree, budget_share: float, max_epochs: int, seed: int) -> DataFrame:
    """The rows of docs (doc_id, text, lang, source, ...) that the mix takes, once for each epoch that takes them.

    Returns row (a struct of all columns of docs), domain, language, origin, n_tokens and epoch. The budget is
    budget_share of all tokens.
    """
    spark = docs.sparkSession
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *tree.leaf(F.col("lang"), F.col("source")), n_words(F.col("text")).cast("long").alias("n_tokens"))
    narrow = rows.select("doc_id", *LEAF, "n_tokens")
    totals = {(r["domain"], r["language"], r["origin"]): r["n"] for r in narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("n")).collect()}
    budgets = leaf_budgets(totals, tree, budget_share * sum(totals.values()), max_epochs)
    plan = [(*leaf, *(divmod(budgets[leaf], n) if n else (max_epochs, 0))) for leaf, n in totals.items()]
    leaves = spark.createDataFrame(plan, "domain string, language string, origin string, epochs long, rest long")
    # the epoch taken in part: sums by leaf and the hash's first digits, then exactly within the digits that the cut falls into
    placed = narrow.join(F.broadcast(leaves), LEAF).withColumn("place", draw(F.col("doc_id"), seed, F.col("epochs"))).withColumn("head", F.left("place", F.lit(DIGITS)))
    sums = placed.groupBy(*LEAF, "head", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEAF).orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sums.withColumn("upto", F.sum("n").over(upto))
    cut = running.filter("upto > rest").groupBy(*LEAF).agg(F.min_by(F.struct("head", (F.col("upto") - F.col("n")).alias("before")), "head").alias("cut"))
    cuts = [(*(r[k] for k in LEAF), r["cut"]["head"], r["cut"]["before"]) for r in cut.collect()]
    at = spark.createDataFrame(cuts, "domain string, language string, origin string, head string, before long")
    within = Window.partitionBy(*LEAF).orderBy("place", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.join(F.broadcast(at), [*LEAF, "head"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    last = {tuple(r[k] for k in LEAF): r["last"] for r in inside.filter("upto <= rest").groupBy(*LEAF).agg(F.max("place").alias("last")).collect()}
    heads = {tuple(c[:3]): c[3] for c in cuts}
    # what follows is compared with the leaf's last place; "g" follows every digit, and a head alone precedes all that begin with it
    ends = [(*p[:3], p[3], last.get(p[:3], heads.get(p[:3], "g"))) for p in plan]
    chosen = spark.createDataFrame(ends, "domain string, language string, origin string, epochs long, last string")
    taken = rows.join(F.broadcast(chosen), LEAF)
    partial = (F.col("epochs") < max_epochs) & (draw(F.col("doc_id"), seed, F.col("epochs")) <= F.col("last"))
    copies = F.col("epochs") + partial.cast("long")
    return taken.withColumn("epoch", F.explode(F.slice(F.array(*(F.lit(e) for e in range(max_epochs))), F.lit(1), copies.cast("int")))).select("row", *LEAF, "n_tokens", "epoch")
