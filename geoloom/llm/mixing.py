"""Mixing sources to target weights.

Weights are tempered: source i gets w_i(a) proportional to n_i * (t_i / n_i) ** a, where n_i is its share of all
tokens and t_i its target; a = 1 is the target, a = 0 the sizes as they are. The exponent is found by bisection as
the largest in [0, 1] at which no source is used more often than its repetition limit (or at which the weights reach
a wanted entropy). Without a wanted size the mix is as large as the limits allow at a = 1, so the target shares are
met; the bisection then confirms 1 at that size. Weights are realised as whole passes over a source and one last pass
cut where the budget ends, in the order of a hash of (seed, document): the permutation is cut into blocks, blocks are
summed up in parallel, and only the block in which the budget ends is looked at row by row. The order of the mix
deals each source's passes, each permuted by itself, evenly over all of it, in blocks of nearly equal make-up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.tokens import VOCABULARY, tokenizer
from geoloom.util import materialise, spread

MAX_SOURCES = 100_000
ROWS_PER_BLOCK = 4096
GRID = 256  # steps of the exponent at which the bisection starts


def count_tokens(docs: DataFrame, id_col: str, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """`id_col`, the columns `keep` and `n_tokens` of each row; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = tokenizer(path).count
        for batch in batches:
            out = batch[[id_col, *keep]].copy()
            out["n_tokens"] = [count(t) if t else 0 for t in batch[text]]
            yield out

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [id_col, *keep]) + ", n_tokens bigint"
    return docs.select(id_col, *keep, text).mapInPandas(run, schema)


def tempered(sizes: dict[str, int], targets: dict[str, float], a: float) -> dict[str, float]:
    total = sum(sizes.values())
    raw = {s: (n / total) * (targets[s] / (n / total)) ** a for s, n in sizes.items()}
    norm = sum(raw.values())
    return {s: w / norm for s, w in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def solve_exponent(sizes: dict[str, int], targets: dict[str, float], repeats: dict[str, int], size: float | None, want_entropy: float | None) -> tuple[float, float]:
    """(exponent, tokens of the mix)."""
    cap = {s: sizes[s] * repeats[s] for s in sizes}

    def largest(a: float) -> float:
        w = tempered(sizes, targets, a)
        return min(cap[s] / w[s] for s in sizes if w[s] > 0)

    if want_entropy is not None:
        low, high = 0.0, 1.0
        rising = entropy(tempered(sizes, targets, 1.0)) > entropy(tempered(sizes, targets, 0.0))
        for _ in range(60):
            mid = (low + high) / 2
            below = entropy(tempered(sizes, targets, mid)) < want_entropy
            low, high = (mid, high) if below == rising else (low, mid)
        a = (low + high) / 2
        return a, min(size or math.inf, largest(a))
    size = largest(1.0) if size is None else size
    # The limits may hold on several stretches of the exponent; the one nearest to the targets is bisected.
    grid = [k / GRID for k in range(GRID, -1, -1)]
    low = next((a for a in grid if largest(a) >= size), None)
    if low is None:
        low = max(grid, key=largest)
        return low, largest(low)
    high = min(1.0, low + 1 / GRID)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if largest(mid) >= size else (low, mid)
    return low, size


class Mix:
    """The result: `documents` (one row per document used), `shares` (one row per source) and `order` (one row per use:
    source, doc_id, n_tokens, copy, block, place; the mix is read by block and place)."""

    def __init__(self, documents: DataFrame, order: DataFrame, shares: DataFrame, exponent: float, size: float):
        self.documents, self.order, self.shares, self.exponent, self.size = documents, order, shares, exponent, size


def _unit(seed: int, *cols) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _dealt(documents: DataFrame, seed: int) -> DataFrame:
    """One row per use with its place: a source's passes follow one another, evenly over the mix. Each pass has a
    permutation of its own; the last one is that in which its budget was cut."""
    uses = documents.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    within = F.when(F.col("copy") > F.col("passes"), F.col("key")).otherwise(_unit(seed, "copy", "source", "doc_id"))
    at = F.least((F.col("copy") - 1 + within) / F.col("span"), F.lit(1 - 1e-12))
    total = documents.agg(F.sum("copies")).first()[0] or 0
    uses = uses.withColumn("at", at).withColumn("block", F.floor(F.col("at") * max(1, math.ceil(total / ROWS_PER_BLOCK))).cast("int"))
    place = F.row_number().over(W.partitionBy("block").orderBy("at", "source", "doc_id", "copy"))
    return uses.select("source", "doc_id", "n_tokens", "copy", "block", place.alias("place"))


def mix_sources(docs: DataFrame, targets: DataFrame, *, size: float | None = None, want_entropy: float | None = None, seed: int = 17, path: str = VOCABULARY) -> Mix:
    """A mix of `docs` (doc_id, source, text) with the shares of `targets` (source, target_share, max_repeats).

    A document is used `copies` times, at most its source's `max_repeats`. Sources without a target or with share or
    limit 0, and documents without a source, are not used; targets of sources without tokens cannot be met, are
    reported with share 0, and the others keep their proportions. Each source's tokens differ from its budget by at
    most half of one document. Repeated doc_ids are separate documents; documents without tokens are never used. The
    result depends on the seed, not on the order of the input. Nothing usable gives an empty mix.
    """
    spark = docs.sparkSession
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    if (n := wanted.count()) > MAX_SOURCES:
        raise ValueError(f"{n} sources exceed {MAX_SOURCES}")
    rows = {r.source: r for r in wanted.collect()}
    used = spread(docs.select("doc_id", "source", "text")).join(wanted.select("source"), "source", "left_semi")
    counted = materialise(count_tokens(used, "doc_id", "text", ["source"], path).where("n_tokens > 0"))
    totals = {r.source: (r.tokens, r.n) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    sizes = {s: t for s, (t, _) in totals.items()}
    if sizes:
        share = sum(rows[s].target_share for s in sizes)
        goal = {s: rows[s].target_share / share for s in sizes}
        exponent, tokens = solve_exponent(sizes, goal, {s: rows[s].max_repeats for s in sizes}, size, want_entropy)
        weights = tempered(sizes, goal, exponent)
    else:
        exponent, tokens, weights = 1.0, 0.0, {}
    plan = []
    for s, (total, n) in totals.items():
        budget = min(weights[s] * tokens, float(total * rows[s].max_repeats))
        passes = min(int(budget // total), rows[s].max_repeats)
        rest = 0.0 if passes == rows[s].max_repeats else budget - passes * total
        plan.append((s, passes, rest, total, max(1, math.ceil(n / ROWS_PER_BLOCK))))
    plan_df = spark.createDataFrame(plan, "source string, passes int, rest double, total bigint, blocks int")

    # One permutation per source; (block, key) is its order.
    placed = counted.join(F.broadcast(plan_df), "source").withColumn("key", _unit(seed, "source", "doc_id"))  # one row per source, counted above
    placed = placed.withColumn("block", F.floor(F.col("key") * F.col("blocks")).cast("int"))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    # Sums before each block: the block table is one row per 4,096 documents, and its sums are taken in two levels.
    blocks = blocks.withColumn("group", F.floor(F.col("block") / 1024))
    groups = blocks.groupBy("source", "group").agg(F.sum("size").alias("gsize"))
    groups = groups.withColumn("gbefore", F.coalesce(F.sum("gsize").over(W.partitionBy("source").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = W.partitionBy("source", "group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = blocks.withColumn("bbefore", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(groups, ["source", "group"])
    before = before.select("source", "block", (F.col("gbefore") + F.col("bbefore")).alias("before"), "size")
    placed = placed.join(before, ["source", "block"])
    whole = (F.col("before") + F.col("size")) <= F.col("rest")
    cut = ~whole & (F.col("before") < F.col("rest"))
    row = W.partitionBy("source", "block").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    ends = placed.where(cut).withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(row), F.lit(0)))
    # A document belongs to the last pass if at least half of it fits.
    ends = ends.withColumn("extra", F.when(F.col("at") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)).drop("at")
    rest = placed.where(~cut).withColumn("extra", F.when(whole, 1).otherwise(0))
    copies = (F.col("passes") + F.col("extra")).cast("int")
    span = F.col("passes") + F.col("rest") / F.col("total")
    documents = materialise(ends.unionByName(rest).select("source", "doc_id", "n_tokens", copies.alias("copies"), "passes", "key", span.alias("span")).where("copies > 0"))
    order = _dealt(documents, seed)
    documents = documents.drop("passes", "key", "span")

    actual = documents.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").cast("int").alias("most_copies")
    )
    all_tokens = documents.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] or 1
    report = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    weight_df = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "source string, weight double")
    shares = report.join(actual, "source", "left").join(weight_df, "source", "left")
    shares = shares.select(
        "source", "target_share", "max_repeats", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.col("tokens") / F.lit(float(all_tokens)), F.lit(0.0)).alias("actual_share"),
    )
    return Mix(documents, order, shares, exponent, tokens)
