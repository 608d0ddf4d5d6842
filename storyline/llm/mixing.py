"""Temperature mixing of sources to target weights.

Each source's share of the tokens is raised to an exponent between 0 and 1, and the shares are normalised again: 1 keeps the corpus as it is,
0 makes all sources equal. The exponent is bisected to the smallest one at which the weights' entropy is no more than the target and no source
is repeated more often than the limit. Sources are then realised as budgeted block permutations: each pass over a source is a permutation of its
documents of its own, the last pass ends where the source's share of the budget does, and every source's sequence is dealt over the same
blocks, so that each block has the sources in their weights.

Only sums by source or by bucket of a source meet in one task. A pass over a source is dealt into buckets by its permutation, so that the running
sums of a source that holds a third of all rows are taken in many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, let, put_back, set_apart


@dataclass(frozen=True)
class Mix:
    """What the weights must keep to, and how they are realised.

    entropy: the target, as a part of the entropy of equal weights (0 to 1); with None only the limit holds.
    max_repeats: passes over a source at most. budget: tokens of the result; with None, as many as let every source be read once.
    blocks: blocks of the result. bucket_docs: documents in a bucket of a permutation, about.
    """

    entropy: float | None = None
    max_repeats: float = 2.0
    budget: float | None = None
    blocks: int = 64
    bucket_docs: int = 2000
    seed: int = 11


#: Midpoints looked at in one pass over the sources (as many as six halvings would need), and passes.
GRID, PASSES = 63, 5
#: Cuts of all sources that are broadcast at most, some 30 bytes each; beyond them the texts are joined with them by source.
BROADCAST_CUTS = 100_000


def source_tokens(docs: DataFrame, source_col: str = "source", tokens: Column | None = None) -> DataFrame:
    """(source, n_docs, n_tokens); a source of null is one of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"), F.sum(tokens if tokens is not None else F.lit(1)).cast("long").alias("n_tokens"))


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The bisected exponent. Sources stay distributed; each pass brings a few sums for GRID exponents to the driver.

    Both the entropy of the weights and the most repeated source fall as the exponent grows, so the smallest exponent that keeps to the target
    is the one sought. Sources without tokens have no say. One means the corpus as it is, which always keeps to a limit of one.
    """
    held = sources.where("n_tokens > 0").select(F.col("n_tokens").cast("double").alias("t"))
    low, high = 0.0, 1.0
    total, least, most, n = held.agg(F.sum("t"), F.min("t"), F.max("t"), F.count("*")).first()
    if not n:
        return 1.0
    for _ in range(PASSES):
        grid = [low + (high - low) * (k + 1) / (GRID + 1) for k in range(GRID)]
        sums = held.agg(*[f for a in grid for f in (F.sum(F.pow(F.col("t") / total, F.lit(a))), F.sum(F.pow(F.col("t") / total, F.lit(a)) * F.log(F.col("t") / total)))]).first()
        fits = [keeps(a, sums[2 * k], sums[2 * k + 1], total, least, most, n, mix) for k, a in enumerate(grid)]
        k = fits.index(True) if True in fits else GRID
        low, high = (grid[k - 1] if k else low), (grid[k] if k < GRID else high)
    return high


def keeps(a: float, z: float, zlog: float, total: float, least: float, most: float, n: int, mix: Mix) -> bool:
    """Whether exponent ``a`` keeps to the mix. z, zlog: sums over sources of p**a and of p**a * log p, where p is a source's share."""
    from math import log

    entropy = log(z) - a * zlog / z
    passes = (mix.budget or smallest_budget(a, z, total, most)) * (least / total) ** a / z / least
    return (mix.entropy is None or n < 2 or entropy <= mix.entropy * log(n) + 1e-12) and passes <= mix.max_repeats * (1 + 1e-12)


def smallest_budget(a: float, z: float, total: float, most: float) -> float:
    """Tokens at which even the largest source, which is repeated least, is read once."""
    return most * z / (most / total) ** a


def weights(sources: DataFrame, mix: Mix | None = None) -> DataFrame:
    """(source, n_docs, n_tokens, weight, quota, passes): quota in tokens; passes: how often the source is read."""
    mix = mix or Mix()
    a = exponent(sources, mix)
    held = sources.where("n_tokens > 0")
    total, most = held.agg(F.sum("n_tokens").cast("double"), F.max("n_tokens").cast("double")).first()
    raw = F.pow(F.col("n_tokens") / F.lit(total or 1.0), F.lit(a))
    z = held.agg(F.sum(raw)).first()[0] or 1.0
    budget = mix.budget or smallest_budget(a, z, total or 1.0, most or 1.0)
    out = held.withColumn("weight", raw / F.lit(z)).withColumn("quota", F.col("weight") * F.lit(budget))
    # The passes that the budget gives, but for rounding, which must not add or take a document.
    return out.withColumn("passes", F.round(F.least(F.col("quota") / F.col("n_tokens"), F.lit(mix.max_repeats)), 9))


def plan(thin: DataFrame, weighed: DataFrame, mix: Mix) -> DataFrame:
    """(source, passes, cuts): cuts are struct<pass, block, key>, the least key of each block of each pass; block ``mix.blocks`` is left out.

    A document's place is that of the tokens of its source before it, of all smaller keys of its pass and of the passes before; a block holds the
    same part of each source's quota. thin: (source, id, tokens).
    """
    own = thin.alias("t").join(weighed.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source"))).select("t.source", "id", "tokens", "n_docs", "n_tokens", "passes")
    own = own.withColumn("pass", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes").cast("int"), F.lit(1)) - 1)))
    own = own.withColumn("key", key(F.col("id"), F.col("pass"), mix.seed))
    n = F.ceil(F.col("n_docs") / mix.bucket_docs)
    own = own.withColumn("bucket", F.floor(F.col("key") / F.lit(float(1 << 63)) * n))
    sums = own.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("n"))
    earlier = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "pass", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    on = F.col("o.source").eqNullSafe(F.col("f.source")) & (F.col("o.pass") == F.col("f.pass")) & (F.col("o.bucket") == F.col("f.bucket"))
    own = own.alias("o").join(offsets.alias("f"), on).select("o.*", "offset")
    # Documents of equal keys, which are of equal ids, have the same place.
    smaller = Window.partitionBy("source", "pass", "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, -1)
    place = F.col("pass") * F.col("n_tokens") + F.col("offset") + F.coalesce(F.sum("tokens").over(smaller), F.lit(0))
    part = place / (F.col("passes") * F.col("n_tokens"))
    block = F.when(part < 1, F.floor(part * mix.blocks)).otherwise(mix.blocks).cast("int")
    cuts = own.select("source", "passes", "pass", block.alias("block"), "key").groupBy("source", "passes", "pass", "block").agg(F.min("key").alias("key"))
    return cuts.groupBy("source", "passes").agg(F.sort_array(F.collect_list(F.struct("pass", "block", "key"))).alias("cuts"))


def key(id_: Column, pass_: Column, seed: int) -> Column:
    """Where a document stands in a pass's permutation: 63 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), pass_, id_), 1)


#: Columns that a mix adds.
ADDED = ["mix_pass", "mix_block", "mix_order", "mix_tokens"]


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, mix: Mix | None = None) -> DataFrame:
    """``docs`` repeated or cut to the weights, with mix_pass, mix_block, mix_order and mix_tokens; columns of these names are replaced.

    Blocks are read in order, and documents in a block by mix_order, a hash. Each source's cuts say which of its documents are in which block; few
    enough of them are broadcast, so that texts aren't shuffled. Documents of a source without tokens come once, in block 0. Null sources are one
    source; null and repeated ids take part, all documents of an id in the same place. A null number of tokens is none. A document longer than a block's
    share is in the block in which it starts. Other columns stay as they are, whatever their names. No rows: no rows.
    """
    mix = mix or Mix()
    size = F.coalesce((tokens if tokens is not None else F.lit(1)).cast("long"), F.lit(0).cast("long"))
    own = docs.select("*", size)  # before the columns lose their names
    own = own.toDF(*[f"_{k}" for k in range(len(docs.columns))], "tokens")
    _, i, s = set_apart(docs, id_col, source_col)
    thin = checkpointed(own.select(F.col(s).alias("source"), F.col(i).alias("id"), "tokens"))
    sources = checkpointed(source_tokens(thin, "source", F.col("tokens")))
    cuts = checkpointed(plan(thin, weights(sources, mix), mix))
    if (cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0) <= BROADCAST_CUTS:
        cuts = F.broadcast(cuts)
    out = own.join(cuts, F.col(s).eqNullSafe(F.col("source")), "left")
    last = F.greatest(F.coalesce(F.ceil("passes").cast("int"), F.lit(1)), F.lit(1)) - 1
    out = out.select(*own.columns, "cuts", F.explode(F.sequence(F.lit(0), last)).alias("pass"))
    out = out.withColumn("key", key(F.col(i), F.col("pass"), mix.seed))
    mine = let(F.col("key"), lambda k: F.array_max(F.transform(F.filter("cuts", lambda x: (x["pass"] == F.col("pass")) & (x["key"] <= k)), lambda x: x["block"])))
    out = out.withColumn("block", F.coalesce(mine, F.lit(0))).where(F.col("block") < mix.blocks)
    order = F.xxhash64(F.lit(mix.seed), F.lit("block"), F.col("pass"), F.col(i))
    return put_back(out, docs, **dict(zip(ADDED, (F.col("pass"), F.col("block"), order, F.col("tokens")), strict=True)))
