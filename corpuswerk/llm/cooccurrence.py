"""Items that appear together: pair counts and how far they exceed chance.

Items are made distinct per basket, ordered pairs are emitted by an equi-join of the baskets with
themselves and combined map-side; lift and pointwise mutual information come from the marginals.
A basket of more than BLOCK_ITEMS items is cut into blocks of items: the join key of its pairs is the
pair of blocks, so that no task holds all pairs of a large basket. Each pair is still met once.

Defined cases: null items or baskets don't count; repeated items of a basket count once; a basket
of one item counts for N and the marginals and has no pair; ties need no order, every pair that
meets the thresholds is returned; very long items are items as they stand; extra columns are
ignored; an empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswerk.plans.storage import materialized

BLOCK_ITEMS = 1000


def _plain_pairs(held: DataFrame) -> DataFrame:
    a, b = held.select("basket", F.col("item").alias("term_a")), held.select("basket", F.col("item").alias("term_b"))
    return a.join(b, "basket").filter("term_a < term_b").select("term_a", "term_b")


def _block_pairs(held: DataFrame, sizes: DataFrame, block_items: int) -> DataFrame:
    """Pairs of large baskets: an item goes to the keys of its block with every block of the basket."""
    blocks = F.ceil(F.col("n") / block_items).cast("int")
    own = held.join(sizes, "basket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    # In a pair of blocks (lo, hi) a comes from lo, b from hi; within one block both come from it.
    lo = own.select("basket", F.col("block").alias("lo"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("hi"), F.col("item").alias("a"))
    hi = own.select("basket", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("lo"), F.col("block").alias("hi"), F.col("item").alias("b"))
    both = lo.join(hi, ["basket", "lo", "hi"]).filter("lo < hi or a < b")
    return both.select(F.least("a", "b").alias("term_a"), F.greatest("a", "b").alias("term_b"))


def pair_counts(baskets: DataFrame, basket: str, item: str, min_count: int = 1, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(term_a, term_b, n_ab, n_a, n_b, n, lift, pmi) of all pairs found in at least min_count baskets."""
    held = baskets.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()
    held = materialized(held, "baskets")
    sizes = materialized(held.groupBy("basket").agg(F.count("*").alias("n")), "basket_sizes")
    n, largest = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    counts = held.groupBy("item").agg(F.count("*").alias("n"))
    if largest > block_items:
        large = sizes.filter(F.col("n") > block_items)
        pairs = _plain_pairs(held.join(large, "basket", "left_anti")).unionByName(_block_pairs(held, large, block_items))
    else:
        pairs = _plain_pairs(held)
    pairs = pairs.groupBy("term_a", "term_b").agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= min_count)
    pairs = pairs.join(counts.select(F.col("item").alias("term_a"), F.col("n").alias("n_a")), "term_a")
    pairs = pairs.join(counts.select(F.col("item").alias("term_b"), F.col("n").alias("n_b")), "term_b")
    lift = F.col("n_ab").cast("double") * n / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.select("term_a", "term_b", "n_ab", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"), lift.alias("lift"), F.log2(lift).alias("pmi"))


def above_chance(pairs: DataFrame, factor: int) -> DataFrame:
    """Pairs found at least factor times as often as chance has it, in exact whole numbers."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.filter(wide("n_ab") * wide("n") >= wide("n_a") * wide("n_b") * F.lit(factor).cast("decimal(4,0)"))
