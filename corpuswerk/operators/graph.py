"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswerk.operators.wordclass import dense_ids
from corpuswerk.plans.storage import drop_path, fresh_path


def connected_components(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """(key, component): the smallest key that can be reached; edges have src and dst.

    Large-star and small-star rounds until no edge changes, so the rounds grow with the logarithm
    of the longest path. Each round is one written table. Nodes without an edge are components of
    their own; null ends and loops are passed over.
    """
    spark = edges.sparkSession
    keep = lambda df: (df.write.parquet(at := fresh_path(spark, "edges")), at)[1]
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u > v").distinct()
    schema, at, mark = pairs.schema, keep(pairs), None
    while True:
        pairs = spark.read.schema(schema).parquet(at)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
        # Large star: every larger neighbour of u goes to u's smallest neighbour. The smallest are found map-side first.
        both = pairs.union(pairs.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        linked = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, at = at, keep(linked.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        drop_path(spark, last)
    roots = pairs.select(F.col("u").alias(key), F.col("v").alias("component"))
    return nodes.select(key).join(roots, key, "left").select(key, F.coalesce("component", F.col(key)).alias("component"))


def large_components(nodes: DataFrame, edges: DataFrame, more_than: int, key: str = "node") -> DataFrame:
    """(key, component, size) of the components of more than so many nodes."""
    found = connected_components(nodes, edges, key)
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") > more_than)
    return found.join(sizes, "component").select(key, "component", "size")


def vertices(edges: DataFrame) -> DataFrame:
    """(node) of both ends of (src, dst)."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).filter("node is not null").distinct()


def numbered_vertices(edges: DataFrame) -> DataFrame:
    """(node, idx): vertices numbered densely from 0 in order of their name."""
    return dense_ids(vertices(edges), ["node"], "idx")


def parallel_edges(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """An edge of weight w as w rows (src, dst, n), n from 1."""
    return edges.filter(F.col(weight) > 0).select("src", "dst", F.explode(F.sequence(F.lit(1), F.col(weight).cast("int"))).alias("n"))


def clique_edges(items: DataFrame, group: list[str], place: str, item: str) -> DataFrame:
    """(src, dst, weight): pairs of the items of a group in their order, each item with itself too.

    An equi-join by group; groups are sentences or paragraphs, whose size doesn't grow with the corpus.
    """
    counted = items.filter(F.col(item).isNotNull()).select(*group, F.col(place).alias("p"), F.col(item).alias("w"))
    a, b = counted.select(*group, F.col("p").alias("pa"), F.col("w").alias("src")), counted.select(*group, F.col("p").alias("pb"), F.col("w").alias("dst"))
    return a.join(b, group).filter("pa <= pb").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def undirected(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """(src, dst, weight) with the smaller end first and parallel edges added up."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(weight).alias(weight))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength): edges at a node, a loop counting twice, and their weight."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def overview(edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, n_loops, total_weight, density."""
    n = vertices(edges).agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("n_loops"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total_weight"))
    both = n.join(e)  # one row each
    return both.withColumn("density", F.try_divide(2.0 * F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)))


def cut_off(edges: DataFrame, least_degree: int, least_weight: int) -> DataFrame:
    """Edges of a least weight between nodes of a least degree."""
    strong = degrees(edges).filter(F.col("degree") >= least_degree).select("node")
    out = edges.filter(F.col("weight") >= least_weight)
    return out.join(strong.withColumnRenamed("node", "src"), "src", "left_semi").join(strong.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by synchronous weighted label propagation.

    In a round each node takes the label of most weight among its neighbours and, with weight 1, its own;
    ties go to the smaller label. Rounds end when no label changes, or after so many. A modularity
    optimiser may cut elsewhere; labels are names of nodes.
    """
    spark = edges.sparkSession
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).toDF("node", "other", "weight").filter("node <> other")
    keep = lambda df: (df.write.parquet(at := fresh_path(spark, "labels")), spark.read.schema(df.schema).parquet(at))[1]
    both = keep(both)
    labels = keep(vertices(edges).select("node", F.col("node").alias("community")))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("other"), "community"), "other").select("node", "community", F.col("weight").cast("double").alias("weight"))
        votes = votes.unionByName(labels.select("node", "community", F.lit(1.0).alias("weight")))
        votes = votes.groupBy("node", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("b")).select("node", F.col("b.community").alias("community"))
        after = keep(best)
        same = after.join(labels.withColumnRenamed("community", "before"), "node").filter("community <> before").isEmpty()
        labels = after
        if same:
            break
    return labels


def between_communities(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(ca, cb, n_edges, weight): edges whose ends lie in different communities, by the communities of their ends."""
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    return edges.join(a, "src").join(b, "dst").filter("ca <> cb").groupBy("ca", "cb").agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))


def node_sizes(counts: DataFrame, factor: int = 70, base: int = 100) -> DataFrame:
    """(node, n, size) for drawing."""
    return counts.select("node", "n", (F.col("n") * factor + base).alias("size"))
