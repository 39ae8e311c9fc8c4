"""Subject-verb-object triples of dependency trees, and what is asked of them.

Tokens are those of wordclass.classified. Defined cases: a verb without a subject or an object gives
no triple; conjuncts of conjuncts count; repeated triples of a sentence are one row in `distinct`
form; lists of triples may be empty or null; ties in a neighbourhood are settled by the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswerk.plans.storage import materialized

# Relations of subjects and of objects to their verb.
SUBJECTS = ["sb", "ph", "sbp", "sp", "ep"]
OBJECTS = ["nmc", "mo", "nk", "mnr", "oa", "da", "oa2", "op", "og", "oc"]
CONJUNCT = "cj"


def children(tokens: DataFrame, side: str | None = None) -> DataFrame:
    """(sid, head, ix): dependents of each token, those to its left or right only where asked."""
    out = tokens.filter("ixDEP > 0").select("sid", F.col("ixDEP").alias("head"), "ix")
    return {"left": out.filter("ix < head"), "right": out.filter("ix > head")}.get(side, out)


def _arguments(tokens: DataFrame, verbs: DataFrame, relations: list[str]) -> DataFrame:
    """(sid, verb_ix, ix, ent_id) of the nouns in one of the relations to a verb, with their conjuncts, of any depth."""
    nouns = tokens.filter("wclass = 'NOUN'").select("sid", "ix", "ixDEP", "dep", "good", "ent_id")
    direct = nouns.filter(F.col("dep").isin(relations) & F.col("good")).join(verbs, (nouns["sid"] == verbs["v_sid"]) & (nouns["ixDEP"] == verbs["verb_ix"]))
    found = frontier = direct.select("sid", "verb_ix", "ix", "ent_id", "good")
    joined = nouns.filter((F.col("dep") == CONJUNCT) & (F.col("ix") > F.col("ixDEP"))).select("sid", F.col("ixDEP").alias("of"), F.col("ix").alias("next"), F.col("ent_id").alias("next_ent"), F.col("good").alias("next_good"))
    if joined.isEmpty():
        return found.drop("good")
    while True:  # as often as the longest chain of conjuncts is long
        step = frontier.filter("good").withColumnRenamed("ix", "of").join(joined, ["sid", "of"])
        frontier = materialized(step.select("sid", "verb_ix", F.col("next").alias("ix"), F.col("next_ent").alias("ent_id"), F.col("next_good").alias("good")), "conjuncts")
        if frontier.isEmpty():
            return found.drop("good")
        found = found.unionByName(frontier)


def triples(tokens: DataFrame) -> DataFrame:
    """(sid, verb_ix, subj, verb, obj) of every subject with every object of a verb.

    The columns it needs are written once; verbs, arguments and conjuncts are all joined from there.
    """
    tokens = materialized(tokens.filter("wclass in ('VERB', 'NOUN')").select("sid", "ix", "ixDEP", "dep", "wclass", "good", "ent_id"), "svo_tokens")
    verbs = tokens.filter("wclass = 'VERB' and good").select(F.col("sid").alias("v_sid"), F.col("ix").alias("verb_ix"), F.col("ent_id").alias("verb"))
    subj = _arguments(tokens, verbs, SUBJECTS).select("sid", "verb_ix", F.col("ent_id").alias("subj"))
    obj = _arguments(tokens, verbs, OBJECTS).select("sid", "verb_ix", F.col("ent_id").alias("obj"))
    both = subj.join(obj, ["sid", "verb_ix"])
    return both.join(verbs.withColumnRenamed("v_sid", "sid"), ["sid", "verb_ix"]).select("sid", "verb_ix", "subj", "verb", "obj")


def as_lists(found: DataFrame) -> DataFrame:
    """(verb, subj, obj) with the distinct subjects and objects of a verb as sorted lists."""
    lists = found.groupBy("sid", "verb_ix", "verb").agg(F.sort_array(F.collect_set("subj")).alias("subj"), F.sort_array(F.collect_set("obj")).alias("obj"))
    return lists.select("verb", "subj", "obj")


def _in(words: str, selection: str | Column) -> Column:
    return F.coalesce(F.array_contains(words, selection), F.lit(False))


def lookup(triplets: DataFrame, words: DataFrame) -> DataFrame:
    """(word, other, whole): for each of words and each triplet that names it the first of the other list; where both name it the whole triplet.

    Triplets are exploded to their nouns and joined, so that many words are looked up in one pass.
    """
    keyed = triplets.withColumn("word", F.explode(F.array_distinct(F.concat("subj", "obj")))).join(words.select("word").distinct(), "word")
    in_s, in_o = _in("subj", F.col("word")), _in("obj", F.col("word"))
    other = F.when(in_s & ~in_o, F.get("obj", F.lit(0))).when(in_o & ~in_s, F.get("subj", F.lit(0)))
    whole = F.when(in_s & in_o, F.concat_ws(";", "verb", F.array_join("subj", ","), F.array_join("obj", ",")))
    return keyed.select("word", other.alias("other"), whole.alias("whole"))


def partners(triplets: DataFrame, word: str) -> DataFrame:
    """(other): of triplets that name the word, the first subject if the word is the first object, else the first object."""
    hit = triplets.filter(_in("subj", F.lit(word)) | _in("obj", F.lit(word)))
    return hit.select(F.when(F.get("obj", F.lit(0)) == word, F.get("subj", F.lit(0))).otherwise(F.get("obj", F.lit(0))).alias("other"))


def pair_partners(pairs: DataFrame, word: str) -> DataFrame:
    """(other) of (subj, obj) pairs that name the word."""
    return pairs.filter((F.col("subj") == word) | (F.col("obj") == word)).select(F.when(F.col("obj") == word, F.col("subj")).otherwise(F.col("obj")).alias("other"))


def with_polarity(triplets: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds polarity POS, NEG or NEUT of the verb; lexicon: (word, kind); positive goes first."""
    polar = lexicon.filter("kind in ('POS', 'NEG')").groupBy(F.col("word").alias("verb")).agg(F.max("kind").alias("polarity"))
    return triplets.join(polar, "verb", "left").withColumn("polarity", F.coalesce("polarity", F.lit("NEUT")))


def subject_object_pairs(triplets: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(polarity, subj, obj) of the first subject and object of each triplet."""
    return with_polarity(triplets, lexicon).select("polarity", F.get("subj", F.lit(0)).alias("subj"), F.get("obj", F.lit(0)).alias("obj"))


def split_by_polarity(triplets: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Triplets with a polar verb; the others are left out."""
    return with_polarity(triplets, lexicon).filter("polarity <> 'NEUT'")


def neutral_verbs(triplets: DataFrame, words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(verb, n): verbs outside of the lexicon of triplets that name one of words; a triplet counts once a word it names."""
    keyed = triplets.join(lexicon.select(F.col("word").alias("verb")).distinct(), "verb", "left_anti")
    keyed = keyed.withColumn("word", F.explode(F.array_distinct(F.concat("subj", "obj")))).join(words.select("word").distinct(), "word", "left_semi")
    return keyed.groupBy("verb").agg(F.count("*").alias("n"))


def neighbourhood(pairs: DataFrame, start: list[str], depth: int) -> DataFrame:
    """(node, neighbour, n): breadth-first from the start words over (subj, obj) pairs, depth levels of nodes.

    Nodes are visited by level and, within a level, by word (start words in their given order); a node's
    neighbours are those not visited before it and not itself. Each level is a join and one written table.
    """
    spark = pairs.sparkSession
    both = pairs.filter("subj is not null and obj is not null")
    both = both.select(F.col("subj").alias("node"), F.col("obj").alias("other")).union(both.filter("subj <> obj").select("obj", "subj"))
    edges = materialized(both.groupBy("node", "other").agg(F.count("*").alias("n")), "svo_edges")
    seeds = list(dict.fromkeys(start))
    ranks = spark.createDataFrame([(w, 0, k) for k, w in enumerate(seeds)], "node string, level int, place int")
    frontier, visited, out = ranks, ranks, None
    for level in range(depth):
        order = visited.select(F.col("node").alias("other"), F.struct("level", "place", "node").alias("other_rank"))
        here = edges.join(frontier, "node").join(order, "other", "left")
        later = F.col("other_rank").isNull() | (F.col("other_rank") > F.struct("level", "place", "node"))
        found = materialized(here.filter(later).select("node", F.col("other").alias("neighbour"), "n"), "svo_level")
        out = found if out is None else out.unionByName(found)
        if level + 1 == depth:
            break
        fresh = found.select(F.col("neighbour").alias("node")).distinct().join(visited, "node", "left_anti")
        frontier = materialized(fresh.select("node", F.lit(level + 1).alias("level"), F.lit(0).alias("place")), "svo_frontier")
        visited = visited.unionByName(frontier)
    return out
