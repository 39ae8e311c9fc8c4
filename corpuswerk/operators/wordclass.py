"""Word classes by vote of three taggers, entity spans, noun chunks and the entity vocabulary.

Token columns: sid, ix, word, lemma, pos (fine tags), posTT, posUDS, posTI, ner, iob, ixNP. Defined
cases: null tags vote for nothing; a token no tagger places is a NOUN; a span opens at B only, an I
without an open span belongs to none; null words are empty in a span; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuswerk.functions.text import is_good_word
from corpuswerk.plans.storage import materialized

CLASSES = ["NOUN", "ADJ", "VERB", "ADV", "DET", "FM", "TRUNC", "PTKNEG", "OTHER"]
#: Votes of the fine tagger, the second tagger and the parser.
VOTES = (1.0, 1.0, 3.0)
IN_ENTITY = 3.5
# Fixed values, by class: beginning of the fine tag, or parts of it; tags of the second tagger, a star for any
# ending; universal tags; tags of the parser.
TAGS = {
    "NOUN": (("^N",), ("NE", "NN"), ("NOUN", "PROPN"), ()),
    "ADJ": (("^ADJ",), ("ADJ*",), ("ADJ",), ()),
    "VERB": (("^V",), ("V*",), ("VERB", "AUX"), ()),
    "ADV": (("^ADV",), ("ADV",), ("ADV",), ()),
    "DET": (("Pro", "Attr"), ("PDAT", "PIAT", "PWAT", "PPER", "PRF", "PRELAT", "PPOSAT"), ("DET", "ADP"), ()),
    "FM": (("FM",), ("FM",), (), ("FM",)),
    "TRUNC": (("TRUNC",), ("TRUNC",), (), ("TRUNC",)),
    "PTKNEG": (("PTKNEG",), ("PTKNEG",), (), ("PTKNEG",)),
    "OTHER": (("PTKNEG",), ("PTKNEG",), ("PUNCT", "NUM", "SPACE", "PART", "PRON", "INTJ", "CONJ", "SCONJ"), ("XY",)),
}


def _vote(condition: Column, weight: float) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), weight).otherwise(0.0)


def class_scores(pos: str = "pos", second: str = "posTT", universal: str = "posUDS", tag: str = "posTI", in_entity: Column | None = None) -> Column:
    """array<double> of the votes for each class."""
    fine, coarse, parser = VOTES
    scores = []
    for name in CLASSES:
        begins, tags, universals, parsers = TAGS[name]
        rf = F.lit(True)
        for part in begins:
            rf = rf & (F.startswith(F.col(pos), F.lit(part[1:])) if part[0] == "^" else F.contains(F.col(pos), F.lit(part)))
        tt = F.col(second).isin([t for t in tags if t[-1] != "*"])
        for t in tags:
            tt = tt | F.startswith(F.col(second), F.lit(t[:-1])) if t[-1] == "*" else tt
        score = _vote(rf, fine) + _vote(tt, coarse)
        if universals:
            score = score + _vote(F.col(universal).isin(list(universals)), parser)
        if parsers:
            score = score + _vote(F.col(tag).isin(list(parsers)), parser)
        scores.append(score)
    voted = F.array(*scores)
    if in_entity is None:
        return voted
    return F.when(in_entity, F.array(F.lit(IN_ENTITY), *[F.lit(0.0)] * (len(CLASSES) - 1))).otherwise(voted)


def best_class(scores: str | Column) -> Column:
    """The first class with the most votes."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    at = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES]), at)


def with_spans(tokens: DataFrame) -> DataFrame:
    """Adds span, the ix of the token that opens the entity a token belongs to, else null."""
    order = Window.partitionBy("sid").orderBy("ix")
    # A span reaches from its B over the I that follow; the last token that is no I decides whether one is open.
    opener = F.last(F.when(~F.coalesce(F.col("iob") == "I", F.lit(False)), F.struct("ix", (F.col("iob") == "B").alias("is_b"))), ignorenulls=True).over(order)
    return tokens.withColumn("opener", opener).withColumn("span", F.when(F.col("iob").isin("B", "I") & F.col("opener.is_b"), F.col("opener.ix"))).drop("opener")


def entity_spans(tokens: DataFrame) -> DataFrame:
    """(sid, ix, etype, entity): each span with the type of its first token and its words."""
    inside = with_spans(tokens).filter("span is not null")
    words = F.sort_array(F.collect_list(F.struct("ix", F.coalesce("word", F.lit("")).alias("word"))))
    out = inside.groupBy("sid", "span").agg(F.min(F.struct("ix", "ner")).alias("first"), words.alias("words"))
    return out.select("sid", F.col("span").alias("ix"), F.col("first.ner").alias("etype"), F.array_join("words.word", " ").alias("entity"))


def classified(tokens: DataFrame) -> DataFrame:
    """Adds span, wclass, good (a good word, or inside of an entity) and ent_id, the first reading of the lemma."""
    spans = with_spans(tokens)
    scores = class_scores(in_entity=F.col("span").isNotNull())
    good = F.coalesce(is_good_word("word"), F.lit(False)) | F.col("span").isNotNull()
    return spans.withColumns({"wclass": best_class(scores), "good": good, "ent_id": first_lemma()})


def lemma_readings(lemma: str = "lemma", word: str = "word") -> Column:
    """All readings of a lemma, lower-cased; the word where there is none."""
    own = F.btrim(F.lower(lemma))
    return F.split(F.when(own.isNull() | own.isin("", "<unknown>"), F.lower(F.coalesce(word, F.lit("")))).otherwise(own), r"\|")


def first_lemma(lemma: str = "lemma", word: str = "word") -> Column:
    return lemma_readings(lemma, word)[0]


def noun_chunks(tokens: DataFrame, keep_last: bool = True) -> DataFrame:
    """(sid, first_ix, np, words): runs of good words of one chunk number; a good word outside of chunks closes one.

    keep_last False leaves out the chunk still open at the end of a sentence.
    """
    good = classified(tokens).filter("good")
    order = Window.partitionBy("sid").orderBy("ix")
    changed = ~F.coalesce(F.lag("ixNP").over(order) == F.col("ixNP"), F.lag("ixNP").over(order).isNull() & F.col("ixNP").isNull() & F.lag("ix").over(order).isNotNull())
    chunk = F.sum(F.when(changed, 1).otherwise(0)).over(order)
    runs = good.withColumn("changed", changed).withColumn("run", chunk).withColumn("last_run", F.max("run").over(Window.partitionBy("sid"))).filter("ixNP is not null and not isnan(ixNP)")
    if not keep_last:
        runs = runs.filter("run < last_run")
    words = F.sort_array(F.collect_list(F.struct("ix", "ent_id")))
    return runs.groupBy("sid", "run", "ixNP").agg(F.min("ix").alias("first_ix"), words.alias("w")).select("sid", "first_ix", F.col("ixNP").alias("np"), F.array_join("w.ent_id", " ").alias("words"))


def span_counts(tokens: DataFrame) -> DataFrame:
    """(entity, PER, LOC, ORG, MISC): how often each surface form is of each type."""
    kinds = ["PER", "LOC", "ORG", "MISC"]
    counts = [F.count(F.when(F.col("etype") == k, 1)).alias(k) for k in kinds]
    return entity_spans(tokens).groupBy("entity").agg(*counts)


def entity_vocabulary(tokens: DataFrame) -> DataFrame:
    """(entity, ent_id, freq): lemma readings and entity spans, numbered densely from 0 by first appearance.

    Tokens outside of spans count under every reading of their lemma, spans once under their words.
    Only the distinct entities are numbered: in ranges of first appearance, so that no task holds all of them.
    """
    outside = with_spans(tokens).filter("span is null").select("sid", "ix", F.posexplode(lemma_readings()).alias("part", "entity"))
    spans = entity_spans(tokens).select("sid", "ix", F.lit(0).alias("part"), F.col("entity"))
    seen = outside.unionByName(spans).filter("entity <> ''").groupBy("entity").agg(F.min(F.struct("sid", "ix", "part")).alias("first"), F.count("*").alias("freq"))
    return dense_ids(seen, ["first", "entity"], "ent_id").select("entity", "ent_id", "freq")


def dense_ids(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Numbers rows densely from 0 in an order: sorted into ranges, counted by range, numbered within each."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("range", F.shiftright("at", 33)).withColumn("within", F.col("at").bitwiseAND((1 << 33) - 1))
    ranged = materialized(ranged.drop("at"), "ranges")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))  # a row a partition
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))
    return ranged.join(F.broadcast(before.select("range", F.coalesce("before", F.lit(0)).alias("before"))), "range").withColumn(name, F.col("before") + F.col("within")).drop("range", "within", "before")


def space_before(lines: DataFrame, order: list[str], keys: list[str], glue: Column) -> DataFrame:
    """Drops glue marks; each token says whether a blank follows it (none where a mark does)."""
    ahead = F.lead(F.when(glue, True)).over(Window.partitionBy(*keys).orderBy(*order))
    return lines.withColumn("space_after", ~F.coalesce(ahead, F.lit(False))).filter(~glue)


def negated_verbs(tokens: DataFrame) -> DataFrame:
    """(sid, ix) of verbs with a negation among their dependents."""
    t = classified(tokens)
    negations = t.filter("dep = 'ng'").select("sid", F.col("ixDEP").alias("ix"))
    return t.filter("wclass = 'VERB' and good").select("sid", "ix").join(negations, ["sid", "ix"], "left_semi")


def dependent_spans(tokens: DataFrame, dep: str, wclass: str) -> DataFrame:
    """(sid, ix, from_ix, to_ix): heads of a class with the dependents of a kind that stand next to them, without a gap."""
    t = classified(tokens).select("sid", "ix", "ixDEP", "dep", "wclass")
    heads = t.filter(F.col("wclass") == wclass).select("sid", F.col("ix").alias("head"))
    own = t.filter(F.col("dep") == dep).select("sid", "ix", F.col("ixDEP").alias("head")).join(heads, ["sid", "head"], "left_semi")
    left, right = F.col("ix") < F.col("head"), F.col("ix") > F.col("head")
    near = Window.partitionBy("sid", "head", left)
    rank = F.when(left, F.col("head") - F.col("ix")).otherwise(F.col("ix") - F.col("head"))
    own = own.withColumn("gap", rank - F.row_number().over(near.orderBy(rank))).filter("gap = 0")
    edge = own.groupBy("sid", "head").agg(F.min(F.when(left, F.col("ix"))).alias("a"), F.max(F.when(right, F.col("ix"))).alias("b"))
    return heads.join(edge, ["sid", "head"], "left").select("sid", F.col("head").alias("ix"), F.coalesce("a", "head").alias("from_ix"), F.coalesce("b", "head").alias("to_ix"))
