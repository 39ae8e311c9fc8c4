"""Networks of words and entities over documents and sentences.

A mention is a row (sid, doc_id, word, etype, wid, is_stop) of a word or entity in a sentence, with
etype one of NOUN, ADJ, VERB, ADVERB, PER, LOC, ORG, MISC; polarity and emotion of words are rows of
the same table with etype POS, NEG, NEUT or the emotion, and a valence (that of NEG is positive).

Weights count the pairs of mentions. Mentions are first counted by sentence and word, with partial
aggregation on the map side, so that a word said often in one sentence meets others once; what is
joined are sentences' distinct words. Defined cases: null words and sentences have no mention; two
mentions of a pair are never the same mention; ties of a best label go to the smaller label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Documents:
    """Which documents: inclusive dates (yyyymmdd) or one date, sources, and parts of the section's name, one of which it contains."""

    start: int | None = None
    end: int | None = None
    date: int | None = None
    sources: list[str] | None = None
    sections: list[str] | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        if self.start and self.end:
            out = out & F.col("date_int").between(self.start, self.end)
        elif self.date:
            out = out & (F.col("date_int") == self.date)
        if self.sources:
            out = out & F.col("docsrc").isin(self.sources)
        if self.sections:
            hit = F.lit(False)
            for s in self.sections:
                hit = hit | F.contains(F.col("section"), F.lit(s))
            out = out & hit
        return out


@dataclass(frozen=True)
class Network:
    """What is counted: kinds of the two ends, a centre (word of the first end), stop words, entities with an id only, weight beyond freq."""

    pos1: tuple[str, ...] = ("NOUN",)
    pos2: tuple[str, ...] = ("NOUN",)
    center: str | None = None
    stop_words: bool = False
    has_wid: bool = False
    freq: int = 10
    documents: Documents = field(default_factory=Documents)


def filtered(mentions: DataFrame, docs: DataFrame, which: Documents) -> DataFrame:
    """Mentions of the documents asked for; docs: (doc_id, date_int, docsrc, section)."""
    if which == Documents():
        return mentions
    return mentions.join(docs.filter(which.condition()).select("doc_id"), "doc_id", "left_semi")


def _usable(m: DataFrame, net: Network) -> DataFrame:
    out = m.filter("word is not null and sid is not null")
    if not net.stop_words:
        out = out.filter("not is_stop")
    if net.has_wid:
        out = out.filter("wid is not null or etype <> 'NOUN'")
    return out


def _ends(m: DataFrame, net: Network, unit: list[str]) -> DataFrame:
    """(unit, word, c1, c2, c12): mentions of a word that can be the first end, the second one, both."""
    one, two = F.col("etype").isin(list(net.pos1)), F.col("etype").isin(list(net.pos2))
    count = lambda c: F.count(F.when(c, 1))
    return _usable(m, net).filter(one | two).groupBy(*unit, "word").agg(count(one).alias("c1"), count(two).alias("c2"), count(one & two).alias("c12"))


def _pairs(ends: DataFrame, net: Network, on: list[str], differ: Column | None = None) -> DataFrame:
    a = ends.filter("c1 > 0").select(*on, *[c for c in ("unit_sid",) if c in ends.columns], F.col("word").alias("n1"), "c1", "c12")
    b = ends.filter("c2 > 0").select(*on, *[F.col(c).alias("other_sid") for c in ("unit_sid",) if c in ends.columns], F.col("word").alias("n2"), F.col("c2"))
    if net.center is not None:
        a = a.filter(F.col("n1") == net.center)
    both = a.join(b, on)
    if differ is not None:
        both = both.filter(differ)
    if net.pos1 == net.pos2:
        both = both.filter("n1 < n2")
    same = F.when(F.col("n1") == F.col("n2"), F.col("c12")).otherwise(0) if differ is None else F.lit(0)
    return both.withColumn("w", F.col("c1") * F.col("c2") - same).filter("w > 0")


def over(df: DataFrame, freq: int, weight: str = "weight") -> DataFrame:
    """Weights beyond freq; freq up to 1 lets all pass."""
    return df.filter(F.col(weight) > freq) if freq > 1 else df


def sentence_pairs(mentions: DataFrame, docs: DataFrame, net: Network) -> DataFrame:
    """(sid, n1, n2, w) of each sentence."""
    return _pairs(_ends(filtered(mentions, docs, net.documents), net, ["sid"]), net, ["sid"]).select("sid", "n1", "n2", "w")


def sentence_network(mentions: DataFrame, docs: DataFrame, net: Network) -> DataFrame:
    """(n1, n2, weight): pairs within a sentence."""
    out = sentence_pairs(mentions, docs, net).groupBy("n1", "n2").agg(F.sum("w").alias("weight"))
    return over(out, net.freq)


def paragraph_network(mentions: DataFrame, docs: DataFrame, net: Network, paragraph: list[str]) -> DataFrame:
    """(n1, n2, weight): pairs within a paragraph, of two different sentences.

    Counted as all pairs of the paragraph less those within one sentence: so each paragraph's words are
    joined once a word, not once a sentence.
    """
    m = filtered(mentions, docs, net.documents)
    free = lambda ends, on: _pairs(ends, net, on, F.lit(True)).groupBy("n1", "n2").agg(F.sum("w").alias("w"))
    whole = free(_ends(m, net, paragraph), paragraph)
    inside = free(_ends(m, net, [*paragraph, "sid"]), [*paragraph, "sid"]).withColumn("w", -F.col("w"))
    out = whole.unionByName(inside).groupBy("n1", "n2").agg(F.sum("w").alias("weight")).filter("weight > 0")
    return over(out, net.freq)


def occurrences(mentions: DataFrame, docs: DataFrame, net: Network) -> DataFrame:
    """(word, wid, weight): mentions of each word."""
    m = _usable(filtered(mentions, docs, net.documents), net).filter(F.col("etype").isin(list(net.pos1)))
    return over(m.groupBy("word", "wid").agg(F.count("*").alias("weight")), net.freq)


def sentence_frequency(mentions: DataFrame, docs: DataFrame, which: Documents, word: str | None = None, wid: str | None = None) -> DataFrame:
    """(n_sentences): sentences that mention a word or entity in any way."""
    m = filtered(mentions, docs, which)
    if word is not None:
        m = m.filter(F.col("word") == word)
    if wid is not None:
        m = m.filter(F.col("wid") == wid)
    return m.agg(F.count_distinct("sid").alias("n_sentences"))


def best_label(weighted: DataFrame, keys: list[str], label: str, weight: str = "weight") -> DataFrame:
    """The heaviest label of each key, the smaller one at a tie; by aggregation, without a sort."""
    top = F.min(F.struct((-F.col(weight)).alias("w"), F.col(label).alias("label"))).alias("top")
    return weighted.groupBy(*keys).agg(top).select(*keys, (-F.col("top.w")).alias(weight), F.col("top.label").alias(label))


def sentence_valence(mentions: DataFrame) -> DataFrame:
    """(sid, balance): sum of the valence of positive words less that of negative ones."""
    sign = F.when(F.col("etype") == "POS", F.coalesce("valence", F.lit(0.0))).otherwise(-F.coalesce("valence", F.lit(0.0)))
    return mentions.filter("etype in ('POS', 'NEG')").groupBy("sid").agg(F.round(F.sum(sign), 9).alias("balance"))


def sentiment_network(mentions: DataFrame, docs: DataFrame, net: Network) -> DataFrame:
    """(n1, n2, weight, valence): the label of most pairs, Positive, Negative or Neutral by the balance of their sentences."""
    pairs = sentence_pairs(mentions, docs, net).join(sentence_valence(mentions), "sid", "left")
    label = F.when(F.col("balance") > 0, "Positive").when(F.col("balance") < 0, "Negative").otherwise("Neutral")
    counted = pairs.withColumn("valence", label).groupBy("n1", "n2", "valence").agg(F.sum("w").alias("weight"))
    return best_label(over(counted, net.freq), ["n1", "n2"], "valence")


def emotion_network(mentions: DataFrame, docs: DataFrame, net: Network, emotions: list[str]) -> DataFrame:
    """(n1, n2, weight): pairs weighted by the emotional words of their sentences."""
    felt = mentions.filter(F.col("etype").isin(emotions)).groupBy("sid").agg(F.count("*").alias("n"))
    out = sentence_pairs(mentions, docs, net).join(felt, "sid").groupBy("n1", "n2").agg(F.sum(F.col("w") * F.col("n")).alias("weight"))
    return over(out, net.freq)


def main_emotion_network(mentions: DataFrame, docs: DataFrame, net: Network, emotions: list[str]) -> DataFrame:
    """(n1, n2, weight, emotion): the emotion of most weight, each sentence counting for its most frequent one."""
    felt = mentions.filter(F.col("etype").isin(emotions)).groupBy("sid", F.col("etype").alias("emotion")).agg(F.count("*").alias("n"))
    felt = best_label(felt, ["sid"], "emotion", "n")
    pairs = sentence_pairs(mentions, docs, net).join(felt, "sid").groupBy("n1", "n2", "emotion").agg(F.sum(F.col("w") * F.col("n")).alias("weight"))
    return best_label(over(pairs, net.freq), ["n1", "n2"], "emotion")


def valence_network(mentions: DataFrame, docs: DataFrame, net: Network, kinds: list[str]) -> DataFrame:
    """(n1, n2, weight): pairs counted by the valence sum of their sentences, counts beyond freq added up."""
    sums = mentions.filter(F.col("etype").isin(kinds)).groupBy("sid").agg(F.round(F.sum(F.coalesce("valence", F.lit(0.0))), 6).alias("nsum"))
    pairs = sentence_pairs(mentions, docs, net).join(sums, "sid", "left").withColumn("nsum", F.coalesce("nsum", F.lit(0.0)))
    counted = over(pairs.groupBy("n1", "n2", "nsum").agg(F.sum("w").alias("weight")), net.freq)
    return counted.groupBy("n1", "n2").agg(F.sum("weight").alias("weight"))


def _svo_ends(svo: DataFrame, mentions: DataFrame, docs: DataFrame, net: Network) -> DataFrame:
    polar = filtered(mentions, docs, net.documents).filter("etype in ('POS', 'NEG')").select("sid", F.col("word").alias("verb"), "etype", "valence").distinct()
    out = svo.select("sid", F.col("subj").alias("n1"), "verb", F.col("obj").alias("n2")).distinct().join(polar, ["sid", "verb"])
    return out.filter(F.col("n1") == net.center) if net.center is not None else out


def svo_sentiment_network(svo: DataFrame, mentions: DataFrame, docs: DataFrame, net: Network, subject_kind: str | None = None, object_kind: str | None = None) -> DataFrame:
    """(n1, n2, weight, valence): subject and object with the polarity of most of their verbs; kinds: the object is mentioned as subject_kind and the subject as object_kind in the sentence."""
    pairs = _svo_ends(svo, mentions, docs, net)
    if subject_kind and object_kind:
        as_kind = lambda kind, end: mentions.filter(F.col("etype") == kind).select("sid", F.col("word").alias(end))
        pairs = pairs.join(as_kind(subject_kind, "n2"), ["sid", "n2"], "left_semi").join(as_kind(object_kind, "n1"), ["sid", "n1"], "left_semi")
    label = F.when(F.col("etype") == "POS", "Positive").otherwise("Negative").alias("valence")
    counted = pairs.groupBy("n1", "n2", label).agg(F.count_distinct("sid", "verb").alias("weight"))
    return best_label(over(counted, net.freq), ["n1", "n2"], "valence")


def svo_polarity_network(svo: DataFrame, mentions: DataFrame, docs: DataFrame, net: Network, polarity: str = "POS") -> DataFrame:
    """(n1, n2, weight, valence): triples whose verb has one polarity, and the sum of its valence."""
    pairs = _svo_ends(svo, mentions, docs, net).filter(F.col("etype") == polarity)
    return over(pairs.groupBy("n1", "n2").agg(F.count("*").alias("weight"), F.round(F.sum("valence"), 6).alias("valence")), net.freq)


def triples_of(svo: DataFrame, sentences: DataFrame, word: str, as_object: bool = False) -> DataFrame:
    """(verb, other, n_sentences, example): what a word does, or what is done to it, with the sentence of smallest id."""
    own, other = ("obj", "subj") if as_object else ("subj", "obj")
    mine = svo.filter(F.col(own) == word).select("sid", "verb", F.col(other).alias("other")).distinct()
    out = mine.join(sentences.select("sid", "original"), "sid").groupBy("verb", "other").agg(F.count_distinct("sid").alias("n_sentences"), F.min_by("original", "sid").alias("example"))
    return out.orderBy(F.desc("n_sentences"), "verb", "other")


def adjective_nouns(tokens: DataFrame) -> DataFrame:
    """(sid, adjective, noun): adjectives with the noun they depend on; tokens as of wordclass.classified."""
    adj = tokens.filter("wclass = 'ADJ' and good").select("sid", F.col("ixDEP").alias("ix"), F.col("ent_id").alias("adjective"))
    nouns = tokens.filter("wclass = 'NOUN' and good").select("sid", "ix", F.col("ent_id").alias("noun"))
    return adj.join(nouns, ["sid", "ix"]).select("sid", "adjective", "noun")


def adjective_network(pairs: DataFrame, entities: DataFrame | None = None, stop: list[str] | None = None, center: str | None = None, freq: int = 1) -> DataFrame:
    """(n1, n2, weight): nouns with their adjectives; entities (sid): only sentences with one; stop: the noun is a stop word, the adjective none."""
    out = pairs
    if entities is not None:
        out = out.join(entities.select("sid").distinct(), "sid", "left_semi")
    if stop is not None:
        out = out.filter(F.col("noun").isin(stop) & ~F.col("adjective").isin(stop))
    if center is not None:
        out = out.filter(F.col("noun") == center)
    return over(out.groupBy(F.col("noun").alias("n1"), F.col("adjective").alias("n2")).agg(F.count("*").alias("weight")), freq)


def top_words(mentions: DataFrame, k: int = 20) -> DataFrame:
    """(word, n): the k words mentioned most often; ties by word."""
    return mentions.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


def best_by_window(weighted: DataFrame, keys: list[str], label: str, weight: str, k: int = 1) -> DataFrame:
    """The k heaviest labels of each key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(weight), label))
    return weighted.withColumn("rank", rank).filter(F.col("rank") <= k)
