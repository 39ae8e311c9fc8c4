"""Entity linking against a gazetteer of persons, places and organisations.

Names are taken apart into a lookup table (tok, pid, name, plen, pos); a name is found where all its
tokens stand side by side. All of it is joins and aggregates by sentence: what a sentence takes over
from earlier ones of its document is the least sentence in which an entity was resolved, which one
aggregate by document and entity gives. Only the settling of overlaps is a fold over the spans of one
sentence. Defined cases: null names and tokens match nothing; names of blanks only are left out;
all-caps tokens match as they stand, others in lower case; ties go to the earlier start, then to the
smaller pid; the lookup table is joined by token, it is never broadcast unasked.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ["PER", "LOC", "ORG"]


def folded(tok: str | Column) -> Column:
    """Lower case, but all-caps tokens as they stand."""
    tok = F.col(tok) if isinstance(tok, str) else tok
    return F.when((F.upper(tok) == tok) & (F.lower(tok) != tok), tok).otherwise(F.lower(tok))


def lookup_table(names: DataFrame) -> DataFrame:
    """(tok, pid, name, plen, pos) of (pid, name); pos from 1."""
    words = F.filter(F.split("name", r"\s+"), lambda w: w != "")
    each = names.select("pid", "name", words.alias("words")).distinct()
    return each.select("pid", "name", F.size("words").alias("plen"), F.posexplode("words").alias("pos0", "w")).select(folded("w").alias("tok"), "pid", "name", "plen", (F.col("pos0") + 1).alias("pos"))


def gazetteer_names(gazetteer: DataFrame) -> DataFrame:
    """(pid, name): labels and aliases."""
    every = F.array_union(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))
    return gazetteer.select("pid", F.explode(every).alias("name")).filter("name is not null and trim(name) <> ''").distinct()


def person_names(persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First and last names as (pid, name), of persons (pid, name, firstnames, lastnames).

    A full name of two words is cut in two; a longer one after its last known first name, else before
    its first known last name, else before its last word. First names also stand as an initial, last
    names with a genitive s. Names of one character or with other characters than letters are left out.
    """
    none = F.array().cast("array<string>")
    words = F.filter(F.split("name", r"\s+"), lambda w: w != "")
    p = persons.select("pid", words.alias("w"), F.coalesce("firstnames", none).alias("fn"), F.coalesce("lastnames", none).alias("ln"))
    places = F.sequence(F.lit(1), F.size("w"))
    last_first = F.array_max(F.filter(places, lambda i: F.array_contains(F.col("fn"), F.element_at(F.col("w"), i))))
    first_last = F.array_min(F.filter(places, lambda i: F.array_contains(F.col("ln"), F.element_at(F.col("w"), i))))
    cut = F.when(F.size("w") == 2, 1).otherwise(F.coalesce(last_first, first_last - 1, F.size("w") - 1)).cast("int")
    p = p.filter(F.size("w") > 0).withColumn("cut", F.least(cut, F.size("w") - 1))
    join = lambda words: F.array_join(words, " ")
    first = F.array_union(F.col("fn"), F.array(join(F.slice("w", F.lit(1), F.col("cut")))))
    last = F.array_union(F.col("ln"), F.array(join(F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut")))))
    usable = lambda n: (F.length(n) > 1) & F.replace(F.replace(n, F.lit("-"), F.lit("")), F.lit(" "), F.lit("")).rlike(r"\A\p{L}+\z")
    initial = F.concat(F.substring(F.element_at("w", 1), 1, 1), F.lit("."))
    firsts = p.select("pid", F.explode(F.array_union(F.filter(first, usable), F.array(initial))).alias("name"))
    kept = F.filter(last, usable)
    lasts = p.select("pid", F.explode(F.array_union(kept, F.transform(kept, lambda n: F.concat(n, F.lit("s"))))).alias("name"))
    return firsts.distinct(), lasts.distinct()


def runs(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """(sid, start, plen, pid): where all tokens of a name stand side by side; tokens (sid, ix, word)."""
    hits = tokens.select("sid", "ix", folded("word").alias("tok")).join(table, "tok").withColumn("start", F.col("ix") - F.col("pos") + 1)
    found = hits.groupBy("sid", "start", "plen", "pid", "name").agg(F.count_distinct("pos").alias("n")).filter("n = plen")
    return found.select("sid", "start", "plen", "pid").distinct()


def longest_by_entity(found: DataFrame) -> DataFrame:
    """Of each entity in a sentence the longest run, the first at a tie."""
    return found.groupBy("sid", "pid").agg(F.min(F.struct((-F.col("plen")).alias("l"), "start")).alias("b")).select("sid", F.col("b.start").alias("start"), (-F.col("b.l")).alias("plen"), "pid")


def blocks(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """(sid, ix, block): tokens of names, numbered by runs of neighbours."""
    known = table.select("tok").distinct()
    hits = tokens.select("sid", "ix", folded("word").alias("tok")).join(known, "tok", "left_semi")
    order = Window.partitionBy("sid").orderBy("ix")
    return hits.select("sid", "ix", (F.col("ix") - F.row_number().over(order)).alias("block"))


def ranked(found: DataFrame, views: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the longest candidates, of these the one with most views: one row a key."""
    scored = found.join(views.select("pid", F.coalesce("views", F.lit(0)).alias("views")), "pid", "left")
    best = F.min(F.struct((-F.col("plen")).alias("l"), (-F.coalesce("views", F.lit(0))).alias("v"), "start", "pid")).alias("b")
    return scored.groupBy(*keys).agg(best).select(*keys, F.col("b.start").alias("start"), (-F.col("b.l")).cast("int").alias("plen"), F.col("b.pid").alias("pid"))


def link_names(tokens: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(sid, start, plen, pid): places or organisations, one a block of neighbouring name tokens."""
    table = lookup_table(gazetteer_names(gazetteer))
    found = longest_by_entity(runs(tokens, table)).join(blocks(tokens, table).withColumnRenamed("ix", "start"), ["sid", "start"])
    return ranked(found, gazetteer, ["sid", "block"]).drop("block")


def link_persons(tokens: DataFrame, persons: DataFrame, politicians: DataFrame | None = None) -> DataFrame:
    """(sid, id_article, start, plen, pid, resolved, cap) of the persons mentioned, one a block.

    Resolved is a last name directly after a first name of the same person, or one whose person was
    resolved in an earlier sentence of the document. Others are resolved to a candidate found anywhere
    in the document, then, where the document names a politician, to a politician; else the candidate
    with most views stays unresolved. tokens: (id_article, sid, ix, word); politicians: (pid).
    """
    firsts, lasts = person_names(persons)
    f = longest_by_entity(runs(tokens, lookup_table(firsts))).select("sid", "pid", F.col("start").alias("f_start"), F.col("plen").alias("f_len"))
    last_table = lookup_table(lasts)
    last = longest_by_entity(runs(tokens, last_table)).join(tokens.select("sid", "id_article").distinct(), "sid")
    both = last.join(f, ["sid", "pid"], "left").withColumn("full", F.coalesce(F.col("f_start") + F.col("f_len") == F.col("start"), F.lit(False)))
    seen = both.filter("full").groupBy("id_article", "pid").agg(F.min("sid").alias("first_sid"))
    both = both.join(seen, ["id_article", "pid"], "left").withColumn("before", F.coalesce(F.col("first_sid") < F.col("sid"), F.lit(False)))
    both = both.withColumns({"anywhere": F.col("first_sid").isNotNull(), "resolved": F.col("full") | F.col("before")})
    if politicians is not None:
        both = both.join(politicians.select("pid", F.lit(True).alias("politic")).distinct(), "pid", "left")
        named = both.filter("resolved and politic").select("id_article", F.lit(True).alias("political")).distinct()
        both = both.join(named, "id_article", "left").withColumn("politic", F.coalesce(F.col("politic") & F.col("political"), F.lit(False)))
    else:
        both = both.withColumn("politic", F.lit(False))
    both = both.join(blocks(tokens, last_table).withColumnRenamed("ix", "start"), ["sid", "start"])
    both = both.join(persons.select("pid", F.coalesce("views", F.lit(0)).alias("views")), "pid", "left")
    start, length = F.when(F.col("full"), F.col("f_start")).otherwise(F.col("start")), F.when(F.col("full"), F.col("f_len") + F.col("plen")).otherwise(F.col("plen"))
    tier = F.when(F.col("resolved"), 0).when(F.col("anywhere"), 1).when(F.col("politic"), 2).otherwise(3)
    best = F.min(F.struct(tier.alias("tier"), (-length).alias("l"), (-F.coalesce("views", F.lit(0))).alias("v"), start.alias("start"), "pid")).alias("b")
    out = both.groupBy("sid", "id_article", "block").agg(best)
    out = out.select("sid", "id_article", F.col("b.start").cast("int").alias("start"), (-F.col("b.l")).cast("int").alias("plen"), F.col("b.pid").alias("pid"), (F.col("b.tier") < 3).alias("resolved"))
    opening = tokens.select("sid", F.col("ix").alias("start"), F.substring("word", 1, 1).alias("c"))
    return out.join(opening, ["sid", "start"], "left").withColumn("cap", F.coalesce((F.upper("c") == F.col("c")) & (F.lower("c") != F.col("c")), F.lit(False))).drop("c")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    sure: bool
    pid: str


def settle(spans: list[Span]) -> list[Span]:
    """The spans of a sentence that stand, from left to right.

    Each kind has a queue in order of start. A round picks a first span among the heads of the queues; a
    head that lies wholly before it takes its place and lets it wait. A head that starts no later and
    overlaps wins only if sure and the other is unsure or shorter, one that starts inside of it only if
    sure and the other is unsure; who loses is gone.
    """
    queues = {k: deque(sorted((s for s in spans if s.kind == k), key=lambda s: s.start)) for k in KINDS}
    out = []
    while any(queues.values()):
        best: Span | None = None
        settled = False
        while not settled:
            settled = True
            for kind in KINDS:
                queue = queues[kind]
                if not queue or queue[0] is best:
                    continue
                head = queue[0]
                if best is None or head.start < best.start and head.end < best.start:
                    best = head
                elif head.start <= best.end:
                    longer = head.end - head.start > best.end - best.start
                    wins = head.sure and (not best.sure or head.start <= best.start and longer)
                    if wins:
                        queues[best.kind].popleft()
                        best, settled = head, False
                    else:
                        queue.popleft()
        queues[best.kind].popleft()
        out.append(best)
    return out


def settled(spans: DataFrame) -> DataFrame:
    """(sid, kind, start, end, sure, pid) without overlaps of kinds; one sentence is one group of a few rows."""
    schema = "sid bigint, kind string, start int, end int, sure boolean, pid string"

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for sid, found in zip(batch["sid"], batch["spans"]):
                rows += [(sid, s.kind, s.start, s.end, s.sure, s.pid) for s in settle([Span(**x) for x in found])]
            yield pd.DataFrame(rows, columns=["sid", "kind", "start", "end", "sure", "pid"])

    listed = spans.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "sure", "pid"))).alias("spans"))
    return listed.mapInPandas(per_partition, schema)


def link(tokens: DataFrame, gazetteer: DataFrame, persons: DataFrame, politicians: DataFrame | None = None) -> DataFrame:
    """All spans of a corpus, settled: gazetteer (pid, kind place or org, label, aliases, views), persons (pid, name, firstnames, lastnames, views)."""
    end = (F.col("start") + F.col("plen") - 1).cast("int").alias("end")
    parts = link_persons(tokens, persons, politicians).select("sid", F.lit("PER").alias("kind"), "start", end, (F.col("resolved") & F.col("cap")).alias("sure"), "pid")
    for kind, name in (("place", "LOC"), ("org", "ORG")):
        own = link_names(tokens, gazetteer.filter(F.col("kind") == kind))
        parts = parts.unionByName(own.select("sid", F.lit(name).alias("kind"), F.col("start").cast("int").alias("start"), end, F.lit(True).alias("sure"), "pid"))
    return settled(parts)


def enriched(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens with ent_id, ent_type and ent_iob of the span that covers them; an unsure span counts only where the tagger saw an entity at its start."""
    cover = spans.withColumn("ix", F.explode(F.sequence("start", "end"))).select("sid", "ix", "start", "kind", "pid", "sure")
    opening = tokens.select("sid", F.col("ix").alias("start"), F.col("ner").isNotNull().alias("tagged"))
    cover = cover.join(opening, ["sid", "start"]).filter("sure or tagged").select("sid", "ix", F.col("pid").alias("ent_id"), F.col("kind").alias("ent_type"), F.when(F.col("ix") == F.col("start"), "B").otherwise("I").alias("ent_iob"))
    return tokens.join(cover, ["sid", "ix"], "left")


def candidate_frequency(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """(pid, kind, docsrc, sure, surface, n, example): how each entity is written, with its first sentence."""
    sentence = tokens.groupBy("sid").agg(F.min("docsrc").alias("docsrc"), F.sort_array(F.collect_list(F.struct("ix", F.coalesce("word", F.lit("")).alias("word")))).alias("t"))
    each = spans.join(sentence, "sid")
    surface = F.array_join(F.transform(F.filter("t", lambda x: x["ix"].between(F.col("start"), F.col("end"))), lambda x: x["word"]), " ")
    each = each.select("sid", "pid", "kind", "docsrc", "sure", surface.alias("surface"), F.array_join("t.word", " ").alias("text"))
    return each.groupBy("pid", "kind", "docsrc", "sure", "surface").agg(F.count("*").alias("n"), F.min_by("text", "sid").alias("example"))


def merged_vocabulary(*vocabularies: DataFrame) -> DataFrame:
    """Rows by pid; of repeated ones that of the later vocabulary."""
    ranked_parts = [v.withColumn("order", F.lit(k)) for k, v in enumerate(vocabularies)]
    whole = ranked_parts[0]
    for v in ranked_parts[1:]:
        whole = whole.unionByName(v, allowMissingColumns=True)
    rest = [c for c in whole.columns if c not in ("pid", "order")]
    return whole.groupBy("pid").agg(F.max_by(F.struct(*rest), "order").alias("v")).select("pid", "v.*")
