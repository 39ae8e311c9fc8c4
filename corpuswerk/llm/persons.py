"""Spellings of the same person or office.

A spelling is read into surname and given name (or initial), whatever their order; titles and middle
initials are passed over, short forms of given names are put back. Each distinct reading is a node.
Readings meet by MinHash bands over the padded 3-grams of their surname and given name, meetings are
verified by Monge-Elkan similarity, and each reading goes to the one written most often among those
similar to it: stars, whose centres may be satellites of a heavier star. Initials alone go to the one
star they fit best; where they fit several alike, they are linked to none of them.

How many bands: a band holds ROWS hashes of the surname and one of the given name, so that two readings
of Jaccard similarity s and g meet with probability 1 - (1 - s^ROWS * g)^BANDS. An edit in a surname
of seven letters leaves s at 0.38 or more, two in one of fourteen at 0.33; 160 bands of 3 find these with
0.9998 and 0.997, and readings of a tenth in common with 0.15 at most; see `meeting`. Namesakes of one
surname share few 3-grams of the given name and rarely meet, so that a common surname is no hot key.

Defined cases: null, empty and letterless spellings name nobody; offices are linked to offices only;
repeated rows count as weight, ties in weight go to the greater string; very long spellings are read
whole; extra columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuswerk.llm.linking import allowed, edits, fold
from corpuswerk.plans.storage import materialized

BANDS = 160
ROWS = 3
GRAM = 3
#: Least Monge-Elkan similarity of spellings of one person.
SIMILAR = 0.83
# Words in front of a name, words of offices, and short forms of given names (folded).
TITLES = {"dr", "mag", "prof", "di", "ing", "dipl", "dkfm", "univ", "msc", "bsc", "mba", "phd", "med", "phil", "jur", "herr", "frau"}
OFFICE = re.compile(r"^(red|redaktion|redaktionsburo|pressestelle|presseburo|pressedienst|presse|buro)$")
SHORT = {
    "vroni": "veronika", "beni": "benedikt", "andi": "andreas", "lisi": "elisabeth", "michi": "michal", "babsi": "barbara", "rosi": "rosalinde", "susi": "susanne", "hilde": "hildegard", "resi": "theresia",
    "kathi": "katharina", "kati": "katharina", "gabi": "gabriele", "alex": "alexander", "max": "maximilian", "niki": "nikolaus", "klaus": "nikolaus", "sepp": "josef", "pepi": "josef", "poldi": "leopold", "franzi": "franziska",
    "leni": "magdalena", "magda": "magdalena", "gretl": "margarete", "grete": "margarete", "ferdl": "ferdinand", "ferdi": "ferdinand", "fritz": "friedrich", "hans": "johann", "willi": "wilhelm", "luki": "lukas", "rudi": "rudiger",
    "christl": "christoph", "stoffl": "christoph", "domi": "dominik", "nick": "dominik", "toni": "anton", "steffi": "stefanie", "wolfi": "wolfgang", "schorsch": "georg", "wickerl": "ludwig", "lois": "alois", "wiggerl": "ludwig", "valti": "valentin", "uschi": "ursula", "betti": "elisabeth", "sissi": "elisabeth",
}
GIVEN = set(SHORT) | set(SHORT.values())


def read(name: str) -> tuple[bool, tuple[str, ...], str] | None:
    """(office, words of the surname, given name or its initial)."""
    text = re.sub(r"\s*-[-\s]*", "-", fold(name))
    words = lambda part: [w for w in (x.strip("-") for x in re.findall(r"[^\W\d_][\w-]*", part)) if w]
    every = [w for w in words(text.replace("-", " "))]
    if any(OFFICE.match(w) for w in every[:2]) or every and OFFICE.match(every[-1]):
        rest = "".join(w for w in every if not OFFICE.match(w))
        return (True, (rest,), "") if rest else None
    front, comma, back = text.partition(",")
    front, back = ([w for w in words(x) if w not in TITLES] for x in (front, back))
    if comma and front and back:
        sur, given = front, next((w for w in back if len(w) > 1), back[0])
    else:
        own = front + back
        long = [w for w in own if len(w) > 1]
        if not long:
            return None
        if len(long) == 1:
            sur, given = long, next((w for w in own if len(w) == 1), "")
        else:
            known = [w for w in long if w in GIVEN]
            # Of two words the shorter is taken for the given name, so that both orders read alike.
            given = known[0] if len(known) == 1 else long[0] if len(long) > 2 else min(long, key=lambda w: (len(w), w))
            sur = list(long)
            sur.remove(given)
    given = given.replace("-", "")
    return False, tuple(x for w in sur for x in w.split("-") if x), SHORT.get(given, given)


def word_similarity(a: str, b: str) -> float:
    """1 - edits / length; 0 beyond the edits a word of that length may have."""
    if a == b:
        return 1.0
    short, long = sorted((len(a), len(b)))
    most = 2 if long >= 6 else 1
    d = edits(a, b, most)
    return 0.0 if d > most or short < 2 else 1 - d / long


def surname_similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    one, other = "".join(a), "".join(b)
    if one == other:
        return 1.0
    most = min(allowed(len(one)), allowed(len(other)))
    d = edits(one, other, most)
    return 1 - d / max(len(one), len(other)) if d <= most else 0.0


def monge_elkan(a: tuple, b: tuple) -> float:
    """Mean over the words of the shorter name of their best similarity in the longer one; surnames meet surnames.

    The second part of a double surname may be left out where the rest is written alike.
    """
    (office_a, sur_a, given_a), (office_b, sur_b, given_b) = a, b
    if office_a != office_b or bool(given_a) != bool(given_b):
        return 0.0
    sur = surname_similarity(sur_a, sur_b)
    short, long = sorted((sur_a, sur_b), key=len)
    if not sur and len(short) == 1 and len(long) == 2 and len(given_a) > 1 and given_a == given_b:
        sur = surname_similarity(short, long[:1])
    if not given_a or not sur:
        return sur
    given = float(given_a == given_b) if min(len(given_a), len(given_b)) == 1 else word_similarity(given_a, given_b)
    return (sur + given) / 2 if given else 0.0


def meeting(sur: float, given: float = 1.0, bands: int = BANDS, rows: int = ROWS) -> float:
    """The collision curve: how probably readings of these Jaccard similarities meet in a band."""
    return 1 - (1 - sur**rows * given) ** bands


@cache
def _factors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**61 - 1, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**61 - 1, n, dtype=np.uint64)


def minhashes(text: str, n: int, seed: int) -> np.ndarray:
    padded = "\u0001" * (GRAM - 1) + text + "\u0002" * (GRAM - 1)
    grams = np.array([xxhash.xxh64_intdigest(padded[i : i + GRAM]) for i in range(len(padded) - GRAM + 1)], dtype=np.uint64)
    by, plus = _factors(n, seed)
    with np.errstate(over="ignore"):
        mixed = grams[:, None] * by[None, :] + plus[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed ^ (mixed >> np.uint64(32))).min(axis=0)


def band_keys(sur: str, given: str, exact: bool = False) -> np.ndarray:
    """One key a band; exact: given names meet only where they are equal."""
    s = minhashes(sur, BANDS * ROWS, 1).reshape(BANDS, ROWS)
    g = np.full(BANDS, xxhash.xxh64_intdigest(given), dtype=np.uint64) if exact or not given else minhashes(given, BANDS, 2)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in (*s.T, g):
            key = (key ^ part) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [read(x) for x in batch.column(0).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array([r and "|".join((str(int(r[0])), " ".join(r[1]), r[2])) for r in out], pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["spelling", "weight", "reading"])


def _split(reading: str) -> tuple[bool, tuple[str, ...], str]:
    office, sur, given = reading.split("|")
    return office == "1", tuple(sur.split(" ")), given


def _banded(fits: bool):
    """Band keys of readings; fits: of surname and first letter, by which initials meet names, else of surname and given name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys = [], []
            for reading in batch.column(0).to_pylist():
                office, sur, given = _split(reading)
                if fits and not given:
                    continue
                names.append(reading)
                keys.append(band_keys("".join(sur), given[0] if fits else given or "-+"[office], fits or not given))
            at = pa.array(np.repeat(np.arange(len(names)), BANDS))
            keys = pa.array(np.concatenate(keys) if keys else np.empty(0, dtype=np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(at), keys], ["reading", "key"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array([monge_elkan(_split(a), _split(b)) >= SIMILAR for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.bool_())
        yield batch.filter(keep)


def _fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to pairs of an initial and a name how similar their surnames are."""
    for batch in batches:
        near = [surname_similarity(_split(a)[1], _split(b)[1]) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.float64())], ["a", "b", "near"])


def _meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of every two different readings of one band key, each two once.

    Bands are many times the size Spark guesses for them, so that neither side is to be broadcast.
    """
    one = left.select(F.col("reading").alias("a"), "key").hint("shuffle_merge")
    return one.join(right.select(F.col("reading").alias("b"), "key"), "key").filter("a <> b").select("a", "b").distinct()


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(reading, centre): each goes to its heaviest similar one that is heavier than itself, over and over; edges (a, b) hold both directions."""
    weights = nodes.select(F.col("reading").alias("b"), F.col("weight").alias("weight_b"))
    up = edges.join(weights, "b").groupBy(F.col("a").alias("reading")).agg(F.max(F.struct("weight_b", "b")).alias("top"))
    up = nodes.join(up, "reading", "left")
    heavier = F.coalesce(F.struct("weight", "reading") < F.col("top"), F.lit(False))
    now = materialized(up.select("reading", F.when(heavier, F.col("top.b")).otherwise(F.col("reading")).alias("centre")), "stars")
    while True:  # each round halves the way to the centre
        on = now.select(F.col("reading").alias("centre"), F.col("centre").alias("next"))
        after = materialized(now.join(on, "centre").select("reading", F.col("next").alias("centre"), (F.col("next") != F.col("centre")).alias("moved")), "stars")
        if after.filter("moved").isEmpty():
            return after.select("reading", "centre")
        now = after.select("reading", "centre")


def clusters(spellings: DataFrame, column: str = "spelling") -> DataFrame:
    """(spelling, weight, centre) of each distinct spelling that can be read; those of one centre name the same."""
    counted = spellings.filter(F.length(column) > 0).groupBy(F.col(column).alias("spelling")).agg(F.count("*").alias("weight"))
    schema = "spelling string, weight bigint, reading string"
    names = materialized(counted.mapInArrow(_readings, schema).filter("reading is not null"), "names")
    nodes = materialized(names.groupBy("reading").agg(F.sum("weight").alias("weight")), "readings")
    readings = nodes.select("reading")
    initial = F.col("reading").rlike(r"\|.$")
    pairs = "a string, b string"
    banded = materialized(readings.mapInArrow(_banded(False), "reading string, key bigint"), "bands")
    edges = materialized(_meetings(banded, banded).filter("a < b").mapInArrow(_verified, pairs), "edges")
    found = materialized(stars(nodes, edges.union(edges.select("b", "a"))), "stars")
    short = readings.filter(initial).mapInArrow(_banded(True), "reading string, key bigint")
    full = readings.filter(~initial).mapInArrow(_banded(True), "reading string, key bigint")
    fits = _meetings(short, full).mapInArrow(_fitting, pairs + ", near double").filter("near > 0")
    of = lambda c, name: found.select(F.col("reading").alias(c), F.col("centre").alias(name))
    fits = fits.join(of("a", "centre"), "a").join(of("b", "person"), "b").groupBy("centre", "person").agg(F.max("near").alias("near"))
    best = fits.groupBy("centre").agg(F.max("near").alias("near"))
    fits = fits.join(best, ["centre", "near"]).groupBy("centre").agg(F.count("*").alias("n"), F.min("person").alias("person")).filter("n = 1")
    joined = found.join(fits.select("centre", "person"), "centre", "left").select("reading", F.coalesce("person", "centre").alias("centre"))
    return materialized(names.join(joined, "reading").select("spelling", "weight", "centre"), "persons")


def same_names(spellings: DataFrame, column: str = "spelling") -> DataFrame:
    """(name_a, name_b) of every two spellings of the same."""
    joined = clusters(spellings, column)
    a, b = joined.select("centre", F.col("spelling").alias("name_a")), joined.select("centre", F.col("spelling").alias("name_b"))
    return a.join(b, "centre").filter("name_a < name_b").select("name_a", "name_b")
