"""Visually identical text in one consistent form, and documents that differ only in characters.

Stretches of text around affected characters (combining marks and everything the tables map) are
cut out; each distinct stretch is exploded once to positioned code points, joined to the broadcast
decomposition and look-alike tables, its combining marks are ordered by class, it is recomposed,
and the texts are rebuilt from the stretches and what lies between them. Text without affected
characters passes unchanged. The form of a text depends on the text alone: each distinct affected
text is formed once, and documents meet its form by a digest of the text.

Stays visible: letter case, accents, sharp s, raised digits, fractions, missing blanks, line breaks.
Look-alike letters become Latin wherever they stand, also in words wholly of another alphabet: for
the eye these are the same as their Latin double, which is what the form is compared for.

Defined cases: null stays null; empty text stays empty; texts without a visible character are never
reported as look-alikes; a text of any length is handled, only its affected stretches are moved;
repeated rows and rows with a null doc_id have their form each; a null doc_id is never reported as
a look-alike; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuswerk.plans.storage import materialized

# Letters of other alphabets that look like a Latin letter, under the Latin one.
LOOK_ALIKE = {
    "АВЕЅІЈКМНОРСТХУԚԜ": "ABESIJKMHOPCTXYQW",  # Cyrillic capitals
    "асԁеһіјорԛѕԝхуү": "acdehijopqswxyy",  # Cyrillic small letters
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",  # Greek capitals
    "ο": "o",  # Greek small letter
    "‐‑﹣": "---",  # hyphens
}
# Code points that aren't seen at all, as inclusive ranges.
UNSEEN = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xE0100, 0xE01EF)]
# Line breaks other than the usual one.
BREAKS = "\r\x0b\x0c\x85  "
#: Compatibility forms that look like what they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")
LIGATURES = range(0xFB00, 0xFB07)


@cache
def mapping() -> dict[str, str]:
    """Code point to what it is replaced by; built by rule from the Unicode data, a table of fixed size."""
    out: dict[str, str] = {}
    for code in range(0xA0, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        form = unicodedata.decomposition(c)
        if kind == "Zs":
            out[c] = " "
        elif form.startswith(SAME_LOOK) or code in LIGATURES:
            out[c] = unicodedata.normalize("NFKC", c)
        elif form and not form.startswith("<") and unicodedata.normalize("NFC", c) != c:
            out[c] = unicodedata.normalize("NFC", c)
    for a, b in LOOK_ALIKE.items():
        out |= dict(zip(a, b, strict=True))
    out |= {chr(k): "" for a, b in UNSEEN for k in range(a, b + 1)}
    out |= dict.fromkeys(BREAKS, "\n") | {"\t": " "}
    for c, to in list(out.items()):  # a wide form may stand for something that is mapped itself
        out[c] = "".join(out.get(x, x) for x in to)
    return out


@cache
def _affected() -> frozenset[int]:
    marks = {k for k in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(k))[0] == "M"}
    return frozenset(marks | set(map(ord, mapping())) | set(range(0x1100, 0x1200)))


@cache
def _unaffected(least: int) -> str:
    """Inside of Java's character class of spans without affected code points: those of the common
    letters and quotes, and beyond these the ones of at least so many code points. Few spans keep
    the class fast; code points in none of them are looked at and pass unchanged."""
    spans, start = [], 0x20
    for k in range(0x20, 0x20000):
        if k in _affected() or 0x7F <= k < 0xA0 or 0xD800 <= k < 0xE000:
            if k - start >= (1 if k <= 0x300 or 0x2010 < k <= 0x2028 else least):
                spans.append((start, k - 1))
            start = k + 1
    return r"\n" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


def suspect_pattern() -> str:
    return f"[^{_unaffected(1 << 20)}]"


def stretch_pattern() -> str:
    """One unaffected character, if any, the others that follow it, and the end of a line."""
    inside = _unaffected(500)
    return f"[{inside}]?[^{inside}]++\n?"


def tables(spark) -> DataFrame:
    """(c, d, class): the decomposed code points d that stand for code point c, and their combining class."""
    rows = []
    chars = set(mapping()) | {chr(k) for k in range(sys.maxunicode + 1) if unicodedata.combining(chr(k)) or unicodedata.decomposition(chr(k)) and not unicodedata.decomposition(chr(k)).startswith("<")}
    for c in sorted(chars):
        for k, d in enumerate(unicodedata.normalize("NFD", mapping().get(c, c))):
            rows.append((c, k, d, unicodedata.combining(d)))
    return spark.createDataFrame(rows, "c string, k int, d string, class int")


@F.pandas_udf(T.StringType())
def _composed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x))


def canonical_stretches(stretches: DataFrame) -> DataFrame:
    """(stretch, form) of distinct stretches."""
    table = tables(stretches.sparkSession)
    crlf = F.replace("stretch", F.lit("\r\n"), F.lit("\n"))
    each = stretches.select("stretch", F.posexplode(F.split(crlf, "")).alias("pos", "c"))
    unseen = table.sparkSession.createDataFrame([(c,) for c, to in sorted(mapping().items()) if not to], "c string")
    each = each.join(F.broadcast(unseen), "c", "left_anti").join(F.broadcast(table), "c", "left")
    each = each.select("stretch", "pos", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("d", "c").alias("d"), F.coalesce("class", F.lit(0)).alias("class"))
    # Marks are ordered by class behind their starter; marks of one class keep their order.
    order = Window.partitionBy("stretch").orderBy("pos", "k")
    each = each.withColumn("starter", F.sum((F.col("class") == 0).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("starter", "class", "pos", "k", "d")))
    built = each.groupBy("stretch").agg(F.array_join(parts["d"], "").alias("form"))
    built = stretches.join(built, "stretch", "left").select("stretch", F.coalesce("form", F.lit("")).alias("form"))
    return built.select("stretch", _composed("form").alias("form"))


def _digest(c: str | Column) -> Column:
    return F.unhex(F.md5(c))


def affected(text: str | Column) -> Column:
    return F.coalesce((F.col(text) if isinstance(text, str) else text).rlike(suspect_pattern()), F.lit(False))


def forms_of(dirty: DataFrame) -> DataFrame:
    """(raw, form) of distinct affected texts (raw, text)."""
    pattern = stretch_pattern()
    cut = dirty.select("raw", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "stretch"))
    cut = materialized(cut, "stretches")
    forms = canonical_stretches(cut.select("stretch").distinct())
    put = cut.join(forms, "stretch").groupBy("raw").agg(F.sort_array(F.collect_list(F.struct("pos", "form")))["form"].alias("forms"))
    gaps = F.split("text", pattern, -1)
    put = dirty.join(put, "raw", "left").withColumn("forms", F.coalesce("forms", F.array().cast("array<string>")))
    return put.select("raw", F.array_join(F.zip_with(gaps, "forms", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "").alias("form"))


def canonical(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form) of every row, whatever its key."""
    own = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("dirty", affected("text"))
    own = own.withColumn("raw", F.when(F.col("dirty"), _digest("text")))
    dirty = materialized(own.filter("dirty").select("raw", "text").groupBy("raw").agg(F.min("text").alias("text")), "dirty_texts")
    # Only affected rows meet a form; the others pass.
    plain = own.filter("not dirty").select("key", F.col("text").alias("form"))
    return plain.unionByName(own.filter("dirty").select("key", "raw").join(forms_of(dirty), "raw").select("key", "form"))


def canonical_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw, form, visible): digests of each text and of its form; each distinct text is formed once.

    Texts are looked through once: what is affected is kept with its text, of others only the digest.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    own = own.select("doc_id", "text", _digest("text").alias("raw"), affected("text").alias("dirty"))
    seen = F.col("text").rlike(r"\S")
    own = materialized(own.select("doc_id", "raw", "dirty", seen.alias("visible"), F.when(F.col("dirty"), F.col("text")).alias("text")), "looked_through")
    plain = own.filter("not dirty").select("doc_id", "raw", F.col("raw").alias("form"), "visible")
    distinct = own.filter("dirty").groupBy("raw").agg(F.min("text").alias("text"))
    forms = forms_of(materialized(distinct, "dirty_texts")).select("raw", _digest("form").alias("form"), F.col("form").rlike(r"\S").alias("visible"))
    return plain.unionByName(own.filter("dirty").select("doc_id", "raw").join(forms, "raw").select("doc_id", "raw", "form", "visible"))


def form_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, form, n_texts, n_docs): each document with a visible text, the class of its form, and how many texts and documents that has."""
    every = materialized(canonical_texts(docs, id_col, text_col).filter("visible").select("doc_id", "raw", "form"), "forms")
    sizes = every.groupBy("form", "raw").agg(F.count("*").alias("n")).groupBy("form").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_docs"))
    return every.join(sizes, "form").select("doc_id", F.lower(F.hex("form")).alias("form"), "n_texts", "n_docs")


def look_alikes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b) of every two documents of one form and different characters.

    Texts are paired first, each distinct text once, and their documents joined then: exact copies
    meet only the documents they are to be reported with.
    """
    all_forms = materialized(canonical_texts(docs, id_col, text_col).filter("visible and doc_id is not null").select("doc_id", "raw", "form"), "forms")
    texts = all_forms.select("form", "raw").distinct()
    several = texts.groupBy("form").agg(F.count("*").alias("n")).filter("n > 1").select("form")
    texts = texts.join(several, "form", "left_semi")
    a = texts.select("form", F.col("raw").alias("raw_a"))
    pairs = a.join(texts.select("form", F.col("raw").alias("raw_b")), "form").filter("raw_a < raw_b").select("raw_a", "raw_b")
    ids = all_forms.select("doc_id", "raw")
    out = pairs.join(ids.select(F.col("raw").alias("raw_a"), F.col("doc_id").alias("x")), "raw_a")
    out = out.join(ids.select(F.col("raw").alias("raw_b"), F.col("doc_id").alias("y")), "raw_b")
    return out.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
