"""Text functions of newspaper articles, as column expressions that stay in the JVM.

Letters and digits are those of Unicode; a blank is any white space and the no-break space. Null
texts give null, empty ones empty results, unless a docstring says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = r"\p{L}\p{N}_"
BLANK = r"[\s ]"
# The letters of German texts that plain tokenizers keep.
GERMAN = "a-zA-ZüäöÜÄÖß"
VOWELS = "[aeiouyäöüáéíóúàèêâîôûëïœ]+"
# Phrases that close an article, up to thirty characters after them.
NOTES = r"(?:Bild[.:/0-9A-Za-z, ]{0,30}|Seit[en ]*[.:/0-9A-Za-z, ]{0,30})$"
# Place and agency that open a report.
DATELINE = r"^([\p{L}\p{N}_\s]+)\(([\p{L}\p{N}_\s/]+)\)[\s-]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_words(word: str | Column, *order: str, sep: str = " ") -> Column:
    """Aggregate: the words of a group in order."""
    parts = F.sort_array(F.collect_list(F.struct(*order, _col(word).alias("joined_word"))))
    return F.array_join(parts["joined_word"], sep)


def attach_punctuation(text: str | Column) -> Column:
    """No blank before ?!.,;:) and after (, no stars."""
    out = F.regexp_replace(_col(text), r"\s+([?!.,;:)])", "$1")
    return F.replace(F.regexp_replace(out, r"([(])\s+", "$1"), F.lit("*"), F.lit(""))


def collapse_blanks(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), rf"{BLANK}+", " ")


def only_words(text: str | Column) -> Column:
    """Anything but letters and digits becomes a blank, lone Latin letters inside go."""
    return F.regexp_replace(F.regexp_replace(_col(text), f"[^{LETTER}]", " "), r"\s+[a-zA-Z]\s+", " ")


def subtitle(text: str | Column) -> Column:
    """struct(subtitle, rest): what stands between `Utl.: ` and `=`; without it null and the text."""
    text = _col(text)
    at, end = F.instr(text, "Utl."), F.instr(text, "=")
    has = (at > 0) & (end > at)
    cut = F.substring(text, at + 6, end - at - 6)
    return F.struct(F.when(has, F.btrim(cut)).alias("subtitle"), F.when(has, F.substring(text, end + 2, F.length(text))).otherwise(text).alias("rest"))


def dateline(text: str | Column) -> Column:
    """struct(place, agency, rest) of a report that opens with PLACE (AGENCY) -."""
    text = _col(text)
    whole = F.regexp_extract(text, DATELINE, 0)
    has = whole != ""
    place = F.when(has, F.btrim(F.regexp_extract(text, DATELINE, 1)))
    agency = F.when(has, F.btrim(F.regexp_extract(text, DATELINE, 2)))
    return F.struct(place.alias("place"), agency.alias("agency"), F.when(has, F.substring(text, F.length(whole) + 1, F.length(text))).otherwise(text).alias("rest"))


def final_note(text: str | Column) -> Column:
    """struct(note, rest): a closing reference to a picture or page, cut off."""
    text = _col(text)
    note = F.regexp_extract(text, NOTES, 0)
    has = note != ""
    return F.struct(F.when(has, note).alias("note"), F.when(has, F.substring(text, F.lit(1), F.length(text) - F.length(note))).otherwise(text).alias("rest"))


def wordpunct_tokens(text: str | Column) -> Column:
    """Runs of letters and digits, and runs of other visible characters."""
    return F.regexp_extract_all(_col(text), F.lit(f"[{LETTER}]+|[^{LETTER}\\s]+"), F.lit(0))


def is_good_word(word: str | Column) -> Column:
    """More than one character, ends in a letter, digit, full stop or hyphen, and only letters and digits before, hyphens aside."""
    word = _col(word)
    bare = F.replace(word, F.lit("-"), F.lit(""))
    inner = F.substring(bare, F.lit(1), F.length(bare) - 1)
    return (F.length(word) > 1) & word.rlike(r"[\p{L}\p{N}.\-]\z") & inner.rlike(r"\A[\p{L}\p{N}]+\z")


def n_syllables(word: str | Column) -> Column:
    """Groups of vowels, at least one."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.lower(_col(word)), F.lit(VOWELS), F.lit(0))))


def filter_sentences(paragraph: str | Column) -> Column:
    """The words of a paragraph without special characters and full stops."""
    kept = F.regexp_replace(_col(paragraph), rf"[^{GERMAN}0-9\-.\s]", "")
    return F.filter(F.split(kept, r"[.\n ]"), lambda w: w != "")


def regex_tokens(text: str | Column, shortest: int = 3) -> Column:
    """Lower-cased runs of letters, _ and - of a least length."""
    return F.filter(F.split(F.lower(_col(text)), f"[^{GERMAN.lower()}_\\-]+"), lambda w: F.length(w) >= shortest)


def without_stop_words(tokens: str | Column, stop: list[str]) -> Column:
    """Tokens that are no stop words, whatever their case; repeated tokens stay."""
    listed = F.array(*[F.lit(w) for w in sorted({w.lower() for w in stop})]) if stop else F.array().cast("array<string>")
    return F.filter(_col(tokens), lambda w: ~F.array_contains(listed, F.lower(w)))


def embedding_sentences(text: str | Column) -> Column:
    """One list of lower-cased words longer than two characters a sentence."""
    kept = F.regexp_replace(_col(text), rf"[^{GERMAN}0-9.\s]", "")
    words = F.transform(F.filter(F.split(kept, r"\."), lambda s: s != ""), lambda s: F.filter(F.split(F.lower(s), r"\s+"), lambda w: F.length(w) > 2))
    return F.filter(words, lambda s: F.size(s) > 0)


def name_pattern(first: str, last: str, short: str = "", title: str = "") -> tuple[str, str]:
    """(pattern, surname) by which the forms of a person's name are put as the surname alone.

    Forms are first name and surname, initial and surname, the surname, each perhaps after the title, and
    the short form; a genitive ending goes too. Surnames of three and more words are written as one.
    """
    words = last.split()
    surname = "".join(words) if len(words) > 2 else last
    body = r"\s*".join(map(re.escape, words))
    given = rf"(?:{re.escape(first)}|{re.escape(first[0])}\.)"
    front = rf"(?:{re.escape(title)}\s*)?" if title else ""
    forms = [rf"{front}(?:{given}\s*)?{body}(?:e)?(?:s)?"]
    if short:
        forms.append(re.escape(short))
    pattern = rf"(?is)(?<![{GERMAN}0-9])(?:{'|'.join(forms)})(?![{GERMAN}0-9])"
    return pattern, surname[0].upper() + surname[1:].lower()


def normalise_names(text: str | Column, people: list[tuple[str, str, str, str]]) -> Column:
    """Every form of the names of people (first, last, short, title) becomes the surname."""
    out = _col(text)
    for person in people:
        pattern, surname = name_pattern(*person)
        out = F.regexp_replace(out, pattern, surname)
    return out


def documents_of(file_text: str | Column) -> Column:
    """array<struct(meta map, content)> of the <doc ...> elements of a file; of repeated attributes the last counts."""
    whole = F.regexp_extract_all(_col(file_text), F.lit(r"(?s)<doc [^>]*?>.*?</doc>"), F.lit(0))
    return F.transform(whole, lambda d: F.struct(attributes(F.regexp_extract(d, r"(?s)^<doc ([^>]*?)>", 1)).alias("meta"), F.regexp_extract(d, r"(?s)^<doc [^>]*?>(.*)</doc>$", 1).alias("content")))


def attributes(head: str | Column) -> Column:
    """map of key="value" pairs; of repeated keys the last counts."""
    keys = F.regexp_extract_all(_col(head), F.lit(r'([^=\s]*)="([^"]*)"'), F.lit(1))
    values = F.regexp_extract_all(_col(head), F.lit(r'([^=\s]*)="([^"]*)"'), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(keys, p["i"] + 2, F.greatest(F.size(keys) - p["i"] - 1, F.lit(0))), lambda k: k == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


def paragraphs_of(content: str | Column) -> Column:
    return F.regexp_extract_all(_col(content), F.lit(r"(?s)<p>(.*?)</p>"), F.lit(1))


def markup_pieces(text: str | Column) -> Column:
    """Tags and the stretches between them, in order; joined they are the text."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?s)<[^>]+>|<|[^<]+"), F.lit(0))


def iso_date(value: str | Column, missing: str = "0001-01-01") -> Column:
    """The date of an ISO time stamp; what is none becomes the given date."""
    return F.coalesce(F.try_to_date(F.split(_col(value), "T")[0]), F.lit(missing).cast("date"))


def padded(values: str | Column, length: int) -> Column:
    """A list of counts, filled up with zeros in front."""
    values = F.coalesce(_col(values), F.array().cast("array<bigint>"))
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(length) - F.size(values), F.lit(0))), values)
