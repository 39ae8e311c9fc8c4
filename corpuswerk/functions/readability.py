"""Readability scores as column expressions.

Defined cases: a null count, no words or no sentences give null; the language is compared in lower
case and without blanks around it, null stands for English; an unknown language raises, or gives
null where strict is False.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base, weight of words a sentence, weight of syllables a word, by language.
FLESCH = {
    "de": (180.0, 1.0, 58.5),
    "en": (206.835, 1.015, 84.6),
    "es": (206.84, 1.02, 60.0),
    "fr": (207.0, 1.015, 73.6),
    "it": (217.0, 1.3, 60.0),
    "nl": (206.84, 0.93, 77.0),
    "ru": (206.835, 1.3, 60.1),
}
# Weights of the shares of words of three and more syllables, of the sentence length, of the
# shares of words of seven and more letters and of one syllable, and the constant, by variant.
WIENER = {
    1: (0.1935, 0.1672, 0.1297, -0.0327, -0.875),
    2: (0.2007, 0.1682, 0.1373, 0.0, -2.779),
    3: (0.2963, 0.1905, 0.0, 0.0, -1.1144),
    4: (0.2744, 0.2656, 0.0, 0.0, -1.693),
}


def _col(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(_col(a), _col(b))


def flesch_reading_ease(n_syllables: str | Column, n_words: str | Column, n_sents: str | Column, lang: str | Column, strict: bool = True) -> Column:
    code = F.coalesce(F.lower(F.btrim(F.col(lang) if isinstance(lang, str) else lang)), F.lit("en"))
    out = None
    for name, (base, per_sentence, per_word) in FLESCH.items():
        score = F.lit(base) - per_sentence * _ratio(n_words, n_sents) - per_word * _ratio(n_syllables, n_words)
        out = F.when(code == name, score) if out is None else out.when(code == name, score)
    if strict:
        return out.otherwise(F.raise_error(F.concat(F.lit("no reading ease for the language "), code)).cast("double"))
    return out


def wiener_sachtextformel(n_words: str | Column, n_poly: str | Column, n_mono: str | Column, n_long: str | Column, n_sents: str | Column, variant: int = 1) -> Column:
    if variant not in WIENER:
        raise ValueError(f"variant {variant} is none of {sorted(WIENER)}")
    poly, length, long, mono, constant = WIENER[variant]
    out = poly * 100 * _ratio(n_poly, n_words) + length * _ratio(n_words, n_sents)
    if long:
        out = out + long * 100 * _ratio(n_long, n_words)
    if mono:
        out = out + mono * 100 * _ratio(n_mono, n_words)
    return out + F.lit(constant)


def lix(n_words: str | Column, n_long: str | Column, n_sents: str | Column) -> Column:
    return _ratio(n_words, n_sents) + 100 * _ratio(n_long, n_words)


def automated_readability_index(n_chars: str | Column, n_words: str | Column, n_sents: str | Column) -> Column:
    return 4.71 * _ratio(n_chars, n_words) + 0.5 * _ratio(n_words, n_sents) - 21.43
