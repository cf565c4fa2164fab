"""Text normalisers, character statistics and edit distances as Spark columns.

Everything here stays inside the JVM except Unicode normal forms, case folding
and HTML entities, for which Spark has no built-in; those are Arrow functions.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespan import constants as K

WORD_CHARS = "A-Za-zçğıöşüÇĞİÖŞÜ"
# leading marks, the letters, trailing marks; neither mark run may hold digits
WORD_PATTERN = rf"^([^{WORD_CHARS}0-9]*)([{WORD_CHARS}]+)([^{WORD_CHARS}0-9]*)$"


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


# what \s stands for in a pattern with (?U)
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_ws(text: Column) -> Column:
    """Trim every kind of white space at both ends, not only blanks."""
    return F.btrim(text, F.lit(WHITE))


def dense_chars(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def strip_markup(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*>|\{\\[^}]*\}", "")


def visible_chars(text: Column) -> Column:
    return F.length(dense_chars(strip_markup(text)))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def cjk_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^　-鿿]+", ""))


def letter_ratio(text: Column) -> Column:
    return _share(letter_count(dense_chars(text)), F.length(dense_chars(text)))


def cjk_ratio(text: Column) -> Column:
    return F.when(has_cjk(text), _share(cjk_count(text) - F.length(F.regexp_replace(text, "[^\u3000]+", "")),
                                        F.length(dense_chars(text)))).otherwise(F.lit(0.0))


def cjk_majority(text: Column) -> Column:
    return cjk_count(dense_chars(text)) * 2 > F.length(dense_chars(text))


def has_cjk(text: Column) -> Column:
    return text.rlike("[　-鿿]")


def vowel_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{K.VOWELS}]+", ""))


def rep_norm(text: Column) -> Column:
    folded = F.lower(F.translate(F.coalesce(text, F.lit("")), "çÇğĞıİöÖşŞüÜ", "ccggiioossuu"))
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def tr_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def tr_upper(text: Column) -> Column:
    return F.upper(F.translate(text, K.ALPHABET, K.ALPHABET_UPPER))


def dot_norm(text: Column) -> Column:
    """Letters that differ only by a dot or cedilla become one letter."""
    return F.translate(text, "şçği", "scgı")


def core(token: Column) -> Column:
    """The word inside edge punctuation, or null when the token is not a word."""
    found = F.regexp_extract(token, WORD_PATTERN, 2)
    return F.when(found != "", found)


def edge_prefix(token: Column) -> Column:
    return F.regexp_extract(token, WORD_PATTERN, 1)


def edge_suffix(token: Column) -> Column:
    return F.regexp_extract(token, WORD_PATTERN, 3)


def is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def is_lower(word: Column) -> Column:
    return (word == F.lower(word)) & (word != F.upper(word))


def words(text: Column) -> Column:
    """White-space separated tokens; an empty text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


NEAR = 8


def char_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; a narrow band is tried first, as most pairs are near."""
    return F.coalesce(F.nullif(F.levenshtein(a, b, NEAR), F.lit(-1)), F.levenshtein(a, b))


def word_distance(a: Column, b: Column, words: Callable[[Column], Column] = words) -> Column:
    """Levenshtein distance over tokens.

    Where as many words of the first text are foreign to the second as there are
    places at which two equally long texts differ, each of those is one edit.
    Otherwise each distinct word of the pair becomes one private code point, so the
    built-in character distance counts whole words.
    """
    def encode(tokens: Column, vocabulary: Column) -> Column:
        codes = F.transform(
            tokens, lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + 0x4E00), 4, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")

    # the one-element array binds both word lists, and then their vocabulary, once per row
    bound = F.transform(F.array(F.struct(words(a).alias("a"), words(b).alias("b"))), lambda s: F.struct(
        s["a"].alias("a"), s["b"].alias("b"),
        F.when(F.size(s["a"]) == F.size(s["b"]), F.size(F.filter(F.zip_with(s["a"], s["b"], lambda x, y: x != y), lambda d: d))).alias("places"),
        F.size(F.filter(s["a"], lambda w: ~F.array_contains(s["b"], w))).alias("foreign")))
    coded = lambda s: F.get(F.transform(
        F.array(F.array_distinct(F.concat(s["a"], s["b"]))), lambda v: F.levenshtein(encode(s["a"], v), encode(s["b"], v))), F.lit(0))
    distance = F.transform(bound, lambda s: F.when(s["places"] == s["foreign"], s["places"]).otherwise(coded(s)))
    return F.when(a == b, F.lit(0)).otherwise(F.get(distance, F.lit(0)))


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFC", s).split()))


def norm_nfc(text: Column | str) -> Column:
    """NFC with collapsed white space; case is kept. A line of plain ASCII words
    is its own normal form and does not go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    other = text.rlike(r"[^ !-~]|  |\A | \z")
    return F.when(other, _nfc(F.when(other, text))).otherwise(text)


@F.pandas_udf(T.StringType())
def norm_memory(text: pd.Series) -> pd.Series:
    """NFKC, case folded, collapsed: the key under which memory entries meet."""
    return text.map(
        lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


@F.pandas_udf(T.StringType())
def norm_group(text: pd.Series) -> pd.Series:
    """NFC, collapsed, case folded: the part of a source/episode group key."""
    return text.map(
        lambda s: None if s is None else " ".join(unicodedata.normalize("NFC", s).split()).casefold())


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or "&" not in s else html.unescape(s))


def norm_qa(text: Column) -> Column:
    """Markup out, entities decoded, every blank run one space."""
    stripped = F.regexp_replace(F.regexp_replace(text, r"\{\\[^}]*\}", ""), r"<[^>]*>", "")
    return collapse_ws(F.regexp_replace(_unescape(stripped), " ", " "))
