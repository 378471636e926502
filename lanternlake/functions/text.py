"""Text primitives. Unicode normal forms need Arrow UDFs; everything else is built-in functions."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

WORDS = r"(?U)\w+"
LEXICAL = r"(?U)\w+(?:[-_.]\w+)*"


class _Bare(dict):
    """Characters without combining marks, and đ as d; filled as characters are met."""

    def __missing__(self, c: str):
        self[c] = "" if unicodedata.category(c) == "Mn" else {"đ": "d", "Đ": "D"}.get(c, c)
        return self[c]


_BARE, _OTHER = _Bare(), re.compile(r"[^\x00-\x7f]")


def fold(text: str | None) -> str:
    """Without combining marks, đ as d, caseless; white space stays."""
    if not text or text.isascii():
        return (text or "").lower()
    text = unicodedata.normalize("NFD", text)
    # A text has few kinds of such characters, so it is gone through once for each and not by character.
    for c in set(_OTHER.findall(text)):
        if _BARE[c] != c:
            text = text.replace(c, _BARE[c])
    return text.casefold()


def squeeze(text: str) -> str:
    return " ".join(text.split())


@F.pandas_udf(StringType())
def fold_raw(text: pd.Series) -> pd.Series:
    """``fold`` of a column; null becomes the empty string."""
    return text.map(fold)


@F.pandas_udf(StringType())
def fold_ws(text: pd.Series) -> pd.Series:
    """``fold`` with runs of white space as one space and none at the ends."""
    return text.map(lambda t: squeeze(fold(t)))


_MARKS = {point: None for point in range(0x300, 0x370)} | {ord("đ"): "d", ord("Đ"): "D"}


@F.pandas_udf(StringType())
def fold_ui(text: pd.Series) -> pd.Series:
    """What a search box compares: without the marks U+0300 to U+036F, đ as d, lower case; ß and other marks stay."""
    return text.map(lambda t: unicodedata.normalize("NFD", t or "").translate(_MARKS).lower())


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t or ""))


@F.pandas_udf(StringType())
def nfc_caseless(text: pd.Series) -> pd.Series:
    """Composed and caseless; the form that exact lexical tokens are cut from."""
    return text.map(lambda t: unicodedata.normalize("NFC", t or "").casefold())


def normalize_query(text: Column) -> Column:
    """Composed, controls and no-break spaces as spaces, single spaces, trimmed."""
    plain = F.regexp_replace(F.replace(nfc(text), F.lit("\u00a0"), F.lit(" ")), r"[\x00-\x1f\x7f]+", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def clean_page(text: pd.Series) -> pd.Series:
    """Lines with single blanks, trimmed, without empty ones; no-break spaces are spaces; null becomes the empty string."""

    def clean(t: str | None) -> str:
        lines = unicodedata.normalize("NFC", t or "").replace("\u00a0", " ").replace("\t", " ").splitlines()
        return "\n".join([x for line in lines if (x := " ".join([w for w in line.split(" ") if w]))])

    return text.map(clean)


def page_text(text: Column) -> Column:
    """Raw page text with plain spaces, pairs of line feeds as one (in a single pass), stripped."""
    plain = F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\n\n"), F.lit("\n"))
    return F.regexp_replace(plain, r"(?U)\A\s+|\s+\z", "")


def channel_tokens(text: Column) -> Column:
    """Bag of lexical tokens of two or more characters, as written (``raw:``) and folded (``fold:``)."""
    cut = lambda t, name: F.transform(
        F.filter(F.regexp_extract_all(t, F.lit(LEXICAL), 0), lambda x: F.length(x) > 1), lambda x: F.concat(F.lit(name), x)
    )
    return F.concat(cut(nfc_caseless(text), "raw:"), cut(fold_raw(nfc_caseless(text)), "fold:"))


# Retrieval stop words that a folded token can equal.
STOPWORDS = ("cho", "khi", "sinh", "trong")


def token_set(folded: Column) -> Column:
    """Distinct words of two or more characters of a folded text, without stop words."""
    words = F.regexp_extract_all(folded, F.lit(WORDS), 0)
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) > 1) & ~x.isin(*STOPWORDS)))


CLAIM_TOKEN = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*"
# Words without meaning for claims.
CLAIM_STOPWORDS = (
    "ai bao bi cach can co con cua cho duoc gi hay hien huong khi la lam mot nao nhu nhung phai sau su tai theo thi"
    " trong truoc va ve voi"
).split()


def claim_tokens(folded: Column) -> Column:
    """Ordered tokens of two or more characters without claim stop words."""
    return F.filter(F.regexp_extract_all(folded, F.lit(CLAIM_TOKEN), 0), lambda x: (F.length(x) > 1) & ~x.isin(*CLAIM_STOPWORDS))


def bigrams(tokens: Column) -> Column:
    """Distinct neighbouring pairs, each as one string."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


# Product terms that identify a question, and the shape of other identifiers.
DOMAIN_TERMS = ("eos", "eosclient", "pea", "pealogin", "e360", "usb", "fu-exam", "wifi", "wi-fi")
IDENTIFIER = r"(?U)(?<!\w)(?:[A-Za-z]{1,12}[-_.]?[A-Za-z0-9]*\d+[A-Za-z0-9_.-]*|[0-9]{3,})(?!\w)"


def identifiers(text: Column, folded: Column) -> Column:
    """Codes and long numbers as written, caseless, and the domain terms that ``folded`` contains."""
    codes = F.transform(F.regexp_extract_all(text, F.lit(IDENTIFIER), 0), F.lower)
    terms = F.filter(F.array(*(F.lit(t) for t in DOMAIN_TERMS)), lambda t: F.contains(folded, t))
    return F.array_sort(F.array_distinct(F.concat(codes, terms)))


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two character sequences; 0 where one is null."""
    return pd.Series([0.0 if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)])
