"""Tokens, short texts and escaping, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"[^\p{L}\p{N}-]+"


def lower(text: Column) -> Column:
    """Lower case one code point at a time: a final sigma and a dotted capital I get no special form."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def tokens(text: Column) -> Column:
    """ARRAY of words: runs of letters, digits and '-', of 3 bytes or more, not all of one character, lower case.

    Null text gives null; text without a word gives an empty array. "All of one character" is tested before lower-casing.
    """
    keep = lambda w: (F.octet_length(w) >= 3) & (F.replace(w, F.left(w, F.lit(1)), F.lit("")) != "")
    return F.transform(F.filter(F.split(text, SEPARATOR), keep), lower)


def limit_text(text: Column, n: int) -> Column:
    """At most n characters and '...'; a text of at most n bytes or n characters stays."""
    return (
        F.when(F.octet_length(text) <= n, text)
        .when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("...")))
        .otherwise(text)
    )


def escape_html(text: Column) -> Column:
    """The five characters that markup reserves, as entities."""
    for raw, entity in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text
