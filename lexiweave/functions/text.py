"""Columns over text: normal forms, ids, tokens, n-grams, sentences and occurrences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation that tokenisation replaces by a blank.
PUNCTUATION = r'[,.;:!?"\[\]{}()<>]'


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_punct(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, " ")


def tokens(text: Column) -> Column:
    """Lower-case tokens between punctuation and white space."""
    return F.filter(F.split(clean_punct(F.lower(text)), r"\s+"), lambda t: t != "")


def word_ngrams(toks: Column, least: int, most: int) -> Column:
    """Every slice of ``least`` to ``most`` tokens that follow one another, joined by blanks."""
    size = F.size(toks)
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*(of(n) for n in range(least, most + 1))))


def ngram_id(label: Column) -> Column:
    """Hex SHA-256 of the lower-case tokens joined by blanks, characters beyond ASCII as question marks."""
    return F.sha2(F.regexp_replace(F.lower(label), r"[^\x00-\x7F]", "?"), 256)


def clean_id(value: Column) -> Column:
    return F.regexp_replace(value, r"[^a-zA-Z0-9_\-]", "")


def select_content(*fields: Column) -> Column:
    """The fields in order, each after " . "; null fields are left out."""
    return F.concat_ws("", *(F.concat(F.lit(" . "), f) for f in fields))


def sentences(text: Column) -> Column:
    """Sentences of European text: cut after . ! ? before a capital or opening mark; none crosses a field."""
    marked = F.regexp_replace(strip(text), r"([.!?][\"')\]]*)\s+(?=[\"'(\[]*\p{Lu})", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.length(F.trim(s)) > 0)


def treebank_tokens(sentence: Column) -> Column:
    """Words and punctuation apart, clitics and the final period cut off."""
    s = F.regexp_replace(sentence, r"([,;:@#$%&?!\"()\[\]{}<>]|--|\.\.\.)", " $1 ")
    s = F.regexp_replace(s, r"([^.])\.([\"')\]]*)\s*$", "$1 . $2")
    s = F.regexp_replace(s, r"('s|'S|'m|'M|'d|'D|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T)(?=\s|$)", " $1")
    return F.filter(F.split(s, r"\s+"), lambda t: t != "")


def occurrences(text: Column, form: str) -> Column:
    """How often a form stands as a whole in a text, whatever its case."""
    return F.regexp_count(text, F.lit(r"(?i)\b\Q" + form.replace(r"\E", r"\E\\E\Q") + r"\E\b"))
