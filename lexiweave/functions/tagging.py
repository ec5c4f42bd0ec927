"""Part-of-speech tags by ordered rules, and predicates over tags and tokens."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the rule tagger in order, the grammar of noun phrases over tags, and the words and tags of
# the rules. The punctuation is written as ranges of ASCII, which Java and RE2 both take; a backslash is none of it.
WORD_PATTERNS = (
    (r"^-?[0-9]+(.[0-9]+)?$", "CD"),
    (r"^.*ould$", "MD"),
    (r"^.*ing$", "VBG"),
    (r"^.*ed$", "VBD"),
    (r"^.*ness$", "NN"),
    (r"^.*ment$", "NN"),
    (r"^.*ful$", "JJ"),
    (r"^.*ious$", "JJ"),
    (r"^.*ble$", "JJ"),
    (r"^.*ic$", "JJ"),
    (r"^.*ive$", "JJ"),
    (r"^.*est$", "JJ"),
    (r"^a$", "PREP"),
    (r"^[!-/:-@\[\]-`{-~]", "PUN"),
)
POSTAG_VALID = (
    r"^((VBD,|VBG,|VBN,|CD.?,|JJ.?,|\?,){0,2}?(N.?.?,|\?,)+?(CD.,)??)+?((PREP.?|DET.?,|IN.?,|CC.?,|\?,)((VBD,|VBG,|VBN,|CD.?,|JJ.?,|\?,){0,2}?(N.?.?,|\?,)+?)+?)*?$"
)
CONTENT_RULES = {"any": ("",), "both": ("by", "in", "of", "a", "have", "is", "are", "or", "and"), "begin": (), "end": ()}
TAG_RULES = {
    "any": ("PUN", "SENT"),
    "both": ("VB", "VDB", "VBP", "VBZ", "DT", "CC", "TO", "IN", "WDT", "WP", "WRB", "PRP", "EX", "MD", "UH"),
    "begin": ("POS",),
    "end": (),
}


def tag(token: Column) -> Column:
    """The tag of the first rule that holds, ``?`` where none does."""
    out = None
    for pattern, name in WORD_PATTERNS:
        out = (F.when if out is None else out.when)(token.rlike(pattern), name)
    return out.otherwise("?")


# Java's dot takes no line end of any kind, and its dollar stands before one at the end too.
_LINE_ENDS = "\n\r\u0085\u2028\u2029"
_WORD_RULES = [(re.compile(p.replace(".*", f"[^{_LINE_ENDS}]*").replace("(.[", f"([^{_LINE_ENDS}][").replace("$", f"(?=(?:\r\n|[{_LINE_ENDS}])?\\Z)")), name) for p, name in WORD_PATTERNS]


def tag_word(word: str) -> str:
    """``tag`` of one word."""
    return next((name for rule, name in _WORD_RULES if rule.search(word)), "?")


def postag_valid(tags: Column, grammar: str = POSTAG_VALID) -> Column:
    return F.concat(F.concat_ws(",", tags), F.lit(",")).rlike(grammar)


def passes_rules(values: Column, rules: dict[str, tuple[str, ...]] = CONTENT_RULES) -> Column:
    """No value among ``any``; neither end among ``both``; the first not among ``begin``, the last not among ``end``."""
    first, last = F.get(values, 0), F.element_at(values, -1)
    ok = F.size(values) > 0
    if rules["any"]:
        ok = ok & ~F.arrays_overlap(values, F.array(*map(F.lit, rules["any"])))
    for at, names in ((first, (*rules["both"], *rules["begin"])), (last, (*rules["both"], *rules["end"]))):
        if names:
            ok = ok & ~at.isin(*names)
    return ok


def min_word_size(toks: Column, least: int) -> Column:
    return F.forall(toks, lambda t: F.length(t) >= least)


def all_of(predicates: Iterable[Column]) -> Column:
    """A chain of filters as one predicate."""
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out
