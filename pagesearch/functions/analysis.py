"""Analysis data: stop words and suffix rules per language, as tables.

FIXED VALUES below are our own short lists (the contract of D02/D03): the
stop words and the suffix rules.  A suffix rule ``(suffix, replacement,
excluded endings)`` applies when the term ends with ``suffix``, does not end
with any excluded ending and the result (stem plus replacement) keeps at
least ``MIN_STEM`` characters; of the rules that apply the longest suffix wins.  The English
rules are the plural s-stemmer of Harman (1991).
"""

from __future__ import annotations

MIN_STEM = 3

# FIXED VALUES: stop words per language.
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was with",
    "fr": "au aux de des du elle en est et il la le les ou par pour qui que sur un une",
    "de": "auf das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "es": "al con de del el en es la las lo los no para por que se su un una y",
    "it": "che di e il in la le per un una",
    "pt": "a da de do e em o os que um uma",
    "nl": "de een en het in is van",
}

# FIXED VALUES: suffix rules per language: (suffix, replacement, excluded endings).
SUFFIX_RULES = {
    "en": [("ies", "y", ["eies", "aies"]), ("es", "e", ["aes", "ees", "oes"]), ("s", "", ["us", "ss"])],
    "fr": [("eaux", "eau", []), ("aux", "al", []), ("s", "", ["ss"]), ("x", "", [])],
    "de": [("ern", "", []), ("en", "", []), ("er", "", []), ("es", "", []), ("e", "", []), ("s", "", ["ss"])],
    "es": [("es", "", []), ("s", "", [])],
    "it": [("i", "o", []), ("e", "a", [])],
    "pt": [("ões", "ão", []), ("s", "", [])],
    "nl": [("en", "", []), ("s", "", [])],
}


def stop_rows(stops: dict[str, str] | None = None) -> list[tuple[str, str]]:
    stops = STOP_WORDS if stops is None else stops
    return [(lang, w) for lang, words in stops.items() for w in words.split()]


def rule_rows(rules: dict[str, list] | None = None) -> list[tuple[str, str, str, list[str]]]:
    rules = SUFFIX_RULES if rules is None else rules
    return [(lang, s, r, list(ex)) for lang, rs in rules.items() for s, r, ex in rs]
