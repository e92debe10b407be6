"""English words for text search: stop words, and Porter's suffix stripping (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

#: Words that an English text search leaves out (fixed values).
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
    themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because
    as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
    should now""".split()
)

#: Suffixes and what they become where at least one vowel-consonant pair lies before them (second step), and likewise (third step): fixed values of the rule list.
SECOND = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
#: Suffixes that go where two such pairs lie before them (fourth step; ``ion`` only after s or t).
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]


def _shape(word: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _pairs(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters and those with other characters stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _pairs(word[:-3]) else word
    elif (end := _longest(word, ("ed", "ing"))) and "v" in _shape(word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif _pairs(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for rules in (SECOND, THIRD):
        if (end := _longest(word, rules)) and _pairs(word[: -len(end)]):
            word = word[: -len(end)] + rules[end]
    if (end := _longest(word, FOURTH)) and _pairs(head := word[: -len(end)]) > 1 and (end != "ion" or head[-1:] in ("s", "t")):
        word = head
    if word.endswith("e") and (_pairs(word[:-1]) > 1 or (_pairs(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _pairs(word) > 1 else word
