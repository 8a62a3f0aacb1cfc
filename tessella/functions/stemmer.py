"""The published Snowball English stemmer (Porter2), from its public description."""

from __future__ import annotations

import re
from functools import lru_cache

#: English stop words of the Snowball project.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
#: Special forms, doubles and endings of the published algorithm.
_EXCEPTIONS = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl", sky="sky", news="news", howe="howe", atlas="atlas", cosmos="cosmos", bias="bias", andes="andes")
_STAYS = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_DOUBLES = frozenset("bb dd ff gg mm nn pp rr tt".split())
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()
_VOWEL = "aeiouy"


def _regions(word: str) -> tuple[int, int]:
    m = re.match(r"(gener|commun|arsen)", word)
    first = m.end() if m else (m.end() if (m := re.search(r"[aeiouy][^aeiouy]", word)) else len(word))
    second = first + m.end() if (m := re.search(r"[aeiouy][^aeiouy]", word[first:])) else len(word)
    return first, second


def _short_end(word: str) -> bool:
    return bool(re.search(r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


def _step1(word: str) -> str:
    for end in ("'s'", "'s", "'"):
        if word.endswith(end):
            word = word[: -len(end)]
            break
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in _STAYS:
        return word
    first, _ = _regions(word)
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(end):
            if end in ("eed", "eedly"):
                return word[: -len(end)] + "ee" if len(word) - len(end) >= first else word
            base = word[: -len(end)]
            if not re.search(r"[aeiouy]", base):
                return word
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if base[-2:] in _DOUBLES:
                return base[:-1]
            return base + "e" if _short_end(base) and _regions(base)[0] >= len(base) else base
    return word


def _replace(word: str, rules: list[tuple[str, str]], first: int, second: int) -> str:
    for end, new in rules:
        if word.endswith(end):
            at = len(word) - len(end)
            if at < first or end == "ogi" and word[at - 1 : at] != "l" or end == "li" and word[at - 1 : at] not in tuple("cdeghkmnrt") or end == "ative" and at < second:
                return word
            return word[:at] + new
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    word = word.lstrip("'") if word.startswith("'") else word
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    word = _step1(word)
    if word in _STAYS:
        return word
    word = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", word)
    first, second = _regions(word)
    word = _replace(word, _STEP2, first, second)
    word = _replace(word, _STEP3, first, second)
    for end in _STEP4:
        if word.endswith(end):
            at = len(word) - len(end)
            if at >= second and (end != "ion" or word[at - 1 : at] in ("s", "t")):
                word = word[:at]
            break
    if word.endswith("e") and (len(word) - 1 >= second or len(word) - 1 >= first and not _short_end(word[:-1])) or word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()
