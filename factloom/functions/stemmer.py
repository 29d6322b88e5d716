"""The published English suffix stemmer (second version of Porter's algorithm).

A word has two regions: R1 is what follows the first consonant after a vowel,
R2 the same within R1. A suffix goes or changes only where it lies in the
region that its step names. Words are given in lower case and without
apostrophes, as the lexical index cuts them.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the algorithm.
VOWELS = "aeiouy"
LI_ENDINGS = "cdeghkmnrt"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Where R1 begins after these starts of words.
STARTS = ("gener", "commun", "arsen")
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Left alone once the plural is off.
SETTLED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Suffixes in R1 and what they become.
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
SHORTENED = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Suffixes that go in R2.
DROPPED = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT_SYLLABLE = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
_REGION, _SHORT, _HIDDEN, _PLURAL = re.compile(REGION), re.compile(SHORT_SYLLABLE), re.compile("([aeiouy])y"), re.compile("[aeiouy].+s$", re.DOTALL)


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _region(word: str, at: int) -> int:
    m = _REGION.match(word, at)
    return m.end() if m else len(word)


def _has_vowel(word: str) -> bool:
    return any(c in VOWELS for c in word)


def _past_and_progressive(w: str, r1: int) -> str:
    suffix = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    base = w[: len(w) - len(suffix)]
    if suffix.startswith("ee"):
        return base + "ee" if len(base) >= r1 else w
    if not suffix or not _has_vowel(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(DOUBLES):
        return base[:-1]
    return base + "e" if len(base) == r1 and _SHORT.search(base) else base


@lru_cache(1 << 18)
def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    w = "Y" + word[1:] if word[0] == "y" else word
    w = _HIDDEN.sub(r"\1Y", w)  # a y after a vowel is a consonant
    r1 = next((len(s) for s in STARTS if w.startswith(s)), None) or _region(w, 0)
    r2 = _region(w, r1)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif not w.endswith(("us", "ss")) and _PLURAL.search(w):
        w = w[:-1]
    if w in SETTLED:
        return w
    w = _past_and_progressive(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"

    s = _longest(w, DERIVED)
    base = w[: len(w) - len(s)]
    if s and len(base) >= r1 and not (s == "li" and base[-1:] not in LI_ENDINGS) and not (s == "ogi" and not base.endswith("l")):
        w = base + DERIVED[s]
    s = _longest(w, SHORTENED)
    base = w[: len(w) - len(s)]
    if s and len(base) >= (r2 if s == "ative" else r1):
        w = base + SHORTENED[s]
    s = _longest(w, DROPPED)
    base = w[: len(w) - len(s)]
    if s and len(base) >= r2 and not (s == "ion" and not base.endswith(("s", "t"))):
        w = base
    base = w[:-1]
    if w.endswith("e") and (len(base) >= r2 or len(base) >= r1 and not _SHORT.search(base)) or w.endswith("ll") and len(base) >= r2:
        w = base
    return w.replace("Y", "y")
