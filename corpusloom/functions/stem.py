"""English stemmers: Porter (1980), its successor Porter2, and a light rule stemmer.

The first two follow the published descriptions of the algorithms.
"""

from __future__ import annotations

from functools import lru_cache

VOWELS = frozenset("aeiou")


def _consonants(word: str) -> list[bool]:
    out: list[bool] = []
    for i, ch in enumerate(word):
        out.append(ch not in VOWELS and not (ch == "y" and i > 0 and out[i - 1]))
    return out


def _measure(word: str) -> int:
    """The number of vowel-consonant sequences."""
    c = _consonants(word)
    return sum(1 for a, b in zip(c, c[1:]) if not a and b)


def _has_vowel(word: str) -> bool:
    return not all(_consonants(word))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonants(word)[-1]


def _cvc(word: str) -> bool:
    return len(word) > 2 and _consonants(word)[-3:] == [True, False, True] and word[-1] not in "wxy"


# Suffix tables of steps 2, 3 and 4.
PORTER_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
PORTER_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
PORTER_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        w = cut
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (PORTER_2, PORTER_3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, PORTER_4)
    if s:
        base = w[: -len(s)]
        if _measure(base) > 1 and (s != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        base = w[:-1]
        m = _measure(base)
        if m > 1 or (m == 1 and not _cvc(base)):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# Exceptions and suffix tables of Porter2.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
EXCEPTIONS_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDS = frozenset("cdeghkmnrt")
PORTER2_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
PORTER2_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
PORTER2_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
V2 = frozenset("aeiouy")


def _region(w: str, start: int) -> int:
    """After the first non-vowel that follows a vowel, from start on."""
    for i in range(start + 1, len(w)):
        if w[i] not in V2 and w[i - 1] in V2:
            return i + 1
    return len(w)


def _short_syllable(w: str) -> bool:
    if len(w) == 2:
        return w[0] in V2 and w[1] not in V2
    return len(w) > 2 and w[-3] not in V2 and w[-2] in V2 and w[-1] not in V2 and w[-1] not in "wxY"


@lru_cache(maxsize=200_000)
def porter2(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.removeprefix("'")
    chars = list(w)
    for i, ch in enumerate(chars):
        if ch == "y" and (i == 0 or chars[i - 1] in V2):
            chars[i] = "Y"
    w = "".join(chars)
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, 0) if r1 is None else r1
    r2 = _region(w, r1)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in V2 for c in w[:-2]):
        w = w[:-1]
    if w in EXCEPTIONS_1A:
        return w
    s = _longest(w, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in V2 for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_syllable(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in V2:
        w = w[:-1] + "i"
    s = _longest(w, PORTER2_2)
    if s and len(w) - len(s) >= r1:
        base = w[: -len(s)]
        if s == "ogi":
            w = base + "og" if base.endswith("l") else w
        elif s == "li":
            w = base if base and base[-1] in LI_ENDS else w
        else:
            w = base + PORTER2_2[s]
    s = _longest(w, PORTER2_3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + PORTER2_3[s]
    s = _longest(w, PORTER2_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(maxsize=200_000)
def kstem(word: str) -> str:
    """Plural, past and -ing endings only: an approximation of a lexicon-backed stemmer."""
    w = word
    if len(w) > 4 and w.endswith("ies"):
        w = w[:-3] + "y"
    elif len(w) > 3 and w.endswith("s") and not w.endswith(("ss", "us", "is")):
        w = w[:-1]
    for s in ("ing", "ed"):
        if len(w) > len(s) + 2 and w.endswith(s) and _has_vowel(w[: -len(s)]):
            base = w[: -len(s)]
            if _double(base) and base[-1] not in "lsz":
                return base[:-1]
            return base + "e" if base.endswith(("at", "bl", "iz")) or (_measure(base) == 1 and _cvc(base)) else base
    return w
