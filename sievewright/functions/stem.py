"""The Porter stemmer with the usual later extensions (irregular forms, -bli, -logi, short words kept)."""

from __future__ import annotations

from functools import lru_cache

#: Forms that the rules would miss.
IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
#: Suffix tables of steps 2, 3 and 4.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """A consonant-vowel pattern of the word, a letter for a letter."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _closed(word: str) -> bool:
    """Ends consonant-vowel-consonant, the last not w, x or y; or is a vowel and a consonant."""
    s = _shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def _replace_first(word: str, table, least: int) -> str:
    for suffix, new in table:
        if word.endswith(suffix):
            base = word[: len(word) - len(suffix)]
            return base + new if _measure(base) >= least else word
    return word


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    # plurals
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # -ed, -ing
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            base = w[: len(w) - len(suffix)]
            if w.endswith(suffix) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    w = base + "e"
                elif len(base) > 1 and base[-1] == base[-2] and _shape(base)[-1] == "c" and base[-1] not in "lsz":
                    w = base[:-1]
                elif _measure(base) == 1 and _closed(base):
                    w = base + "e"
                else:
                    w = base
                break
    # final y after a consonant that is not the first letter
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = _second(w[:-2])
    else:
        w = _second(w)
    w = _replace_first(w, STEP3, 1)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: len(w) - len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _closed(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _second(w: str) -> str:
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    return _replace_first(w, STEP2, 1)
