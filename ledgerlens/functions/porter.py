"""Porter (1980) suffix-stripping stemmer, with the refinements commonly
shipped as the default variant of the reference Python toolkit (irregular
forms, 'ies'/'ied' on four-letter words, 'y' → 'i' only after a consonant
that is not the first letter, 'bli' → 'ble', 'logi' → 'log', 'fulli' →
'ful', 'alli' → 'al' re-entering step 2). Used by the stemmed ROUGE-L.
"""

from __future__ import annotations

from functools import lru_cache

# FIXED VALUES: irregular forms mapped directly to their stem
IRREGULAR_FORMS = {
    "skies": "sky", "sky": "sky",
    "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news",
    "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning",
    "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

_VOWELS = set("aeiou")


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in _VOWELS:
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    """m in [C](VC)^m[V]."""
    m, prev_v = 0, False
    for i in range(len(stem)):
        v = not _cons(stem, i)
        if prev_v and not v:
            m += 1
        prev_v = v
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    """*o: consonant-vowel-consonant, the last not w, x or y."""
    if len(w) >= 3 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) \
            and _cons(w, len(w) - 1):
        return w[-1] not in "wxy"
    # a two-letter word vowel-consonant also counts in the refined variant
    return len(w) == 2 and not _cons(w, 0) and _cons(w, 1)


def _step1a(w: str) -> str:
    if w.endswith("ies") and len(w) == 4:
        return w[:-1]
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-2]
    if w.endswith("ss"):
        return w
    if w.endswith("s"):
        return w[:-1]
    return w


def _step1b(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    stem = None
    for suf in ("ed", "ing"):
        if w.endswith(suf) and _has_vowel(w[:-len(suf)]):
            stem = w[:-len(suf)]
            break
    if stem is None:
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double_cons(stem) and stem[-1] not in "lsz":
        return stem[:-1]
    if _measure(stem) == 1 and _cvc(stem):
        return stem + "e"
    return stem


def _step1c(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _cons(w, len(w) - 2):
        return w[:-1] + "i"
    return w


_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
    ("logi", "log"),
]
_STEP3 = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def _longest(w: str, table):
    best = None
    for suf, rep in table:
        if w.endswith(suf) and (best is None or len(suf) > len(best[0])):
            best = (suf, rep)
    return best


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-4] + "al")
    hit = _longest(w, _STEP2)
    if hit and hit[0] == "logi":        # its measure is taken with the l
        return w[:-1] if _measure(w[:-3]) > 0 else w
    if hit and _measure(w[:-len(hit[0])]) > 0:
        return w[:-len(hit[0])] + hit[1]
    return w


def _step3(w: str) -> str:
    hit = _longest(w, _STEP3)
    if hit and _measure(w[:-len(hit[0])]) > 0:
        return w[:-len(hit[0])] + hit[1]
    return w


def _step4(w: str) -> str:
    hit = _longest(w, [(s, "") for s in _STEP4])
    if not hit:
        return w
    stem = w[:-len(hit[0])]
    if _measure(stem) <= 1:
        return w
    if hit[0] == "ion" and not stem.endswith(("s", "t")):
        return w
    return stem


def _step5(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR_FORMS:
        return IRREGULAR_FORMS[w]
    if len(w) <= 2:
        return w
    w = _step1a(w)
    w = _step1b(w)
    w = _step1c(w)
    w = _step2(w)
    w = _step3(w)
    w = _step4(w)
    w = _step5(w)
    return w
