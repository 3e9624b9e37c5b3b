"""Porter's suffix stripping (1980) with the common later refinements.

Refinements: words of up to two letters stay; a short list of irregular words; ``-ies`` and
``-ied`` keep the e in four-letter words; y becomes i only after a consonant that does not
begin the word; ``-alli``, ``-bli``, ``-fulli`` and ``-logi`` in step 2; a two-letter
vowel-consonant stem counts as short. The irregular words and refinements are those of NLTK's
PorterStemmer in its default mode (public documentation); that library is not at hand to compare
with. The tests pin outputs, and the SQL in ``plans/oracles.py`` restates the steps independently.
"""

from __future__ import annotations

from functools import lru_cache

#: Fixed values.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"), ("logi", "log"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """One letter per letter of the word: c for consonants, v for vowels."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def measure(word: str) -> int:
    """Number of vowel-to-consonant turns."""
    return shape(word).count("vc")


def has_vowel(word: str) -> bool:
    return "v" in shape(word)


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Ends consonant-vowel-consonant with the last not w, x or y; or is vowel-consonant."""
    s = shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    cut = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and has_vowel(w[: -len(s)])), None)
    if cut is None:
        return w
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if doubled(cut):
        return cut if cut[-1] in "lsz" else cut[:-1]
    return cut + "e" if measure(cut) == 1 and short_end(cut) else cut


def _final_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and shape(w[:-1])[-1] == "c" else w


def _double_suffix(w: str) -> str:
    if w.endswith("alli") and measure(w[:-4]) > 0:
        return _double_suffix(w[:-2])
    for s, to in sorted(STEP2, key=lambda x: -len(x[0])):
        if w.endswith(s):
            of = w[:-3] if s == "logi" else w[: -len(s)]
            return w[: -len(s)] + to if measure(of) > 0 else w
    return w


def _single_suffix(w: str) -> str:
    for s, to in STEP3:
        if w.endswith(s):
            return w[: -len(s)] + to if measure(w[: -len(s)]) > 0 else w
    return w


def _last_suffix(w: str) -> str:
    for s in sorted(STEP4, key=len, reverse=True):
        if w.endswith(s):
            base = w[: -len(s)]
            return base if measure(base) > 1 and (s != "ion" or base[-1:] in ("s", "t")) else w
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        m = measure(w[:-1])
        w = w[:-1] if m > 1 or (m == 1 and not short_end(w[:-1])) else w
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    for step in (_plural, _past, _final_y, _double_suffix, _single_suffix, _last_suffix, _tidy):
        w = step(w)
    return w
