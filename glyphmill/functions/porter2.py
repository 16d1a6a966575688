"""The English Snowball stemmer (Porter2), from its published description."""

from __future__ import annotations

import re

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"),
    ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"),
    ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
    ("ogi", "og"), ("li", ""),
]
_STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""),
    ("ful", ""),
]
_STEP4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic",
]


def _region(word: str, start: int) -> int:
    m = re.compile(rf"[{_V}][^{_V}]").search(word, start)
    return m.end() if m else len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _V and word[1] not in _V
    return len(word) > 2 and word[-3] not in _V and word[-2] in _V and word[-1] not in _V + "wxY"


def stem(word: str) -> str:
    """Stem of a word; the result is in lower case."""
    word = word.lower().replace("’", "'").replace("‘", "'").replace("‛", "'")
    if len(word) <= 2:
        return word
    if word in _SPECIAL:
        return _SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub(rf"(^|(?<=[{_V}]))y", "Y", word)
    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(word, 0)
    r2 = _region(word, r1)

    for s in ("'s'", "'s", "'"):
        if word.endswith(s):
            word = word[: -len(s)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _V for c in word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if word.endswith(s):
            if s in ("eedly", "eed"):
                if len(word) - len(s) >= r1:
                    word = word[: -len(s)] + "ee"
            elif any(c in _V for c in word[: -len(s)]):
                word = word[: -len(s)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif word.endswith(_DOUBLE):
                    word = word[:-1]
                elif r1 >= len(word) and _short_end(word):
                    word += "e"
            break
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _V:
        word = word[:-1] + "i"
    # 2 and 3: the longest suffix that ends the word decides, even where it doesn't apply
    for s, to in _STEP2:
        if word.endswith(s):
            if len(word) - len(s) >= r1:
                before = word[: -len(s)]
                if not (s == "ogi" and not before.endswith("l") or s == "li" and before[-1:] not in tuple("cdeghkmnrt")):
                    word = before + to
            break
    for s, to in _STEP3:
        if word.endswith(s):
            if len(word) - len(s) >= (r2 if s == "ative" else r1):
                word = word[: -len(s)] + to
            break
    for s in _STEP4:
        if word.endswith(s):
            if len(word) - len(s) >= r2 and (s != "ion" or word[-4:-3] in ("s", "t")):
                word = word[: -len(s)]
            break
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or len(word) - 1 >= r1 and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
