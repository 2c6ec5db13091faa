"""Stemmers in Python, applied to distinct words only: Porter's of 1980 with the usual later extensions, and his English one of the Snowball
project (Porter 2), both after their published descriptions."""

from __future__ import annotations

# Words that the rules get wrong.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Endings and what replaces them, where the rest has a measure above 0 (steps 2 and 3) or 1 (step 4).
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"),
    ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


LONGEST_FIRST = {2: sorted(STEP2, key=lambda r: -len(r[0])), 3: sorted(STEP3, key=lambda r: -len(r[0])), 4: sorted(STEP4, key=len, reverse=True)}


def _shape(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel after a consonant."""
    out = []
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    shape = _shape(word)
    return (len(word) > 2 and shape[-3:] == "cvc" and word[-1] not in "wxy") or (len(word) == 2 and shape == "vc")


def _by_ending(word: str, rules, least: int) -> str:
    for ending, new in rules:
        if word.endswith(ending):
            rest = word[: len(word) - len(ending)]
            return rest + new if _measure(rest) > least else word
    return word


def porter(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    # 1a
    if word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        ending = next((e for e in ("ed", "ing") if word.endswith(e) and "v" in _shape(word[: -len(e)])), None)
        if ending:
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word):
                word = word if word[-1] in "lsz" else word[:-1]
            elif _measure(word) == 1 and _short(word):
                word += "e"
    # 1c
    if word.endswith("y") and len(word) > 2 and _shape(word)[-2] == "c":
        word = word[:-1] + "i"
    # 2
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        word = _by_ending(word[:-2], LONGEST_FIRST[2], 0)
    elif word.endswith("logi"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        word = _by_ending(word, LONGEST_FIRST[2], 0)
    word = _by_ending(word, LONGEST_FIRST[3], 0)
    # 4
    for ending in LONGEST_FIRST[4]:
        if word.endswith(ending):
            rest = word[: -len(ending)]
            if _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    # 5
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _short(rest)):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


# -- English of the Snowball project

# Words with a stem of their own; words that step 1a leaves as they are; beginnings that R1 follows.
OWN_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_AS_THEY_ARE = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = ("gener", "commun", "arsen")
# Endings of steps 2 and 3 (in R1) and what replaces them, and of step 4 (in R2).
ENGLISH2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
ENGLISH3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
ENGLISH4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_VOWELS = "aeiouy"


def _region(word: str, at: int) -> int:
    """The place after the first consonant that follows a vowel, from `at` on."""
    for i in range(at + 1, len(word)):
        if word[i] not in _VOWELS and word[i - 1] in _VOWELS:
            return i + 1
    return len(word)


def _short_syllable(word: str) -> bool:
    """Whether a word ends in a vowel between consonants (the last no w, x or Y), or is a vowel and a consonant."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


def english(word: str) -> str:
    word = word.lower().replace("\u2019", "'").removeprefix("'")
    if len(word) <= 2:
        return word
    if word in OWN_STEMS:
        return OWN_STEMS[word]
    marked = ""  # a y that is a consonant is written Y
    for c in word:
        marked += "Y" if c == "y" and (not marked or marked[-1] in _VOWELS) else c
    word = marked
    start = next((len(b) for b in BEGINNINGS if word.startswith(b)), None)
    r1 = start if start is not None else _region(word, 0)
    r2 = _region(word, r1)
    # 0
    for ending in ("'s'", "'s", "'"):
        if word.endswith(ending):
            word = word[: -len(ending)]
            break
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in LEFT_AS_THEY_ARE:
        return word
    # 1b
    ending = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if word.endswith(e)), None)
    if ending in ("eed", "eedly"):
        if len(word) - len(ending) >= r1:
            word = word[: -len(ending)] + "ee"
    elif ending and any(c in _VOWELS for c in word[: -len(ending)]):
        word = word[: -len(ending)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif len(word) <= r1 and _short_syllable(word):
            word += "e"
    # 1c
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # 2
    for ending, new in ENGLISH2:
        if word.endswith(ending):
            rest = word[: -len(ending)]
            fits = {"ogi": rest.endswith("l"), "li": rest[-1:] in tuple("cdeghkmnrt")}.get(ending, True)
            if len(rest) >= r1 and fits:
                word = rest + new
            break
    # 3
    for ending, new in ENGLISH3:
        if word.endswith(ending):
            rest = word[: -len(ending)]
            if len(rest) >= (r2 if ending == "ative" else r1):
                word = rest + new
            break
    # 4
    for ending in ENGLISH4:
        if word.endswith(ending):
            rest = word[: -len(ending)]
            if len(rest) >= r2 and (ending != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    # 5
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_syllable(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()
