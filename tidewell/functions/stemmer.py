"""English stemming by the published Porter2 (Snowball English) rules, as an Arrow UDF over token lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published algorithm.
EXCEPTIONS = dict(
    skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl",
    sky="sky", news="news", howe="howe", atlas="atlas", cosmos="cosmos", bias="bias", andes="andes",
)
STAY = frozenset("inning outing canning herring earring proceed exceed succeed".split())
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
    ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"),
    ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
VOWEL = "[aeiouy]"


def _after(word: str, start: int) -> int:
    """The place after the first consonant that follows a vowel, from start on."""
    m = re.compile(f"{VOWEL}[^aeiouy]").search(word, start)
    return m.end() if m else len(word)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii():
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    w = word.lstrip("'")
    w = re.sub(r"(^|(?<=[aeiouy]))y", "Y", w)
    special = re.match(r"gener|commun|arsen", w)
    r1 = special.end() if special else _after(w, 0)
    r2 = _after(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(VOWEL, w[:-2]):
        w = w[:-1]
    if w in STAY:
        return w
    # 1b
    if m := re.search(r"(eedly|eed)$", w):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif (m := re.search(r"(ingly|edly|ing|ed)$", w)) and re.search(VOWEL, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif _short_end(w) and r1 >= len(w):
            w += "e"
    # 1c
    w = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", w)
    for suffix, to in STEP2:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + to
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in "cdeghkmnrt":
            w = w[:-2]
    for suffix, to in STEP3:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r1:
                w = w[: -len(suffix)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for suffix in STEP4:
        if w.endswith(suffix):
            if len(w) - len(suffix) >= r2:
                w = w[: -len(suffix)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_all(tokens: Column) -> Column:
    """Stems of an array of tokens; a worker remembers the words it has seen in a batch."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        known: dict[str, str] = {}

        def one(w: str) -> str:
            if w not in known:
                known[w] = stem(w)
            return known[w]

        return lists.map(lambda x: None if x is None else [one(w) for w in x])

    return run(tokens)
