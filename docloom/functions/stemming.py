"""Porter's suffix stripping (M. F. Porter, An algorithm for suffix stripping, Program 14(3), 1980) as a table of rules and an Arrow function.

Words of other than the letters a-z, and words of one or two letters, stay as they are; null stays null.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Rules of the published algorithm (fixed values): suffix and what takes its place. In each step the longest suffix that a word has decides.
PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
DERIVED_1 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
DERIVED_2 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
ENDINGS = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for each vowel and c for each other letter; y is a vowel after a letter that is none."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or letter == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    """Number of times that letters after a vowel follow it: m in [C](VC)^m[V]."""
    return _shape(stem).count("vc")


def _short_end(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double_end(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _shape(stem).endswith("c")


def _replaced(word: str, rules, least: int) -> str:
    """The longest suffix among the rules is replaced if what is before it has a measure over ``least``."""
    found = max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)
    if found is None:
        return word
    stem = word[: len(word) - len(found[0])]
    return stem + found[1] if _measure(stem) > least else word


def stem(word: str | None) -> str | None:
    """The stem of a word in small letters."""
    if word is None or len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    word = _replaced(word, PLURALS, -1)
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for ending in ("ed", "ing"):
            if word.endswith(ending) and "v" in _shape(word[: -len(ending)]):
                word = word[: -len(ending)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double_end(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, DERIVED_1, 0), DERIVED_2, 0)
    ending = max((e for e in ENDINGS if word.endswith(e)), key=len, default="")
    rest = word[: len(word) - len(ending)]
    if ending and _measure(rest) > 1 and (ending != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stems(batches):
    import pyarrow as pa

    for rows in batches:
        yield pa.RecordBatch.from_arrays([rows["term"], pa.array([stem(t) for t in rows["term"].to_pylist()], pa.string())], ["term", "stem"])


def stem_table(terms: DataFrame) -> DataFrame:
    """(term, stem) of each distinct term: a vocabulary is stemmed once, not every word of every text."""
    return terms.select("term").distinct().mapInArrow(_stems, "term string, stem string")
