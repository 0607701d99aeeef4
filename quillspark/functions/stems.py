"""Words of a full-text index: folded letters and digits, and English stems by Porter's published algorithm (1980)."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

#: Suffixes of the published steps 2 and 3 with what takes their place, and those that step 4 drops.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Words of other lengths stay as they are.
LEAST, MOST = 3, 63
WORDS = re.compile(r"[^\W_]+")
_KINDS = {ord(x): "v" if x in "aeiou" else "c" for x in "abcdefghijklmnopqrstuvwxyz"}
_ASCII = re.compile("[a-z]+")
_LONGEST = {name: sorted(x, key=len, reverse=True) for name, x in (("2", STEP_2), ("3", STEP_3), ("4", STEP_4))}
_ENDS = {step: tuple(x) for step, x in _LONGEST.items()}


def shape(stem: str) -> str:
    """The stem's letters as consonants (c) and vowels (v); y is a vowel after a consonant."""
    if "y" not in stem:
        return stem.translate(_KINDS)
    out = ""
    for x in stem:
        out += "v" if x in "aeiou" or x == "y" and out[-1:] == "c" else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return shape(stem).count("vc")


def short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last one not w, x or y."""
    return shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def swapped(word: str, step: str, table: dict[str, str]) -> str:
    if not word.endswith(_ENDS[step]):
        return word
    for suffix in _LONGEST[step]:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if measure(stem) > 0 else word
    return word


@lru_cache(1 << 17)
def stem(word: str) -> str:
    """The Porter stem of a lower-case ASCII word; any other word is returned as it is."""
    if not LEAST <= len(word) <= MOST or not _ASCII.fullmatch(word):
        return word
    # 1a: plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: -eed, -ed, -ing
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix):
                base = word[: -len(suffix)]
                if "v" in shape(base):
                    if base.endswith(("at", "bl", "iz")):
                        base += "e"
                    elif base[-1] == base[-2:-1] and shape(base)[-1] == "c" and base[-1] not in "lsz":
                        base = base[:-1]
                    elif measure(base) == 1 and short_end(base):
                        base += "e"
                    word = base
                break
    # 1c: y to i
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = swapped(swapped(word, "2", STEP_2), "3", STEP_3)
    for suffix in _LONGEST["4"] if word.endswith(_ENDS["4"]) else ():
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                word = base
            break
    # 5a, 5b: a last e, and double l
    if word.endswith("e"):
        base = word[:-1]
        if measure(base) > 1 or measure(base) == 1 and not short_end(base):
            word = base
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


@lru_cache(1 << 17)
def folded(word: str) -> str:
    """Lower case without diacritics."""
    if word.isascii():
        return word.lower()
    return "".join(x for x in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(x))


def index_terms(text: str) -> list[str]:
    """Stems of all words of a text, in order."""
    return [stem(folded(x)) for x in WORDS.findall(text)]


def term_counts(text: str) -> tuple[int, dict[str, int]]:
    """How many words a text has, and how often each stem, by first occurrence; each spelling is folded and stemmed once."""
    words = WORDS.findall(text)
    held: dict[str, int] = {}
    for word, n in Counter(words).items():
        term = stem(folded(word))
        held[term] = held.get(term, 0) + n
    return len(words), held


#: Operators of the search language, which are no search terms.
OPERATORS = {"and", "or", "not", "near"}


def search_terms(question: str) -> list[str]:
    """Distinct stems of a question without signs and operators, in order."""
    words = (folded(x) for x in WORDS.findall(question or ""))
    return list(dict.fromkeys(stem(x) for x in words if x not in OPERATORS))
