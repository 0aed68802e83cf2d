"""English words to lexemes: stop words and the Snowball English (Porter 2) stemmer, in two forms.

`stem` is a function for tasks that hold words already; `stemmed` is a list of projections whose expressions are plain SQL, for
a vocabulary of distinct words in a DataFrame or in another engine. Both have the regions R1 and R2 as positions: `p1` and
`p2` are where they begin.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words of the English configuration.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further then once here there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very s t can will just don should now"
).split()

# The stemmer's exceptions and suffixes, as published.
_IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

_R1, _VC = "^(?:gener|commun|arsen|.*?[aeiouy][^aeiouy])", "^.*?[aeiouy][^aeiouy]"
_SHORT = "(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"


def _has(x: str, regex: str) -> str:
    return f"regexp_extract({x}, '{regex}', 0) <> ''"


def _less(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _suffixes(rules: list[tuple[str, str]]) -> str:
    """The first suffix in order decides, whatever its outcome; longer ones must come first."""
    return "CASE " + " ".join(f"WHEN w LIKE '%{suffix}' THEN {then}" for suffix, then in rules) + " ELSE w END"


def _in(region: str, suffix: str, new: str, more: str = "") -> tuple[str, str]:
    return suffix, f"CASE WHEN length(w) - {len(suffix)} >= {region}{more} THEN {_less(len(suffix))} || '{new}' ELSE w END"


@functools.cache
def layers() -> list[dict[str, str]]:
    """Projections one upon another, from `word` to `lexeme`; a column that a layer doesn't name stays."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    fixed = f"length(word) < 3 OR {_has('word', '[^a-z]')} OR word IN ({quoted(_IRREGULAR)})"
    marked = "CASE WHEN word LIKE 'y%' THEN 'Y' || substr(word, 2) ELSE word END"
    for v in "aeiouy":
        marked = f"replace({marked}, '{v}y', '{v}Y')"
    length = lambda x, regex: f"CASE WHEN {_has(x, regex)} THEN length(regexp_extract({x}, '{regex}', 0)) ELSE length({x}) END"
    vowel = lambda n: _has(_less(n), "[aeiouy]")
    dropped = lambda s: (s, f"CASE WHEN {vowel(len(s))} THEN {_less(len(s))} ELSE w END")
    ends = ("ingly", "edly", "ing", "ed")
    return [
        {"fixed": fixed, "w": marked},
        {"p1": length("w", _R1)},
        {"p2": f"p1 + {length('substr(w, p1 + 1)', _VC)}"},
        {"w": _suffixes([("sses", _less(2)), *((s, f"CASE WHEN length(w) > 4 THEN {_less(2)} ELSE {_less(1)} END") for s in ("ied", "ies")), ("us", "w"), ("ss", "w"), ("s", f"CASE WHEN {vowel(2)} THEN {_less(1)} ELSE w END")])},
        {"fixed": f"fixed OR w IN ({quoted(_AFTER_1A)})", "kept": "w"},
        {"w": _suffixes([_in("p1", "eedly", "ee"), dropped("ingly"), dropped("edly"), _in("p1", "eed", "ee"), dropped("ing"), dropped("ed")]), "cut": "CASE WHEN w LIKE '%eedly' OR w LIKE '%eed' THEN false ELSE " + " OR ".join(f"(w LIKE '%{s}' AND {vowel(len(s))})" for s in ends) + " END"},
        {"w": f"CASE WHEN NOT cut THEN w WHEN w LIKE '%at' OR w LIKE '%bl' OR w LIKE '%iz' THEN w || 'e' WHEN right(w, 2) IN ({quoted(_DOUBLES)}) THEN {_less(1)} WHEN p1 = length(w) AND {_has('w', _SHORT)} THEN w || 'e' ELSE w END"},
        {"w": f"CASE WHEN length(w) > 2 AND {_has('w', '[^aeiouy][yY]$')} THEN {_less(1)} || 'i' ELSE w END"},
        {"w": _suffixes([*(_in("p1", a, b) for a, b in _STEP_2.items()), _in("p1", "ogi", "og", " AND w LIKE '%logi'"), _in("p1", "li", "", f" AND {_has('w', '[cdeghkmnrt]li$')}")])},
        {"w": _suffixes(sorted([*(_in("p1", a, b) for a, b in _STEP_3.items()), _in("p2", "ative", "")], key=lambda r: -len(r[0])))},
        {"w": _suffixes(sorted([*(_in("p2", s, "") for s in _STEP_4), _in("p2", "ion", "", f" AND {_has('w', '[st]ion$')}")], key=lambda r: -len(r[0])))},
        {"w": _suffixes([("e", f"CASE WHEN length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT ({_has(_less(1), _SHORT)})) THEN {_less(1)} ELSE w END"), ("ll", f"CASE WHEN length(w) - 1 >= p2 THEN {_less(1)} ELSE w END")])},
        {"lexeme": "CASE " + " ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in _IRREGULAR.items()) + " WHEN length(word) < 3 OR regexp_extract(word, '[^a-z]', 0) <> '' THEN word WHEN fixed THEN replace(kept, 'Y', 'y') ELSE replace(w, 'Y', 'y') END"},
    ]


def stemmed(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, lexeme) for each row of words. Words with a digit, and those of fewer than three letters, stay as they are.

    Write or checkpoint the result before it is joined or filtered: the optimizer would put the layers into one another to
    learn what holds of lexeme, and each mentions the one below many times.
    """
    out = words.select(F.col(word).alias("word"))
    for layer in layers():
        out = out.withColumns({c: F.expr(e) for c, e in layer.items()})
    return out.select("word", "lexeme")


def stem_sql(relation: str) -> str:
    """The same as a query over a relation with a column `word`."""
    have = ["word"]
    for layer in layers():
        names = [c for c in have if c not in layer]
        relation = f"(SELECT {', '.join([*names, *(f'{e} AS {c}' for c, e in layer.items())])} FROM {relation})"
        have = [*names, *layer]
    return f"(SELECT word, lexeme FROM {relation})"


_MATCH_R1, _MATCH_VC, _ENDS_SHORT = re.compile(_R1), re.compile(_VC[1:]), re.compile(_SHORT)
_VOWEL, _LI = frozenset("aeiouy"), frozenset("cdeghkmnrt")


def _vowels(w: str) -> bool:
    return not _VOWEL.isdisjoint(w)


def _cut(w: str, rules: dict[str, str], p1: int) -> str:
    for n in range(7, 1, -1):
        if (new := rules.get(w[-n:])) is not None and len(w) > n:
            return w[:-n] + new if len(w) - n >= p1 else w
    return w


@functools.lru_cache(1 << 18)
def stem(word: str) -> str:
    """The lexeme of a word; words with a digit, and those of fewer than three letters, stay as they are."""
    if len(word) < 3 or not word.isalpha():
        return word
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    w = "Y" + word[1:] if word[0] == "y" else word
    for v in "aeiouy":
        w = w.replace(v + "y", v + "Y")
    p1 = m.end() if (m := _MATCH_R1.match(w)) else len(w)
    p2 = m.end() if (m := _MATCH_VC.match(w, p1)) else len(w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _vowels(w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            rest = w[: -len(s)]
            if s.startswith("eed"):
                w = rest + "ee" if len(rest) >= p1 else w
            elif _vowels(rest):
                w = rest
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w[-2:] in _DOUBLES:
                    w = w[:-1]
                elif len(w) == p1 and _ENDS_SHORT.search(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    # 2
    if w.endswith("ogi"):
        w = w[:-1] if len(w) - 3 >= p1 and w[-4:-3] == "l" else w
    elif (short := _cut(w, _STEP_2, p1)) != w or any(w.endswith(s) for s in _STEP_2):
        w = short
    elif w.endswith("li") and len(w) - 2 >= p1 and w[-3:-2] in _LI:
        w = w[:-2]
    # 3
    if w.endswith("ative"):
        w = w[:-5] if len(w) - 5 >= p2 else w
    else:
        w = _cut(w, _STEP_3, p1)
    # 4
    if (s := next((s for s in _STEP_4 if w.endswith(s)), None)) or w.endswith("ion"):
        s = s or "ion"
        if len(w) - len(s) >= p2 and (s != "ion" or w[-4:-3] in ("s", "t")):
            w = w[: -len(s)]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= p2 or (len(w) - 1 >= p1 and not _ENDS_SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= p2:
        w = w[:-1]
    return w.replace("Y", "y")


def is_stop_word(word: Column) -> Column:
    return word.isin(*STOP_WORDS)
