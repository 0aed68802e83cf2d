"""What a regular expression's matches must contain: a boolean query over trigrams.

Expressions are read by Python's parser and only for what every match has: runs of literal characters. What it cannot read, or
may read otherwise than Java does, has no requirement, which is always right.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as op
from re import _parser as parser

#: Stands in front of a text, so that an expression's beginning is a literal too.
START = "\x02"
#: More alternatives than these are taken as no requirement.
MOST = 16

# inline flags, quotations, classes within classes: read otherwise, or read without case
_OTHERWISE = re.compile(r"\(\?[a-zA-Z-]*[a-zA-Z][):-]|&&|\[[^\]]*\[|\[\]|\[\^\]|\\[QEGRXhHvVzZAkKp]")

Runs = list[list[str]]  # alternatives, each a list of texts that must stand somewhere


def _joined(a: Runs, b: Runs) -> Runs:
    """a followed at once by b: the last text of one and the first of the other touch."""
    return [[*x[:-1], x[-1] + y[0], *y[1:]] for x in a for y in b]


def _runs(tree) -> Runs:
    """Alternatives of texts in order; neighbours in a list are apart by anything. "" at an end means that nothing is known there."""
    out: Runs = [[""]]
    for kind, value in tree:
        if kind is op.LITERAL:
            one: Runs = [[chr(value)]]
        elif kind is op.SUBPATTERN:
            one = _runs(value[3])
        elif kind is op.ATOMIC_GROUP:
            one = _runs(value)
        elif kind is op.BRANCH:
            one = [x for branch in value[1] for x in _runs(branch)]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, body = value
            inner = _runs(body) if least else [[""]]
            one = inner if least == most == 1 else [["", *x, ""] for x in inner]
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue  # takes no room
        else:
            one = [["", ""]]
        if len(out) * len(one) > MOST:
            one = [["", ""]]
        out = _joined(out, one)
    return out


def required(regex: str | None) -> list[list[str]]:
    """Alternatives of trigrams, one of which each text that the whole expression matches has entirely; [] where nothing is required.

    Trigrams are of START followed by the text. A match may end before a last line end, so its end is not known.
    """
    if not regex or _OTHERWISE.search(regex):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(regex)
    except (re.error, RecursionError, OverflowError):
        return []
    out = []
    for x in _joined([[START]], _runs(tree)):
        grams = sorted({t[i : i + 3] for t in x for i in range(len(t) - 2)})
        if not grams:
            return []
        out.append(grams)
    return out
