"""Literals that every match of a regular expression must hold, read off its parse tree."""

from __future__ import annotations

from re import _constants as K
from re import _parser as parser

#: Sequences of characters grow to at most so many variants.
MOST = 8
#: A literal of this length is rare enough.
LONG = 5


def fold(text: str) -> str:
    """Lower case such that equal under ``re.I`` implies equal here: also for the letters that ``str.lower`` keeps apart."""
    if text.isascii():
        return text.lower()
    return text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s").replace("ς", "σ")


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set with the longer shortest literal, up to LONG; the smaller one if equal."""
    if not a or not b:
        return a or b
    return max(a, b, key=lambda s: (min(LONG, *map(len, s)), -len(s)))


def _characters(items: list) -> frozenset[str] | None:
    """The characters of a class, if they are few and given one by one."""
    out = set()
    for op, arg in items:
        if op is K.LITERAL:
            out.add(fold(chr(arg)))
        elif op is K.RANGE and arg[1] - arg[0] < 8:
            out |= {fold(chr(c)) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return frozenset(out) if out and len(out) <= 8 else None


def _exact(node: tuple) -> frozenset[str] | None:
    """All folded strings that a node matches, if they are few; None if not known."""
    op, arg = node
    if op is K.LITERAL:
        return frozenset([fold(chr(arg))])
    if op is K.IN:
        return _characters(arg)
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return frozenset([""])
    if op is K.SUBPATTERN:
        return _exact_sequence(arg[-1])
    if op is K.BRANCH:
        sets = [_exact_sequence(x) for x in arg[1]]
        return frozenset().union(*sets) if all(s is not None for s in sets) and sum(map(len, sets)) <= MOST else None
    if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[1] == 1 and (inner := _exact_sequence(arg[2])) is not None:
        return inner if arg[0] == 1 else inner | {""}
    return None


def _exact_sequence(nodes) -> frozenset[str] | None:
    out = frozenset([""])
    for node in nodes:
        s = _exact(node)
        if s is None or len(out) * len(s) > MOST:
            return None
        out = frozenset(a + b for a in out for b in s)
    return out


def _inside(node: tuple) -> frozenset[str] | None:
    """Literals of which a match of this node, which is no short list of strings, holds one."""
    op, arg = node
    if op is K.SUBPATTERN:
        return _required(arg[-1])
    if op is K.BRANCH:
        sets = [_required(x) for x in arg[1]]
        return frozenset().union(*sets) if all(sets) else None
    if op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] >= 1:
        return _required(arg[2])
    return None


def _required(nodes) -> frozenset[str] | None:
    best, run = None, frozenset([""])
    for node in nodes:
        s = _exact(node)
        if s is not None and len(run) * len(s) <= MOST:
            run = frozenset(a + b for a in run for b in s)
            continue
        best = _better(best, run if "" not in run else None)
        best = _better(best, _inside(node))
        run = s if s is not None else frozenset([""])
    return _better(best, run if "" not in run else None)


def required(pattern: str) -> frozenset[str]:
    """Folded literals of which every match holds one when folded, with or without regard to case.

    An alternative without any literal is an error: nothing would then be implied.
    """
    found = _required(parser.parse(pattern))
    if not found:
        raise ValueError(f"no literal is implied by {pattern!r}")
    # a literal that holds another one adds nothing
    return frozenset(x for x in found if not any(y != x and y in x for y in found))
