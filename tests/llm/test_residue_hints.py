"""What is searched for first must be implied by every alternative of every pattern."""

import re
from re import _constants as K
from re import _parser as parser

import pytest

from tessera.llm import residue
from tessera.llm.literals import fold, required

SKIPPED = [
    ("Warning: Cannot modify header information", "error"),
    ("Notice: Undefined index: id in a.php on line 5", "error"),
    ("The document has been moved.", "error"),
    ("This site is currently offline.", "error"),
    ("We looked everywhere.", "error"),
    ("DDoS protection by X", "error"),
    ("Accès interdit", "error"),
    ("Hier steht Ihr Inhalt", "filler"),
    ("Código: 404 -", "error"),
    ("[nombre aqui]", "placeholder"),
    ("Please complete the security check", "error"),
    ("Duis aute irure dolor in reprehenderit in voluptate", "filler"),
    ("Go go Go go Go go", "filler"),
    ("go,go,go,go,go,go", "filler"),
    ("PLEAſE COMPLETE THE SECURİTY CHECK", "error"),
]


@pytest.mark.parametrize("text,kind", SKIPPED)
def test_leftovers_without_an_old_hint(text, kind):
    assert residue.residue_kind(text) == kind


def examples(nodes, depth=0):
    """Short texts that match: every alternative at least once, optional parts left out and put in."""
    out = [""]
    for op, arg in nodes:
        if op is K.LITERAL:
            each = [chr(arg)]
        elif op is K.IN:
            each = [next(c for c in "a0_ .:-–4xA[#€eéiís'’" + "".join(map(chr, range(33, 256))) if re.match(_class(arg), c))]
        elif op is K.ANY:
            each = ["x"]
        elif op is K.SUBPATTERN:
            each = examples(arg[-1], depth + 1)
        elif op is K.BRANCH:
            each = [e for x in arg[1] for e in examples(x, depth + 1)]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            inner = examples(arg[2], depth + 1)
            each = [e * arg[0] for e in inner] if arg[0] else ["", *inner]
        elif op is K.NOT_LITERAL:
            each = ["x" if arg != ord("x") else "y"]
        else:
            each = [""]
        # every variant of this part once, beside the first and the last of what came before
        ends = out if len(out) <= 2 else [out[0], out[-1]]
        out = [a + b for a in ends for b in each] + [a + each[0] for a in out[1:-1]]
    return list(dict.fromkeys(out))


def _class(items):
    def one(op, arg):
        if op is K.NEGATE:
            return "^"
        if op is K.LITERAL:
            return re.escape(chr(arg))
        if op is K.RANGE:
            return f"{re.escape(chr(arg[0]))}-{re.escape(chr(arg[1]))}"
        return {K.CATEGORY_WORD: r"\w", K.CATEGORY_SPACE: r"\s", K.CATEGORY_NOT_SPACE: r"\S", K.CATEGORY_DIGIT: r"\d"}[arg]

    return "[" + "".join(one(*x) for x in items) + "]"


@pytest.mark.parametrize("kind", [*residue.PLACEHOLDERS, *residue.MESSAGES])
def test_every_alternative_holds_a_literal(kind):
    pattern = (residue.PLACEHOLDERS | residue.MESSAGES)[kind]
    hints, compiled = required(pattern), re.compile(pattern, re.I)
    texts = [t for t in examples(parser.parse(pattern)) if compiled.search(t)]
    assert texts
    for t in texts:
        for x in (t, t.upper()):
            if compiled.search(x):
                assert any(h in fold(x) for h in hints), x


@pytest.mark.parametrize("word", sorted(residue.CORE_LATIN))
def test_every_core_word_is_tried(word):
    assert residue.residue_kind(f"{word} esse cillum fugiat {word} velit") == "filler"
