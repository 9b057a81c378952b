r"""Python's regular expressions as Java's, with the same matches.

Python's own parser reads a pattern, and each of its parts is written in Java's syntax without anything whose meaning
differs: classes (``\d``, ``\w``, ``\s``, ``\b``) by the characters that Python counts in, ends of text as look-arounds,
named groups by number, flags in place.
"""

from __future__ import annotations

import re
import warnings
from re import _constants as C
from re import _parser

#: The characters of Python's classes, in Unicode and in ASCII, as the inside of a Java class.
CLASSES = {
    "digit": (r"\p{Nd}", "0-9"),
    "word": (r"\p{L}\p{N}_", "A-Za-z0-9_"),
    "space": (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", r"\t-\r\x{20}"),
}


class RegexError(ValueError):
    """A pattern that is malformed, or that Java can't match in the same way."""


def java_regex(pattern: str) -> str:
    """A Java pattern that finds the same as Python's ``re.search``."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _parser.parse(pattern)
            re.compile(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        raise RegexError(f"malformed pattern: {e}") from None
    return _Writer().sequence(tree, tree.state.flags)


def _character(code: int) -> str:
    return chr(code) if code < 128 and chr(code).isalnum() else f"\\x{{{code:x}}}"


class _Writer:
    def sequence(self, items, flags: int) -> str:
        return "".join(self.part(op, value, flags) for op, value in items)

    def part(self, op, value, flags: int) -> str:
        method = getattr(self, str(op).lower(), None)
        if method is None:
            raise RegexError(f"{str(op).lower()} has no equivalent")
        return method(value, flags)

    def _folded(self, text: str, flags: int) -> str:
        """``text``, in any case if so flagged."""
        if not flags & re.IGNORECASE:
            return text
        return f"(?i:{text})" if flags & re.ASCII else f"(?iu:{text})"

    def literal(self, code, flags):
        return self._folded(_character(code), flags)

    def not_literal(self, code, flags):
        return self._folded(f"[^{_character(code)}]", flags)

    def any(self, _, flags):
        return r"(?s:.)" if flags & re.DOTALL else r"[^\n]"

    def _class(self, category, flags: int) -> str:
        name = str(category).lower().removeprefix("category_")
        inside = CLASSES[name.removeprefix("not_")][bool(flags & re.ASCII)]
        return f"[^{inside}]" if name.startswith("not_") else inside

    def in_(self, items, flags):
        negated = any(op is C.NEGATE for op, _ in items)
        inside = ""
        for op, value in items:
            if op is C.LITERAL:
                inside += _character(value)
            elif op is C.RANGE:
                inside += f"{_character(value[0])}-{_character(value[1])}"
            elif op is C.CATEGORY:
                inside += self._class(value, flags)
        return self._folded(f"(?:(?![{inside}])(?s:.))" if negated else f"[{inside}]", flags)

    def branch(self, value, flags):
        return "(?:" + "|".join(self.sequence(x, flags) for x in value[1]) + ")"

    def subpattern(self, value, flags):
        group, add, drop, inside = value
        return ("(?:" if group is None else "(") + self.sequence(inside, (flags | add) & ~drop) + ")"

    def _repeat(self, value, flags, how: str) -> str:
        low, high, inside = value
        times = f"{{{low},{'' if high is C.MAXREPEAT else high}}}"
        return f"(?:{self.sequence(inside, flags)}){times}{how}"

    def max_repeat(self, value, flags):
        return self._repeat(value, flags, "")

    def min_repeat(self, value, flags):
        return self._repeat(value, flags, "?")

    def possessive_repeat(self, value, flags):
        return self._repeat(value, flags, "+")

    def atomic_group(self, inside, flags):
        return f"(?>{self.sequence(inside, flags)})"

    def groupref(self, number, flags):
        return self._folded(f"(?:\\{number})", flags)

    def assert_(self, value, flags):
        return f"(?{'=' if value[0] > 0 else '<='}{self.sequence(value[1], flags)})"

    def assert_not(self, value, flags):
        return f"(?{'!' if value[0] > 0 else '<!'}{self.sequence(value[1], flags)})"

    def failure(self, _, flags):
        return "(?!)"

    def at(self, where, flags):
        word = f"[{CLASSES['word'][bool(flags & re.ASCII)]}]"
        edge = rf"(?<={word})(?!{word})|(?<!{word})(?={word})"
        many = flags & re.MULTILINE
        if where is C.AT_BEGINNING_STRING or (where is C.AT_BEGINNING and not many):
            return r"\A"
        if where is C.AT_END_STRING:
            return r"\z"
        if where is C.AT_BEGINNING:
            return r"(?:\A|(?<=\n))"
        if where is C.AT_END:
            return r"(?=\n|\z)" if many else r"(?=\n?\z)"
        return f"(?:{edge})" if where is C.AT_BOUNDARY else f"(?!{edge})"


setattr(_Writer, "in", _Writer.in_)
setattr(_Writer, "assert", _Writer.assert_)
