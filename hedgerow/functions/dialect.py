"""Python's regular expressions in Java's syntax.

The pattern is parsed by Python's own parser, and its tree is written out node by node, so nothing of the source's spelling
is read as something else by Java: `[[]`, `&&` in a class, `\\Z`, `$` before a last line feed, names of groups. Classes and
word boundaries are spelled out as Python defines them. Groups keep their numbers; names are dropped.
"""

from __future__ import annotations

import re
from functools import lru_cache

try:
    from re import _parser as _tree
except ImportError:  # before Python 3.11
    import sre_parse as _tree

#: Flags of every pattern: without case, also beyond ASCII, and only \n ends a line.
FLAGS = "(?iud)"


class NoCounterpart(ValueError):
    """A construct that Java has not."""


# What Python's classes hold, as the inside of a Java class.
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNICODE = {"DIGIT": r"\p{Nd}", "SPACE": _SPACE, "WORD": r"\p{L}\p{N}_"}
_ASCII = {"DIGIT": "0-9", "SPACE": r"\t-\r\x20", "WORD": r"\p{Alnum}_"}
_REPEATS = {"MAX_REPEAT": "", "MIN_REPEAT": "?", "POSSESSIVE_REPEAT": "+"}


def _char(code: int) -> str:
    char = chr(code)
    return char if char.isalnum() and char.isascii() else f"\\x{{{code:x}}}"


class _Writer:
    def __init__(self, flags: int) -> None:
        self.flags = flags

    def _kinds(self) -> dict[str, str]:
        return _ASCII if self.flags & re.A else _UNICODE

    def sequence(self, nodes) -> str:
        return "".join(self.node(str(op), value) for op, value in nodes)

    def _category(self, name: str) -> str:
        """The inside of a class."""
        kind = name.removeprefix("CATEGORY_")
        held = self._kinds()[kind.removeprefix("NOT_")]
        return f"[^{held}]" if kind.startswith("NOT_") else held

    def _members(self, items) -> str:
        parts, negated = [], False
        for op, value in items:
            op = str(op)
            if op == "NEGATE":
                negated = True
            elif op == "LITERAL":
                parts.append(_char(value))
            elif op == "RANGE":
                parts.append(f"{_char(value[0])}-{_char(value[1])}")
            elif op == "CATEGORY":
                parts.append(self._category(str(value)))
            else:
                raise NoCounterpart(f"class member {op}")
        inside = "".join(parts)
        return f"[^{inside}]" if negated and "[" not in inside else f"(?![{inside}])(?s:.)" if negated else f"[{inside}]"

    def _at(self, name: str) -> str:
        many = bool(self.flags & re.M)
        word = self._kinds()["WORD"]
        here = f"(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}])"
        same = f"(?<=[{word}])(?=[{word}])|(?<![{word}])(?![{word}])"
        return {
            "AT_BEGINNING": r"(?:\A|(?<=\n))" if many else r"\A", "AT_BEGINNING_STRING": r"\A",
            "AT_END": r"(?=\n|\z)" if many else r"(?=\n?\z)", "AT_END_STRING": r"\z",
            "AT_BOUNDARY": f"(?:{here})", "AT_NON_BOUNDARY": rf"(?:(?!\A\z)(?:{same}))",  # nowhere in an empty text
        }[name]

    def _group(self, number: int | None, added: int, dropped: int, nodes) -> str:
        before = self.flags
        self.flags = (self.flags | added) & ~dropped
        if added & (re.A | re.U):
            self.flags = (self.flags & ~(re.A | re.U)) | (added & (re.A | re.U))
        inside = self.sequence(nodes)
        self.flags = before
        if added & (re.A | re.U):
            inside = f"(?{'-' if added & re.A else ''}u:{inside})"
        if dropped & re.I:
            inside = f"(?-i:{inside})"
        elif added & re.I:
            inside = f"(?i:{inside})"
        return f"({inside})" if number is not None else f"(?:{inside})"

    def node(self, op: str, value) -> str:
        if op == "LITERAL":
            return _char(value)
        if op == "NOT_LITERAL":
            return f"[^{_char(value)}]"
        if op == "ANY":
            return "(?s:.)" if self.flags & re.S else "."
        if op == "IN":
            return self._members(value)
        if op == "AT":
            return self._at(str(value))
        if op == "BRANCH":
            return "(?:" + "|".join(self.sequence(branch) for branch in value[1]) + ")"
        if op == "SUBPATTERN":
            return self._group(*value)
        if op == "ATOMIC_GROUP":
            return f"(?>{self.sequence(value)})"
        if op in _REPEATS:
            least, most, nodes = value
            most = "" if most is _tree.MAXREPEAT else str(most)
            return f"(?:{self.sequence(nodes)}){{{least},{most}}}{_REPEATS[op]}"
        if op == "GROUPREF":
            return f"(?:\\{value})"
        if op in ("ASSERT", "ASSERT_NOT"):
            way = ("<" if value[0] < 0 else "") + ("=" if op == "ASSERT" else "!")
            return f"(?{way}{self.sequence(value[1])})"
        if op == "FAILURE":
            return "(?!)"
        raise NoCounterpart(f"{op.lower().replace('_', ' ')} has no counterpart in Java")


@lru_cache(maxsize=10_000)
def to_java(pattern: str) -> str:
    """A Python pattern, searched without regard to case, in Java's syntax. Raises `NoCounterpart`."""
    parsed = _tree.parse(pattern, re.I)
    flags = parsed.state.flags
    return (FLAGS.replace("u", "") if flags & re.A else FLAGS) + _Writer(flags).sequence(parsed)
