"""STEP physical files (ISO 10303-21), as building models come in them: text to entity records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field


class SpfError(ValueError):
    """A file that isn't well formed."""


class UnexpectedEnd(SpfError):
    pass


class UnexpectedCharacter(SpfError):
    pass


class InvalidNumber(SpfError):
    pass


class UnterminatedString(SpfError):
    pass


class MissingDataSection(SpfError):
    pass


class DuplicateEntityId(SpfError):
    pass


@dataclass(slots=True)
class Value:
    """One argument. kind: unset, derived, int, real, string, enum, ref or list."""

    kind: str
    ref: int | None = None
    num: float | None = None
    str: str | None = None
    items: list[Value] = field(default_factory=list)

    def record(self, nested: bool = True) -> dict:
        out = {"kind": self.kind, "ref": self.ref, "num": self.num, "str": self.str}
        return out | ({"items": [v.record(False) for v in self.items]} if nested else {})


_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<comment>/\*)
    |(?P<string>'(?:[^']|'')*')
    |(?P<ref>\#\d+)
    |(?P<enum>\.[A-Za-z0-9_]+\.)
    |(?P<binary>"[0-9A-Fa-f]*")
    |(?P<number>[+-]?\d[0-9.+\-Ee]*)
    |(?P<word>[A-Za-z_!][A-Za-z0-9_\-]*)
    |(?P<mark>[()=,;$*])""",
    re.X | re.S,
)
_COMMENT = re.compile(r"/\*|\*/")
_NUMBER = re.compile(r"[+-]?\d+(?:(?P<real>\.\d*)?(?P<exponent>[Ee][+-]?\d+)?)\Z")


def _skip_comment(text: str, at: int) -> int:
    """Past a comment, which may hold others."""
    depth = 0
    for m in _COMMENT.finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    raise UnexpectedEnd("comment without an end")


def tokens(text: str, at: int = 0) -> Iterator[tuple[str, str]]:
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise (UnterminatedString if text[at] == "'" else UnexpectedCharacter)(f"{text[at : at + 20]!r} at {at}")
        if m.lastgroup == "comment":
            at = _skip_comment(text, at)
            continue
        at = m.end()
        if m.lastgroup != "space":
            yield m.lastgroup, m[0]


def _number(text: str) -> Value:
    m = _NUMBER.match(text)
    if not m:
        raise InvalidNumber(text)
    return Value("real" if m["real"] or m["exponent"] else "int", num=float(text))


class _Reader:
    def __init__(self, stream: Iterator[tuple[str, str]]):
        self.stream = stream

    def next(self) -> tuple[str, str]:
        try:
            return next(self.stream)
        except StopIteration:
            raise UnexpectedEnd("the file ends within the data") from None

    def expect(self, mark: str) -> None:
        _, found = self.next()
        if found != mark:
            raise UnexpectedCharacter(f"{found!r}, not {mark!r}")

    def value(self, kind: str, found: str) -> Value:
        if found == "$":
            return Value("unset")
        if found == "*":
            return Value("derived")
        if kind == "ref":
            return Value("ref", ref=int(found[1:]))
        if kind == "string":
            return Value("string", str=found[1:-1].replace("''", "'"))
        if kind in ("enum", "binary"):
            return Value("enum", str=found.strip('."'))
        if kind == "number":
            return _number(found)
        if found == "(":
            return Value("list", items=self.list())
        if kind == "word":  # a typed value stands for what it wraps
            self.expect("(")
            inner = self.list()
            return inner[0] if len(inner) == 1 else Value("list", items=inner)
        raise UnexpectedCharacter(repr(found))

    def list(self) -> list[Value]:
        """After the opening bracket."""
        out: list[Value] = []
        kind, found = self.next()
        if found == ")":
            return out
        while True:
            out.append(self.value(kind, found))
            _, mark = self.next()
            if mark == ")":
                return out
            if mark != ",":
                raise UnexpectedCharacter(repr(mark))
            kind, found = self.next()


def parse(text: str) -> Iterator[tuple[int, str, list[Value]]]:
    """Entities of the data section: id, upper-case type, arguments."""
    stream = tokens(text)
    before = None
    for kind, found in stream:  # what stands before the data section is only cut into tokens
        if (before, found) == ("DATA", ";"):
            break
        before = found.upper() if kind == "word" else None
    else:
        raise MissingDataSection("no data section")
    reader, seen = _Reader(stream), set()
    while True:
        kind, found = reader.next()
        if kind == "word" and found.upper() == "ENDSEC":
            return
        if kind != "ref":
            raise UnexpectedCharacter(f"{found!r} where an entity should begin")
        number = int(found[1:])
        if number in seen:
            raise DuplicateEntityId(found)
        seen.add(number)
        reader.expect("=")
        kind, name = reader.next()
        if kind != "word":
            raise UnexpectedCharacter(f"{name!r} where a type should stand")
        reader.expect("(")
        args = reader.list()
        reader.expect(";")
        yield number, name.upper(), args
