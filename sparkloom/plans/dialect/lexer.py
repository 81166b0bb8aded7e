"""Tokens of the dialect. Keywords are case-insensitive, both quotes make strings, backticks quote names."""

from __future__ import annotations

import re
from dataclasses import dataclass

_RULES = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<name>[A-Za-z_][A-Za-z_0-9]*|`[^`]+`)|(?P<op><=|>=|<>|!=|==|\|\||[-+*/%=<>(),.;\[\]])""",
    re.S | re.X,
)


class DialectError(ValueError):
    """The text isn't a statement of the dialect."""


@dataclass(frozen=True)
class Token:
    kind: str  # number | string | name | op | end
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _RULES.match(text, at)
        if m is None:
            raise DialectError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), at))
        at = m.end()
    return [*out, Token("end", "", len(text))]


def unquote(text: str) -> str:
    """The value of a string token: backslash escapes and doubled quotes."""
    q, body = text[0], text[1:-1].replace(text[0] * 2, text[0])
    del q
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), body)
