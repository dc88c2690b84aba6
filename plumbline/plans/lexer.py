"""Tokens of T-SQL, and trees of tokens by parentheses. Strings, comments and quoted names are single tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

PATTERN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<string>[nN]?'(?:[^']|'')*')|(?P<bracket>\[(?:[^\]]|\]\])*\])|(?P<quoted>"(?:[^"]|"")*")
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<variable>@@?\w+)|(?P<word>[#$A-Za-z_\u0080-￿][\w$#\u0080-￿]*)|(?P<op><>|!=|<=|>=|\+=|-=|\|\||::|.)""",
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


@dataclass
class Group:
    """What stands between a pair of parentheses."""

    items: list[Token | Group] = field(default_factory=list)
    kind = "group"
    upper = "("


def tokenize(sql: str) -> list[Token]:
    """All tokens but white space and comments."""
    return [Token(m.lastgroup, m[0]) for m in PATTERN.finditer(sql) if m.lastgroup not in ("space", "comment")]


def batches(script: str) -> list[str]:
    """The parts of a script between lines that hold GO alone."""
    return [p.strip() for p in re.split(r"(?im)^\s*GO\s*;?\s*$", script) if p.strip()]


def tree(tokens: list[Token]) -> list[Token | Group]:
    stack: list[list] = [[]]
    for t in tokens:
        if t.text == "(" and t.kind == "op":
            stack.append([])
        elif t.text == ")" and t.kind == "op":
            if len(stack) == 1:
                raise ValueError("a closing parenthesis too many")
            items = stack.pop()
            stack[-1].append(Group(items))
        else:
            stack[-1].append(t)
    if len(stack) != 1:
        raise ValueError("a parenthesis is not closed")
    return stack[0]


def split(items: list, at: str) -> list[list]:
    """Parts of items between tokens of that text."""
    parts: list[list] = [[]]
    for x in items:
        if isinstance(x, Token) and x.text == at and x.kind == "op":
            parts.append([])
        else:
            parts[-1].append(x)
    return parts
