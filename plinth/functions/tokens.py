"""A tokenizer for Postgres-flavoured SQL: enough structure for token-level rewriting."""

import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
  |(?P<dollar>\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$)
  |(?P<string>[eE]'(?:[^'\\]|\\.|'')*'|'(?:[^']|'')*')
  |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
  |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)
  |(?P<name>[A-Za-z_\u0080-\U0010ffff][\w$]*)
  |(?P<param>\$\d+)
  |(?P<op>->>|->|<=>|==|\#>>|\#>|::|<>|!=|<=|>=|\|\||!~\*|!~|~\*|~|[-+*/%<>=?^@&|!\#])
  |(?P<punct>[(),.;\[\]:{}])""",
    re.X | re.S,
)


class Token(NamedTuple):
    kind: str
    text: str

    @property
    def word(self) -> str:
        """Lower-case text of a name, else the text."""
        return self.text.lower() if self.kind == "name" else self.text


class UnsupportedSyntax(ValueError):
    """Text that the engine refuses instead of guessing."""


def tokens(sql: str) -> list[Token]:
    """Tokens without white space and comments."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise UnsupportedSyntax(f"unexpected character at {at}: {sql[at : at + 20]!r}")
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "tag" else "dollar"
        if kind == "space":
            continue
        text = m[0]
        if kind == "dollar":
            text = "'" + text[text.index("$", 1) + 1 : text.rindex("$", 0, len(text) - 1)].replace("'", "''") + "'"
            kind = "string"
        out.append(Token(kind, text))
    return out


def comments(sql: str) -> list[str]:
    """The /* */ comments of a text; what stands in strings or names isn't one."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            break
        at = m.end()
        if m.lastgroup == "space" and m[0].startswith("/*"):
            out.append(m[0])
    return out


def statements(sql: str) -> list[list[Token]]:
    """Tokens of each statement of a text; empty ones go."""
    out: list[list[Token]] = [[]]
    for t in tokens(sql):
        if t.text == ";":
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


def close(ts: list[Token], at: int) -> int:
    """Index of the bracket that closes the one at `at`."""
    pairs = {"(": ")", "[": "]"}
    depth, opened, closed = 0, ts[at].text, pairs[ts[at].text]
    for i in range(at, len(ts)):
        depth += (ts[i].text == opened and ts[i].kind == "punct") - (ts[i].text == closed and ts[i].kind == "punct")
        if not depth:
            return i
    raise UnsupportedSyntax("unbalanced brackets")


def opening(ts: list[Token], at: int) -> int:
    """Index of the bracket that opens the one at `at`."""
    pairs = {")": "(", "]": "["}
    depth, closed, opened = 0, ts[at].text, pairs[ts[at].text]
    for i in range(at, -1, -1):
        depth += (ts[i].text == closed and ts[i].kind == "punct") - (ts[i].text == opened and ts[i].kind == "punct")
        if not depth:
            return i
    raise UnsupportedSyntax("unbalanced brackets")


def split(ts: list[Token], by: str = ",") -> list[list[Token]]:
    """Parts of a list at brackets' top level."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in ts:
        if t.kind == "punct":
            depth += (t.text in "([") - (t.text in ")]")
        if t.word == by and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [] if out == [[]] else out


def text(ts: list[Token]) -> str:
    """SQL text of tokens."""
    out = ""
    for i, t in enumerate(ts):
        glue = i and not (t.text in (".", ",", ")", "]", "[", "::", ";") or ts[i - 1].text in (".", "(", "[", "::") or (t.text == "(" and ts[i - 1].kind in ("name", "quoted")))
        out += (" " if glue else "") + t.text
    return out
