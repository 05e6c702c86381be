"""Reads source and configuration texts as assignments of terms to names.

A scanner goes over comments, strings and operators of the common languages and file formats:

    name = "literal"        name := other + "literal"    name += "literal"      const name: Type = "literal"
    "name": "literal"       table["name"] = "literal"    "name" => "literal"    call("name", "literal")
    name("literal")         <name>literal</name>         <x key="name" value="literal"/>
    NAME=literal            (anywhere, as in shells and query strings)
    name: literal           (name first on its line and literal last, as in configuration files; also with " = ")

Strings are in double, single or triple quotes or backticks. Comments assign nothing, nor do strings' contents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Literal(NamedTuple):
    start: int
    end: int
    text: str


class Name(NamedTuple):
    """A reference to what a name stands for; `bare` is what it is where no such name is assigned."""

    name: str
    bare: Literal | None


class Assignment(NamedTuple):
    name: str
    adds: bool
    terms: list[Literal | Name]


_ID = r"[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|->|::|-(?=[A-Za-z0-9]))[A-Za-z0-9_]+)*"
_DOUBLE, _SINGLE = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"', r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'"
#: What the scanner stops at.
NEXT = re.compile(
    rf"""(?P<open>/\*|<!--|\"\"\"|''')
    |(?P<line>(?:(?<![^\s;{{}}])//|(?<![^\s])\#(?![A-Za-z0-9_])|(?m:^)[ \t]*(?:\#|--[ \t]|;))[^\n]*)
    |(?P<string>{_DOUBLE}|(?<![A-Za-z0-9_]){_SINGLE})
    |(?P<tag><[A-Za-z_][A-Za-z0-9_.:\-]*(?:\s[^<>]*)?/?>)
    |(?P<name>(?<![A-Za-z0-9_])(?<![A-Za-z0-9_][.\-])(?<![A-Za-z0-9_]->)(?<![A-Za-z0-9_]::){_ID})(?=\(|\s*(?:\[[^\[\]\n]*\]\s*)?(?:[:=+?|]|(?:string|String|str)\b))""",
    re.VERBOSE | re.ASCII,
)
CLOSE = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''", "`": "`"}
#: Between a name and its value: an optional index or type, and the operator.
OPERATOR = re.compile(r"[ \t]*(?:\[[ \t]*(?P<index>[^\[\]\n]*?)[ \t]*\][ \t]*)?(?:(?:string|String|str)\b[ \t]*)?(?P<op>\+=|\?\?=|\|\|=|\?=|:=|=>|=(?![=~>])|:(?![:=/]))[ \t]*", re.ASCII)
AFTER_STRING = re.compile(r"[ \t]*(?:(?P<op>:(?![:=])|=>)|\][ \t]*(?P<index>\+=|:=|=(?![=~>]))|(?P<call>,))[ \t]*")
TYPED = re.compile(r""":[ \t]*[&*]?'?[A-Za-z_][A-Za-z0-9_.<>\[\]?| ]*?(?:[ \t]=|=(?=[ \t]*["'`]))(?![=~>])[ \t]*(?=\S)""", re.ASCII)
STRING = re.compile(rf"(?:[rbfuLRBFU@$]{{0,2}})(?:{_DOUBLE}|{_SINGLE})")
ONLY_STRING = re.compile(rf"\(\s*({_DOUBLE}|{_SINGLE})\s*\)")
LONG = re.compile(r"[rbfuRBFU]{0,2}(\"\"\"|'''|`)")
REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}|\$\(([A-Za-z_][A-Za-z0-9_]*)\)|\$([A-Za-z_][A-Za-z0-9_]*)|%([A-Za-z_][A-Za-z0-9_]*)%", re.ASCII)
IDENTIFIER = re.compile(_ID, re.ASCII)
BARE = re.compile(r"""[^\s"'`;,(){}\[\]<>&|]+""")
ENDS_LINE = re.compile(r"[ \t]*[,;]?[ \t]*(?:(?:#|//)[^\n]*)?(?=[\r\n]|\Z)")
STARTS_LINE = re.compile(r"[ \t]*(?:-[ \t]+)?(?:(?:export|set|setenv|env|ENV|ARG|local|readonly|declare|var|let|const|val|final|public|private|protected|static)[ \t]+)*\Z")
JOIN = re.compile(r"[ \t]*(?:\\\r?\n[ \t]*)?(?:\+(?!=)|\.\.?(?=[ \t]*[\"'$A-Za-z])|&(?!&)|\|\||\?\?|or\b|~(?=[ \t]*[\"']))[ \t]*(?:\\?\r?\n[ \t]*)?")
SPACE = re.compile(r"[ \t]*(?:\\\r?\n[ \t]*)?")
ANY_SPACE = re.compile(r"\s*")
ATTRIBUTE = re.compile(r"""([A-Za-z_][A-Za-z0-9_.:\-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')""", re.ASCII)
WHOLE_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.:\- ]*\Z", re.ASCII)
ELEMENT = re.compile(r"\s*([^<>\s][^<>\n]*?)\s*</")
#: Attributes of elements that hold a name and its value.
NAMES, VALUES = ("key", "name", "id", "property"), ("value", "content", "val")


class Scanner:
    """The assignments of one text. Each opener without a close is remembered, so that a text is searched for it once."""

    def __init__(self, text: str):
        self.text = text
        self.unclosed: set[str] = set()

    def closed(self, opener: str, at: int) -> int:
        """Where the stretch that `opener` begins ends, from `at` on; -1 if it doesn't."""
        if opener in self.unclosed:
            return -1
        end = self.text.find(CLOSE[opener], at)
        if end < 0:
            self.unclosed.add(opener)
        return end

    def assignments(self) -> Iterator[Assignment]:
        text, at, line, seen = self.text, 0, 0, 0
        while m := NEXT.search(text, at):
            kind, at = m.lastgroup, m.end()
            if kind == "open":
                end = self.closed(m[0], at)
                at = end + len(CLOSE[m[0]]) if end >= 0 else at
            elif kind == "tag":
                yield from self.element(m)
            elif kind == "string":
                name, op = text[m.start() + 1 : at - 1], AFTER_STRING.match(text, at)
                if op and WHOLE_NAME.match(name) and (op.lastgroup != "call" or text[max(0, m.start() - 9) : m.start()].rstrip().endswith("(")):
                    terms, at = self.terms(op.end(), bare=None, alone=op.lastgroup == "call")
                    if terms:
                        yield Assignment(name, op["index"] == "+=", terms)
            elif kind == "name":
                if text.startswith("(", at):
                    if call := ONLY_STRING.match(text, at):
                        yield Assignment(m[0], False, [Literal(call.start(1) + 1, call.end(1) - 1, call[1][1:-1])])
                        at = call.end()
                    continue
                line, seen = max(line, text.rfind("\n", seen, m.start()) + 1), m.start()
                op = OPERATOR.match(text, at)
                if op:
                    typed = TYPED.match(text, op.start("op")) if op["op"] == ":" else None
                    after = typed.end() if typed else op.end()
                    first = STARTS_LINE.match(text, line, m.start()) is not None
                    tight = op[0] == "=" or op[0] == "+="
                    index = op["index"] or ""
                    name = index[1:-1] if len(index) > 2 and index[0] == index[-1] and index[0] in "\"'" else m[0]
                    terms, end = self.terms(after, bare="tight" if tight else "line" if first and not typed else None)
                    if terms:
                        yield Assignment(name, op["op"] in ("+=", "||=", "??=", "?="), terms)
                        at = end

    def terms(self, at: int, bare: str | None, alone: bool = False) -> tuple[list[Literal | Name], int]:
        """The terms from `at` on, and where they end. bare: whether unquoted values count, `tight` anywhere or `line` where they end their line."""
        text, out, held, depth, begin = self.text, [], [], 0, at
        while True:
            at = (ANY_SPACE if depth else SPACE).match(text, at).end()
            if m := LONG.match(text, at):
                end = self.closed(m[1], m.end())
                if end < 0:
                    break
                out.append(Literal(m.end(), end, text[m.end() : end]))
                at = end + len(m[1])
            elif m := STRING.match(text, at):
                inner = at + next(k for k, c in enumerate(m[0]) if c in "\"'") + 1
                out.append(Literal(inner, m.end() - 1, text[inner : m.end() - 1]))
                at = m.end()
            elif m := REFERENCE.match(text, at):
                out.append(Name(m[m.lastindex], None))
                at = m.end()
            elif bare and not depth and (m := BARE.match(text, at)):
                value = Literal(at, m.end(), m[0])
                if bare == "line" and not ENDS_LINE.match(text, m.end()):
                    value = None
                if IDENTIFIER.fullmatch(m[0]):
                    if text.startswith("(", m.end()):
                        depth, at = depth + 1, m.end() + 1
                        continue
                    out.append(Name(m[0], value))
                elif value:
                    out.append(value)
                elif m := IDENTIFIER.match(text, at):
                    out.append(Name(m[0], None))
                else:
                    break
                at = m.end()
            elif m := IDENTIFIER.match(text, at):
                at = m.end()
                if text.startswith("(", at):
                    depth, at = depth + 1, at + 1
                    continue
                out.append(Name(m[0], None))
            elif text.startswith("(", at):
                depth, at = depth + 1, at + 1
                continue
            elif depth and text.startswith(")", at):
                pass
            else:
                break
            while depth and text.startswith(")", end := ANY_SPACE.match(text, at).end()):
                depth, at = depth - 1, end + 1
            if depth and text.startswith(",", end := ANY_SPACE.match(text, at).end()):
                at, held, out = end + 1, out or held, []  # of a call's arguments the last counts: the default, or the text
            elif m := JOIN.match(text, at):
                at = m.end()
            elif isinstance(out[-1] if out else None, Literal) and not alone and (m := (ANY_SPACE if depth else SPACE).match(text, at)) and STRING.match(text, m.end()) and text[at - 1] in "\"'":
                at = m.end()
            else:
                break
        return out or held, max(at, begin)

    def element(self, m: re.Match) -> Iterator[Assignment]:
        """The pairs of an element's attributes, and of its name and its text."""
        text, tag = self.text, re.match(r"<([A-Za-z0-9_.:\-]+)", m[0])[1]
        found: dict[str, Literal] = {}
        for a in ATTRIBUTE.finditer(text, m.start(), m.end()):
            k = 2 if a[2] is not None else 3
            found.setdefault(a[1].lower(), Literal(a.start(k), a.end(k), a[k]))
            yield Assignment(a[1], False, [Literal(a.start(k), a.end(k), a[k])])
        told = next((found[x].text for x in NAMES if x in found), None)
        value = next((found[x] for x in VALUES if x in found), None)
        if told and value:
            yield Assignment(told, False, [value])
        if not m[0].endswith("/>") and (inner := ELEMENT.match(text, m.end())) and text.startswith(tag, inner.end()):
            literal = Literal(inner.start(1), inner.end(1), inner[1])
            yield Assignment(tag, False, [literal])
            if told and not value:
                yield Assignment(told, False, [literal])


def assignments(text: str) -> list[Assignment]:
    return list(Scanner(text).assignments())


def resolved(found: list[Assignment]) -> Iterator[tuple[str, list[Literal | int]]]:
    """Each assignment's name with its terms, references as the number of the assignment that they mean.

    A name means its latest assignment before, or else its first one after, whole or by the part behind the last dot.
    Other names are what they are if they stand bare, and else nothing.
    """
    first: dict[str, int] = {}
    for k, a in enumerate(found):
        for n in (a.name, short(a.name)):
            first.setdefault(n, k)
    latest: dict[str, int] = {}
    for k, a in enumerate(found):
        terms: list[Literal | int] = []
        if a.adds and a.name in latest:
            terms.append(latest[a.name])
        for t in a.terms:
            if isinstance(t, Literal):
                terms.append(t)
                continue
            to = next((d[n] for n in (t.name, short(t.name)) for d in (latest, first) if n in d), None)
            if to is not None and to != k:
                terms.append(to)
            elif to is None and t.bare:
                terms.append(t.bare)
        yield a.name, terms
        for n in (a.name, short(a.name)):
            latest[n] = k


def short(name: str) -> str:
    return re.split(r"\.|->|::", name)[-1]
