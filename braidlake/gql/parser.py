"""GraphQL query documents: operations, variables, aliases, arguments, fragments and directives."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from braidlake.errors import RequestError

_TOKEN = re.compile(r'[\s,﻿]+|#[^\n]*|(?P<name>[_A-Za-z]\w*)|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])|(?P<block>"""(?:\\"""|(?!""").)*""")|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<mark>\.\.\.|[!$()&:=@\[\]{|}])', re.S)


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Enum:
    name: str


@dataclass
class Field:
    name: str
    alias: str
    arguments: dict
    directives: list
    selection: list | None


@dataclass
class Spread:
    name: str
    directives: list


@dataclass
class Inline:
    on: str | None
    directives: list
    selection: list


@dataclass
class Operation:
    kind: str
    name: str | None
    variables: dict  # name to (type text, default or None, whether there is a default)
    selection: list


@dataclass
class Document:
    operations: list[Operation] = field(default_factory=list)
    fragments: dict[str, Inline] = field(default_factory=dict)


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise RequestError(f"syntax error at {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] in ("mark", "name") else ""

    def take(self, mark: str) -> bool:
        if self.tokens[self.at] == ("mark", mark):
            self.at += 1
            return True
        return False

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise RequestError(f"syntax error: {mark!r} wanted, {self.tokens[self.at][1]!r} found")

    def name(self) -> str:
        kind, text = self.tokens[self.at]
        if kind != "name":
            raise RequestError(f"syntax error: a name wanted, {text!r} found")
        self.at += 1
        return text

    def document(self) -> Document:
        out = Document()
        while self.tokens[self.at][0] != "end":
            if self.peek() == "fragment":
                self.name()
                name = self.name()
                if self.name() != "on":
                    raise RequestError("syntax error: a fragment needs 'on'")
                out.fragments[name] = Inline(self.name(), self.directives(), self.selection())
            elif self.peek() == "{":
                out.operations.append(Operation("query", None, {}, self.selection()))
            else:
                kind = self.name()
                if kind not in ("query", "mutation", "subscription"):
                    raise RequestError(f"syntax error at {kind!r}")
                name = self.name() if self.tokens[self.at][0] == "name" else None
                variables = self.variables()
                self.directives()
                out.operations.append(Operation(kind, name, variables, self.selection()))
        if not out.operations:
            raise RequestError("there is no operation")
        return out

    def variables(self) -> dict:
        out = {}
        if self.take("("):
            while not self.take(")"):
                self.need("$")
                name = self.name()
                self.need(":")
                kind = self.type_text()
                given = self.take("=")
                out[name] = (kind, self.value() if given else None, given)
                self.directives()
        return out

    def type_text(self) -> str:
        if self.take("["):
            inner = f"[{self.type_text()}]"
            self.need("]")
        else:
            inner = self.name()
        return inner + "!" * self.take("!")

    def directives(self) -> list:
        out = []
        while self.take("@"):
            out.append((self.name(), self.arguments()))
        return out

    def arguments(self) -> dict:
        out = {}
        if self.take("("):
            while not self.take(")"):
                name = self.name()
                self.need(":")
                out[name] = self.value()
        return out

    def selection(self) -> list:
        self.need("{")
        out: list = []
        while not self.take("}"):
            if self.take("..."):
                if self.tokens[self.at][0] == "name" and self.peek() != "on":
                    out.append(Spread(self.name(), self.directives()))
                else:
                    on = None
                    if self.peek() == "on":
                        self.name()
                        on = self.name()
                    out.append(Inline(on, self.directives(), self.selection()))
                continue
            name = alias = self.name()
            if self.take(":"):
                name = self.name()
            out.append(Field(name, alias, self.arguments(), self.directives(), self.selection() if self.peek() == "{" else None))
        if not out:
            raise RequestError("syntax error: an empty selection")
        return out

    def value(self):
        kind, text = self.tokens[self.at]
        if self.take("$"):
            return Variable(self.name())
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.value())
            return out
        if self.take("{"):
            out = {}
            while not self.take("}"):
                name = self.name()
                self.need(":")
                out[name] = self.value()
            return out
        self.at += 1
        if kind == "number":
            return int(text) if re.fullmatch(r"-?\d+", text) else float(text)
        if kind == "string":
            try:
                return json.loads(text)
            except ValueError as e:
                raise RequestError(f"syntax error in {text}") from e
        if kind == "block":
            return "\n".join(line.strip() for line in text[3:-3].replace('\\"""', '"""').strip("\n").split("\n"))
        if kind == "name":
            return {"true": True, "false": False, "null": None}.get(text, Enum(text)) if text != "null" else None
        raise RequestError(f"syntax error: a value wanted, {text!r} found")


def parse(text: str) -> Document:
    return Parser(text).document()
