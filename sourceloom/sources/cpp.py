"""Definitions, calls, includes and constants of C++ text: a lexer, a bracket matcher, and one walk over scopes.

The lexer gives names, numbers, literals (raw strings too), directives and marks; comments and white space go. The matcher pairs
(), [] and {}, and decides which < and > enclose template arguments. The walk reads, at each {, the tokens since the last ; { } or
access label as a header. All three are linear in the text. Macros are taken as written: conditional branches are all read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

NAME, VALUE, DIRECTIVE, MARK = range(4)

_TOKEN = re.compile(
    r"(?P<space>\s+|//(?:\\\n|[^\n])*)"
    r"|(?P<raw>(?:u8|[uUL])?R\"(?P<guard>[^()\\\s\"]{0,16})\()"
    r"|(?P<text>(?:u8|[uUL])?(?:\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))"
    r"|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<number>\.?\d(?:[eEpP][+-]|'?[\w.])*)"
    r"|(?P<mark>::|->\*?|<=>|<<=|<<|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|\.\.\.|.)", re.S)
_DIRECTIVE = re.compile(r"#(?:\\\n|/\*.*?\*/|//[^\n]*|[^\n])*", re.S)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_CONTROL = frozenset("if for while switch catch return else do try case default goto throw new delete".split())
_BEFORE_CALL = frozenset("return else do throw case co_return co_await co_yield and or not xor".split())
_NO_CALL = _CONTROL | frozenset("sizeof alignof decltype static_assert defined operator typeid noexcept alignas explicit requires".split())
_BUILT_IN = frozenset("void bool char short int long float double signed unsigned auto wchar_t char8_t char16_t char32_t".split())
_ATTRIBUTES = frozenset("__attribute__ __declspec alignas decltype explicit noexcept requires".split())
_TYPES = frozenset("class struct enum union namespace".split())
_ACCESS = frozenset("public private protected signals slots".split())


class Token(NamedTuple):
    kind: int
    text: str
    begin: int
    end: int


def tokens_of(text: str) -> list[Token]:
    """All tokens but comments and white space. What is not closed (comment, raw string) reaches to the end of the text."""
    found, at, line_start = [], 0, True
    while at < len(text):
        if text.startswith("/*", at):
            end = text.find("*/", at + 2)
            at = len(text) if end < 0 else end + 2
            continue
        if line_start and text[at] == "#":
            end = _DIRECTIVE.match(text, at).end()
            found.append(Token(DIRECTIVE, text[at:end], at, end))
            at = end
            continue
        m = _TOKEN.match(text, at)
        end, kind = m.end(), m.lastgroup
        if kind == "space":
            line_start = line_start or "\n" in m[0] and not m[0].startswith("//")
            at = end
            continue
        if m["raw"] is not None:
            mark = f'){m["guard"]}"'
            end = text.find(mark, end)
            end = len(text) if end < 0 else end + len(mark)
        found.append(Token(NAME if kind == "name" else MARK if kind == "mark" else VALUE, text[at:end], at, end))
        at, line_start = end, False
    return found


def matched(tokens: list[Token]) -> dict[int, int]:
    """Place of the closing token for each opening one that is closed, template argument lists included.

    A < after a name opens a list if it is closed before any ; { } ? or || and before a bracket around it is closed. && is allowed
    where a type may end. Each > closes one list, so >> closes two; a > that closes none compares.
    """
    pairs, open_ = {}, []  # places of opening tokens
    for k, (kind, text, _, _) in enumerate(tokens):
        if kind != MARK:
            continue
        if text in _OPEN:
            if text == "{":
                while open_ and tokens[open_[-1]].text == "<":
                    open_.pop()
            open_.append(k)
        elif text in _CLOSE:
            while open_ and tokens[open_[-1]].text == "<":
                open_.pop()
            if open_ and _OPEN[tokens[open_[-1]].text] == text:
                pairs[open_.pop()] = k
            elif text == "}":  # a bracket inside was never closed: the brace wins
                depth = next((d for d in range(len(open_) - 1, -1, -1) if tokens[open_[d]].text == "{"), None)
                if depth is not None:
                    pairs[open_[depth]] = k
                    del open_[depth:]
        elif text == "<" and k and tokens[k - 1].kind == NAME and tokens[k - 1].text != "operator":
            open_.append(k)
        elif text == ">" and open_ and tokens[open_[-1]].text == "<":
            pairs[open_.pop()] = k
        elif text in (";", "?", "||") or text == "&&" and (k + 1 == len(tokens) or tokens[k + 1].text not in (">", ",", ")", "...")):
            while open_ and tokens[open_[-1]].text == "<":
                open_.pop()
    return pairs


class _Header(NamedTuple):
    kind: str | None  # class, struct, enum, namespace, function; None for any other brace
    name: str | None
    begin: int  # the first token that belongs to the definition


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens = text, tokens_of(text)
        self.pairs = matched(self.tokens)
        self.opener = {b: a for a, b in self.pairs.items()}
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.chunks: list[list] = []
        self.calls: list[list[str]] = []
        self.seen = (-1, -1, False)  # where a header begins, how far it was searched for a constructor's list, and whether one was found

    def line(self, at: int) -> int:
        return bisect_left(self.lines, at) + 1

    def directives(self) -> tuple[list, list]:
        includes, constants, guards = [], [], 0
        for kind, text, begin, _ in self.tokens:
            if kind != DIRECTIVE:
                continue
            if m := re.match(r'#\s*include\s*(?:<([^>\n]+)>|"([^"\n]+)")', text):
                includes.append([m[1] or m[2], m[1] is not None, self.line(begin)])
            elif re.match(r"#\s*if", text):
                guards += 1
            elif re.match(r"#\s*endif", text):
                guards -= 1
            elif not guards and (m := re.match(r"#\s*define\s+([A-Za-z_]\w*)", text)):
                constants.append([m[1], self.line(begin)])
        return includes, constants

    def qualified(self, last: int) -> tuple[int, list[str]]:
        """Where the name that ends at a token begins, and its parts without template arguments; (last, []) if it is none."""
        parts, at = [], last
        while True:
            if self.tokens[at].text == ">" and at in self.opener:
                at = self.opener[at] - 1
            if at < 0 or self.tokens[at].kind != NAME:
                return last, []
            part = self.tokens[at].text
            if at and self.tokens[at - 1].text == "~":
                part, at = "~" + part, at - 1
            parts.append(part)
            if at < 2 or self.tokens[at - 1].text != "::":
                break
            if self.tokens[at - 2].kind != NAME and self.tokens[at - 2].text != ">":
                break
            at -= 2
        return at, parts[::-1]

    def header(self, begin: int, brace: int, in_code: bool) -> _Header:
        """What the tokens before a brace define. In a function's body only types are defined."""
        k, last, assigned = begin, brace - 1, False
        while k < brace:  # template lists and attributes before the definition are not part of it
            text = self.tokens[k].text
            if text == "template" and k + 1 in self.pairs:
                k = self.pairs[k + 1] + 1
            elif text == "[" and k in self.pairs and self.tokens[k + 1].text == "[":
                k = self.pairs[k] + 1
            else:
                break
        first, none = k, _Header(None, None, k)
        if k >= brace or self.tokens[k].text in _CONTROL:
            return none
        typed, params = None, None
        while k <= last:
            kind, text = self.tokens[k].kind, self.tokens[k].text
            if text in _TYPES and typed is None and kind == NAME:
                typed = k
            elif text == "=" and not (k and self.tokens[k - 1].text == "operator"):
                assigned = True
                break
            elif text == "operator":
                return _Header("function", None, first) if not in_code else none
            elif text == "(":
                before = self.tokens[k - 1] if k > first else None
                if before is not None and before.text not in _ATTRIBUTES and (before.kind == NAME or before.text == ">" and k - 1 in self.opener):
                    params = k
                    break
                if before is None or before.text not in _ATTRIBUTES:
                    return none
            elif text == ":" and typed is not None:
                last = k - 1
                break
            k = self.pairs[k] + 1 if text in ("(", "[", "<") and k in self.pairs else k + 1
        if assigned:
            return none
        if params is None:
            if typed is None or self.tokens[typed].text == "union":
                return none
            names = [k for k in range(typed + 1, last + 1) if self.tokens[k].kind == NAME and self.tokens[k].text not in ("class", "struct", "final") and not self.inside(k, typed)]
            _, parts = self.qualified(names[-1]) if names else (0, [])
            return _Header(self.tokens[typed].text, "::".join(parts) or None, first)
        if in_code:
            return none
        start, parts = self.qualified(params - 1)
        if not parts or parts[-1] in _NO_CALL or start and self.tokens[start - 1].text in ("]", ".", "->"):
            return none
        # the name of what is in A is what follows A; a destructor named inside its class has no name of its own
        name = "::".join(parts[1:]) if len(parts) > 1 else None if parts[0].startswith("~") else parts[0]
        return _Header("function", name, first)

    def inside(self, k: int, begin: int) -> bool:
        """Whether a token lies in brackets that open after another token."""
        return any(a < k < self.pairs.get(a, -1) for a in range(begin, k) if self.tokens[a].text in ("(", "[", "<"))

    def initialiser(self, begin: int, brace: int) -> bool:
        """Whether a brace gives a member its value in a constructor's list: after a name, and before a comma or the body."""
        before, close = self.tokens[brace - 1], self.pairs.get(brace)
        if close is None or close + 1 >= len(self.tokens) or self.tokens[close + 1].text not in (",", "{", "..."):
            return False
        if before.kind != NAME and not (before.text == ">" and brace - 1 in self.opener):
            return False
        _, k, listed = self.seen if self.seen[0] == begin else (begin, begin, False)
        while k < brace and not listed:
            listed = self.tokens[k].text == ":" and k > begin and self.tokens[k - 1].text in (")", "noexcept", "const", "try")
            k = self.pairs[k] + 1 if self.tokens[k].text in _OPEN and k in self.pairs else k + 1
        self.seen = (begin, k, listed)
        return listed

    def walk(self) -> None:
        """One pass over the tokens with a stack of open braces: (innermost chunk or None, whether statements are inside, the closing token)."""
        tokens, n = self.tokens, len(self.tokens)
        stack: list[tuple[int | None, bool, int]] = []
        begin, k, initial = 0, 0, False
        while k < n:
            kind, text, at, end = tokens[k]
            while stack and k >= stack[-1][2]:
                stack.pop()
                begin, initial = k + 1, False
            in_code = bool(stack) and stack[-1][1]
            if kind == MARK:
                if text == "{":
                    if not in_code and self.initialiser(begin, k):
                        k = self.pairs[k] + 1
                        continue
                    found = self.header(begin, k, in_code)
                    mine = owner = stack[-1][0] if stack else None
                    if found.kind and found.name:
                        mine = len(self.chunks)
                        close = self.pairs.get(k)
                        start, stop = tokens[found.begin].begin, tokens[close].end if close is not None else len(self.text)
                        symbol = found.kind if found.kind != "function" else "function" if owner is None else "method"
                        self.chunks.append([mine, owner, found.name, symbol, self.line(start), self.line(stop - 1 if close is not None else stop), self.text[start:stop], self.text[start:at], []])
                        self.calls.append([])
                    code = found.kind == "function" or found.kind is None and (in_code or initial)
                    stack.append((mine, code, self.pairs.get(k, n)))
                    begin, initial = k + 1, False
                elif text == "(" and not in_code and not initial and k in self.pairs:
                    k = self.pairs[k] + 1  # parameters, no calls
                    continue
                elif text == ";":
                    begin, initial = k + 1, False
                elif text == "=":
                    initial = True
                elif text == ":" and k and tokens[k - 1].text in _ACCESS:
                    begin = k + 1
            elif kind == DIRECTIVE:
                begin = k + 1 if begin == k else begin
            elif kind == NAME and (in_code or initial) and text not in _NO_CALL and text not in _BUILT_IN:
                self.call(k, stack)
            k += 1

    def call(self, k: int, stack: list[tuple[int | None, bool, int]]) -> None:
        after = k + 1
        if after in self.pairs and self.tokens[after].text == "<":
            after = self.pairs[after] + 1
        if after >= len(self.tokens) or self.tokens[after].text != "(":
            return
        start, _ = self.qualified(k)
        before = self.tokens[start - 1] if start else None
        if before is not None and before.kind == NAME and before.text not in _BEFORE_CALL:
            return  # a declaration of a variable, or new
        owner = stack[-1][0] if stack else None
        if owner is not None:
            self.calls[owner].append(self.tokens[k].text)


def read_cpp(text: str) -> tuple[list, list, list]:
    """Chunks, includes and constants of a file, as lists in the order of the text."""
    reader = _Reader(text)
    reader.walk()
    for chunk, names in zip(reader.chunks, reader.calls):
        chunk[8] = list(dict.fromkeys(names))
    return (reader.chunks, *reader.directives())
