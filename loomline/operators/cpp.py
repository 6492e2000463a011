"""C++ without a compiler: tokens, conditions, scopes and declarators of one file.

A file is read once, token by token, whatever its nesting: scopes are a linked list, not a call stack. A scope list and
the tokens of the unit that is open are the whole state, and they share their tails, so a condition costs nothing: each branch of
``#if`` begins in the state before it. After ``#endif`` reading goes on in the state of the first branch; where
branches opened scopes of their own, these wait for the same closing brace, and where they left different heads (two
signatures before one body), all are read. The ``#if 0`` side never gives the state.

What a unit declares is read by a grammar of declarators: pointers, references, arrays, parentheses, parameter lists
and qualified names, inside out. Types are as written; macros are not expanded, but a macro call before a declaration is told from it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

from loomline.functions import keys

_TOKEN = re.compile(
    r"""(?P<directive>^[ \t]*\#(?:/\*.*?(?:\*/|\Z)|//[^\n]*|\\\r?\n|[^\n])*)
    |(?P<comment>//(?:\\\r?\n|[^\n])*|/\*[^*]*(?:\*(?!/)[^*]*)*(?:\*/|\Z))
    |(?P<literal>(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)"|(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"?|(?:u8|[uUL])?'(?:\\.|[^'\\\n])*'?)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<number>\.?\d(?:[eEpP][+-]|'\w|[\w.])*)
    |(?P<mark>::|->\*?|\.\.\.|&&|[^\s])""",
    re.M | re.S | re.X,
)

_NOTE = re.compile(r'("(?:\\.|[^"\\\n])*")|/\*.*?(?:\*/|\Z)|//[^\n]*', re.S)
_HASH = re.compile(r"#\s*(\w*)\s*(.*)", re.S)
_DEFINED = re.compile(r"(\w+)(\([^)]*\))?")
_ELSE = re.compile(r"\s*#\s*(?:el|endif)")
_NEWLINE = re.compile("\n")
_ALONE = re.compile(r"[A-Z][A-Z0-9_]{2,}")
_WORDS = re.compile(r"\w+")
_ATTRIBUTES = re.compile(r"\[\[.*?\]\]")
_EXPLICIT = re.compile(r"^explicit\s*\([^)]*\)\s*")
_NO_TYPE = re.compile(r"[=?+|!%]|\breturn\b|\.(?!\.\.)")
_TEMPLATED = re.compile(r"\w\s*<")
_ARGUMENTS = re.compile(r"<[^<>]*>")
_OUTER = re.compile(r"\s*<.*?>")
_POINTER = re.compile(r"\*\s*(?:const\s*)?$")
_MARKS = re.compile(r"[\s*&]+$")
_TYPE = re.compile(r"[\w:]")

#: Words that name no function though brackets follow them.
_NO_NAME = frozenset("if for while switch catch return sizeof decltype alignas alignof static_assert new delete throw else do defined noexcept explicit requires typeof __attribute__ __declspec case".split())
#: Words that may stand behind a parameter list.
_BEHIND = frozenset("const volatile & && noexcept throw override final -> = : try requires [ { ; , __attribute__ mutable".split())
_STORAGE = frozenset("static extern inline constexpr consteval constinit thread_local register mutable typedef".split())
_FUNCTION_WORDS = frozenset("static virtual inline explicit constexpr consteval extern friend".split())
_BUILTIN = frozenset("void bool char short int long float double signed unsigned auto wchar_t char8_t char16_t char32_t const volatile".split())
_ACCESS = frozenset("public protected private signals slots Q_SIGNALS Q_SLOTS".split())
_NO_VARIABLE = frozenset("friend using return template namespace static_assert delete goto else case break continue if for while switch do throw asm".split())
_RECORDS = {"class": "class_decl", "struct": "struct_decl", "union": "union_decl"}
_CONVENTIONS = {"__cdecl": "cdecl", "__stdcall": "stdcall", "__fastcall": "fastcall", "__thiscall": "thiscall", "__vectorcall": "vectorcall"}
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: Below so many levels elements have no path and no code any more, which would grow with the square; parent ids and places lead on.
DEEP = 256


class _Scope:
    """An open brace, and the rows that end with it."""

    __slots__ = ("kind", "name", "at", "path", "inside", "level", "known", "up", "rows", "role", "rest", "more", "fields", "tried", "depth")

    def __init__(self, kind: str = "translation_unit", name: str = "", at: int = 0, up: _Scope | None = None, role: str = "units", row: dict | None = None) -> None:
        self.kind, self.name, self.at, self.up, self.role = kind, name, at, up, role
        self.known, self.rows, self.fields, self.tried = True, [row] if row else [], None, False
        self.more, self.rest = False, [None]  # whether the unit goes on behind the brace, and its heads so far
        self.path, self.inside, self.level, self.depth = [], False, 0, 0 if up is None else up.depth + 1

    def of(self, outer: _Scope, names: list[str]) -> _Scope:
        """What a scope that counts as a level takes from the one around it."""
        self.level = outer.level + 1
        self.path = None if outer.path is None or self.level > DEEP else [*outer.path, *names]
        self.inside = outer.inside or self.kind in keys.CLASS_LIKE or self.kind in ("union_decl", "function_decl", "cxx_method", "function_template")
        return self

    def like(self, outer: _Scope) -> _Scope:
        """A brace that is no level of its own."""
        self.kind, self.name, self.at, self.path, self.inside, self.level, self.known = outer.kind, outer.name, outer.at, outer.path, outer.inside, outer.level, outer.known
        return self


class Declarator:
    """One declared name: its owner as written, its type, and its parameters if it is a function."""

    __slots__ = ("name", "owner", "type", "call")

    def __init__(self, name: str, owner: str, type_: str, call: tuple[int, int] | None) -> None:
        self.name, self.owner, self.type, self.call = name, owner, type_, call


class Head:
    """The tokens of a unit, for reading its declarators."""

    def __init__(self, file: Tokens, tokens: list[int]) -> None:
        self.file, self.tokens = file, tokens
        self.words = [file.texts[t] for t in tokens]
        self.match = self._matched()

    def _matched(self) -> dict[int, int]:
        """Places of brackets that belong together, both ways; ``<`` counts where a template's arguments can begin."""
        out, open_ = {}, []
        for i, w in enumerate(self.words):
            if w in ("(", "[", "{"):
                open_.append(i)
            elif w in _CLOSES:
                while open_ and self.words[open_[-1]] == "<":
                    open_.pop()
                if open_ and self.words[open_[-1]] == _CLOSES[w]:
                    out[open_.pop()] = i
            elif w == "<" and i and (self.words[i - 1].isidentifier() or self.words[i - 1] == ">") and self.words[i - 1] != "operator":
                open_.append(i)
            elif w == ">" and open_ and self.words[open_[-1]] == "<" and self.words[i - 1] != "operator":
                out[open_.pop()] = i
            elif w == ";" or (w == "=" and open_ and self.words[open_[-1]] == "<" and not self._in_template(open_[-1])):
                while open_ and self.words[open_[-1]] == "<":
                    open_.pop()
        return out | {b: a for a, b in out.items()}

    def _in_template(self, at: int) -> bool:
        return at > 0 and self.words[at - 1] == "template"

    def text(self, start: int, end: int) -> str:
        """The source of tokens, with white space and comments as single blanks."""
        out, last = [], None
        for t in self.tokens[start:end]:
            a, b = self.file.starts[t], self.file.ends[t]
            out.append((" " if last is not None and a > last else "") + self.file.texts[t])
            last = b
        return "".join(out)

    def split(self, start: int, end: int, mark: str = ",") -> list[tuple[int, int]]:
        """Spans between marks outside brackets."""
        out, last, i = [], start, start
        while i < end:
            if self.words[i] == mark:
                out.append((last, i))
                last = i + 1
            i = self.match[i] + 1 if self.match.get(i, -1) > i else i + 1
        return [(a, b) for a, b in (*out, (last, end)) if a < b]

    def find(self, marks: tuple[str, ...] | frozenset, start: int, end: int) -> int:
        """The first of the marks outside brackets and operators' names, or end."""
        i, words, match = start, self.words, self.match
        while i < end:
            word = words[i]
            if word in marks:
                return i
            if word == "operator":
                i = self.past_operator(i, end)
            else:
                i = max(match.get(i, i), i) + 1
        return end

    def past_operator(self, i: int, end: int) -> int:
        """The bracket of the parameters of the operator whose name begins at i."""
        i += 1
        if i + 1 < end and self.words[i] == "(" and self.words[i + 1] == ")":
            return i + 2
        while i < end and self.words[i] != "(":
            i += 1
        return i

    def name_before(self, end: int, start: int) -> tuple[int, str, str] | None:
        """(where it begins, name, owner) of the name that ends before ``end``."""
        i = end - 1
        for j in range(end - 1, max(start, end - 12) - 1, -1):  # operator and what follows it
            if self.words[j] == "operator":
                symbol = all(not w.isidentifier() for w in self.words[j + 1 : end])
                name = "operator" + ("" if symbol else " ") + self.text(j + 1, end)
                return self._owner(j, start, name)
            if self.words[j] in (";", "{", "}"):
                break
        if i >= start and self.words[i] == ">" and i in self.match:
            i = self.match[i] - 1
        if i < start or not self.words[i].isidentifier() or self.words[i] in _NO_NAME:
            return None
        name = self.words[i]
        if i > start and self.words[i - 1] == "~":
            i, name = i - 1, "~" + name
        return self._owner(i, start, name)

    def _owner(self, i: int, start: int, name: str) -> tuple[int, str, str]:
        first = i
        while first - 1 >= start and self.words[first - 1] == "::":
            j = first - 2
            if j >= start and self.words[j] == ">" and j in self.match:
                j = self.match[j] - 1
            if j < start or not self.words[j].isidentifier() or self.words[j] in _BUILTIN:
                first -= 1
                break
            first = j
        return first, name, self.text(first, i).rstrip(":").strip()

    def declarator(self, start: int, end: int, base: str | None = None) -> Declarator | None:
        """Of ``type declarator``, or with a base of a declarator alone: read from the name outwards."""
        stop = self.find(("=", "{", ":"), start, end)
        i, paren = start, -1
        while i < stop:  # the first bracket behind something that is no word of a specifier
            if self.words[i] == "(":
                paren = i
                break
            if self.words[i] in _NO_NAME and i + 1 < stop and self.words[i + 1] == "(" and i + 1 in self.match:
                i = self.match[i + 1] + 1
                continue
            if self.words[i] == "operator":
                i = self.past_operator(i, stop)
                continue
            i = self.match[i] + 1 if self.match.get(i, -1) > i else i + 1
        close = self.match.get(paren, -1)
        if close > 0:
            inner = self._pointed(paren + 1, close)
            if inner is not None and (base is not None or paren > start and self.words[close + 1 : close + 2] in (["("], ["["])):  # ( * name ): the brackets are the declarator's own
                before = f"{base or ''} {self.text(start, paren)}".strip()
                ops, a, b = inner
                found = self.declarator(a, b, "") if b > a else None
                if found is None:
                    return None
                if found.call is not None:  # a function that returns what points
                    return Declarator(found.name, found.owner, f"{before} ({ops})({self.text(close + 2, self.match.get(close + 1, close + 2))})", found.call)
                rest = self.text(close + 1, self._suffixes(close + 1, stop))
                return Declarator(found.name, found.owner, f"{before} ({ops}){rest}".strip(), None)
            named = self.name_before(paren, start)
            if named is not None:
                first, name, owner = named
                return Declarator(name, owner, base if base is not None else self.text(start, first), (paren, close))
            return None
        # no brackets: type, then name, then array bounds
        last = stop
        while last - 1 > start and self.words[last - 1] == "]" and last - 1 in self.match:
            last = self.match[last - 1]
        named = self.name_before(last, start)
        if named is None or named[1].startswith(("~", "operator")):
            return None
        first, name, owner = named
        if base is None and (first == start or self.words[first - 1] in ("class", "struct", "union", "enum")):
            return None
        return Declarator(name, owner, self.text(start, first) if base is None else f"{base} {self.text(start, first)}".strip(), None)

    def _pointed(self, start: int, end: int) -> tuple[str, int, int] | None:
        """(pointer operators, declarator from, to) of what begins with * & or a member pointer; None if it does not."""
        i = start
        while i < end:
            if self.words[i] in ("*", "&", "&&", "^", "const", "volatile") or self.words[i] in _CONVENTIONS:
                i += 1
            elif self.words[i].isidentifier() and "::" in self.words[i + 1 : end] and (star := self.find(("*",), i, end)) < end and self.words[star - 1] == "::":
                i = star + 1
            else:
                break
        return (self.text(start, i), i, end) if any(w in ("*", "&", "&&", "^") for w in self.words[start:i]) else None

    def _suffixes(self, i: int, end: int) -> int:
        while i < end and self.words[i] in ("(", "[") and i in self.match:
            i = self.match[i] + 1
        return i


class Tokens:
    """The tokens of a text, without comments; a directive is one token."""

    def __init__(self, code: str) -> None:
        self.code = code
        found = [(kind, *m.span()) for m in _TOKEN.finditer(code) if (kind := m.lastgroup) != "comment"]  # of nested groups the outer one
        self.kinds: list[str] = [x[0] for x in found]
        self.starts: list[int] = [x[1] for x in found]
        self.ends: list[int] = [x[2] for x in found]
        self.texts: list[str] = [code[a:b] for _, a, b in found]


@lru_cache(maxsize=1 << 12)
def _parted(text: str) -> tuple[str, str]:
    """The word of a directive and the rest of its line; most directives of a project are the same few lines."""
    plain = text.replace("\\\n", " ") if '"' not in text and "/" not in text else _NOTE.sub(lambda m: m[1] or " ", text).replace("\\\n", " ")
    m = _HASH.match(plain)
    return m[1], m[2].strip()


class Scanner(Tokens):
    """All elements of one file, in ``found``, ordered by place. Without ``signatures`` only their names and types are read, where nothing else needs the rest."""

    def __init__(self, code: str, location: str, skip: Callable[[str], bool] | None = None, signatures: bool = True) -> None:
        self.code, self.location, self.signatures = code, location, signatures
        self.lines = [0, *(m.end() for m in _NEWLINE.finditer(code))]
        self.found: list[dict] = []
        self.records: dict[str, _Scope] = {}  # of this file, by name and by qualified name
        self.emitted: dict[int, dict] = {}  # rows of records and enumerations, by their opening brace
        self.tests: dict[int, tuple[tuple, str]] = {}  # conditions of heads that differ by branch
        if not (skip and skip(location)):
            super().__init__(code)
            self._read()
            self._finish()

    # conditions ------------------------------------------------------------------------------------------------

    def _directive(self, t: int, ifs: list) -> tuple[str, str]:
        """Adds the row; gives its word and the rest of the line."""
        text = self.texts[t].lstrip()
        start = self.ends[t] - len(text)
        word, rest = _parted(text)
        top = _Scope()
        if word == "define" and (d := _DEFINED.match(rest)):
            self._add("macro_definition", d[1], start, self.ends[t], top, ifs, code=False, macro_args=[a.strip() for a in d[2][1:-1].split(",") if a.strip()] if d[2] else None)
        elif word == "include":
            self._add("inclusion_directive", rest.strip(' "<>\t'), start, self.ends[t], top, ifs, include_kind="quoted" if rest.startswith('"') else "angled" if rest.startswith("<") else "computed")
        elif word:
            self._add("preprocessing_directive", word, start, self.ends[t], top, ifs)
        return word, rest

    def _read(self) -> None:
        """One pass over the tokens. ``heads``: the open units' tokens as linked lists, one for each way through the conditions."""
        self.scope, self.heads, self.open = _Scope(), [None], None
        groups: list[dict] = []  # of open conditions
        ifs: list[str] = []
        self.pairs: list[int] = []
        self.match: dict[int, int] = {}  # of bodies: brackets, closing to opening
        for t, (text, kind) in enumerate(zip(self.texts, self.kinds, strict=True)):
            if kind != "mark" and kind != "directive":  # words, numbers and literals open and end nothing
                role, heads = self.scope.role, self.heads
                if role == "units":
                    self.heads = [(t, heads[0])] if len(heads) == 1 else [(t, h) for h in heads]
                elif role == "handlers":
                    self._in_handlers(t, text, ifs)
                continue
            if kind == "directive":
                # the conditions of #else are those of its group, not of the branch before
                own = groups and _ELSE.match(text) is not None
                word, rest = self._directive(t, [g["now"] for g in (groups[:-1] if own else groups) if g["now"]])
                self._condition(t, word, rest, groups)
                ifs = [g["now"] for g in groups if g["now"]]
                continue
            if text in ("(", "["):
                self.pairs.append(t)
            elif text in (")", "]") and self.pairs and self.texts[self.pairs[-1]] == _CLOSES[text]:
                self.match[t] = self.pairs.pop()
            if self.scope.role == "body":
                self._in_body(t, text, ifs)
            elif self.scope.role == "handlers":
                self._in_handlers(t, text, ifs)
            else:
                self._in_units(t, text, ifs)

    def _condition(self, t: int, word: str, rest: str, groups: list[dict]) -> None:
        state = (self.scope, self.heads, self.open)
        if word in ("if", "ifdef", "ifndef"):
            test = rest if word == "if" else f"{'!' * (word == 'ifndef')}defined({rest})"
            guard = word == "ifndef" and not groups and t + 1 < len(self.texts) and re.fullmatch(rf"\s*#\s*define\s+{re.escape(rest)}\s*", self.texts[t + 1]) is not None
            groups.append({"before": state, "tests": [test], "now": None if guard else test, "ends": [], "dead": rest in ("0", "false")})
        elif word in ("elif", "else", "elifdef", "elifndef") and groups:
            g = groups[-1]
            g["ends"].append((*state, g["now"], g["dead"]))
            past = " && ".join(f"!({x})" for x in g["tests"])
            test = None if word == "else" else rest if word == "elif" else f"{'!' * (word == 'elifndef')}defined({rest})"
            g["now"] = past if test is None else f"{past} && ({test})"
            g["dead"] = word != "else" and test in ("0", "false") or word == "else" and g["tests"] == ["1"]
            if test is not None:
                g["tests"].append(test)
            g["else"] = word == "else"
            self.scope, self.heads, self.open = g["before"]
        elif word == "endif" and groups:
            g = groups.pop()
            ends = [*g["ends"], (*state, g["now"], g["dead"])]
            if not g.get("else"):  # none of the branches may hold
                ends.append((*g["before"], None, False))
            alive = [e for e in ends if not e[4]] or [(*g["before"], None, False)]
            for e in ends:
                if e[4]:
                    self._abandon(e[0], alive[0][0], self.starts[t])
            self._merge(alive, implicit=not g.get("else"), at=self.starts[t])

    def _merge(self, states: list[tuple], implicit: bool, at: int) -> None:
        """Goes on in the first state; the others' scopes wait for the same braces, or end here."""
        self.scope, self.heads, self.open = states[0][:3]
        others = states[1 : -1 if implicit else None]
        for scope, heads, open_, *_ in others:
            if scope is not self.scope:
                one, two = self._chain(self.scope, scope), self._chain(scope, self.scope)
                if len(one) == len(two):
                    for a, b in zip(one, two, strict=True):
                        a.rows += [r for r in b.rows if r not in a.rows]
                else:
                    self._abandon(scope, self.scope, at)
            elif open_ == self.open and len(self.heads) < 16:
                self.heads = self.heads + [h for h in heads if not any(h is x for x in self.heads)]
        if len(self.heads) > 1:  # each has the condition of its branch
            for _, heads, _, test, _ in [states[0], *others]:
                for h in heads:
                    if h is not None and test:
                        self.tests[id(h)] = (h, test)

    @staticmethod
    def _chain(scope: _Scope, other: _Scope) -> list[_Scope]:
        """The scopes from scope up to the first that is also around other."""
        a, b, out = scope, other, []
        while a is not b and a is not None:
            if b is not None and b.depth > a.depth:
                b = b.up
                continue
            if b is not None and b.depth == a.depth:
                b = b.up
            out.append(a)
            a = a.up
        return out

    def _abandon(self, scope: _Scope, kept: _Scope, at: int) -> None:
        for s in self._chain(scope, kept):
            for r in s.rows:
                r.setdefault("stop", at)

    # bodies ----------------------------------------------------------------------------------------------------

    def _in_body(self, t: int, text: str, ifs: list[str]) -> None:
        if text == "{":
            start, kind = self._opener(t)
            row = self._add(kind, None, self.starts[start], None, self.scope, ifs) if kind else None
            self.scope = _Scope(up=self.scope, role="body", row=row).like(self.scope)
        elif text == "}":
            self._close(t)

    def _in_handlers(self, t: int, text: str, ifs: list[str]) -> None:
        """Between the handlers of a function's try block."""
        if text == "catch":
            self.scope.rest = [(t, None)]
        elif text == "{":
            row = self._add("cxx_catch_stmt", None, self.starts[self.scope.rest[0][0]], None, self.scope, ifs)
            self.scope = _Scope(up=self.scope, role="body", row=row).like(self.scope)
        elif text == "}":
            self._close(t)

    def _opener(self, t: int) -> tuple[int, str | None]:
        """What opens a brace in a body: (its first token, lambda_expr, cxx_try_stmt or cxx_catch_stmt), else no kind."""
        i, texts = t - 1, self.texts
        if i >= 0 and texts[i] == "try":
            return i, "cxx_try_stmt"
        for _ in range(24):  # specifiers and a trailing return type
            if i < 0 or texts[i] in (")", "]"):
                break
            if not (self.kinds[i] == "word" or texts[i] in ("::", "<", ">", "*", "&", "&&", "->", ",")):
                return t, None
            i -= 1
        if i < 0 or texts[i] not in (")", "]") or i not in self.match:
            return t, None
        o = self.match[i]
        if texts[i] == ")":
            if o and texts[o - 1] == "noexcept":
                o -= 1
                if o and texts[o - 1] == ")" and o - 1 in self.match:
                    o = self.match[o - 1]
            if o and texts[o - 1] == "catch" and i == t - 1:
                return o - 1, "cxx_catch_stmt"
            if not o or texts[o - 1] != "]" or o - 1 not in self.match:
                return t, None
            o = self.match[o - 1]
        before = texts[o - 1] if o else ""
        subscript = o > 0 and (self.kinds[o - 1] == "word" and before not in ("return", "co_return", "co_yield", "co_await", "throw", "case", "else") or before in (")", "]", "["))
        return (t, None) if subscript else (o, "lambda_expr")

    # scopes ----------------------------------------------------------------------------------------------------

    def _close(self, t: int) -> None:
        scope = self.scope
        if scope.up is None:  # closes nothing
            self.heads, self.open = [None], None
            return
        handled = t + 1 < len(self.texts) and self.texts[t + 1] == "catch"
        waiting = scope.rows[:1] if scope.tried and handled else []  # its handlers belong to a function
        for r in scope.rows:
            if not any(r is x for x in waiting):
                r.setdefault("stop", self.ends[t])
        self.scope = scope.up
        if scope.role != "skip":
            self.heads, self.open = [None], None
        if waiting:
            self.scope = _Scope(up=scope.up, role="handlers", row=waiting[0]).like(scope)
        elif scope.role == "body" and scope.up.role == "handlers" and not handled:
            self._close(t)
        elif scope.more:  # the unit goes on behind its braces
            self.heads, self.open = scope.rest, None
            self._take(t)
        if self.scope.role != "body":
            self.pairs.clear()

    def _take(self, t: int) -> None:
        self.heads = [(t, h) for h in self.heads]

    def _in_units(self, t: int, text: str, ifs: list[str]) -> None:
        """A token of a declaration, outside of function bodies; ``open`` holds brackets that are open in it."""
        if self.scope.role == "skip":  # braces of an initialiser or an enumeration
            if text == "{":
                self.scope = _Scope(up=self.scope, role="skip").like(self.scope)
            elif text == "}":
                self._close(t)
            return
        if text in ("(", "[") or text == "{" and self.open is not None:
            self.open = (text, self.open)
            self._take(t)
        elif text in _CLOSES and self.open is not None:
            if self.open[0] == _CLOSES[text]:
                self.open = self.open[1]
                self._take(t)
            elif text == "}":  # a bracket was never closed
                self.heads, self.open = [None], None
                self._close(t)
        elif self.open is not None:
            if text == ";" and self.open[1] is None and self.open[0] == "(":  # never closed
                self.heads, self.open = [None], None
            else:
                self._take(t)
        elif text == "}":
            self.heads = [None]
            self._close(t)
        elif text == ";":
            self._ended(t, ifs)
        elif text == "{":
            self._opened(t, ifs)
        elif text == ":" and self.heads[0] is not None and self._label():
            self.heads = [None]
        else:
            self._take(t)

    def _label(self) -> bool:
        """Whether the open unit is public, protected or the like, a macro's name before it allowed."""
        words, h = [], self.heads[0]
        while h is not None and len(words) < 4:
            words.append(self.texts[h[0]])
            h = h[1]
        return h is None and words[0] in _ACCESS and all(w.isidentifier() for w in words)

    def _listed(self, head: tuple | None, ifs: list[str]) -> tuple[list[int], list[str]]:
        """The tokens of a head, and the conditions that hold for it."""
        out, tests = [], []
        if not self.tests:
            while head is not None:
                out.append(head[0])
                head = head[1]
            return out[::-1], ifs
        while head is not None:
            if id(head) in self.tests:
                tests.append(self.tests[id(head)][1])
            out.append(head[0])
            head = head[1]
        return out[::-1], ifs + tests[::-1]

    def _stripped(self, head: Head) -> tuple[int, int, list | None, int]:
        """(where the unit begins, where its declaration, template parameters, number of template headers): macros before it aren't part of it; attributes and template headers are."""
        w, i, begin, templates, n = head.words, 0, 0, None, 0
        while i < len(w):
            if w[i] == "[" and i + 1 < len(w) and w[i + 1] == "[" and i in head.match:
                i = head.match[i] + 1
            elif w[i] == "template" and i + 1 < len(w) and w[i + 1] == "<" and i + 1 in head.match:
                templates, n = self._template_parameters(head, i + 2, head.match[i + 1]), n + 1
                i = head.match[i + 1] + 1
            elif w[i] == "extern" and i + 1 < len(w) and head.file.kinds[head.tokens[i + 1]] == "literal":
                i += 2
            elif (past := self._macro(head, i)) > i:
                i, begin = past, past if begin == i else begin
            else:
                break
        return begin, i, templates, n

    def _macro(self, head: Head, i: int) -> int:
        """Where a macro's use that stands before a declaration ends: NAME(...) something, or NAME alone on its line; i if there is none."""
        w = head.words
        if not w[i].isidentifier() or w[i] in _NO_NAME or w[i] in _BUILTIN or i + 1 >= len(w):
            return i
        if w[i + 1] == "(":
            close = head.match.get(i + 1, -1)
            return close + 1 if close > 0 and close + 2 < len(w) and w[close + 1].isidentifier() and w[close + 1] not in _BEHIND else i
        alone = _ALONE.fullmatch(w[i]) and w[i + 1].isidentifier() and i + 2 < len(w)
        return i + 1 if alone and "\n" in self.code[self.ends[head.tokens[i]] : self.starts[head.tokens[i + 1]]] else i

    def _template_parameters(self, head: Head, start: int, end: int) -> list[dict]:
        """Type and non-type parameters with defaults."""
        out = []
        for a, b in head.split(start, end):
            eq = head.find(("=",), a, b)
            typed = head.words[a] in ("typename", "class")
            names = [x for x in head.words[a + 1 if typed else a : eq] if x.isidentifier()]
            out.append({"kind": "type" if typed else "non_type", "name": names[-1] if names else "", "default_value": head.text(eq + 1, b) if eq < b else None})
        return out

    # units -----------------------------------------------------------------------------------------------------

    def _opened(self, t: int, ifs: list[str]) -> None:
        """A brace behind the open heads: what it opens."""
        made: _Scope | None = None
        heads, seen = self.heads, []
        for h in heads:
            listed, tests = self._listed(h, ifs)
            scope = self._opens(t, Head(self, listed), listed, tests, seen)
            if made is None:
                made = scope
                if scope.role == "skip":  # within a unit: nothing is decided yet
                    break
            elif scope.rows and scope.role == made.role:
                made.rows += scope.rows
        if made.more:
            made.rest = [(t, h) for h in heads]
        self.scope, self.heads, self.open = made, [None], None

    def _opens(self, t: int, head: Head, listed: list[int], ifs: list[str], seen: list) -> _Scope:
        scope, w = self.scope, head.words
        begin, i, template, n = self._stripped(head)
        start = self.starts[listed[begin]] if begin < len(listed) else self.starts[t]
        rest = w[i:]
        if not rest:
            units = _Scope(up=scope).like(scope)  # extern "C", or a stray brace
            if not listed and scope.kind != "translation_unit":
                units.role = "skip"
            return units
        if "namespace" in rest[:2] and rest[0] in ("namespace", "inline"):  # E9
            names = [x for x in rest[rest.index("namespace") + 1 :] if x.isidentifier() and x != "inline"]
            name = "::".join(names)
            row = self._add("namespace", name, start, None, scope, ifs, code=False) if self._new(seen, "namespace", name) else None
            return _Scope("namespace", name, start, scope, row=row).of(scope, [name or "(anonymous)"])
        eq = head.find(("=",), i, len(w))
        paren = head.find(("(",), i, len(w))
        key = head.find(frozenset(("class", "struct", "union", "enum")), i, min(eq, len(w)))
        if key < len(w) and eq == len(w):
            base = head.find((":",), key, len(w))
            calls = [p for p in (paren,) if p < base and not (w[p - 1] in ("alignas", "__declspec", "__attribute__") or w[p - 1].isupper())]
            if not calls:
                return self._record(t, head, key, base, i, start, template, ifs, seen) if w[key] != "enum" else self._enum(t, head, key, base, i, start, ifs, seen)
        if eq == len(w):
            call = self._function(head, i, scope, template, n, True)
            if call is not None:
                made, after = call
                colon = head.find((":",), after, len(w))
                if colon < len(w) and (w[-1].isidentifier() or w[-1] == ">"):  # a member's initialiser
                    return self._within(t, ifs)
                return self._body(head, made, after, start, ifs, seen)
        return self._within(t, ifs)

    def _within(self, t: int, ifs: list[str]) -> _Scope:
        """Braces in a unit that goes on behind them: an initialiser's, a lambda's or an enumeration's."""
        start, kind = self._opener(t)
        row = self._add(kind, None, self.starts[start], None, self.scope, ifs) if kind == "lambda_expr" else None
        out = _Scope(up=self.scope, role="skip", row=row).like(self.scope)
        out.more = True
        return out

    @staticmethod
    def _new(seen: list, *what) -> bool:
        """Whether another head of the same place has not given the same."""
        if what in seen:
            return False
        seen.append(what)
        return True

    def _record(self, t: int, head: Head, key: int, base: int, i: int, start: int, template: list | None, ifs: list[str], seen: list) -> _Scope:
        """E4, E5, E13."""
        w, j, name, special = head.words, key + 1, "", False
        while j < base:
            if w[j] == "[" and j in head.match or w[j] == "(" and j in head.match:
                j = head.match[j] + 1
            elif w[j] == "<" and j in head.match:
                special, j = True, head.match[j] + 1
            else:
                if w[j].isidentifier() and w[j] not in ("final", "alignas", "__declspec", "__attribute__"):
                    name, special = w[j], False
                j += 1
        scope, kind = self.scope, _RECORDS[w[key]]
        if template is not None and kind != "union_decl":
            kind = "class_template_partial_specialization" if special else "class_template"
        own = _Scope(kind, name, start, scope).of(scope, [name or "(anonymous)"])
        own.more, own.fields = True, [] if kind == "union_decl" else None
        if self._new(seen, kind, name):
            row = self._add(kind, name, start, None, scope, ifs, template_parameters=template, is_defined=True)
            if kind == "union_decl":
                row["fields"] = own.fields
            self.emitted[t], own.rows = row, [row]  # at the brace it ends at the latest, if no semicolon follows
            self._attributes(head, 0, key + 6, own, ifs)
        if name and not special:
            if own.path is not None:
                self.records["::".join(own.path)] = own
            self.records.setdefault(name, own)
        return own

    def _enum(self, t: int, head: Head, key: int, base: int, i: int, start: int, ifs: list[str], seen: list) -> _Scope:
        """E16."""
        w, j = head.words, key + 1
        scoped = j < len(w) and w[j] in ("class", "struct")
        names = [x for x in w[j + scoped : base] if x.isidentifier()]
        out = self._within(t, ifs)
        name = names[-1] if names else ""
        if not self.scope.inside and self._new(seen, "enum", name):
            self.emitted[t] = self._add("enum_decl", name, start, None, self.scope, ifs, is_scoped=scoped, underlying_type=head.text(base + 1, len(w)) or None)
        return out

    def _function(self, head: Head, i: int, scope: _Scope, template: list | None, n: int, body: bool) -> tuple[dict, int] | None:
        """What a head declares if it is a function, and where its parameter list ends."""
        w = head.words
        if i >= len(w) or w[i] in ("using", "typedef") or w[i] in _NO_VARIABLE and w[i] != "friend":
            return None
        d = head.declarator(i, len(w))
        if d is None or d.call is None:
            return None
        open_, close = d.call
        end = close + 1
        while "(" in d.type and end < len(w) and w[end] in (")", "(", "["):  # a function that returns a pointer to one
            end = head.match[end] + 1 if head.match.get(end, -1) > end else end + 1
        behind = w[end] if end < len(w) else ""
        if behind and behind not in _BEHIND and not behind.isidentifier():
            return None
        if body and behind == ",":
            return None
        if behind == "=" and (end + 1 >= len(w) or w[end + 1] not in ("0", "default", "delete")):
            return None
        params = [(a, b) for a, b in head.split(open_ + 1, close) if w[a:b] != ["void"]]
        if any(head.file.kinds[head.tokens[a]] in ("number", "literal") or w[a] in ("-", "!", "{", "this", "nullptr", "true", "false") for a, b in params) and not body:
            return None  # a variable with arguments
        words = set(_WORDS.findall(d.type))
        type_ = " ".join(x for x in (_ATTRIBUTES.sub(" ", d.type) if "[[" in d.type else d.type).split() if x not in _FUNCTION_WORDS and not x.startswith("__"))
        if type_.startswith("explicit"):
            type_ = _EXPLICIT.sub("", type_)
        name, owner = d.name, d.owner
        inner = owner or (scope.name if scope.kind in keys.CLASS_LIKE or scope.kind == "union_decl" else "")
        short = inner.split("::")[-1].partition("<")[0].strip()
        special = name.startswith("~") or name.startswith("operator") or bool(inner) and name == short
        trail = w[end : head.find(("{", ";", ":"), end, len(w))]
        arrow = head.find(("->",), end, len(w))
        if not type_ and not special and not body and arrow == len(w):
            return None  # a macro's call
        if _NO_TYPE.search(type_):
            return None
        if arrow < len(w):
            type_ = head.text(arrow + 1, head.find(("{", ";", "=", "override", "final", "requires"), arrow + 1, len(w)))
        if n and n <= len(_TEMPLATED.findall(owner)):
            template = None  # its header is the owner's
        if name.startswith("operator") and re.match(r"operator\s+\w", name) and not re.match(r"operator (?:new|delete|co_await)\b", name):
            kind = "conversion_function"
        elif template is not None:
            kind = "function_template"
        elif name.startswith("~"):
            kind = "destructor"
        elif inner and name == short:
            kind = "constructor"
        else:
            kind = "cxx_method" if inner else "function_decl"
        if not self.signatures and len(self.heads) == 1:  # several heads of one place are told apart by their parameters
            return {"kind": kind, "signature": {"name": name[1:] if kind == "destructor" else name, "return_type": " ".join(type_.split()), "parameters": []}, "rich": None, "template": template, "owner": owner}, end
        equal = head.find(("=",), end, len(w))
        declared = [self.parameter(head, a, b) for a, b in params]
        throwing = "noexcept" in trail and trail[trail.index("noexcept") + 1 : trail.index("noexcept") + 3] == ["(", "false"]
        sig = {
            "name": name,
            "return_type": " ".join(type_.split()),
            "parameters": [{k: p[k] for k in ("name", "type", "default_value")} for p in declared],
            "qualifiers": {
                "is_const": "const" in trail[: trail.index("->") if "->" in trail else None],
                "is_static": "static" in words,
                "is_virtual": "virtual" in words,
                "is_pure_virtual": equal + 1 < len(w) and w[equal + 1] == "0",
                "is_noexcept": "noexcept" in trail and not throwing,
                "is_override": "override" in trail,
                "is_final": "final" in trail,
            },
        }
        storage = next((x for x in ("static", "extern") if x in words), None)
        rich = {
            "storage_class": storage, "calling_convention": next((c for x, c in _CONVENTIONS.items() if x in words), None), "is_explicit": "explicit" in words, "is_volatile": "volatile" in trail,
            "parameters": [{k: p[k] for k in ("name", "type_kind", "is_const", "is_volatile", "is_reference", "is_pointer")} for p in declared],
        }
        if kind == "destructor":
            sig["name"] = name[1:]
        return {"kind": kind, "signature": sig, "rich": rich, "template": template, "owner": owner}, end

    def parameter(self, head: Head, start: int, end: int) -> dict:
        """Name, type and default of one parameter, and the kind of its type."""
        eq = head.find(("=",), start, end)
        w = head.words
        d = head.declarator(start, eq) if not (w[start:eq][-1:] and w[eq - 1] in _BUILTIN) else None
        if d is not None and (d.call is not None or not d.name.isidentifier() or not d.type or d.type.split()[-1:] in (["const"], ["struct"], ["class"], ["typename"]) and len(d.type.split()) == 1):
            d = None
        if d is not None and d.name and w[start:eq].count(d.name) and d.owner:
            d = None  # a qualified type without a name
        type_ = d.type if d is not None else head.text(start, eq)
        if d is not None:
            at = eq
            while at - 1 > start and w[at - 1] == "]" and at - 1 in head.match:
                at = head.match[at - 1]
            if w[at - 1] == d.name:
                type_ += head.text(at, eq)
        type_ = " ".join(type_.split())
        pointer = "(*" in type_.replace(" ", "")
        kind = "function_pointer" if pointer else "pack" if "..." in type_ else "array" if type_.endswith("]") else "rvalue_reference" if type_.endswith("&&") else "lvalue_reference" if type_.endswith("&") else "pointer" if _POINTER.search(type_) else "value"
        return {
            "name": d.name if d is not None else "", "type": type_, "default_value": head.text(eq + 1, end) if eq < end else None,
            "type_kind": kind, "is_const": "const" in type_.split() or type_.startswith("const "), "is_volatile": "volatile" in type_.split(), "is_reference": kind.endswith("reference"), "is_pointer": kind in ("pointer", "function_pointer"),
        }

    def _home(self, scope: _Scope, owner: str) -> tuple[_Scope, str | None]:
        """The scope that a name with an owner belongs to, and the owner's whole name."""
        if not owner or scope.kind in keys.CLASS_LIKE:
            return scope, None
        bare = (_OUTER.sub("", _ARGUMENTS.sub("", owner)) if "<" in owner else owner).replace(" ", "")
        whole, bare = bare.startswith("::"), bare.lstrip(":")
        outside = bare if whole else "::".join([*(scope.path or []), bare])
        short = bare.split("::")[-1]
        found = next((self.records[x] for x in ((outside,) if whole else (outside, bare, short)) if x in self.records), None)
        if found is None:
            found = _Scope("class_decl", short, scope.at, scope)
            found.path, found.inside, found.level, found.known = scope.path, scope.inside, scope.level, False
        return found, outside

    def _body(self, head: Head, made: dict, after: int, start: int, ifs: list[str], seen: list) -> _Scope:
        scope = self.scope
        inner, outside = self._home(scope, made["owner"])
        name = made["signature"]["name"]
        out = _Scope(made["kind"], name, start, scope, role="body").of(inner, [name])
        if self._new(seen, made["kind"], name, str(made["signature"]["parameters"])):
            out.rows = [self._add(made["kind"], name, start, None, inner, ifs, signature=made["signature"], rich=made["rich"], is_defined=True, template_parameters=made["template"], owner=outside)]
            self._attributes(head, 0, len(head.words), out, ifs)
        tried = head.find(("try",), after, len(head.words))
        if tried < len(head.words) and out.rows:  # E37: the whole body may throw
            out.rows.append(self._add("cxx_try_stmt", None, self.starts[head.tokens[tried]], None, out, ifs))
            out.tried = True
        return out

    def _attributes(self, head: Head, start: int, end: int, scope: _Scope, ifs: list[str]) -> None:
        """[[...]] of a declaration, one row for each name in it."""
        w = head.words
        for i in range(start, min(end, len(w) - 1)):
            if w[i] == "[" and w[i + 1] == "[" and i in head.match and i + 1 in head.match:
                for a, b in head.split(i + 2, head.match[i + 1]):
                    self._add("attribute", head.text(a, head.find(("(",), a, b)), self.starts[head.tokens[i]], self.ends[head.tokens[head.match[i]]], scope, ifs)

    def _ended(self, t: int, ifs: list[str]) -> None:
        """A semicolon: what the open heads declare."""
        seen: list = []
        for h in self.heads:
            if h is not None:
                listed, tests = self._listed(h, ifs)
                self._plain(t, Head(self, listed), listed, tests, seen)
        self.heads = [None]

    def _plain(self, t: int, head: Head, listed: list[int], ifs: list[str], seen: list) -> None:
        """E12, E14, E15, and functions without a body."""
        scope, w, stop = self.scope, head.words, self.ends[t]
        begin, i, template, n = self._stripped(head)
        if i >= len(w):
            return
        start = self.starts[listed[begin]]
        brace = next((k for k in range(i, len(w)) if w[k] == "{" and listed[k] in self.emitted), None)
        if brace is not None or any(listed[k] in self.emitted for k in range(len(w)) if w[k] == "{"):
            self._behind_braces(head, listed, i, brace, stop, start, ifs, seen)
            return
        if w[i] == "using":
            if w[i + 1 : i + 2] == ["namespace"]:
                if self._new(seen, "using", head.text(i + 2, len(w))):
                    self._add("using_directive", None, start, stop, scope, ifs, namespace=head.text(i + 2, len(w)))
            elif w[i + 2 : i + 3] == ["="] and not scope.inside and self._new(seen, "alias", w[i + 1]):
                self._add("type_alias_decl", w[i + 1], start, stop, scope, ifs, template_parameters=template, aliased=head.text(i + 3, len(w)))
            elif len(w) > i + 2 and "=" not in w and self._new(seen, "using", head.text(i + 1, len(w))):
                name = head.text(i + 2 if w[i + 1] == "typename" else i + 1, len(w))
                self._add("using_declaration", name.split("::")[-1].strip(), start, stop, scope, ifs, namespace=name)
            return
        if w[i] == "namespace":
            if w[i + 2 : i + 3] == ["="] and self._new(seen, "namespace", w[i + 1]):
                self._add("namespace_alias", w[i + 1], start, stop, scope, ifs, namespace=head.text(i + 3, len(w)))
            return
        if w[i] == "typedef":
            if not scope.inside:
                for d in self._declared(head, i + 1):
                    if self._new(seen, "typedef", d.name):
                        self._add("typedef_decl", d.name, start, stop, scope, ifs, aliased=d.type)
            return
        call = self._function(head, i, scope, template, n, False)
        if call is not None:
            made = call[0]
            inner, outside = self._home(scope, made["owner"])
            name = made["signature"]["name"]
            if self._new(seen, made["kind"], name, str(made["signature"]["parameters"])):
                self._add(made["kind"], name, start, stop, inner, ifs, signature=made["signature"], rich=made["rich"], is_defined=False, template_parameters=made["template"], owner=outside)
                own = _Scope(made["kind"], name, start, scope).of(inner, [name])
                self._attributes(head, 0, len(w), own, ifs)
            return
        if w[i] not in _NO_VARIABLE:
            self._variables(head, i, start, stop, ifs, seen)

    def _declared(self, head: Head, start: int, base: str | None = None) -> Iterator[Declarator]:
        """All declarators of a unit."""
        for a, b in head.split(start, len(head.words)):
            d = head.declarator(a, b, base if a > start or base is not None else None)
            if d is not None and d.name:
                if base is None:
                    base = _MARKS.sub("", d.type.split("(")[0])
                yield d

    def _variables(self, head: Head, i: int, start: int, stop: int, ifs: list[str], seen: list, base: str | None = None) -> None:
        scope = self.scope
        for d in self._declared(head, i, base):
            words = d.type.split()
            if not words or words[0] in _NO_VARIABLE or not d.name.isidentifier() or (d.call is not None and base is not None):
                continue
            kind = " ".join(x for x in words if x not in _STORAGE)
            if not kind or not _TYPE.match(kind):
                continue
            if scope.fields is not None:
                scope.fields.append({"name": d.name, "type": kind + self._bounds(head, d.name), "line": self._place(start)[0]})
            inner, outside = self._home(scope, d.owner)
            if not scope.inside and self._new(seen, "var", d.name):
                self._add("var_decl", d.name, start, stop, inner, ifs, var_type=kind, is_const="const" in words or "constexpr" in words, is_static="static" in words, owner=outside)

    @staticmethod
    def _bounds(head: Head, name: str) -> str:
        at = head.words.index(name) + 1
        return head.text(at, head.match[at] + 1) if at < len(head.words) and head.words[at] == "[" and at in head.match else ""

    def _behind_braces(self, head: Head, listed: list[int], i: int, brace: int | None, stop: int, start: int, ifs: list[str], seen: list) -> None:
        """The end of a record or enumeration, and what is declared behind its braces."""
        for k in range(len(listed)):
            if head.words[k] == "{" and listed[k] in self.emitted:
                self.emitted[listed[k]]["stop"] = stop
        if brace is None or brace + 1 not in range(len(head.words)):
            return
        base = head.text(i, brace)
        colon = head.find((":",), i, brace)
        base = head.text(i, colon) if colon < brace else base
        if head.words[i] == "typedef":
            if not self.scope.inside:
                for d in self._declared(head, brace + 2, base):
                    if self._new(seen, "typedef", d.name):
                        self._add("typedef_decl", d.name, start, stop, self.scope, ifs)
        else:
            self._variables(head, brace + 2, start, stop, ifs, seen, base)

    # rows ------------------------------------------------------------------------------------------------------

    def _place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at)
        return line, at - self.lines[line - 1] + 1

    def _add(self, kind: str, name: str | None, start: int, stop: int | None, scope: _Scope, ifs: list[str], code: bool = True, **more) -> dict:
        parent = self._place(scope.at) if scope.level and scope.known else (None, None)
        row = {
            "type": kind, "name": name or None, "location": self.location, "start": start, "level": scope.level, "parent_type": scope.kind, "parent_name": scope.name or None,
            "parent_line": parent[0], "parent_col": parent[1], "path": scope.path, "code": code, "condition": " && ".join(f"({x})" if len(ifs) > 1 else x for x in ifs) or None if ifs else None,
        } | more
        if stop is not None:
            row["stop"] = stop
        self.found.append(row)
        return row

    def _finish(self) -> None:
        for r in self.found:
            r.setdefault("stop", len(self.code))
            r["line"], r["col"] = self._place(r["start"])
            r["end_line"], r["end_col"] = self._place(r["stop"])
            r["code"] = self.code[r["start"] : r["stop"]] if r["code"] and r["level"] <= DEEP else None
        self.found.sort(key=lambda e: (e["start"], -e["stop"]))
