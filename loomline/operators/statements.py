"""The statements of C++ functions and the members of classes, with their places.

Where a statement that began at a token would end follows from where later ones end, so one pass from the last token to the
first finds all ends; a work list then walks blocks, branches and bodies. Nothing recurses. A statement's place
includes its semicolon; a label's goes to the end of the statement behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomline.functions.batches import small
from loomline.operators.cpp import Head, Tokens

#: What a class and what a function may be cut at.
CLASS_KINDS = frozenset("constructor destructor function_template function_decl cxx_method field_decl decl_stmt access_specifier struct_decl enum_decl enum_constant using_declaration type_alias_decl friend_decl".split())
FUNCTION_KINDS = frozenset("if_stmt switch_stmt for_stmt while_stmt do_stmt case_stmt default_stmt decl_stmt lambda_expr compound_stmt cxx_try_stmt cxx_catch_stmt".split())

_LEADS = {"if": "if_stmt", "for": "for_stmt", "while": "while_stmt", "switch": "switch_stmt"}
_NO_DECLARATION = frozenset("return delete throw goto new else break continue co_return co_yield co_await using static_assert typedef".split())
_ACCESS = frozenset("public protected private signals slots".split())

Place = tuple[str, int, int]


class Statements:
    """All statements and members of a text, in ``found`` as (kind, start, end)."""

    def __init__(self, code: str) -> None:
        self.file = Tokens(code)
        keep = [i for i, k in enumerate(self.file.kinds) if k != "directive"]
        self.t = [self.file.texts[i] for i in keep]
        self.at = [(self.file.starts[i], self.file.ends[i]) for i in keep]
        self.kinds, self.keep, self.n = [self.file.kinds[i] for i in keep], keep, len(keep)
        self.match = self._matched()
        self.semicolon = [0] * self.n + [self.n]  # behind the next semicolon outside brackets, or at the bracket that closes
        self.end = [0] * self.n + [self.n]
        for i in reversed(range(self.n)):
            self.semicolon[i] = i + 1 if self.t[i] == ";" else i if self.t[i] in ")]}" else self.semicolon[min(self.match.get(i, i) + 1, self.n)]
            self.end[i] = self._ends(i)
        self.found: list[Place] = []
        self.work: list[tuple[str, int, int, str]] = [("units", 0, self.n, "")]
        while self.work:
            what, a, b, name = self.work.pop()
            (self._units if what == "units" else self._statements if what == "statements" else self._lambdas)(a, b, name)
        self.found = sorted(set(self.found), key=lambda x: (x[1], -x[2], x[0]))

    def _matched(self) -> dict[int, int]:
        out, open_ = {}, []
        for i, x in enumerate(self.t):
            if x in ("(", "[", "{"):
                open_.append(i)
            elif x in (")", "]", "}") and open_ and self.t[open_[-1]] == {")": "(", "]": "[", "}": "{"}[x]:
                out[open_.pop()] = i
        return out

    def _word(self, i: int) -> str:
        return self.t[i] if 0 <= i < self.n else ""

    def _assigns(self, i: int) -> bool:
        """Whether i is an equals sign that is not an operator's name."""
        return self.t[i] == "=" and "operator" not in (self._word(i - 1), self._word(i - 2))

    def _behind(self, i: int) -> int:
        """Behind the bracket group at i."""
        return min(self.match.get(i, self.n - 1) + 1, self.n)

    def _ends(self, i: int) -> int:
        """Where the statement that begins at i ends; later ends are known."""
        x = self.t[i]
        if x == "{":
            return self._behind(i)
        if x in _LEADS:
            j = i + 1 + (self._word(i + 1) in ("constexpr", "consteval"))
            j = self.end[self._behind(j)] if self._word(j) == "(" else j
            return self.end[j + 1] if x == "if" and self._word(j) == "else" and j + 1 < self.n else j
        if x == "do":
            j = self.end[i + 1]
            return self.semicolon[j] if self._word(j) == "while" else j
        if x == "try" and self._word(i + 1) == "{":
            j = self._behind(i + 1)
            while self._word(j) == "catch":
                j = self._behind(self._behind(j + 1))
            return j
        if x in ("case", "default"):
            j = i + 1
            while j < self.n and self.t[j] not in (":", ";", "}"):
                j = self._behind(j) if self.t[j] in "([{" else j + 1
            return self.end[j + 1] if self._word(j) == ":" and j + 1 < self.n and self.t[j + 1] != "}" else min(j + 1, self.n)
        return i if x == "}" else self.semicolon[i]

    def _add(self, kind: str, a: int, b: int) -> None:
        if b > a:
            self.found.append((kind, self.at[a][0], self.at[b - 1][1]))

    def _head(self, a: int, b: int) -> Head:
        return Head(self.file, [self.keep[i] for i in range(a, b)])

    # functions -------------------------------------------------------------------------------------------------

    def _statements(self, a: int, b: int, _: str) -> None:
        """The statements between two places, and what is in them."""
        i = a
        while i < b:
            e = max(self.end[i], i + 1)
            self._statement(i, e)
            i = e

    def _inside(self, a: int, b: int) -> None:
        if a < b:
            self.work.append(("statements", a, b, ""))

    def _statement(self, i: int, e: int) -> None:
        x = self.t[i]
        if x == "{":
            self._add("compound_stmt", i, e)
            self._inside(i + 1, e - 1)
        elif x in _LEADS:
            self._add(_LEADS[x], i, e)
            j = i + 1 + (self._word(i + 1) in ("constexpr", "consteval"))
            self.work.append(("lambdas", j, self._behind(j), ""))
            body = self._behind(j)
            self._inside(body, self.end[body])
            if x == "if" and self._word(self.end[body]) == "else":
                self._inside(self.end[body] + 1, e)
        elif x == "do":
            self._add("do_stmt", i, e)
            self._inside(i + 1, self.end[i + 1])
        elif x == "try" and self._word(i + 1) == "{":
            self._add("cxx_try_stmt", i, e)
            j = self._behind(i + 1)
            self._inside(i + 1, j)
            while self._word(j) == "catch":
                body = self._behind(j + 1)
                self._add("cxx_catch_stmt", j, self._behind(body))
                self._inside(body, self._behind(body))
                j = self._behind(body)
        elif x in ("case", "default"):
            self._add(f"{x}_stmt", i, e)
            j = i
            while j < e and self.t[j] != ":":
                j = self._behind(j) if self.t[j] in "([{" else j + 1
            self._inside(j + 1, e)
        else:
            if self._declares(i, e):
                self._add("decl_stmt", i, e)
            self.work.append(("lambdas", i, e, ""))

    def _declares(self, a: int, b: int) -> bool:
        if self.t[a] in _NO_DECLARATION or self.kinds[a] not in ("word",) and self.t[a] != "::":
            return self.t[a] in ("using", "typedef", "static_assert")
        stop = next((i for i in range(a, b) if self.t[i] in ("=", "{", ";")), b)
        d = self._head(a, stop).declarator(0, stop - a)
        return d is not None and bool(d.type) and not d.name.startswith("~") and re.fullmatch(r"(?:[\w\s:,*&()\[\]]|<(?!\s*<)|>|\.\.\.)+", d.type) is not None and "<<" not in d.type and d.type.count("<") == d.type.count(">")

    def _lambdas(self, a: int, b: int, _: str) -> None:
        """The lambdas of an expression."""
        i = a
        while i < b:
            if self.t[i] == "[" and not (i and (self.kinds[i - 1] == "word" and self.t[i - 1] not in ("return", "co_return", "co_yield") or self.t[i - 1] in (")", "]", "["))):
                j = self._behind(i)
                if self._word(j) == "(":
                    j = self._behind(j)
                while j < b and (self.kinds[j] == "word" or self.t[j] in ("->", "::", "<", ">", "*", "&", ",")):
                    j += 1
                if j < b and self.t[j] == "{":
                    self._add("lambda_expr", i, self._behind(j))
                    self._inside(j, self._behind(j))
                    i = self._behind(j)
                    continue
            i += 1

    # members ---------------------------------------------------------------------------------------------------

    def _unit_end(self, i: int, b: int) -> tuple[int, int]:
        """(the end of the member that begins at i, its body's brace or -1)."""
        record, body, j = False, -1, i
        while j < b:
            x = self.t[j]
            if x == ";":
                return j + 1, body
            if body < 0 and (x in ("class", "struct", "union", "enum") and "(" not in self.t[i:j] or self._assigns(j)):
                record = True
            if x == "{":
                body = j if body < 0 or not record else body
                j = self._behind(j)
                if not record and self._word(j) not in (",", "{", ";", "catch"):
                    return j, body
                if self._word(j) == ";":
                    return j + 1, body
                continue
            j = self._behind(j) if x in ("(", "[") else j + 1
        return b, body

    def _units(self, a: int, b: int, owner: str) -> None:
        """Members of a class (owner), or declarations of a file or namespace."""
        i = a
        while i < b:
            if self.t[i] in (";", "}"):
                i += 1
                continue
            if self.t[i] in _ACCESS and self._word(i + 1 + (self._word(i + 1) in _ACCESS)) == ":":
                e = i + 2 + (self._word(i + 1) in _ACCESS)
                self._add("access_specifier", i, e)
                i = e
                continue
            e, body = self._unit_end(i, b)
            e = max(e, i + 1)
            self._unit(i, e, body, owner)
            i = e

    def _unit(self, i: int, e: int, body: int, owner: str) -> None:
        words = self.t[i : body if body >= 0 else e]
        first = words[0] if words else ""
        inner = (body + 1, self._behind(body) - 1) if body >= 0 else None
        if first == "template":
            words = words[self._past_template(i) - i :]
        key = next((w for w in words if w in ("class", "struct", "union", "enum", "namespace", "(", "=")), "")
        if key == "namespace" or words[:1] == ["extern"] and len(words) == 2 and inner:
            if inner:
                self.work.append(("units", *inner, ""))
        elif key in ("class", "struct", "union") and inner:
            colon = words.index(":") if ":" in words else len(words)
            names = [w for w in words[words.index(key) + 1 : colon] if w.isidentifier() and w != "final"]
            if owner or key == "struct":
                self._add("struct_decl", i, e)
            self.work.append(("units", *inner, names[-1] if names else "?"))
        elif key == "enum" and inner:
            self._add("enum_decl", i, e)
            self._constants(*inner)
        elif first == "using":
            self._add("type_alias_decl" if "=" in words else "using_declaration", i, e)
        elif first == "friend":
            self._add("friend_decl", i, e)
        else:
            self._function_or_field(i, e, inner, owner)

    def _past_template(self, i: int) -> int:
        depth = 0
        for j in range(i + 1, self.n):
            depth += (self.t[j] == "<") - (self.t[j] == ">")
            if depth <= 0:
                return j + 1
        return self.n

    def _constants(self, a: int, b: int) -> None:
        start = i = a
        while i <= b:
            if i == b or self.t[i] == ",":
                self._add("enum_constant", start, min(i, b))
                start = i + 1
            i = self._behind(i) if i < b and self.t[i] in "([{" else i + 1

    def _function_or_field(self, i: int, e: int, inner: tuple[int, int] | None, owner: str) -> None:
        template = self.t[i] == "template"
        j = min(self._past_template(i), e) if template else i
        stop = next((k for k in range(j, e) if self.t[k] in ("{", ";") or self._assigns(k)), e)
        d = self._head(j, stop).declarator(0, stop - j)
        if d is not None and d.call is not None:
            name = d.name
            kind = "function_template" if template else "destructor" if name.startswith("~") else "constructor" if name == (owner or d.owner.split("::")[-1].split("<")[0]) else "cxx_method" if owner or d.owner else "function_decl"
            self._add(kind, i, e)
            if inner and self.t[inner[0] - 1] == "{":
                self._add("compound_stmt", inner[0] - 1, inner[1] + 1)
                self._inside(*inner)
        else:
            if owner and d is not None:
                self._add("field_decl", i, e)
            self.work.append(("lambdas", i, e, ""))


def statements(code: str) -> list[Place]:
    return Statements(code).found


def table(rows: DataFrame, key: str, code: str) -> DataFrame:
    """(key, kind, start, stop) of all statements of each row's code; null code has none. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at, found = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                here = statements(x) if x else []
                at += [i] * len(here)
                found += here
            kind, start, stop = zip(*found, strict=True) if found else ((), (), ())
            columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [key, "kind", "start", "stop"])

    return rows.select(key, code).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, kind string, start int, stop int")


def points(code: str, kinds: frozenset[str]) -> list[int]:
    """Where what is of those kinds begins and ends."""
    return sorted({p for kind, a, b in statements(code) if kind in kinds for p in (a, b)})
