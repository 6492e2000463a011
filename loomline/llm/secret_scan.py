"""Secret scans with one combined deterministic automaton.

All rules' patterns are compiled by subset construction and minimisation (``automaton``) into one transition
array, which reads each byte of a text once. Where it reports the end of a match, two small automata of that rule
fix the span: the reversed one finds the leftmost start, the anchored one the longest end. Matches of a rule
are leftmost and do not overlap; those that fail the rule's length test are dropped but have been consumed.
Spans are in code points, end exclusive.

Defined results: a null or empty text has no spans; repeated documents get the same spans each; texts of any
length are read whole, with memory in proportion to one text; spans with one start are listed in the order of the rules;
a null doc_id stays null; other columns are ignored, or kept by ``redact``, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.automaton import Automaton, compile_rules
from loomline.llm.common import lean


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # <...> ignores the case of ASCII letters
    least: int = 1  # how long a match has to be
    tail: int = 0  # how long its value has to be: what follows the first : or =, blanks and a quote
    trigger: str | None = None  # what the combined automaton looks for: each match of least characters has it


#: A key's first line. The key goes to its END line if no two dashes come before; else over what looks like base64.
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_BLANK = r"([\x09-\x0D\x20]|\\[nr])"

#: The first three are the base rules, in this order. Lengths are tested on the match, so that a short match is
#: consumed like any other and the combined automaton needs no counters for overlapping runs.
RULES = (
    Rule("assign", r"<password|passwd|secret|token|api_?key>[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", tail=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24, trigger=r"[0-9a-f]{8}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("pem", rf"{_PEM}(([^-]|-[^-])*-----END [A-Z ]*PRIVATE KEY-----|({_BLANK}+[A-Za-z0-9+/=]{{20,}})+({_BLANK}+[A-Za-z0-9+/=]+)?)?", trigger=_PEM),
)
BASE = ("assign", "access", "hex")


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.scan: Automaton = compile_rules([r.trigger or r.pattern for r in rules], anywhere=True)
        self.forward = [compile_rules([r.pattern]) for r in rules]
        self.backward = [compile_rules([r.pattern], backward=True) for r in rules]

    def _start(self, k: int, data: bytes, end: int, floor: int) -> int:
        """Leftmost start, not before floor, of a match of rule k that ends at end; -1 if there is none."""
        a = self.backward[k]
        t, s, found = a.table, a.start, -1
        for at in range(end - 1, floor - 1, -1):
            s = t[s + data[at]]
            if not s:
                break
            if s in a.accepts:
                found = at
        return found

    def _end(self, k: int, data: bytes, start: int) -> int:
        a = self.forward[k]
        t, s, found = a.table, a.start, -1
        for at in range(start, len(data)):
            s = t[s + data[at]]
            if not s:
                break
            if s in a.accepts:
                found = at + 1
        return found

    def _counts(self, k: int, match: bytes) -> bool:
        rule = self.rules[k]
        if rule.tail:
            value = match[min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
            return len(value) - (value[:1] in (b'"', b"'")) >= rule.tail
        return len(match) >= rule.least

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes, by start, then rule."""
        found: list[tuple[int, int, int]] = []
        floor = [0] * len(self.rules)
        t, s, accepts, least = self.scan.table, self.scan.start, self.scan.accepts, self.scan.least_accept
        for at, b in enumerate(data):
            s = t[s + b]
            if s >= least:
                for k in accepts[s]:
                    if at < floor[k]:
                        continue
                    start = self._start(k, data, at + 1, floor[k])
                    if start < 0:
                        continue
                    floor[k] = end = self._end(k, data, start)
                    if self._counts(k, data[start:end]):
                        found.append((start, end, k))
        found.sort(key=lambda x: (x[0], x[2]))
        return found

    def named(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        data = text.encode("utf-8", "surrogatepass")
        out, at, chars = [], 0, 0
        for start, end, k in self.spans(data):
            chars += start - at if text.isascii() else len(data[at:start].decode("utf-8", "surrogatepass"))
            at = start
            length = end - start if text.isascii() else len(data[start:end].decode("utf-8", "surrogatepass"))
            out.append((self.rules[k].kind, chars, chars + length))
        return out


_SPANS = "array<struct<kind:string,start:bigint,`end`:bigint>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of every document."""
    scanner = Scanner(rules)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # the rules' transition arrays

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = shared.value.named
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in named(x.as_py() or "")] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _ARROW_SPANS)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(lean(scanned), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base rules' spans, and all spans."""
    listed = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return scan(docs).select("doc_id", *(n(k) for k in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with each maximal run of secret characters in text replaced by mark; all rows and columns stay.

    A null text stays null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = shared.value.named
        for b in batches:
            at = b.schema.get_field_index("text")
            new = []
            for x in b.column(at):
                text = x.as_py()
                spans = named(text) if text else []
                if spans:
                    parts, done = [], 0
                    for _, s, e in spans:
                        if s >= done:
                            parts += [text[done:s], mark]
                        done = max(done, e)
                    text = "".join(parts) + text[done:]
                new.append(text)
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(lean(redacted), docs.schema)
