"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a piece of text exactly one token can be the last of its encoding. The candidates are the
tokens that are suffixes of the prefix, which a suffix-matching automaton over the vocabulary reports, longest
first; a candidate is the last token if the shorter prefix's last token may stand before it. Two tokens may
stand side by side if the merges would never join across their border, a test on the pieces that exist at the
border while each of them is being built. Back-pointers from the last prefix give the exact ids.

Text is cut into pieces (and at the added tokens' strings) as the tokenizer file says. The prefixes of equal length of
many pieces are worked out at once in numpy, those in common once; encodings of pieces are kept in a bounded memory per
worker, of which one half is for pieces that were asked for again.

Defined results: null or empty text has no ids and decodes to ''; texts of any length are encoded whole; ties can't
occur, since the last token of a prefix is unique; repeated rows are encoded each by itself; an empty table gives no
rows; columns other than doc_id and text are ignored, whatever their names; a null doc_id stays null. Only byte-level
BPE files without normalizer are read; others raise.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomline.llm.common import lean

#: The byte-level pre-tokenizer's pattern (a fixed value of the file format).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters of texts that a plainer pattern cuts in the same way, with the faster module.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_OTHER = re.compile(rf"[^\x00-\x7f{_LATIN}]")
_LATIN_PIECES = re.compile(rf" ?[{_LATIN}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+", re.A)
#: A worker's memory: pieces (of LONG_PIECE characters at most) and pairs of tokens, about 45 and 12 MB.
REMEMBERED, REMEMBERED_PAIRS, LONG_PIECE = 250_000, 400_000, 64
#: Characters of text cut into pieces together; bytes of pieces, and how few pieces, encoded together.
TOGETHER, CELLS, FEW = 1 << 20, 1 << 18, 24


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself, or the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Encoder and decoder of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files without normalizer or prefix space are read")
        symbols = _byte_symbols()
        as_bytes = lambda t: bytes(symbols[c] for c in t)
        self.bytes_of: dict[int, bytes] = {i: as_bytes(t) for t, i in model["vocab"].items()}
        self.ids = {b: i for i, b in self.bytes_of.items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens with options are not read")
        self.at_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.size = 1 + max(chain(self.bytes_of, self.added.values()))
        # a merge: its rank by left << 20 | right, and how each token is made
        self.rank: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b = self.ids[as_bytes(left)], self.ids[as_bytes(right)]
            t = self.ids[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a << 20 | b] = r
            self.made.setdefault(t, (a, b, r))
        self._borders = lru_cache(8192)(self._border)
        self._pairs = _Pairs(0)
        self._specials: dict[str | int, bytes] = {i: i.to_bytes(4, "little") for i in self.added.values()}
        self._often, self._once = dict(self._specials), dict[str | int, bytes]()
        self._automaton()
        self._decoded = {i: self.bytes_of[i] for i in self.bytes_of} | {i: t.encode() for t, i in self.added.items()}

    def _border(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces that stand at the token's right (side 1) or left (0) border while it is built, each with the rank of the merge that ends it."""
        found, t, until = [], token, float("inf")
        while True:
            found.append((t, until))
            if t not in self.made:
                return found
            until = self.made[t][2]
            t = self.made[t][side]

    def _compatible(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether no merge of a rank below ``before`` joins the two across their border.

        At equal ranks the leftmost merge goes first: one inside the left token comes before one across the
        border, one across the border before one inside the right token.
        """
        rank = self.rank
        ours, theirs = self._borders(left, 1), self._borders(right, 0)
        i, j = len(ours) - 1, len(theirs) - 1
        while True:  # through time: only pieces that exist together are tried
            a, a_until = ours[i]
            b, b_until = theirs[j]
            r = rank.get(a << 20 | b)
            if r is not None and r < before and r < a_until and r <= b_until:
                return False
            if a_until <= b_until:
                i -= 1
                if i < 0:
                    return True
                if a_until == b_until:
                    r = rank.get(ours[i][0] << 20 | b)
                    if r is not None and r < before and r < ours[i][1] and r <= b_until:
                        return False
                    j -= 1
            else:
                j -= 1
            if j < 0:
                return True

    def _whole(self, token: int, known: dict[int, bool]) -> bool:
        """Whether the token's bytes are encoded as the token itself."""
        found = known.get(token)
        if found is None:
            if token not in self.made:
                found = len(self.bytes_of[token]) == 1
            else:
                a, b, r = self.made[token]
                found = self._whole(a, known) and self._whole(b, known) and self._compatible(a, b, r)
            known[token] = found
        return found

    def _automaton(self) -> None:
        """States are the beginnings of tokens; ``first`` leads from a state to the longest token among its suffixes,
        ``shorter`` from a token's state to the next one."""
        self._go: dict[int, int] = {}  # state << 8 | byte
        token, parent, last_byte = [-1], [0], [0]
        known: dict[int, bool] = {}
        for b, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if not self._whole(i, known):
                continue
            state = 0
            for c in b:
                to = self._go.get(state << 8 | c)
                if to is None:
                    to = self._go[state << 8 | c] = len(token)
                    token.append(-1)
                    parent.append(state)
                    last_byte.append(c)
                state = to
            token[state] = i
        if sum(k >> 8 == 0 for k in self._go) < 256:
            raise ValueError("the vocabulary lacks some of the 256 bytes")
        n = len(token)
        depth = [0] * n
        for s in range(1, n):  # a state's parent comes before it
            depth[s] = depth[parent[s]] + 1
        fail, first, shorter = [0] * n, [0] * n, [0] * n
        self._fail = fail
        for s in sorted(range(1, n), key=depth.__getitem__):
            fail[s] = self._step(fail[parent[s]], last_byte[s]) if parent[s] else 0
            first[s] = s if token[s] >= 0 else first[fail[s]]
            shorter[s] = first[fail[s]]
        self._fail, self._first, self._shorter, self._token, self._depth = (np.array(x, np.int32) for x in (fail, first, shorter, token, depth))
        self._goes = _Pairs(len(self._go))
        self._goes.add(np.fromiter(self._go.keys(), np.int64, len(self._go)), np.fromiter(self._go.values(), np.int32, len(self._go)))

    def _step(self, state: int, byte: int) -> int:
        """The longest beginning of a token that is a suffix of state + byte."""
        while True:
            to = self._go.get(state << 8 | byte)
            if to is not None or not state:
                return to or 0
            state = int(self._fail[state])

    def _steps(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """``_step`` of many states."""
        out, at, todo = np.zeros(len(state), np.int32), state.astype(np.int64), np.arange(len(state))
        while len(todo):
            to = self._goes.get(at[todo] << 8 | byte[todo])
            hit = to >= 0
            out[todo[hit]] = to[hit]
            todo = todo[~hit & (at[todo] > 0)]
            at[todo] = self._fail[at[todo]]
        return out

    def _may_follow(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the tokens left << 20 | right may stand side by side."""
        found = self._pairs.get(pairs)
        if (found < 0).any():
            new = np.unique(pairs[found < 0])
            if self._pairs.held + len(new) > REMEMBERED_PAIRS:
                self._pairs = _Pairs(0)
                new = np.unique(pairs)
            self._pairs.add(new, np.fromiter((self._compatible(int(p) >> 20, int(p) & 0xFFFFF) for p in new), np.int32, len(new)))
            found = self._pairs.get(pairs)
        return found > 0

    def piece(self, piece: bytes) -> bytes:
        """The packed ids of one piece, prefix after prefix."""
        first, shorter, token, depth = (x.item for x in (self._first, self._shorter, self._token, self._depth))
        last, lengths, known = [0] * len(piece), [0] * len(piece), {}
        state = 0
        for end, byte in enumerate(piece):
            state = self._go.get(state << 8 | byte) or self._step(state, byte)
            s = first(state)
            while True:
                t, n = token(s), depth(s)
                if n > end:
                    break
                pair = (last[end - n], t)
                ok = known.get(pair)
                if ok is None:
                    if len(known) > REMEMBERED_PAIRS:
                        known.clear()
                    ok = known[pair] = self._compatible(*pair)
                if ok:
                    break
                s = shorter(s)
            last[end], lengths[end] = t, n
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= lengths[at]
        return np.array(out[::-1], "<u4").tobytes()

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece: the prefixes of one length of all pieces are worked out at once."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order, at = np.argsort(-lengths, kind="stable"), 0
        out: list[bytes] = [b""] * len(pieces)
        while at < len(order):
            here = order[at : at + CELLS // max(1, int(lengths[order[at]]))]
            if len(here) < FEW:  # numpy has no use for so few; very long pieces are such
                here = order[at : at + 1]
                found = [self.piece(pieces[here[0]])]
            else:
                found = self._together([pieces[i] for i in here])
            for i, ids in zip(here, found, strict=True):
                out[i] = ids
            at += len(here)
        return out

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """``pieces`` of some pieces; a beginning that several have in common is worked out for the first of them."""
        n = len(pieces)
        order = sorted(range(n), key=pieces.__getitem__)
        data = np.array([pieces[i] for i in order], np.bytes_)
        lengths, most = np.fromiter((len(pieces[i]) for i in order), np.int64, n), data.itemsize
        data = data.view(np.uint8).reshape(n, most)
        other = data[1:] != data[:-1]
        same = np.concatenate([[0], np.minimum(np.where(other.any(1), other.argmax(1), most), lengths[:-1])])
        last, size, state = np.zeros((most, n), np.int32), np.zeros((most, n), np.int32), np.zeros(n, np.int32)
        for end in range(most):
            live = np.flatnonzero(lengths > end)
            first = same[live] <= end
            heads, of = live[first], np.cumsum(first) - 1
            here = self._steps(state[heads], data[heads, end].astype(np.int64))
            found, wide = np.zeros(len(heads), np.int32), np.zeros(len(heads), np.int32)
            candidate, todo = self._first[here], np.arange(len(heads))
            while len(todo):
                width, token = self._depth[candidate], self._token[candidate]
                ok = width > end
                inner = np.flatnonzero(~ok)
                before = last[end - width[inner], heads[todo[inner]]].astype(np.int64)
                ok[inner] = self._may_follow(before << 20 | token[inner])
                found[todo[ok]], wide[todo[ok]] = token[ok], width[ok]
                todo, candidate = todo[~ok], self._shorter[candidate[~ok]]
            last[end, live], size[end, live], state[live] = found[of], wide[of], here[of]
        rows = np.arange(n)
        at, ids, count = lengths - 1, np.zeros((n, most), "<u4"), np.zeros(n, np.int64)
        while len(rows):  # the pointers back, from the right
            here = at[rows]
            count[rows] += 1
            ids[rows, most - count[rows]] = last[here, rows]
            at[rows] = here - size[here, rows]
            rows = rows[at[rows] >= 0]
        flat = ids[np.arange(most) >= most - count[:, None]].tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        out = [b""] * n
        for i, x, y in zip(order, [0, *ends], ends, strict=False):
            out[i] = flat[x:y]
        return out

    def _cut(self, text: str) -> list[str | int]:
        """The text's pieces; an added token is its id."""
        find = (PIECES if _OTHER.search(text) else _LATIN_PIECES).findall
        parts = self.at_added.split(text) if self.at_added else [text]
        if len(parts) == 1:
            return find(text)
        return [x for k, part in enumerate(parts) for x in ([self.added[part]] if k % 2 else find(part))]

    def _cut_long(self, text: str) -> Iterator[list[str | int]]:
        """``_cut`` of a long text in parts."""
        pattern = PIECES if _OTHER.search(text) else _LATIN_PIECES
        parts = enumerate(self.at_added.split(text) if self.at_added else [text])
        pieces = chain.from_iterable([self.added[x]] if k % 2 else (m[0] for m in pattern.finditer(x)) for k, x in parts)
        while part := list(islice(pieces, TOGETHER // 4)):
            yield part

    def _learned(self, pieces: set[str]) -> dict[str | int, bytes]:
        """The packed ids of pieces that are not known as frequent; those that were asked for before become so."""
        found = {p: ids for p in pieces if (ids := self._once.pop(p, None)) is not None}
        if len(self._often) + len(found) > REMEMBERED // 2:
            self._often = dict(self._specials)
        self._often.update(found)
        new = [p for p in pieces if p not in found]
        more = dict(zip(new, self.pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
        if len(self._once) + len(more) > REMEMBERED // 2:
            self._once = {}
        self._once.update(more if max(map(len, new), default=0) <= LONG_PIECE else {p: ids for p, ids in more.items() if len(p) <= LONG_PIECE})
        return found | more

    def _looked_up(self, cut: list[list[str | int]]) -> Iterator[bytes]:
        """The packed ids of each list of pieces: one look for a frequent piece."""
        found = [list(map(self._often.get, x)) for x in cut]
        new = self._learned({p for x, ids in zip(cut, found, strict=True) if None in ids for p, known in zip(x, ids, strict=True) if known is None})
        for x, ids in zip(cut, found, strict=True):
            yield b"".join([new[p] if known is None else known for p, known in zip(x, ids, strict=True)] if None in ids else ids)

    def packed(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        texts = iter(texts)
        while group := list(_some(texts)):
            if len(group[-1]) > TOGETHER:  # it ends its group
                last = group.pop()
            else:
                last = None
            yield from self._looked_up([self._cut(x) for x in group])
            if last is not None:
                yield b"".join(x for part in self._cut_long(last) for x in self._looked_up([part]))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.packed([text])), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self._decoded.__getitem__, ids)).decode("utf-8", "replace")


def _some(texts: Iterator[str]) -> Iterator[str]:
    """The next texts, until they have ``TOGETHER`` characters; none at the end."""
    size = 0
    for x in texts:
        yield x
        size += len(x)
        if size >= TOGETHER:
            return


class _Pairs:
    """Numbers below 2 ** 22 by keys below 2 ** 41, both in one number of a numpy array: many are looked up at a time."""

    def __init__(self, room: int) -> None:
        self.bits = max(12, (2 * room).bit_length())
        self.slots, self.held = np.full(1 << self.bits, -1, np.int64), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        at = self._slot(keys)
        there = self.slots[at]
        out, todo = there & 0x3FFFFF, np.flatnonzero(there >> 22 != keys)
        out[todo] = -1
        todo = todo[there[todo] >= 0]
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.slots[at[todo]]
            hit = there >> 22 == keys[todo]
            out[todo[hit]] = there[hit] & 0x3FFFFF
            todo = todo[~hit & (there >= 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        if 2 * (self.held + len(keys)) > len(self.slots):
            had = self.slots[self.slots >= 0]
            self.__init__(2 * (self.held + len(keys)))
            self.add(had >> 22, had & 0x3FFFFF)
        self.held += len(keys)
        both, at, todo = keys << 22 | values, self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = both[free]  # of those for one slot the last gets it
            todo = todo[self.slots[at[todo]] != both[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer per worker."""
    return Tokenizer(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids array<int>."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for part in _small(b):
                packed = list(t.packed(x.as_py() or "" for x in part.column(1)))
                edges = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(encoded), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text, from doc_id and ids; null ids give ''."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            for part in _small(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.decode(x.as_py() or []) for x in part.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(decoded), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def _small(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in parts: ids take several times the memory of text."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again, in one pass.

    Ids are not moved between processes for a digest of them.
    """
    from hashlib import sha256

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        numerals = [str(i) for i in range(t.size)]
        for b in batches:
            n, of_ids, of_text = [], [], []
            for packed in t.packed(x.as_py() or "" for x in b.column(1)):
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                of_ids.append(sha256(",".join(map(numerals.__getitem__, ids)).encode()).hexdigest())
                of_text.append(sha256(t.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(digested), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    """The tokenizer file of the registered queries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
