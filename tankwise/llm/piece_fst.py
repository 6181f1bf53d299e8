"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is read as it is (its path is a parameter) and compiled into two machines:

- the normaliser: the character map of the file (a deterministic rewriting of the longest match), white space squeezed or
  kept, a dummy prefix, space to U+2581. It is functional, so its composition with an input is again a chain of symbols;
- the pieces: states are the nodes of a trie, arcs read a symbol, and from the end of a piece an arc that reads nothing writes
  its id and leads back to the start. A symbol that no piece spells has an arc to the start which writes the ids of its bytes,
  or the unknown id where the file has no bytes.

The chain is composed with the pieces state by state, and the encoding is the shortest path in the tropical semiring: weights
are added along a path, the least sum wins, and of equal sums the path whose last differing piece is longer. Weights are -score
for unigram models, and the arc of an unspelled symbol weighs 10 more than the worst piece; user-defined pieces weigh
0.1 - n * best score, so they win over all else; unused pieces have no arcs.

A BPE file orders merges instead of weighing pieces. Its machine has the segmentations of the chain as states, from single
symbols (and user-defined pieces, which stay whole) on, and an arc for each merge of two neighbours to a piece, which weighs
(-score, place). Weights of a path are compared in lexicographic order, so the least first arc decides whatever follows:
the shortest path takes the least arc of each state until there is none. Unused pieces come apart again at its end. The
ids are those of the library.

Where no piece but runs of U+2581 holds that sign after another character, the chain falls apart before each such run, and
further wherever no piece holds two neighbours in a row (if unknown symbols have bytes, so that runs of them need not stay
together). A worker finds the path of a part once and keeps those that recur.

Defined cases: a null or empty text has no tokens; U+2581 in a text decodes as a space; an unknown id decodes as " U+2047 ";
null ids decode as null; repeated rows are encoded alike; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
HELD_PARTS = 150_000
#: Symbols of a chain whose merges are followed without a heap.
SHORT = 64
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What the arc of an unspelled symbol weighs above the worst piece.
PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """The longest-match rewriting of a compiled map: its size, a double-array trie and the replacements."""

    def __init__(self, blob: bytes) -> None:
        (size,) = struct.unpack_from("<I", blob)
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest key that data has at a place."""
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, found = step(self.units[0]), None
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[end]:
                break
            unit = self.units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = end + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.texts[start : self.texts.index(b"\0", start)]


class Normaliser:
    def __init__(self, charsmap: bytes, prefix: bool, squeeze: bool, kept: list[str]) -> None:
        self.map = CharacterMap(charsmap) if charsmap else None
        self.prefix, self.squeeze = prefix, squeeze
        self.kept = re.compile("|".join(re.escape(k) for k in sorted(kept, key=len, reverse=True)).encode()) if kept else None

    def _rewritten(self, data: bytes) -> bytes:
        out, at = [], 0
        while at < len(data):
            if self.kept and (m := self.kept.match(data, at)):
                n, text = len(m[0]), m[0]
            elif (found := self.map.longest(data, at)) is not None:
                n, text = found
            else:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                text = data[at : at + n]
            out.append(text)
            at += n
        return b"".join(out)

    def chain(self, text: str) -> str:
        """The symbols that text becomes."""
        if self.map:
            text = self._rewritten(text.encode()).decode("utf-8", "replace")
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(SPACE, " ")).strip(" ")
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)


class Held:
    """Paths of parts, in two generations: when the newer is full it becomes the older, so that what recurs stays."""

    def __init__(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def age(self) -> None:
        if len(self.new) > HELD_PARTS:
            self.old, self.new = self.new, {}


class PieceTransducer:
    def __init__(self, model: bytes) -> None:
        pieces, unigram, prefix, squeeze, charsmap = [], True, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                unigram = dict(_fields(value)).get(3, 1) == 1
            elif number == 3:
                own = dict(_fields(value))
                charsmap, prefix, squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        self.text: list[bytes] = []
        #: Of each state the arcs (symbol to state) and, at the end of a piece, its id and weight.
        self.arcs: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, float] | None] = [None]
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        #: Of a BPE file the weight of the merge that makes each piece, the ids of pieces, and those that come apart again.
        self.merges: dict[str, float] | None = None if unigram else {}
        self.ids: dict[str, int] = {}
        self.unused: set[str] = set()
        #: Neighbours that stand in a row in some piece.
        self.pairs: set[tuple[str, str]] = set()
        scores = [s for _, s, k in pieces if k == NORMAL]
        best = max(scores, default=0.0)
        self.whole = True
        kept = []
        for rank, (piece, score, kind) in enumerate(pieces):
            weight = -score
            if kind == USER:
                weight = 0.1 - len(piece) * best
                kept.append(piece)
            if not unigram and kind in (NORMAL, USER, UNUSED):
                self.merges[piece], self.ids[piece] = -score, rank
                if kind == UNUSED:
                    self.unused.add(piece)
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = rank
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            self.unknown = rank if kind == UNKNOWN else self.unknown
            shown = {NORMAL: piece.replace(SPACE, " "), USER: piece.replace(SPACE, " "), UNUSED: piece.replace(SPACE, " "), UNKNOWN: UNKNOWN_TEXT}
            self.text.append(shown.get(kind, "").encode())
            if kind in (NORMAL, USER) or not unigram and kind == UNUSED:
                self.pairs.update(pairwise(piece))
                self.whole &= not re.search(f"[^{SPACE}]{SPACE}", piece)
                self._add(piece, rank, weight)
        self.whole &= SPACE in self.arcs[0] and self.ends[self.arcs[0][SPACE]] is not None
        self.unspelled = PENALTY - min(scores, default=0.0)
        self.normaliser = Normaliser(charsmap, prefix, squeeze, kept)
        self.runs = not self.byte_ids  # a run of unknown symbols is one id, so it must not be cut
        self.kept = re.compile("|".join(re.escape(k) for k in sorted(kept, key=len, reverse=True)) + "|.", re.DOTALL) if kept else None
        self.frozen = set(kept)
        #: Merges alone decide: no pieces that stay whole or come apart.
        self.plain = self.merges is not None and not kept and not self.unused

    def _add(self, piece: str, rank: int, weight: float) -> None:
        state = 0
        for c in piece:
            if c not in self.arcs[state]:
                self.arcs[state][c] = len(self.arcs)
                self.arcs.append({})
                self.ends.append(None)
            state = self.arcs[state][c]
        self.ends[state] = rank, weight

    def merged(self, chain: str) -> list[int]:
        """Ids at the end of the lexicographically shortest path of merges of chain."""
        part = self.kept.findall(chain) if self.kept else list(chain)
        apart: dict[str, tuple[str, str]] = {}
        part = self._merge_few(part) if self.plain and len(part) <= SHORT else self._merge_many(part, apart)
        out: list[int] = []
        last_unknown = False
        todo = part[::-1]
        while todo:
            p = todo.pop()
            if p in apart:
                todo += reversed(apart[p])
                continue
            rank = self.ids.get(p)
            if rank is not None:
                out.append(rank)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            elif not last_unknown:  # a run of unknown symbols is one id
                out.append(self.unknown)
            last_unknown = rank is None
        return out

    def _merge_few(self, part: list[str]) -> list[str]:
        """Follow the least arc of each state: the weights of all arcs stand in one short list."""
        weight, none = self.merges.get, math.inf
        arcs = [weight(a + b, none) for a, b in pairwise(part)]
        while arcs and (least := min(arcs)) < none:
            i = arcs.index(least)
            made = part[i] + part[i + 1]
            part[i : i + 2] = (made,)
            if i + 1 < len(arcs):
                arcs[i : i + 2] = (weight(made + part[i + 1], none),)
            else:
                arcs.pop()
            if i:
                arcs[i - 1] = weight(part[i - 1] + made, none)
        return part

    def _merge_many(self, part: list[str], apart: dict[str, tuple[str, str]]) -> list[str]:
        """The same with a heap of arcs, for long chains and files with user-defined or unused pieces; apart gets what unused ones
        were made from.
        """
        before, after = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        after[-1:] = [-1]
        open_: list[tuple[float, int, int, int]] = []

        def arc(left: int, right: int) -> None:
            if left >= 0 <= right and part[left] not in self.frozen and part[right] not in self.frozen:
                piece = part[left] + part[right]
                if (weight := self.merges.get(piece)) is not None:
                    heapq.heappush(open_, (weight, left, right, len(piece)))
                    if piece in self.unused:
                        apart[piece] = part[left], part[right]

        for i in range(len(part) - 1):
            arc(i, i + 1)
        while open_:
            _, left, right, size = heapq.heappop(open_)
            if not part[left] or not part[right] or len(part[left]) + len(part[right]) != size:
                continue  # an arc of a state that has been left
            part[left] += part[right]
            part[right] = ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            arc(before[left], left)
            arc(left, after[left])
        return [p for p in part if p]

    def path(self, chain: str) -> list[int]:
        """Ids that the shortest path of the composition with chain writes.

        States of the composition are (place in the chain, state of the pieces); those at the start state are the only ones that
        paths can part from, so the least sums are kept for them alone, place by place.
        """
        n, arcs, ends = len(chain), self.arcs, self.ends
        least: list[float] = [0.0] + [math.inf] * n
        back: list[tuple[int, int | None]] = [(0, None)] * (n + 1)
        for i in range(n):
            here, state, spelled = least[i], 0, False
            if here == math.inf:
                continue
            for j in range(i, n):
                state = arcs[state].get(chain[j], -1)
                if state < 0:
                    break
                if (end := ends[state]) is not None:
                    spelled |= j == i
                    cost = here + end[1]
                    if cost < least[j + 1]:
                        least[j + 1], back[j + 1] = cost, (i, end[0])
            if not spelled and here + self.unspelled < least[i + 1]:
                least[i + 1], back[i + 1] = here + self.unspelled, (i, None)
        out: list[int] = []
        at, last_unknown = n, False
        while at:
            before, rank = back[at]
            if rank is not None:
                out.append(rank)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(chain[before:at].encode())]
            elif not last_unknown:  # a run of unknown symbols is one id
                out.append(self.unknown)
            last_unknown = rank is None
            at = before
        return out[::-1]

    def encode(self, text: str, held: Held | None = None) -> bytes:
        """Ids of text as packed 32-bit integers; held keeps the paths of parts between calls."""
        held = held or Held()
        chain = self.normaliser.chain(text)
        parts = _PARTS.findall(chain) if self.whole else [chain] if chain else []
        new, old = held.new, held.old
        for p in set(parts).difference(new):
            new[p] = old.get(p) or (self._spelled(p, held) if self.runs else b"".join([self._spelled(q, held) for q in self._apart(p)]))
        out = b"".join(map(held.new.__getitem__, parts))
        held.age()
        return out

    def _apart(self, part: str) -> list[str]:
        """part cut wherever no piece holds the two neighbours in a row, which no arc can cross."""
        pairs = self.pairs
        if pairs.issuperset(pairwise(part)):
            return [part]
        cuts = [i for i, pair in enumerate(pairwise(part), 1) if pair not in pairs]
        return [part[a:b] for a, b in pairwise([0, *cuts, len(part)])]

    def _spelled(self, part: str, held: Held) -> bytes:
        packed = held.new.get(part) or held.old.get(part)
        if packed is None:
            if self.plain and len(part) <= SHORT:
                found = list(map(self.ids.get, self._merge_few(list(part))))
                ids = self.merged(part) if None in found else found
            else:
                ids = self.path(part) if self.merges is None else self.merged(part)
            packed = held.new[part] = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}i", *ids)
        return packed

    def decode(self, ids: memoryview | list[int]) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.normaliser.prefix and text[:1] == " " else text

    def normalised(self, text: str) -> str:
        """What decoding the encoded text gives if no symbol is unknown."""
        chain = self.normaliser.chain(text).replace(SPACE, " ")
        return chain[1:] if self.normaliser.prefix else chain


_PACK = [struct.Struct(f"<{n}i").pack for n in range(33)]
_PARTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def read_model(df: DataFrame, path: str) -> bytes:
    """The model file, by Spark's reader (any store that it reaches)."""
    return bytes(df.sparkSession.read.format("binaryFile").load(path if "://" in path else f"file://{path}").select("content").first()[0])


def _lists(sizes: list[int], packed: bytearray) -> pa.Array:
    """Lists of 32-bit integers from their sizes and their values in a row, without a Python object for each."""
    values = pa.Array.from_buffers(pa.int32(), len(packed) // 4, [None, pa.py_buffer(packed)])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)


def encode(docs: DataFrame, model: bytes, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip) and, if wanted, ids for each row of docs (doc_id, text).

    ids_sha256 is of the ids as little-endian 32-bit integers; round_trip tells whether decoding gives the normalised text back.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst, held = PieceTransducer(sent.value), Held()
        for batch in batches:
            n, sha, same, ids = [], [], [], bytearray()
            for value in batch.column(1):
                text = value.as_py() or ""
                packed = fst.encode(text, held)
                own = memoryview(packed).cast("i")
                n.append(len(own))
                sha.append(hashlib.sha256(packed).hexdigest())
                same.append(fst.decode(own) == fst.normalised(text))
                if with_ids:
                    ids += packed
            more = [_lists(n, ids)] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_()), *more], ["doc_id", "n_tokens", "ids_sha256", "round_trip", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)


def decode(tokens: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) for each row of tokens (doc_id, ids)."""
    sent = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = PieceTransducer(sent.value)
        for batch in batches:
            texts = [None if ids is None else fst.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
