"""SentencePiece ids as the shortest path of a weighted finite-state transducer.

The model file is compiled into three transducers over characters:

* the normaliser, itself two in a row: the model's character map, longest match
  first, as a trie whose states fall back where no arc fits, then the spaces: the
  dummy prefix, runs of them squeezed, each written as U+2581;
* the pieces: a trie whose last states have an arc without input back to the start,
  with minus the piece's score as weight and the piece's id as output;
* byte fallback: an arc for any character that no single-character piece covers,
  whose output is the ids of its UTF-8 bytes, or the unknown id without them.

The last two are united at their start, which closes them over texts. An input is
composed with the normaliser, whose arcs leave no choice, so the result is one line
of characters; that is composed with the machine, and the path of least weight in
the tropical semiring (weights add along a path, the smaller of two paths wins)
gives the ids. Of equal weights the path with fewer arcs wins, then the one whose
last arc is longer. No piece has U+2581 behind another character, so the
composition falls apart at such places and the paths of its parts are taken from a
bounded cache.

``compose`` and ``shortest`` say this in general terms; ``Transducer.path`` does
both in one pass over arcs laid out for it, and the tests hold it against them.

The scores of a model trained by merges are merge ranks; the path then is the
cheapest segmentation under those ranks, which need not be the one that merging
in order gives. Decoding either gives the same text.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paperloom.llm.common import ids_and_texts

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Below the lowest score by which an uncovered character is penalised.
PENALTY = 10.0
PARTS_HELD = 400_000
_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def read_model(path: str) -> Spec:
    with open(path, "rb") as f:
        data = f.read()
    out = Spec()
    for key, value in _fields(data):
        if key == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif key == 3:
            for k, v in _fields(value):
                if k == 2:
                    out.charsmap = v
                elif k in (3, 4, 5):
                    setattr(out, {3: "dummy_prefix", 4: "squeeze", 5: "escape"}[k], bool(v))
    return out


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """The rewrite rules of a compiled character map: a double-array trie, then texts ended by zero."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    texts, out = blob[4 + size :], {}
    todo = [(0, b"")]
    while todo:
        node, key = todo.pop()
        unit = int(units[node])
        base = node ^ ((unit >> 10) << ((unit & 1 << 9) >> 6))
        if unit >> 8 & 1:
            at = int(units[base]) & 0x7FFFFFFF
            out[key.decode()] = texts[at : texts.index(b"\0", at)].decode()
        for byte in range(1, 256):
            to = base ^ byte
            if to < len(units) and int(units[to]) & 0x800000FF == byte:
                todo.append((to, key + bytes([byte])))
    return out


#: Label of the arc for every symbol that has no arc of its own in a state.
OTHER = None
Arc = tuple[int, float, tuple]  # next state, weight, output


@dataclass
class Fst:
    """States with arcs by input symbol, arcs without input, and final states; state 0 is the start.

    Where ``falls`` has a state, a symbol without an arc there takes that arc first,
    without being read.
    """

    arcs: list[dict[str | None, Arc]] = field(default_factory=lambda: [{}])
    free: dict[int, Arc] = field(default_factory=dict)
    final: dict[int, tuple] = field(default_factory=dict)  # output at the end
    falls: dict[int, Arc] = field(default_factory=dict)

    def state(self) -> int:
        self.arcs.append({})
        return len(self.arcs) - 1

    def step(self, state: int, symbol: str) -> Arc | None:
        """Where a symbol leads, with what falling back puts out before it."""
        out: tuple = ()
        while True:
            arc = self.arcs[state].get(symbol)
            if arc is None and state in self.falls:
                state, _, more = self.falls[state]
                out += more
                continue
            if arc is None:
                arc = self.arcs[state].get(OTHER)
                if arc is None:
                    return None
                return arc[0], arc[1], out + tuple(symbol if o is OTHER else o for o in arc[2])
            return arc[0], arc[1], out + arc[2]


def rewriter(rules: dict[str, str]) -> Fst:
    """Replaces the longest rule that starts at a place; everything else stays."""
    out = Fst()
    pending = {"": 0}
    for rule in rules:
        state = 0
        for k, c in enumerate(rule):
            if c not in out.arcs[state]:
                pending[rule[: k + 1]] = out.state()
                out.arcs[state][c] = pending[rule[: k + 1]], 0.0, ()
            state = out.arcs[state][c][0]
    out.arcs[0][OTHER] = 0, 0.0, (OTHER,)
    # Shorter strings first: falling back leads to states that have their own already.
    for held, state in sorted(pending.items(), key=lambda x: len(x[0])):
        if not held:
            continue
        size = next((k for k in range(len(held), 0, -1) if held[:k] in rules), 0)
        done = tuple(rules[held[:size]]) if size else (held[0],)
        at = 0
        for c in held[size or 1 :]:
            at, _, more = out.step(at, c)
            done += more
        out.falls[state] = at, 0.0, done
    for state in pending.values():
        done: tuple = ()
        at = state
        while at in out.falls:
            at, _, more = out.falls[at]
            done += more
        out.final[state] = done
    return out


def spacer(spec: Spec) -> Fst:
    """Dummy prefix, squeezed spaces, spaces written as U+2581."""
    space = SPACE if spec.escape else " "
    before = (space,) if spec.dummy_prefix else ()
    out = Fst(final={0: (), 1: (), 2: ()})
    body, gap = out.state(), out.state()
    out.arcs[0][OTHER] = body, 0.0, (*before, OTHER)
    out.arcs[body][OTHER] = body, 0.0, (OTHER,)
    out.arcs[gap][OTHER] = body, 0.0, (space, OTHER)
    if spec.squeeze:
        for state, to in ((0, 0), (body, gap), (gap, gap)):
            out.arcs[state][" "] = to, 0.0, ()
    else:
        out.arcs[0][" "] = body, 0.0, (*before, space)
        out.arcs[body][" "] = body, 0.0, (space,)
    return out


class Normaliser:
    """Transducer from a text to the characters that pieces are written in."""

    def __init__(self, spec: Spec, rules: dict[str, str] | None = None):
        rules = rules if rules is not None else charsmap_rules(spec.charsmap)
        self.machines = [rewriter(rules), spacer(spec)] if rules else [spacer(spec)]
        last = self.machines[-1]
        #: In a text's body most models stay in one state: its arcs, to be taken one symbol after the other.
        self.body = {c: "".join(o) for c, (_, _, o) in last.arcs[1].items() if c is not OTHER} if not rules and all(a[0] == 1 for a in last.arcs[1].values()) else None

    def __call__(self, text: str) -> str:
        if self.body is not None and text:
            head, text = "".join(self.machines[0].step(0, text[0])[2]), text[1:]
            for c, put in self.body.items():
                text = text.replace(c, put)
            return head + text
        for machine in self.machines:
            text = "".join(line(machine, text))
        return text


def line(machine: Fst, symbols: Iterable[str]) -> list[str]:
    """Composition of a line of symbols with a machine that leaves no choice: again a line."""
    state, out = 0, []
    for c in symbols:
        state, _, more = machine.step(state, c)
        out += more
    return out + list(machine.final[state])


def piece_machine(pieces: list[tuple[str, float, int]]) -> Fst:
    """The trie of (piece, weight, id), closed by arcs back to its start."""
    out = Fst(final={0: ()})
    for piece, weight, i in pieces:
        state = 0
        for c in piece:
            if c not in out.arcs[state]:
                out.arcs[state][c] = out.state(), 0.0, ()
            state = out.arcs[state][c][0]
        out.free[state] = 0, weight, (i,)
    return out


def fallback_machine(weight: float) -> Fst:
    """Any symbol, as it is: ids are put in its place on the way out."""
    return Fst(arcs=[{OTHER: (0, weight, (OTHER,))}], final={0: ()})


def united(pieces: Fst, fallback: Fst) -> tuple[Fst, frozenset]:
    """Both machines with one start; the fallback is for symbols that no piece of one symbol covers."""
    covered = frozenset(c for c, (to, _, _) in pieces.arcs[0].items() if to in pieces.free)
    return Fst([{**pieces.arcs[0], **fallback.arcs[0]}, *pieces.arcs[1:]], pieces.free, pieces.final), covered


def compose(symbols: str, machine: Fst, covered: frozenset) -> dict[tuple[int, int], list[tuple[tuple[int, int], float, tuple]]]:
    """All arcs of the composition of a line with a united machine, by (place, state)."""
    out: dict = {}
    todo = [(0, 0)]
    while todo:
        here = todo.pop()
        if here in out:
            continue
        place, state = here
        arcs = out[here] = []
        if state in machine.free:
            to, weight, put = machine.free[state]
            arcs.append(((place, to), weight, put))
        if place < len(symbols):
            c = symbols[place]
            if c in machine.arcs[state]:
                to, weight, put = machine.arcs[state][c]
                arcs.append(((place + 1, to), weight, put))
            if state == 0 and c not in covered:
                to, weight, _ = machine.arcs[state][OTHER]
                arcs.append(((place + 1, to), weight, (c,)))
        todo += [a[0] for a in arcs]
    return out


def shortest(lattice: dict, end: tuple[int, int]) -> tuple[list, float]:
    """Output and weight of the least path to ``end``; the start is (0, 0).

    Places ascend along arcs, and at one place the arcs without input lead to the start.
    """
    best: dict = {(0, 0): (0.0, 0, 0, None, ())}
    for here in sorted(lattice, key=lambda x: (x[0], x[1] == 0)):
        if here not in best:
            continue
        weight, arcs, opened, _, _ = best[here]
        opened = opened if here[1] else here[0]  # where the last arc with an output starts
        for to, more, put in lattice[here]:
            new = (weight + more, arcs + bool(put), opened, here, put)
            if to not in best or new[:3] < best[to][:3]:
                best[to] = new
    out, at = [], end
    while at != (0, 0):
        *_, before, put = best[at]
        out.append(put)
        at = before
    return [o for put in reversed(out) for o in put], best[end][0]


class Transducer:
    """Normaliser, pieces and byte fallback of one model, and composition with inputs."""

    def __init__(self, spec: Spec, held: int = PARTS_HELD):
        self.spec, self.normalise, self.held = spec, Normaliser(spec), held
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        own = []
        low = 0.0
        for i, (piece, score, kind) in enumerate(spec.pieces):
            self.bytes_of.append(b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
            if kind == BYTE:
                self.byte_ids[int(piece[3:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:-1], 16)])
            elif kind == UNKNOWN:
                self.unknown = i
                self.bytes_of[i] = " ⁇ ".encode()
            elif kind in (NORMAL, USER):
                own.append((piece, -score if kind == NORMAL else 0.0, i))
                low = min(low, score)
        self.fallback_weight = PENALTY - low
        self.machine, self.covered = united(piece_machine(own), fallback_machine(self.fallback_weight))
        self.start = self._laid_out()
        self.whole = any(SPACE in p.lstrip(SPACE) for p, _, _ in own)
        self.parts: dict[str, tuple[bytes, float]] = {}

    def _laid_out(self) -> dict:
        """The machine's arcs as symbol -> (arcs of the next state, its weight and id back to the start, or none)."""
        machine = self.machine
        tables: list[dict] = [{} for _ in machine.arcs]
        for table, arcs in zip(tables, machine.arcs, strict=True):
            for c, (to, _, _) in arcs.items():
                if c is not OTHER:
                    _, weight, put = machine.free.get(to, (0, None, (None,)))
                    table[c] = tables[to], weight, put[0]
        return tables[0]

    def fallback(self, char: str) -> list[int]:
        data = char.encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in data] if len(self.byte_ids) == 256 else [self.unknown]

    def path(self, chars: str) -> tuple[list[int], float]:
        """Ids and weight of the least path through the composition with ``chars``."""
        n = len(chars)
        weight, arcs, back = [0.0] + [float("inf")] * n, [0] * (n + 1), [(0, -1)] * (n + 1)
        start, covered = self.start, self.covered
        for i in range(n):
            here, step, table = weight[i], arcs[i] + 1, start
            for j in range(i, n):
                arc = table.get(chars[j])
                if arc is None:
                    break
                table, more, piece = arc
                if more is not None:
                    total = here + more
                    if total < weight[j + 1] or total == weight[j + 1] and step < arcs[j + 1]:
                        weight[j + 1], arcs[j + 1], back[j + 1] = total, step, (i, piece)
            if chars[i] not in covered:
                total = here + self.fallback_weight
                if total < weight[i + 1] or total == weight[i + 1] and step < arcs[i + 1]:
                    weight[i + 1], arcs[i + 1], back[i + 1] = total, step, (i, -1)
        out, at = [], n
        while at:
            before, piece = back[at]
            out.append(self.fallback(chars[before]) if piece < 0 else [piece])
            at = before
        return [i for ids in reversed(out) for i in ids], weight[n]

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids as little-endian unsigned 32-bit bytes, and the path's weight."""
        chars = self.normalise(text)
        parts = [chars] if self.whole and chars else _PART.findall(chars)
        have, out, total = self.parts, [], 0.0
        for part in parts:
            got = have.get(part)
            if got is None:
                ids, weight = self.path(part)
                got = np.array(ids, "<u4").tobytes(), weight
                if len(have) >= self.held:
                    have.clear()
                have[part] = got
            out.append(got[0])
            total += got[1]
        return b"".join(out), total

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces and bytes joined, without the dummy prefix."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.spec.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """One compiled model per worker process."""
    return Transducer(read_model(path))


def encode_texts(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, weight): ids of every whole text; a null text gives null.

    Equal texts give equal ids, so repeated rows and null or repeated ids need no
    care; an empty text has no ids and an empty table gives no rows.
    """
    path = model or default_model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in batches:
            got = [None if t is None else own.encode(t) for t in batch.column(1).to_pylist()]
            ids = [None if g is None else np.frombuffer(g[0], "<u4").astype(np.int32) for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([None if g is None else g[1] for g in got], pa.float64())], ["doc_id", "ids", "weight"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, weight double")


def decode_ids(df: DataFrame, id_col: str, ids_col: str, model: str | None = None) -> DataFrame:
    """(doc_id, text): texts of id arrays; null arrays give null, empty ones an empty text.

    Each row is decoded by itself, repeated ones alike; an empty table gives no rows.
    """
    from pyspark.sql import functions as F

    path = model or default_model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else own.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def piece_digests(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, ids_crc32, weight, round_trip for every row. A null
    text counts as empty and has no ids. Equal texts give equal values, so
    repeated rows and null or repeated ids need no care; an empty table gives no
    rows. round_trip is false for texts that the normaliser changes, here those
    that hold U+2581 themselves.
    """
    path = model or default_model()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids, weight = own.encode(text)
                rows.append((len(ids) // 4, zlib.crc32(ids), weight, own.decode(np.frombuffer(ids, "<u4").tolist()) == text))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_tokens", "ids_crc32", "weight", "round_trip"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, weight double, round_trip boolean")
