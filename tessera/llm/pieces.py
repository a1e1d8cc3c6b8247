"""SentencePiece encoding and decoding as weighted finite-state transducers.

Three machines are compiled from a model file into arrays of states and arcs,
over UTF-8 bytes:

* the normaliser writes the mark U+2581 before a text and for each space, and
  every other byte as it is;
* the pieces: a trie, an arc a byte, whose ends write a piece's id and go back to
  the start for the piece's weight;
* byte fallback: a character that is no piece writes the ids of its bytes, for a
  weight over any path of pieces. It is looked up in a table, not walked arc by arc.

A text's chunks are composed with the machines lazily: states are (place in the
input, state of the pieces), built as they are reached, in the order of places.
The ids are the outputs of the shortest path in the tropical semiring.

For a unigram model an arc weighs its negative score. A BPE model's result is
not the least sum of any piece weights, so its machine is composed with one more,
an acceptor of neighbours whose states are the last piece: two pieces may
follow each other only if merging their joined text gives just these two, else
the arc weighs infinity (weights are 0 otherwise, so the first path to the end is
shortest). A sequence all of whose neighbours are allowed is the one that
merging gives for the whole, so the only finite path is the right one. The
acceptor's arcs are compiled when first met. A run of two or more marks is no
such machine's language: which of its marks merge hangs on the run's length, with
equal scores taken from the left. For a chunk that begins with such a run the
acceptor is one chain, compiled from its merges by a heap of neighbour pairs in
n log n steps.

No piece holds a mark after another character, so a text falls into chunks that
start with marks, and each different chunk's path is remembered within a bound.

Decoding is the inverse of the pieces as a table of bytes by id, and of the
normaliser: marks become spaces and the first is taken off. It restores the text,
but that the mark itself comes back as a space.

Null and empty texts have no ids; texts of any length, also without a space, take
n log n time; repeated rows give equal rows; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytewords import slices
from .shared import id_text, tidily

MARK = "▁"
TWO_MARKS = 2 * MARK.encode()
CLOSING = b".,;:!?)*%$#&"
CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
FALLBACK = 1e6  # weight of a character without a piece


class Transducer:
    """Arcs (state, input byte) -> (next state, output, weight) in arrays; input -1 reads nothing.

    ``step`` finds an arc by state and byte; ``ends[state]`` are the arcs that read nothing.
    """

    def __init__(self):
        self.n_states, self.to, self.output, self.weight = 1, array("q"), array("q"), array("d")
        self.step: dict[int, int] = {}
        self.ends: dict[int, list[int]] = {}
        self.bursts: dict[int, tuple[bytes, int]] = {}
        self.copies: dict[int, bytes] = {}  # states that write every byte but this one as it is and stay

    def state(self) -> int:
        self.n_states += 1
        return self.n_states - 1

    def arc(self, state: int, byte: int, to: int, output: int = -1, weight: float = 0.0) -> int:
        k = len(self.to)
        self.to.append(to)
        self.output.append(output)
        self.weight.append(weight)
        if byte < 0:
            self.ends.setdefault(state, []).append(k)
        else:
            self.step[state << 8 | byte] = k
        return to

    def burst(self, state: int) -> tuple[bytes, int]:
        """What the arcs that read nothing write from here on, and where they end."""
        found = self.bursts.get(state)
        if found is None:
            out, at = bytearray(), state
            while at in self.ends:
                k = self.ends[at][0]
                out.append(self.output[k])
                at = self.to[k]
            found = self.bursts[state] = bytes(out), at
        return found

    def path_of(self, state: int, text: bytes) -> int:
        """The state after these bytes, with arcs added where there are none."""
        for b in text:
            k = self.step.get(state << 8 | b)
            state = self.arc(state, b, self.state()) if k is None else self.to[k]
        return state


def normaliser(prefix: bool) -> tuple[Transducer, int]:
    """Bytes to bytes, and its state after the first mark: a space is the mark's bytes, every other byte itself."""
    machine, mark = Transducer(), MARK.encode()
    start = 0
    if prefix:
        for b in mark:
            start = machine.arc(start, -1, machine.state(), b)
    for b in range(256):
        if b != 0x20:
            machine.arc(start, b, start, b)
    machine.copies[start] = b" "
    last = machine.arc(start, 0x20, machine.state(), mark[0])
    machine.arc(machine.arc(last, -1, machine.state(), mark[1]), -1, start, mark[2])
    return machine, start


def transduced(machine: Transducer, text: bytes, state: int = 0) -> bytes:
    """The output, from ``state`` on, of a machine that has one path for each input."""
    begun, state = machine.burst(state)
    out, at, n = bytearray(begun), 0, len(text)
    while at < n:
        if state in machine.copies:  # a run of arcs from the state to itself
            stop = text.find(machine.copies[state], at)
            if stop < 0:
                out += text[at:]
                return bytes(out)
            out += text[at:stop]
            at = stop
        k = machine.step[state << 8 | text[at]]
        more, state = machine.burst(machine.to[k])
        out.append(machine.output[k])
        out += more
        at += 1
    return bytes(out)


def heap_merged(text: str, score: dict[str, float]) -> list[str]:
    """BPE by definition: the best-scored neighbours merge, leftmost of equals, until none can.

    Pairs wait in a heap; parts are a doubly linked list, and a pair whose parts have changed is passed over.
    A few characters are scanned for each merge instead.
    """
    part, n = list(text), len(text)
    if n <= 16:
        while True:
            pairs = [score.get(a + b, -inf) for a, b in zip(part, part[1:])]
            best = max(pairs, default=-inf)
            if best == -inf:
                return part
            at = pairs.index(best)
            part[at : at + 2] = [part[at] + part[at + 1]]
    after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n:
            s = score.get(part[i] + part[j])
            if s is not None:
                heap.append((-s, i, len(part[i]), len(part[j])))

    for i in range(n - 1):
        offer(i)
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if len(part[i]) != a or j >= n or len(part[j]) != b:
            continue
        part[i] += part[j]
        part[j], after[i] = "", after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n:
                s = score.get(part[k] + part[after[k]])
                if s is not None:
                    heapq.heappush(heap, (-s, k, len(part[k]), len(part[after[k]])))
    return [p for p in part if p]


class PieceMachine(dict):
    """Chunk to ids (uint32 bytes), filled by shortest paths; at most 2 * ``most`` chunks."""

    def __init__(self, path: str, most: int = 600_000):
        from sentencepiece import sentencepiece_model_pb2 as proto

        gc.set_threshold(200_000, 50, 100)  # strings and bytes make no cycles
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, self.bpe = model.normalizer_spec, model.trainer_spec.model_type == 2
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only identity normalisers that escape spaces are compiled")
        self.most, self.older, self.prefix = most, {}, norm.add_dummy_prefix
        self.score = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
        self.piece = [p.piece for p in model.pieces]
        self.id_of = {p: k for k, p in enumerate(self.piece) if p in self.score}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a mark after another character")
        self.normal, self.normal_end = normaliser(self.prefix)
        self.compile([(k, p.piece, 0.0 if self.bpe else -p.score) for k, p in enumerate(model.pieces) if p.type in (1, 4)])
        byte = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == 6}
        unk = next(k for k, p in enumerate(model.pieces) if p.type == 2)
        self.byte_ids = [byte[b] for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.unk = unk
        # the inverse: ids to bytes, and marks to spaces
        blank = {1: lambda p: p.piece.encode(), 4: lambda p: p.piece.encode(), 2: lambda p: " ⁇ ".encode(), 6: lambda p: bytes([int(p.piece[3:5], 16)])}
        self.out = [blank.get(p.type, lambda p: b"")(p).replace(MARK.encode(), b" ") for p in model.pieces]
        self.allowed: dict[int, bool] = {}
        self.cores: dict[bytes, tuple[bytes, int, int]] = {}

    def compile(self, pieces: list[tuple[int, str, float]]) -> None:
        """The pieces' machine from (id, piece, weight), and its arcs as steps and final pieces by state."""
        m = self.pieces = Transducer()
        self.weight_of = {}
        for k, piece, weight in pieces:
            state = m.path_of(0, piece.encode())
            self.weight_of[k] = weight
            m.arc(state, -1, 0, k, weight)
        self.longest = max((len(p.encode()) for _, p, _ in pieces), default=1)
        self.next = {key: m.to[k] for key, k in m.step.items()}
        self.final = [-1] * m.n_states
        for state, arcs in m.ends.items():
            self.final[state] = m.output[arcs[0]]

    def fallback(self, char: bytes) -> list[int]:
        """Outputs of the fallback arcs of a character."""
        return [self.byte_ids[b] for b in char] if self.byte_ids else [self.unk]

    def _arcs(self, text: bytes, i: int) -> list[int]:
        """Composition from place i at the start of the pieces' machine: end << 32 | name of each way, the longest last."""
        step, final, state, j, out = self.next.get, self.final, 0, i, []
        for b in text[i : i + self.longest]:
            state = step(state << 8 | b)
            if state is None:
                break
            j += 1
            piece = final[state]
            if piece >= 0:
                out.append(j << 32 | piece)
        first = text[i]
        end = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
        if not out or out[0] >> 32 != end:  # the character is no piece: it goes over the fallback arcs
            out.insert(0, end << 32 | len(self.piece) + ord(text[i:end].decode()))
        return out

    def _spelling(self, name: int) -> str:
        return self.piece[name] if name < len(self.piece) else chr(name - len(self.piece))

    def _pair(self, a: int, b: int) -> bool:
        """Whether b may follow a (-1: stand first): an arc of the acceptor of neighbours.

        Names are ids, or a character's code behind all ids where the character is no piece.
        """
        key = (a + 1) << 32 | b
        ok = self.allowed.get(key)
        if ok is None:
            if len(self.allowed) > 1_000_000:
                self.allowed.clear()
            x, y = self._spelling(a) if a >= 0 else "", self._spelling(b)
            ok = self.allowed[key] = heap_merged(x + y, self.score) == ([x, y] if x else [y])
        return ok

    def path(self, text: bytes) -> list[int]:
        """The shortest path's pieces, by the names that the acceptor knows."""
        return self._only_path(text) if self.bpe else self._cheapest_path(text)

    def _cheapest_path(self, text: bytes) -> list[int]:
        """Places in their order are a topological order of the composition's states at the start."""
        n = len(text)
        cost, last = {0: 0.0}, {}
        for i in range(n):
            if i not in cost:
                continue
            for way in self._arcs(text, i):
                j, name = way >> 32, way & 0xFFFFFFFF
                w = self.weight_of.get(name, FALLBACK)
                if cost[i] + w < cost.get(j, inf):
                    cost[j], last[j] = cost[i] + w, (i, name)
        out = []
        while n > 0:
            n, name = last[n]
            out.append(name)
        return out[::-1]

    def _only_path(self, text: bytes) -> list[int]:
        """The path of weight 0, depth first, longest arcs first.

        A place is reached with finite weight by one piece at most, the last
        of the text so far, so a place without a way on is left for good.
        """
        n, i, out, places, arcs, dead, before = len(text), 0, [], [], [], set(), -1
        allowed, step, final, longest, n_pieces = self.allowed.get, self.next.get, self.final, self.longest, len(self.piece)
        while i < n:
            if len(arcs) == len(out):  # a place not met before: as _arcs, without a call
                state, j, here = 0, i, []
                for b in text[i : i + longest]:
                    state = step(state << 8 | b)
                    if state is None:
                        break
                    j += 1
                    piece = final[state]
                    if piece >= 0:
                        here.append(j << 32 | piece)
                first = text[i]
                end = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
                if not here or here[0] >> 32 != end:
                    here.insert(0, end << 32 | n_pieces + ord(text[i:end].decode()))
                arcs.append(here)
            else:
                here = arcs[-1]
            while here:
                way = here.pop()
                name = way & 0xFFFFFFFF
                ok = allowed((before + 1) << 32 | name)
                if (ok or ok is None and self._pair(before, name)) and way >> 32 not in dead:
                    out.append(name)
                    places.append(i)
                    before, i = name, way >> 32
                    break
            else:
                dead.add(i)
                arcs.pop()
                i = places.pop()
                out.pop()
                before = out[-1] if out else -1
        return out

    def _run_chain(self, chunk: str) -> list[int]:
        """The acceptor of a chunk that begins with two marks or more: one chain, from its merges."""
        return [self.id_of[p] if p in self.id_of else len(self.piece) + ord(p) for p in heap_merged(chunk, self.score)]

    def _outputs(self, names: list[int]) -> bytes:
        n, ids = len(self.piece), []
        if max(names) < n:
            return array("I", names).tobytes()
        for x in names:
            if x < n:
                ids.append(x)
            else:
                ids += self.fallback(chr(x - n).encode())
        return array("I", ids).tobytes()

    def _core(self, core: bytes) -> tuple[bytes, int, int]:
        """The outputs of a part's path, and the names of its first and last piece."""
        found = self.cores.get(core)
        if found is None:
            names = self.path(core)
            found = self._outputs(names), names[0], names[-1]
            if len(core) <= 200:
                if len(self.cores) >= self.most:
                    self.cores.clear()
                self.cores[core] = found
        return found

    def __missing__(self, raw: str) -> bytes:
        ids = self.older.get(raw)
        if ids is None:
            chunk = transduced(self.normal, raw.encode(), self.normal_end)
            if self.bpe and chunk.startswith(TWO_MARKS):
                ids = self._outputs(self._run_chain(chunk.decode()))
            else:  # the path up to closing marks is shared, if it may end there
                core = chunk.rstrip(CLOSING) if self.bpe else chunk
                ids, _, last = self._core(core) if core else (b"", -1, -1)
                if len(core) < len(chunk):
                    rest, first, _ = self._core(chunk[len(core) :])
                    ids = ids + rest if self._pair(last, first) else self._outputs(self.path(chunk))
        if len(raw) > 200:
            return ids
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[raw] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The first mark is what a space before the text gives."""
        if not text:
            return np.zeros(0, "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, CHUNK.findall(" " * self.prefix + text))), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw[1:] if self.prefix and raw.startswith(" ") else raw


_machines: dict[str, PieceMachine] = {}


def machine(path: str) -> PieceMachine:
    if path not in _machines:
        _machines[path] = PieceMachine(path)
    return _machines[path]


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256, round_trip and, with ``keep_ids``, ids of every row.

    Null and empty texts have no ids and decode to the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for text in part.column(1).to_pylist():
                    ids = m.encode(text)
                    back = m.decode(ids)
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text, *([ids.tolist()] * keep_ids)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip", "ids"][: 5 + keep_ids])

    return id_text(docs, id_col, text_col).mapInArrow(tidily(run), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids)


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(path)
        for batch in batches:
            texts = [None if x is None else m.decode(np.asarray(x, "u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(tidily(run), "doc_id long, text string")
