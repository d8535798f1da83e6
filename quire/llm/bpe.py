"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A byte-level BPE result is fixed by its neighbours: a sequence of tokens is the encoding of its bytes exactly if each
adjacent pair is stable, that is if merging the pair's bytes leaves the pair. So the merges are a nondeterministic
transducer over bytes: it stands behind a token, reads the bytes of another that is stable after it, and writes that. A
state of the deterministic machine is the set of all ways that are open after some bytes: for each, the last token and the
bytes read of the next. A move tells the next state and the token that ends with its byte, which is the same for all ways
as encodings are unique. A token is settled and leaves as soon as all open ways go back to it, which is after a lookahead
bounded by the lengths of tokens; nothing that has left is taken back. States and their moves are made when
first met and kept up to a bound; from there on others are made and dropped, until they have come to as many as are kept and
a new machine begins. The machine over all merges is never built.

Decoding joins token bytes chunk by chunk and runs a UTF-8 state machine that
keeps its state between chunks, so a character may be cut anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.common import by_slices, held

START = -1


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


NEVER = 1 << 40


def steps(ranks: dict[bytes, int], data: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
    """Plain BPE by its definition: join the adjacent pair of lowest rank, leftmost first, until none is left.

    Returns the parts and, for each join, its rank and the first and last part after it.
    """
    parts = [data[i : i + 1] for i in range(len(data))]
    joins = [ranks.get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
    trace = []
    while joins and (low := min(joins)) < NEVER:
        i = joins.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joins[i]
        if i:
            joins[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        if i < len(joins):
            joins[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        trace.append((low, parts[0], parts[-1]))
    return parts, trace


def merged(ranks: dict[bytes, int], data: bytes) -> list[int]:
    return [ranks[p] for p in steps(ranks, data)[0]]


#: A way is one number: the place in the tree of tokens that the bytes read of the next one lead to << WAY | the last token + 1 (0: none).
WAY = 32
#: A move is the next state << TOKEN | token that ends there + 1 (0: none).
TOKEN = 24
ENDED = (1 << TOKEN) - 1
#: Bytes of one piece after which settled tokens leave.
FLUSH = 1 << 14


class Transducer:
    """Bytes to token ids. ``max_moves`` bounds the moves kept at once, ``max_pieces`` the pieces remembered whole."""

    def __init__(self, ranks: dict[bytes, int], max_moves: int = 400_000, max_pieces: int = 200_000):
        self.ranks, self.max_moves, self.max_pieces = ranks, max_moves, max_pieces
        self.token = {i: t for t, i in ranks.items()}
        # the tree of tokens: place << 8 | byte -> place, the token that ends there (-1: none), whether it goes on
        self.child: dict[int, int] = {}
        self.ends_here, self.goes_on, self.depth = [-1], bytearray(1), array("i", [0])
        for t, i in ranks.items():
            at = 0
            for byte in t:
                self.goes_on[at] = 1
                to = self.child.get(at << 8 | byte)
                if to is None:
                    to = self.child[at << 8 | byte] = len(self.ends_here)
                    self.ends_here.append(-1)
                    self.goes_on.append(0)
                    self.depth.append(self.depth[at] + 1)
                at = to
            self.ends_here[at] = i
        self.length = array("i", [0]) * (max(self.token) + 2)  # by token + 1
        for t, i in ranks.items():
            self.length[i + 1] = len(t)
        self.traces: dict[int, list[tuple[int, bytes, bytes]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # pieces of the generation before: what is met again moves on
        self._clear()

    def _clear(self) -> None:
        self.moves: dict[int, int] = {}
        self.ids: dict[tuple[int, ...], int] = {}
        self.states: list[tuple[int, ...]] = []
        self.spared = 0  # moves made and not kept
        self._state((0,))

    def _state(self, ways: tuple[int, ...]) -> int:
        got = self.ids.get(ways)
        if got is None:
            got = self.ids[ways] = len(self.states)
            self.states.append(ways)
        return got

    def _trace(self, t: int) -> list[tuple[int, bytes, bytes]] | None:
        """The joins that make the token from its bytes; None if its bytes encode to something else."""
        if t not in self.traces:
            parts, trace = steps(self.ranks, data := self.token[t])
            self.traces[t] = [(0, data[:1], data[-1:]), *trace, (NEVER, b"", b"")] if len(parts) == 1 else None
        return self.traces[t]

    def _stable(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: the joins of both run side by side, lowest rank and leftmost first, and none across the border comes first."""
        if len(self.pairs) >= self.max_moves:
            self.pairs.clear()
        right = self._trace(b)
        got = self.pairs[a + 1 << 32 | b] = right is not None and (a == START or self._apart(self._trace(a), right))
        return got

    def _apart(self, left: list[tuple[int, bytes, bytes]], right: list[tuple[int, bytes, bytes]]) -> bool:
        i, j, rank = 0, 0, self.ranks.get
        while True:
            across, x, y = rank(left[i][2] + right[j][1], NEVER), left[i + 1][0], right[j + 1][0]
            if across < x and across <= y:
                return False
            if x == y == NEVER:
                return True
            if x <= y:
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> int:
        """The move by one more byte; -1 if no way is open or two tokens end at once (ranks that do not come from merges)."""
        ways, ended = self._ways(self.states[state], byte)
        if not ways:
            return -1
        if len(self.moves) < self.max_moves:
            got = self.moves[state << 8 | byte] = self._state(ways) << TOKEN | ended + 1
            return got
        self.spared += 1
        if self.spared >= self.max_moves:
            self._clear()
            to = self._state(ways)
        elif (to := self.ids.get(ways)) is None:
            to = len(self.states)  # a state for this piece only
            self.states.append(ways)
        return to << TOKEN | ended + 1

    def _ways(self, ways: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
        """The ways open after one more byte, and the token that ends with it or -1."""
        out: list[int] = []
        child, pairs, ended = self.child.get, self.pairs.get, -1
        for way in ways:
            last = way & 0xFFFFFFFF
            to = child(way >> WAY << 8 | byte)
            if to is None:
                continue
            if (t := self.ends_here[to]) >= 0:
                stable = pairs(last << 32 | t)
                if self._stable(last - 1, t) if stable is None else stable:
                    if ended >= 0:
                        return (), -1
                    ended = t
                    out.append(t + 1)
            if self.goes_on[to]:
                out.append(to << WAY | last)
        out.sort()
        return tuple(out), ended

    def settled(self, state: int, made: list[int]) -> int:
        """The number of bytes whose tokens all open ways go back to. made: the move by each byte read."""
        at = sorted({len(made) - self.depth[way >> WAY] for way in self.states[state]})
        while len(at) > 1:
            last = at.pop()
            back = last - self.length[made[last - 1] & ENDED]
            if back not in at:
                at.append(back)
                at.sort()
        return at[0]

    def _back(self, made: list[int], to: int) -> list[int]:
        """Tokens of the first bytes."""
        out, length = [], self.length
        while to:
            out.append(t := made[to - 1] & ENDED)
            to -= length[t]
        out.reverse()
        return [t - 1 for t in out]

    def piece(self, text: str) -> tuple[int, ...]:
        """Token ids of one piece of the pre-tokeniser."""
        data = text.encode()
        if (t := self.ranks.get(data)) is not None:
            return (t,)  # what the merges' definition does first with a piece that is a token
        del self.states[len(self.ids) :]  # those of the piece before only
        out: list[int] = []
        made: list[int] = []
        state, moves, add = 0, self.moves, made.append
        for at in range(0, len(data), FLUSH):
            for byte in data[at : at + FLUSH]:
                try:
                    got = moves[state << 8 | byte]
                except KeyError:
                    got = self._move(state, byte)
                    if got < 0:
                        return tuple(merged(self.ranks, data))
                    moves = self.moves
                add(got)
                state = got >> TOKEN
            if len(data) > at + FLUSH:
                to = self.settled(state, made)
                out += self._back(made, to)
                del made[:to]
        if made and not made[-1] & ENDED:
            return tuple(merged(self.ranks, data))
        return (*out, *self._back(made, len(made)))

    def encode(self, pieces: Iterable[str]) -> list[int]:
        """Token ids of the pieces, as they come."""
        known, ids = self.pieces, []
        for p in pieces:
            got = known.get(p)
            if got is None:
                got = self.older.get(p) or self.piece(p)
                if len(p) <= 64:
                    if len(known) >= self.max_pieces // 2:
                        self.older, self.pieces = known, {}
                        known = self.pieces
                    known[p] = got
            ids += got
        return ids


#: UTF-8 by rule: first byte -> (bytes that follow, range of the second byte).
def _lead(b: int) -> tuple[int, int, int] | None:
    if 0xC2 <= b <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= b <= 0xEF:
        return 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
    if 0xF0 <= b <= 0xF4:
        return 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
    return None


LEAD = [_lead(b) for b in range(256)]
NOT_ASCII = re.compile(rb"[\x80-\xff]+")


class Utf8Machine:
    """Incremental UTF-8: feed() takes any cut of the bytes, returns the characters complete so far.

    A byte that cannot stand where it does gives U+FFFD, and ``ok`` turns false; so does an unfinished end.
    """

    def __init__(self) -> None:
        self.need, self.low, self.high, self.code, self.ok = 0, 0x80, 0xBF, 0, True

    def _bad(self, out: list[str]) -> None:
        self.need, self.low, self.high, self.ok = 0, 0x80, 0xBF, False
        out.append("�")

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        at = 0
        for m in NOT_ASCII.finditer(data):
            if m.start() > at:
                if self.need:
                    self._bad(out)
                out.append(data[at : m.start()].decode("ascii"))
            for b in m[0]:
                if self.need:
                    if self.low <= b <= self.high:
                        self.need, self.code, self.low, self.high = self.need - 1, self.code << 6 | b & 0x3F, 0x80, 0xBF
                        if not self.need:
                            out.append(chr(self.code))
                        continue
                    self._bad(out)
                if (lead := LEAD[b]) is None:
                    self._bad(out)
                else:
                    self.need, self.low, self.high = lead
                    self.code = b & (0x3F >> self.need)
            at = m.end()
        if at < len(data):
            if self.need:
                self._bad(out)
            out.append(data[at:].decode("ascii"))
        return "".join(out)

    def end(self) -> str:
        out: list[str] = []
        if self.need:
            self._bad(out)
        return "".join(out)


def decode_stream(token: dict[int, bytes], ids: Sequence[int], chunk: int = 4096) -> Iterator[bytes]:
    for at in range(0, len(ids), chunk):
        yield b"".join(map(token.__getitem__, ids[at : at + chunk]))


def decoded(token: dict[int, bytes], ids: Sequence[int], text: str) -> tuple[str, bool]:
    """SHA-256 of the decoded bytes, and whether they are UTF-8 and the text; nothing but a chunk is held of them."""
    sha, utf8, at, same = hashlib.sha256(), Utf8Machine(), 0, True
    for data in decode_stream(token, ids):
        sha.update(data)
        back = utf8.feed(data)
        same = same and text.startswith(back, at)
        at += len(back)
    return sha.hexdigest(), not utf8.end() and utf8.ok and same and at == len(text)


#: Characters from which the pieces of a text are made one after the other, not all at once.
LONG = 1 << 18


def transducer(rank_file: bytes) -> Transducer:
    """One machine a Python worker: what it has worked out serves the worker's later tasks too."""
    return held(f"transducer {hashlib.sha256(rank_file).hexdigest()}", lambda: Transducer(read_ranks(rank_file)))


def encode_decode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns ``keep`` and n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers), decoded_sha256 (of the decoded bytes), utf8_ok
    (the decoded bytes are valid UTF-8 and equal the text); with_ids adds
    token_ids array<int>. Null text: as empty (no tokens, hash of nothing).
    No shuffle; the rank file is read once by the driver and broadcast, its
    size is fixed. Of very long texts the pieces and the decoded bytes stream; the ids are held, four bytes each. Rows without a key and repeated rows give rows like any other, an
    empty table gives an empty one, other columns are left out.
    """
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    kept = docs.select(*keep, text)
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", "utf8_ok boolean"] + ["token_ids array<int>"] * with_ids)

    def make():
        machine = transducer(sent.value)
        split = regex.compile(pattern)

        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            n, enc, dec, good, all_ids = [], [], [], [], []
            for x in part.column(len(keep)).to_pylist():
                x = x or ""
                ids = array("i", machine.encode(split.findall(x) if len(x) < LONG else (m[0] for m in split.finditer(x))))
                n.append(len(ids))
                little = ids if sys.byteorder == "little" else array("i", ids)
                if little is not ids:
                    little.byteswap()
                enc.append(hashlib.sha256(little.tobytes()).hexdigest())
                sha, ok = decoded(machine.token, ids, x)
                dec.append(sha)
                good.append(ok)
                if with_ids:
                    all_ids.append(np.frombuffer(ids, np.int32) if ids else ())
            cols = [part.column(i) for i in range(len(keep))] + [pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string()), pa.array(good, pa.bool_())] + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids
            return pa.RecordBatch.from_arrays(cols, names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", "utf8_ok"] + ["token_ids"] * with_ids)

        return run

    return kept.mapInArrow(by_slices(make, keeps=True), schema)
