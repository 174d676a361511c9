"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A merge table defines enc(w), the tokens of a byte string w. If enc(w) = t1..tn then enc(t1..tk) = t1..tk for
every k, since no merge of w's run crosses a final boundary. So after reading a prefix, any token that later
bytes can still change starts at a *live* position p: the bytes from p to the end are a proper prefix of some
token. Tokens common to enc(prefix[:p]) for all live p are certain and can be emitted; what is left, the pending
bytes, alone determines the future. The pending bytes are therefore the transducer's state, and
``step(state, byte) -> (state, emitted tokens)`` is computed on first use and kept (lazy determinisation).
Lookahead is bounded by the longest token; should a vocabulary not allow that for some input, the pending bytes
pass ``max_pending`` and the rest of that piece is merged directly.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame

from doclens.llm.store import give_back

STATES = 250_000  # kept by a transducer; forgotten together when there are more
SLICE = 500_000  # characters whose ids are held at once, beside those of one text
ENCODED = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class BpeTransducer:
    """Encodes single pieces (matches of the splitting pattern).

    A state is a dict: byte -> (next state, emitted tokens), PENDING -> its pending bytes, FINAL -> the tokens that
    end the piece there. ``states`` finds it by its pending bytes; all are forgotten when there are max_states."""

    PENDING, FINAL = -1, -2

    def __init__(self, ranks: dict[bytes, int], max_pending: int = 512, max_states: int = STATES):
        self.ranks, self.max_pending, self.max_states = ranks, max_pending, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.prefixes = {token[:k] for token in ranks for k in range(1, len(token))}
        self.longest = max(map(len, ranks))
        self._reset()

    def _reset(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.clear()  # states point at each other; else they would wait for the garbage collector beside new ones
        self.states: dict[bytes, dict] = {}
        self.short: dict[bytes, tuple[int, ...]] = {}
        self.start = self._state(b"")

    def _state(self, pending: bytes) -> dict:
        if (state := self.states.get(pending)) is None:
            state = self.states[pending] = {self.PENDING: pending}
        return state

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """enc(piece) by the merges themselves: lowest rank first, leftmost on ties."""
        if len(piece) > 24:
            return self._merge_long(piece)
        if (known := self.short.get(piece)) is not None:
            return known
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(ranks) + 1
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) != none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if len(self.short) > 2 * self.max_states:
            self.short.clear()
        out = self.short[piece] = tuple([ranks[p] for p in parts])
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap, in O(n log n)."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end[i]: where the part starting at i ends
        before = list(range(-1, n))
        heap = [(ranks[pair], i, i + 2) for i in range(n - 1) if (pair := piece[i : i + 2]) in ranks]
        heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, stop = heappop(heap)
            mid = end[i]
            if not alive[i] or mid >= n or end[mid] != stop or not alive[mid]:
                continue  # one of the two parts has been merged meanwhile
            alive[mid] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heappush(heap, (r, i, end[stop]))
            if i > 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
                heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def step(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """The arc for one byte, worked out and kept: the next state and the tokens it emits."""
        text = state[self.PENDING] + bytes((byte,))
        sure = self.merge(text)
        for p in range(max(0, len(text) - self.longest), len(text)):
            if text[p:] in self.prefixes:
                other = self.merge(text[:p])
                k = 0
                while k < len(sure) and k < len(other) and sure[k] == other[k]:
                    k += 1
                sure = sure[:k]
                if not sure:
                    break
        done = sum([len(self.tokens[t]) for t in sure])
        arc = state[byte] = (self._state(text[done:]), sure)
        return arc

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one piece; a piece that is a token is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        if len(self.states) >= self.max_states:
            self._reset()
        out: list[int] = []
        state, step = self.start, self.step
        long = len(piece) > self.max_pending
        for at, byte in enumerate(piece):
            state, sure = state.get(byte) or step(state, byte)
            if sure:
                out += sure
            if long and len(state[self.PENDING]) > self.max_pending:
                return (*out, *self.merge(state[self.PENDING] + piece[at + 1 :]))
        if (rest := state.get(self.FINAL)) is None:
            rest = state[self.FINAL] = self.merge(state[self.PENDING])
        out += rest
        return tuple(out)


class Utf8Machine:
    """Incremental UTF-8: feed bytes in any cuts, get text; ill-formed sequences become U+FFFD at the end of
    their longest valid part. The state is the pending bytes of an unfinished character, three at most."""

    def __init__(self):
        self.pending = b""

    @staticmethod
    def _need(lead: int) -> tuple[int, int, int]:
        """Length of the sequence that lead opens (0: none) and the range of its second byte."""
        if lead < 0x80:
            return 1, 0, 0
        if 0xC2 <= lead <= 0xDF:
            return 2, 0x80, 0xBF
        if 0xE0 <= lead <= 0xEF:
            return 3, 0xA0 if lead == 0xE0 else 0x80, 0x9F if lead == 0xED else 0xBF
        if 0xF0 <= lead <= 0xF4:
            return 4, 0x90 if lead == 0xF0 else 0x80, 0x8F if lead == 0xF4 else 0xBF
        return 0, 0, 0

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        pending = self.pending
        for byte in data:
            if pending:
                length, low, high = self._need(pending[0])
                if (low <= byte <= high) if len(pending) == 1 else (0x80 <= byte <= 0xBF):
                    pending += bytes((byte,))
                    if len(pending) == length:
                        out.append(pending.decode())
                        pending = b""
                    continue
                out.append("�")
                pending = b""
            length = self._need(byte)[0]
            if length == 1:
                out.append(chr(byte))
            elif length:
                pending = bytes((byte,))
            else:
                out.append("�")
        self.pending = pending
        return "".join(out)

    def end(self) -> str:
        rest, self.pending = "�" if self.pending else "", b""
        return rest


class StreamDecoder:
    """Ids to text, as they come. What a token does to a state of the UTF-8 machine is worked out once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.clean: dict[int, str | None] = {}
        for rank, token in self.tokens.items():
            machine = Utf8Machine()
            text = machine.feed(token)
            self.clean[rank] = None if machine.pending or "�" in text else text
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text in pieces, each as soon as its characters are complete."""
        state, clean, moves = b"", self.clean, self.moves
        for i in ids:
            if not state and (text := clean[i]) is not None:
                yield text
                continue
            if (move := moves.get((state, i))) is None:
                machine = Utf8Machine()
                machine.pending = state
                text = machine.feed(self.tokens[i])
                move = moves[state, i] = (machine.pending, text)
            state, text = move
            if text:
                yield text
        if state:
            yield "�"

    def text(self, ids: list[int]) -> str:
        pieces = list(map(self.clean.__getitem__, ids))
        return "".join(pieces if None not in pieces else self.decode(ids))


class _Pieces(dict):
    """piece -> (ids, ids as text); forgets all when full."""

    def __init__(self, transducer: BpeTransducer, size: int):
        super().__init__()
        self.transducer, self.size = transducer, size

    def __missing__(self, piece: str) -> tuple[tuple[int, ...], str]:
        ids = self.transducer.encode(piece.encode())
        got = (ids, ",".join(map(str, ids)))
        if len(piece) <= 48:
            if len(self) >= self.size:
                self.clear()
            self[piece] = got
        return got


class Codec:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, states: int = STATES):
        import regex

        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(BpeTransducer(ranks, max_states=states), states * 4 // 5)
        self.decoder = StreamDecoder(ranks)

    def forget(self) -> None:
        """Give back what texts have added; a worker outlives its tasks and waits beside other stages."""
        self.pieces.clear()
        self.pieces.transducer._reset()
        give_back()  # states point at each other

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces
        return list(chain.from_iterable([pieces[p][0] for p in self.split(text)]))

    def decode(self, ids: list[int]) -> str:
        return self.decoder.text(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them."""
        pieces = self.pieces
        got = [pieces[p] for p in self.split(text)]
        ids = list(chain.from_iterable([g[0] for g in got]))
        named = ",".join([g[1] for g in got])
        decoded = self.decoder.text(ids)
        return len(ids), hashlib.sha256(named.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


_codecs: dict[tuple[str, str, int], Codec] = {}


def codec(path: str, pattern: str, states: int) -> Codec:
    """One codec for each vocabulary and Python worker."""
    if (path, pattern, states) not in _codecs:
        _codecs[path, pattern, states] = Codec(load_ranks(path), pattern, states)
    return _codecs[path, pattern, states]


def encode_documents(docs: DataFrame, path: str, pattern: str, states: int = 100_000) -> DataFrame:
    """doc_id, ids array<int>, text as decoded again, for every row of docs(doc_id, text).

    A null text counts as empty: no ids, text "". Rows are independent, so repeated rows give repeated results and
    an empty table gives none; other columns of docs are not read. Texts are never cut. states bounds what the
    transducer keeps of its arcs, and so the memory of a worker: some 90 MB here, 140 MB with STATES; results are the same."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own = codec(path, pattern, states)

        def made(keys, ids, texts):
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

        for batch in batches:
            keys, ids, texts, chars = [], [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                own_ids = own.encode(text.as_py() or "")
                keys.append(key.as_py())
                ids.append(np.array(own_ids, np.int32))
                texts.append(own.decode(own_ids))
                chars += len(texts[-1])
                if chars > SLICE:
                    yield made(keys, ids, texts)
                    keys, ids, texts, chars = [], [], [], 0
            if keys:
                yield made(keys, ids, texts)
        own.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, text string")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the same ids and decoded bytes, computed in one pass."""

    def run(batches):
        import pyarrow as pa

        own = codec(path, pattern, STATES)
        for batch in batches:
            rows = [own.digest(t.as_py() or "") for t in batch.column(1)]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)
