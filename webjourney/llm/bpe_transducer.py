"""Byte-level BPE by a transducer that reads bytes from left to right.

Two tokens may stand side by side if merging the bytes of both gives just these two; a sequence of tokens is the
encoding of its bytes if all its neighbours may. So every prefix has exactly one last token, and a prefix's encoding is
that of a shorter prefix plus one token. The state keeps, for every place where a token that reaches further may
start, the tokens that end there; tokens that all of these share are emitted, hence the lookahead is bounded by the
longest token. States are numbered when they are first met (lazy determinisation): a transition that has been taken
once is a table lookup from then on.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webjourney.llm.common import Pieces, bounded_batches, encode_column


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Transducer:
    """Ids of one piece; ``ranks`` gives each token's id, which is also the order of merges."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000, most_pairs: int = 1_000_000):
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.bytes_of = token_bytes(self.text)
        self.no_rank = max(self.text) + 1
        self.most_states, self.most_pairs = most_states, most_pairs
        self.side_by_side: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        self._plant()
        self._reset()

    def _plant(self) -> None:
        """The tokens as a tree of bytes: child by (node, byte), the token that ends at a node (-1: none)."""
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for text, rank in self.ranks.items():
            node = 0
            for byte in text:
                self.inner[node] = True
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = rank

    def _reset(self) -> None:
        # A state: for each place a token may start at, the node that the bytes read since lead to and the tokens not
        # yet emitted; -1 stands for the start of the piece, else the first token is the last one that was emitted.
        start = ((0, (-1,)),)
        self.states, self.numbers = [start], {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: list[tuple[int, ...]] = [()]
        if len(self.side_by_side) > self.most_pairs:
            self.side_by_side.clear()

    def merge(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first; used on at most two tokens' bytes when the table is filled."""
        parts = [data[i:i + 1] for i in range(len(data))]
        rank = self.ranks.get
        none = self.no_rank
        ranked = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranked:
            lowest = min(ranked)
            if lowest == none:
                break
            i = ranked.index(lowest)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranked[i]
            if i < len(ranked):
                ranked[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranked[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        if left < 0:
            if right not in self.own:
                self.own[right] = self.merge(self.text[right]) == [right]
            return self.own[right]
        key = (left, right)
        if key not in self.side_by_side:
            both = self.text[left] + self.text[right]
            self.side_by_side[key] = both not in self.ranks and self.may_follow(-1, right) and \
                self.merge(both) == [left, right]
        return self.side_by_side[key]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        open_places = []
        here = None
        for node, tokens in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if here is None and token >= 0:
                follows = self.side_by_side.get((tokens[-1], token))
                if self.may_follow(tokens[-1], token) if follows is None else follows:
                    here = (*tokens, token)
            if self.inner[node]:
                open_places.append((node, tokens))
        if here is None:
            raise ValueError("the vocabulary lacks a byte")
        open_places.append((0, here))
        first = open_places[0][1]
        shared = len(first)  # the first token is the same everywhere
        for _, tokens in open_places[1:]:
            if shared == 1:
                break
            n, most = 1, min(shared, len(tokens))
            while n < most and tokens[n] == first[n]:
                n += 1
            shared = n
        # The last shared token stays as the left neighbour of what follows.
        new = tuple(open_places) if shared == 1 else tuple(
            [(node, tokens[shared - 1:]) for node, tokens in open_places])
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
            self.ends.append(here[shared:])
        move = self.moves[state << 8 | byte] = (number, first[1:shared])
        return move

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.states) > self.most_states:
            self._reset()
        out: list[int] = []
        state = 0
        moves = self.moves
        for byte in piece:
            state, emitted = moves.get(state << 8 | byte) or self._step(state, byte)
            if emitted:
                out += emitted
        out += self.ends[state]
        return out


def token_bytes(text_of: dict[int, bytes]) -> pa.Array:
    """The bytes of each id at its own place, for ``decode_stream``."""
    return pa.array([text_of.get(i) for i in range(max(text_of) + 1)], pa.large_binary())


def decode_stream(chunks: Iterable[np.ndarray], texts: pa.Array) -> Iterator[str]:
    """Text of ids that come in chunks; a character cut by a chunk's end waits for its other bytes.

    Bytes that are no UTF-8 come out as U+FFFD; an id that no token has is an error.
    """
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in chunks:
        found = texts.take(pa.array(ids))
        if found.null_count:
            raise KeyError("no token has this id")
        yield machine.decode(found.buffers()[2] if len(found) else b"")
    yield machine.decode(b"", True)


_CODERS: dict[str, tuple[Transducer, Pieces]] = {}


def coder(path: str, pattern: str) -> tuple[Transducer, Pieces]:
    """One of each vocabulary for a Python worker, whichever tasks it runs."""
    import regex

    key = f"{path}\n{pattern}"
    if key not in _CODERS:
        machine, matches = Transducer(load_ranks(path)), regex.compile(pattern)

        def encode(piece: str) -> bytes:
            found = matches.findall(piece)
            if len(found) > 1:
                return b"".join([pieces[m] for m in found])
            return np.array([i for m in found for i in machine.encode(m.encode())], "<u4").tobytes()

        pieces = Pieces(encode)
        _CODERS[key] = machine, pieces
    return _CODERS[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the text that decoding them gives.

    A null text is the empty one; repeated rows stay; other columns are not looked at. Work is row by row, without a
    shuffle.
    """
    bounded_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, pieces = coder(path, pattern)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            gc.disable()  # the table of states has no cycles; looking for some in it takes a fifth of the time
            try:
                ids, counts = encode_column(texts, pieces, False)
            finally:
                gc.enable()
            ends = np.cumsum(counts)
            own = [ids[e - n:e] for e, n in zip(ends, counts)]
            chunks = ([x[i:i + 4096] for i in range(0, len(x), 4096)] for x in own)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts), pa.array([x.tobytes() for x in own], pa.binary()),
                pa.array(["".join(decode_stream(c, machine.bytes_of)) for c in chunks], pa.string()),
            ], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, decoded string")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
