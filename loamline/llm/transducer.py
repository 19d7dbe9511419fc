"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

Every prefix of a BPE-encoded string has one encoding, and it ends in one last
token; that token follows the encoding of the prefix before it exactly when the
two tokens stay apart when encoded together. So the whole encoding can be
followed from left to right by keeping, for each place from which a longer token
might still start, the tokens up to that place. Tokens that all these places
agree on are final and are emitted: the lookahead is bounded by the longest
token.

A state is what has not been emitted, without its absolute position: the bytes
since each open place and the tokens pending up to it. The last emitted token is
kept beside it, and only looked at by transitions at which a token may start
right after it. States and transitions are made when they are first needed and
kept; a transition is then a dictionary look-up that may emit tokens.

Decoding composes a UTF-8 state machine with the vocabulary in the same lazy
way: (decoder state, token) leads to the next state and the completed text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.base import bounded, byte_slices, text_or_empty
from loamline.llm.tokens import BYTE_TOKENIZER, SLICE_BYTES

CACHE_ENTRIES = 400_000  # chunks and pieces of at most CACHED_LETTERS
CACHED_LETTERS = 64
STATE_ENTRIES = 200_000
APART_ENTRIES = 1_000_000


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The defining procedure: merge the leftmost pair of lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, 1 << 62), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 62:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes byte strings; ``encode(piece)`` equals ``merge_by_rank``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        # The vocabulary as a trie: child of (node << 8 | byte); the token that ends at a node, or -1.
        self.child: dict[int, int] = {}
        self.ends = [-1]
        self.inner = [True]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                node = self.child.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(False)
            self.ends[node] = i
        for edge in self.child:
            self.inner[edge >> 8] = True
        # How each token is made: the two tokens of its last merge (a byte: itself twice).
        self.joined: dict[tuple[int, int], int] = {}
        self.halves = [(i, i) for i in range(len(self.tokens))]
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1 and len(two := merge_by_rank(t, {k: v for k in _substrings(t) if (v := ranks.get(k, i)) < i})) == 2:
                self.halves[i] = (two[0], two[1])
                self.joined[two[0], two[1]] = i
        self.apart: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: ((trie node, pending tokens), ...) of each open place, longest open bytes first.
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, tuple] = {}
        self._state(((0, ()),))

    def _state(self, key: tuple) -> int:
        found = self.number.setdefault(key, len(self.states))
        if found == len(self.states):
            self.states.append(key)
        return found

    def _stays(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay apart: no merge across their border comes before those that make them.

        The border's two tokens are taken back merge by merge, latest first.
        """
        joined, halves = self.joined, self.halves
        before = len(halves)
        while True:
            if joined.get((a, b), before) < before:
                return False
            if a > b:
                before, inner = a, halves[a][1]
                if inner != a:
                    a = inner
                    continue
                before = b + 1
                if halves[b][0] == b:
                    return True
                b = halves[b][0]
            else:
                before, inner = b + 1, halves[b][0]
                if inner != b:
                    b = inner
                    continue
                before = a
                if halves[a][1] == a:
                    return True
                a = halves[a][1]

    def _after(self, still: list, here: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
        """The state with ``here`` as the pending tokens up to now, and what all its places agree on."""
        places = [*still, (0, here)]
        n = len(here) if all([p for _, p in places]) else 0
        for _, p in places if n else ():
            n = min(n, len(p))
            while p[:n] != here[:n]:
                n -= 1
        return self._state(tuple([(s, p[n:]) for s, p in places]) if n else tuple(places)), here[:n]

    def _move(self, state: int, byte: int) -> tuple:
        """``(guard, state, out, state, out)``.

        At most one place has nothing pending; whether a token may start there
        depends on the last token emitted. That token is then the guard: the
        first state and output hold if it stays apart from the last one, the
        others if not. Without a guard (-1) the first hold.
        """
        guard, here, still = -1, None, []
        for node, pending in self.states[state]:
            grown = self.child.get(node << 8 | byte)
            if grown is None:
                continue
            if (t := self.ends[grown]) >= 0:
                if not pending:
                    guard = t
                elif here is None and self.stays(pending[-1], t):
                    here = (*pending, t)
            if self.inner[grown]:
                still.append((grown, pending))
        if guard < 0 and here is None:
            raise ValueError("a byte is not in the vocabulary")
        rest = self._after(still, here) if here is not None else (0, ())
        made = self.moves[state << 8 | byte] = (guard, *(self._after(still, (guard,)) if guard >= 0 else rest), *rest)
        return made

    def stays(self, a: int, b: int) -> bool:
        found = self.apart.get(a << 20 | b)
        if found is None:
            if len(self.apart) > APART_ENTRIES:
                self.apart.clear()
            found = self.apart[a << 20 | b] = self._stays(a, b)
        return found

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > STATE_ENTRIES:
            self._reset()
        out: list[int] = []
        state, last, get = 0, -1, self.moves.get
        for byte in piece:
            guard, state, more, other, other_more = get(state << 8 | byte) or self._move(state, byte)
            if guard >= 0 and last >= 0 and not self.stays(last, guard):
                state, more = other, other_more
            if more:
                out += more
                last = more[-1]
        out += self.states[state][-1][1]
        return out


def _substrings(t: bytes) -> set[bytes]:
    return {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}


class Encoder(dict):
    """Ids of whole texts; pieces already met are kept as packed ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks = ranks
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(raw)
        ids = self.transducer.encode(raw) if whole is None else [whole]
        packed = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(piece) <= CACHED_LETTERS:
            self.pieces[piece] = packed
        return packed

    def __missing__(self, chunk: str) -> bytes:
        """``chunk`` is a stretch of text that the pattern splits alike wherever it stands."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
            self.pieces.clear()
        known = self.pieces
        if len(chunk) > CACHED_LETTERS:
            return b"".join([known.get(m) or self._piece(m) for m in self.split(chunk)])
        packed = self[chunk] = b"".join([known.get(m) or self._piece(m) for m in self.split(chunk)])
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A space before a character that is no white space starts a new match
        of the pattern, so a text can be cut there; with other white space
        around the space it is left whole up to the next such place.
        """
        if not text:
            return b""
        chunks = text.split(" ")
        if "" in chunks:
            return b"".join([self[c] for c in _cut(text)])
        first = chunks[0]
        return self[first] + b"".join([self[c] for c in [" " + c for c in chunks[1:]]])


#: A single space after and before something that is not white space.
_PLACE = regex.compile(r"(?<=\S)(?= \S)")


def _cut(text: str) -> list[str]:
    return _PLACE.split(text)


# --- decoding ---------------------------------------------------------------


def _utf8_step(state: tuple[int, int, int], byte: int) -> tuple[tuple[int, int, int], bool, bool]:
    """One byte of the UTF-8 automaton.

    A state is (bytes still needed, least and most next byte). Returns the next
    state, whether the byte ends a code point, and whether what was pending
    before it is broken off (the byte is then read again from the start).
    """
    need, low, high = state
    if need:
        if low <= byte <= high:
            return ((need - 1, 0x80, 0xBF) if need > 1 else (0, 0, 0)), need == 1, False
        return (0, 0, 0), False, True
    if byte < 0x80:
        return (0, 0, 0), True, False
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF), False, False
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF), False, False
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF), False, False
    return (0, 0, 0), False, False


class Decoder:
    """Streaming decode: feed ids, get the text completed so far; ``finish`` flushes.

    Broken sequences become U+FFFD, one for each maximal broken part.
    """

    def __init__(self, tokens: list[bytes], memo: dict | None = None):
        self.tokens = tokens
        self.memo = {} if memo is None else memo
        self.state: tuple = ((0, 0, 0), b"")

    def _token(self, state: tuple, token: int) -> tuple[tuple, str]:
        (automaton, held), out = state, []
        for byte in self.tokens[token]:
            now, done, broken = _utf8_step(automaton, byte)
            if broken:
                out.append("�")
                held = b""
                now, done, _ = _utf8_step((0, 0, 0), byte)
            if done:
                out.append((held + bytes([byte])).decode())
                held = b""
            elif now[0]:
                held += bytes([byte])
            else:
                out.append("�")
            automaton = now
        return (automaton, held), "".join(out)

    def feed(self, ids: Iterable[int]) -> str:
        out, state, memo = [], self.state, self.memo
        for i in ids:
            step = memo.get((state, i))
            if step is None:
                step = memo[state, i] = self._token(state, i)
            state = step[0]
            out.append(step[1])
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        rest = "�" if self.state[1] else ""
        self.state = ((0, 0, 0), b"")
        return rest


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> tuple[Encoder, list[bytes], dict]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = Encoder(ranks, pattern)
    return encoder, encoder.transducer.tokens, {}


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit), ``decoded`` (text of the ids, streamed).

    One row for each row of ``docs``, in one pass without a shuffle. Null texts
    count as empty: no ids, an empty decoded text. Repeated rows are each
    encoded. Other columns are not read.
    """
    path = path or public_tokenizers.path(BYTE_TOKENIZER)
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens, memo = codec(path, pattern)
        for b in (part for b in batches for part in byte_slices(b, 1, SLICE_BYTES)):
            ids = [encoder.encode(t) for t in b.column(1).to_pylist()]
            texts = []
            for x in ids:
                d = Decoder(tokens, memo)
                texts.append(d.feed(np.frombuffer(x, "<u4").tolist()) + d.finish())
            if len(memo) > CACHE_ENTRIES:
                memo.clear()
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    source = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode_and_decode``."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def sha256_hex(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
