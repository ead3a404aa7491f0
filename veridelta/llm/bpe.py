"""Byte-level BPE as a lazily determinised finite-state transducer, and its inverse.

Encoding. For every prefix of a piece, the BPE encoding of that prefix ends in exactly one
token, and a token sequence is an encoding just when each neighbouring pair is one on its own.
So a left-to-right machine needs to know, at each position, only the last token there: a token
``t`` ends at position i when it is a suffix of the input and forms a valid pair with the last
token at ``i - len(t)``. Positions older than the longest suffix that starts a vocabulary entry
can't be reached by any later token. A state of the transducer therefore holds that suffix and
the last tokens of the live positions; whatever all live positions have in common behind them is
emitted. States and transitions are made when first met, up to a bound; beyond it short pieces
finish without new states, and long ones start the table anew.

Decoding. Token bytes go through an incremental UTF-8 machine whose transitions over whole
tokens are remembered, so a code point split over tokens comes out as soon as it is complete.

Null text is the empty text; an empty text has no tokens. Nulls in doc_id stay null. Repeated
rows give repeated results. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from veridelta.llm.common import kept, map_arrow


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """bytes -> token ids, one byte at a time. ``max_states`` bounds the memory."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 40_000):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.prefixes = {token[:i] for token in ranks for i in range(len(token) + 1)}
        self.max_states = max_states
        self.sizes = [0] * (max(self.bytes_of) + 1)
        for token, raw in self.bytes_of.items():
            self.sizes[token] = len(raw)
        # Of each live suffix: its number, its length and the tokens that end it, longest first.
        self.suffixes: dict[bytes, int] = {}
        self.texts: list[bytes] = []
        self.ends: list[list[tuple[int, int, dict[int, bool]]]] = []
        self.moves: list[dict[int, int]] = []
        # Of each token: whether it forms a valid pair with a token before it.
        self.pairs: dict[int, dict[int, bool]] = {}
        self.n_pairs = 0
        self._suffix(b"")
        self._reset()

    def _reset(self) -> None:
        # A state: the live suffix, the token that ends at the root, and the last token at each
        # position after the root (-1 where no live position's chain passes).
        self.keys: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[int, tuple]] = []  # byte -> state, how to look up its arrows, what is emitted
        self.final: list[tuple[int, ...] | None] = []
        self.start = self._state((0, -1, ()))

    def _suffix(self, text: bytes) -> int:
        found = self.suffixes.get(text)
        if found is None:
            found = self.suffixes[text] = len(self.texts)
            self.texts.append(text)
            self.moves.append({})
            ends = [(len(text) - i, self.ranks[text[i:]]) for i in range(len(text)) if text[i:] in self.ranks]
            self.ends.append([(*x, self.pairs.setdefault(x[1], {})) for x in ends if self.merge(self.bytes_of[x[1]]) == [x[1]]])
        return found

    def _move(self, suffix: int, byte: int) -> int:
        text = self.texts[suffix] + bytes((byte,))
        while text not in self.prefixes:
            text = text[1:]
        found = self.moves[suffix][byte] = self._suffix(text)
        return found

    def _state(self, key: tuple) -> int:
        found = self.keys.get(key)
        if found is None:
            found = self.keys[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.final.append(None)
        return found

    def _chain(self, last: tuple, at: int) -> tuple[int, ...]:
        """The tokens from the root to a position."""
        out, sizes = [], self.sizes
        while at:
            token = last[at - 1]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return tuple(out)

    def merge(self, piece: bytes) -> list[int]:
        """Plain BPE of a short byte string: merge the pair of lowest rank, leftmost first."""
        parts, get = [piece[i : i + 1] for i in range(len(piece))], self.ranks.get
        ranks = [get(x + y) for x, y in zip(parts, parts[1:])]
        while True:
            best = min((x for x in ranks if x is not None), default=None)
            if best is None:
                return [self.ranks[x] for x in parts]
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1])
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at])

    def _valid(self, left: int, right: int) -> bool:
        if self.n_pairs > 400_000:
            for known in self.pairs.values():
                known.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        valid = self.pairs[right][left] = left < 0 or self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return valid

    def _step(self, state: int, byte: int) -> tuple:
        suffix, root_token, last = self.states[state]
        end, sizes = len(last) + 1, self.sizes  # positions count from the root
        suffix = self.moves[suffix].get(byte) or self._move(suffix, byte)
        for size, token, known in self.ends[suffix]:
            left = last[end - size - 1] if end > size else root_token
            valid = known.get(left)
            if valid or valid is None and self._valid(left, token):
                break
        last = (*last, token)
        low = end - len(self.texts[suffix])
        # The youngest position that the chains of all live positions share: follow the youngest
        # of their heads back until one is left.
        heads, seen = {low}, None
        for p in range(low + 1, end + 1):
            before = p - sizes[last[p - 1]]
            if before < low:
                heads.add(before)
        if len(heads) > 1:
            seen = set(heads)
            while len(heads) > 1:
                top = max(heads)
                heads.discard(top)
                top -= sizes[last[top - 1]]
                heads.add(top)
                seen.add(top)
        (root,) = heads
        out = ()
        if root:
            out, root_token = self._chain(last, root), last[root - 1]
        if low - root > 1:
            kept = tuple([last[p - 1] if p in seen else -1 for p in range(root + 1, low + 1)]) + last[low:]
        else:
            kept = last[root:]
        key = (suffix, root_token, kept)
        if len(self.states) >= self.max_states:
            self._reset()
            return self._arrow(key, out)
        arrow = self.next[state][byte] = self._arrow(key, out)
        return arrow

    def _arrow(self, key: tuple, out: tuple[int, ...]) -> tuple:
        state = self._state(key)
        return state, self.next[state].get, out

    def _rest(self, state: int, tail: bytes) -> tuple[int, ...]:
        """The remaining tokens of a short piece, without making states: most words that meet a
        new transition are never seen again, so only their first new state is kept."""
        suffix, root_token, last = self.states[state]
        last, end, moves, ends = list(last), len(last), self.moves, self.ends
        for byte in tail:
            suffix = moves[suffix].get(byte) or self._move(suffix, byte)
            for size, token, known in ends[suffix]:
                left = last[end - size] if end >= size else root_token
                valid = known.get(left)
                if valid or valid is None and self._valid(left, token):
                    break
            end += 1
            last.append(token)
        return self._chain(last, end)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        state, out, short = self.start, [], len(piece) <= 64
        arrows = self.next[state].get
        for i, byte in enumerate(piece, 1):
            arrow = arrows(byte)
            if arrow is None:
                if short and len(self.states) >= self.max_states:
                    return (*out, *self._rest(state, piece[i - 1 :]))
                arrow = self._step(state, byte)
                if short:
                    return (*out, *arrow[2], *self._rest(arrow[0], piece[i:]))
            state, arrows, emitted = arrow
            if emitted:
                out += emitted
        final = self.final[state]
        if final is None:
            last = self.states[state][2]
            final = self.final[state] = self._chain(last, len(last))
        return (*out, *final)


class _Irregular(Exception):
    pass


class _Chunks(dict):
    """What follows a single space, up to the next one -> the ids of it and its space, as 32-bit numbers."""

    def __init__(self, pieces: Encoder, bound: int):
        super().__init__()
        self.pieces, self.bound = pieces, bound

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():  # one piece: a space and letters
            ids = self.pieces.piece(" " + chunk)
        else:
            if not chunk or self.pieces.blank(chunk[0] + chunk[-1]):
                raise _Irregular
            find = self.pieces.find(" " + chunk)
            ids = self.pieces.piece(find[0]) if len(find) == 1 else tuple(chain.from_iterable(map(self.pieces.__getitem__, find)))
        ids = array("I", ids).tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder(dict):
    """Text -> ids: splits by the pattern; remembers pieces up to a bound. A piece that is itself
    an entry of the vocabulary is that entry, as in the usual libraries.

    A single space between two characters that aren't white space always starts a piece under the
    default pattern, so texts are first cut there; texts with other white space around spaces, and
    other patterns, go through the pattern as a whole."""

    def __init__(self, path: str, pattern: str, bound: int = 200_000):
        super().__init__()
        self.machine = Transducer(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.blank = regex.compile(r"[\s\x1c-\x1f\x85]").search
        self.bound = bound
        self.chunks = _Chunks(self, bound) if pattern == default_pattern() else None

    def piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        rank = self.machine.ranks.get(raw)
        return (rank,) if rank is not None else self.machine.encode(raw)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.piece(piece)
        if len(piece) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if self.chunks is not None:
            first, *rest = text.split(" ")
            if first and not self.blank(first[-1]):
                try:
                    found = b"".join(map(self.chunks.__getitem__, rest))
                    head = array("I", chain.from_iterable(map(self.__getitem__, self.find(first)))).tobytes()
                    return np.frombuffer(head + found, np.uint32)
                except _Irregular:
                    pass
        return np.fromiter(chain.from_iterable(map(self.__getitem__, self.find(text))), np.uint32)


#: Lead byte -> (continuation bytes to come, least and greatest first continuation byte).
def _lead(byte: int) -> tuple[int, int, int] | None:
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


class Utf8Machine:
    """Incremental UTF-8: a state is the bytes of an unfinished code point. Ill-formed bytes
    come out as U+FFFD, one for each maximal part of a well-formed sequence."""

    def step(self, state: bytes, byte: int) -> tuple[bytes, str]:
        if state:
            more, low, high = _lead(state[0])
            if len(state) > 1:
                low, high = 0x80, 0xBF
            if low <= byte <= high:
                whole = state + bytes((byte,))
                return (b"", whole.decode()) if len(whole) > more else (whole, "")
            after, out = self.step(b"", byte)
            return after, "�" + out
        if byte < 0x80:
            return b"", chr(byte)
        return (bytes((byte,)), "") if _lead(byte) else (b"", "�")

    def feed(self, state: bytes, data: bytes) -> tuple[bytes, str]:
        out = []
        for byte in data:
            state, text = self.step(state, byte)
            out.append(text)
        return state, "".join(out)


class StreamDecoder:
    """Ids -> text, as a stream: ``feed`` returns what is complete, ``close`` the rest."""

    def __init__(self, bytes_of: dict[int, bytes], bound: int = 200_000):
        self.bytes_of, self.bound = bytes_of, bound
        self.machine, self.state = Utf8Machine(), b""
        self.arrows: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        self.whole: dict[int, str] = {}  # tokens that start and end between code points

    def _move(self, token: int) -> str:
        arrow = self.arrows.get((self.state, token))
        if arrow is None:
            if len(self.arrows) >= self.bound:
                self.arrows.clear()
            arrow = self.arrows[self.state, token] = self.machine.feed(self.state, self.bytes_of[token])
            if not self.state and not arrow[0]:
                self.whole[token] = arrow[1]
        self.state = arrow[0]
        return arrow[1]

    def feed(self, ids) -> str:
        ids = ids if isinstance(ids, list) else list(ids)
        out, at = list(map(self.whole.get, ids)), 0
        while True:
            # From an unfinished code point, or the next token not known to be whole, to the end of a code point.
            if not self.state:
                try:
                    at = out.index(None, at)
                except ValueError:
                    break
            while at < len(ids):
                out[at] = self._move(ids[at])
                at += 1
                if not self.state:
                    break
            else:
                break
        return "".join(out)

    def close(self) -> str:
        left, self.state = self.state, b""
        return "�" if left else ""

    def decode(self, ids) -> str:
        return self.feed(ids) + self.close()


def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, until it turns to another operator."""
    state, key = kept(__name__), (path, pattern)
    if key not in state:
        state.clear()
        state[key] = Encoder(path, pattern)
    return state[key]


def _decoder(enc: Encoder) -> StreamDecoder:
    if not hasattr(enc, "decoder"):
        enc.decoder = StreamDecoder(enc.machine.bytes_of)
    return enc.decoder


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>) of each whole text."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()

    def run(batch):
        enc = encoder(path, pattern)
        return {"doc_id": batch.column("doc_id"), "ids": [enc.encode(x or "").astype(np.int32) for x in batch.column("text").to_pylist()]}

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, ids array<int>", run, keep=True)


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text of each row's ids; null ids are no ids."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()

    def run(batch):
        dec = _decoder(encoder(path, pattern))
        return {"doc_id": batch.column("doc_id"), "text": [dec.decode(x or ()) for x in batch.column("ids").to_pylist()]}

    return map_arrow(tokens.select("doc_id", "ids"), "doc_id long, text string", run, keep=True)


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode, then decode, each whole text in one pass; what remains are counts and digests.

    doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the decoded bytes), n_bytes; with_ids adds ids (array<int>)."""
    path, pattern = path or default_vocabulary(), pattern or default_pattern()

    def run(batch):
        enc = encoder(path, pattern)
        dec, sizes, ids_sha, text_sha, lengths, kept = _decoder(enc), [], [], [], [], []
        for text in batch.column("text"):
            ids = enc.encode(text.as_py() or "")
            raw = dec.decode(ids.tolist()).encode()
            sizes.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(raw).hexdigest())
            lengths.append(len(raw))
            if with_ids:
                kept.append(ids.astype(np.int32))
        return {"ids": kept, "doc_id": batch.column("doc_id"), "n_tokens": sizes, "ids_sha256": ids_sha, "decoded_sha256": text_sha, "n_bytes": lengths}

    return map_arrow(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long" + ", ids array<int>" * with_ids, run, keep=True)
