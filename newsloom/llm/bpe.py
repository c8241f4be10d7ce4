"""Byte-level BPE by a lazily determinised finite-state transducer, and its streaming decoder.

Every prefix of a piece has exactly one valid tokenisation, and a sequence of tokens is valid when
each neighbouring pair is what the merges give for the pair's own bytes. A state holds the bytes that
may still begin a longer token; registers hold the last token at each place. What the tokenisations
at all places where a longer token may start agree on is final: it is emitted and its registers are
dropped, so lookahead is bounded by the longest token and memory by that and EVERY. States,
transitions and pair checks are made when first met and reused afterwards; what a frequent whole
chunk or piece makes from the start state is kept as one transition.

Null text counts as empty and gives no tokens. One row in gives one row out, repeated rows, rows without
id and very long texts included; columns other than the id and the text go. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.plan import bounded_batches, quoted
from newsloom.llm.words import HELD, give_back

MAX_VOCABULARY_BYTES = 64 << 20
#: Bounds of what one worker keeps: pair checks, whole chunks, and pieces of chunks; no result depends on them.
PAIRS, CHUNKS, PIECES = 400_000, 600_000, 300_000
#: Bytes between two looks at what is final.
EVERY = 64
#: How a pattern must end for its matches to start anew at a lone space.
SPACED = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ADJACENT = re.compile(r"\s | \s|^ | $|[\x1c-\x1f]")


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class State:
    """Bytes that may begin a longer token, how far before their end one may start, and for each next
    byte met the tokens (size, id) that can end there, longest first, and the next state."""

    __slots__ = ("tail", "starts", "step")

    def __init__(self, tail: bytes, prefixes: set[bytes]):
        self.tail, self.step = tail, {}
        self.starts = [len(tail) - k for k in range(len(tail) + 1) if k == len(tail) or tail[k:] in prefixes]


class Transducer:
    """Bytes to token ids, for one piece, whole or in parts."""

    START = -1

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.states: dict[bytes, State] = {}
        self.start = self.state(b"")

    def state(self, tail: bytes) -> State:
        return self.states.get(tail) or self.states.setdefault(tail, State(tail, self.prefixes))

    def merge(self, data: bytes) -> list[int]:
        """The merges applied one at a time, lowest rank first: the definition, used for pairs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [self.ranks.get(data[i : i + 2], 1 << 60) for i in range(len(data) - 1)]
        while ranks and (best := min(ranks)) < 1 << 60:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [self.ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether the merges give a token's own bytes back as that token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def valid(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens apart when they stand together."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = left == self.START or self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.pairs[left, right] = known
        return known

    def ends(self, state: State, byte: int) -> tuple[tuple[tuple[int, int], ...], State]:
        """The transition at a byte: tokens that can end there and the next state."""
        text = state.tail + bytes((byte,))
        found = []
        for size in range(len(text), 0, -1):
            token = self.ranks.get(text[-size:])
            if token is not None and self.stands(token):
                found.append((size, token))
        while text and text not in self.prefixes:
            text = text[1:]
        step = state.step[byte] = (tuple(found), self.state(text))
        return step

    @staticmethod
    def path(tokens: list[int], sizes: list[int], at: int) -> list[int]:
        """The tokens of the tokenisation that ends at a place."""
        out = []
        while at:
            out.append(tokens[at])
            at -= sizes[at]
        return out[::-1]

    def final(self, state: State, tokens: list[int], sizes: list[int]) -> list[int]:
        """The tokens that no later byte can change, whose registers are dropped."""
        live = {len(tokens) - 1 - back for back in state.starts}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(last - sizes[last])
        (place,) = live
        out = self.path(tokens, sizes, place)
        del tokens[:place], sizes[:place]
        return out

    def stream(self, parts: Iterable[bytes], every: int = 1) -> Iterator[list[int]]:
        """Tokens of one piece that arrives in parts, each once no later byte can change it, looked at
        every so many bytes, and the rest at the end."""
        state, pairs = self.start, self.pairs
        tokens, sizes, due = [self.START], [0], every  # the registers: at each place, the token that ends there
        for data in parts:
            for byte in data:
                try:
                    found, state = state.step[byte]
                except KeyError:
                    found, state = self.ends(state, byte)
                for size, token in found:
                    left = tokens[-size]
                    known = pairs.get((left, token))
                    if known or known is None and self.valid(left, token):
                        tokens.append(token)
                        sizes.append(size)
                        break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
                if len(tokens) > due:
                    yield self.final(state, tokens, sizes)
                    due = len(tokens) + every - 1
        yield self.path(tokens, sizes, len(tokens) - 1)

    def encode(self, data: bytes) -> list[int]:
        return [token for out in self.stream((data,), EVERY) for token in out]


class Packed(dict):
    """Text to its ids as little-endian 32-bit integers; entries are kept up to a bound."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, text: str) -> bytes:
        out = self.make(text)
        if len(self) < self.most and len(text) <= 64:
            self[text] = out
        return out


class Utf8Decoder:
    """Incremental UTF-8: a state machine over the bytes that an unfinished character still needs."""

    def __init__(self):
        self.left = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many last bytes begin a character that is not complete (0 to 3)."""
        need = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4 if byte < 0xF8 else 0
                return back if need > back else 0
        return 0

    def feed(self, data: bytes, last: bool = False) -> str:
        data = self.left + data
        keep = 0 if last else self.unfinished(data)
        self.left = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")


class Codec:
    def __init__(self, content: bytes, pattern: str):
        ranks = read_ranks(content)
        self.pattern = regex.compile(pattern)
        self.transducer = Transducer(ranks)
        self.pieces = Packed(self.piece, PIECES)
        self.chunks = Packed(self.chunk, CHUNKS)
        head = pattern.removesuffix(SPACED)
        self.by_chunk = head != pattern and regex.fullmatch(r"\|?('[a-z]+\|?)*", head) is not None
        self.vocabulary = {v: k for k, v in ranks.items()}

    def piece(self, piece: str) -> bytes:
        ids = array("I", self.transducer.encode(piece.encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def chunk(self, chunk: str) -> bytes:
        found = self.pattern.findall(chunk)
        # a chunk that is one piece is kept once
        return self.piece(chunk) if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def encode_packed(self, text: str) -> bytes:
        """Where every space stands alone between other characters, no match runs past the end of a
        chunk that a space begins, so chunks are matched apart and found again; else the whole text."""
        if not self.by_chunk or ADJACENT.search(text):
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        first, *rest = text.split(" ")
        return self.chunks[first] + b"".join(map(self.chunks.__getitem__, map(" ".__add__, rest)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def decode_stream(self, ids, step: int = 4096) -> Iterator[str]:
        """Texts of consecutive runs of ids; a character split between tokens waits for its rest."""
        machine = Utf8Decoder()
        for i in range(0, len(ids), step):
            yield machine.feed(self.decode_bytes(ids[i : i + step]))
        yield machine.feed(b"", last=True)


_codecs: dict[tuple[bytes, str], Codec] = HELD.setdefault("bpe", {})


def codec(content: bytes, pattern: str) -> Codec:
    """One codec for each Python worker and vocabulary; its states stay for later tasks."""
    key = (hashlib.sha256(content).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(content, pattern)
    return _codecs[key]


def vocabulary(path: str) -> bytes:
    """The vocabulary file, read by the driver and sent with the tasks; its size is checked."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to send with each task")
    return content


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, token_ids (array<int>, with ``ids``), ids_sha256 and decoded_sha256.

    One row in, one row out, repeated rows included. The text is decoded again from its ids.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches):
        c = codec(sent.value, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                counts, lists, digests, decoded = [], [], [], []
                for text in part.column(1):
                    packed = c.encode_packed(text.as_py() or "")
                    found = np.frombuffer(packed, dtype="<u4")
                    counts.append(len(found))
                    digests.append(hashlib.sha256(packed).hexdigest())
                    back, machine = hashlib.sha256(), Utf8Decoder()
                    for at in range(0, len(found), 1 << 16):
                        back.update(machine.feed(c.decode_bytes(found[at : at + (1 << 16)].tolist())).encode())
                    back.update(machine.feed(b"", last=True).encode())
                    decoded.append(back.hexdigest())
                    if ids:
                        lists.append(found.astype(np.int32))
                columns = {"doc_id": part.column(0), "n_tokens": pa.array(counts, pa.int64())}
                if ids:
                    columns["token_ids"] = pa.array(lists, pa.list_(pa.int32()))
                columns |= {"ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, " + "token_ids array<int>, " * ids + "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(lambda batches: give_back(run(batches), "bpe"), schema)
