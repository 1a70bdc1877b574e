"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last WINDOW characters decides where a text is cut, so equal passages of different documents give
equal chunks, wherever they stand. A chunk is encoded once and its ids are remembered by each worker. Where two chunks
join, the end of the left one is encoded again together with more and more of the right one, until the result ends with a
pre-token that the right one has there itself; no merge crosses that, so from there on the right one's ids hold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm.common import in_batches
from colloquy.llm.token_counts import byte_lengths, portions

WINDOW, MEAN_BITS, LEAST = 16, 9, 64
#: Pre-tokens at a chunk's start at which a join may agree; where none does the chunk is encoded again whole.
HEAD = 4
#: Characters of remembered chunks and remembered pre-tokens of a worker; they bound memory only.
CHUNK_CHARS, REMEMBERED = 8_000_000, 300_000
#: Characters for which the pattern below and the library's splitter agree (checked one by one in the tests).
UNUSUAL = re.compile("[^\x00-\u0557\u2000-\u208e\u20a0-\ua7cd]")
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INV)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def cuts(text: str) -> list[int]:
    """Where chunks of text end. Depends on the WINDOW characters before a cut, and on the cut before it by LEAST."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(points)
    if n <= LEAST:
        return [n]
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    sums = np.cumsum(points * up[:n])
    sums[WINDOW:] -= sums[:-WINDOW].copy()
    value = sums * down[:n] * np.uint64(0xD6E8FEB86659FD93)
    out, last = [], 0
    for k in (np.flatnonzero(value >> np.uint64(64 - MEAN_BITS) == 0) + 1).tolist():
        if k - last >= LEAST and k < n:
            out.append(k)
            last = k
    return [*out, n]


@dataclass(slots=True)
class Chunk:
    """ids of all pre-tokens but those of tail, which what follows may change; the first pre-tokens, and for each where it
    starts in the text and in ids."""

    text: str
    ids: bytes
    tail: str
    head: list[str]
    chars: list[int]
    places: list[int]


class ChunkCodec:
    """Gives the ids that the tokenizers library gives for a byte-level BPE file."""

    def __init__(self, path: str):
        import json

        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        spec = json.loads(self.lib.to_str())
        split = spec["pre_tokenizer"] or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only plain byte-level tokenizers are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not supported")
        self.usual = regex.compile(PATTERN).findall
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.added_ids = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        # Bytes of each id: the byte-level alphabet maps printable bytes to themselves, the others to U+0100 and on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.bytes = [b""] * (max(self.lib.get_vocab().values()) + 1)
        for token, i in self.lib.get_vocab().items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.ids: dict[str, bytes] = {}
        self.chunks: dict[str, Chunk] = {}
        self.held = self.encoded = self.used = 0

    def pretokens(self, text: str) -> list[str]:
        if UNUSUAL.search(text):
            return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        return self.usual(text)

    def words_ids(self, words: list[str]) -> bytes:
        return b"".join(map(self.ids.__getitem__, words))

    def remember(self, texts: set[str]) -> None:
        """Encodes chunks that are new."""
        new = {t: self.pretokens(t) for t in texts if t not in self.chunks}
        ends = {}
        for t, words in new.items():
            # What follows can change the last pre-token, and one before it where an apostrophe and a letter may become a
            # contraction ('l of 'll).
            ends[t] = words[-2:] if len(words) > 1 and len(words[-1]) == 1 and words[-2] == "'" else words[-1:]
            del words[len(words) - len(ends[t]) :]
        self.learn(set().union(*new.values()) if new else set())
        for t, words in new.items():
            chars, places = [0], [0]
            for w in words[:HEAD]:
                chars.append(chars[-1] + len(w))
                places.append(places[-1] + len(self.ids[w]))
            self.chunks[t] = Chunk(t, self.words_ids(words), "".join(ends[t]), words[:HEAD], chars, places)
            self.held += len(t)
        self.encoded += len(new)

    def joined(self, text: str) -> list[bytes | list[str]]:
        """The encoding of a text without added tokens, in parts: ids of its chunks, and pre-tokens that are to be encoded
        again. What waits for an agreement is looked at when it has doubled, so a pre-token over many chunks takes linear time."""
        out: list[bytes | list[str]] = []
        wait: list[str] = []  # text from a certain pre-token start on
        size = need = start = 0
        for end in cuts(text):
            c = self.chunks[text[start:end]]
            start = end
            self.used += 1
            if size >= need and wait:
                left = "".join(wait)
                for k, word in enumerate(c.head):
                    again = self.pretokens(left + c.text[: c.chars[k + 1]])
                    if again[-1] == word:
                        out += [again[:-1], c.ids[c.places[k] :]]
                        wait = [c.tail]
                        break
                else:
                    wait = [left, c.text]
                size = sum(map(len, wait))
                need = 2 * size if len(wait) > 1 else 0
            elif wait:
                wait.append(c.text)
                size += len(c.text)
            else:
                out.append(c.ids)
                wait, size, need = [c.tail], len(c.tail), 0
        out.append(self.pretokens("".join(wait)))
        return out

    def learn(self, some: set[str]) -> None:
        """Remembers the ids of pre-tokens that are new. Words with a space before them are encoded as one text, which the library
        splits at each of these spaces again; if it also splits elsewhere, there are more parts than words, and such a
        batch goes one by one, as all else does."""
        words, rest = [], []
        for t in some.difference(self.ids):
            (words if t[0] == " " and t[1:].isalpha() else rest).append(t)
        for k in range(0, len(words), 4096):
            some = words[k : k + 4096]
            e = self.lib.encode("".join(some), add_special_tokens=False)
            word, ids = np.array(e.word_ids), np.array(e.ids, "<u4").tobytes()
            at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            ends = (4 * np.r_[at, len(word)]).tolist()
            if len(at) == len(some):
                self.ids.update((t, ids[a:b]) for t, a, b in zip(some, ends[:-1], ends[1:], strict=True))
            else:
                rest += some
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            self.ids.update((t, np.array(e.ids, "<u4").tobytes()) for t, e in zip(some, self.lib.encode_batch(some, add_special_tokens=False), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.added.split(t) if t and self.added and self.added.search(t) else [t or ""] for t in texts]
        self.remember({p[a:b] for some in pieces for p in some[::2] if p for a, b in pairwise([0, *cuts(p)])})
        parts = [[x for k, p in enumerate(some) if p for x in ([self.added_ids[p]] if k % 2 else self.joined(p))] for some in pieces]
        self.learn({w for some in parts for x in some if isinstance(x, list) for w in x})
        out = [b"".join(x if isinstance(x, bytes) else self.words_ids(x) for x in some) for some in parts]
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        if self.held > CHUNK_CHARS:
            self.chunks.clear()
            self.held = 0
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> ChunkCodec:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return ChunkCodec(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; null text has no ids. Texts are encoded whole, rows are kept one by one."""
    return _mapped(docs, path, id_col, text_col, "ids array<int>", lambda c, ids: [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))])


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows with arrays of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return in_batches(encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each row is encoded, then decoded from its ids.

    Null text counts as empty, null ids stay null, repeated rows give repeated results, an empty table an empty one;
    other columns are not read. No shuffle: chunks are reused within a worker.
    """
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _mapped(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda c, ids: [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids], pa.string()), pa.array([sha(c.decode(x).encode()) for x in ids], pa.string())])


def _mapped(docs, path, id_col, text_col, columns, of):
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for part in portions(byte_lengths(b.column(1))):
                yield pa.RecordBatch.from_arrays([b.column(0)[part], *of(c, c.encode(b.column(1)[part].to_pylist()))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).mapInArrow(run, f"id {kind}, {columns}").withColumnRenamed("id", id_col)
