"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens that no piece of the vocabulary can cross. The distinct pre-tokens of a batch lie in one
ragged numpy array; in every step each sequence merges its own pair of lowest rank, all sequences at once, until no
sequence has a pair left. The symbols that survive are the tokens.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from colloquy.llm.common import in_batches

MARK = "▁"
NONE = np.int64(1) << 60
#: Distinct pre-tokens a worker remembers, and bytes it handles at once. Both bound memory only, not what is counted.
REMEMBERED, AT_ONCE = 300_000, 1 << 21
#: Characters from which a pre-token has a list of its pairs by rank, so that a step costs what it merges.
LONG = 2000


class PairTable:
    """(left symbol, right symbol) -> symbol, in open addressing over numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray):
        bits = max(8, int(len(left) * 4).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.made = np.full(1 << bits, -1, np.int64)
        keys, slots = (left << 32) | right, self._slot(left, right)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slots[todo]] == -1]
            at = slots[free]
            self.keys[at] = keys[free]  # of several for one slot the last is in; the others go on
            self.made[at] = made[free]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & self.mask

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left * 0x9E3779B1 + right * 0x85EBCA77) ^ ((left * 0x9E3779B1 + right * 0x85EBCA77) >> 15)) & self.mask

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, -1 for none."""
        keys, slots = (left << 32) | right, self._slot(left, right)
        out = np.where(self.keys[slots] == keys, self.made[slots], -1)
        todo = np.flatnonzero((out < 0) & (self.keys[slots] != -1))
        for _ in range(self.probes):
            if not len(todo):
                break
            slots[todo] = (slots[todo] + 1) & self.mask
            hit = self.keys[slots[todo]] == keys[todo]
            out[todo[hit]] = self.made[slots[todo[hit]]]
            todo = todo[~hit & (self.keys[slots[todo]] != -1)]
        return out


def _fields(data: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a protocol buffer's message."""
    out: dict[int, int | bytes] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            out[key >> 3] = number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        out[key >> 3] = data[at : at + size]
        at += size
    return out


def check_model(data: bytes) -> None:
    """Raises ValueError for a sentencepiece model that does anything to a text but what PieceCounter does.

    Fixed values of that format: field 2 is the trainer's settings, 3 of these the model's type (2 is BPE), 24 marks at the
    ends of words; field 3 is the normaliser's, of these 2 its rules, 3 a space before the text, 4 removal of spaces, 5
    marks for spaces, the last three true unless given."""
    model = _fields(data)
    trainer, rules = _fields(model.get(2, b"")), _fields(model.get(3, b""))
    if trainer.get(3, 1) != 2 or trainer.get(24, 0):
        raise ValueError("only BPE models with marks before words are supported")
    if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
        raise ValueError("only models that leave texts as they are but for a space before them are supported")


class PieceCounter:
    """Counts tokens as a sentencepiece BPE model with byte fallback does."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            check_model(f.read())
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        score = {sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.byte_fallback = any(sp.is_byte(i) for i in range(n))
        chars = sorted({c for p in score for c in p})
        symbols = chars + [p for p in score if len(p) > 1]
        ids = {p: i for i, p in enumerate(symbols)}
        # Characters that no piece has: one symbol for each length in UTF-8.
        self.other = len(symbols)
        self.char = np.full(0x110000, self.other + 3, np.int32)
        self.char[:0x10000], self.char[:0x800], self.char[:0x80] = self.other + 2, self.other + 1, self.other
        self.char[[ord(c) for c in chars]] = np.arange(len(chars))
        levels = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.array([levels.get(score.get(p), 0) for p in symbols], np.int64)
        unknown = lambda c: len(c.encode()) if self.byte_fallback else 1
        self.cost = np.array([1 if p in score else unknown(p) for p in symbols] + ([1, 2, 3, 4] if self.byte_fallback else [1] * 4), np.int64)
        splits = [(ids[p[:k]], ids[p[k:]], ids[p]) for p in score if len(p) > 1 for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        self.pairs = PairTable(*np.array(splits, np.int64).T) if splits else None
        # A pre-token ends before a mark that follows anything else, and around characters that no longer piece has.
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in score):
            raise ValueError("pieces that go on after a space are not supported")
        alone = "" if any("\n" in p for p in score if len(p) > 1) else "\n"
        self.split = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + ("|\n" if alone else "")).findall
        self.known: dict[str, int] = {}

    def merge(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        if any(len(t) >= LONG for t in texts):
            total = np.zeros(len(texts), np.int64)
            long = np.array([len(t) >= LONG for t in texts])
            total[long] = [self.merge_long(t) for t, x in zip(texts, long, strict=True) if x]
            total[~long] = self.merge([t for t, x in zip(texts, long, strict=True) if not x])
            return total
        total = np.zeros(len(texts), np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        sym = self.char[points].astype(np.int64)
        seq = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        while len(sym):
            made = np.full(len(sym), -1, np.int64)
            if len(sym) > 1 and self.pairs:
                made[:-1] = self.pairs.get(sym[:-1], sym[1:])
                made[:-1][seq[:-1] != seq[1:]] = -1
            rank = np.where(made >= 0, self.rank[made], NONE)
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            each = np.diff(np.r_[first, len(seq)])
            low = np.minimum.reduceat(rank, first)
            ready = np.repeat(low == NONE, each)
            if ready.any():
                np.add.at(total, seq[ready], self.cost[sym[ready]])
                sym, seq, made, rank, low, each = sym[~ready], seq[~ready], made[~ready], rank[~ready], low[low != NONE], each[low != NONE]
                if not len(sym):
                    break
            low = np.repeat(low, each)
            hit = rank == low
            # Of overlapping pairs the left one goes first: every other one of a run.
            at = np.arange(len(hit))
            start = hit & ~np.r_[False, hit[:-1]]
            run = np.maximum.accumulate(np.where(start, at, 0))
            hit &= (at - run) % 2 == 0
            hit = self._in_order(sym, seq, made, low, hit)
            sym = np.where(hit, made, sym)
            keep = ~np.r_[False, hit[:-1]]
            sym, seq = sym[keep], seq[keep]
        return total

    def merge_long(self, text: str) -> int:
        """The number of tokens of one pre-token. The same steps, lowest rank first and all its pairs at once, but places
        are listed by the rank of the pair that starts there, and symbols linked to their neighbours."""
        sym = self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)
        n = len(sym)
        # Places n and -1, which is the same, stand for the ends; their symbol is in no pair.
        sym = np.r_[sym, -1]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[n] = before[0] = n
        rank = np.full(n + 1, NONE)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def listed(at: np.ndarray) -> None:
            right = sym[after[at]]
            made = np.where(right >= 0, self.pairs.get(sym[at], np.maximum(right, 0)), -1)
            rank[at] = new = np.where(made >= 0, self.rank[made], NONE)
            at, new = at[new < NONE], new[new < NONE]
            if not len(at):
                return
            order = np.argsort(new, kind="stable")
            at, new = at[order], new[order]
            cut = np.flatnonzero(np.diff(new)) + 1
            for r, some in zip(new[np.r_[0, cut]].tolist(), np.split(at, cut), strict=True):
                if r not in places:
                    heapq.heappush(ranks, r)
                    places[r] = []
                places[r].append(some)

        if self.pairs:
            listed(np.arange(n))
        while ranks:
            low = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(low)))
            at = at[rank[at] == low]
            if not len(at):
                continue
            # Of overlapping pairs the left one goes first: every other one of a run.
            i = np.arange(len(at))
            start = np.r_[True, after[at[:-1]] != at[1:]]
            at = at[(i - np.maximum.accumulate(np.where(start, i, 0))) % 2 == 0]
            gone = after[at]
            made = self.pairs.get(sym[at], sym[gone])
            beside, behind = before[at], after[gone]
            left = np.where(np.r_[False, behind[:-1] == at[1:]], np.r_[-1, made[:-1]], sym[beside])
            # A merged symbol can form a pair of a still lower rank, which goes before the merges to its right.
            sooner = np.zeros(len(at), bool)
            for ok, x, y in ((left >= 0, left, made), (sym[behind] >= 0, made, sym[behind])):
                new = self.pairs.get(np.maximum(x, 0), np.maximum(y, 0))
                sooner |= ok & (new >= 0) & (self.rank[new] < low)
            if sooner.any():
                stop = int(sooner.argmax()) + 1
                if stop < len(at):
                    heapq.heappush(ranks, low)
                    places[low] = [at[stop:]]
                at, gone, made, behind = at[:stop], gone[:stop], made[:stop], behind[:stop]
            sym[at], rank[gone] = made, NONE
            sym[gone] = -2
            after[at] = behind
            before[behind] = at
            after[n] = n
            touched = np.unique(np.r_[before[at], at])
            listed(touched[touched < n])
        return int(self.cost[sym[sym >= 0]].sum())

    def _in_order(self, sym: np.ndarray, seq: np.ndarray, made: np.ndarray, low: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Merging from left to right, a merged symbol can form a pair of a still lower rank, which has to go before the
        merges to its right; these wait for the next step."""
        at = np.flatnonzero(hit)
        made_at = made[at]
        left, right = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
        before = np.maximum(at - 2, 0)
        left_sym = np.where((at >= 2) & hit[before], made[before], sym[left])
        sooner = np.zeros(len(at), bool)
        for ok, pair in (((at >= 1) & (seq[left] == seq[at]), (left_sym, made_at)), ((at + 2 < len(sym)) & (seq[right] == seq[at]), (made_at, sym[right]))):
            new = self.pairs.get(*pair)
            sooner |= ok & (new >= 0) & (self.rank[new] < low[at])
        if not sooner.any():
            return hit
        so_far = np.cumsum(sooner) - sooner
        first = np.r_[True, seq[at][1:] != seq[at][:-1]]
        base = np.repeat(so_far[first], np.diff(np.r_[np.flatnonzero(first), len(at)]))
        out = np.zeros_like(hit)
        out[at[so_far == base]] = True
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.split(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if new:
            self.known.update(zip(new, self.merge(new).tolist(), strict=True))
        get = self.known.__getitem__
        out = [sum(map(get, words)) for words in cut]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return out


@lru_cache(2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def byte_lengths(texts: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def portions(lengths: list[int], at_once: int = AT_ONCE) -> Iterator[slice]:
    """Slices of about at_once bytes: the length of texts, not their number, bounds what Python holds of a batch."""
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > at_once:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of docs; no shuffle.

    Null text counts as empty: 0 bytes, 0 tokens. Null ids stay null, repeated rows are counted one by one, other
    columns are not read. An empty table gives an empty result. Texts of any length are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            size, n = byte_lengths(batch.column(1)), []
            for part in portions(size):
                n += counter.count(batch.column(1)[part].to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = in_batches(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
