"""Token counts by rank-synchronous array merging.

A text is cut into pre-tokens that no merge can cross. Those not met before are held as one
ragged array of symbols; in every round each sequence's lowest-rank pair is merged, in all
sequences at once, until no sequence has a pair left. What survives is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from runledger.llm import ragged
from runledger.llm.common import Memo, travels

travels(__name__)
travels(ragged.__name__)

# Counts of pre-tokens that a task remembers before it starts anew; speed only, never results.
REMEMBERED = 600_000
_NONE = np.int64(1 << 40)
_SPACE = "▁"


class PairTable:
    """The merges of a vocabulary: which pairs of symbols join, in which order, to which symbol.

    Symbols are the vocabulary's pieces and their single characters. Pairs are found in an
    open hash table of numpy arrays.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        score = dict(pieces)
        known = {piece: number for number, piece in enumerate(score)}
        for piece in score:
            for char in piece:
                known.setdefault(char, len(known))
        self.width = max(1, len(known)).bit_length()
        order = {value: rank for rank, value in enumerate(sorted(set(score.values()), reverse=True))}
        keys, ranks, results = [], [], []
        for piece, value in score.items():
            for cut in range(1, len(piece)):
                left, right = known.get(piece[:cut]), known.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left << self.width | right)
                    ranks.append(order[value])
                    results.append(known[piece])
        # A single character that is a piece is one token; any other is as many as it has bytes.
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for symbol, number in known.items():
            if len(symbol) == 1:
                self.symbol_of[ord(symbol)] = number
        self.weights = np.array([1 if symbol in score else len(symbol.encode()) for symbol in known] + [1, 2, 3, 4])
        self.unknown = len(known) - 1  # plus the number of bytes
        self._build(np.array(keys, np.int64), np.array(ranks, np.int64), np.array(results, np.int64))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, keys: np.ndarray, ranks: np.ndarray, results: np.ndarray) -> None:
        self.bits = max(4, (4 * len(keys)).bit_length())
        size = (1 << self.bits) + len(keys) + 1
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE)
        self.results = np.zeros(size, np.int64)
        waiting, at = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            winners = waiting[free][first]
            self.keys[slots], self.ranks[slots], self.results[slots] = keys[winners], ranks[winners], results[winners]
            left = self.keys[at] != keys[waiting]
            waiting, at = waiting[left], at[left] + 1

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, and the symbol it becomes; pairs that don't merge have the last rank."""
        keys = left << self.width | right
        at = self._slot(keys)
        while True:
            there = self.keys[at]
            other = (there != keys) & (there >= 0)
            if not other.any():
                break
            at = at + other
        hit = there == keys
        return np.where(hit, self.ranks[at], _NONE), self.results[at]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' symbols one after another, and each word's length."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.symbol_of[points].astype(np.int64)
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        return np.where(found < 0, self.unknown + size, found), np.fromiter(map(len, words), np.int64, len(words))

    def counts(self, words: list[str]) -> np.ndarray:
        """How many tokens each word has; no word is empty."""
        out = np.zeros(len(words), np.int64)
        symbol, sizes = self.symbols(words)
        number = np.arange(len(words))
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        rank, into = self._ranks(symbol, start, sizes)
        while len(sizes):
            best = np.minimum.reduceat(rank, start)
            done = best == _NONE
            if done.any():
                ended = np.repeat(done, sizes)
                weights = self.weights[symbol[ended]]
                firsts = np.concatenate([[0], np.cumsum(sizes[done])])[:-1].astype(np.int64)
                out[number[done]] = np.add.reduceat(weights, firsts) if len(weights) else 0
                symbol, rank, into = symbol[~ended], rank[~ended], into[~ended]
                number, sizes, best = number[~done], sizes[~done], best[~done]
                start = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
                if not len(sizes):
                    break
            symbol, rank, into, sizes, start = self._merge(symbol, rank, into, sizes, start, best)
        return out

    def _ranks(self, symbol, start, sizes):
        rank, into = np.full(len(symbol), _NONE), np.zeros(len(symbol), np.int64)
        if len(symbol) > 1:
            rank[:-1], into[:-1] = self.find(symbol[:-1], symbol[1:])
        rank[start + sizes - 1] = _NONE
        return rank, into

    def _merge(self, symbol, rank, into, sizes, start, best):
        """One round: every sequence's lowest-rank pair, at all its places if their order can't matter."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(rank == best[owner])
        run = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[place % 2 == 0]  # a symbol belongs to one pair
        who = owner[at]
        first = np.concatenate([[True], who[1:] != who[:-1]])
        if not first.all():
            # If a merge makes a pair that comes before this round's, only the first place is merged now.
            new, before, after = into[at], np.maximum(at - 1, 0), np.minimum(at + 2, len(symbol) - 1)
            has_before, has_after = at > start[who], at + 2 < (start + sizes)[who]
            twin = np.concatenate([[False], (at[1:] == at[:-1] + 2) & ~first[1:]])
            sooner = (
                (has_before & (self.find(symbol[before], new)[0] < best[who]))
                | (has_after & (self.find(new, symbol[after])[0] < best[who]))
                | (twin & (self.find(new, new)[0] < best[who]))
            )
            if sooner.any():
                single = np.zeros(len(sizes), bool)
                single[who[sooner]] = True
                keep = first | ~single[who]
                at, who = at[keep], who[keep]
        symbol = symbol.copy()
        symbol[at] = into[at]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        new_at = np.cumsum(keep)[at] - 1
        symbol, rank, into = symbol[keep], rank[keep], into[keep]
        sizes = sizes - np.bincount(who, minlength=len(sizes))
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        last = np.zeros(len(symbol), bool)
        last[start + sizes - 1] = True
        inner = np.ones(len(symbol), bool)
        inner[start] = False
        rank[new_at] = _NONE
        stale = np.zeros(len(symbol), bool)
        stale[new_at] = True
        stale[new_at[inner[new_at]] - 1] = True
        renew = np.flatnonzero(stale & ~last)
        rank[renew], into[renew] = self.find(symbol[renew], symbol[renew + 1])
        return symbol, rank, into, sizes, start


class PieceCounter:
    """Token counts of texts under a piece vocabulary with byte fallback and a leading space."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        pieces = [(model.id_to_piece(i), model.get_score(i)) for i in ids]
        if any(_SPACE in piece.lstrip(_SPACE) for piece, _ in pieces) or model.normalize("  Ａ é ") != "▁▁▁Ａ▁é▁":
            raise ValueError("this vocabulary has pieces across spaces, or changes texts before it cuts them")
        self.table = PairTable(pieces)
        self.known: dict[str, int] = {}

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        """Runs of spaces, each with what follows it; no piece goes on past one."""
        parts = (" " + text.replace(_SPACE, " ")).split(" ")[1:]
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for part in parts:
            if part:
                out.append(" " * spaces + part)
                spaces = 0
            else:
                spaces += 1
        return out + [" " * (spaces - 1)] * (spaces > 0)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; an empty text has none."""
        cut = [self.pre_tokens(text) if text else [] for text in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set().union(*cut)
            words = sorted(new)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                self.known.update(zip(some, self.table.counts([_SPACE + word.replace(" ", _SPACE) for word in some]).tolist()))
        get = self.known.__getitem__
        return [sum(map(get, parts)) for parts in cut]


_COUNTERS: dict[str, PieceCounter] = Memo("piece counters")


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row; one pass, no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Special strings in a text are ordinary text.
    Repeated rows and null keys are rows like others, extra columns are ignored, and an empty
    table gives no rows. A task's memory is bounded by its longest text and REMEMBERED.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            for part in ragged.portions(batch, text):
                column = part.column(text).fill_null("")
                sizes = pa.compute.cast(pa.compute.binary_length(column), pa.int64())
                found = pa.array(counter.counts(column.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(key), sizes, found, pa.compute.greater(found, limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
