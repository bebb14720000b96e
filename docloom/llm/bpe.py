"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of the corpus (matches of the splitting pattern)
are laid out as linked symbols in flat arrays. An inverted index maps the rank
of every mergeable token pair to the positions where the pair stands. The
smallest rank that has positions is replayed over all words at once; a merge
looks at nothing but the left and right neighbours of the merged symbols, whose
new pairs enter the index. Each document is then assembled from its words' ids.
Blocks have a bounded number of bytes, so memory does not grow with the corpus,
and nothing is shuffled.

A merge may make a pair of smaller rank than its own; it is then replayed next,
as a word-by-word encoder would. Only where a word had two merges of one rank
in the same step could the order differ; such words are encoded one by one.

Cases: null and empty texts give no ids; texts of any length are encoded whole,
run by run of words; bytes that are no UTF-8 pass through unchanged; repeated
rows give repeated results; null ids and any other columns are carried, never
interpreted, whatever their names (columns called ids or n_tokens are replaced);
an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame

from docloom.llm import shared, text


class Vocabulary:
    """Ranks of byte strings; a token's id is its rank. Bounded by the vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 80_000):
        self.pattern, self.ranks, self.remember = pattern, ranks, remember
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.encoder: Encoder | None = None  # of one worker

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        return cls(ranks, pattern)

    def __getstate__(self):
        return self.__dict__ | {"encoder": None}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank that each pair merges to, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)


def one_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a single word, always the leftmost of the smallest rank."""
    ends = list(range(1, len(word) + 1))  # of the part that begins at a place; 0: none does
    before = list(range(-1, len(word) - 1))

    def waiting(i: int):
        if i >= 0 and ends[i] < len(word) and (rank := ranks.get(word[i : ends[ends[i]]])) is not None:
            yield rank, i, ends[ends[i]]

    heap = [x for i in range(len(word)) for x in waiting(i)]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        right = ends[i]
        if not right or right == len(word) or ends[right] != end:
            continue  # one of its parts has been merged since
        ends[i], ends[right] = end, 0
        if end < len(word):
            before[end] = i
        for x in (*waiting(before[i]), *waiting(i)):
            heapq.heappush(heap, x)
    return [ranks[word[i:end]] for i, end in enumerate(ends) if end]


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of non-empty words, one after the other, and how many each has; merges are replayed over all together."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    ids = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    place = np.int32 if total < 1 << 31 else np.int64
    owner = np.repeat(np.arange(len(words), dtype=place), lengths)
    after = np.arange(1, total + 1, dtype=place)
    before = np.arange(-1, total - 1, dtype=place)
    after[ends - 1] = -1
    before[ends - lengths] = -1
    alive = np.ones(total, bool)
    rank = np.full(total, -1, np.int32)
    inside = np.flatnonzero(after >= 0)
    rank[inside] = vocabulary.rank_of(ids[inside], ids[inside + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(positions: np.ndarray) -> None:
        positions = positions[rank[positions] >= 0]
        if len(positions) == 0:
            return
        positions = positions[np.argsort(rank[positions], kind="stable")]
        values = rank[positions]
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for r, some in zip(values[np.r_[0, cuts]].tolist(), np.split(positions, cuts), strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(some)

    enter(inside)
    by_hand: set[int] = set()
    while heap:
        r = heapq.heappop(heap)
        held = index.pop(r)
        at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
        at = at[rank[at] == r]
        if len(at) == 0:
            continue
        if len(at) > 1 and (chained := after[at[:-1]] == at[1:]).any():  # overlapping pairs: from the left, every other one
            starts = np.r_[True, ~chained]
            first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        right = after[at]
        beyond = after[right]
        ids[at] = r
        after[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        alive[right] = False
        rank[right] = -1
        left = before[at]
        touched = np.unique(np.concatenate([at, left[left >= 0]]))
        rank[touched] = -1
        open_ = touched[after[touched] >= 0]
        rank[open_] = vocabulary.rank_of(ids[open_], ids[after[open_]])
        early = open_[(rank[open_] >= 0) & (rank[open_] < r)]
        if len(early):
            seen, times = np.unique(owner[at], return_counts=True)
            by_hand.update(np.intersect1d(owner[early], seen[times > 1]).tolist())
        enter(open_)
    lengths = np.bincount(owner[alive], minlength=len(words)).astype(np.int64)
    out = ids[alive]
    if by_hand:
        parts = np.split(out, np.cumsum(lengths)[:-1])
        for w in by_hand:
            parts[w] = np.array(one_word(words[w], vocabulary.ranks), np.int64)
        out, lengths = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    return out, lengths


class _Words(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


class Encoder:
    """Ids of the words met so far, in one flat array; forgotten when there are too many.

    Texts are cut into words in runs of ``run``; of a run only the words' numbers
    stay. New words wait until the block ends or ``fresh`` of them are there, and
    are then merged together. Memory holds at most ``remember + fresh + run``
    words, however long a text or a block is.
    """

    def __init__(self, vocabulary: Vocabulary, run: int = 50_000, fresh: int = 40_000):
        import regex

        self.vocabulary, self.run, self.fresh = vocabulary, run, fresh
        pattern = regex.compile(vocabulary.pattern)
        self.find, self.each = pattern.findall, pattern.finditer
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.flat, self.starts = _Words(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        ranks = self.vocabulary.ranks
        whole = np.fromiter((ranks.get(r, -1) for r in raw), np.int64, len(raw))
        rest = np.flatnonzero(whole < 0)
        ids, lengths = replay([raw[i] for i in rest], self.vocabulary)
        n = np.ones(len(raw), np.int64)
        n[rest] = lengths
        flat = np.empty(int(n.sum()), np.uint32)
        starts = np.cumsum(n) - n
        known = np.flatnonzero(whole >= 0)
        flat[starts[known]] = whole[known]
        flat[np.repeat(starts[rest] - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(ids))] = ids
        self.starts = np.concatenate([self.starts, self.starts[-1] + starts + n])
        self.flat = np.concatenate([self.flat, flat])

    def _runs(self, decoded: str):
        """Words of a text, some at a time."""
        if len(decoded) <= 4 * self.run:
            yield self.find(decoded)
            return
        words = (m.group() for m in self.each(decoded))
        while some := list(islice(words, self.run)):
            yield some

    def block(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, np.ndarray]] = []  # (text, numbers of words)

        def flush() -> None:
            new = len(self.numbers) - (len(self.starts) - 1)
            if new:
                self._learn(list(islice(reversed(self.numbers), new))[::-1])
            for i, numbered in waiting:
                begins = self.starts[numbered]
                n = self.starts[numbered + 1] - begins
                ends = np.cumsum(n)
                parts[i].append(self.flat[np.repeat(begins - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)])
            waiting.clear()
            if len(self.numbers) > self.vocabulary.remember:
                self._forget()

        for i, body in enumerate(texts):
            for words in self._runs((body or b"").decode("utf-8", "surrogateescape")):
                waiting.append((i, np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))))
                if len(self.numbers) - (len(self.starts) - 1) >= self.fresh:
                    flush()
        flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]


def encode_block(texts: list[bytes | None], vocabulary: Vocabulary) -> list[np.ndarray]:
    """uint32 ids of each text; words stay known to the worker for its later blocks."""
    if vocabulary.encoder is None:
        vocabulary.encoder = Encoder(vocabulary)
    return vocabulary.encoder.block(texts)


def _encode(vocabulary, columns: list[str], text_name: str, block_bytes: int):
    def run(batches):
        import pyarrow as pa

        for table in text.blocks(batches, block_bytes, text_name):
            found = encode_block(table[text_name].cast(pa.large_binary()).to_pylist(), vocabulary.value)
            done = table.select(columns).append_column("out0", pa.array([len(x) for x in found], pa.int64()))
            yield from done.append_column("out1", pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())).to_batches()

    return run


def encode(df: DataFrame, vocabulary: Vocabulary, text_name: str = "text", keep: list[str] | None = None, block_bytes: int = 2 << 20) -> DataFrame:
    """Columns ``keep`` (all but the text by default), n_tokens and ids (little-endian uint32); columns of these two names are replaced."""
    keep = [c for c in (df.columns if keep is None else keep) if c != text_name and c not in ("ids", "n_tokens")]
    shared.bound_batches(df.sparkSession)
    known = df.sparkSession.sparkContext.broadcast(vocabulary)
    return shared.map_texts(df, keep, text_name, lambda columns, body: _encode(known, columns, body, block_bytes), n_tokens="long", ids="binary")


def _decode(vocabulary, columns: list[str], ids_name: str):
    def run(batches):
        import pyarrow as pa

        look = vocabulary.value.tokens.__getitem__
        for batch in batches:
            texts = [b"".join(map(look, np.frombuffer(x, "<u4").tolist())) if x is not None else None for x in batch[ids_name].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(texts, pa.binary())], [*columns, "out0"])

    return run


def decode(df: DataFrame, vocabulary: Vocabulary, ids_name: str = "ids", out_name: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) and the bytes that the ids stand for; null ids stay null; a column of the added name is replaced."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out_name]
    known = df.sparkSession.sparkContext.broadcast(vocabulary)
    return shared.map_texts(df, keep, ids_name, lambda columns, ids: _decode(known, columns, ids), **{out_name: "binary"})
