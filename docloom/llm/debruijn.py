"""Substring dedup by words: repeated windows as paths of a compacted de Bruijn graph.

A word goes if a window of ``length`` words that covers it also starts in a document of smaller id. The windows are the
edges of a de Bruijn graph of words (an edge leads from its first ``length`` - 1 words to its last), of which only
the repeated edges matter, and of those a long stretch mostly repeats as a whole. So the repeated edges are compacted:

1. Anchors. Each window picks its least gram of ``GRAM`` words by hash; equal windows pick equal grams. Blocks send their
   distinct grams to range buckets, which tell each block those that two documents have. Windows without such a
   gram repeat nowhere and are not sent.
2. Edges. Runs of up to eight windows with one anchor go, with the windows before and after them, to the bucket of the
   anchor, once a block. A bucket thus holds all occurrences of its edges. It keeps those of two documents,
   with the least source coordinate (id, row, word) and, where all occurrences agree on it, the edge before and after.
   The windows of a gram that very many blocks have go out singly, by their own hash, so no bucket gets a gram's
   surroundings from everywhere.
3. Compaction. Two edges join where each is the only neighbour of the other: then every occurrence of one
   goes on as the other does, the node between does not branch, and the source coordinates follow each other.
   Buckets join their own edges to pieces; a Spark join glues pieces of different buckets, and their source coordinates
   put them in a row (in cells of 4,096 words, so no document gathers in one task).
4. Verification. Blocks look for the heads of the paths alone. Each occurrence of a path is digested over all of its
   words; a path whose occurrences do not all have the digest of their source was joined by colliding
   hashes, and its windows are told apart by their own digests.
5. Removal. Each occurrence of a path whose source has a smaller id removes its words.

Texts are never shuffled: blocks are files in the shared folder, named by a committed manifest.

Cases: null and empty texts have no words; a null id is smaller than any other; rows of equal id are one document for
the comparison; texts of fewer words than a window are kept; a very long text is one block (its task holds some 150
bytes for each of its words); an empty table gives no rows; only the id and text columns are read, whatever the
others are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import blocks, shared, text, words
from docloom.llm.suffix_dedup import BITS, _bucket_cuts, _pack, _unpack

#: Words of an anchor.
GRAM = 6
#: Windows that travel together at most.
RUN = 8
#: Blocks that have a gram before its windows go out one by one.
HOT_BLOCKS = 64
#: Words of a document in whose range paths are put together.
CELL = 4096


def _sequence_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive items."""
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : n + j]
    return text.mix64(out)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


class _Windows:
    """All windows of a block that lie inside one document, in order."""

    def __init__(self, uri: str, length: int, bits: int):
        self.length = length
        self.ids, self.data, self.offsets = blocks.read(uri)
        self.begins, self.ends, doc = words.spans(self.data, self.offsets)
        self.first_word = np.searchsorted(self.begins, self.offsets)
        own = words.hashes(words.padded8(self.data), self.begins, self.ends - self.begins) if len(self.begins) else np.zeros(0, np.uint64)
        n = max(len(own) - length + 1, 0)
        self.at = np.flatnonzero(doc[:n] == doc[length - 1 :]) if n else np.zeros(0, np.int64)  # first word of each window
        self.doc = doc[self.at]
        self.hash = np.maximum(_sequence_hashes(own, length)[self.at] >> np.uint64(64 - bits), np.uint64(1))  # 0 stands for none
        least = _sliding_least(_sequence_hashes(own, GRAM), length - GRAM + 1)[self.at] if n else np.zeros(0, np.uint64)
        # least hashes are small ones: mixed anew, they fill the buckets' ranges evenly
        self.anchor = text.mix64(least + np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - BITS) & ~np.uint64(1)

    def normalised(self) -> tuple[bytes, np.ndarray]:
        """(all words, each with a space behind, place of each word and the end)."""
        sizes = self.ends - self.begins
        place = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes + 1, out=place[1:])
        flat = np.full(int(place[-1]), 0x20, np.uint8)
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        flat[np.repeat(place[:-1], sizes) + step] = self.data[np.repeat(self.begins, sizes) + step]
        return flat.tobytes(), place

    def occurrences(self, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which head, window) of every window with the hash of a head."""
        order = np.argsort(self.hash, kind="stable")
        low, high = (np.searchsorted(self.hash[order], heads, side=s) for s in ("left", "right"))
        n = high - low
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(heads)), n), order[np.repeat(low, n) + step]


def _send_anchors(length: int, bits: int, n_buckets: int):
    """Worker: distinct anchors of a block; the lowest bit says that two documents of the block have it."""

    def run(batches):
        import pyarrow as pa

        cuts = _bucket_cuts(n_buckets)
        for batch in batches:
            for number, uri in zip(batch["number"].to_pylist(), batch["block"].to_pylist(), strict=True):
                held = _Windows(uri, length, bits)
                fresh = np.flatnonzero(np.r_[True, (held.anchor[1:] != held.anchor[:-1]) | (held.doc[1:] != held.doc[:-1])]) if len(held.at) else np.zeros(0, np.int64)
                anchor, own = held.anchor[fresh], held.ids[held.doc[fresh]]
                order = np.argsort(anchor, kind="stable")
                anchor, own = anchor[order], own[order]
                begins = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, np.int64)
                several = np.minimum.reduceat(own, begins) != np.maximum.reduceat(own, begins) if len(begins) else np.zeros(0, bool)
                values = anchor[begins] | several.astype(np.uint64)
                rows = [(b, number, uri, _pack(p)) for b, p in enumerate(np.split(values, np.searchsorted(values, cuts))) if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.binary()))], ["bucket", "number", "block", "body"])

    return run


ANCHORS = "bucket int, number long, block string, body binary"


def _shared_anchors(hot_blocks: int):
    """Worker, for one bucket: tell each block its anchors that two documents have; the lowest bit marks those of very many blocks."""

    def run(batches):
        import pyarrow as pa

        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        parts = [_unpack(r["body"]) for r in rows]
        anchors = np.concatenate(parts)
        source = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
        order = np.argsort(anchors & ~np.uint64(1), kind="stable")
        anchors, source = anchors[order], source[order]
        several, anchors = (anchors & np.uint64(1)).astype(bool), anchors & ~np.uint64(1)
        begins = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
        n = np.diff(np.r_[begins, len(anchors)])
        keep = np.repeat((n > 1) | np.logical_or.reduceat(several, begins), n)
        anchors = (anchors | np.repeat(n > hot_blocks, n).astype(np.uint64))[keep]
        source = source[keep]
        order = np.argsort(source, kind="stable")  # anchors stay in order inside a block
        cuts = np.searchsorted(source[order], np.arange(len(rows) + 1))
        anchors = anchors[order]
        for i, r in enumerate(rows):
            if cuts[i] < cuts[i + 1]:
                values = [[r["bucket"]], [r["number"]], [r["block"]], [_pack(anchors[cuts[i] : cuts[i + 1]])]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["bucket", "number", "block", "body"])

    return run


def _places(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every run, one after the other."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _runs(held: _Windows, wanted: np.ndarray):
    """Distinct runs of windows around shared anchors: (key, hashes, windows a run, before, after, least id, several ids, row, word)."""
    hot, wanted = (wanted & np.uint64(1)).astype(bool), wanted & ~np.uint64(1)
    i = np.minimum(np.searchsorted(wanted, held.anchor), max(len(wanted) - 1, 0))
    taken = np.flatnonzero(wanted[i] == held.anchor) if len(wanted) else np.zeros(0, np.int64)
    next_to = np.r_[False, np.diff(held.at) == 1] if len(held.at) else np.zeros(0, bool)
    before = np.where(next_to, np.r_[np.uint64(0), held.hash[:-1]], np.uint64(0)) if len(held.at) else held.hash
    after = np.where(np.r_[next_to[1:], False], np.r_[held.hash[1:], np.uint64(0)], np.uint64(0)) if len(held.at) else held.hash
    anchor, alone = held.anchor[taken], hot[i[taken]]
    new = np.ones(len(taken), bool)
    new[1:] = (np.diff(taken) != 1) | ~next_to[taken[1:]] | (anchor[1:] != anchor[:-1]) | alone[1:]
    since = np.arange(len(taken)) - np.maximum.accumulate(np.where(new, np.arange(len(taken)), 0)) if len(taken) else taken
    begin = np.flatnonzero(since % RUN == 0)
    n = np.diff(np.r_[begin, len(taken)])
    first, last = taken[begin], taken[begin + n - 1]
    hashes = held.hash[taken]
    key = np.where(alone[begin], text.mix64(hashes[begin].copy()) >> np.uint64(64 - BITS), anchor[begin])
    row = held.doc[first]
    ids, word = held.ids[row], held.at[first] - held.first_word[row]
    before, after = before[first], after[last]
    step = (np.arange(len(taken)) - np.repeat(begin, n) + 1).astype(np.uint64)
    digest = np.add.reduceat(text.mix64(hashes + step * np.uint64(0xC2B2AE3D27D4EB4F)), begin) if len(begin) else key
    digest = text.mix64(digest + before * np.uint64(0x9E3779B97F4A7C15) + text.mix64(after + np.uint64(1)))
    order = np.lexsort((word, row, ids, digest, key))  # the first of equal runs has the least coordinate
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (key[a] == key[b]) & (digest[a] == digest[b]) & (n[a] == n[b]) & (before[a] == before[b]) & (after[a] == after[b])
    pairs = np.flatnonzero(same)
    if len(pairs):  # equal digests of different runs stay two runs
        x, y = order[pairs], order[pairs - 1]
        unequal = hashes[_places(begin[x], n[x])] != hashes[_places(begin[y], n[y])]
        same[pairs[np.unique(np.repeat(np.arange(len(pairs)), n[x])[unequal])]] = False
    groups = np.flatnonzero(~same)
    several = np.maximum.reduceat(ids[order], groups) != ids[order[groups]] if len(groups) else np.zeros(0, bool)
    o = order[groups]
    return key[o], hashes[_places(begin[o], n[o])], n[o], before[o], after[o], ids[o], several, row[o], word[o]


#: What a run sends besides its hashes.
_FIELDS = (("n", "<u1"), ("several", "<u1"), ("row", "<u4"), ("word", "<u4"), ("before", "<u8"), ("after", "<u8"), ("id", "<i8"))


def _send_runs(length: int, bits: int, n_buckets: int):
    def run(batches):
        import pyarrow as pa

        cuts = _bucket_cuts(n_buckets)
        for uri, rows in blocks.by_block(batches):
            wanted = np.concatenate([_unpack(r["body"]) for r in rows])
            key, hashes, n, before, after, ids, several, row, word = _runs(_Windows(uri, length, bits), wanted)
            ends = np.r_[0, np.cumsum(n)]
            edges = np.r_[0, np.searchsorted(key, cuts), len(key)]
            values = {"n": n, "several": several, "row": row, "word": word, "before": before, "after": after, "id": ids}
            for b in range(n_buckets):
                i, j = edges[b], edges[b + 1]
                if i < j:
                    raw = b"".join(values[name][i:j].astype(kind).tobytes() for name, kind in _FIELDS) + hashes[ends[i] : ends[j]].tobytes()
                    columns = ([b], [rows[0]["number"]], [int(j - i)], [len(raw)], [pa.compress(raw, codec="zstd", asbytes=True)])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "number", "n", "raw", "body"])

    return run


RUNS = "bucket int, number long, n long, raw long, body binary"
#: Pieces (kind 0) and the blocks where their heads stand (kind 1); (row, word) is the source coordinate of the head.
PIECES = "kind int, head long, row long, word long, before long, tail long, after long, n long, id long, number long"


def _pieces():
    """Worker, for one bucket: its repeated edges, joined where no occurrence tells them apart."""
    schema = text.arrow_schema(PIECES)

    def run(batches):
        import pyarrow as pa

        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        got: dict[str, list[np.ndarray]] = {name: [] for name, _ in _FIELDS} | {"hash": [], "number": []}
        for r in rows:
            raw, at = pa.decompress(r["body"], r["raw"], codec="zstd", asbytes=True), 0
            for name, kind in _FIELDS:
                got[name].append(np.frombuffer(raw, kind, r["n"], at))
                at += r["n"] * np.dtype(kind).itemsize
            got["hash"].append(np.frombuffer(raw, "<u8", offset=at))
            got["number"].append(np.full(r["n"], r["number"], np.int64))
        run = {name: np.concatenate(parts) for name, parts in got.items()}
        n = run["n"].astype(np.int64)
        row = run["number"] << 32 | run["row"].astype(np.int64)
        order = np.lexsort((run["word"], row, run["id"]))
        begin = np.cumsum(n) - n
        flat = run["hash"][_places(begin[order], n[order])]  # windows by the coordinates of their runs
        n = n[order]
        owner = np.repeat(order, n)
        end = np.cumsum(n)
        step = np.arange(len(flat)) - np.repeat(end - n, n)
        prev, following = np.r_[np.uint64(0), flat[:-1]], np.r_[flat[1:], np.uint64(0)]
        prev[end - n], following[end - 1] = run["before"][order], run["after"][order]
        order = np.argsort(flat, kind="stable")  # of equal windows, the least coordinate comes first
        flat, owner, step, prev, following = flat[order], owner[order], step[order], prev[order], following[order]
        begins = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
        least = run["id"][owner[begins]]
        repeated = np.logical_or.reduceat(run["several"][owner].astype(bool), begins) | (np.maximum.reduceat(run["id"][owner], begins) != least)
        only = lambda x: np.where(np.minimum.reduceat(x, begins) == np.maximum.reduceat(x, begins), x[begins], np.uint64(0))[repeated]
        edge, before, after = flat[begins][repeated], only(prev), only(following)
        if not len(edge):
            return
        at_row = row[owner[begins]][repeated]
        at_word = (run["word"][owner[begins]].astype(np.int64) + step[begins])[repeated]
        least = least[repeated]
        by_source = np.lexsort((at_word, at_row))  # joined edges stand next to each other
        a, b = by_source[:-1], by_source[1:]
        joined = np.r_[False, (after[a] == edge[b]) & (before[b] == edge[a]) & (at_row[a] == at_row[b]) & (at_word[a] + 1 == at_word[b])]
        starts = np.flatnonzero(~joined)
        heads = by_source[starts]
        sizes = np.diff(np.r_[starts, len(by_source)])
        tails = by_source[starts + sizes - 1]
        signed = lambda x: x.view(np.int64)
        columns = [np.zeros(len(heads), np.int32), signed(edge[heads]), at_row[heads], at_word[heads], signed(before[heads]), signed(edge[tails]), signed(after[tails]), sizes, least[heads]]
        for k in range(0, len(heads), 100_000):
            part = [c[k : k + 100_000] for c in columns]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(part, schema.types, strict=False)), pa.nulls(len(part[0]), pa.int64())], schema=schema)
        number_of = np.full(len(begins), -1, np.int64)  # of each distinct window: its piece, if it is the head
        number_of[np.flatnonzero(repeated)[heads]] = np.arange(len(heads))
        piece = np.repeat(number_of, np.diff(np.r_[begins, len(flat)]))
        piece, number = piece[piece >= 0], run["number"][owner[piece >= 0]]
        order = np.lexsort((number, piece))
        piece, number = piece[order], number[order]
        fresh = np.r_[True, (piece[1:] != piece[:-1]) | (number[1:] != number[:-1])]
        piece, number = piece[fresh], number[fresh]
        for k in range(0, len(piece), 100_000):
            p, m = piece[k : k + 100_000], number[k : k + 100_000]
            h = heads[p]
            none = pa.nulls(len(p), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(p), np.int32)), pa.array(signed(edge[h])), pa.array(at_row[h]), pa.array(at_word[h]), none, none, none, none, none, pa.array(m)], schema=schema)

    return run


def paths(pieces: DataFrame) -> DataFrame:
    """(row, word, head, n, id) of the compacted paths: pieces glued where no occurrence tells them apart, a cell of a document at most."""
    tails = pieces.where("after <> 0").select(F.col("after").alias("head"), F.col("tail").alias("before"), "row", (F.col("word") + F.col("n")).alias("word"), F.lit(True).alias("glued"))
    glued = pieces.join(tails.hint("merge"), ["row", "word", "head", "before"], "left").withColumn("cell", F.floor(F.col("word") / CELL))
    along = Window.partitionBy("row", "cell").orderBy("word")
    started = glued.withColumn("starts", (F.col("glued").isNull() | F.lag("word").over(along).isNull()).cast("int"))
    named = started.withColumn("path", F.sum("starts").over(along))
    return named.groupBy("row", "cell", "path").agg(F.min("word").alias("word"), F.min_by("head", "word").alias("head"), F.sum("n").alias("n"), F.min("id").alias("id")).select("row", "word", "head", "n", "id")


def _gathered(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows of each block behind a row with the block's file, a block after the other."""
    both = manifest.select("number", "block").unionByName(rows, allowMissingColumns=True)
    return both.repartition(blocks.tasks_for(manifest), "number").sortWithinPartitions("number", F.col("block").asc_nulls_last())


def _by_number(batches):
    """Worker: (file, rows) of each block, the rows as an Arrow table."""
    import pyarrow as pa

    held, current = [], None
    for batch in batches:
        numbers = batch["number"].to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(numbers)) + 1, len(numbers)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i == j:
                continue
            if held and numbers[i] != current:
                whole = pa.Table.from_batches(held)
                yield whole["block"][0].as_py(), whole.slice(1)
                held = []
            current = numbers[i]
            held.append(batch.slice(i, j - i))
    if held:
        whole = pa.Table.from_batches(held)
        yield whole["block"][0].as_py(), whole.slice(1)


DIGESTS = "row long, word long, digest binary"


def _verify(length: int, bits: int):
    """Worker: digests of the words of every path's occurrences, each digest once a block."""
    schema = text.arrow_schema(DIGESTS)

    def run(batches):
        import pyarrow as pa

        for uri, told in _by_number(batches):
            if not len(told):
                continue
            held = _Windows(uri, length, bits)
            flat, place = held.normalised()
            row, word, n = (told[c].to_numpy() for c in ("row", "word", "n"))
            which, window = held.occurrences(told["head"].to_numpy().view(np.uint64))
            stop = held.at[window] + n[which] + length - 1
            stop = np.where(stop > held.first_word[held.doc[window] + 1], 0, stop)  # a path cannot leave a document: hashes collide here
            begin, end = place[held.at[window]], place[stop]
            found = {(p, hashlib.blake2b(flat[i:j] if j > i else b"", digest_size=16).digest()) for p, i, j in zip(which.tolist(), begin.tolist(), end.tolist(), strict=True)}
            paths_, digests = [p for p, _ in found], [d for _, d in found]
            yield pa.RecordBatch.from_arrays([pa.array(row[paths_]), pa.array(word[paths_]), pa.array(digests, pa.binary())], schema=schema)

    return run


SINGLES = "number long, at long, id long, digest binary"


def _singly(length: int, bits: int):
    """Worker: every window of the occurrences of paths that did not verify, with a digest of its own."""
    schema = text.arrow_schema(SINGLES)

    def run(batches):
        import pyarrow as pa

        for uri, told in _by_number(batches):
            if not len(told):
                continue
            held = _Windows(uri, length, bits)
            flat, place = held.normalised()
            which, window = held.occurrences(told["head"].to_numpy().view(np.uint64))
            n = told["n"].to_numpy()[which]
            at = _places(held.at[window], n)
            doc = np.repeat(held.doc[window], n)
            inside = at + length <= held.first_word[doc + 1]
            at, first = np.unique(at[inside], return_index=True)
            doc = doc[inside][first]
            number = told["number"][0].as_py()
            for k in range(0, len(at), 20_000):
                some = at[k : k + 20_000]
                digests = [hashlib.blake2b(flat[i:j], digest_size=16).digest() for i, j in zip(place[some].tolist(), place[some + length].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(some), pa.array(held.ids[doc[k : k + 20_000]]), pa.array(digests, pa.binary())], schema=schema)

    return run


REMOVED = "id long, n_words long, n_removed long, kept binary"


def _remove(length: int, bits: int):
    schema = text.arrow_schema(REMOVED)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for uri, told in _by_number(batches):
            held = _Windows(uri, length, bits)
            flat, place = held.normalised()
            change = np.zeros(len(held.begins) + 1, np.int64)
            whole = told.filter(pc.is_valid(told["head"]))
            which, window = held.occurrences(whole["head"].to_numpy().view(np.uint64))
            goes = whole["id"].to_numpy()[which] < held.ids[held.doc[window]]
            at = held.at[window[goes]]
            np.add.at(change, at, 1)
            np.add.at(change, at + whole["n"].to_numpy()[which[goes]] + length - 1, -1)
            alone = told.filter(pc.is_valid(told["at"]))["at"].to_numpy()
            np.add.at(change, alone, 1)
            np.add.at(change, alone + length, -1)
            gone = np.cumsum(change[:-1]) > 0
            n_gone = np.r_[0, np.cumsum(gone)]
            stays = np.frombuffer(flat, np.uint8)[np.repeat(~gone, np.diff(place))].tobytes()
            kept_place = np.r_[0, np.cumsum(np.where(gone, 0, np.diff(place)))][held.first_word]
            n_words, removed = np.diff(held.first_word), np.diff(n_gone[held.first_word])
            for i in range(0, len(held.ids), 2000):
                j = min(i + 2000, len(held.ids))
                kept = [stays[kept_place[k] : max(kept_place[k + 1] - 1, kept_place[k])] for k in range(i, j)]
                ids = held.ids[i:j]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == blocks.NO_ID), pa.array(n_words[i:j]), pa.array(removed[i:j]), pa.array(kept, pa.binary())], schema=schema)

    return run


def remove_repeats(df: DataFrame, length: int = 13, id_name: str = "doc_id", text_name: str = "text", block_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20, hot_blocks: int = HOT_BLOCKS, bits: int = 64) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (words joined by one space, UTF-8).

    ``bits`` of a window's hash name an edge; fewer only make more work for the verification.
    """
    if length < GRAM:
        raise ValueError(f"a window has at least {GRAM} words")
    spark = df.sparkSession
    folder = shared.scratch(spark, "debruijn")
    manifest = shared.written(blocks.numbered(blocks.write(df, folder, id_name, text_name, block_bytes)), f"{folder}/numbered")
    total = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = shared.parts_for(total, bucket_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = blocks.spread(manifest).mapInArrow(shared.tidy(_send_anchors(length, bits, n_buckets)), ANCHORS)
    common = shared.written(sent.repartitionById(n_buckets, "bucket").mapInArrow(shared.tidy(_shared_anchors(hot_blocks)), ANCHORS), f"{folder}/anchors")
    runs = blocks.gathered(common, "bucket", blocks.tasks_for(manifest)).mapInArrow(shared.tidy(_send_runs(length, bits, n_buckets)), RUNS)
    found = runs.repartitionById(n_buckets, "bucket").mapInArrow(shared.tidy(_pieces()), PIECES)
    found.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/pieces")
    found = spark.read.schema(PIECES).parquet(f"{folder}/pieces")
    stands = found.where("kind = 1").select("row", "word", "number")
    told = stands.join(paths(found.where("kind = 0").drop("kind", "number")).hint("merge"), ["row", "word"])
    told = shared.written(told.select("number", "row", "word", "head", "n", "id"), f"{folder}/told")
    digests = _gathered(told, manifest).mapInArrow(shared.tidy(_verify(length, bits)), DIGESTS)
    collided = shared.written(digests.groupBy("row", "word").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("row", "word"), f"{folder}/collided")
    singles = None
    if not collided.isEmpty():
        unsure = told.join(collided.hint("merge"), ["row", "word"], "left_semi")
        each = shared.written(_gathered(unsure.select("number", "head", "n"), manifest).mapInArrow(shared.tidy(_singly(length, bits)), SINGLES), f"{folder}/singles")
        firsts = each.groupBy("digest").agg(F.min("id").alias("first"))
        singles = each.join(firsts.hint("merge"), "digest").where("first < id").select("number", "at")
        told = told.join(collided.hint("merge"), ["row", "word"], "left_anti")
    rows = told.select("number", "head", "n", "id")
    rows = rows.withColumn("at", F.lit(None).cast("long")) if singles is None else rows.unionByName(singles, allowMissingColumns=True)
    return _gathered(rows, manifest).mapInArrow(shared.tidy(_remove(length, bits)), REMOVED).withColumnRenamed("id", id_name)
