"""N-gram Jaccard join by universe partition and pigeonhole, exact for components.

Every document is the set of its distinct word n-grams (64-bit hashes; equal
sets share a 128-bit key). Sizes fall into bands so narrow that the larger set
of a similar pair is in the smaller one's band or the next. Each band fixes a
scheme: the most by which similar sets may differ (H), and a cut of the hash
universe into m segments. H differences cannot touch all segments, so similar
sets agree on one:

- exact allocation: m > H segments, one signature for each segment's subset;
- one-deletion allocation: m > H / 2 segments, signatures of each subset and of
  all subsets with one element less, which also find segments one apart.

A cost model takes the allocation and m with the fewest signatures that still
leave spare segments and, with a probability over 0.9999, are not too often
empty (an empty subset has no signature, as it would be everyone's). Sets below
that margin also carry one signature of the scheme for all of them.

Signatures meet in range buckets, which see how common each one is. The spare
segments pay for skipping common ones: similar sets agree on more segments than
H touches, so a set whose common and empty segments fit into the spare needs
none of them. Only sets that exceed it meet under common signatures, too; two
such sets are the only pairs that could be missed otherwise.

To keep groups linear, a few star rounds verify each member only against one
set of its group, the one that is in most groups, then the next one; the links
give components, and only groups that are still split go on. What is left then
are pairs of one group in different components, taken in chunks of bounded
size; sizes and the parity of hashed shingles rule out nearly all of them (both
are lower bounds of the difference), the rest is verified. A pair inside one component needs no check,
so the components are exact. Verification computes both sets again from the
whole texts.

Cases: null and empty texts have no shingles and no links; with fewer words
than n the whole sequence is the one shingle; repeated rows link to each other;
ids may be null or repeat; texts may be of any length (a task holds one, and
about 30 bytes for each of its bytes, half a megabyte at a time if they are
short); empty tables give no rows; only the id and text columns are read, so
names cannot clash.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import blocks, components, shared, text

#: Bits of a document's place in its block; the rest of a node is the block's number, so 2**32 blocks have nodes of their own.
PLACE = 31

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD1B54A32D192ED03, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; A-Z are lower-cased, words end at \\x20 and \\x09-\\x0D."""
    n_texts = len(offsets) - 1
    nothing = np.zeros(0, np.uint64)
    if len(data) == 0:
        return [nothing] * n_texts
    if n > len(_ODD):
        raise ValueError("n-grams of at most 8 words")
    capital = (data >= 65) & (data <= 90)
    low = data + capital.astype(np.uint8) * np.uint8(32)
    inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    opens[begins] = inside[begins]
    start = np.flatnonzero(opens)
    if len(start) == 0:
        return [nothing] * n_texts
    number = np.cumsum(opens) - 1
    place = np.arange(len(low)) - start[np.maximum(number, 0)]
    marks = text.mix64((low.astype(np.uint64) + np.uint64(1)) * _ODD[0] + place.astype(np.uint64) * _ODD[1])
    marks[~inside] = 0
    word = text.mix64(np.add.reduceat(marks, start))
    text_of = np.searchsorted(offsets, start, side="right") - 1
    counts = np.bincount(text_of, minlength=n_texts)
    ends = np.cumsum(counts)
    grams = nothing
    if len(word) >= n:
        grams = word[: len(word) - n + 1] * _ODD[0]
        for j in range(1, n):
            grams = grams + word[j : len(word) - n + 1 + j] * _ODD[j]
        grams = text.mix64(grams)
    out = []
    for t in range(n_texts):
        c, e = int(counts[t]), int(ends[t])
        if c >= n:
            out.append(np.unique(grams[e - c : e - n + 1]))
        elif c:
            whole = np.array([int((word[e - c : e] * _ODD[:c]).sum()) & (2**64 - 1)], np.uint64)
            out.append(text.mix64(whole + np.uint64(c)))  # shorter sequences never equal an n-gram
        else:
            out.append(nothing)
    return out


def set_key(values: np.ndarray) -> bytes:
    """128-bit key of a set."""
    a = text.mix64(values * _ODD[2] + _ODD[3]).sum()
    b = text.mix64(values * _ODD[4] + _ODD[5]).sum() + np.uint64(len(values))
    return a.tobytes() + b.tobytes()


class Schemes:
    """Bands of sizes and the allocation of each; ``top / bottom`` is the least similarity."""

    def __init__(self, top: int, bottom: int, spare: float = 0.4):
        if not 0 < 2 * top or not bottom / 2 < top <= bottom:
            raise ValueError("similarity must be over 0.5 and at most 1")
        self.top, self.bottom, self.spare = top, bottom, spare
        self.ends: list[int] = []
        self.known: dict[int, tuple[int, int, bool]] = {}

    def most(self, size: int) -> int:
        """Largest partner of a set of this size."""
        return size * self.bottom // self.top

    def band(self, size: int) -> int:
        while not self.ends or self.ends[-1] < size:
            least = self.ends[-1] + 1 if self.ends else 1
            self.ends.append(max(least, self.most(least)))
        return int(np.searchsorted(self.ends, size))

    def scheme(self, band: int) -> tuple[int, int, bool]:
        """(segments, segments that may be bad, one-deletion) of a band."""
        if band not in self.known:
            self.known[band] = self._allocate(band)
        return self.known[band]

    def _allocate(self, band: int) -> tuple[int, int, bool]:
        self.band(1)
        while len(self.ends) <= band:
            self.band(self.ends[-1] + 1)
        least, most = (self.ends[band - 1] + 1 if band else 1), self.ends[band]
        apart = (most + self.most(most)) * (self.bottom - self.top) // (self.bottom + self.top)
        best = None
        for deletion in (False, True):
            bad = apart // 2 if deletion else apart
            for m in range(bad + 1 + int(self.spare * bad), 3 * bad + 40):
                empty = (1 - 1 / m) ** least
                if deletion and m > 1:
                    empty += least / m * (1 - 1 / m) ** (least - 1)
                elif m == 1:
                    empty = 1.0 if deletion and least == 1 else 0.0
                if self._tail(m, empty, m - bad) > 1e-4:
                    continue
                price = most + m if deletion else m
                if best is None or price < best[0]:
                    best = (price, m, bad, deletion)
                break
        if best is None:
            best = (0, apart + 1, apart, False)
        return best[1:]

    @staticmethod
    def _tail(m: int, p: float, k: int) -> float:
        """Chance of k or more empty segments among m."""
        if p <= 0:
            return 0.0
        if p >= 1:
            return 1.0
        if m > 400:  # Poisson
            term, total = float(np.exp(-m * p)), 0.0
            for i in range(k):
                total += term
                term *= m * p / (i + 1)
            return max(0.0, 1 - total)
        return max(0.0, 1 - sum(comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k)))

    def signatures(self, values: np.ndarray) -> np.ndarray:
        """48-bit signatures of a set under its band's scheme and, if it can be the larger one of a pair, the band
        before's; the lowest bit tells the two apart."""
        band = self.band(len(values))
        out = [self._under(values, band)[0]]
        if self._reaches(len(values), band):
            out.append(self._under(values, band - 1)[0])
        return np.unique(np.concatenate(out))

    def allowances(self, values: np.ndarray) -> tuple[int, int, int]:
        """(lowest bit of the own scheme, common segments that may be skipped in it, in the one before)."""
        band = self.band(len(values))
        before = self._under(values, band - 1)[1] if self._reaches(len(values), band) else 0
        return band & 1, self._under(values, band)[1], before

    def _reaches(self, size: int, band: int) -> bool:
        return band > 0 and self.most(self.ends[band - 1]) >= size

    def _under(self, values: np.ndarray, band: int) -> tuple[np.ndarray, int]:
        m, bad, deletion = self.scheme(band)
        segment = ((values >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # ascending, as the values are
        marks = text.mix64(values * _ODD[6] + np.uint64(band))
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        sums = np.add.reduceat(marks, first)
        held, counts = segment[first], np.diff(np.r_[first, len(values)])
        places = (np.uint64(band) << np.uint64(32)) + held.astype(np.uint64) * np.uint64(2)
        good = counts > 1 if deletion and m > 1 else counts > 0
        found = [text.mix64(sums[good] + places[good] * _ODD[7])]
        if deletion:
            less = np.repeat(sums, counts) - marks
            keep = np.repeat(good & (counts > 1), counts)
            found.append(text.mix64(less[keep] + np.repeat(places, counts)[keep] * _ODD[7]))
        spare = int(good.sum()) - bad - 1  # good segments that may be skipped
        if spare < 0:
            found.append(text.mix64(np.array([(band << 32) + 1], np.uint64) * _ODD[7]))
        return np.concatenate(found) >> np.uint64(16) & ~np.uint64(1) | np.uint64(band & 1), spare


SKETCH_BITS = 1024


def sketch(values: np.ndarray) -> bytes:
    """Parity of the shingles in each of 1024 cells: two sketches differ in no more bits than the sets in elements."""
    return np.packbits(np.bincount((values >> np.uint64(20) & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def _pieces(uri: str, n: int, piece: int = 1 << 19):
    """(index, id, text bytes view, set) of each document of a block."""
    ids, data, offsets = blocks.read(uri)
    start = 0
    while start < len(ids):
        stop = min(len(ids), max(start + 1, int(np.searchsorted(offsets, offsets[start] + piece, side="right")) - 1))
        low = int(offsets[start])
        for i, values in enumerate(shingles(data[low : int(offsets[stop])], offsets[start : stop + 1] - low, n), start):
            yield i, int(ids[i]), data[int(offsets[i]) : int(offsets[i + 1])], values
        start = stop


DOCS = "id long, text_hash long, n_shingles long, key binary, node long, first boolean, side int, spare long, spare_before long, sketch binary"


def _describe(n: int, top: int, bottom: int):
    """Worker: one row per document; ``node`` numbers the first of its block with the same set."""
    schema = text.arrow_schema(DOCS)

    def run(batches):
        import pyarrow as pa
        import xxhash

        schemes = Schemes(top, bottom)
        for batch in batches:
            for uri, number in zip(batch["block"].to_pylist(), batch["number"].to_pylist(), strict=True):
                seen: dict[bytes, int] = {}
                rows = []
                for i, doc_id, body, values in _pieces(uri, n):
                    key = set_key(values) if len(values) else None
                    first = seen.setdefault(key, i) if key else i
                    digest = xxhash.xxh64_intdigest(body, 42)
                    more = (*schemes.allowances(values), sketch(values)) if key and first == i else (None, None, None, None)
                    rows.append((None if doc_id == blocks.NO_ID else doc_id, digest - (digest >> 63 << 64), len(values), key, number << PLACE | first, first == i, *more))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)

    return run


def _sign(n: int, top: int, bottom: int, n_buckets: int, common: int):
    """Worker: a block's signatures with their nodes, one row per bucket.

    A signature that more than ``common`` sets of the block have is common
    without being met: its nodes go on by themselves (bucket -1), and its bucket
    gets ``common + 1`` of them, so that it counts as common there, too. A bucket
    thus gets a bounded number of rows of a signature from each block.
    """

    def run(batches):
        schemes = Schemes(top, bottom)
        cuts = np.array([(i << 48) // n_buckets for i in range(1, n_buckets)], np.uint64)
        for batch in batches:
            for uri, number in zip(batch["block"].to_pylist(), batch["number"].to_pylist(), strict=True):
                seen: set[bytes] = set()
                signs, owners = [], []
                for i, _, _, values in _pieces(uri, n):
                    if len(values) and (key := set_key(values)) not in seen:
                        seen.add(key)
                        some = schemes.signatures(values)
                        signs.append(some)
                        owners.append(np.full(len(some), i, np.uint32))
                if not signs:
                    continue
                flat, own = np.concatenate(signs), np.concatenate(owners)
                order = np.argsort(flat, kind="stable")
                flat, own = flat[order], own[order]
                begins = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
                size = np.diff(np.r_[begins, len(flat)])
                rest = np.arange(len(flat)) - np.repeat(begins, size) > common
                if rest.any():
                    yield _packed(-1, number, flat[rest], own[rest])
                    flat, own = flat[~rest], own[~rest]
                edges = np.r_[0, np.searchsorted(flat, cuts), len(flat)]
                for b in range(n_buckets):
                    i, j = edges[b], edges[b + 1]
                    if i < j:
                        yield _packed(b, number, flat[i:j], own[i:j])

    return run


SIGNED = "bucket int, number long, signs binary, owners binary"


def _packed(bucket: int, number: int, signs: np.ndarray, owners: np.ndarray):
    """A row of signatures in 6 bytes each, with their owners in 2 or 4."""
    import pyarrow as pa

    six = signs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    own = owners.astype(np.uint16 if owners.max() < 1 << 16 else np.uint32).tobytes()
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([number], pa.int64()), pa.array([six], pa.binary()), pa.array([own], pa.binary())], ["bucket", "number", "signs", "owners"])


def _plain(batches):
    """Worker: (sign, node) rows of packed ones, some at a time."""
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            signs, nodes = _unpack(row)
            for at in range(0, len(signs), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(signs[at : at + 50_000].astype(np.int64)), pa.array(nodes[at : at + 50_000])], ["sign", "node"])


GROUPS = "nodes array<long>, sign long, node long"


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    n = len(row["signs"]) // 6
    signs = np.zeros((n, 8), np.uint8)
    signs[:, :6] = np.frombuffer(row["signs"], np.uint8).reshape(n, 6)
    owners = np.frombuffer(row["owners"], np.uint16 if len(row["owners"]) == 2 * n else np.uint32)
    return signs.view("<u8").ravel(), owners.astype(np.int64) | row["number"] << PLACE


def _groups(common: int):
    """Worker, for one bucket: distinct lists of at most ``common`` nodes that share a signature; (sign, node) rows of commoner ones."""
    schema = text.arrow_schema(GROUPS)

    def run(batches):
        import pyarrow as pa

        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        parts = [_unpack(r) for r in rows]
        del rows
        signs, nodes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        del parts
        order = np.argsort(signs, kind="stable")
        signs, nodes = signs[order], nodes[order]
        equal = signs[1:] == signs[:-1]
        keep = np.zeros(len(signs), bool)
        keep[1:] |= equal
        keep[:-1] |= equal
        signs, nodes = signs[keep], nodes[keep]
        if len(signs) == 0:
            return
        order = np.lexsort((nodes, signs))
        signs, nodes = signs[order], nodes[order]
        begins = np.flatnonzero(np.r_[True, signs[1:] != signs[:-1]])
        size = np.diff(np.r_[begins, len(signs)])
        many = np.repeat(size > common, size)
        heavy_signs, heavy_nodes = signs[many].astype(np.int64), nodes[many]
        for at in range(0, len(heavy_signs), 50_000):
            some = slice(at, at + 50_000)
            n = len(heavy_signs[some])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, schema.types[0]), pa.array(heavy_signs[some]), pa.array(heavy_nodes[some])], schema=schema)
        seen: set[bytes] = set()
        out: list[np.ndarray] = []
        for i, n in zip(begins[size <= common].tolist(), size[size <= common].tolist(), strict=True):
            mark = nodes[i : i + n].tobytes()
            if mark not in seen:
                seen.add(mark)
                out.append(nodes[i : i + n])
            if len(out) == 5000:
                yield _listed(out, schema)
                out = []
        if out:
            yield _listed(out, schema)

    return run


def _listed(lists: list[np.ndarray], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(lists, schema.types[0]), pa.nulls(len(lists), pa.int64()), pa.nulls(len(lists), pa.int64())], schema=schema)


def _fetch(n: int):
    """Worker: (lead, slice, node, raw, body) for rows (lead, slice, node) of each block, those of a node together; a text is compressed once."""
    schema = text.arrow_schema(TEXTS)

    def run(batches):
        import pyarrow as pa

        block, node, held, size = None, None, [], 0
        for batch in batches:
            for uri, lead, slice_, at in zip(*(batch[c].to_pylist() for c in ("block", "lead", "slice", "node")), strict=True):
                if uri != block:
                    block, (_, data, offsets) = uri, blocks.read(uri)
                if at != node:
                    node, i = at, at & (1 << PLACE) - 1
                    plain = data[int(offsets[i]) : int(offsets[i + 1])].tobytes()
                    body = pa.compress(plain, codec="zstd", asbytes=True)
                held.append((lead, slice_, node, len(plain), body))
                size += len(body)
                if size >= shared.BATCH_BYTES:
                    yield _texts(held, schema)
                    held, size = [], 0
        if held:
            yield _texts(held, schema)

    return run


TEXTS = "lead long, slice long, node long, raw long, body binary"


def _texts(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _verify(n: int, top: int, bottom: int):
    """Worker: rows of a slice stand together, its centre first; links between the centre and the similar ones of the others."""

    def run(batches):
        import pyarrow as pa

        def unpack(raw, body):
            data = np.frombuffer(pa.decompress(body, raw, codec="zstd", asbytes=True), np.uint8)
            return shingles(data, np.array([0, len(data)]), n)[0]

        centre, held = None, None
        for batch in batches:
            links = []
            for lead, node, raw, body in zip(*(batch.column(c).to_pylist() for c in ("lead", "node", "raw", "body")), strict=True):
                if node == lead:
                    if lead != centre:
                        centre, held = lead, unpack(raw, body)
                    continue
                other = unpack(raw, body)
                small, large = (held, other) if len(held) <= len(other) else (other, held)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                if bottom * both >= top * (len(held) + len(other) - both):
                    links.append((max(lead, node), min(lead, node)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

    return run


def _across(top: int, bottom: int):
    """Worker: pairs of different components from two chunks of a group that sizes and sketches do not rule out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for low, high, members in zip(batch["low"].to_pylist(), batch["high"].to_pylist(), batch["members"].to_pylist(), strict=True):
                node, part, chunk, size = (np.array([m[c] for m in members]) for c in ("node", "component", "chunk", "n"))
                bits = np.frombuffer(b"".join(m["sketch"] for m in members), np.uint64).reshape(len(members), -1)
                us, vs = [], []
                for i in range(len(node)):
                    if low == high:
                        other = np.arange(i + 1, len(node))
                    elif chunk[i] == low:
                        other = np.flatnonzero(chunk == high)
                    else:
                        continue
                    other = other[part[other] != part[i]]
                    most = (size[other] + size[i]) * (bottom - top) // (bottom + top)  # elements in which similar sets differ at most
                    apart = np.maximum(np.abs(size[other] - size[i]), np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1))
                    other = other[apart <= most]
                    us.append(np.maximum(node[other], node[i]))
                    vs.append(np.minimum(node[other], node[i]))
                if us:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


#: A component of more than one in LARGE of all distinct sets is large; there are fewer than LARGE such.
LARGE = 1000
#: Sets that are compared with one centre in one slice, at least; all pairs over LARGE if that is more.
SLICE = 256


def _verified(pairs: DataFrame, manifest: DataFrame, tasks: int, folder: str, n: int, top: int, bottom: int) -> DataFrame:
    """Links among candidate pairs (lead, node).

    The pairs of a large centre are dealt over slices; its text goes once to each
    slice, not to each pair, and no task has all pairs of it.
    """
    sizes = shared.written(pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("n")), f"{folder}/sizes")
    most = max(SLICE, (sizes.agg(F.sum("n")).first()[0] or 0) // LARGE)
    large = F.broadcast(sizes.where(F.col("n") > most).select("lead", F.ceil(F.col("n") / most).alias("slices")))  # fewer than LARGE rows
    place = lambda at: F.when(F.col("slices").isNull(), F.lit(0).cast("long")).otherwise(at)
    sliced = pairs.join(large, "lead", "left").select("lead", place(F.pmod(F.xxhash64("node"), F.col("slices"))).alias("slice"), "node")
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1)) - 1)
    centres = sizes.join(large, "lead", "left").select("lead", F.explode(every).alias("slice"), F.col("lead").alias("node"))
    # texts go from their blocks to their slices at once, and lie nowhere in between
    rows = sliced.unionByName(centres).withColumn("number", F.shiftright("node", PLACE)).join(manifest.select("block", "number"), "number").select("block", "lead", "slice", "node")
    texts = blocks.gathered(rows, "node", tasks).mapInArrow(shared.tidy(_fetch(n)), TEXTS)
    both = texts.repartition("lead", "slice").sortWithinPartitions("lead", "slice", F.col("node") != F.col("lead"))
    return shared.written(both.select("lead", "node", "raw", "body").mapInArrow(shared.tidy(_verify(n, top, bottom)), "u long, v long"), f"{folder}/links")


def jaccard_components(df: DataFrame, n: int = 5, top: int = 80, bottom: int = 100, id_name: str = "doc_id", text_name: str = "text", block_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20, common: int = 64, chunk: int = 1024, stars: int = 2) -> DataFrame:
    """One row per document: id, text_hash, n_shingles, component_id (least id of its component), first (one row of each component)."""
    spark = df.sparkSession
    folder = shared.scratch(spark, "ngram")
    manifest = blocks.write(df, folder, id_name, text_name, block_bytes)
    numbered = shared.written(blocks.numbered(manifest), f"{folder}/numbered")
    total, tasks = manifest.agg(F.sum("n_bytes")).first()[0] or 0, blocks.tasks_for(numbered)
    docs = shared.written(blocks.spread(numbered).mapInArrow(shared.tidy(_describe(n, top, bottom)), DOCS), f"{folder}/docs")
    n_buckets = shared.parts_for(total, bucket_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    signed = shared.written(blocks.spread(numbered).mapInArrow(shared.tidy(_sign(n, top, bottom, n_buckets, common)), SIGNED), f"{folder}/signed")
    groups = shared.written(signed.where("bucket >= 0").repartitionById(n_buckets, "bucket").mapInArrow(shared.tidy(_groups(common)), GROUPS), f"{folder}/groups")
    beyond = shared.written(signed.where("bucket < 0").repartition("number").mapInArrow(shared.tidy(_plain), "sign long, node long"), f"{folder}/beyond")
    shared.remove(spark, f"{folder}/signed")
    sets = docs.where("first and key is not null")
    # nodes that meet under common signatures as well: those with more of them than their scheme can spare
    heavy = groups.where("sign is not null").select("sign", "node").unionByName(beyond).withColumn("side", (F.col("sign") % 2).cast("int"))
    held = heavy.groupBy("node", "side").agg(F.count(F.lit(1)).alias("n_heavy"))
    spare = sets.select("node", F.col("side").alias("own"), "spare", "spare_before")
    over = held.join(spare.hint("merge"), "node").where(F.col("n_heavy") > F.when(F.col("side") == F.col("own"), F.col("spare")).otherwise(F.col("spare_before"))).select("node", "side")
    kept = heavy.join(over.hint("merge"), ["node", "side"]).select(F.xxhash64("sign", F.lit("common")).alias("group"), "node")
    listed = groups.where("nodes is not null").withColumn("group", F.xxhash64("nodes")).select("group", F.explode("nodes").alias("node")).unionByName(kept)
    # equal sets of different blocks become one node
    heads = sets.groupBy("key").agg(F.min("node").alias("head"))
    head_of = shared.written(sets.join(heads.hint("merge"), "key").select("node", "head"), f"{folder}/heads")
    members = shared.written(listed.join(head_of.hint("merge"), "node").select("group", F.col("head").alias("node")).distinct(), f"{folder}/members")
    # stars: each member against the set of its group that is in most groups, then against the next, where the group is still split
    central = members.groupBy("node").agg(F.count(F.lit(1)).alias("n_groups"))
    ranked = members.join(central.hint("merge"), "node").select("group", "node", F.struct("n_groups", -F.col("node")).alias("rank"))
    links, parts, tried, led = None, None, None, None
    for turn in range(stars):
        where = f"{folder}/star-{turn}"
        rows = ranked
        if turn:
            labelled = ranked.join(parts.hint("merge"), "node", "left").select("group", "node", "rank", F.coalesce("component", "node").alias("component"))
            open_ = labelled.groupBy("group").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("group")
            rows = labelled.join(open_.hint("merge"), "group")
        free = rows.join(led.hint("merge"), ["group", "node"], "left_anti") if turn else rows
        lead = free.groupBy("group").agg(F.max("rank").alias("rank")).select("group", (-F.col("rank.col2")).alias("lead"))
        pairs = rows.join(lead.hint("merge"), "group").where("node <> lead")
        if turn:
            of_lead = parts.select(F.col("node").alias("lead"), F.col("component").alias("lead_component"))
            pairs = pairs.join(of_lead.hint("merge"), "lead", "left").where(F.col("component") != F.coalesce("lead_component", "lead"))
        pairs = pairs.select("lead", "node", F.greatest("node", "lead").alias("u"), F.least("node", "lead").alias("v")).dropDuplicates(["u", "v"])
        pairs = shared.written(pairs.join(tried.hint("merge"), ["u", "v"], "left_anti") if turn else pairs, f"{where}/pairs")
        found = _verified(pairs, numbered, tasks, where, n, top, bottom)
        links = links.unionByName(found) if turn else found
        tried = tried.unionByName(pairs.select("u", "v")) if turn else pairs.select("u", "v")
        now = shared.written(lead.select("group", F.col("lead").alias("node")), f"{where}/led")
        led = led.unionByName(now) if turn else now
        parts = components.connected_components(links, where)
    labelled = members.join(parts.hint("merge"), "node", "left").select("group", "node", F.coalesce("component", "node").alias("component"))
    split = labelled.groupBy("group").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("size")).where("a <> b and size > 2")
    split = split.select("group", F.ceil(F.col("size") / chunk).cast("int").alias("chunks"))
    facts = sets.select("node", F.col("n_shingles").alias("n"), "sketch")
    rows = labelled.join(split.hint("merge"), "group").join(facts.hint("merge"), "node").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
    chunked = rows.groupBy("group", "low", "high").agg(F.collect_list(F.struct("node", "component", "chunk", "n", "sketch")).alias("members"))
    rest = chunked.select("low", "high", "members").mapInArrow(shared.tidy(_across(top, bottom)), "u long, v long").distinct().join(tried.hint("merge"), ["u", "v"], "left_anti")
    more = _verified(shared.written(rest.select(F.col("v").alias("lead"), F.col("u").alias("node")), f"{folder}/rest"), numbered, tasks, f"{folder}/two", n, top, bottom)
    parts = components.connected_components(links.unionByName(more), f"{folder}/two")
    for name in ("blocks", "groups", "beyond", "members", "rest"):  # what follows reads none of them
        shared.remove(spark, f"{folder}/{name}")
    # the least row of each node (rows of one block), of each head, of each component: sums all the way, no join by component
    mine = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("text_hash").alias("hash"))
    by_node = docs.where("key is not null").groupBy("node").agg(F.min(mine).alias("pick"), F.min("id").alias("least"))
    of_head = by_node.join(head_of.hint("merge"), "node").groupBy("head").agg(F.min("pick").alias("pick"), F.min("least").alias("least"))
    placed = shared.written(of_head.join(parts.withColumnRenamed("node", "head").hint("merge"), "head", "left"), f"{folder}/placed")
    best = shared.written(placed.where("component is not null").groupBy("component").agg(F.min("pick").alias("pick"), F.min("least").alias("least"), F.count(F.lit(1)).alias("n")), f"{folder}/best")
    heads = placed.count()
    large = best.where(F.col("n") * LARGE > heads).select("component", F.col("pick").alias("large_pick"), F.col("least").alias("large_least"))
    linked = placed.where("component is not null").join(F.broadcast(large), "component", "left")  # fewer than LARGE rows
    known = placed.where("component is null").select("head", "pick", "least")
    known = known.unionByName(linked.where("large_pick is not null").select("head", F.col("large_pick").alias("pick"), F.col("large_least").alias("least")))
    small = linked.where("large_pick is null").select("head", "component").join(best.hint("merge"), "component")  # none has more than one in LARGE of the heads
    known = known.unionByName(small.select("head", "pick", "least"))
    by_place = shared.written(head_of.join(known.hint("merge"), "head").select("node", "pick", "least"), f"{folder}/by-place")
    out = docs.select("id", "text_hash", "n_shingles", "node", "key").join(by_place.hint("merge"), "node", "left")
    alone = F.col("key").isNull()
    return out.select(
        F.col("id").alias(id_name), "text_hash", "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("least")).alias("component_id"),
        (alone | mine.eqNullSafe(F.col("pick"))).alias("first"),
    )
