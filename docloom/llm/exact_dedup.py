"""Exact dedup with an extendible-hash index on shared files.

1. Texts are normalised (A-Z lower-cased) and hashed in blocks of bounded size.
   A block groups its own equal texts, comparing bytes, so a group of copies of
   any size leaves at most one record per block. The records, texts compressed,
   are written to the shared folder once, under Spark's commit protocol.
2. Owner tasks take ranges of the 64-bit keys. Each keeps an extendible-hash
   index of its range in the shared folder: a directory over the leading key
   bits, which doubles when a full bucket cannot be told apart by the bits in
   use, and one page file per bucket with its texts; a full bucket splits in
   two. Entries of one key are chained and told apart by comparing bytes. Records
   come in the order of their keys, so a task holds a few pages at a time, reads
   and writes each about once, and answers its records from the stored pages.
3. Each record learns its group's kept row and size through an equi-join on
   (block, record): no key there has more than one row, so a group holding a
   third of the table does not meet in one task.

The index outlives its batch: ``exact_groups(more, index=folder)`` opens the
stored directories, splits and rewrites the pages that its records touch, and
answers them with regard to all batches so far. A task reads the directories of
committed batches only and writes files of its own, whose names travel with its
rows; they become the index when all tasks of the batch have succeeded and its
name is put on the list of committed batches. So a task that is lost, repeated
or run twice leaves no trace, and a batch that failed can be run again. As an
index grows it gets more owners, which take their ranges from the old ones.

Cases: null and empty texts are equal to each other; among repeated rows of
the largest id one row stays (which one is not told apart by id); null ids
count as smaller than any other; texts of any length are compared whole; empty
tables give no rows; clashing column names do not matter, since only the id and
text columns are read.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared, text

RECORDS = "block string, rec int, key long, sha string, n_bytes long, body binary, ids array<long>, max_id long, n long"
OWNED = "block string, rec int, keep_id long, group_size long, keep_block string, keep_rec int, owner long, directory string"


class Entry:
    """A distinct text of the index: its bytes, the row that stays and the number of rows."""

    __slots__ = ("block", "body", "max_id", "n", "number", "rec", "size")

    def __init__(self, number: int, size: int, body: bytes, max_id: int | None, block: str, rec: int, n: int):
        self.number, self.size, self.body, self.max_id, self.block, self.rec, self.n = number, size, body, max_id, block, rec, n

    def equals(self, size: int, body: bytes) -> bool:
        import pyarrow as pa

        if self.size != size:
            return False
        return self.body == body or pa.decompress(self.body, size, codec="zstd", asbytes=True) == pa.decompress(body, size, codec="zstd", asbytes=True)

    def joins(self, max_id: int | None, block: str, rec: int, n: int) -> None:
        if max_id is not None and (self.max_id is None or (max_id, block, rec) > (self.max_id, self.block, self.rec)):
            self.max_id, self.block, self.rec = max_id, block, rec
        self.n += n


class Pages:
    """Files of one owner in a shared folder; each version of a page or directory is a file of its own.

    ``batches`` are the (name, owner bits) of the committed batches, the oldest first.
    """

    def __init__(self, folder: str, bits: int, owner: int, batches: list[tuple[str, int]]):
        self.fs, self.root = shared.open_fs(folder)
        self.bits, self.owner, self.batches = bits, owner, batches
        self.path = self._path(bits, owner)
        self.run = uuid.uuid4().hex
        self.n = 0
        self.fs.create_dir(self.path)

    def _path(self, bits: int, owner: int) -> str:
        return f"{self.root}/owner-{bits}-{owner}"

    def _put(self, name: str, rows) -> str:
        with self.fs.open_output_stream(f"{self.root}/{name}") as out:
            out.write(pickle.dumps(rows))
        return name

    def _get(self, name: str):
        with self.fs.open_input_file(f"{self.root}/{name}") as file:
            return pickle.loads(file.read())

    def write(self, held: dict[int, list[Entry]]) -> str:
        self.n += 1
        return self._put(f"owner-{self.bits}-{self.owner}/page-{self.run}-{self.n}", [(key, [[getattr(e, s) for s in Entry.__slots__] for e in chain]) for key, chain in held.items()])

    def read(self, name: str) -> dict[int, list[Entry]]:
        return {key: [Entry(**dict(zip(Entry.__slots__, e, strict=True))) for e in chain] for key, chain in self._get(name)}

    def save(self, state: tuple) -> str:
        """Name of a directory file, which counts once it is published and its batch committed."""
        return self._put(f"owner-{self.bits}-{self.owner}/directory-{self.run}", state)

    def load(self) -> tuple[int, tuple] | None:
        """(owner bits, directory) of the latest committed batch that wrote this range, perhaps as part of a wider one."""
        for bits in range(self.bits, -1, -1):
            path = self._path(bits, self.owner >> self.bits - bits)
            for name, _ in reversed([b for b in self.batches if b[1] == bits]):
                if self.fs.get_file_info(f"{path}/{name}").is_file:
                    with self.fs.open_input_file(f"{path}/{name}") as file:
                        return bits, self._get(file.read().decode())
        return None


def _publish(folder: str, bits: int, batch: str):
    """Worker: point the owners of a batch to their directories; the same files whoever writes them."""

    def run(batches):
        fs, root = shared.open_fs(folder)
        for rows in batches:
            for owner, directory in zip(rows["owner"].to_pylist(), rows["directory"].to_pylist(), strict=True):
                with fs.open_output_stream(f"{root}/owner-{bits}-{owner}/{batch}") as out:
                    out.write(directory.encode())
            yield rows

    return run


def _committed(index: str) -> dict:
    """Batches of an index, the oldest first as (name, owner bits), and the bytes that they held."""
    fs, path = shared.open_fs(index)
    if not fs.get_file_info(f"{path}/committed").is_file:
        return {"batches": [], "n_bytes": 0}
    with fs.open_input_file(f"{path}/committed") as file:
        return json.loads(file.read())


def _commit(index: str, state: dict) -> None:
    """Put the list of batches in place in one step."""
    fs, path = shared.open_fs(index)
    name = f"{path}/committed.{uuid.uuid4().hex}"
    with fs.open_output_stream(name) as out:
        out.write(json.dumps(state).encode())
    fs.move(name, f"{path}/committed")


class ExtendibleHash:
    """Directory over the leading bits of ``width``-bit keys, and buckets of at most ``capacity`` keys.

    At most ``most_held`` buckets are in memory; the others are in their page files.
    """

    def __init__(self, width: int, pages: Pages, capacity: int = 64, most_held: int = 32):
        self.width, self.pages, self.capacity, self.most_held = width, pages, capacity, most_held
        self.depth, self.directory, self.depths, self.files, self.n = 0, [0], [0], [None], 0
        self.held: OrderedDict[int, dict[int, list[Entry]]] = OrderedDict()
        self.changed: set[int] = set()
        stored = pages.load()
        if stored is not None and stored[0] == pages.bits:
            self.depth, self.directory, self.depths, self.files, self.n = stored[1]
        elif stored is not None:  # the range was part of a wider owner's
            low, self.n = pages.owner & (1 << pages.bits - stored[0]) - 1, stored[1][4]
            for name in stored[1][3]:
                for key, chain in pages.read(name).items() if name else ():
                    if key >> width == low:
                        key &= (1 << width) - 1
                        self._room(key)[key] = chain

    def _bucket(self, key: int) -> int:
        return self.directory[key >> self.width - self.depth]

    def _open(self, bucket: int) -> dict[int, list[Entry]]:
        if bucket not in self.held:
            self.held[bucket] = self.pages.read(self.files[bucket]) if self.files[bucket] else {}
            while len(self.held) > self.most_held:
                self._put_away(next(iter(self.held)))
        self.held.move_to_end(bucket)
        return self.held[bucket]

    def _put_away(self, bucket: int) -> None:
        held = self.held.pop(bucket)
        if bucket in self.changed:
            self.files[bucket] = self.pages.write(held)
            self.changed.discard(bucket)

    def chain(self, key: int) -> list[Entry]:
        """Entries under a key, in order of insertion."""
        return self._open(self._bucket(key)).get(key, [])

    def _room(self, key: int) -> dict[int, list[Entry]]:
        """The bucket of a key, with room for it."""
        while True:
            bucket = self._bucket(key)
            held = self._open(bucket)
            if key in held or len(held) < self.capacity or self.depths[bucket] == self.width:
                self.changed.add(bucket)
                return held
            self._split(bucket)

    def add(self, key: int, size: int, body: bytes, max_id: int | None, block: str, rec: int, n: int) -> Entry:
        """The entry of a text; it is made, or the rows join it."""
        held = self._room(key)
        entry = next((e for e in held.get(key, ()) if e.equals(size, body)), None)
        if entry is not None:
            entry.joins(max_id, block, rec, n)
            return entry
        entry = Entry(self.n, size, body, max_id, block, rec, n)
        self.n += 1
        held.setdefault(key, []).append(entry)  # same key, other bytes: the chain grows, splitting cannot help
        return entry

    def _split(self, bucket: int) -> None:
        depth, held = self.depths[bucket], self._open(bucket)
        if depth == self.depth:
            self.directory = [b for b in self.directory for _ in (0, 1)]
            self.depth += 1
        bit = 1 << self.width - depth - 1
        other = len(self.files)
        self.held[bucket] = {k: v for k, v in held.items() if not k & bit}
        self.held[other] = {k: v for k, v in held.items() if k & bit}
        self.depths[bucket] = depth + 1
        self.depths.append(depth + 1)
        self.files.append(None)
        self.changed |= {bucket, other}
        any_key = next(iter(held))
        first = (any_key >> self.width - depth) << self.depth - depth  # the bucket's slots stand together
        half = 1 << self.depth - depth - 1
        self.directory[first + half : first + 2 * half] = [other] * half

    def save(self) -> str:
        for bucket in list(self.held):
            self._put_away(bucket)
        return self.pages.save((self.depth, self.directory, self.depths, self.files, self.n))


def _records(block_bytes: int, id_name: str, text_name: str, batch: str):
    """Worker: one record per distinct normalised text of a block."""
    schema = text.arrow_schema(RECORDS)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for at, table in enumerate(text.blocks(batches, block_bytes, text_name)):
            ids = table[id_name].to_pylist()
            groups: dict[bytes, list] = {}
            for doc_id, body in zip(ids, table[text_name].cast(pa.large_binary()).to_pylist(), strict=True):
                groups.setdefault((body or b"").lower(), []).append(doc_id)  # dict keys compare bytes
            rows = []
            for rec, (body, members) in enumerate(groups.items()):
                digest = hashlib.sha256(body)
                key = int.from_bytes(digest.digest()[:8], "little", signed=True)
                rows.append((f"{batch}-{part}-{at}", rec, key, digest.hexdigest(), len(body), pa.compress(body, codec="zstd", asbytes=True), members, max((m for m in members if m is not None), default=None), len(members)))
                if len(rows) == 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)

    return run


def _own(folder: str, capacity: int, owner_bits: int, committed: list[tuple[str, int]]):
    """Worker: put the records of a key range into its index, then answer each from the stored pages."""
    schema = text.arrow_schema(OWNED)
    width = 64 - owner_bits

    def run(batches):
        import pyarrow as pa

        index, where = None, []
        for batch in batches:
            for block, rec, key, size, body, max_id, n in zip(*(batch.column(c).to_pylist() for c in ("block", "rec", "key", "n_bytes", "body", "max_id", "n")), strict=True):
                if index is None:
                    index = ExtendibleHash(width, Pages(folder, owner_bits, (key & (1 << 64) - 1) >> width, committed), capacity)
                key &= (1 << width) - 1  # the range's common leading bits tell nothing
                where.append((block, rec, key, index.add(key, size, body, max_id, block, rec, n).number))
        if index is None:
            return
        directory = index.save()
        for start in range(0, len(where), 5000):
            rows = []
            for block, rec, key, number in where[start : start + 5000]:
                e = next(e for e in index.chain(key) if e.number == number)
                rows.append((block, rec, e.max_id, e.n, e.block, e.rec, index.pages.owner, directory))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types, strict=True)], schema=schema)

    return run


def exact_groups(df: DataFrame, id_name: str = "doc_id", text_name: str = "text", block_bytes: int = 16 << 20, owner_bytes: int = 48 << 20, capacity: int = 64, index: str | None = None, batch: str = "0") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``index`` is the folder of an index to open or make; without it, one is made
    for this table alone. Ids and sizes then count all batches of the index, and a
    row that an earlier ``batch`` (each has a name of its own) holds is not among
    those kept.
    """
    spark = df.sparkSession
    folder = shared.scratch(spark, "exact")
    shared.bound_batches(spark)
    docs = df.select(F.col(id_name).cast("long").alias(id_name), F.col(text_name))
    records = shared.written(docs.mapInArrow(shared.tidy(_records(block_bytes, id_name, text_name, batch)), RECORDS), f"{folder}/records")
    total = records.agg(F.sum("n_bytes")).first()[0] or 0
    wanted = shared.parts_for(total, owner_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    where = shared.make(spark, index or f"{folder}/index")
    state = _committed(where)
    wanted = max(wanted, shared.parts_for(state["n_bytes"] + total, owner_bytes, 1))
    bits = max([1, (wanted - 1).bit_length(), *(b for _, b in state["batches"])])
    owner = F.shiftrightunsigned(F.col("key"), 64 - bits).cast("int")  # a range of keys each
    lean = shared.written(records.select("block", "rec", "sha", "ids"), f"{folder}/members")
    dealt = records.select("block", "rec", "key", "n_bytes", "body", "max_id", "n").repartitionById(1 << bits, owner).sortWithinPartitions("key")
    owned = shared.written(dealt.mapInArrow(shared.tidy(_own(where, capacity, bits, state["batches"])), OWNED), f"{folder}/owned")
    shared.remove(spark, f"{folder}/records")  # the texts are not needed any more
    if index is None:
        shared.remove(spark, where)
    else:
        name = uuid.uuid4().hex
        owned.select("owner", "directory").distinct().mapInArrow(_publish(where, bits, name), "owner long, directory string").write.format("noop").mode("overwrite").save()
        _commit(where, {"batches": [*state["batches"], (name, bits)], "n_bytes": state["n_bytes"] + total})
    joined = lean.join(owned.drop("owner", "directory").hint("merge"), ["block", "rec"])
    first = F.array_position("ids", F.col("keep_id"))
    rows = joined.select(
        "sha", "keep_id", "group_size", F.posexplode("ids").alias("__at", id_name),
        F.when((F.col("keep_block") == F.col("block")) & (F.col("keep_rec") == F.col("rec")), F.coalesce(first, F.lit(1)) - 1).otherwise(F.lit(-1)).alias("__keep"),
    )
    return rows.select(id_name, "keep_id", F.col("group_size"), (F.col("__at") == F.col("__keep")).alias("kept"), F.col("sha").alias("text_sha256"))

