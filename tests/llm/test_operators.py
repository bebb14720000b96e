"""Operators 1 to 10 against brute force, on odd rows and on the small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import blocks, bpe, components, exact_dedup, fingerprints, html_extraction, mixing, ngram_join, queries, sharding, suffix_dedup, token_counts, toxicity
from tests import oracle

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
EXTRA = ("block", "rec", "key", "n", "ids", "id", "node", "first", "score", "tokens", "rate", "topic", "text_hash", "n_tokens", "bucket", "part")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeats and near copies."""
    rng = random.Random(11)
    base = sentence(rng, 120)
    shared = sentence(rng, 60)
    rows = [(1, "Hello World"), (2, None), (3, ""), (4, "hello world"), (4, "HELLO world"), (None, "lone text"), (None, None), (5, "  \t\n "), (6, "one two three"), (7, "One Two\tThree"), (1, "Hello World")]
    rows += [(10, base), (11, base.replace("alpha", "omega", 1)), (12, base + " tail"), (13, base.upper()), (14, sentence(rng, 3000) + shared), (15, shared + sentence(rng, 80)), (16, "naïve café " + shared), (17, "a" * 5000), (18, "ab" * 400), (19, "é" * 90)]
    rows += [(100 + i, sentence(rng, rng.randrange(1, 60))) for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)
    for i, name in enumerate(EXTRA):
        df = df.withColumn(name, F.lit(i).cast("string"))
    return df.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).otherwise("en")).withColumn("source", F.lit("s1"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


def pairs(rows):
    return sorted(rows, key=repr)


# 1 -------------------------------------------------------------------------------------------------------------------------


def test_exact_groups(odd, odd_rows, none):
    groups: dict[bytes, list] = {}
    for i, t in odd_rows:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    want = []
    for body, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(body).hexdigest()) for i in ids]
    got = exact_dedup.exact_groups(odd, block_bytes=2000).collect()
    assert pairs((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == pairs(want)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_groups(none).count() == 0


def test_index_doubles_splits_and_chains(tmp_path):
    rng = random.Random(2)
    keys = [rng.getrandbits(63) for _ in range(3000)]
    body = lambda i: exact_dedup_zstd(str(i).encode())
    pages = exact_dedup.Pages(f"file://{tmp_path}", 1, 0, [])
    index = exact_dedup.ExtendibleHash(63, pages, capacity=4, most_held=3)
    for i, key in enumerate(keys):
        index.add(key, len(str(i)), body(i), i, "b", i, 1)
    index.add(keys[7], 1, body(5), 9999, "c", 0, 1)  # the same key for another text
    index.add(keys[7], 1, body(7), 8888, "d", 0, 5)  # the same text again
    published(tmp_path, 1, {0: index.save()}, "first")
    assert exact_dedup.Pages(f"file://{tmp_path}", 1, 0, []).load() is None  # no committed batch, no index
    again = exact_dedup.ExtendibleHash(63, exact_dedup.Pages(f"file://{tmp_path}", 1, 0, [("first", 1)]), capacity=4, most_held=3)
    assert again.depth >= 9 and len(again.directory) == 1 << again.depth and again.n == 3001
    assert all(len(again._open(b)) <= 4 for b in range(len(again.files)))
    assert len(again.held) == 3
    assert all(again.chain(key)[0].rec == i for i, key in enumerate(keys) if i != 7)
    assert [(e.max_id, e.n, e.block) for e in again.chain(keys[7])] == [(8888, 6, "d"), (9999, 1, "c")]
    assert again.chain(keys[8])[0].max_id == 8 and again.add(123, 1, body(1), None, "e", 0, 1).number == 3001
    parts = [exact_dedup.ExtendibleHash(61, exact_dedup.Pages(f"file://{tmp_path}", 3, owner, [("first", 1)]), capacity=4, most_held=3) for owner in range(4)]
    for i, key in enumerate(keys):  # more owners take the range of one
        assert [e.rec for e in parts[key >> 61].chain(key & (1 << 61) - 1)][0] == (i if i != 7 else 0 if again.chain(key)[0].block == "d" else i)


def test_equal_keys_of_different_texts_stay_apart(spark, tmp_path):
    rows = [("b", 0, 5, 1, exact_dedup_zstd(b"x"), 1, 1), ("b", 1, 5, 1, exact_dedup_zstd(b"y"), 2, 1), ("c", 0, 5, 1, exact_dedup_zstd(b"x"), 3, 1)]
    df = spark.createDataFrame(rows, "block string, rec int, key long, n_bytes long, body binary, max_id long, n long").coalesce(1)
    got = df.mapInArrow(exact_dedup._own(f"file://{tmp_path}", 64, 1, []), exact_dedup.OWNED).collect()
    assert pairs((r.block, r.rec, r.keep_id, r.group_size) for r in got) == [("b", 0, 3, 2), ("b", 1, 2, 1), ("c", 0, 3, 2)]
    assert [p.name for p in tmp_path.iterdir()]


def test_a_second_batch_is_answered_from_the_stored_index(spark, tmp_path):
    """All batches so far count, whatever their sizes; the first index is small and its pages split later."""
    rng = random.Random(31)
    texts = [sentence(rng, 3) for _ in range(700)]
    rows = [(i, rng.choice(texts)) for i in range(2400)]
    seen: dict[str, list[int]] = {}
    for name, some in (("0", rows[:100]), ("1", rows[100:900]), ("2", rows[900:])):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
        got = exact_dedup.exact_groups(df, block_bytes=5000, capacity=4, index=f"file://{tmp_path}/index", batch=name).collect()
        for i, t in some:
            seen.setdefault(t, []).append(i)
        of = dict(some)
        assert len(got) == len(some)
        for r in got:
            ids = seen[of[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), r.doc_id == max(ids))


@pytest.mark.parametrize("times", [1, 3])
def test_repeated_tasks_and_more_owners(spark, tmp_path, monkeypatch, times):
    """Owner tasks that ran before and whose rows were lost, in every batch; each batch has more owners than the one before; a batch that fails is run again."""
    own = exact_dedup._own

    def repeated(*args):
        once = own(*args)

        def run(batches):
            batches = list(batches)
            for _ in range(times - 1):
                list(once(iter(batches)))  # all files are written, no row is seen
            yield from once(iter(batches))

        return run

    monkeypatch.setattr(exact_dedup, "_own", repeated)
    rng = random.Random(8)
    texts = [sentence(rng, 4) for _ in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(900)]
    seen: dict[str, list[int]] = {}
    index = f"file://{tmp_path}/index"
    for name, some, owner_bytes in (("a", rows[:200], 48 << 20), ("b", rows[200:500], 1000), ("c", rows[500:], 300)):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
        groups = lambda: exact_dedup.exact_groups(df, block_bytes=3000, owner_bytes=owner_bytes, capacity=4, index=index, batch=name)  # noqa: B023, E731
        if name == "b":
            with monkeypatch.context() as broken:
                broken.setattr(exact_dedup, "_commit", lambda *a: 1 / 0)
                with pytest.raises(ZeroDivisionError):
                    groups()
        got = groups().collect()
        for i, t in some:
            seen.setdefault(t, []).append(i)
        of = dict(some)
        assert len(got) == len(some)
        assert all((r.keep_id, r.group_size, r.kept) == (max(seen[of[r.doc_id]]), len(seen[of[r.doc_id]]), r.doc_id == max(seen[of[r.doc_id]])) for r in got)
    state = exact_dedup._committed(index)
    assert len(state["batches"]) == 3 and state["batches"][0][1] < state["batches"][1][1] < state["batches"][2][1]


def published(folder, bits, directories, batch):
    import pyarrow as pa

    list(exact_dedup._publish(f"file://{folder}", bits, batch)([pa.RecordBatch.from_pydict({"owner": list(directories), "directory": list(directories.values())})]))


def exact_dedup_zstd(raw):
    import pyarrow as pa

    return pa.compress(raw, codec="zstd", asbytes=True)


# 2 and 4 ---------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return queries._vocabulary()


@pytest.fixture(scope="module")
def reference(vocabulary):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_merges_equal_the_library(vocabulary, reference):
    rng = np.random.default_rng(4)
    texts = ["", "aaa" * 500, "abababab" * 300, "===" * 99 + "----" * 77, "'S 's'll I'm", "\n\n\n  x \t\r\n", "日本語 123", "\U0001f600\U0001f601 ½ ² Ⅷ", "zzzzzzzz yyyyyyyy" * 40]
    texts += ["".join(rng.choice(list("abcdet hion"), 1500)) for _ in range(30)] + ["".join(chr(c) for c in rng.integers(1, 0x2FFF, 300)) for _ in range(30)]
    for text, ids in zip(texts, bpe.encode_block([t.encode() for t in texts], vocabulary), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)


def test_words_forgotten_change_nothing(vocabulary, reference):
    small = bpe.Vocabulary(vocabulary.ranks, vocabulary.pattern, remember=5)
    for text in ("the quick unbelievable foxes", "jumped overwhelmingly far", "the quick unbelievable foxes"):
        assert bpe.encode_block([text.encode()], small)[0].tolist() == reference.encode_ordinary(text)


def test_encode_and_decode(odd, odd_rows, none, vocabulary, reference):
    rows = bpe.decode(bpe.encode(odd, vocabulary, keep=["doc_id"]), vocabulary).collect()
    want = [(i, len(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in odd_rows]
    assert pairs((r.doc_id, r.n_tokens, bytes(r.decoded)) for r in rows) == pairs(want)
    assert bpe.encode(none, vocabulary).count() == 0


def test_separator_scan_over_any_blocks(spark, tmp_path):
    rng = random.Random(6)
    files, want = [], []
    for f in range(4):
        lengths = [rng.choice([0, 1, 5, 300]) for _ in range(30)]
        ids = [x for n in lengths for x in [*(rng.randrange(1, 99) for _ in range(n)), 0]]
        if f == 1:
            ids += [3] * 7  # no separator after the last document
            lengths.append(7)
        if f == 3:
            ids, lengths = [], []
        path = tmp_path / f"{f}.bin"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        files.append((f"file://{path}", 2 * len(ids)))
        want += [(f"file://{path}", i, n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(files, "file string, n_bytes long")
    for block in (2, 14, 200, 1 << 20):
        got = token_counts.separator_counts(df, 0, 2, block).collect()
        assert pairs((r.file, r.ordinal, r.n_tokens) for r in got) == pairs(want)


def test_token_files(odd, odd_rows, none, vocabulary, reference):
    written = token_counts.write_token_files(odd, vocabulary, 50256)
    counts = token_counts.separator_counts(written.where("ordinal = 0").select("file", "n_bytes"), 50256, block_bytes=64)
    rows = written.join(counts, ["file", "ordinal"]).collect()
    assert pairs((r.key, r.n_tokens) for r in rows) == pairs((i, len(reference.encode_ordinary(t or ""))) for i, t in odd_rows)
    assert token_counts.write_token_files(none, vocabulary, 50256).count() == 0


# 3 -------------------------------------------------------------------------------------------------------------------------


def slow_minhash(raw: bytes, slots: int, ell: int) -> list[int]:
    """The definition, one element at a time."""
    mix = lambda x: int(__import__("docloom.llm.text", fromlist=["mix64"]).mix64(np.array([x & (2**64 - 1)], np.uint64))[0])
    if len(raw) < fingerprints.K:
        grams = [int.from_bytes(raw.ljust(8, b"\0"), "little") + (len(raw) + 1 << 56)]
    else:
        grams = [int.from_bytes(raw[i : i + 8], "little") for i in range(len(raw) - 7)]
    seen: dict[int, int] = {}
    elements = []
    for g in map(mix, grams):
        t = seen[g] = seen.get(g, -1) + 1
        elements.append((mix(g + t * 0x9E3779B97F4A7C15) if t else g, g))
    out = []
    for s in range(1, slots + 1):
        factor = mix(s * 0xD1B54A32D192ED03) | 1
        best = sorted((e * factor & (2**64 - 1), i) for i, (e, _) in enumerate(elements))[:ell]
        mark = 0
        places = sorted(i for _, i in best)
        for j in range(ell):
            if j < len(places):
                mark = mark * 0x100000001B3 + elements[places[j]][1] + j
            mark = mix(mark)
        out.append(mark >> 32)
    return out


def test_order_minhash_is_its_definition():
    rng = random.Random(8)
    texts = [b"", b"abc", b"12345678", b"ab" * 60, sentence(rng, 40).encode(), sentence(rng, 90).encode()]
    offsets = np.cumsum([0, *map(len, texts)])
    got = fingerprints.order_minhash(np.frombuffer(b"".join(texts), np.uint8), offsets, 8, 3)
    assert got.tolist() == [slow_minhash(t, 8, 3) for t in texts]
    by_class = fingerprints.order_minhash(np.frombuffer(b"".join(texts), np.uint8), offsets, 8, 3, long=100)
    assert by_class.tolist() == got.tolist()


def test_likeness_falls_with_edits_and_with_moves():
    rng = random.Random(1)
    words = sentence(rng, 300).split()
    moved = words[150:] + words[:150]
    edited = words[:270] + sentence(rng, 30).split()
    other = sentence(rng, 300).split()
    texts = [" ".join(w).encode() for w in (words, words, edited, moved, sorted(words), other)]
    found = fingerprints.order_minhash(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 128)
    same, edit, move, sort, far = (float(fingerprints.likeness(found[:1], found[i : i + 1])[0]) for i in range(1, 6))
    assert same == 1 and 1 > edit > move > sort >= far and edit > 0.6 and far < 0.05


def test_next_rows(spark, none):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 500)
    rows = [(i, f"t{i}", 1) for i in ids] + [(None, f"null{j}", 2) for j in range(120)] + [(77_000, f"hot{j}", 3) for j in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").withColumn("tie", F.xxhash64("text")).repartition(7)
    got = {r.text: r.next_text for r in fingerprints.with_next(df, "doc_id", "tie", ["text"], rows_per_range=16).collect()}
    order = [t for _, _, t in sorted((fingerprints.LEAST if i is None else i, xxhash.xxh64_intdigest(t, seed=42) - (xxhash.xxh64_intdigest(t, seed=42) >> 63 << 64), t) for i, t, _ in rows)]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
    named = df.withColumns({"b": F.lit(1), "ghost": F.lit(2)})
    dealt = fingerprints.with_next(named, "doc_id", "tie", ["text"], rows_per_range=16)
    assert dealt.columns == [*named.columns, "next_text"] and {r.b for r in dealt.collect()} == {1}
    one = spark.createDataFrame([(5, "x", 1)], "doc_id long, text string, tie long")
    assert fingerprints.with_next(one, "doc_id", "tie", ["text"]).first().next_text == "x"
    assert fingerprints.with_next(one.where("1 = 0"), "doc_id", "tie", ["text"]).count() == 0


def test_a_hot_id_fills_many_ranges():
    splits = fingerprints._split_points([3, 7, 7, 7, 7, 9])
    ties = np.random.default_rng(5).integers(-(1 << 63), (1 << 63) - 1, 4000)
    sizes = np.bincount(fingerprints._range_of(splits, np.full(4000, 7), ties))
    assert sizes[sizes > 0].max() < 1400 and (sizes > 0).sum() >= 4


def test_fingerprint_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, sf_dir).collect()}
    for a, b in zip(docs, docs[1:] + docs[:1], strict=True):
        q = len(a.text) // 4
        edited = a.text[: len(a.text) - q] + b.text[:q]
        r = got[a.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(a.text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.25


# 5 -------------------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randrange(20, 80)) + (" you worthless clown " + sentence(rng, 10) if i % 5 == 0 else "")) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows] + [(None, 1), (9999, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, ~queries.held_out())
    scored = toxicity.score(docs, model, ["doc_id"]).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200 and np.mean([(r.score >= 0.3) == (r.doc_id % 5 == 0) for r in held]) > 0.97


def test_toxicity_odd_rows(odd, odd_rows, none, spark):
    one_class = spark.createDataFrame([(10, 0), (14, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd, one_class, F.lit(True))
    got = toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score < 0.3 for r in got)
    assert toxicity.score(none, model, ["doc_id"]).count() == 0
    assert toxicity.learn(none, one_class, F.lit(True)).weights.any() == np.False_


def test_toxicity_query_folds(spark, sf_dir):
    rows = queries.op5_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)


# 6 -------------------------------------------------------------------------------------------------------------------------


def slow_shard(key, weights):
    seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42)
    best = None
    for i, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=seed)
        score = w / -np.log(((h >> 11) + 0.5) / 2**53)
        best = max(best or (score, -i), (score, -i))
    return -best[1]


def test_shards(odd, odd_rows, none):
    weights = [1.0, 2.0, 1.0, 0.5]
    got = sharding.shard_documents(odd, weights).collect()
    assert pairs((r.doc_id, r.size, r.text_crc32) for r in got) == pairs((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert all(r.shard == slow_shard(r.doc_id, weights) and r.grown_shard == slow_shard(r.doc_id, [*weights, 1.0]) for r in got)
    assert all(r.grown_shard in (r.shard, 4) for r in got)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(none, weights).count() == 0


def test_weights_take_their_share(spark):
    rows = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0, 0.0]).alias("s")).groupBy("s").count().collect()
    n = {r.s: r["count"] for r in rows}
    assert set(n) == {0, 1} and abs(n[1] / 20_000 - 0.75) < 0.02


# 7 -------------------------------------------------------------------------------------------------------------------------


def test_raking_meets_marginals(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)), rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", "c"]), rng.choice(["x", "y"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    targets = {"source": {"a": 0.4, "b": 0.3, "c": 0.3}, "lang": {"en": 0.7, "de": 0.3}, "topic": 1.0}
    for most in (100_000, 1):  # on the driver, and by DataFrames
        got = mixing.with_probabilities(df, targets, sweeps=8, most_cells=most)
        mass = {r.source: r.m for r in got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("m")).collect()}
        assert mass["a"] / sum(mass.values()) == pytest.approx(0.4, abs=0.01)
        kept = {r.lang: r.m for r in got.where("selected").groupBy("lang").agg(F.sum("tokens").alias("m")).collect()}
        assert kept["en"] / sum(kept.values()) == pytest.approx(0.7, abs=0.04)
        assert got.agg(F.max("probability")).first()[0] == pytest.approx(1.0)


def test_mixing_odd_rows(odd, odd_rows, none):
    got = mixing.with_probabilities(odd, queries.MIX).collect()
    assert len(got) == len(odd_rows) and all(0 < r.probability <= 1 for r in got)
    assert mixing.with_probabilities(none, queries.MIX).count() == 0


# 8 -------------------------------------------------------------------------------------------------------------------------


def slow_components(rows, n, top, bottom):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and bottom * both >= top * len(a | sets[j]):
                up[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return out


@pytest.mark.parametrize(("n", "top"), [(4, 85), (5, 80), (2, 60)])
def test_join_odd_rows(odd, odd_rows, n, top):
    got = ngram_join.jaccard_components(odd, n, top, block_bytes=4000, common=2, chunk=2).collect()
    assert pairs((r.doc_id, r.n_shingles, r.component_id) for r in got) == pairs(slow_components(odd_rows, n, top, 100))


def test_join_finds_all_links_under_common_passages(spark):
    """A passage in every text, near copies in chains, and hot groups cut into chunks."""
    rng = random.Random(21)
    passage = sentence(rng, 30)
    rows = []
    for i in range(260):
        words = sentence(rng, rng.randrange(4, 70)).split()
        for c in range(rng.choice([1, 1, 2, 4])):
            rows.append((len(rows), " ".join([*words, *passage.split()]) if i % 3 else " ".join(words)))
            words[rng.randrange(len(words))] = f"edit{i}x{c}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = pairs(slow_components(rows, 3, 80, 100))
    for common in (3, 64):
        got = ngram_join.jaccard_components(df, 3, 80, common=common, chunk=16).collect()
        assert pairs((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    firsts = {}
    for r in got:
        firsts[r.component_id] = firsts.get(r.component_id, 0) + r.first
    assert set(firsts.values()) == {1}


def test_join_empty(none):
    assert ngram_join.jaccard_components(none).count() == 0


def test_segments_agree_whenever_sets_are_similar():
    """The pigeonhole itself: similar sets share a signature, also when both skip what they can spare."""
    rng = np.random.default_rng(7)
    schemes = ngram_join.Schemes(80, 100)
    for size in [*range(1, 40), 75, 200, 900]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            while True:
                b = a.copy()
                k = int(rng.integers(0, max(1, size // 9) + 1))
                b[rng.choice(len(b), min(k, len(b)), replace=False)] = rng.integers(0, 2**63, min(k, len(b))).astype(np.uint64)
                b = np.unique(b)[: len(b) - int(rng.integers(0, 2))] if size > 10 else np.unique(b)
                if len(b):
                    break
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert len(np.intersect1d(schemes.signatures(a), schemes.signatures(b)))


def test_components(spark, tmp_path):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {x: x for e in links for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long"), f"file://{tmp_path}/c").collect()}
    assert got == {x: find(x) for e in links for x in e if e[0] != e[1]}


# 9 -------------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site name and claim of the site</a></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice"><p>We use cookies. Accept them all, please, as this is a long sentence.</p></div>
<main><article><h1>The   title &amp; more</h1><p>First paragraph with <b>bold</b> and <a href=z>a link</a> inside.<p>Short.</p><div class="ad">Buy this now, it is very cheap and very good indeed.</div>
<p>Second&nbsp;one, long enough to count as text of the article.<br>After the break.</p><ul><li>An item of the list</li><li>Another item</li></ul></article>
<aside><p>Related: read this other story, which is also long enough to pass.</p></aside>
<form><p>Name of the reader and the address of the reader, please.</p><input name=a><button>Send</button></form>
<section id="comments"><div class="comment"><p>I think that this article is wrong, and here is a long reason why.</p></div></section></main>
<footer><p>Copyright &copy; the company, all rights reserved in all countries.</p></footer></body></html>"""
TEXT = ["The title & more", "First paragraph with bold and a link inside.", "Short.", "Second one, long enough to count as text of the article. After the break.", "An item of the list", "Another item"]


def test_page_text():
    assert html_extraction.main_text(PAGE).split("\n\n") == TEXT


def test_page_without_semantic_tags():
    body = "<div id=menu><a href=a>Home page</a> <a href=b>All news</a></div><div class=content><h2>A heading</h2>" + "".join(f"<p>Sentence number {i} of the text, which goes on for a while.</p>" for i in range(4)) + "</div><div class=sidebar><p>Links of the week, and a sentence about them.</p></div>"
    assert html_extraction.main_text(body).split("\n\n") == ["A heading"] + [f"Sentence number {i} of the text, which goes on for a while." for i in range(4)]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "</p></div>", "<script>", "&am &#x110000; <b", "<p>" * 3000, "<div><span>" * 2000 + "x" * 100_000])
def test_pages_that_are_odd(page):
    html_extraction.main_text(page)


def slow_cut(costs, links):
    best = None
    for mask in range(1 << len(costs)):
        side = [bool(mask >> i & 1) for i in range(len(costs))]
        value = sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(costs, side, strict=True)) + sum(w for i, j, w in links if side[i] != side[j])
        best = value if best is None else min(best, value)
    return best


def test_cut_is_minimal():
    rng = random.Random(13)
    for _ in range(200):
        n = rng.randrange(1, 9)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        links = [(i, j, rng.uniform(0, 1.5)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        side = html_extraction.minimum_cut(costs, links)
        value = sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(costs, side, strict=True)) + sum(w for i, j, w in links if side[i] != side[j])
        assert value == pytest.approx(slow_cut(costs, links))


def test_page_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extraction.extract(df, ["page_id", "url"]).collect()
    assert pairs((r.page_id, r.url, r.text) for r in got) == pairs([(1, "u", "\n\n".join(TEXT)), (2, None, ""), (3, "v", ""), (1, "u", "\n\n".join(TEXT))])
    assert html_extraction.extract(df.where("1 = 0"), ["page_id", "url"]).count() == 0


# 10 ------------------------------------------------------------------------------------------------------------------------


def slow_repeats(rows, length):
    low = -(1 << 63)
    first: dict[bytes, int] = {}
    rows = [(low if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in rows:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        out.append((None if i == low else i, len(t), int(gone.sum()), int(opens.sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("length", [25, 50])
def test_repeats_odd_rows(odd, odd_rows, length):
    got = suffix_dedup.remove_repeats(odd, length, block_bytes=6000).collect()
    assert pairs((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == pairs(slow_repeats(odd_rows, length))


def test_repeats_with_overlaps_and_small_alphabet(spark):
    rng = random.Random(17)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(20, 120))) for _ in range(12)]
    rows = [(rng.randrange(60), "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))) for _ in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.remove_repeats(df, 50, block_bytes=3000).collect()
    assert pairs((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == pairs(slow_repeats(rows, 50))


def test_repeats_empty(none):
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_rounds_sort_and_match():
    """Each round's order is by reversed prefix, and its match lengths are those of neighbours."""
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(9)) for _ in range(40)]
    columns = [np.array([ord(s[c]) for s in strings], np.uint16) for c in range(9)]
    for c, (order, match) in enumerate(suffix_dedup.column_rounds(iter(columns), 40, 5)):
        keys = [strings[i][: c + 1][::-1] for i in order]
        assert keys == sorted(keys)
        for k in range(1, 40):
            same = next((n for n, (x, y) in enumerate(zip(keys[k - 1], keys[k], strict=True)) if x != y), c + 1)
            assert match[k] == same


# all -----------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    oracle.same(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.ORACLES[name])


def test_every_operator_has_its_query():
    assert {int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES} == set(range(1, 14))


def test_texts_go_from_their_block_to_their_slices(spark, tmp_path):
    """A worker gives the text of each (lead, slice, node) at once, so texts are neither stored nor shuffled for a join."""
    bodies = [b"one text", b"", b"x" * 5000]
    uri = f"file:{tmp_path}/block"
    (tmp_path / "block").write_bytes(blocks.pack(np.arange(3), np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)])))
    asked = [(uri, 7, 0, 0), (uri, 8, 1, 0), (uri, 7, 0, 2)]
    rows = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*asked)], ["block", "lead", "slice", "node"])
    found = [r for b in ngram_join._fetch(4)(iter([rows])) for r in b.to_pylist()]
    assert [(r["lead"], r["slice"], r["node"]) for r in found] == [a[1:] for a in asked]
    assert [pa.decompress(r["body"], r["raw"], codec="zstd", asbytes=True) for r in found] == [bodies[a[3]] for a in asked]
