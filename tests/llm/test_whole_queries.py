"""Every opN query over a whole table against a plain version, on all columns of its contract."""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from docloom.llm import html_extraction, queries, toxicity
from tests.llm.test_operators import slow_components, slow_repeats, slow_shard

SHA = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    vocabulary = queries._vocabulary()
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_op2_and_op4_equal_the_library(spark, sf_dir, docs, reference):
    ids = {i: reference.encode_ordinary(t) for i, t in docs}
    assert rows(queries.op2_token_counts(spark, sf_dir), "doc_id", "n_tokens") == sorted((i, len(x)) for i, x in ids.items())
    want = sorted((i, len(ids[i]), SHA(np.array(ids[i], "<u4").tobytes()), SHA(t.encode())) for i, t in docs)
    assert rows(queries.op4_byte_bpe(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op6_hashes_and_slots(spark, sf_dir, docs):
    got = queries.op6_sharding(spark, sf_dir).collect()
    want = sorted((i, len(t.encode()) + 16, zlib.crc32(t.encode()), "key", slow_shard(i, [1.0] * 40), slow_shard(i, [1.0] * 41)) for i, t in docs)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_op8_components(spark, sf_dir, docs):
    assert rows(queries.op8_ngram_join(spark, sf_dir), "doc_id", "n_shingles", "component_id") == sorted(slow_components(docs, 4, 85, 100))


def test_op10_repeats(spark, sf_dir, docs):
    want = sorted((i, n, gone, spans, SHA(kept)) for i, n, gone, spans, kept in slow_repeats(docs, 50))
    assert rows(queries.op10_suffix_dedup(spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op5_scores_by_plain_sums(spark, sf_dir, docs):
    """The score of every text from the model's weights, one n-gram at a time."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.learn(table, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~queries.held_out())

    def bucket(gram: str) -> int:
        h = len(gram)
        for c in gram:
            h = (h * 0x100000001B3 + ord(c)) % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor % 2**64
        return (h ^ h >> 31) >> 64 - model.bits

    got = {r.doc_id: r for r in queries.op5_toxicity(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, t in docs[:60] + docs[-5:]:
        low = t.lower()
        total = model.intercept
        for n in model.orders:
            total += sum(float(model.weights[b]) for b in {bucket(low[k : k + n]) for k in range(len(low) - n + 1)})
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


def test_op5_two_labels_of_one_id(spark):
    rows_ = [(i, f"plain words number {i} " + ("awful clown" if i % 4 == 0 else "of a text")) for i in range(400)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i, _ in rows_]
    one = toxicity.learn(docs, spark.createDataFrame(labels + [(8, 0), (8, 0), (9, None)], "doc_id long, toxic int"), queries.F.lit(True))
    two = toxicity.learn(docs.repartition(5), spark.createDataFrame([(8, 0), *labels, (8, 0)], "doc_id long, toxic int"), queries.F.lit(True))
    assert (one.weights == two.weights).all() and one.intercept == two.intercept


# 3: the definition without any shortcut -------------------------------------------------------------------------------------


def plain_fingerprint(raw: bytes, slots: int = 32, ell: int = 2) -> bytes:
    mix = lambda x: __import__("docloom.llm.text", fromlist=["mix64"]).mix64(x)
    if len(raw) < 8:
        grams = [int.from_bytes(raw.ljust(8, b"\0"), "little") + (len(raw) + 1 << 56)]
    else:
        grams = [int.from_bytes(raw[i : i + 8], "little") for i in range(len(raw) - 7)]
    seen: dict[int, int] = {}
    times = []
    for g in grams:
        times.append(seen.get(g, 0))
        seen[g] = times[-1] + 1
    grams, times = mix(np.array(grams, np.uint64)), np.array(times, np.uint64)
    elements = np.where(times > 0, mix(grams + times * np.uint64(0x9E3779B97F4A7C15)), grams)
    out = []
    for s in range(1, slots + 1):
        factor = int(mix(np.array([s * 0xD1B54A32D192ED03 % 2**64], np.uint64))[0]) | 1
        value = elements * np.uint64(factor)
        few = np.flatnonzero(value <= np.partition(value, min(ell, len(value)) - 1)[min(ell, len(value)) - 1])
        places = np.sort(few[np.lexsort((few, value[few]))][:ell])
        mark = np.zeros(1, np.uint64)
        for j in range(ell):
            if j < len(places):
                mark = mark * np.uint64(0x100000001B3) + grams[places[j]] + np.uint64(j)
            mark = mix(mark)
        out.append(int(mark[0]) >> 32)
    return np.array(out, "<u4").tobytes()


def test_op3_fingerprints_and_likeness(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    own = {i: plain_fingerprint(t.encode()) for i, t in docs}
    same = lambda a, b: float((np.frombuffer(a, "<u4") == np.frombuffer(b, "<u4")).mean())
    for (i, t), (j, u) in zip(docs, docs[1:] + docs[:1], strict=True):
        q = len(t) // 4
        edited = (t[: len(t) - q] + u[:q]).encode()
        mark = plain_fingerprint(edited)
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), SHA(edited), own[i].hex(), mark.hex())
        assert (r.near_edited, r.near_next) == (same(own[i], mark), same(own[i], own[j]))


# 9 -------------------------------------------------------------------------------------------------------------------------


class Articles(HTMLParser):
    """Blocks inside article elements, by another parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.pieces, self.found = False, [], []

    def close_block(self):
        text = " ".join("".join(self.pieces).split())
        if text:
            self.found.append(text)
        self.pieces = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("p", "h1", "h2", "h3", "div", "li", "ul", "article", "table", "tr"):
            self.close_block()
        if tag == "br":
            self.pieces.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "div", "li", "ul", "article"):
            self.close_block()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.pieces.append(data)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op9_texts_of_all_pages(spark, folder):
    path = f"/root/testdata/{folder}"
    pages = spark.read.parquet(f"{path}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op9_html_extraction(spark, path).collect()}
    assert len(got) == len(pages)
    for page in pages:
        parser = Articles()
        parser.feed(page.html)
        want = "\n\n".join(parser.found)
        assert got[page.page_id].text == want and got[page.page_id].n_chars == len(want) and got[page.page_id].url == page.url


LONG = "A long paragraph with many words that goes on and on for a while until it is over one hundred characters."
KEPT = {
    "<p>Energy is given by <math><mi>E</mi></math> and more": ["Energy is given by E and more"],
    f"<div><p>Short one</p><p>Tiny</p><p>{LONG}</p><p>Yes</p></div>": ["Short one", "Tiny", LONG, "Yes"],
    "<article><h2>Intro</h2><p>Some text.</p><section id=discussion><h2>Discussion</h2><p>We discuss the results.</p></section></article>": ["Intro", "Some text.", "Discussion", "We discuss the results."],
    "<article><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></article>": ["a b", "1 2"],
    "<main><object>Shown instead</object><canvas>Drawn text</canvas></main>": ["Shown instead Drawn text", "Shown insteadDrawn text"],
}


@pytest.mark.parametrize("page", KEPT)
def test_kept_parts(page):
    got = html_extraction.main_text(page)
    assert got == "\n\n".join(KEPT[page]) or got in KEPT[page]


def test_the_cut_corrects_the_sign():
    """Short lines between paragraphs, and a long line among links, in pages of div elements alone."""
    short = "".join(f"<div>{LONG} {LONG}</div><div>So {i}</div>" for i in range(5))
    menu = "".join(f"<div><a href=x>Part {i} of all</a></div>" for i in range(4))
    page = f"<div class=a>{menu}</div><div class=b>{short}</div>"
    blocks = html_extraction.scan(page)
    want = [b.element.parent.marks == 0 and not b.linked for b in blocks]
    signs = [c > 0 for c in html_extraction.GIVEN.costs(blocks)]
    assert html_extraction.GIVEN.labels(blocks) == want
    assert sum(a != b for a, b in zip(signs, want, strict=True)) == 5


def test_learned_on_the_table_the_cut_beats_the_sign(spark):
    """Pages the model was not fitted on, seen as div elements without classes."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").collect()]
    model = html_extraction.fit(pages[:400])
    right = by_sign = total = 0
    for page in pages[400:]:
        blocks = html_extraction.scan(page)
        for y, kept, c in zip(map(html_extraction.own_label, blocks), model.labels(blocks, 0, False), model.costs(blocks, 0, False), strict=True):
            if y >= 0:
                total, right, by_sign = total + 1, right + (y == int(kept)), by_sign + (y == int(c > 0))
    assert total > 1500 and right / total > 0.93 and right > by_sign


HOSTILE = ('<a title="x ', "<a ", "<div>x ", "<button>", "<b><p></p>", "</x><i>", "<!-- - ", "</button ", "<p class='", "<span>x<p>y", "<p>ok</p><p>a longer sentence, which ends.</p>", "<li>a<dd>b", "<td>x<table>")


@pytest.mark.parametrize("piece", HOSTILE)
def test_time_is_linear(piece):
    import time

    took = []
    for size in (100_000, 400_000):
        began = time.process_time()
        html_extraction.main_text(piece * (size // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 0.3 + 8 * took[0] and took[1] < 4
