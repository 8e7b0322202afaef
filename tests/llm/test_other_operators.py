"""URL filters, top-k search, toxicity, archives, the pipeline and the registry."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_rows import corpus, docs, no_docs, prose  # noqa: F401
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from oracle.compare import connect, differences
from wanderlens.llm import topk, toxicity, url_filter, warc
from wanderlens.llm.queries import ORACLE, QUERIES
from wanderlens.sources.stored import n_stored, stored

FOLDER = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, key string, host string, row string"


# --- URLs ---


def pages(urls, html="<p>x</p>"):
    return [(i, u, html if not isinstance(html, list) else html[i], "k", "h", "r") for i, u in enumerate(urls)]


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://COM/a", "http://www.Example.com/en/x", "http://example.com/en/", "http://example.com/en",
    "http://xexample.com/en/", "http://a.www.example.com/en/1?q#f", "https://b.net/es/1", "https://net/fr/", "https://net.org/es/", "ftp://x.org?en/",
    "http://x.org/a/", "http://www.x.org/a", "http://X.org/a.html?utm_source=1&b=2&a=1#z", "http://x.org/a?a=1&b=2", "http://y.org/a://b", "http://İ.org/É",
]


def test_urls_are_split_and_ruled(spark):
    frame = spark.createDataFrame(pages(URLS), PAGES)
    listed = spark.createDataFrame([("http://x.org/a",), ("http://x.org/a?a=1&b=2",), (None,), ("http://x.org/a",)], "url string")
    found = {r.row.url: r for r in url_filter.judge(frame, listed).collect()}
    assert len(found) == len(URLS)
    for url, r in found.items():
        rest = url.partition("://")[2] if url and "://" in url else ""
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        assert r.host == rest[:end].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        assert r.path == rest[end:].split("?")[0].split("#")[0]
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert r.rule == rule
        if rule:
            assert r.verdict == verdict
    blocked = {u for u, r in found.items() if r.rule is None and r.verdict == "block"}
    assert blocked == {u for u in URLS if u and "x.org/a" in u.lower()}


def test_bloom_filter_never_misses(spark):
    names = spark.range(3000).select(F.concat(F.lit("h.org/"), "id").alias("url"))
    table, blocks = url_filter.bloom(names, 3000)
    asked = spark.range(6000).select(F.concat(F.lit("h.org/"), "id").alias("url"), "id")
    found = url_filter.possible_hits(asked, table, blocks, "url")
    assert found.where("id < 3000 and not possible").count() == 0
    assert found.where("id >= 3000 and possible").count() < 60
    assert table.count() <= blocks


def test_false_positives_do_not_block(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)  # a full filter lets everything through
    listed = spark.range(500).select(F.concat(F.lit("http://l.org/"), "id").alias("url"))
    frame = spark.createDataFrame(pages([f"http://l.org/{i}" for i in range(400, 600)]), PAGES)
    verdicts = Counter(r.verdict for r in url_filter.judge(frame, listed).collect())
    assert verdicts == {"block": 100, "allow": 100}


def test_urls_of_nothing(spark):
    empty = spark.createDataFrame([], PAGES)
    assert url_filter.judge(empty, url_filter.labelled(empty)).count() == 0
    frame = spark.createDataFrame(pages(URLS), PAGES)
    assert url_filter.judge(frame, empty.select("url")).count() == len(URLS)


# --- top-k ---

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, block string"


def plain_top(rows, is_query, k):
    usable = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows
              if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = []
    for q, a in {(i, tuple(v)) for i, v in usable if is_query(i)}:
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q)
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return Counter(found)


@pytest.mark.parametrize("block", [7, 64, 1 << 14])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = random.Random(block)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(150)]
    rows += [(200 + i, rows[10][1]) for i in range(60)]  # many equal vectors
    rows += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [0.0] * 8), (305, []), (306, [0.5]), rows[20], (None, [1.0] * 8)]
    frame = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], VECTORS).repartition(3)
    found = topk.top_k(frame, F.col("vec_id") % 10 == 0, k=10).collect()
    assert Counter(map(tuple, found)) == plain_top(rows, lambda i: i % 10 == 0, 10)


def test_top_k_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0, -1.0], 1, "", "", ""), (3, [0.5, 0.5], 1, "", "", "")], VECTORS)
    assert [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 3, 0)]
    assert topk.top_k(frame.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_search_stops_before_the_end():
    rng = np.random.default_rng(1)
    values = np.rint(rng.normal(0, 50, (4000, 16))).astype(np.int64)
    query = np.zeros(16, np.int64)
    query[:3] = (400, -300, 5)
    index = topk.Block(np.arange(4000), values)
    where, scores = index.search(query, -1, 10)
    exact = values @ query
    best = np.lexsort((np.arange(4000), -exact))[:10]
    assert where.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()


# --- toxicity ---


def toxic_rows(n=600):
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        text, toxic = prose(i, rng.randint(20, 200), 3000), int(i % 6 == 0)
        if toxic:
            text += " " + " ".join(rng.choice(["nasty", "vileness", "vilely", "horrid"]) for _ in range(3))
        rows.append((i, text, "en", "a", 0, *"xk9rln"))
        if i % 2 == 0 or rng.random() < 0.5:
            labels.append((i, 1, toxic, "extra"))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs):
    rows, labels = toxic_rows()
    frame = spark.createDataFrame(rows, docs.schema)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = toxicity.train(frame, marks)
    found = {r.key: r for r in toxicity.score(frame.unionByName(docs), model).collect() if r.key is not None and r.key >= 50}
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.predicted == int(r.key % 6 == 0) for r in held) >= 0.95 * len(held)
    # Labels of held-out rows change nothing.
    flipped = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(frame, flipped)
    assert again[1] == model[1] and np.array_equal(again[0], model[0])


def test_toxicity_of_odd_rows(spark, docs, no_docs):
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert toxicity.score(docs, model).count() == len(corpus())
    assert toxicity.score(docs, model).where("score > 0.01 or held_out is null").count() == 0
    assert toxicity.score(no_docs, toxicity.train(no_docs, marks)).count() == 0


def test_negative_clean_risk_turns_the_step():
    rng = np.random.default_rng(0)
    positive = [np.array([1, 2, *rng.integers(10, 5000, 20)]) for _ in range(200)]
    unlabelled = [np.array([*([1, 2] if i % 5 == 0 else []), *rng.integers(10, 5000, 20)]) for i in range(400)]
    weights, bias = toxicity.fit(positive, unlabelled, 0.2)
    assert bias < 0 < weights[1] and bias + weights[1] + weights[2] > 0


# --- archives ---


def page_rows():
    html = [None, "", "<p>é\U0001f600</p>", "same", "same", "same", "x" * 700_000, "a\r\n\r\nb", "WARC/1.1\r\n", "same"]
    rows = [(i + 10, f"http://h/{i}\r\nX: y", h, "k", "h", "r") for i, h in enumerate(html)]
    return rows + [(13, None, "same", "k", "h", "r"), (None, "u", "same", "k", "h", "r"), (9, "u", "only", "k", "h", "r")]


def test_archives_return_every_page(spark):
    frame = spark.createDataFrame(page_rows(), PAGES).repartition(3)
    found = warc.read(warc.write(frame)).collect()
    first = {}
    for key, _, html, *_ in page_rows():
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    expected = Counter()
    for key, _, html, *_ in page_rows():
        payload = (html or "").encode()
        own = key == first[html or ""]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected[(key, len(payload), digest, "response" if own else "revisit", None if own else first[html or ""])] += 1
    assert Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected
    assert all(r.payload == (None if r.record_type == "revisit" else r.payload) for r in found)
    assert {r.url for r in found if r.url} >= {"u", "http://h/0%0D%0AX:%20y"}


def test_small_payloads_are_all_responses(spark):
    frame = spark.createDataFrame(page_rows(), PAGES)
    types = Counter(r.record_type for r in warc.read(warc.write(frame, smallest=5)).collect())
    assert types == {"response": len(page_rows())}


def test_one_record_is_read_by_its_frame(spark, tmp_path):
    frame = spark.createDataFrame([(i, "u", f"page {i} " * 4000, "k", "h", "r") for i in range(60)], PAGES).coalesce(1)
    bundles = warc.write(frame)
    row = bundles.first()
    places = warc.frame_places(row.data)
    assert len(places) > 3
    entry_of = {r.key: r for r in row.records}[41]
    at, size, full = places[entry_of.frame]
    plain = warc.zstandard.ZstdDecompressor().decompress(row.data[at : at + size], max_output_size=full)
    assert warc.parse(plain[entry_of["at"] : entry_of["at"] + entry_of["length"]])[6] == b"page 41 " * 4000
    assert warc.export_files(bundles, str(tmp_path)).count() == bundles.count()
    whole = b"".join(p.read_bytes() for p in tmp_path.glob("*.warc.zst"))
    text = warc.zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == 60


def test_a_damaged_record_fails():
    good = warc.record(1, "u", b"payload", None)
    assert warc.parse(good)[6] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n", b"pAyload\r\n"))


def test_archive_of_nothing(spark):
    assert warc.read(warc.write(spark.createDataFrame([], PAGES))).count() == 0


# --- pipeline and registry ---


def test_pipeline_keeps_documents_until_it_packs_them(spark, docs):
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, frame, FOLDER)
        assert kept.dtypes == frame.dtypes
        frame = stored(kept)
    placed = corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER)
    assert Counter(r.doc_id for r in placed.where("piece = 0").collect()) == Counter(r.doc_id for r in frame.collect())


def test_pipeline_carries_columns_with_clashing_names(spark, docs):
    """Extra columns named as the operators' own come through all stages that return documents."""
    names = ["_key", "_print", "_lang", "key", "lines", "label", "n"]
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(f"x {c}").alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, frame, FOLDER)
        assert kept.dtypes == frame.dtypes
        frame = stored(kept)
        assert frame.count() > 0 and frame.where(" or ".join(f"`{c}` <> 'x {c}'" for c in names)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).count() >= frame.count()


def test_pipeline_leaves_two_tables_behind(spark):
    before = n_stored()
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert n_stored() == before + 2


def test_pipeline_of_nothing(spark, no_docs):
    frame = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        frame = stored(stage(spark, frame, FOLDER))
        assert frame.count() == 0


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 1 + len(QUERIES))]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_duckdb(spark, name):
    count, different = differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name])
    assert not different and count > 0
