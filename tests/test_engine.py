"""Dedup, frontier, graph, storage, state, metrics and streams against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, frontier, graph, metrics, state
from corpusloom.plans import crawl
from corpusloom.sources import store, web
from corpusloom.streaming import streams


def greedy(rows, semantic=()):
    """rows of (id, text, simhash) in order; semantic: set of pairs of ids."""
    kept, out = [], {}
    for i, t, s in rows:
        if any(t == u for _, u, _ in kept):
            out[i] = "exact"
        elif any(bin((s ^ r) & (2**64 - 1)).count("1") <= 4 for _, _, r in kept):
            out[i] = "near"
        elif any((min(i, j), max(i, j)) in semantic for j, _, _ in kept):
            out[i] = "semantic"
        else:
            out[i] = ""
            kept.append((i, t, s))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    rows = []
    for k in range(150):
        own = list(base[k % 12])
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(60)] = rng.choice(words)
        rows.append((k, " ".join(own)))
    rows += [(150, ""), (151, ""), (152, rows[3][1]), (153, rows[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_cascade(spark, docs):
    from corpusloom.functions import text as tx

    rows = sorted((r[0], r[1], r[2]) for r in docs.select("doc_id", "text", tx.simhash("text")).collect())
    assert {r["doc_id"]: r["reason"] for r in dedup.cascade(docs).collect()} == greedy(rows)
    pairs = {(0, 1), (1, 5), (2, 7), (5, 30)}
    frame = spark.createDataFrame(sorted(pairs), "a long, b long")
    by_text = {}
    for i, t, _ in rows:
        by_text.setdefault(t, []).append(i)
    closed = {(min(x, y), max(x, y)) for a, b in pairs for x in by_text[rows[a][1]] for y in by_text[rows[b][1]]}
    assert {r["doc_id"]: r["reason"] for r in dedup.cascade(docs, semantic=frame).collect()} == greedy(rows, closed)


def test_near_pairs_are_all_pairs(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        fps += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for _ in range(5)]
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    reps = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "simhash long, rep long")
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 4}
    got = [(r["a"], r["b"]) for r in dedup.near_pairs(reps).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("block,local", [(3, 20_000), (4, 2)])
def test_greedy_chain(spark, block, local):
    """A chain in which each matches the next only: every other one stays, however it is decided."""
    rows = [(k, (1 << 3 * k) - 1, k) for k in range(20)] + [(100, -1, 5), (101, -2, 6), (102, -1 << 30, 7)]
    nodes = spark.createDataFrame(rows, "node long, simhash long, rep long")
    got = {r["node"] for r in dedup.greedy(nodes, block=block, local=local).where("kept").collect()}
    want = greedy_nodes(rows)
    assert got == want and {0, 2, 4, 6} <= got


def greedy_nodes(rows):
    kept = []
    for n, s, r in sorted(rows, key=lambda x: (x[2], x[0])):
        if all(bin((s ^ t) & (2**64 - 1)).count("1") > 4 for _, t in kept):
            kept.append((n, s))
    return {n for n, _ in kept}


def test_greedy_variants_of_one_page(spark):
    """Many variants within a few bits give rows in proportion to their number, not their pairs."""
    rng = random.Random(5)
    base = rng.getrandbits(62)
    sims = sorted({base ^ sum(1 << b for b in rng.sample(range(62), rng.randrange(0, 4))) for _ in range(600)})
    rows = [(k, s, k) for k, s in enumerate(sims)]
    nodes = spark.createDataFrame(rows, "node long, simhash long, rep long")
    want = greedy_nodes(rows)
    for local in (20_000, 10):
        assert {r["node"] for r in dedup.greedy(nodes, local=local, block=512).where("kept").collect()} == want


def test_cascade_odd_rows(spark):
    """One row out for each row in: repeated ids, rows without id, null texts, an empty table."""
    rows = [(1, "same text here"), (1, "same text here"), (1, "another text, quite different from it"), (2, "same text here"), (None, "lone words of no id at all"), (None, "same text here"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for semantic in (None, spark.createDataFrame([(7, 8)], "a long, b long")):
        got = sorted(((r["doc_id"] or 99, r["reason"]) for r in dedup.cascade(docs, semantic=semantic).collect()))
        assert got == [(1, ""), (1, ""), (1, "exact"), (2, "exact"), (3, ""), (4, "exact"), (99, ""), (99, "exact")]
        assert dedup.cascade(docs.limit(0), semantic=semantic).count() == 0


def test_semantic_pairs(spark):
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) + 3 * (d == k % 4) for d in range(5)]) for k in range(120)]
    odd = [(200, None), (201, [0.0] * 5), (202, [float("nan")] * 5), (203, [1.0, 2.0]), (204, [1.0, 2.1]), (205, [None, 1.0]), (None, rows[0][1]), (206, [])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    norm = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    unit = {k: norm(v) for k, v in rows + [odd[3], odd[4]]}
    for threshold in (0.95, 0.4):
        want = {(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and sum(x * y for x, y in zip(unit[a], unit[b])) >= threshold}
        for block in (4096, 7):
            got = [(r["a"], r["b"]) for r in dedup.semantic_pairs(frame, threshold, block=block).collect()]
            assert set(got) == want and len(got) == len(want)
    mixed = dedup.nearest(frame.where("vec_id IN (20, 203, 201)"), frame, 0.5).collect()
    assert {(r["query_id"], r["vec_id"]) for r in mixed if r["query_id"] == 203} == {(203, 204)}


def test_exact_with_null_keys(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (None, "b")], "doc_id long, content_hash string")
    assert sorted((r["doc_id"] or 99, r["first"]) for r in dedup.exact(docs).collect()) == [(1, True), (2, False), (3, True), (4, False), (99, False)]
    known = spark.createDataFrame([("a",), (None,)], "content_hash string")
    assert dedup.exact(docs, known=known).where("first").count() == 0


def test_nearest(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(80)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    norm = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    for group in (4096, 2):
        got = {r["query_id"]: r["vec_id"] for r in dedup.nearest(frame.where("vec_id % 20 = 0"), frame, 0.5, group=group).collect()}
        for q in (0, 20, 40, 60):
            best = max(((sum(a * b for a, b in zip(norm(rows[q][1]), norm(v))), -k) for k, v in rows if k != q))
            assert got.get(q) == (-best[1] if best[0] >= 0.5 else None)


def test_frontier(spark):
    urls_ = ["http://a/", "http://a/x", "http://a/x/", "http://b/product/1", "ftp://x", "http://b/q", "http://c/y"]
    cand = spark.createDataFrame([(u, k) for k, u in enumerate(urls_)], "url string, seq long")
    seen = spark.createDataFrame([("http://b/q",)], "url string")
    used = spark.createDataFrame([("c", 5)], "domain string, used long")
    got = frontier.admit(cand, seen, used, seq="seq", default=5).collect()
    assert {(r["url"], r["priority"], r["seq"]) for r in got} == {("http://a/", 100, 0), ("http://a/x", 40, 1), ("http://b/product/1", 60, 3)}
    ranks = spark.createDataFrame([("http://a/", 100.0), ("http://a/x", 33.0)], "url string, score double")
    got = frontier.admit(cand, seen, used, ranks, seq="seq", tiers={"c": 2}, overrides={"a": 9}, default=1)
    assert {r["url"]: r["priority"] for r in got.collect()} == {"http://a/": 150, "http://a/x": 56, "http://b/product/1": 60}
    pending = spark.createDataFrame([(f"u{d}{k}", d, k % 3, k) for d, n in (("a", 10), ("b", 1), ("c", 5)) for k in range(n)], "url string, domain string, priority int, seq long")
    fair = frontier.fair(pending).groupBy("domain").count().collect()
    assert {r["domain"]: r["count"] for r in fair} == {"a": round(50 / 16), "b": 1, "c": round(25 / 16)}
    assert [r["url"] for r in frontier.top(pending, 3).collect()] == ["ua2", "ua5", "ua8"]
    assert frontier.within_budget(pending, default=2).count() == 5
    tables = frontier.budgets(spark.createDataFrame([("a",), ("b",), ("c",)], "domain string"), spark.createDataFrame([("a", 7)], "domain string, budget int"), spark.createDataFrame([("b", 3), ("c", 9)], "domain string, tier int"))
    assert {r["domain"]: r["budget"] for r in tables.collect()} == {"a": 7, "b": 20000, "c": 1000}
    stats = frontier.budget_stats(pending, default=3).collect()
    assert {(r["domain"], r["used"], r["remaining"]) for r in stats} == {("a", 10, 0), ("b", 1, 2), ("c", 5, 0)}


def pagerank(edges, d=0.85, rounds=20):
    """Membership of an edge counts once, the number of a source's links with repetitions."""
    nodes = {x for e in edges for x in e}
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    pr = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        pr = {u: (1 - d) / len(nodes) + d * sum(pr[v] / len(out[v]) for v in out if u in out[v]) for u in nodes}
    top = max(pr.values())
    return {u: 100 * p / top for u, p in pr.items()}


def test_pagerank(spark):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("d", "e"), ("a", "b"), ("e", "dangling")]
    got = {r["url"]: r["score"] for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = pagerank(edges)
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-9 for u in want) and max(got.values()) == 100
    assert graph.pagerank(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_storage(spark, tmp_path):
    schema = "url string, title string, etag string, seq long"
    old = spark.createDataFrame([("a", "t0", "e0", 0), ("z", "tz", "ez", 1)], schema)
    new = spark.createDataFrame([("a", "t1", "e1", 1), ("a", "t2", None, 2), ("b", "u1", "f1", 1), ("b", None, "f2", 2), (None, "x", "y", 3)], schema)
    rows = lambda df: {(r["url"], r["title"], r["etag"]) for r in df.collect()}
    assert rows(store.upsert(old, new)) == {("a", "t2", "e0"), ("b", None, "f1"), ("z", "tz", "ez")}
    assert rows(store.replace(old, new)) == {("a", "t2", None), ("b", None, "f2"), ("z", "tz", "ez")}
    again = store.upsert(store.upsert(old, new).withColumn("seq", F.lit(0)), new)
    assert rows(again) == rows(store.upsert(old, new))
    links = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c")], "src string, dst string")
    assert {tuple(r) for r in store.insert_ignore(links.limit(1), links, ["src", "dst"]).collect()} == {("a", "c")}
    path = str(tmp_path / "wal")
    events = spark.createDataFrame([("fetched", "a", "status=200 ms=12", 1.5), ("stored", "a", None, None)], "event string, url string, detail string, ts double")
    store.append_wal(events, path)
    store.append_wal(events.limit(1), path)
    (tmp_path / "wal" / "bad.json").write_text('{"event": "x", \n\n{"event": "error", "url": "b", "detail": "d", "ts": 2.0}\n')
    got = store.replay_wal(spark, path).collect()
    assert sorted(r["event"] for r in got) == ["error", "fetched", "fetched", "stored"]
    assert all(r["ts"] > 1e9 for r in got if r["event"] == "stored")
    page = spark.createDataFrame([("http://H/x", "T", "body words", "", "A", "", "en", {"DATE": ["d"]}, {"k": "v"}, "2024")], "url string, title string, text string, article string, author string, date string, language string, entities map<string,array<string>>, schema_org map<string,string>, scraped_at string")
    doc = json.loads(store.search_documents(page).first()["document"])
    assert doc["article"] == "body words" and doc["date"] is None and doc["domain"] == "H" and len(doc) == 10


def test_rate_schedule(spark):
    rng = random.Random(5)
    rows = [(k, f"d{rng.randrange(3)}", round(rng.uniform(0, 60), 3)) for k in range(200)]
    last, want = {}, {}
    for k, d, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[k] = last[d] = max(t, last.get(d, -1e9) + 1.5)
    got = {r["event_id"]: r["start"] for r in state.schedule(spark.createDataFrame(rows, "event_id long, domain string, arrival double")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


CASES = {
    "four and success": ([(0, "failure")] * 4 + [(1, "success"), (2, "failure")], [True] * 6, [1, 2, 3, 4, 0, 1]),
    "five open": ([(0, "failure")] * 5 + [(1, "success"), (119, "other"), (120, "failure"), (121, "success"), (240, "success")], [True] * 5 + [False, False, True, False, True], [1, 2, 3, 4, 5, 5, 5, 6, 6, 0]),
    "other leaves alone": ([(0, "failure"), (1, "other"), (2, "failure")], [True] * 3, [1, 1, 2]),
}


def test_breaker(spark, tmp_path):
    rows, want = [], {}
    for name, (events, allowed, failures) in CASES.items():
        for k, ((t, o), a, f) in enumerate(zip(events, allowed, failures)):
            rows.append((name, k, float(t), o))
            want[name, k] = (a, f)
    frame = spark.createDataFrame(rows, "domain string, event_id long, ts double, outcome string")
    got = {(r["domain"], r["event_id"]): (r["allowed"], r["failures"]) for r in state.breaker(frame).collect()}
    assert got == want
    stats = {r["domain"]: (r["failures"], r["trips"]) for r in state.breaker_stats(state.breaker(frame)).collect()}
    assert stats["five open"] == (0, 2)
    # The stream gives the same rows, in however many batches.
    for k in range(3):
        frame.where(f"event_id % 1000 >= {k * 4} AND event_id < {k * 4 + 4}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = []
    q = streams.breaker(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda b, n: out.extend(b.collect())).start()
    q.awaitTermination()
    assert {(r["domain"], r["event_id"]): (r["allowed"], r["failures"]) for r in out} == want


def test_streaming_dedup_equals_batch(spark, docs, tmp_path):
    want = {r["doc_id"]: r["reason"] for r in dedup.cascade(docs).collect()}
    run = streams.dedup_batches(str(tmp_path))
    parts = [docs.where("doc_id < 50"), docs.where("doc_id >= 50 AND doc_id < 90"), docs.where("doc_id >= 90")]
    for k, part in enumerate(parts):
        run(part, k)
    run(parts[2], 2)
    got = {r["doc_id"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "verdicts")).collect()}
    assert got == want


def test_streaming_upsert(spark, tmp_path):
    schema = "url string, title string, etag string, seq long"
    run = streams.upsert_batches(str(tmp_path))
    for k, rows in enumerate(([("a", "t0", "e0", 0)], [("a", "t1", "e1", 1), ("b", "u", "f", 2)])):
        run(spark.createDataFrame(rows, schema), k)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "v=1")).select("url", "title", "etag").collect()} == {("a", "t1", "e0"), ("b", "u", "f")}


def test_metrics(spark):
    values = [10.0, 60.0, 70.0, 300.0, 20000.0]
    events = spark.createDataFrame([(v, "x") for v in values], "value double, label string")
    buckets = metrics.histogram(events, "value")
    assert {r["le"]: r["cumulative"] for r in buckets.collect()}[100.0] == 3
    assert metrics.quantile(buckets, 0.5).first()["value"] == pytest.approx(50 + 50 * (2.5 - 1) / 2)
    assert metrics.quantile(buckets, 0.99).first()["value"] == 10000
    assert metrics.quantile(metrics.histogram(events.limit(0), "value"), 0.5).first()["value"] is None
    assert {r["label"]: r["n"] for r in metrics.totals(spark.createDataFrame([("",), (None,), ("a",)], "l string"), "l").collect()} == {"unknown": 2, "a": 1}


def test_crawl(spark):
    page = lambda title, *links: f"<html><title>{title}</title><body><article>{' '.join(title + str(k) for k in range(40))}</article>" + "".join(f'<a href="{u}">x</a>' for u in links) + "</body></html>"
    site = [(1, "http://h/", page("root", "/a", "/b", "http://other/")), (2, "http://h/a", page("a", "/c")), (3, "http://h/b", page("a")), (4, "http://h/c", page("c")), (5, "http://other/", page("other")), (6, "http://h/unlinked", page("u"))]
    web_pages = spark.createDataFrame(site, "page_id long, url string, html string")
    got = crawl.crawl(spark, ["http://H"], web_pages)
    assert {r["url"] for r in got["pages"].collect()} == {"http://h/", "http://h/a", "http://h/c"}
    assert {r["label"]: r["n"] for r in got["kinds"].collect()} == {"stored": 3, "near": 1} or {r["label"]: r["n"] for r in got["kinds"].collect()} == {"stored": 3, "exact": 1}
    assert {r["url"] for r in crawl.crawl(spark, ["http://h/"], web_pages, crawl.Settings(same_domain_only=False))["pages"].collect()} == {"http://h/", "http://h/a", "http://h/c", "http://other/"}
    assert crawl.crawl(spark, ["http://h/"], web_pages, crawl.Settings(max_pages=2))["processed"].count() == 2
    assert crawl.crawl(spark, ["http://nowhere/"], web_pages)["pages"].count() == 0
    lang = crawl.process(web_pages, crawl.Settings(target_languages=("xx",)))
    assert {r["status"] for r in lang.collect()} == {"lang_filtered"}
    assert web.seeds(spark, ["a"]).count() == 1


def test_crawl_reaches_the_end_of_a_chain(spark):
    """Hop by hop to the last page; there is no limit of rounds."""
    words = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(4)]
    rows = [(k, f"http://h/{k or ''}", f"<html><body><article><p>{words[k]}</p><a href='/{k + 1}'>next</a></article></body></html>") for k in range(4)]
    web_pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = crawl.crawl(spark, ["http://h/"], web_pages, crawl.Settings(max_pages=None))
    assert {r["label"]: r["n"] for r in got["kinds"].collect()} == {"stored": 4}


def test_process_with_semantic_layer(spark):
    rows = [(k, f"http://h/{k}", f"<article><p>{' '.join(f'w{k}x{j}' for j in range(30))}</p></article>") for k in range(4)]
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.05]), (3, None)], "page_id long, embedding array<double>")
    fetched = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["status"] for r in crawl.process(fetched, crawl.Settings(semantic_threshold=0.92), vectors).collect()}
    assert got == {0: "stored", 1: "stored", 2: "semantic", 3: "stored"}
    hashed = crawl.process(fetched, crawl.Settings(semantic_threshold=0.999))
    assert hashed.where("status = 'stored'").count() == 4


# Fixes by definition: repeated edges, stored pages as the limit, batches of a stream.


def test_the_limit_of_a_crawl_counts_stored_pages(spark):
    """Six pages, of which three are copies: a limit of three stores three."""
    page = "<html><body><article><p>{}</p></article></body></html>"
    texts = ["the same text on three pages and more of it"] * 3 + [f"another {w} text with {w} words that nobody else has, {w}" for w in ("first", "second", "third")]
    pages = spark.createDataFrame([(k, f"https://x.example/{k}", page.format(t)) for k, t in enumerate(texts)], "page_id long, url string, html string")
    got = crawl.crawl(spark, pages.select("url"), pages, crawl.Settings(max_pages=3))
    assert got["pages"].count() == 3


ODD = [(1, "a b c d"), (1, "e f g h"), (2, "a b c d"), (None, "i j k l"), (None, "i j k l"), (None, "a b c d"), (3, None), (4, ""), (3, None), (5, "a b c d"), (5, "a b c d"), (6, "e f g h"), (7, "m n o p")]


@pytest.mark.parametrize("seed", range(2))
def test_a_stream_of_batches_gives_the_verdicts_of_one_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [*ODD, *((rng.randrange(8, 40), " ".join(rng.choice(("red", "blue", "green", "x")) for _ in range(rng.randrange(1, 4)))) for _ in range(20))]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    schema = "doc_id long, text string"
    want = sorted(map(repr, dedup.cascade(spark.createDataFrame(rows, schema)).collect()))
    run = streams.dedup_batches(str(tmp_path / "t"))
    # A batch begins with a new id; the rows without one are the last.
    starts = sorted(rng.sample([k for k in range(1, len(rows)) if rows[k][0] != rows[k - 1][0]], 2))
    for number, (a, b) in enumerate(zip([0, *starts], [*starts, len(rows)])):
        part = spark.createDataFrame(rows[a:b], schema).repartition(2)
        run(part, number)
        if number == 1:
            run(part, number)  # after a failure
    got = spark.read.parquet(str(tmp_path / "t" / "verdicts")).select("doc_id", "is_dup", "reason")
    assert sorted(map(repr, got.collect())) == want


def test_a_batch_of_odd_rows(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "c")]
    verdicts, kept = streams.judge_batch(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], streams.KEPT_SCHEMA))
    assert sorted(map(repr, verdicts.collect())) == sorted(map(repr, dedup.cascade(spark.createDataFrame(rows, "doc_id long, text string")).collect())) and kept.count() == 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert streams.judge_batch(empty, spark.createDataFrame([], streams.KEPT_SCHEMA))[0].collect() == []


def test_first_seen_and_rates_of_a_stream(spark, tmp_path):
    events = [("u1", "2024-01-01 00:00:01", "a"), ("u1", "2024-01-01 00:00:05", "a"), ("u2", "2024-01-01 00:00:30", "b"), ("u3", "2024-01-01 00:01:10", "a")]
    spark.createDataFrame(events, "url string, ts string, label string").selectExpr("url", "timestamp(ts) AS ts", "label").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("url string, ts timestamp, label string").parquet(str(tmp_path / "in"))

    def rows(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["url"] for r in rows(streams.first_seen(stream()), "seen1", "append")) == ["u1", "u2", "u3"]
    assert sorted(r["url"] for r in rows(streams.first_seen(stream(), ts="ts"), "seen2", "append")) == ["u1", "u2", "u3"]
    got = {(str(r["window_start"]), r["label"]): r["rate"] for r in rows(streams.rate(stream(), "ts", "label"), "rates", "complete")}
    assert got == {("2024-01-01 00:00:00", "a"): 2 / 60, ("2024-01-01 00:00:00", "b"): 1 / 60, ("2024-01-01 00:01:00", "a"): 1 / 60}
