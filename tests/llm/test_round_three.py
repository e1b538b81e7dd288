"""Whitening, document fingerprints and vector codes: against plain versions, with odd rows."""

from __future__ import annotations

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import fingerprints, vector_codes, vectors, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<double>, label int"


def odd_vectors(n=300, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(k, [float(x) for x in rng.normal(0, 0.3, dim)], k % 3) for k in range(n)]
    rows += [(k + n, rows[0][1], None) for k in range(n // 2)]  # a group of copies of a third of all rows
    rows += [(9000, None, 1), (9001, [0.1] * (dim - 1) + [NAN], 1), (9002, [INF] * dim, 1), (9003, [None] + [0.2] * (dim - 1), 1), (9004, [], 2), (9005, [0.0] * dim, 2), (None, [0.5] * dim, 2)]
    rows += [(9006, [-0.25] * (dim + 1), 2), (9007, [1e300] * dim, 2), (9008, [40000.0] + [-0.0] * (dim - 1), 2), (5, rows[7][1], 0)]
    return rows


def kept_of(rows, dim, scale):
    good = [r for r in rows if r[1] is not None and len(r[1]) == dim and all(v is not None and math.isfinite(v) and abs(v * scale) < vectors.LIMIT - 1 for v in r[1])]
    return good, np.array([[math.floor(scale * v) for v in r[1]] for r in good], dtype=np.int64).reshape(len(good), dim)


def plain_whitening(x, scale_shift=whitening.SHIFT):
    x = x + scale_shift
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = (n * fit - sums) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return n, [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x], (n * x - sums) / n @ u, e


def test_packed_rows_are_read_back():
    x = np.array([[0, 1, -1], [127, -128, 5], [128, 0, 0], [-129, 0, 0], [32767, -32768, 0], [32768, 0, 0], [vectors.LIMIT - 1, 1 - vectors.LIMIT, 0]])
    codes = vectors.packed(x)
    assert [len(c) for c in codes] == [4, 4, 7, 7, 7, 13, 13] and (vectors.unpacked(codes, 3) == x).all()
    assert vectors.packed(np.zeros((2, 0), dtype=np.int64)) == [b"\0", b"\0"]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 8))
def test_merges_lose_nothing(seed, sizes, dim):
    rng = np.random.default_rng(seed)
    parts = [rng.integers(-50, 50, (n, dim)) * 10 ** rng.integers(0, 3) + 1_000_000 for n in sizes]
    found = whitening.summary(parts[0])
    for p in parts[1:]:
        found = whitening.joined(found, whitening.summary(p))
    every = np.vstack(parts)
    centred = every - every.mean(axis=0)
    want = centred.T @ centred
    assert found[0] == len(every) and found[1] == every.sum(axis=0).tolist()
    assert np.allclose((found[2][:, None] * found[3]).T @ (found[2][:, None] * found[3]), want, rtol=1e-9, atol=1e-9 * (1 + np.abs(want).max()))


def test_whitening_against_eigenvectors(spark):
    dim = 12
    rows = odd_vectors(dim=dim)
    given_ = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS component", "1 AS n").repartition(7)
    found = whitening.whiten(given_).collect()
    good, x = kept_of(rows, dim, whitening.SCALE)
    n, deviation, projected, e = plain_whitening(x)
    by_component = {}
    for r in found:
        by_component.setdefault((r["vec_id"], r["deviation"], r["n"]), {})[r["component"]] = r
    rest = [r for r in found if r["n"] == n]
    assert len(rest) == len(good) * min(dim, 16) and len({r["identity_error"] for r in rest}) == 1 and rest[0]["identity_error"] < 1e-6
    signs = None
    for (vec_id, *_), d, p in zip(good, deviation, projected):
        own = by_component[(vec_id, d if d < 1 << 63 else None, n)]
        got = np.array([own[k + 1]["whitened"] for k in range(dim)]) * np.sqrt(e)
        if signs is None:
            signs = np.sign(got * p)
        assert np.allclose(got, signs * p, rtol=1e-6, atol=1e-6 * np.abs(projected).max())
    for r in rest:
        assert math.isclose(r["explained"], e[r["component"] - 1] / e.sum(), rel_tol=1e-6)
    # One vector of another length: no variance.
    alone = [r for r in found if r["vec_id"] == 9006]
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(alone, key=lambda r: r["component"])] == [(k, 1, 0, 0.0, 0.0, 0.0) for k in range(1, 14)]


def test_whitening_of_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1), (2, [], 1)], VECTORS)).collect() == []


def test_whitening_of_a_flat_space(spark):
    """Vectors of a plane in six dimensions: two components have variance, the others are zero."""
    rng = np.random.default_rng(1)
    rows = [(k, [float(a), float(b), float(a + b), 0.0, 1.0, float(a - b)], 0) for k, (a, b) in enumerate(rng.integers(-9, 9, (200, 2)))]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert all((r["whitened"] == 0) == (r["component"] > 2) or r["component"] <= 2 for r in found) and found[0]["identity_error"] < 1e-9
    assert math.isclose(sum(r["explained"] for r in found if r["vec_id"] == 0), 1.0)


def test_deviation_beyond_64_bits(spark):
    rows = [(k, [float(1 << 24) * (k % 2), float(k)], 0) for k in range(60)]
    found = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    x = kept_of(rows, 2, whitening.SCALE)[1]
    for k, d in enumerate(plain_whitening(x)[1]):
        assert found[k, 1]["deviation"] == (d if d < 1 << 63 else None)


# Vector codes


def plain_codes(ids, x, labels):
    """All distances in each round."""
    order = sorted(range(len(x)), key=lambda k: (ids[k] is None, ids[k] or 0, vectors.packed(x[k : k + 1])[0]))
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % 4))).astype(object)
    parts = np.split(x, 4, axis=1)
    books = [[p[k] for k in order[:256]] for p in parts]

    def assigned():
        out = []
        for p, book in zip(parts, books):
            d = np.stack([((p - e) ** 2).sum(axis=1) for e in book], axis=1) if p.shape[1] else np.zeros((len(p), len(book)), dtype=object)
            at = d.argmin(axis=1)
            out.append((at, d[np.arange(len(p)), at]))
        return out

    for _ in range(4):
        for (at, _), p, book in zip(assigned(), parts, books):
            for k in range(len(book)):
                own = p[at == k]
                if len(own):
                    book[k] = np.array([int(s) // len(own) for s in own.sum(axis=0)], dtype=object)
    found = assigned()
    error = [sum(int(f[1][k]) for f in found) for k in range(len(x))]
    by_label = {}
    for e, label in zip(error, labels):
        by_label[label] = by_label.get(label, 0) + e
    text = ",".join(str(v) for book in books for e in book for v in e)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return [(i, "".join(f"{int(f[0][k]):02x}" for f in found), error[k], by_label, sha) for k, i in enumerate(ids)]


@pytest.mark.parametrize(("n", "dim"), [(700, 12), (90, 10)])
def test_codes_against_all_distances(spark, n, dim):
    rows = odd_vectors(n, dim)
    found = vector_codes.codes(spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS code", "2 AS x", "3 AS dim").repartition(5)).collect()
    want, labels = [], {}
    for size in (0, dim, dim + 1):
        good, x = kept_of(rows, size, vector_codes.SCALE)
        for row in plain_codes([r[0] for r in good], x, [r[2] for r in good]) if len(good) else []:
            want.append(row)
        for r, row in zip(good, want[-len(good) :] if good else []):
            labels[r[2]] = labels.get(r[2], 0) + row[2]
    label_of = {}
    for r in rows:
        label_of.setdefault(r[0], []).append(r[2])
    assert sorted(map(repr, ((r["vec_id"], r["code"], r["error"], r["codebooks_sha256"]) for r in found))) == sorted(map(repr, ((a, b, c, e) for a, b, c, _, e in want)))
    for r in found:
        assert any(r["label_error"] == labels[label] for label in label_of[r["vec_id"]])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 40), st.sampled_from([2, 30, 4000, 1 << 29]))
def test_bounds_keep_nearest_and_ties(seed, dim, entries, spread):
    """Ten rounds of moves: with bounds, the index is always that of a full comparison, ties to the lower index."""
    rng = np.random.default_rng(seed)
    x, c = rng.integers(-spread, spread, (60, dim)), rng.integers(-spread, spread, (entries, dim))
    book = vector_codes.Codebook(c)
    at, upper, lower = book.nearest(x)
    scans = 0
    for _ in range(10):
        c = c + (rng.integers(-1, 2, c.shape) * (rng.random((entries, 1)) < 0.3)) * max(1, spread // 50)
        book = vector_codes.Codebook(c, book.entries)
        scans += book.again(x, at, upper, lower)
        want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(row, e)), k) for k, e in enumerate(c.tolist())) for row in x.tolist()]
        assert at.tolist() == [k for _, k in want] and book.squares(x, at).tolist() == [d for d, _ in want]
    assert scans <= 600


def test_bounds_spare_most_comparisons():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (32, 8))
    x = centres[rng.integers(0, 32, 4000)] + rng.integers(-40, 40, (4000, 8))
    book = vector_codes.Codebook(centres)
    state = book.nearest(x)
    book = vector_codes.Codebook(centres + rng.integers(-10, 10, centres.shape), book.entries)
    assert book.again(x, *state) < 400


def test_codes_of_no_rows(spark):
    assert vector_codes.codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.codes(spark.createDataFrame([(1, None, 1), (2, [NAN], None)], VECTORS)).collect() == []


# Fingerprints


def plain_votes(text: str):
    """Terms with their weights."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    counts = {}
    for t in [*((w,) for w in words), *zip(words, words[1:])]:
        counts[t] = counts.get(t, 0) + 1
    return {t: round(fingerprints.STEPS * (1 + math.log(n))) for t, n in counts.items()}


def plain_fingerprint(text: str) -> int:
    """Votes of each term alone, its hash taken from a text of that term by the operator's own hash of terms."""
    total = np.zeros(fingerprints.BITS, dtype=np.int64)
    for term, weight in plain_votes(text).items():
        data = " ".join(term).encode()
        h, _, _ = fingerprints.terms(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
        if len(term) == 2:
            singles = [fingerprints.terms(np.frombuffer(w.encode(), dtype=np.uint8), np.array([0, len(w.encode())]))[0] for w in term]
            h = np.setdiff1d(h, np.concatenate(singles))
        (h,) = h.tolist()
        for lane in range(fingerprints.BITS // 64):
            with np.errstate(over="ignore"):
                bits = int(fingerprints.mix(np.uint64(h) + np.uint64((lane + 1) * fingerprints._LANE & (1 << 64) - 1)))
            total[64 * lane : 64 * lane + 64] += np.array([weight if bits >> k & 1 else -weight for k in range(64)])
    return sum(1 << (64 * (k // 64) + k % 64) for k in np.flatnonzero(total > 0).tolist())


def as_int(hexed: str) -> int:
    return sum(int(hexed[16 * k : 16 * k + 16], 16) << (64 * k) for k in range(len(hexed) // 16))


LONG = " ".join(f"wort{k % 977} über {k}" for k in range(60_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, the quick one"), (2, "The quick brown fox jumps over the lazy dog, the quick one"), (3, None), (4, ""), (5, " \t\n "), (6, "a"), (7, "ÄÖÜ ß 漢字 🙂 🙂🙂 漢字"),
    (8, "x " * 500), (9, LONG), (None, "no id here"), (10, "The Quick BROWN fox jumps over the lazy dog, the quick one"), (10, "same id, another text"), (-5, "last by id"), (11, "ab"), (12, "abc"),
]


@pytest.mark.parametrize("pieces", [1, 3, 40])
def test_edited_texts(spark, pieces):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 AS piece", "'q' AS f0", "2 AS tie").repartition(5)
    lanes = fingerprints.BITS // 64
    found = fingerprints.edited(docs, pieces=pieces).withColumn("fp", fingerprints.hex_of()).withColumn("ep", fingerprints.hex_of("e")).collect()
    ties = {(r["doc_id"], r["text"]): r["t"] for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS t").collect()}
    rows = sorted(TEXTS, key=lambda r: (r[0] is None, -(r[0] or 0), ties[r]))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        own, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(own) // 3
        new = own[: len(own) - n] + after[:n]
        fp, ep, nx = (plain_fingerprint(t) if len(t) < 10_000 else None for t in (own, new, after))
        same = lambda a, b: None if a is None or b is None else 1 - (a ^ b).bit_count() / fingerprints.BITS
        want.append((doc_id, len(own), hashlib.sha256(new.encode()).hexdigest(), fp, ep, same(fp, ep), same(fp, nx)))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], as_int(r["fp"]), as_int(r["ep"]), r["near_edited"], r["near_next"]) for r in found]
    assert len(got) == len(want) and lanes * 16 == len(found[0]["fp"])
    for g, w in zip(sorted(got, key=lambda r: r[2]), sorted(want, key=lambda r: r[2])):
        assert all(b is None or a == b for a, b in zip(g[1:], w[1:])) and g[0] == w[0], (g[0], w[0])


def test_edited_of_one_and_no_document(spark):
    schema = "doc_id long, text string"
    assert fingerprints.edited(spark.createDataFrame([], schema)).collect() == []
    (r,) = fingerprints.edited(spark.createDataFrame([(7, "abcdef")], schema)).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and r["near_next"] == 1


def plain_links(fps, radius):
    n = len(fps)
    near = [[i != j and (fps[i] ^ fps[j]).bit_count() <= radius for j in range(n)] for i in range(n)]
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near[i][j] and low[j] < low[i]:
                    low[i] = low[j]
                    changed = True
    return [sum(r) for r in near], low


@pytest.mark.parametrize("block", [4096, 3])
def test_block_tables_find_all_within_the_radius(spark, block):
    """Planted chains at each distance up to and beyond the radius, with errors spread over blocks or in one."""
    rng = np.random.default_rng(9)
    fps = []
    for _ in range(12):
        fp = int.from_bytes(rng.bytes(32), "little")
        fps += [fp] * int(rng.integers(1, 4))
        for distance in (1, 4, 7, 8, 9, 15):
            bits = rng.choice(256, distance, replace=False) if distance % 2 else rng.choice(32, distance, replace=False) + 32 * int(rng.integers(0, 8))
            other = fp
            for b in bits.tolist():
                other ^= 1 << b
            fps.append(other)
            if rng.random() < 0.4:
                fp = other
    # A run of a table that is far larger than a cell: half of all fingerprints have the same first block.
    first = int(rng.integers(0, 1 << 32))
    for _ in range(60):
        fp = (int.from_bytes(rng.bytes(28), "little") << 32) | first
        fps += [fp, fp ^ (1 << 200) ^ (1 << 90)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, *(signed(fp >> (64 * lane) & (1 << 64) - 1) for lane in range(4))) for k, fp in enumerate(fps)]
    marked = spark.createDataFrame(rows, "doc_id long, f0 long, f1 long, f2 long, f3 long").repartition(4)
    found = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in fingerprints.joined(marked, block=block).collect()}
    n, low = plain_links(fps, fingerprints.RADIUS)
    assert found == {k: (n[k], low[k]) for k in range(len(fps))}


def test_near_documents(spark):
    docs = [(k, f"text {k % 4} with some words of its own {'and a great many more ' * 9}" if k < 8 else None) for k in range(12)]
    found = {r["doc_id"]: r for r in fingerprints.near(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[0]["fingerprint"] == found[4]["fingerprint"] and found[4]["component_id"] == 0 and found[8]["component_id"] == 8 and found[11]["n_links"] == 3
    assert fingerprints.near(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_edited_texts_are_nearer_than_others(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["op12_fingerprints"](spark, SF).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.97


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_whitening_query(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["op11_whitening"](spark, SF).collect()
    given_ = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    n, deviation, projected, e = plain_whitening(np.array([[math.floor(64 * v) for v in x] for _, x in given_], dtype=np.int64))
    at = {k: i for i, (k, _) in enumerate(given_)}
    assert len(rows) == 16 * len(given_)
    signs = {r["component"]: np.sign(r["whitened"] * projected[at[r["vec_id"]], r["component"] - 1]) for r in rows if r["vec_id"] == given_[0][0]}
    for r in rows:
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[at[r["vec_id"]]] and math.isclose(r["explained"], e[k] / e.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9
        assert abs(r["whitened"] - signs[k + 1] * projected[at[r["vec_id"]], k] / math.sqrt(e[k])) < 1e-8
