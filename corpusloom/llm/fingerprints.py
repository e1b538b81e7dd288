"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius by permuted block tables.

A text's terms are its words (lower case, cut at white space) and pairs of neighbouring words. Each distinct term has a hash of BITS bits and a weight, STEPS * (1 +
ln(times it occurs)), rounded to a whole number; it votes for a bit with its weight where its hash has a one, against it else, and a bit of the fingerprint is 1
if its sum is above zero. So two texts agree in a share of 1 - angle / 180 degrees of all bits, the angle being that of their weight vectors. Sums are of whole
numbers: equal texts have equal fingerprints wherever they are computed.

To find all fingerprints within `radius` bits of one another, the bits are cut into radius + 1 blocks. Of at most `radius` errors one block stays free, so two
such fingerprints are equal in some block. There is a table for each block: the bits permuted so that the block leads, rows dealt by the leading
block. A run of a table with more than BLOCK rows is dealt to cells of piece against piece. Pairs count in the first table that they share.

Edge cases: a null or empty text, or one of white space, has fingerprint zero, like any text without terms; two of them are alike by 1. Very long texts are read
whole; rows keep their multiplicity; rows that repeat an id follow one another by a hash of their texts, equal ones in any order. Null ids come last. The only row's next
is itself. Other columns are not read, so they cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import LOWER, NOT_SPACE, chunks, column_of, mix, spans_hash, words
from .graphs import cells, components, lowest, runs, stars, whole_runs
from .sparkutil import cut

BITS = 256
RADIUS = 7
STEPS = 64
#: Distinct fingerprints of one run of a table that are compared in one cell.
BLOCK = 4096
#: A fingerprint with more than one row in so many is frequent; there are fewer than so many of them, whatever the input.
FREQUENT = 1000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANE = 0xD1342543DE82EF95
#: +1 or -1 for each bit of each byte, lowest bit first.
_SIGNS = (2 * (np.arange(256)[:, None] >> np.arange(8) & 1) - 1).astype(np.float64)
#: Stands for a null id, below others.
_FIRST = 1 - (1 << 63)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, times) of the distinct terms of whole texts, sorted by text and hash."""
    data = LOWER[data]
    starts, ends, text = words(data, offsets, NOT_SPACE)
    word = spans_hash(data, starts, ends)
    pairs = np.flatnonzero(text[1:] == text[:-1])
    h = np.concatenate([mix(word + _STEP), mix(word[pairs] * _STEP + word[pairs + 1])])
    owner = np.concatenate([text, text[pairs]])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), dtype=bool), (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]))
    return h[new], owner[new], np.diff(np.append(new, len(h)))


def fingerprint_texts(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(texts, bits / 64) words of whole texts' fingerprints."""
    n = len(offsets) - 1
    h, owner, times = terms(data, offsets)
    weight = np.rint(STEPS * (1 + np.log(times)))
    out = np.zeros((n, bits // 8), dtype=np.uint8)
    at = owner * 256
    for lane in range(bits // 64):
        octets = mix(h + np.uint64((lane + 1) * _LANE & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            # The weights by byte value are enough: eight bits' votes are one product.
            votes = np.bincount(at + octets[:, k], weights=weight, minlength=n * 256).reshape(n, 256) @ _SIGNS
            out[:, 8 * lane + k] = np.packbits(votes > 0, axis=1, bitorder="little").ravel()
    return out.view(np.uint64)


def _of(texts: pa.Array, bits: int) -> np.ndarray:
    """Fingerprints of a text column."""
    found = [fingerprint_texts(data, offsets, bits) for _, _, data, offsets in chunks(texts, 1 << 19)]
    return np.concatenate(found) if found else np.zeros((0, bits // 64), dtype=np.uint64)


def _hex(fp: np.ndarray) -> list[str]:
    raw, step = fp.astype(">u8").tobytes().hex(), 16 * fp.shape[1]
    return [raw[i : i + step] for i in range(0, len(raw), step)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1) / (64 * a.shape[1])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """docs (or its columns keep) with each text's fingerprint in the long columns f0, f1 and so on."""
    lanes = [f"f{k}" for k in range(bits // 64)]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in lanes]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in lanes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _of(column_of(batch, text), bits).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in kept), *(pa.array(x) for x in fp.T)], [*kept, *lanes])

    return docs.select(*kept, *([] if text in kept else [text])).mapInArrow(run, schema)


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pieces: int | None = None) -> DataFrame:
    """(piece, copy, id, tie, text) of all rows, dealt by piece and sorted so that each row stands before the next by descending id.

    Pieces are ranges of ids between quantiles. The largest id of each is the first in this order; its row is copied to the end of the piece before,
    that of the whole table to the end of the last. So texts are shuffled once.
    """
    spark = docs.sparkSession
    pieces = pieces or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.greatest(F.col(doc_id).cast("long"), F.lit(_FIRST))  # of nulls and the number, the number
    shares = [k / pieces for k in range(1, pieces)] or [0.5]
    ids_ = docs.select(key.alias("k"))
    # Quantiles of large ids are not exact: the largest id that is there up to each of them is.
    cuts = np.array(sorted(set(ids_.agg(F.percentile_approx("k", shares, max(10_000, 20 * pieces))).first()[0] or [])), dtype=np.int64)

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = np.searchsorted(cuts, ids)
            for k in np.unique(at).tolist():
                most[k] = max(most.get(k, _FIRST), int(ids[at == k].max()))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.int64())], ["at", "k"])

    bounds = np.array(sorted(r["k"] for r in ids_.mapInArrow(largest, "at int, k long").groupBy("at").agg(F.max("k").alias("k")).collect()), dtype=np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, int] = {}  # the smallest tie that was copied of each id: what is larger need not be
        names = ["piece", "copy", "id", "tie", "text"]
        for batch in batches:
            ids, tie, texts = column_of(batch, "k").to_numpy(), column_of(batch, "tie"), column_of(batch, "text")
            piece = np.searchsorted(-bounds[::-1], -ids, side="right") - 1  # the largest bound's is piece 0
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(np.zeros(len(ids), dtype=bool)), column_of(batch, "id"), tie, texts], names)
            copied = []
            for i in np.flatnonzero(np.isin(ids, bounds)).tolist():
                k, t = int(ids[i]), tie[i].as_py()
                if k not in sent or t < sent[k]:
                    sent[k] = t
                    copied.append(i)
            if copied:
                at = pa.array(copied)
                before = (piece[copied] - 1) % len(bounds)
                yield pa.RecordBatch.from_arrays([pa.array(before.astype(np.int32)), pa.array(np.ones(len(copied), dtype=bool)), *(x.take(at) for x in (column_of(batch, "id"), tie, texts))], names)

    source = docs.select(key.alias("k"), F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    kind = source.schema["id"].dataType.simpleString()
    dealt = source.select("k", "id", "tie", "text").mapInArrow(deal, f"piece int, copy boolean, id {kind}, tie long, text string")
    return dealt.repartition("piece").sortWithinPartitions("piece", "copy", F.col("id").desc_nulls_last(), "tie")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, pieces: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, f0..., e0..., near_edited, near_next): fingerprints of each text and of its edited text, whose last third of code points
    makes room for as many of the next document's first, in descending order of ids (after the last: the first)."""
    rows = with_next(docs, doc_id, text, pieces)
    kind = rows.schema["id"].dataType.simpleString()
    lanes = bits // 64
    names = ["doc_id", "n_chars", "edited_sha256", *(f"f{k}" for k in range(lanes)), *(f"e{k}" for k in range(lanes)), "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows wait for the one that follows them in their piece.
        held: tuple[int, list, list[str], np.ndarray] | None = None  # piece, ids, texts, fingerprints of rows without their next

        def done(ids: list, texts: list[str], fp: np.ndarray) -> pa.RecordBatch:
            """Of all rows but the last, which is only next."""
            own, after, changed = texts[:-1], texts[1:], []
            for a, b in zip(own, after):
                n = len(a) // 3
                changed.append(a[: len(a) - n] + b[:n])
            ep = _of(pa.array(changed, pa.large_string()), bits)
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in changed]
            columns = [pa.array(ids[:-1], source), pa.array([len(a) for a in own], pa.int64()), pa.array(sha), *(pa.array(x) for x in fp[:-1].view(np.int64).T), *(pa.array(x) for x in ep.view(np.int64).T)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(likeness(fp[:-1], ep)), pa.array(likeness(fp[:-1], fp[1:]))], names)

        for batch in batches:
            source = column_of(batch, "id").type
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                piece, copy = column_of(part, "piece").to_numpy(), column_of(part, "copy").to_numpy(zero_copy_only=False)
                all_ids, all_texts = column_of(part, "id").to_pylist(), column_of(part, "text").to_pylist()
                begin, end = runs([piece, copy])
                for a, b in zip(begin.tolist(), end.tolist()):
                    if copy[a]:
                        # Only the first copy after a piece's rows is their next.
                        if held is not None and held[0] == piece[a]:
                            last = _of(pa.array(all_texts[a : a + 1], pa.large_string()), bits)
                            yield done([*held[1], None], [*held[2], all_texts[a]], np.concatenate([held[3], last]))
                        held = None
                        continue
                    ids, texts, fp = all_ids[a:b], all_texts[a:b], _of(pa.array(all_texts[a:b], pa.large_string()), bits)
                    if held is not None:
                        ids, texts, fp = [*held[1], *ids], [*held[2], *texts], np.concatenate([held[3], fp])
                    if len(ids) > 1:
                        yield done(ids, texts, fp)
                    held = piece[a], ids[-1:], texts[-1:], fp[-1:]

    words_ = ", ".join(f"{c} long" for c in names[3 : 3 + 2 * lanes])
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, {words_}, near_edited double, near_next double")


def hex_of(prefix: str = "f", bits: int = BITS):
    """Column of the hexadecimal digits of a fingerprint in columns prefix0, prefix1 and so on."""
    return F.concat(*(F.lower(F.lpad(F.hex(f"{prefix}{k}"), 16, "0")) for k in range(bits // 64)))


def _blocks(bits: int, radius: int) -> list[tuple[int, int]]:
    """(first bit, size) of radius + 1 blocks within 64-bit words."""
    if (radius + 1) % (bits // 64):
        raise ValueError("radius + 1 must be a multiple of the fingerprint's 64-bit words")
    each = (radius + 1) // (bits // 64)
    edges = [round(64 * k / each) for k in range(each + 1)]
    return [(64 * lane + a, b - a) for lane in range(bits // 64) for a, b in zip(edges, edges[1:])]


def _leading(fp: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """(rows, tables) leading blocks."""
    out = [fp[:, at // 64] >> np.uint64(at % 64) & np.uint64((1 << size) - 1) for at, size in blocks]
    return np.stack(out, axis=1)


def links(distinct: DataFrame, radius: int = RADIUS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(u, n, v) from distinct(node, n, f0...): for each fingerprint with others within the radius, the number of their documents in parts (v is null), and edges
    (u, v) that span the groups (n is null). No list of all pairs is made."""
    blocks, lanes = _blocks(bits, radius), [f"f{k}" for k in range(bits // 64)]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.stack([column_of(batch, c).to_numpy() for c in lanes], axis=1).view(np.uint64)
            lead = _leading(fp, blocks)
            for t in range(len(blocks)):
                key = (mix(lead[:, t]) & np.uint64((1 << 56) - 1)).view(np.int64) | np.int64(t) << 56
                yield pa.RecordBatch.from_arrays([pa.array(key), column_of(batch, "node")], ["key", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, ["key", "i", "j"]):
            key, i, j, piece, node, n = (run.column(c).to_numpy() for c in ("key", "i", "j", "piece", "node", "n"))
            fp = np.stack([run.column(c).to_numpy() for c in lanes], axis=1).view(np.uint64)
            lead = _leading(fp, blocks)
            others, us, vs = np.zeros(len(key), dtype=np.int64), [], []
            begin, end = runs([key, i, j])
            for a, b in zip(begin.tolist(), end.tolist()):
                if b - a < 2:
                    continue
                same, t = i[a] == j[a], int(key[a]) >> 56
                left = np.arange(a, b) if same else a + np.flatnonzero(piece[a:b] == i[a])
                right = left if same else a + np.flatnonzero(piece[a:b] == j[a])
                for at in range(0, len(left), 256):
                    some = left[at : at + 256]
                    differ = sum(np.bitwise_count(fp[some, None, k] ^ fp[None, right, k]).astype(np.int32) for k in range(len(lanes)))
                    p, q = np.nonzero(differ <= radius)
                    p, q = some[p], right[q]
                    first = (p != q) & (lead[p, t] == lead[q, t]) & ~(lead[p, :t] == lead[q, :t]).any(axis=1)
                    p, q = p[first], q[first]
                    if len(p):
                        np.add.at(others, p, n[q])
                        if not same:
                            np.add.at(others, q, n[p])
                        u, v = stars(node[p], node[q])
                        us.append(u)
                        vs.append(v)
            found = np.flatnonzero(others)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(others[found]), pa.nulls(len(found), pa.int64())], ["u", "n", "v"])
                pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.nulls(pairs.shape[1], pa.int64()), pa.array(pairs[1])], ["u", "n", "v"])

    # Runs of a single row have no pair; only rows of the others bring their fingerprints along.
    dealt = cells(distinct.select("node", *lanes).mapInArrow(tables, "key long, node long"), "key", "node", block)
    dealt = dealt.select("key", "i", "j", "piece", "node").join(distinct.select("node", "n", *lanes), "node")
    parts = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return parts.select("key", "i", "j", "piece", "node", "n", *lanes).mapInArrow(compare, "u long, n long, v long")


def groups(marked: DataFrame, radius: int = RADIUS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(f0..., n_links, component_id) of each distinct fingerprint of marked(doc_id, f0...): how many other documents are within the radius of one of its, and the
    smallest id reachable by such links."""
    lanes = [f"f{k}" for k in range(bits // 64)]
    distinct = cut(marked.groupBy(*lanes).agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    found = cut(links(distinct, radius, bits, block))
    partners = found.where("n IS NOT NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    roots = components(found.where("v IS NOT NULL").select("u", "v"))
    whole = lowest(distinct.join(partners, "node", "left"), roots, "node", "low")
    return whole.select(*lanes, (F.coalesce("others", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), "component_id", "n")


def near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, n_links, component_id) of each row."""
    marked = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"], bits=bits))
    return joined(marked, radius, bits, block).select("doc_id", hex_of("f", bits).alias("fingerprint"), "n_links", "component_id")


def joined(marked: DataFrame, radius: int = RADIUS, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """marked(doc_id, f0..., ...), which is read several times, with n_links and component_id. Rows of frequent fingerprints stay where they are."""
    lanes = [f"f{k}" for k in range(bits // 64)]
    found = cut(groups(marked, radius, bits, block))
    frequent = F.col("n") * FREQUENT > marked.count()
    hidden = {c: f"_{c}" for c in lanes}
    few = found.where(frequent).drop("n").withColumnsRenamed(hidden)
    rows = marked.join(F.broadcast(few), [F.col(c) == F.col(h) for c, h in hidden.items()], "left")
    rest = rows.where("_f0 IS NULL").select(*marked.columns).join(found.where(~frequent).drop("n"), lanes)
    columns = [*marked.columns, "n_links", "component_id"]
    return rows.where("_f0 IS NOT NULL").select(*columns).unionByName(rest.select(*columns))
