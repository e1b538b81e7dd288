"""LM scoring with a weighted backoff automaton that is learnt from, and dealt out over, the whole corpus.

Tokens are maximal runs of characters other than white space (A-Z lower-cased), then one end of text. The n-grams of up to
`order` - 1 tokens that the training texts have are the automaton's states, beside the root. From state h there is an arc under
token w for each n-gram hw of the training texts, of weight

    p(w | h) = (c(hw) + mu * p(w | h')) / (c(h) + mu),    p(w) = (c(w) + 1) / (N + V + 1)

with h' the state one token shorter, to the longest suffix of hw that is a state; h has a failure arc to h', of weight
mu / (c(h) + mu), that reads nothing. The root has an arc under every token. These are Dirichlet-smoothed n-grams in backoff
form: each state's arcs and failure arc add up to one. A text starts in the state of the start mark and is traversed once from left to
right: follow the arc, or take failure arcs until there is one, add up log10 of the weights, carry the state reached. The
texts of a block are traversed side by side, one token of each at a step. A long text is cut into stretches that are
traversed side by side as well: the state before any token is the longest state among the suffixes of the tokens before.

The model grows with the corpus, so it is never in one place. Texts are dealt to blocks of bounded size by a hash of id and text. Each block
asks for the counts of its own n-grams: sorted hashes, cut into ranges and packed. A range adds up the counts of all
blocks and answers each block with those totals that differ from its own count. So most n-grams that occur in one
block only cost nothing on the way back, and no count is dropped: there is no cutoff. From the totals a block builds the part of the
automaton that its own texts can reach. Hashes have 22 bits more than the number of the corpus's n-grams
has (LEAST_BITS at least, 64 at most), so that about one in 2^22 n-grams or fewer shares its hash with another.

Edge cases: a null or empty text, or one of white space, is the end token alone; a null id is in the remainder 0 and
trains; rows with equal ids, or all equal, are texts of their own with equal scores. With no training text N = V = 0. An empty table
gives an empty result. Only id and text are read, so other columns cannot clash. Texts are never cut off; a block
holds whole texts, and takes some 150 bytes of memory a token.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import LOWER, NOT_SPACE, chunks, column_of, mix, spans_hash, words

ORDER = 3
#: mu of states of one token, of two, ...: the last holds for longer ones.
MU = (32.0, 32.0)
#: UTF-8 bytes of the texts of a block, about; and n-grams that a range adds up, about.
BLOCK_BYTES = 5 << 20
RANGE_ENTRIES = 1 << 20
#: Tokens of a stretch of text that one traversal reads.
STRETCH = 128
#: Bits of the hashes of n-grams at least.
LEAST_BITS = 52
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def pack(x: np.ndarray) -> bytes:
    """Small unsigned numbers as compressed byte planes, without the planes that are all zero."""
    x = np.ascontiguousarray(x, dtype=np.uint64)
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = zlib.compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)
    return struct.pack("<QBQ", len(x), width, len(planes)) + planes


def unpack(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(numbers, place after them)."""
    n, width, size = struct.unpack_from("<QBQ", blob, at)
    x = np.zeros((n, 8), dtype=np.uint8)
    x[:, :width] = np.frombuffer(zlib.decompress(blob[at + 17 : at + 17 + size]), dtype=np.uint8).reshape(width, n).T
    return x.view(np.uint64).ravel(), at + 17 + size


def pack_steps(h: np.ndarray) -> bytes:
    """Sorted numbers by Rice coding of their steps: low bits as they are, high ones in unary."""
    steps = np.diff(h, prepend=np.uint64(0))
    first, steps = int(steps[0]), steps[1:]
    low_bits = max(0, int(steps.mean()).bit_length() - 1) if len(steps) else 0
    high = (steps >> np.uint64(low_bits)).astype(np.int64)
    unary = np.zeros(int(high.sum()) + len(high), dtype=np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = np.unpackbits(steps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - low_bits :]
    return struct.pack("<QQBQ", first, len(steps), low_bits, len(unary)) + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def unpack_steps(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """(sorted numbers, place after them)."""
    first, n, low_bits, size = struct.unpack_from("<QQBQ", blob, at)
    at += 25
    end = at + (size + 7) // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob[at:end], dtype=np.uint8))[:size])
    after = end + (n * low_bits + 7) // 8
    low = np.zeros((n, 64), dtype=np.uint8)
    low[:, 64 - low_bits :] = np.unpackbits(np.frombuffer(blob[end:after], dtype=np.uint8))[: n * low_bits].reshape(n, low_bits)
    steps = np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64) | (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(low_bits)
    return np.cumsum(np.concatenate([np.array([first], dtype=np.uint64), steps])), after


class Block:
    """The n-grams of some texts: gram[k] has, for each position, the number (among hashes) of the k + 1 tokens that end there."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, train: np.ndarray, order: int, bits: int = 64) -> None:
        tokens, lengths = [], []
        for _, _, data, offsets in chunks(texts):
            data = LOWER[data]
            starts, ends, text = words(data, offsets, NOT_SPACE)
            n = np.bincount(text, minlength=len(offsets) - 1)
            # Start mark, words, end.
            own = np.full(len(starts) + 2 * len(n), _END)
            at = np.cumsum(n + 2) - (n + 2)
            own[at] = _START
            own[np.arange(len(starts)) + 2 * text + 1] = spans_hash(data, starts, ends)
            tokens.append(own)
            lengths.append(n + 2)
        self.order = order
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, dtype=np.int64)
        token = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.uint64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.text = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.place = (np.arange(len(token)) - self.first[self.text]).astype(np.int32)
        tokens.clear()
        hashes, wheres = [], []
        gram = token
        for k in range(order):
            if k:
                gram = np.concatenate([np.zeros(1, dtype=np.uint64), mix(gram[:-1] * _STEP + token[1:] + np.uint64(k))])[: len(token)]
            where = np.flatnonzero(self.place >= k).astype(np.int32)
            hashes.append(gram[where] >> np.uint64(64 - bits))
            wheres.append(where)
        del token, gram
        every = np.concatenate(hashes)
        hashes.clear()
        self.hashes, at = np.unique(every, return_inverse=True)
        del every
        at = at.astype(np.int32)
        self.own = np.bincount(at, weights=np.concatenate([train[self.text[w]] for w in wheres]), minlength=len(self.hashes)).astype(np.int64)
        self.gram, done = [], 0
        for where in wheres:
            numbers = np.full(len(self.text), -1, dtype=np.int32)
            numbers[where] = at[done : done + len(where)]
            self.gram.append(numbers)
            done += len(where)


class Automaton:
    """The part of the backoff automaton that a block's texts can reach. A state is the number of its n-gram; the last is the root."""

    def __init__(self, block: Block, counts: np.ndarray, n_tokens: int, n_types: int, mu: tuple[float, ...]) -> None:
        size = len(counts)
        self.block, self.root = block, size
        self.seen = np.append(counts > 0, True)
        weight = np.zeros(size)
        self.fail, self.fail_log = np.full(size + 1, size, dtype=np.int64), np.zeros(size + 1)
        keys, logs, targets = [], [], []
        for k in range(block.order):
            # One place of each n-gram of k + 1 tokens tells its last token, and those without the first and the last token.
            where = np.flatnonzero(block.place >= k)
            some = np.full(size, -1, dtype=np.int32)
            some[block.gram[k][where]] = where
            number = np.flatnonzero(some >= 0)
            place = some[number]
            if not k:
                weight[number] = (counts[number] + 1) / (n_tokens + n_types + 1)
            else:
                context, shorter = block.gram[k - 1][place - 1], block.gram[k - 1][place]
                m = mu[min(k, len(mu)) - 1]
                weight[number] = (counts[number] + m * weight[shorter]) / (counts[context] + m)
                self.fail[number] = np.where(counts[shorter] > 0, shorter, size)
                arc = counts[number] > 0
                keys.append(context[arc].astype(np.int64) * (size + 1) + block.gram[0][place[arc]])
                logs.append(np.log10(weight[number[arc]]))
                targets.append((number[arc] if k < block.order - 1 else shorter[arc]).astype(np.int32))
            m = mu[min(k + 1, len(mu)) - 1]
            self.fail_log[number] = np.log10(m / (counts[number] + m))
            if not k:
                self.root_log = np.zeros(size)
                self.root_log[number] = np.log10(weight[number])
        key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        keys.clear()
        by = np.argsort(key).astype(np.int32)
        # One more arc, under no token, so that there is a last one.
        self.key = np.append(key[by], np.iinfo(np.int64).max)
        del key
        self.log = np.append((np.concatenate(logs) if logs else np.zeros(0))[by], 0.0)
        self.target = np.append((np.concatenate(targets) if targets else np.zeros(0, dtype=np.int64))[by], size).astype(np.int32)

    def state_before(self, at: np.ndarray) -> np.ndarray:
        """The state in which the token at each position is read: the longest one that the tokens before end with."""
        out = np.full(len(at), self.root, dtype=np.int64)
        for k in range(self.block.order - 1):
            number = self.block.gram[k][at - 1]
            fits = (self.block.place[at] > k) & (number >= 0) & self.seen[number]
            out[fits] = number[fits]
        return out

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 of the weights on the way) of reading one token in each state."""
        log, target = np.zeros(len(state)), np.empty(len(state), dtype=np.int64)
        left = np.arange(len(state))
        while len(left):
            at_root = state[left] == self.root
            done = left[at_root]
            log[done] += self.root_log[token[done]]
            target[done] = np.where(self.seen[token[done]], token[done], self.root)
            left = left[~at_root]
            wanted = state[left] * (self.root + 1) + token[left]
            arc = np.searchsorted(self.key, wanted)
            found = self.key[arc] == wanted
            log[left[found]] += self.log[arc[found]]
            target[left[found]] = self.target[arc[found]]
            left = left[~found]
            log[left] += self.fail_log[state[left]]
            state[left] = self.fail[state[left]]
        return target, log

    def walk(self, stretch: int = STRETCH) -> np.ndarray:
        """log10 of each text's probability."""
        block = self.block
        n = block.lengths - 1
        parts = -(-n // stretch)
        text = np.repeat(np.arange(len(n)), parts)
        k = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = block.first[text] + 1 + k * stretch
        size = np.minimum(stretch, n[text] - k * stretch)
        by = np.argsort(-size, kind="stable")
        text, begin, size = text[by], begin[by], size[by]
        state, total = self.state_before(begin), np.zeros(len(begin))
        tokens = block.gram[0].astype(np.int64)
        for j in range(int(size[0]) if len(size) else 0):
            active = int(np.searchsorted(-size, -j))
            state = state[:active]
            state, log = self.step(state, tokens[begin[:active] + j])
            total[:active] += log
        return np.bincount(text, weights=total, minlength=len(n))

    def base(self) -> tuple[np.ndarray, np.ndarray]:
        """(known tokens, log10 of the product of their root weights) of each text."""
        block = self.block
        real = block.place >= 1
        number = block.gram[0][real]
        text = block.text[real]
        return np.bincount(text, weights=self.seen[number], minlength=len(block.lengths)).astype(np.int64), np.bincount(text, weights=self.root_log[number], minlength=len(block.lengths))


def is_held_out(doc_id: str, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


def ranges_of(hashes: np.ndarray, bits: int, range_bits: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(ranges that have some of the sorted hashes, places of each)."""
    top = hashes >> np.uint64(bits - range_bits)
    at = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else np.zeros(0, dtype=np.int64)
    return top[at].astype(np.int64), list(zip(at.tolist(), [*at[1:].tolist(), len(hashes)]))


def vocabulary(docs: DataFrame, bits: int = 64, range_bits: int = 4) -> tuple[int, int]:
    """(tokens, distinct tokens) of docs(text, train), the end included: packed ranges of hashes, each counted where it is merged."""

    def packed(held: list[np.ndarray]):
        h = np.unique(np.concatenate(held))
        ranges, places = ranges_of(h, bits, range_bits)
        return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.nulls(len(ranges), pa.int64()), pa.array([pack_steps(h[a:b]) for a, b in places], pa.binary())], ["range", "n", "blob"])

    def run(batches):
        held: list[np.ndarray] = []
        total = rows = 0
        for batch in batches:
            train = column_of(batch, "train").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in chunks(column_of(batch, "text")):
                starts, ends, text = words(data := LOWER[data], offsets, NOT_SPACE)
                some = train[a:b][text]
                ended = int(train[a:b].sum())
                total += int(some.sum()) + ended
                held.append(np.unique(np.append(spans_hash(data, starts[some], ends[some]), np.full(min(1, ended), _END)) >> np.uint64(64 - bits)))
                rows += len(held[-1])
                if rows > 1 << 21:
                    held = [np.unique(np.concatenate(held))]
                    rows = len(held[0])
                    if rows > 1 << 20:
                        yield packed(held)
                        held, rows = [], 0
        if held:
            yield packed(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([total]), pa.nulls(1, pa.binary())], ["range", "n", "blob"])

    def count(table: pa.Table) -> pa.Table:
        merged = [unpack_steps(x)[0] for x in table.column("blob").to_pylist() if x is not None]
        tokens = sum(x or 0 for x in table.column("n").to_pylist())
        return pa.table({"n": pa.array([tokens]), "v": pa.array([len(np.unique(np.concatenate(merged))) if merged else 0])})

    found = docs.select("text", "train").mapInArrow(run, "range int, n long, blob binary")
    n, v = found.groupBy("range").applyInArrow(count, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return n or 0, v or 0


def scores(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None, order: int = ORDER, mu: tuple[float, ...] = MU, block_bytes: int = BLOCK_BYTES,
    range_entries: int = RANGE_ENTRIES,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; scores to 6 decimals."""
    out = is_held_out(doc_id) if held_out is None else held_out
    given = docs.select(F.col(doc_id).alias("doc_id"), (~out).alias("train"), F.col(text).alias("text"))
    total = given.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    range_bits = max(0, (total * order // 4 // range_entries).bit_length())
    bits = min(64, max(LEAST_BITS, (total * order // 4).bit_length() + 22))
    n_tokens, n_types = vocabulary(given, bits, range_bits)
    dealt = given.withColumn("block", F.expr(f"int(pmod(xxhash64(doc_id, text), {blocks}))")).repartition("block")

    def block_of(table: pa.Table) -> Block:
        return Block(table.column("text"), table.column("train").to_numpy(), order, bits)

    def ask(table: pa.Table) -> pa.Table:
        block = block_of(table)
        ranges, places = ranges_of(block.hashes, bits, range_bits)
        blobs = [pack_steps(block.hashes[a:b]) + pack(block.own[a:b]) for a, b in places]
        return pa.table({"range": pa.array(ranges, pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(ranges), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def add_up(table: pa.Table) -> pa.Table:
        asking = table.column("block").to_numpy()
        hashes, own = [], []
        for blob in table.column("blob").to_pylist():
            h, at = unpack_steps(blob)
            hashes.append(h)
            own.append(unpack(blob, at)[0])
        size = np.array([len(h) for h in hashes])
        h, mine = np.concatenate(hashes), np.concatenate(own).astype(np.int64)
        by = np.argsort(h, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]]))
        total = np.empty(len(h), dtype=np.int64)
        total[by] = np.repeat(np.add.reduceat(mine[by], new), np.diff(np.concatenate([new, [len(h)]])))
        to, blobs, at = [], [], 0
        for b, n in zip(asking.tolist(), size.tolist()):
            other = np.flatnonzero(total[at : at + n] != mine[at : at + n])
            if len(other):
                to.append(b)
                blobs.append(pack(np.diff(other, prepend=0)) + pack(total[at : at + n][other]))
            at += n
        return pa.table({"block": pa.array(to, pa.int32()), "range": pa.array([table.column("range")[0].as_py()] * len(to), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def walk(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        block = block_of(table)
        counts, block.own = block.own, None
        ranges, places = ranges_of(block.hashes, bits, range_bits)
        first, block.hashes = {r: a for r, (a, _) in zip(ranges.tolist(), places)}, None
        for r, blob in zip(answers.column("range").to_pylist(), answers.column("blob").to_pylist()):
            steps, at = unpack(blob)
            counts[first[r] + np.cumsum(steps.astype(np.int64))] = unpack(blob, at)[0]
        automaton = Automaton(block, counts, n_tokens, n_types, mu)
        known, base = automaton.base()
        return pa.table({
            "doc_id": table.column("doc_id"), "held_out": pa.array(~table.column("train").to_numpy()), "n_tokens": block.lengths - 1, "n_known": known, "base_score": np.round(base, 6),
            "score": np.round(automaton.walk(), 6),
        })

    asked = dealt.groupBy("block").applyInArrow(ask, "range int, block int, blob binary")
    answers = asked.groupBy("range").applyInArrow(add_up, "block int, range int, blob binary")
    id_type = given.schema["doc_id"].dataType.simpleString()
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
