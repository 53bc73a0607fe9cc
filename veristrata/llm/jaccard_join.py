"""N-gram Jaccard join by T-occurrence search with divided lists (short ones merged, long ones probed).

A document's set is its distinct shingles of N words, hashed to 64 bits. Documents with equal sets form one class
with one node. Shingles have one order for all: those in few sets first, the most frequent ones (heavy) last. In
that order, two sets that reach the similarity share l elements among the first n - ceil(s n) + l of each (l is the
smaller of the two LEVELs), so only those prefixes are indexed.

1. A counting pass finds the heavy shingles (counts are summed in each task first). Their number follows the data up to MOST_HEAVY, as they
   are broadcast; the order only decides how much work there is, not what is found.
2. An indexing pass deals the prefixes to shards in packed form; shards are so many that each holds about SHARD_BYTES of text. A shard sorts
   its postings into inverted lists. Short lists give partial candidate lists for each node; these are merged for each node with a heap, adding up
   occurrences.
3. Long lists are not merged. A candidate that short lists leave below l is looked for by binary search in each long list of the other node; it
   stays if all occurrences reach l and the sizes allow it. What stays is verified by probing one whole set in the other by binary search.
   Pairs that share long lists only: nodes are paired with the leader of most of their lists, then, where a list still holds several components, with
   probes from its largest component, and at last with every node of another component, in tiles (an exact end that is
   small because near copies have been linked by then).

Joins on a list's name are salted, as one passage may stand in a third of all documents, and never broadcast; nor are rows that are dealt to tiles.

Links are verified on the 64-bit hashes of whole sets. Only links that join components are sought: the result is
one component per document, and no pairs within it are listed.

Cases: null, empty or blank texts have an empty set and link with nothing; fewer words than N: the whole sequence is
one shingle, apart from those of N words; repeated rows of a doc_id are rows of their own in the result; an
empty table gives an empty result; other columns are ignored; very long texts are used whole; of equally good
partners the smaller node is tried first, which changes no component.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import wordhash as H
from .common import drop_tables, given_id, materialize, salted_join, shielded, some_id, text_of
from .components import components
from .exact_dedup import ID_FILTER_BITS, Bloom, drop_keys, id_keys, row_keys

WORDS = 5
#: Similarity in hundredths.
SIMILARITY = 75
#: A list of more sets than LONG is long. One shingle is put last for each HEAVY_BYTES of text, within bounds (5 bytes each are broadcast).
LONG, HEAVY_BYTES, LEAST_HEAVY, MOST_HEAVY = 32, 1 << 10, 1 << 19, 1 << 23
#: Bytes of text for each shard of postings.
SHARD_BYTES = 64 << 20
#: Postings that a task gathers before it writes them out.
BUFFER = 1 << 20
#: Bytes of sets of either side of a tile in the last turn. A set is sent once for each block of the other side, so tiles are as large as a task's memory lets them be.
TILE_BYTES = 32 << 20
INDEX = ["kind", "a", "b", "c", "d", "e", "blob"]
#: A document's row in packed form: id, node, second hash, size, heavy elements of the prefix, whether it has words, digest.
PACKED = np.dtype([("a", "<i8"), ("b", "<i8"), ("c", "<i8"), ("d", "<i8"), ("e", "<i8"), ("ok", "u1"), ("digest", "V32")])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, at, _, _ = H.words(raw, offsets)
    grams = H.ngrams(hashes, words)
    for k in range(offsets.size - 1):
        a, b = at[k], at[k + 1]
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield H.ngrams(hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    raw, offsets = H.buffers(batch.column(1))
    for a, b in H.chunks(offsets):
        yield from enumerate(shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words), a)


def _pack(x: np.ndarray, size: int) -> np.ndarray:
    """The low `size` bytes of each number."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :size]


def _unpack(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((raw.size // size, 8), np.uint8)
    out[:, :size] = raw.reshape(-1, size)
    return out.view(np.uint64).ravel()


def _by_shard(shard: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not shard.size:
        return
    order = np.argsort(shard, kind="stable")
    shard, rows = shard[order], rows[order]
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], shard.size], strict=True):
        yield int(shard[a]), rows[a:b].tobytes()


def heavy_shingles(docs: DataFrame, words: int, shards: int, long_list: int = LONG, most: int = LEAST_HEAVY) -> bytearray:
    """The top 40 bits of shingles in about long_list different sets or more, the `most` most frequent of them, sorted, 5 bytes each.

    Different sets are counted by a bitmap of 64 bits in which a set has one place, so that copies of one text count once. Shards are ranges
    of hashes and stay in the shared folder. The driver reads how many shingles have each count, sets the cut, and then gets what is
    above it in the order of shards, already sorted: it holds the 5 bytes of each and no more.
    """
    taken = round(64 * (1 - (63 / 64) ** long_list))  # places that so many sets are expected to take

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        places: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, bits = _merge_bits(np.concatenate(held), np.uint64(1) << np.concatenate(places))
            rows = []
            for many in (False, True):
                at = np.flatnonzero((np.bitwise_count(bits) > 1) == many)
                place = bits[at] if many else np.bitwise_count(bits[at] - np.uint64(1)).astype(np.uint64)
                packed = np.concatenate([_pack(keys[at], 5), _pack(place, 8 if many else 1)], axis=1)
                rows += [(s, many, blob) for s, blob in _by_shard(((keys[at] * np.uint64(shards)) >> np.uint64(40)).astype(np.int64), packed)]
            held.clear()
            places.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "many", "blob"])

        for batch in batches:
            for _, s in _sets(batch, words):
                if s.size:
                    held.append(s >> np.uint64(24))
                    places.append(np.full(s.size, H.mix(np.array([np.bitwise_xor.reduce(s)]))[0] & np.uint64(63), np.uint64))
                    size += s.size
                if size >= BUFFER:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def total(rows: pa.Table) -> pa.Table:
        keys, bits = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for many, blob in zip(rows.column("many"), rows.column("blob"), strict=True):
            raw = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, 13 if many.as_py() else 6)
            keys.append(_unpack(raw[:, :5].ravel(), 5))
            place = _unpack(raw[:, 5:].ravel(), raw.shape[1] - 5)
            bits.append(place if many.as_py() else np.uint64(1) << place)
        found, bits = _merge_bits(np.concatenate(keys), np.concatenate(bits))
        n = np.bitwise_count(bits)
        keep = np.flatnonzero(n >= taken)
        packed = np.concatenate([_pack(found[keep], 5), n[keep].astype(np.uint8)[:, None]], axis=1)
        return pa.Table.from_arrays([rows.column("shard")[:1], pa.array([packed.tobytes()], pa.binary())], names=["shard", "blob"])

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(65, np.int64)
        for batch in batches:
            for blob in batch.column(1):
                held += np.bincount(np.frombuffer(blob.as_buffer(), np.uint8)[5::6], minlength=65)
        yield pa.RecordBatch.from_arrays([pa.array(range(65), pa.int32()), pa.array(held, pa.int64())], names=["n", "k"])

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for blob in batch.column(1):
                raw = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, 6)
                keep, tied = raw[:, 5] > cut, np.flatnonzero(raw[:, 5] == cut)
                keep[tied[: room * tied.size // ties]] = True
                blobs.append(raw[keep, :5].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["shard", "blob"])

    parts = docs.select("doc_id", "text").mapInArrow(count, "shard int, many boolean, blob binary").groupBy("shard").applyInArrow(total, "shard int, blob binary")
    parts = materialize(parts, "jac-heavy")
    cut, room, ties = 0, most, 1
    for r in sorted(parts.mapInArrow(numbers, "n int, k long").groupBy("n").agg(F.sum("k").alias("k")).collect(), reverse=True):  # at most 65 rows
        if r.k > room:  # of shingles at the cut, each shard gives its share
            cut, ties = r.n, r.k
            break
        room -= r.k
    packed = bytearray()
    for r in parts.mapInArrow(above, "shard int, blob binary").orderBy("shard").toLocalIterator():
        packed += r.blob
    drop_tables(parts)
    return packed


def _merge_bits(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the union of each one's bits."""
    if not keys.size:
        return keys, bits
    order = np.argsort(keys)
    keys, bits = keys[order], bits[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.bitwise_or.reduceat(bits, starts)


def required(n: int, similarity: int) -> int:
    """ceil(similarity * n): the least overlap of a set of n with any that is similar to it."""
    return -(-similarity * n // 100)


def level(n):
    """How many common elements the prefixes are long enough for."""
    return 1 + n // 25


def node_of(s: np.ndarray, salt: int) -> tuple[int, int]:
    """The node of a set, and a second hash of it."""
    mixed = H.mix(s + np.uint64(salt))
    return int(H.mix(np.array([np.bitwise_xor.reduce(mixed) + np.uint64(s.size)]))[0].astype(np.int64)), int(np.sum(mixed).astype(np.int64))


def _index(docs: DataFrame, heavy: Broadcast, words: int, similarity: int, shards: int, salt: int, long_list: int, keyed: bool) -> DataFrame:
    """Rows of three kinds. 0: a document (a: doc_id, b: node, c: second hash of the set, d: size, e: heavy elements in the prefix, blob: digest of the text if keyed).
    1: a candidate list (a: node, blob: other nodes and occurrences). 2: a heavy posting (a: shingle, b: node)."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = _unpack(np.frombuffer(heavy.value, np.uint8), 5)
        grams: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        documents: list[tuple] = []
        hot: list[tuple] = []
        size, done = 0, 0

        def flush() -> pa.RecordBatch:
            own = -1 - ((TaskContext.get().partitionId() << 32) + done)  # a key that no other flush has
            rows = [(own, 0, np.array(documents, PACKED).tobytes()), (own, 2, np.array(hot, "<i8").tobytes())]
            if grams:
                g, v = np.concatenate(grams), np.concatenate(nodes)
                packed = np.concatenate([_pack(g, 6), _pack(v, 8)], axis=1)
                rows += [(s, 1, blob) for s, blob in _by_shard((g % np.uint64(shards)).astype(np.int64), packed)]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["shard", "kind", "blob"])
            for x in (grams, nodes, documents, hot):
                x.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for k, s in _sets(batch, words):
                if not s.size:
                    documents.append((ids[k], 0, 0, 0, 0, 0, b""))
                    size += 1
                    continue
                node, second = node_of(s, salt)
                top = s >> np.uint64(24)
                at = np.searchsorted(last, top)
                late = (last[np.minimum(at, last.size - 1)] == top) if last.size else np.zeros(s.size, bool)
                first = s[~late]
                p = s.size - required(s.size, similarity) + level(s.size)
                late = s[late][: max(0, p - first.size)]
                first = first[:p]
                digest = hashlib.sha256(batch.column(1)[k].as_buffer()).digest() if keyed else b""
                documents.append((ids[k], node, second, s.size, late.size, 1, digest))
                grams.append(first >> np.uint64(16))
                nodes.append(np.full(first.size, node, np.int64).view(np.uint64))
                hot += [(g, node) for g in (late >> np.uint64(16))]
                size += first.size + 10 * late.size
                if size >= BUFFER:
                    yield flush()
                    size, done = 0, done + 1
        if documents:
            yield flush()

    def lists(rows: pa.Table) -> pa.Table:
        if rows.column("shard")[0].as_py() < 0:  # one flush's documents and heavy postings
            kinds = dict(zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist(), strict=True))
            d, h = np.frombuffer(kinds[0], PACKED), np.frombuffer(kinds[2], "<i8").reshape(-1, 2)
            blank = np.r_[d["ok"] == 0, np.zeros(len(h), bool)]
            none = pa.nulls(len(h), pa.int64())

            def column(x: np.ndarray, rest: np.ndarray | None = None) -> pa.ChunkedArray:
                return pa.chunked_array([pa.array(x, pa.int64()), none if rest is None else pa.array(rest, pa.int64())])

            node = pa.array(np.r_[d["b"], h[:, 1]], pa.int64(), mask=blank)
            second = pa.array(np.r_[d["c"], np.zeros(len(h), np.int64)], pa.int64(), mask=blank | np.r_[np.zeros(len(d), bool), np.ones(len(h), bool)])
            digests = pa.array([bytes(x) if keyed and ok else None for x, ok in zip(d["digest"], d["ok"], strict=True)] + [None] * len(h), pa.binary())
            return pa.Table.from_arrays([pa.array(np.r_[np.zeros(len(d), np.int32), np.full(len(h), 2, np.int32)]), column(d["a"], h[:, 0]), node, second, column(d["d"]), column(d["e"]), digests], names=INDEX)
        packed = np.concatenate([np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, 14) for b in rows.column("blob")])
        g, v = _unpack(packed[:, :6].ravel(), 6), _unpack(packed[:, 6:].ravel(), 8).view(np.int64)
        pairs, (g, v) = list_pairs(g, v, long_list)
        nodes, blobs = candidate_rows(*pairs)
        none = pa.nulls(nodes.size + g.size, pa.int64())
        cols = [pa.array(np.r_[np.full(nodes.size, 1), np.full(g.size, 2)], pa.int32()), pa.array(np.r_[nodes, g.astype(np.int64)], pa.int64()), pa.array([None] * nodes.size + v.tolist(), pa.int64()), none, none, none, pa.array(blobs + [None] * g.size, pa.binary())]
        return pa.Table.from_arrays(cols, names=INDEX)

    return docs.select("doc_id", "text").mapInArrow(postings, "shard long, kind int, blob binary").groupBy("shard").applyInArrow(lists, "kind int, a long, b long, c long, d long, e long, blob binary")


def list_pairs(g: np.ndarray, v: np.ndarray, long_list: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """From postings: pairs (smaller, larger, lists that hold both) of the short lists; postings of long lists."""
    order = np.lexsort((v, g))
    g, v = g[order], v[order]
    if not g.size:
        return (v, v, v), (g, v)
    new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
    g, v = g[new], v[new]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[starts, g.size])
    ones, twos = [], []
    for m in np.unique(sizes[(sizes > 1) & (sizes <= long_list)]):
        table = v[starts[sizes == m][:, None] + np.arange(m)[None, :]]
        i, j = np.triu_indices(m, 1)
        ones.append(table[:, i].ravel())
        twos.append(table[:, j].ravel())
    a = np.concatenate([np.zeros(0, np.int64), *ones])
    b = np.concatenate([np.zeros(0, np.int64), *twos])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if a.size else np.zeros(0, int)
    number = np.diff(np.r_[at, a.size])
    long_ones = np.repeat(sizes > long_list, sizes)
    return (a[at], b[at], number), (g[long_ones], v[long_ones])


def candidate_rows(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each node a, and its partners in rising order, each with the number of lists."""
    if not a.size:
        return a, []
    at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return a[at], [x.tobytes() for x in np.split(np.stack([b, n], axis=1), at[1:])]


def merge_lists(lists: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Partners in rising order with their occurrences in all lists: a heap holds the head of each list."""
    heap = [(int(x[0, 0]), k, 0) for k, x in enumerate(lists) if len(x)]
    heapq.heapify(heap)
    while heap:
        top, number = heap[0][0], 0
        while heap and heap[0][0] == top:
            _, k, i = heap[0]
            x = lists[k]
            number += int(x[i, 1])
            if i + 1 < len(x):
                heapq.heapreplace(heap, (int(x[i + 1, 0]), k, i + 1))
            else:
                heapq.heappop(heap)
        yield top, number


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (a, blob) -> (a, b, n)."""
    node, lists = None, []
    out: tuple[list, list, list] = ([], [], [])

    def take() -> None:
        for b, n in merge_lists(lists):
            for c, x in zip(out, (node, b, n), strict=True):
                c.append(x)

    def emit() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "n"])
        for c in out:
            c.clear()
        return batch

    for batch in batches:
        for a, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a != node:
                take()
                node, lists = a, []
            lists.append(np.frombuffer(blob, np.int64).reshape(-1, 2))
        if len(out[0]) > 50_000:
            yield emit()
    take()
    yield emit()


def overlap(small: np.ndarray, large: np.ndarray) -> int:
    """Size of the intersection: each element of one sorted set is looked for in the other by binary search."""
    if small.size > large.size:
        small, large = large, small
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, large.size - 1)] == small).sum()) if large.size else 0


def sketch(s: np.ndarray) -> bytes:
    """A bitmap of a set: four bits or more for each element, a power of two in all."""
    bits = np.zeros(1 << max(6, (4 * s.size - 1).bit_length()), bool)
    bits[(H.mix(s) & np.uint64(bits.size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_overlap(x: np.ndarray, n: int, y: np.ndarray, m: int) -> int:
    """No less than the overlap of two sets of n and m elements, by their sketches: a bit that only one has is an element that the other lacks."""
    while x.size > y.size:
        x = x[: x.size // 2] | x[x.size // 2 :]
    while y.size > x.size:
        y = y[: y.size // 2] | y[y.size // 2 :]
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def _verify(pairs: DataFrame, sets: DataFrame, similarity: int, tag: str) -> DataFrame | None:
    """Those of pairs (a, b) whose sets are similar; None without pairs. Sketches, a sixteenth of the sets or so, leave out most others before sets are sent."""

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, n, y, m in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist(), strict=True):
                both = most_overlap(np.frombuffer(x.as_buffer(), np.uint8), n, np.frombuffer(y.as_buffer(), np.uint8), m)
                keep.append(100 * both >= similarity * (n + m - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = overlap(s, t)
                keep.append(100 * both >= similarity * (s.size + t.size - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = materialize(pairs.select("a", "b").distinct(), tag)
    if not pairs.take(1):
        return None
    small = sets.select("node", "sketch", "n")
    near = pairs.join(small.toDF("a", "x", "n"), "a").join(small.toDF("b", "y", "m"), "b").select("a", "b", "x", "n", "y", "m").mapInArrow(sieve, "a long, b long")
    near = materialize(near, tag)
    one = sets.select(F.col("node").alias("a"), F.col("blob").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("blob").alias("y"))
    links = materialize(near.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(probe, "a long, b long"), tag)
    drop_tables(pairs, near)
    _tidy(sets)
    return links


def _dealt_join(df: DataFrame, other: DataFrame, key: str, by: str) -> DataFrame:
    """A salted join that is never broadcast: Spark estimates other as it is before each row is taken SALTS times, and would send all of that through the driver."""
    return salted_join(df, other.hint("merge"), key, by)


def _tidy(df: DataFrame) -> None:
    """Lets Spark drop the shuffle files of finished steps."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _id_filter(chosen: DataFrame, slices: int = 8) -> np.ndarray:
    """Filter on the doc_id of chosen; what tasks have found is merged by slices, so the driver gets one filter."""
    size = min(ID_FILTER_BITS, 1 << max(16, (12 * chosen.count()).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size // 8, np.uint8)
        for batch in batches:
            held |= Bloom.build(id_keys(batch.column(0).to_numpy()).ravel(), size)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in np.split(held, slices)], pa.binary())], names=["slice", "held"])

    def merge(rows: pa.Table) -> pa.Table:
        held = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("held")])
        return pa.Table.from_arrays([rows.column("slice")[:1], pa.array([held.tobytes()], pa.binary())], names=["slice", "held"])

    held = np.zeros((slices, size // 8 // slices), np.uint8)
    for r in chosen.select("doc_id").coalesce(8).mapInArrow(build, "slice int, held binary").groupBy("slice").applyInArrow(merge, "slice int, held binary").collect():
        held[r.slice] = np.frombuffer(r.held, np.uint8)
    return held.ravel()


def _sets_of(docs: DataFrame, chosen: DataFrame, words: int, salt: int) -> DataFrame:
    """node, blob, sketch and n of the sets of chosen (doc_id, node); texts are found by a filter on ids before they are joined."""
    wanted = docs.sparkSession.sparkContext.broadcast(_id_filter(chosen))

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.filter(pa.array(Bloom.test(wanted.value, id_keys(batch.column(0).to_numpy()).ravel())))
            got = [(node_of(s, salt)[0] if s.size else None, s.tobytes(), sketch(s), s.size) for _, s in _sets(part, words)]
            columns = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()), strict=True)]], names=["doc_id", "node", "blob", "sketch", "n"])

    found = docs.select("doc_id", "text").mapInArrow(hash_sets, "doc_id long, node long, blob binary, sketch binary, n long")
    # dealt by node alone, for the join and for repeated rows of a document, so that a set is dealt once
    found = found.join(chosen.select("node", F.col("doc_id").alias("own")).hint("merge"), "node").where("doc_id = own")
    found = materialize(found.dropDuplicates(["node"]).select("node", "blob", "sketch", "n"), "jac-sets")
    wanted.destroy()
    _tidy(docs)
    return found


def jaccard_components(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, long_list: int = LONG, tile: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id long, text string)."""
    return _result(*_placed(docs, words, similarity, long_list, tile))


def _placed(docs: DataFrame, words: int, similarity: int, long_list: int = LONG, tile: int | None = None, keyed: bool = False) -> tuple[DataFrame, DataFrame]:
    """A row (doc_id, node, n, digest of the text if keyed) for every row of docs; node, component, component_id for every class."""
    docs = docs.select(some_id("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, words, shards, long_list, min(MOST_HEAVY, max(LEAST_HEAVY, size // HEAVY_BYTES))))
    _tidy(docs)
    salt, clash = 0, True
    while clash:  # two different sets with one 64-bit node: once more with another salt
        salt += 1
        index = materialize(_index(docs, heavy, words, similarity, shards, salt, long_list, keyed), "jac-index")
        rows = index.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("c").alias("second"), F.col("d").alias("n"), F.col("e").alias("hot"), F.col("blob").alias("digest"))
        classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("second").alias("c0"), F.max("second").alias("c1"), F.first("n").alias("n"), F.max("hot").alias("hot"))
        classes = materialize(classes, "jac-classes")
        clash = bool(classes.where("c0 <> c1").take(1))
        if clash:
            drop_tables(index, classes)
    heavy.destroy()
    _tidy(docs)
    hot = materialize(index.where("kind = 2").select(F.col("a").alias("g"), F.col("b").alias("node")).distinct(), "jac-hot")
    info = classes.select("node", "n")
    merged = index.where("kind = 1").select("a", "blob").repartition("a").sortWithinPartitions("a").mapInArrow(_merged, "a long, b long, n long")
    merged = merged.join(info.toDF("a", "na"), "a").join(info.toDF("b", "nb"), "b").where(100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    merged = materialize(merged.withColumn("least", F.least(level_of("na"), level_of("nb"))).select("a", "b", "n", "least"), "jac-merged")
    rows = materialize(rows, "jac-rows")  # all that is read of the index from here on
    drop_tables(index)
    _tidy(docs)
    short = materialize(merged.where("n >= least").select("a", "b", "n").unionByName(_probed(merged.where("n < least"), hot)), "jac-short")
    drop_tables(merged)
    _tidy(docs)
    found = materialize(short.select(F.col("a").alias("node")).unionByName(short.select(F.col("b").alias("node"))).unionByName(hot.select("node")).distinct(), "jac-nodes")
    sets = _sets_of(docs, classes.join(found, "node").select("doc_id", "node"), words, salt)
    # first turn: each node with its best partner, and with the leader of most of its long lists
    sides = short.unionByName(short.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    best = sides.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    leaders = _dealt_join(hot, hot.groupBy("g").agg(F.min_by("node", F.xxhash64("node")).alias("lead")), "g", "node").where("lead <> node")
    leaders = leaders.groupBy("node", "lead").agg(F.count("*").alias("n")).groupBy(F.col("node").alias("a")).agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("b"))
    pairs = best.unionByName(leaders).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = _verify(pairs, sets, similarity, "jac-1")
    if links is None:
        return rows, classes.select("node", F.col("node").alias("component"), F.col("doc_id").alias("component_id"))
    groups = components(links, "jac-1")
    # second turn: all short candidates between components, and probes of the largest component of each long list; at last
    # what long lists still hold between components. A turn without pairs or without links changes nothing.
    pairs = _probes(hot, groups, 2).unionByName(_between(short.select("a", "b"), groups))
    more = _verify(pairs, sets, similarity, "jac-2")
    if more is not None and more.take(1):
        links = links.unionByName(more)
        groups = components(links, "jac-2")
    if more is not None:
        more = _rest(hot, groups, sets, similarity, tile)
    if more is not None and more.take(1):
        groups = components(links.unionByName(more), "jac-3")
    _tidy(docs)
    # the component of a class is named by its smallest doc_id
    drop_tables(short, hot, found, sets)
    names = classes.select("node", "doc_id").join(groups, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = classes.select("node", F.col("doc_id").alias("own")).join(groups.join(names, "component").select("node", "component", "component_id"), "node", "left")
    return rows, of_class.select("node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "own").alias("component_id"))


def _result(rows: DataFrame, of_class: DataFrame) -> DataFrame:
    out = rows.where("node is not null").join(of_class.select("node", "component_id"), "node")
    out = out.unionByName(rows.where("node is null").withColumn("component_id", F.col("doc_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.select(given_id("doc_id"), "n_shingles", given_id("component_id"))


def drop_similar(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """docs with one row (the smallest doc_id; null is smaller than all others) of each component, all columns.

    Rows are found by id and text, as rows of one id, or of none, can lie in several components.
    """
    return shielded(docs, lambda d: _drop_similar(d, words, similarity))


def _drop_similar(docs: DataFrame, words: int, similarity: int) -> DataFrame:
    rows, of_class = _placed(docs, words, similarity, keyed=True)
    rows = rows.where("node is not null").select("node", F.col("doc_id").alias("_vs_id"), F.col("digest").alias("_vs_digest"))
    first = rows.groupBy("node").agg(F.min(F.struct("_vs_id", "_vs_digest")).alias("first")).join(of_class, "node")
    first = first.groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    out = rows.select("_vs_id", "_vs_digest").distinct().join(first, ["_vs_id", "_vs_digest"], "left_anti")
    # texts without words link with nothing, not even with their repeats: each of these rows has its own key
    blank = ~text_of().rlike(r"[^\x20\x09-\x0D]")
    keyed = row_keys(docs)
    return drop_keys(keyed.withColumn("_vs_digest", F.when(blank, F.monotonically_increasing_id().cast("string").cast("binary")).otherwise(F.col("_vs_digest"))), out)


def _probed(pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """Pairs (a, b, n) of (a, b, n, least) that reach least with their common long lists: b is looked for in each long list of a."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(4), batch.column(5)
            ends_x, ends_y = x.offsets.to_numpy(), y.offsets.to_numpy()
            all_x, all_y = x.values.to_numpy(), y.values.to_numpy()
            both = [overlap(all_x[ends_x[k] : ends_x[k + 1]], all_y[ends_y[k] : ends_y[k + 1]]) for k in range(batch.num_rows)]
            number = batch.column(2).to_numpy() + np.array(both, np.int64)
            kept = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number, pa.int64())], names=["a", "b", "n"])
            yield kept.filter(pa.array(number >= batch.column(3).to_numpy()))

    lists = hot.groupBy("node").agg(F.sort_array(F.collect_list("g")).alias("lists"))
    both = pairs.join(lists.toDF("a", "x"), "a").join(lists.toDF("b", "y"), "b").where(F.col("n") + F.least(F.size("x"), F.size("y")) >= F.col("least"))
    return both.select("a", "b", "n", "least", "x", "y").mapInArrow(probe, "a long, b long, n long")


def level_of(n: str):
    return 1 + F.floor(F.col(n) / 25)


def _grouped(df: DataFrame, groups: DataFrame, node: str, out: str) -> DataFrame:
    """df with the component of a node; nodes without links are their own."""
    return df.join(groups.select(F.col("node").alias(node), F.col("component").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))


def _between(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    return _grouped(_grouped(pairs, groups, "a", "ca"), groups, "b", "cb").where("ca <> cb").select("a", "b")


def _open_lists(hot: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings (g, node, c) of long lists that hold several components; the largest component of each list."""
    placed = _grouped(hot, groups, "node", "c")
    sizes = placed.groupBy("g", "c").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("g").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("big"), F.count("*").alias("number")).where("number > 1")
    return placed, largest.select("g", "big")


def _probes(hot: DataFrame, groups: DataFrame, turn: int, ways: int = 4) -> DataFrame:
    """Nodes outside the largest component of their list, each with at most `ways` of its nodes."""
    placed, largest = _open_lists(hot, groups)
    placed = _dealt_join(placed, largest, "g", "node")
    way = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(ways))
    reps = placed.where("c = big").groupBy("g", way.alias("way")).agg(F.min_by("node", F.xxhash64(F.lit(turn + 10), "node")).alias("rep"))
    reps = reps.groupBy("g").agg(F.collect_list("rep").alias("reps"))  # at most `ways`
    rest = _dealt_join(placed.where("c <> big"), reps, "g", "node").withColumn("rep", F.explode("reps")).groupBy("node", "rep").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("node").orderBy(F.desc("n"), "rep"))
    rest = rest.withColumn("rank", rank).where(F.col("rank") <= ways)
    return rest.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b"))


def _rest(hot: DataFrame, groups: DataFrame, sets: DataFrame, similarity: int, tile: int | None) -> DataFrame | None:
    """Links between components that share a long list; None if no long list holds several.

    The lists that do are joined into clusters by their leaders. In a cluster, each node that is outside the largest component of some
    list is compared with all nodes of other components, in tiles of `tile` sets or TILE_BYTES on either side: the elements of one set
    are looked for in the inverted lists of a tile, and a tile returns a forest of links, never pairs.
    """
    placed, largest = _open_lists(hot, groups)
    placed = materialize(_dealt_join(placed, largest, "g", "node"), "jac-open")
    if not placed.take(1):
        return None
    leaders = placed.groupBy("g").agg(F.min("node").alias("lead"))
    clusters = components(_dealt_join(placed, leaders, "g", "node").select(F.col("node").alias("a"), F.col("lead").alias("b")), "jac-clusters")
    nodes = placed.groupBy("node").agg(F.first("c").alias("c"), F.max(F.col("c") != F.col("big")).alias("open")).join(clusters.withColumnRenamed("component", "cluster"), "node")
    nodes = nodes.join(sets.select("node", F.octet_length("blob").alias("bytes")), "node")
    of = lambda c: F.greatest(F.lit(1), F.ceil(F.count_if(c) / tile if tile else F.sum(F.when(c, F.col("bytes")).otherwise(0)) / TILE_BYTES))
    sizes = nodes.groupBy("cluster").agg(of(F.lit(True)).alias("blocks"), of(F.col("open")).alias("open_blocks"))
    nodes = materialize(nodes.join(sizes, "cluster").drop("bytes"), "jac-dealt")
    spot = F.xxhash64("node")
    others = nodes.select("cluster", "node", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("open_blocks") - 1)).alias("i"), F.pmod(spot, "blocks").alias("j"), F.lit(0).alias("side"))
    seekers = nodes.where("open").select("cluster", "node", "c", F.pmod(spot, "open_blocks").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), F.lit(1).alias("side"))
    dealt = others.unionByName(seekers).join(sets.select("node", "blob").hint("merge"), "node").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "side")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(row[k] != held[0][k] for k in ("cluster", "i", "j")):
                    yield from tile_links(held, similarity)
                    held = []
                held.append(row)
        yield from tile_links(held, similarity)

    return materialize(dealt.select("cluster", "i", "j", "side", "node", "c", "blob").mapInArrow(tiles, "a long, b long"), "jac-rest")


def tile_links(rows: list[dict], similarity: int) -> Iterator[pa.RecordBatch]:
    """A forest of links between the rows of side 1 and those of side 0 in other components."""
    index = [r for r in rows if not r["side"]]
    seekers = [r for r in rows if r["side"]]
    if not index or not seekers:
        return
    sets = [np.frombuffer(r["blob"], np.uint64) for r in index]
    sizes = np.array([s.size for s in sets])
    owners = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    elements = np.concatenate(sets)
    order = np.argsort(elements, kind="stable")
    elements, owners = elements[order], owners[order]
    number = {c: k for k, c in enumerate({r["c"] for r in rows})}
    above = list(range(len(number)))

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    colours = np.array([number[r["c"]] for r in index])
    links = []
    for r in seekers:
        s = np.frombuffer(r["blob"], np.uint64)
        lo, hi = np.searchsorted(elements, s, "left"), np.searchsorted(elements, s, "right")
        length = hi - lo
        at = np.arange(length.sum()) + np.repeat(lo - np.r_[0, np.cumsum(length)[:-1]], length)
        both = np.bincount(owners[at], minlength=len(sets))
        mine = number[r["c"]]
        for k in np.flatnonzero((100 * both >= similarity * (s.size + sizes - both)) & (colours != mine)):
            a, b = top(mine), top(int(colours[k]))
            if a != b:
                above[a] = b
                links.append((r["node"], index[k]["node"]))
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])
