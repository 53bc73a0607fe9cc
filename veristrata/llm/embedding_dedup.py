"""Near-duplicate embeddings by spherical-cap filters.

Equal vectors become one class with a weight. A random rotation splits a unit vector into two halves; each half has
a code of random directions, and a filter is a pair of codewords. A vector is list-decoded to every filter
whose inner product with it exceeds a threshold (both halves' codewords are walked in falling order, so only exceeding pairs and
one more per codeword are looked at), and to its LEAST best filters in any case. Vectors that share a filter are verified by
their cosine in double precision. A pair is counted in the first filter that it shares, so each link counts once.

Filters are joined by name; a filter with many vectors is dealt out in tiles of at most 2 * TILE vectors, and filters with one vector are
dealt nowhere. A vector travels in the width that the table has, with the names of its shared filters. Small tiles are verified many at a
time, pair by pair; large ones as a matrix. A tile returns counts per vector and a spanning forest of its links, never pairs.

The code grows with the number of vectors so that a filter holds few unrelated ones, and the number of filters of a vector grows with its
logarithm. The search is probabilistic: a pair near the cosine asked for that shares no filter isn't found (recall by size in the README).
A task holds the code, words * dimensions * 4 bytes, where words is the root of vectors * list / IN_FILTER.

Cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing; vectors of
different lengths never link; a cosine that equals the least one in double precision links; a class of equal vectors links all its members; repeated rows of one vec_id count as
different vectors with one id; an empty table gives an empty result; other columns (labels too) are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import given_id, materialize, some_id
from .components import components

#: Mean number of filters of a vector: LIST, and MORE for each doubling above 1000 vectors, or WORK / vectors up to MOST where that is
#: more; the least; unrelated vectors wanted in a filter, or ROOM / vectors where that is more.
LIST, MORE, WORK, MOST, LEAST, IN_FILTER, ROOM = 72, 4, 2_000_000, 400, 48, 0.2, 10_000
#: Vectors of a half tile; of a tile whose pairs are verified one by one; pairs in a block.
TILE, SMALL, BLOCK = 512, 48, 1 << 16
SEED = 20240229
#: A filter's name is its number, with the vectors' length above these bits.
DIM_BITS = 44


def list_size(n: int) -> int:
    return max(LIST + int(MORE * max(0.0, np.log2(max(n, 1) / 1000))), min(MOST, WORK // max(n, 1)))


def code_words(n: int) -> int:
    """Codewords of each half for n vectors."""
    return int(max(64, (n * list_size(n) / max(IN_FILTER, ROOM / max(n, 1))) ** 0.5))


class CapCode:
    """Codewords of two halves and the threshold that a random unit vector exceeds with `size` filters on average."""

    def __init__(self, dim: int, words: int, size: int = LIST):
        rng = np.random.default_rng(SEED)
        self.cut, self.words = max(1, dim // 2), words
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.codes = [self._unit(rng.normal(size=(words, n))).astype(np.float32) for n in (self.cut, max(1, dim - self.cut))]
        a, b = (-np.sort(-x, axis=1) for x in self.products(self._unit(rng.normal(size=(24, dim)))))
        low, high = -2.0, 2.0
        for _ in range(40):
            t = (low + high) / 2
            number = 0
            for x, y in zip(a, b, strict=True):
                first = int(np.searchsorted(-x, y[0] - t, "right"))
                number += int(np.searchsorted(-y, x[:first] - t, "right").sum())
            low, high = (t, high) if number > size * len(a) else (low, t)
        self.threshold = np.float32(high)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def products(self, units: np.ndarray) -> list[np.ndarray]:
        y = (units @ self.turn).astype(np.float32)
        halves = [y[:, : self.cut], y[:, self.cut :] if y.shape[1] > self.cut else np.zeros((len(y), 1), np.float32)]
        return [h @ c.T for h, c in zip(halves, self.codes, strict=True)]

    def decode(self, units: np.ndarray) -> Iterator[np.ndarray]:
        """Sorted filters of each vector."""
        rows = max(1, (1 << 21) // self.words)
        side = min(self.words, LEAST)
        # the best sums are of codewords whose places multiply to no more than their number
        p, q = np.nonzero((np.arange(side)[:, None] + 1) * (np.arange(side)[None, :] + 1) <= LEAST)
        for start in range(0, len(units), rows):
            one, two = self.products(units[start : start + rows])
            for a, b, top_a, top_b in zip(one, two, one.max(axis=1), two.max(axis=1), strict=True):
                # only codewords that exceed with the other half's best can be in the list
                at_a, at_b = np.flatnonzero(a >= self.threshold - top_b), np.flatnonzero(b >= self.threshold - top_a)
                i, j = np.nonzero(a[at_a][:, None] + b[at_b][None, :] >= self.threshold)
                i, j = at_a[i], at_b[j]
                if i.size < LEAST:  # its best ones, which lie among the best of both halves
                    best_a, best_b = (top[np.argsort(-x[top], kind="stable")] for x in (a, b) for top in [np.argpartition(-x, side - 1)[:side]])
                    best = np.argsort(-(a[best_a[p]] + b[best_b[q]]), kind="stable")[:LEAST]
                    i, j = np.r_[i, best_a[p[best]]], np.r_[j, best_b[q[best]]]
                yield np.unique(i.astype(np.int64) * self.words + j)


def _vectors(width: str):
    """vec_id, key of the exact vector (null if it links with nothing), the vector's bytes in the table's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ends = column.offsets.to_numpy()
            values = column.values.to_numpy(zero_copy_only=False).astype(width) + np.zeros(1, width)  # -0 becomes 0, null NaN
            keys, raw = [], []
            for k in range(batch.num_rows):
                v = values[ends[k] : ends[k + 1]]
                if not column[k].is_valid or not v.size or not np.isfinite(v).all() or not v.any():
                    keys.append(None)
                    raw.append(None)
                    continue
                raw.append(v.tobytes())
                keys.append(hashlib.blake2b(raw[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "raw"])

    return run


def unit_rows(raw: pa.Array, at: np.ndarray, width: str) -> np.ndarray:
    """Unit vectors in double precision of the rows `at`, a rising list, which have one length."""
    if at.size == at[-1] - at[0] + 1:  # one stretch of the column's buffer
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset + int(at[0]) :][: at.size + 1]
        x = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(width).reshape(at.size, -1).astype(np.float64)
    else:
        x = np.stack([np.frombuffer(raw[int(k)].as_buffer(), width) for k in at]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Lists:
    """The filters of rows from `start` on, read where they are asked for."""

    def __init__(self, column: pa.Array, name: str, start: int = 0):
        self.column, self.name, self.start = column, name, start

    def __getitem__(self, k):
        if isinstance(k, slice):
            return [self[x] for x in range(k.start, k.stop)]
        return np.frombuffer(self.column[self.start + int(k)].as_buffer(), self.name)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, edges = np.ones(len(linked), bool), []
    for root in np.flatnonzero(linked.any(axis=1)):
        if not left[root]:
            continue
        left[root] = False
        todo = [int(root)]
        while todo:
            u = todo.pop()
            new = np.flatnonzero(linked[u] & left)
            left[new] = False
            edges += [(u, int(v)) for v in new]
            todo += new.tolist()
    return edges


def _tile(filter_id: int, sides: np.ndarray | None, weights: np.ndarray, units: np.ndarray, lists: list[np.ndarray], least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Weighted numbers of links of each vector that count here, and a forest of them; with sides, of links between the two alone."""
    linked = units @ units.T >= least
    np.fill_diagonal(linked, False)
    if sides is not None:
        linked &= sides[:, None] != sides[None, :]
    if linked.any():
        live = np.flatnonzero(linked.any(axis=1))
        before = [lists[k][lists[k] < filter_id] for k in live]
        names, number = np.unique(np.concatenate(before), return_counts=True) if before else (np.zeros(0), np.zeros(0))
        names = names[number > 1]
        # a pair that shares an earlier filter is counted there; columns are taken in blocks
        for start in range(0, names.size, 2048):
            part = names[start : start + 2048]
            has = np.stack([np.isin(part, b, assume_unique=True) for b in before]).astype(np.float32)
            linked[np.ix_(live, live)] &= ~(has @ has.T > 0)
    return linked @ weights, _forest(linked)


def small_tiles(filters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, units: np.ndarray, lists, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the linked pairs that count in tiles of a few rows each."""
    ones, twos = [], []
    for m in np.unique(sizes):
        at = starts[sizes == m]
        i, j = np.triu_indices(m, 1)
        ones.append((at[:, None] + i[None, :]).ravel())
        twos.append((at[:, None] + j[None, :]).ravel())
    one, two = np.concatenate(ones), np.concatenate(twos)
    near = [np.flatnonzero(np.einsum("ij,ij->i", units[one[k : k + BLOCK]], units[two[k : k + BLOCK]]) >= least) + k for k in range(0, one.size, BLOCK)]
    near = np.concatenate(near) if near else np.zeros(0, int)
    one, two = one[near], two[near]
    first = [not np.intersect1d(lists[a][: np.searchsorted(lists[a], filters[a])], lists[b][: np.searchsorted(lists[b], filters[b])], assume_unique=True).size for a, b in zip(one, two, strict=True)]
    keep = np.flatnonzero(first)
    return one[keep], two[keep]


def _spanning(one: np.ndarray, two: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those pairs that join what earlier ones left apart."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    for a, b in zip(one.tolist(), two.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            above[max(x, y)] = min(x, y)
            yield a, b


def _tiles(least: float, width: str, name: str):
    """Rows sorted by tile -> (a, null, number of links that count) and (a, b, 0) for links of a forest."""

    def done(rows: pa.RecordBatch) -> pa.RecordBatch:
        """Whole tiles."""
        filters, i, j, side, node, weight = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("filter", "i", "j", "side", "node", "weight"))
        raw = rows.column("raw")
        dims = filters >> DIM_BITS
        local = filters & ((1 << DIM_BITS) - 1)
        adds = np.zeros(node.size, np.int64)
        links: list[tuple[int, int]] = []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)  # one stretch
            units = unit_rows(raw, at, width)
            new = np.r_[True, (filters[at][1:] != filters[at][:-1]) | (i[at][1:] != i[at][:-1]) | (j[at][1:] != j[at][:-1])]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.r_[starts, at.size])
            few = (sizes > 1) & (sizes <= SMALL) & (i[at][starts] == j[at][starts])
            mine = _Lists(rows.column("filters"), name, int(at[0]))
            if few.any():
                one, two = small_tiles(local[at], starts[few], sizes[few], units, mine, least)
                np.add.at(adds, at[one], weight[at[two]])
                np.add.at(adds, at[two], weight[at[one]])
                links += [(int(node[at[a]]), int(node[at[b]])) for a, b in _spanning(one, two)]
            for start, size in zip(starts[~few], sizes[~few], strict=True):
                if size < 2:
                    continue
                part = slice(start, start + size)
                sides = side[at[part]] if i[at[start]] != j[at[start]] else None
                add, forest = _tile(int(local[at[start]]), sides, weight[at[part]], units[part], mine[part], least)
                adds[at[part]] += add
                links += [(int(node[at[start + a]]), int(node[at[start + b]])) for a, b in forest]
        some = np.flatnonzero(adds)
        a = np.r_[node[some], np.array([x for x, _ in links], np.int64)]
        b = pa.array([None] * some.size + [y for _, y in links], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(np.r_[adds[some], np.zeros(len(links), np.int64)], pa.int64())], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_batches([held, batch]) if held is not None else batch
            key = [held.column(c).to_numpy(zero_copy_only=False) for c in ("filter", "i", "j")]
            other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            whole = int(other[-1]) + 1 if other.size else 0  # the last tile may go on
            if whole:
                yield done(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield done(held)

    return run


def embedding_dedup(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id long, embedding array<float>)."""
    kind = vectors.schema["embedding"].dataType.elementType
    width = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    given = F.col("embedding").cast(f"array<{'float' if width == '<f4' else 'double'}>")
    rows = materialize(vectors.select(some_id("vec_id"), given).mapInArrow(_vectors(width), "vec_id long, key binary, raw binary"), "emb-rows")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    classes = materialize(classes, "emb-classes")
    n = classes.count()
    if not n:
        return _out(rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
    # a class is named by a hash of its vector, as one vec_id can have several vectors; once more with another salt if two share one
    salt = 0
    while classes.select(F.count_distinct(F.xxhash64(F.lit(salt), "key"))).first()[0] < n:
        salt += 1
    classes = classes.withColumn("node", F.xxhash64(F.lit(salt), "key"))
    words, size = code_words(n), list_size(n)
    name = "<u4" if words <= 1 << 16 else "<i8"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, CapCode] = {}
        for batch in batches:
            raw, lists = batch.column(2), {}
            lengths = np.array([len(raw[k].as_buffer()) for k in range(batch.num_rows)], np.int64) // int(width[-1])
            for dim in np.unique(lengths):
                code = codes.get(int(dim)) or codes.setdefault(int(dim), CapCode(int(dim), words, size))
                at = np.flatnonzero(lengths == dim)
                lists |= {int(k): x for k, x in zip(at, code.decode(unit_rows(raw, at, width)), strict=True)}
            flat = [lists[k] + (int(lengths[k]) << DIM_BITS) for k in range(batch.num_rows)]
            ends = np.cumsum([0] + [x.size for x in flat]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))], names=["node", "weight", "raw", "at"])

    coded = materialize(classes.select("node", "weight", "raw").mapInArrow(decode, "node long, weight long, raw binary, at array<long>"), "emb-coded")
    names = coded.select("node", F.explode("at").alias("filter"))
    shared = names.groupBy("filter").agg(F.count("*").alias("held")).where("held > 1")
    shared = shared.withColumn("blocks", F.ceil(F.col("held") / TILE).cast("long"))
    # a filter with many vectors is one key with few rows of (node, filter); AQE splits what is left of its skew
    wanted = materialize(names.join(shared, "filter").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))), "emb-wanted")
    # what a vector carries: the filters that others share
    mine = wanted.groupBy("node").agg(F.sort_array(F.collect_list("filter")).alias("filters"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            packed = [(flat[ends[k] : ends[k + 1]] & ((1 << DIM_BITS) - 1)).astype(name).tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["node", "weight", "raw", "filters"])

    full = coded.select("node", "weight", "raw").join(mine, "node").select("node", "weight", "raw", "filters").mapInArrow(pack, "node long, weight long, raw binary, filters binary")
    # where a filter has several blocks, a vector goes to the tile of its block with each block
    dealt = wanted.select("filter", "node", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("filter", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    full = dealt.join(full, "node").repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j", "node")
    found = materialize(full.select("filter", "i", "j", "side", "node", "weight", "raw", "filters").mapInArrow(_tiles(cosine, width, name), "a long, b long, n long"), "emb-found")
    numbers = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b is not null").select("a", "b"), "emb")
    # a component is named by its smallest vec_id
    names = classes.select("node", "least").join(groups, "node").groupBy("component").agg(F.min("least").alias("component_id"))
    placed = groups.join(names, "component").select("node", "component_id")
    classes = classes.select("key", "node", "least", "weight").join(numbers, "node", "left").join(placed, "node", "left")
    classes = classes.select("key", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("vec_id", "key").join(classes, "key", "left")
    return _out(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept")))


def _out(df: DataFrame) -> DataFrame:
    return df.select(given_id("vec_id"), "n_links", given_id("component_id"), "kept")
