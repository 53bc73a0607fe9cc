"""Exact dedup by a log-structured merge index.

Each task keeps a memtable (digest -> winning id, count, text) bounded in rows and bytes. A hit in the
memtable is verified byte by byte before it is absorbed. A full memtable is flushed as a run sorted by
digest, with a filter: the places that its digests take among FILTER_BITS a row. The filters of all runs are merged, in each task
first, then by slices, into one that holds the places taken by two runs or more; entries outside it lie in one run only and skip compaction. Compaction
merges the other entries by digest and keeps one identifier; where a digest lies in several runs, one text of
each run is fetched (the scan is pruned by a filter on the wanted ids) and compared byte by byte, and texts
that share a digest but differ are split.

Filters only save work: they grow with the rows up to MOST_BITS (what is broadcast is bounded), beyond which more entries go through
compaction and the result stays the same.

Cases: null text counts as empty; empty texts are equal to each other; very long texts are compared whole, and one that fills a memtable alone is
flushed alone; repeated rows (same doc_id and text)
count once each in group_size and are flagged alike; a null doc_id is smaller than all others; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import given_id, materialize, shielded, some_id, text_of

RUN_SCHEMA = "run long, digest binary, variant int, doc_id long, entry boolean, keep long, n long, filter binary"
MEMTABLE_ROWS = 50_000
MEMTABLE_BYTES = 48 << 20
#: Bits of the runs' filter for each row, least and most of them (32 MB), slices in which it is merged; most bits of the filter on wanted ids (8 MB).
FILTER_BITS, LEAST_BITS, MOST_BITS, SLICES = 16, 1 << 16, 1 << 28, 64
ID_FILTER_BITS = 1 << 26


class Bloom:
    """Four probes into 2**k bits, vectorised over 16-byte keys."""

    @staticmethod
    def probes(keys: np.ndarray, bits: int) -> np.ndarray:
        return keys.reshape(-1, 4) & np.uint32(bits - 1)

    @staticmethod
    def build(keys: np.ndarray, bits: int) -> np.ndarray:
        out = np.zeros(bits // 8, np.uint8)
        at = Bloom.probes(keys, bits).ravel()
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out

    @staticmethod
    def test(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = Bloom.probes(keys, held.size * 8)
        return ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def digest_keys(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:16] for d in digests), "<u4")


def digest_places(digests: list[bytes], bits: int) -> np.ndarray:
    """The place of each digest among a power of two of bits."""
    return digest_keys(digests).reshape(-1, 4)[:, 0] & np.uint32(bits - 1)


def id_keys(ids: np.ndarray) -> np.ndarray:
    """Four 32-bit words from each id (splitmix64, two rounds)."""
    out = []
    for add in (0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A):
        z = ids.astype(np.uint64) + np.uint64(add)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.ascontiguousarray(np.stack(out, axis=1)).view("<u4")


class Memtable:
    """digest -> variants of (text, winning id, count); hits are verified by comparing bytes."""

    def __init__(self, keep_largest: bool):
        self.keep_largest, self.slots, self.rows, self.size = keep_largest, {}, [], 0

    def put(self, doc_id: int, text: bytes) -> None:
        digest = hashlib.sha256(text).digest()
        variants = self.slots.setdefault(digest, [])
        for k, slot in enumerate(variants):
            if slot[0] == text:
                slot[1] = max(slot[1], doc_id) if self.keep_largest else min(slot[1], doc_id)
                slot[2] += 1
                break
        else:
            k = len(variants)
            variants.append([text, doc_id, 1])
            self.size += len(text) + 200
        self.rows.append((digest, k, doc_id))

    def full(self) -> bool:
        return len(self.rows) >= MEMTABLE_ROWS or self.size >= MEMTABLE_BYTES

    def flush(self, run: int, bits: int = LEAST_BITS) -> pa.RecordBatch:
        rows = sorted(self.rows)
        seen: set[tuple[bytes, int]] = set()
        out = []
        for digest, k, doc_id in rows:
            _, keep, n = self.slots[digest][k]
            entry = doc_id == keep and (digest, k) not in seen
            if entry:
                seen.add((digest, k))
            out.append((run, digest, k, doc_id, entry, keep, n, None))
        out[0] = (*out[0][:-1], np.unique(digest_places(list(self.slots), bits)).tobytes())
        types = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
        names = ("run", "digest", "variant", "doc_id", "entry", "keep", "n", "filter")
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def build_runs(docs: DataFrame, keep_largest: bool = True, bits: int = LEAST_BITS) -> DataFrame:
    """One row per document in sorted runs; entry marks the row that stands for its text in the run."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, table = TaskContext.get().partitionId() << 24, Memtable(keep_largest)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table.put(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"")
                if table.full():
                    yield table.flush(run, bits)
                    run, table = run + 1, Memtable(keep_largest)
        if table.rows:
            yield table.flush(run, bits)

    return docs.select("doc_id", "text").mapInArrow(tasks, RUN_SCHEMA)


def shared_places(runs: DataFrame, bits: int) -> np.ndarray:
    """Bits of the places that two runs take: a task merges the filters that it reads, then slices of them are merged."""
    size = bits // SLICES  # bits of a slice

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for f in batch.column(0):
                at = np.frombuffer(f.as_buffer(), "<u4")
                byte, bit = at >> 3, (1 << (at & 7)).astype(np.uint8)
                np.bitwise_or.at(twice, byte, once[byte] & bit)
                np.bitwise_or.at(once, byte, bit)
        rows = [(k, once[k * size // 8 : (k + 1) * size // 8], twice[k * size // 8 : (k + 1) * size // 8]) for k in range(SLICES)]
        rows = [r for r in rows if r[1].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], names=["slice", "once", "twice"])

    def merge(rows: pa.Table) -> pa.Table:
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        for x, y in zip(rows.column("once"), rows.column("twice"), strict=True):
            f = np.frombuffer(x.as_buffer(), np.uint8)
            twice |= np.frombuffer(y.as_buffer(), np.uint8) | (once & f)
            once |= f
        return pa.Table.from_arrays([rows.column("slice").slice(0, 1), pa.array([twice.tobytes()], pa.binary())], names=["slice", "twice"])

    parts = runs.where("filter is not null").select("filter").coalesce(64).mapInArrow(read, "slice int, once binary, twice binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.groupBy("slice").applyInArrow(merge, "slice int, twice binary").collect():
        out[r.slice * size // 8 : (r.slice + 1) * size // 8] = np.frombuffer(r.twice, np.uint8)
    return out


def _at_places(df: DataFrame, held: np.ndarray, want: bool) -> DataFrame:
    """Rows of df whose digest takes (or doesn't take) one of the places, which are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(held)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = digest_places(batch.column("digest").to_pylist(), shared.value.size * 8)
                yield batch.filter(pa.array(((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1) == want))

    return df.mapInArrow(tasks, df.schema)


def _filtered(df: DataFrame, held: np.ndarray, column: str, keys, want: bool) -> DataFrame:
    """Rows of df whose key is (or is not) in the Bloom filter, which is broadcast."""
    bits = df.sparkSession.sparkContext.broadcast(held)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(Bloom.test(bits.value, keys(batch.column(column))) == want))

    return df.mapInArrow(tasks, df.schema)


def exact_dedup(docs: DataFrame, keep_largest: bool = True) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id long, text string)."""
    docs = docs.select(some_id("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    best = F.max if keep_largest else F.min
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (FILTER_BITS * docs.count()).bit_length()))
    runs = materialize(build_runs(docs, keep_largest, bits), "dedup-runs")
    both = shared_places(runs, bits)
    entries = runs.where("entry").select("run", "digest", "variant", "doc_id", "keep", "n")
    alone = _at_places(entries, both, False)
    maybe = _at_places(entries, both, True)
    merged = materialize(maybe.groupBy("digest").agg(best("keep").alias("keep_id"), F.sum("n").alias("group_size"), F.count("*").alias("parts")), "dedup-merged")
    differing = _differing(docs, entries.join(merged.where("parts > 1").select("digest"), "digest", "left_semi"))
    unequal = runs.where("variant > 0").select("digest").distinct()  # in one run, wherever its digests lie
    if unequal.take(1):
        differing = materialize(unequal if differing is None else unequal.union(differing).distinct(), "dedup-unequal")
    members = runs.select("run", "digest", "doc_id")
    if differing is None:
        # a member looks up the entry of its own run, so a hot group is dealt by run
        resolved = maybe.select("run", "digest").join(merged.select("digest", "keep_id", "group_size"), "digest")
        resolved = resolved.unionByName(alone.select("run", "digest", F.col("keep").alias("keep_id"), F.col("n").alias("group_size")))
        return _out(members.join(resolved, ["run", "digest"]))
    # unequal texts behind one digest: those groups are formed by the text itself
    bad = _with_digest(docs).join(differing, "digest", "left_semi")
    by_text = bad.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    rest = members.join(differing, "digest", "left_anti").join(
        merged.select("digest", "keep_id", "group_size").unionByName(alone.select("digest", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"))).join(differing, "digest", "left_anti"), "digest")
    return _out(rest).unionByName(_out(bad.join(by_text, ["digest", "text"])))


def _with_digest(docs: DataFrame) -> DataFrame:
    """Rows of one doc_id can have different texts, so texts are found by both."""
    return docs.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _differing(docs: DataFrame, hits: DataFrame) -> DataFrame | None:
    """Digests whose texts in different runs are not the same bytes; None if there are none."""
    hits = materialize(hits.select("doc_id", "digest", "variant", "run"), "dedup-hits")
    n = hits.count()
    if not n:
        return None
    size = min(ID_FILTER_BITS, 1 << max(16, (12 * n).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size // 8, np.uint8)
        for batch in batches:
            held |= Bloom.build(id_keys(batch.column(0).to_numpy()).ravel(), size)
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["held"])

    held = np.zeros(size // 8, np.uint8)
    for r in hits.select("doc_id").coalesce(8).mapInArrow(build, "held binary").collect():
        held |= np.frombuffer(r.held, np.uint8)
    wanted = _filtered(docs, held, "doc_id", lambda c: id_keys(c.to_numpy()).ravel(), True)
    texts = _with_digest(wanted).join(hits, ["doc_id", "digest"]).groupBy("digest", F.pmod("run", F.lit(64)).alias("salt")).agg(F.min("text").alias("lo"), F.max("text").alias("hi"), F.max("variant").alias("v"))
    bad = texts.groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("v").alias("v")).where("lo <> hi or v > 0").select("digest")
    bad = materialize(bad, "dedup-clash")
    return bad if bad.take(1) else None


def _out(df: DataFrame) -> DataFrame:
    return df.select(
        given_id("doc_id"), given_id("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def row_keys(docs: DataFrame, digest=None) -> DataFrame:
    """docs with the key of a row: _vs_id (NO_ID for null) and _vs_digest, that of the text where none is given."""
    found = F.unhex(F.sha2(text_of().cast("binary"), 256)) if digest is None else digest
    return docs.select("*", some_id("doc_id").alias("_vs_id"), found.alias("_vs_digest"))


def drop_keys(keyed: DataFrame, out: DataFrame) -> DataFrame:
    """The rows of keyed whose key is not in out, one of each key; both have _vs_id and _vs_digest."""
    # repeats are thinned in each task before rows are dealt, so a key with very many rows is no hot spot
    again = F.row_number().over(W.partitionBy("_vs_id", "_vs_digest").orderBy("_vs_id"))
    one = keyed.withColumn("_vs_row", again).where("_vs_row = 1")
    return one.join(out, ["_vs_id", "_vs_digest"], "left_anti").drop("_vs_id", "_vs_digest", "_vs_row")


def drop_copies(docs: DataFrame, keep_largest: bool = True) -> DataFrame:
    """docs with one row of each group of equal texts, all columns.

    Rows are found by id and text: an id, or no id, that has different texts keeps what each of them keeps.
    """
    return shielded(docs, lambda d: _drop_copies(d, keep_largest))


def _drop_copies(docs: DataFrame, keep_largest: bool) -> DataFrame:
    out = exact_dedup(docs, keep_largest).where("not kept")
    return drop_keys(row_keys(docs), row_keys(out, F.unhex("text_sha256")).select("_vs_id", "_vs_digest").distinct())
