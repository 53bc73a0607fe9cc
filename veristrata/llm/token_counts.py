"""Token counts by a two-tier lookup of pre-tokens on the map side.

Tier one is a broadcast table of frequent pre-tokens' lengths in tokens, at most TABLE_ROWS: the most frequent of all documents' pre-tokens,
every one of which is counted, then the vocabulary's entries that are whole pre-tokens. Tasks count words, cut where white space begins, as no
pre-token goes over such a place, and split each different word once; the sums are dealt by pre-token. Tier two is a cache that a worker
keeps for its next tasks; what neither holds is encoded by the library in Arrow batches. The table changes how fast a count comes, never what it is.

Cases: null counts as empty; an empty text has 0 bytes and 0 tokens; strings of special tokens inside a text are
one token each, as the library's default has them; very long texts are counted whole; of equally frequent pre-tokens all or none are in the
table; an empty table gives an empty result; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: Most rows of the broadcast table; different words that a task holds before it writes their pre-tokens out; most entries of a worker's cache.
TABLE_ROWS = 60_000
HELD_WORDS = 200_000
CACHE = 400_000
#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words with the white space before them, or white space at the end.
WORD = regex.compile(r"\s*\S+|\s+").findall


class PreTokens:
    """Splits texts as the tokenizer does, and counts the tokens of single pre-tokens with the library."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        spec = json.load(open(tokenizer_file, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] is not None or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a byte-level tokenizer with the standard pattern")
        self.lib = Tokenizer.from_file(tokenizer_file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings")
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.find = regex.compile(PATTERN).findall
        self.alphabet = spec["model"]["vocab"]

    def pieces(self, text: str) -> list[str]:
        """What stands between special strings."""
        return self.at_special.split(text) if any(s in text for s in self.special) else [text]

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens outside special strings, and the number of special strings."""
        pieces = self.pieces(text)
        return [t for p in pieces for t in self.find(p)], len(pieces) - 1

    def lengths(self, pre_tokens: list[str]) -> list[int]:
        return [len(e) for e in self.lib.encode_batch_fast(pre_tokens, add_special_tokens=False)]


    def whole_entries(self) -> list[str]:
        """Entries of the vocabulary that are one pre-token, in text form."""
        byte = {c: b for b, c in byte_letters().items()}
        out = []
        for entry in self.alphabet:
            try:
                text = bytes(byte[c] for c in entry).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if text and self.find(text) == [text]:
                out.append(text)
        return out


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def pre_token_counts(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """t, n: how often each pre-token stands in all texts of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, words, rest = _worker(tokenizer_file)[0], Counter(), Counter()

        def flush() -> pa.RecordBatch:
            for word, n in words.items():
                for t in pre.find(word):
                    rest[t] += n
            out = pa.RecordBatch.from_arrays([pa.array(list(rest), pa.string()), pa.array(list(rest.values()), pa.int64())], names=["t", "n"])
            words.clear()
            rest.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                for piece in pre.pieces(text.as_py() or ""):
                    words.update(WORD(piece))
                if len(words) > HELD_WORDS:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))


def frequent_lengths(docs: DataFrame, tokenizer_file: str, rows: int = TABLE_ROWS) -> dict[str, int]:
    """The broadcast table: the most frequent pre-tokens of docs, then the vocabulary's, at most `rows` entries."""
    counts = materialize(pre_token_counts(docs, tokenizer_file).where(F.length("t") <= 64), "tokens-counts")
    # how many pre-tokens have each count, from the largest on; at most `rows` of these numbers matter, as each is 1 at least
    cut, left = None, rows
    for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(rows).collect():
        left -= r.k
        if left < 0:
            break
        cut = r.n
    names = [] if cut is None else [r.t for r in sorted(counts.where(F.col("n") >= cut).collect(), key=lambda r: (-r.n, r.t))]
    drop_tables(counts)
    pre = PreTokens(tokenizer_file)
    names = list(dict.fromkeys([*names, *pre.whole_entries()]))[:rows]
    return dict(zip(names, pre.lengths(names), strict=True))


_workers: dict[str, tuple[PreTokens, dict[str, int]]] = {}


def _worker(tokenizer_file: str) -> tuple[PreTokens, dict[str, int]]:
    """The splitter and the cache that this worker process keeps."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if tokenizer_file not in _workers:
        _workers[tokenizer_file] = (PreTokens(tokenizer_file), {})
    return _workers[tokenizer_file]


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer_file))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, known = _worker(tokenizer_file)
        table = shared.value
        known.update(table)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                if len(known) > CACHE:
                    known.clear()
                    known.update(table)
                texts = [t or "" for t in batch.column(1).slice(start, 200).to_pylist()]
                parts = [pre.split(t) for t in texts]
                misses = list(set().union(*[p for p, _ in parts]).difference(known))
                known.update(zip(misses, pre.lengths(misses), strict=True))
                counts = [sum(map(known.__getitem__, p)) + n for p, n in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, 200), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tasks, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
