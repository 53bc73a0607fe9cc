"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder keeps an agenda of adjacent symbol pairs that form a vocabulary piece, ordered by score and then
position; it merges the best live pair, pushes the pairs this creates, and ends with byte pieces for symbols
outside the vocabulary. Where no piece has a space mark after another character (checked at load), a text falls
apart before each run of spaces, and before line ends and marks that no piece joins to what is before them, without changing
the result; such tokens are encoded once for each worker's cache. In each Arrow batch the tokens that were not cached are
encoded and decoded by the library as well, so is one whole text of every 200, and a difference is an error.

Cases: null counts as empty; an empty text gives the end id alone and decodes to ''; repeated rows are encoded
each; extra columns are ignored. Very long texts cost time and memory in proportion.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Segments in a generation of the worker's cache; two generations are held.
CACHE = 600_000
#: Numbers of symbols up to which rows share an agenda table (longer rows have a heap), and the rank of a pair that is no piece.
SHORT, NONE = (6, 9, 12, 16, 24, 40), 1 << 62
#: In front of a token that has no space mark before it.
JOIN = "\x00"


class MergeModel:
    """A merge vocabulary read from a SentencePiece model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.names, self.plain = names, set(plain)
        self.id_of = {names[i]: i for i in plain}
        self.char_ids = self.id_of.get
        self.spelled = [names[i].replace(SPACE, " ") if i in self.plain else None for i in range(size)]
        # best score first; equal scores share a rank and then the position decides
        level = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True), 1)}
        self.rank = {names[i]: level[lib.get_score(i)] << 32 for i in plain}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.end, self.unknown = lib.eos_id(), lib.unk_id()
        self.pair_rank, self.pair_id = self._pairs()
        self.keys = np.array(sorted(self.pair_rank), np.int64)
        self.ranks, self.ids = (np.array([d[k] for k in self.keys.tolist()], np.int64) for d in (self.pair_rank, self.pair_id))
        longer = [p for p in self.id_of if len(p) > 1]
        self.apart = self._apart(longer)
        # a character that no longer piece has: what follows it is encoded as if nothing were before it
        held = set("".join(longer))
        self.guard = next(c for c in map(chr, range(1, 0xD800)) if c not in held and not c.isspace())
        self.guard_ids = lib.encode(self.guard)

    @staticmethod
    def _apart(longer: list[str]) -> re.Pattern | None:
        """Matches where a text may be cut without changing its ids, besides before a single space; None if it may not be cut.

        The places are: before a line end, where no longer piece has one; before marks that follow a letter in no piece. (The
        space mark has to be first or after another one in each piece.)
        """
        letter = r"[^\W\d_]"
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer):
            return None
        after = {b for p in longer for a, b in pairwise(p) if re.match(letter, a)}
        marks = "".join(re.escape(c) for c in ".,;:!?)" if c not in after)
        line = [] if any("\n" in p for p in longer) else [r"\n"]
        return re.compile("|".join(line + ([f"(?<={letter})[{marks}]"] if marks else [])) or "(?!)")

    def _pairs(self) -> tuple[dict[int, int], dict[int, int]]:
        """(left id, right id) in one number -> rank in the agenda, and -> id of the piece that the two form."""
        rank, merged = {}, {}
        for piece, whole in self.id_of.items():
            for k in range(1, len(piece)):
                if (a := self.id_of.get(piece[:k])) is not None and (b := self.id_of.get(piece[k:])) is not None:
                    rank[a << 24 | b], merged[a << 24 | b] = self.rank[piece], whole
        return rank, merged

    def encode_segment(self, text: str) -> list[int]:
        """Ids of one stretch of normalised text."""
        # a character outside the vocabulary is -1 and is in no pair
        symbols = list(map(self.char_ids, text, repeat(-1)))
        self.merge_long(symbols)
        return self.with_bytes(symbols, text)

    def encode_segments(self, texts: list[str]) -> list[list[int]]:
        """The same for many stretches; short ones of like length share one agenda table."""
        rows = [list(map(self.char_ids, t, repeat(-1))) for t in texts]
        order = sorted(range(len(rows)), key=lambda k: len(rows[k]))
        start = 0
        for end in [*SHORT, None]:
            stop = len(order) if end is None else bisect_right(order, end, start, key=lambda k: len(rows[k]))
            part = order[start:stop]
            if end is None:
                for k in part:
                    self.merge_long(rows[k])
            elif part:
                for k, row in zip(part, self.merge_table([rows[k] for k in part]), strict=True):
                    rows[k] = row
            start = stop
        return [self.with_bytes(r, t) for r, t in zip(rows, texts, strict=True)]

    def with_bytes(self, symbols: list[int], text: str) -> list[int]:
        """Byte pieces (or the unknown id) for the characters that stayed -1."""
        if -1 not in symbols:
            return symbols
        out: list[int] = []
        at = 0
        for x in symbols:
            if x >= 0:
                out.append(x)
                at += len(self.names[x])
                continue
            if self.byte_ids:
                out += [self.byte_ids[b] for b in text[at].encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
            at += 1
        return out

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and ids of pairs; NONE where a pair is no piece."""
        pairs = (a << 24) | b
        at = np.minimum(np.searchsorted(self.keys, pairs), self.keys.size - 1)
        held = (self.keys[at] == pairs) & (a >= 0) & (b >= 0)
        return np.where(held, self.ranks[at], NONE), self.ids[at]

    def merge_table(self, rows: list[list[int]]) -> list[list[int]]:
        """Merges many rows at once. A row's agenda holds the rank of each adjacent pair; in each turn the best, leftmost entry
        of every row goes first, its pair becomes one symbol, and the entries on both sides of it are renewed."""
        width = max(map(len, rows)) + 1
        symbols = np.full((len(rows), width), -3, np.int64)  # -3 after a row's end
        for k, r in enumerate(rows):
            symbols[k, : len(r)] = r
        agenda = self.look_up(symbols[:, :-1], symbols[:, 1:])[0]
        columns = np.arange(width)
        live = np.arange(len(rows))
        while live.size:
            part = agenda[live]
            best = part.argmin(axis=1)
            more = part[np.arange(live.size), best] < NONE
            live, best = live[more], best[more]
            if not live.size:
                break
            row = symbols[live]
            each = np.arange(live.size)
            new = self.look_up(row[each, best], row[each, best + 1])[1]
            after = np.minimum(columns[None, :] + (columns[None, :] > best[:, None]), width - 1)
            row = np.take_along_axis(row, after, axis=1)
            row[:, -1] = -3
            row[each, best] = new
            entries = np.take_along_axis(agenda[live], np.minimum(after[:, :-1], width - 2), axis=1)
            entries[:, -1] = NONE
            entries[each, best] = self.look_up(new, row[each, np.minimum(best + 1, width - 1)])[0]
            left = np.flatnonzero(best)
            entries[left, best[left] - 1] = self.look_up(row[left, best[left] - 1], new[left])[0]
            symbols[live], agenda[live] = row, entries
        return [r[: r.index(-3)] for r in symbols.tolist()]

    def merge_long(self, symbols: list[int]) -> None:
        """The same with the agenda as a heap, for long stretches."""
        rank, n = self.pair_rank.get, len(symbols)
        agenda = [r | i for i, (a, b) in enumerate(pairwise(symbols)) if (r := rank(a << 24 | b))]
        heapify(agenda)
        # a symbol that was merged into its left neighbour is -2; a sentinel stands at the end
        right, left = list(range(1, n + 2)), list(range(-1, n))
        symbols.append(-1)
        while agenda:
            top = heappop(agenda)
            i = top & 0xFFFFFFFF
            a, j = symbols[i], right[i]
            if a < 0 or rank(pair := a << 24 | symbols[j]) != top - i:
                continue  # one of the two has changed since
            symbols[i], symbols[j] = (a := self.pair_id[pair]), -2
            right[i] = k = right[j]
            left[k] = i
            if r := rank(a << 24 | symbols[k]):
                heappush(agenda, r | i)
            if (h := left[i]) >= 0 and (b := symbols[h]) >= 0 and (r := rank(b << 24 | a)):
                heappush(agenda, r | h)
        symbols[:] = [x for x in symbols[:n] if x != -2]

    def cut(self, text: str) -> list[str]:
        """Tokens that are encoded one by one: each has a space mark in front, unless it starts with JOIN."""
        if not text:
            return []
        if self.apart is None or JOIN in text:
            return [JOIN + SPACE + text.replace(" ", SPACE)]
        tokens = self.apart.sub(f" {JOIN}\\g<0>", text).split(" ")
        if "" in tokens or SPACE in text:
            # a run of spaces belongs to what follows it
            return [t[1:] for t in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        return tokens

    def symbols_of(self, token: str) -> str:
        return token[1:] if token.startswith(JOIN) else SPACE + token.replace(" ", SPACE)

    def encode(self, text: str, add_end: bool = True) -> list[int]:
        out = [i for t in self.cut(text) for i in self.encode_segment(self.symbols_of(t))]
        return out + [self.end] if add_end else out

    def decode(self, ids: list[int], strip: bool = True) -> str:
        """Text of ids: runs of byte pieces are read as UTF-8, control ids give nothing, one leading space goes."""
        spelled = self.spelled
        try:
            text = "".join([spelled[i] for i in ids])
            return text[1:] if strip and text.startswith(" ") else text
        except TypeError:  # a byte or control piece
            pass
        out: list[str] = []
        held = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i is not None and (i in self.plain):
                out.append(self.names[i].replace(SPACE, " "))
        text = "".join(out)
        return text[1:] if strip and text.startswith(" ") else text


def _own(token: str) -> str:
    """The characters of a token, a space in front unless it is joined."""
    return token[1:] if token.startswith(JOIN) else " " + token


class SegmentCache:
    """token -> its ids as text, two generations; misses are checked with the library.

    The decoded text of a token is kept in `texts` where it isn't the token's own characters.
    """

    def __init__(self, model: MergeModel):
        self.model, self.new, self.old, self.texts = model, {}, {}, {}

    def check(self, misses: list[str], found: list[list[int]], texts: list[str]) -> None:
        """Each token is what the library makes of it, alone or, where no space mark is in front, behind the guard; so is its text."""
        lib, guard = self.model.lib, self.model.guard
        alone = [bool(t) and not t.startswith(JOIN) for t in misses]
        said = lib.encode([t if a else guard + self.model.symbols_of(t) for t, a in zip(misses, alone, strict=True)], num_threads=1)
        spelled = lib.decode(said, num_threads=1)
        for token, a, ids, spelling, mine, text in zip(misses, alone, said, spelled, found, texts, strict=True):
            if ids != (mine if a else self.model.guard_ids + mine):
                raise ValueError(f"encoding differs from the library: {token!r}: {mine} and {ids}")
            if spelling != (text[1:] if a and text.startswith(" ") else text if a else guard + text):
                raise ValueError(f"decoding differs from the library: {token!r}: {text!r}")

    def check_text(self, text: str, ids: str, decoded: str) -> None:
        """One whole text and its decoding against the library."""
        said = self.model.lib.encode(text)
        if " ".join(map(str, said)) != ids or self.model.lib.decode(said) != decoded:
            raise ValueError(f"a text's encoding or decoding differs from the library: {text[:200]!r}")

    def fill(self, tokens: set[str]) -> None:
        new, old = self.new, self.old
        unknown = tokens.difference(new)
        kept = unknown.intersection(old)
        new.update((t, old[t]) for t in kept)
        misses = list(unknown - kept)
        found = self.model.encode_segments([self.model.symbols_of(t) for t in misses])
        texts = [self.model.decode(ids, strip=False) for ids in found]
        self.check(misses, found, texts)
        new.update((t, " ".join(map(str, ids))) for t, ids in zip(misses, found, strict=True))
        self.texts.update((t, x) for t, x in zip(misses, texts, strict=True) if x != _own(t))

    def trim(self) -> None:
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
            self.texts = {t: x for t, x in self.texts.items() if t in self.old}

    def run(self, tokens: list[str]) -> tuple[str, str]:
        """Ids as text and decoded text of one document."""
        ids = " ".join(map(self.new.__getitem__, tokens))
        if self.texts.keys().isdisjoint(tokens):
            return ids, " ".join(tokens).replace(f" {JOIN}", "")
        text = "".join([self.texts[t] if t in self.texts else _own(t) for t in tokens])
        return ids, text[1:] if text.startswith(" ") else text


_caches: dict[str, SegmentCache] = {}


def sentencepiece_roundtrip(docs: DataFrame, model_file: str, keep: bool = False) -> DataFrame:
    """Ids with an end id and their decoding, as digests; with keep, also the ids and the text themselves."""
    schema = SCHEMA + (", ids array<int>, decoded string" if keep else "")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _caches:  # kept by the worker for its next tasks
            _caches[model_file] = SegmentCache(MergeModel(model_file))
        cache = _caches[model_file]
        model = cache.model
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                ids, texts = batch.column(0).slice(start, 500), batch.column(1).slice(start, 500).to_pylist()
                parts = [model.cut(t or "") for t in texts]
                cache.fill(set().union(*parts))
                cols: tuple[list, ...] = ([], [], [], [], [])
                for k, p in enumerate(parts):
                    said, text = cache.run(p)
                    if k % 200 == 0:
                        cache.check_text(texts[k] or "", said, text)
                    said = f"{said} {model.end}" if said else str(model.end)
                    for c, v in zip(cols, (said.count(" ") + 1, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), said, text), strict=True):
                        c.append(v)
                cache.trim()
                out = [ids, pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2])]
                if keep:
                    out += [pa.array([list(map(int, x.split())) for x in cols[3]], pa.list_(pa.int32())), pa.array(cols[4])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(out)]
                yield pa.RecordBatch.from_arrays([x.cast(pa.string()) if pa.types.is_string(x.type) else x for x in out], names=names)

    return docs.select("doc_id", "text").mapInArrow(tasks, schema)
