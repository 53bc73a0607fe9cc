"""The folds of `matching`, local boxes and grids of settings over Arrow batches: all images of a batch advance one prediction at a time.

A batch is flat: one array for each side of all its boxes, and where each image's boxes start. Overlaps are computed once for each pair of
boxes of an image; what follows reads only pairs that reach the least overlap. Null sides are NaN, which fmin and fmax pass over as
SQL's least and greatest pass over null; a null confidence comes first, as in the folds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIDES = ("x0", "y0", "x1", "y1")


class Boxes:
    """Arrays of boxes: `n` of each image, `img` of each box, columns as numpy arrays, `odd` images that hold a null or NaN."""

    def __init__(self, lists: pa.Array, names: tuple[str, ...]):
        self.null = np.asarray(lists.is_null().to_numpy(zero_copy_only=False), bool)
        self.n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.r_[0, np.cumsum(self.n)]
        self.img = np.repeat(np.arange(self.n.size), self.n)
        flat = lists.flatten()
        odd = np.zeros(len(flat), bool)
        if flat.null_count:
            odd |= flat.is_null().to_numpy(zero_copy_only=False)
        for name in names:
            col = flat.field(name)
            if col.null_count:
                odd |= col.is_null().to_numpy(zero_copy_only=False)
            whole = name in ("i", "j", "model")
            x = pc.fill_null(col, 0 if whole else float("nan")).to_numpy(zero_copy_only=False)
            x = x.astype(np.int64) if whole else x
            if not whole:
                odd |= np.isnan(x)
            setattr(self, name, x)
        self.odd = self.null.copy()
        self.odd[self.img[odd]] = True

    def falling(self, name: str) -> np.ndarray:
        """Images whose indices do not rise strictly: an index may stand twice."""
        x, out = getattr(self, name), np.zeros(self.n.size, bool)
        if x.size > 1:
            out[self.img[1:][(self.img[1:] == self.img[:-1]) & (x[1:] <= x[:-1])]] = True
        return out

    def taken(self, at: np.ndarray) -> Boxes:
        """The boxes at `at`, which keeps boxes of an image together and images in order."""
        out = object.__new__(Boxes)
        out.n = np.bincount(self.img[at], minlength=self.n.size)
        out.start = np.r_[0, np.cumsum(out.n)]
        for k, v in self.__dict__.items():
            if k not in ("n", "start"):
                setattr(out, k, v if k in ("odd", "null") else v[at])
        return out


def overlaps(a, p: np.ndarray, b, q: np.ndarray, shift: float = 0.0) -> np.ndarray:
    """Overlap of box p[k] of a with box q[k] of b, moved to the right."""
    ax0, ay0, ax1, ay1 = (getattr(a, s)[p] for s in SIDES)
    bx0, by0, bx1, by1 = (getattr(b, s)[q] for s in SIDES)
    if shift:
        bx0, bx1 = bx0 + shift, bx1 + shift
    side = lambda x: np.fmax(0.0, x)
    shared = side(np.fmin(ax1, bx1) - np.fmax(ax0, bx0)) * side(np.fmin(ay1, by1) - np.fmax(ay0, by0))
    return shared / np.fmax(1e-12, side(ax1 - ax0) * side(ay1 - ay0) + side(bx1 - bx0) * side(by1 - by0) - shared)


def pairs(a, b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (box of a, box of b) of the same image, by box of a."""
    many = b.n[a.img]
    p = np.repeat(np.arange(a.img.size), many)
    return p, np.arange(p.size) - np.repeat(np.cumsum(many) - many, many) + np.repeat(b.start[a.img], many)


def ranked(b, *after: np.ndarray) -> np.ndarray:
    """Order of all boxes by image, falling confidence (null first), then `after`."""
    key = np.where(np.isnan(b.conf), -np.inf, -b.conf)
    return np.lexsort((*reversed(after), key, b.img))


def places(b) -> np.ndarray:
    """The place of each box in its image."""
    return np.arange(b.img.size) - b.start[b.img]


def _turns(rank: np.ndarray):
    """Slices of pairs, sorted by rank, that belong to one rank."""
    if rank.size:
        cuts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
        yield from zip(cuts, np.r_[cuts[1:], rank.size], strict=True)


def _firsts(at: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of the pairs `at`, grouped by p, the first of each group."""
    own = p[at]
    return at[np.r_[True, own[1:] != own[:-1]]] if at.size else at


def match(preds, gts, least, high_index_wins: bool = True, pq=None):
    """For ranked predictions the true box that each takes, or -1, and the overlap. pq: pairs and their overlaps, if known."""
    p, q, o = pq or (lambda p, q: (p, q, overlaps(gts, q, preds, p)))(*pairs(preds, gts))
    keep = np.flatnonzero(o >= (least[preds.img[p]] if isinstance(least, np.ndarray) else least))
    p, q, o = p[keep], q[keep], o[keep]
    rank = places(preds)[p]
    order = np.lexsort((gts.j[q] * (-1 if high_index_wins else 1), -o, p, rank))
    p, q, o, rank = p[order], q[order], o[order], rank[order]
    free, got, far = np.ones(gts.img.size, bool), np.full(preds.img.size, -1), np.full(preds.img.size, np.nan)
    for lo, hi in _turns(rank):
        first = _firsts(lo + np.flatnonzero(free[q[lo:hi]]), p)
        free[q[first]] = False
        got[p[first]], far[p[first]] = q[first], o[first]
    return got, far


def suppress(preds, least, pq=None) -> np.ndarray:
    """For ranked predictions the first kept one that suppresses each, or -1. pq: pairs (later, earlier) and their overlaps, if known."""
    p, q, o = pq or own_pairs(preds)
    keep = np.flatnonzero(o >= (least[preds.img[p]] if isinstance(least, np.ndarray) else least))
    p, q = p[keep], q[keep]
    rank = places(preds)[p]
    order = np.lexsort((q, p, rank))
    p, q, rank = p[order], q[order], rank[order]
    kept, by = np.ones(preds.img.size, bool), np.full(preds.img.size, -1)
    for lo, hi in _turns(rank):
        first = _firsts(lo + np.flatnonzero(kept[q[lo:hi]]), p)
        kept[p[first]] = False
        by[p[first]] = q[first]
    return by


def own_pairs(preds):
    """Pairs (later, earlier) of an image's ranked predictions, and their overlaps."""
    p, q = pairs(preds, preds)
    keep = q < p
    p, q = p[keep], q[keep]
    return p, q, overlaps(preds, q, preds, p)


def one_to_one(a, b, least: np.ndarray):
    """(box of a, box of b, overlap), the best overlap of an image first, each box once."""
    p, q = pairs(a, b)
    o = overlaps(a, p, b, q)
    keep = np.flatnonzero((o >= least[a.img[p]]) & (o > 0))
    p, q, o = p[keep], q[keep], o[keep]
    order = np.lexsort((-b.i[q], -a.i[p], -o, a.img[p]))
    p, q, o = p[order], q[order], o[order]
    n = np.bincount(a.img[p], minlength=a.n.size)
    rank = np.arange(p.size) - np.repeat(np.cumsum(n) - n, n)
    turn = np.argsort(rank, kind="stable")
    open_a, open_b, taken = np.ones(a.img.size, bool), np.ones(b.img.size, bool), np.zeros(p.size, bool)
    for lo, hi in _turns(rank[turn]):
        at = turn[lo:hi]
        at = at[open_a[p[at]] & open_b[q[at]]]
        open_a[p[at]] = open_b[q[at]] = False
        taken[at] = True
    return p[taken], q[taken], o[taken]


def listed(n: np.ndarray, null: np.ndarray, **columns) -> pa.Array:
    """Arrays of structs, n for each image; null where `null` holds."""
    flat = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), flat, mask=pa.array(null))


def int32(x: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.astype(np.int32), pa.int32(), mask=none)


def double(x: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    return pa.array(x, pa.float64(), mask=none)


# ---------------------------------------------------------------- the folds of `matching`
def _least(least: pa.Array) -> np.ndarray:
    return pc.fill_null(least, float("nan")).to_numpy(zero_copy_only=False)


def greedy(preds: pa.Array, gts: pa.Array, least: pa.Array, high_index_wins: bool, ties_last_first: bool) -> pa.Array:
    """matching.greedy_match; null for images that hold a null, NaN or a repeated index."""
    b, g = Boxes(preds, ("i", "conf", *SIDES)), Boxes(gts, ("j", *SIDES))
    b = b.taken(ranked(b, -b.i if ties_last_first else b.i))
    got, far = match(b, g, _least(least), high_index_wins)
    none = got < 0
    return listed(b.n, b.odd | g.odd | g.falling("j"), i=int32(b.i), conf=double(b.conf), j=int32(g.j[got] if g.j.size else got, none), iou=double(far, none))


def union(preds: pa.Array, least: pa.Array, cap: int, by_model: bool) -> pa.Array:
    """matching.union_nms; null for images that hold a null or NaN."""
    b = Boxes(preds, ("i", "conf", "model", *SIDES))
    b = b.taken(ranked(b, b.model, b.i) if by_model else ranked(b, b.i))
    by = suppress(b, _least(least))
    kept = by < 0
    top = np.where(kept, np.arange(by.size), by)
    gone = np.bincount(by[~kept], minlength=by.size)
    order = np.lexsort((b.model, top))
    one, model = top[order], b.model[order]
    new = np.r_[True, (one[1:] != one[:-1]) | (model[1:] != model[:-1])] if one.size else np.zeros(0, bool)
    one, model = one[new], model[new]
    at = np.flatnonzero(kept)
    k = b.taken(at)
    at = at[places(k) < cap]
    inside = np.zeros(by.size, bool)
    inside[at] = True
    model = model[inside[one]]
    k = b.taken(at)
    models = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(one, minlength=by.size)[at])], pa.int32()), int32(model))
    return listed(k.n, b.odd, i=int32(k.i), conf=double(k.conf), model=int32(k.model), **{s: double(getattr(k, s)) for s in SIDES}, models=models, suppressed=int32(gone[at]))


def union_greedy(preds: pa.Array, gts: pa.Array, least: pa.Array) -> pa.Array:
    """matching.union_match; null for images that hold a null, NaN or a repeated index."""
    b, g = Boxes(preds, ("i", "conf", "model", *SIDES)), Boxes(gts, ("j", *SIDES))
    b = fused(b, _least(least))
    got, far = match(b, g, 0.5)
    none = got < 0
    return listed(b.n, b.odd | g.odd | g.falling("j"), i=int32(b.i), conf=double(b.conf), j=int32(g.j[got] if g.j.size else got, none), iou=double(far, none))


def fused(b, least, cap: int = 300):
    """What union suppression keeps, ranked for matching."""
    b = b.taken(ranked(b, b.model, b.i))
    b = b.taken(np.flatnonzero(suppress(b, least) < 0))
    b = b.taken(np.flatnonzero(places(b) < cap))
    return b.taken(ranked(b, b.i))


def audit(preds: pa.Array, least: pa.Array) -> pa.Array:
    """matching.nms_audit; null for images that hold a null or NaN."""
    b = Boxes(preds, ("i", "conf", *SIDES))
    b = b.taken(ranked(b, b.i))
    by = suppress(b, _least(least))
    return listed(b.n, b.odd, i=int32(b.i), conf=double(b.conf), by=int32(b.i[by] if by.size else by, by < 0))


def paired(a: pa.Array, b: pa.Array, least: pa.Array) -> pa.Array:
    """matching.global_match; null for images that hold a null, NaN or a repeated index."""
    x, y = Boxes(a, ("i", *SIDES)), Boxes(b, ("i", *SIDES))
    p, q, o = one_to_one(x, y, _least(least))
    return listed(np.bincount(x.img[p], minlength=x.n.size), x.odd | y.odd | x.falling("i") | y.falling("i"), iou=double(o), ai=int32(x.i[p]), bi=int32(y.i[q]))


def nearest(gts: pa.Array, preds: pa.Array) -> pa.Array:
    """For each true box the largest (overlap, confidence) of all predictions, null without any; null for images that hold a null or NaN."""
    g, b = Boxes(gts, SIDES), Boxes(preds, ("conf", *SIDES))
    p, q = pairs(g, b)
    o, none = overlaps(g, p, b, q), b.n[g.img] == 0
    top, conf = np.zeros(g.img.size), np.zeros(g.img.size)
    if p.size:
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        top[~none] = np.maximum.reduceat(o, starts)
        conf[~none] = np.maximum.reduceat(np.where(o == top[p], b.conf[q], -np.inf), starts)
    flat = pa.StructArray.from_arrays([double(top), double(conf)], names=["iou", "conf"], mask=pa.array(none))
    return pa.ListArray.from_arrays(pa.array(g.start, pa.int32()), flat, mask=pa.array(g.odd | b.odd))


def hits(preds: pa.Array, gts: pa.Array, overlaps_at: list[float]) -> pa.Array:
    """(i, conf, hits) of each prediction by falling (confidence, index): bit k of hits says that it takes a true box at the k-th overlap. Null for images that hold a null, NaN or a repeated index."""
    b, g = Boxes(preds, ("i", "conf", *SIDES)), Boxes(gts, ("j", *SIDES))
    b = b.taken(ranked(b, -b.i))
    p, q = pairs(b, g)
    o = overlaps(g, q, b, p)
    keep = o >= min(overlaps_at)
    pq, bits = (p[keep], q[keep], o[keep]), np.zeros(b.img.size, np.int64)
    for k, t in enumerate(overlaps_at):
        bits |= (match(b, g, t, pq=pq)[0] >= 0).astype(np.int64) << k
    return listed(b.n, b.odd | g.odd | g.falling("j"), i=int32(b.i), conf=double(b.conf), hits=pa.array(bits))


# ---------------------------------------------------------------- grids of settings, one read of an image's boxes for all
def _counts(g, base, shown: np.ndarray, found: np.ndarray) -> tuple[int, ...]:
    """tp, fp, fn, gained and lost against base; shown: predictions, found: true boxes, both as flags."""
    tp = int(found.sum())
    return tp, int(shown.sum()) - tp, found.size - tp, int((found & ~base).sum()), int((base & ~found).sum())


def _taken_boxes(b, g, inverse: np.ndarray, conf: np.ndarray, report: float, pq) -> np.ndarray:
    """Flags of the true boxes that a matching finds at the report threshold; inverse: the place of each prediction in the matching's order."""
    p, q, o = pq
    got = match(b, g, 0.5, pq=(inverse[p], q, o))[0][inverse]
    found = np.zeros(g.img.size, bool)
    found[got[(got >= 0) & (conf >= report)]] = True
    return found


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(order.size, np.int64)
    out[order] = np.arange(order.size)
    return out


def fusion_counts(preds: pa.Array, gts: pa.Array, settings: list[tuple[tuple[int, ...], float]], report: float, base: int, split: bool) -> list[tuple[int, ...]]:
    """For each (models, least overlap) the counts of the boxes that union suppression keeps, against setting `base`. split: odd boxes of model 1 are of model 2."""
    b, g = Boxes(preds, ("i", "conf", "model", *SIDES)), Boxes(gts, ("j", *SIDES))
    if split:
        b.model = np.where((b.model == 1) & (b.i % 2 == 1), 2, b.model)
    b = b.taken(ranked(b, b.model, b.i))
    p, q, o = own_pairs(b)
    keep = o >= min(least for _, least in settings)
    p, q, o = p[keep], q[keep], o[keep]
    mp, mq = pairs(b, g)
    mo = overlaps(g, mq, b, mp)
    keep = mo >= 0.5
    mp, mq, mo = mp[keep], mq[keep], mo[keep]
    inverse = _inverse(ranked(b, b.i))
    seen = np.nan_to_num(b.conf, nan=-np.inf) >= report
    held = []
    for models, least in settings:
        inside = np.isin(b.model, models)
        both = inside[p] & inside[q]
        kept = inside & (suppress(b, least, (p[both], q[both], o[both])) < 0)
        if b.n.size and b.n.max() > 300:
            upto = np.cumsum(kept)
            kept &= upto - np.r_[0, upto][b.start[b.img]] <= 300
        mine = kept[mp]
        held.append((kept & seen, _taken_boxes(b, g, inverse, b.conf if report > -np.inf else np.zeros(b.img.size), report, (mp[mine], mq[mine], mo[mine]))))
    return [_counts(g, held[base][1], *x) for x in held]


class Locals:
    """Candidates (boxes of model 0, `c`), and by scale the best other box of the image, moved and weakened: `iou` (NaN without any), `conf`, `k` (its index) and sides."""

    def __init__(self, preds: pa.Array, scales: tuple[int, ...]):
        b = Boxes(preds, ("i", "conf", "model", *SIDES))
        self.c = c = b.taken(np.flatnonzero(b.model == 0))
        p, q = pairs(c, b)
        keep = c.i[p] != b.i[q]
        p, q = p[keep], q[keep]
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if p.size else np.zeros(0, int)
        some = p[starts]
        group = np.repeat(np.arange(starts.size), np.diff(np.r_[starts, p.size]))
        self.scale = {}
        for s in scales:
            o = overlaps(c, p, b, q, float(s))
            conf = b.conf * (1 - s / 10)
            key = np.where(np.isnan(conf), -np.inf, conf)[q]
            best = {n: np.full(c.img.size, np.nan) for n in ("iou", "conf", "k", *SIDES)}
            if p.size:
                at = np.flatnonzero(o == np.maximum.reduceat(o, starts)[group])
                at = at[key[at] == _top(key, at, group, starts.size)[group[at]]]
                at = at[-b.i[q[at]] == _top(-b.i[q].astype(float), at, group, starts.size)[group[at]]]
                at = at[np.r_[True, p[at][1:] != p[at][:-1]]]
                w = q[at]
                best["iou"][some], best["conf"][some], best["k"][some] = o[at], conf[w], b.i[w]
                for n in SIDES:
                    best[n][some] = getattr(b, n)[w] + (s if n in ("x0", "x1") else 0)
            self.scale[s] = _Box(best)


class _Box:
    def __init__(self, columns: dict[str, np.ndarray]):
        self.__dict__.update(columns)


def _top(values: np.ndarray, at: np.ndarray, group: np.ndarray, number: int) -> np.ndarray:
    out = np.full(number, -np.inf)
    np.maximum.at(out, group[at], values[at])
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """x to nine digits as Spark rounds: half away from zero of the shortest decimal form."""
    from decimal import ROUND_HALF_UP, Decimal

    y = np.abs(x) * 1e9
    out = np.copysign(np.floor(y + 0.5) / 1e9, x)
    for k in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def _medians(values: np.ndarray) -> np.ndarray:
    """Medians of the rows, without NaN; NaN where nothing is left."""
    s, n = np.sort(values, axis=1), (~np.isnan(values)).sum(axis=1)
    at = lambda k: s[np.arange(n.size), np.maximum(k, 0)]
    return np.where(n > 0, (at((n + 1) // 2 - 1) + at(n // 2)) / 2, np.nan) if n.size else np.zeros(0)


def _scale_pairs(found: Locals, scales: tuple[int, ...]) -> dict[tuple[int, int], np.ndarray]:
    """Overlaps of the local boxes of two scales; NaN where one is lacking."""
    every = np.arange(found.c.img.size)
    return {(a, b): np.where(np.isnan(found.scale[a].iou) | np.isnan(found.scale[b].iou), np.nan, overlaps(found.scale[a], every, found.scale[b], every)) for k, a in enumerate(scales) for b in scales[k + 1 :]}


def local_boxes(preds: pa.Array, scales: tuple[int, ...]) -> pa.Array:
    """(pred_index, scale, local_index, iou, conf, x0) of each candidate and scale."""
    found = Locals(preds, scales)
    c, many = found.c, len(scales)
    each = lambda n: np.stack([getattr(found.scale[s], n) for s in scales], axis=1).ravel()
    none, conf = np.isnan(each("iou")), each("conf")
    x0 = each("x0")
    return listed(c.n * many, c.null, pred_index=int32(np.repeat(c.i, many)), scale=int32(np.tile(scales, c.img.size)), local_index=int32(np.nan_to_num(each("k")), none),
                  iou=double(each("iou"), none), conf=double(conf, np.isnan(conf)), x0=double(x0, np.isnan(x0)))


def consensus(preds: pa.Array, scales: tuple[int, ...], least: float, agree: float) -> pa.Array:
    """Of each candidate: how many local boxes are valid and agree, the middle overlap of valid ones, the median box and confidence, and the spread of centres in diagonals."""
    found = Locals(preds, scales)
    c, size = found.c, found.c.img.size
    valid = np.stack([found.scale[s].iou >= least for s in scales], axis=1)
    agreeing, of_pairs = np.zeros(valid.shape, bool), []
    for (a, b), o in _scale_pairs(found, scales).items():
        i, j = scales.index(a), scales.index(b)
        both = valid[:, i] & valid[:, j]
        of_pairs.append(np.where(both, o, np.nan))
        agreeing[:, i] |= both & (o >= agree)
        agreeing[:, j] |= both & (o >= agree)
    columns = {n: np.where(agreeing, np.stack([getattr(found.scale[s], n) for s in scales], axis=1), np.nan) for n in ("conf", *SIDES)}
    ok = agreeing.sum(axis=1) >= 2
    out = {n: np.where(ok, _medians(columns[n]), getattr(c, n)) for n in SIDES}
    conf = np.where(ok, np.fmax(c.conf, _medians(columns["conf"])), c.conf)
    x, y = (columns["x0"] + columns["x1"]) / 2, (columns["y0"] + columns["y1"]) / 2
    far = np.hypot(x - _medians(x)[:, None], y - _medians(y)[:, None])
    far = np.fmax.reduce(far, axis=1) if size else np.zeros(0)
    spread = far / np.fmax(np.hypot(c.x1 - c.x0, c.y1 - c.y0), 1e-12)
    middle = _medians(np.stack(of_pairs, axis=1))
    return listed(c.n, c.null, pred_index=int32(c.i), valid=int32(valid.sum(axis=1)), agreeing=int32(agreeing.sum(axis=1)), confirmed=pa.array(ok), pair_iou=double(np.nan_to_num(middle)), **{n: double(v, np.isnan(v)) for n, v in out.items()}, conf=double(conf, np.isnan(conf)), dispersion=double(spread, ~ok | np.isnan(spread)))


def signal_keys(found: Locals, scales: tuple[int, ...]) -> list[np.ndarray]:
    """By signal the values by which candidates are routed, least first: confidence, shorter side, and instability reversed."""
    c = found.c
    middle = _medians(np.stack(list(_scale_pairs(found, scales).values()), axis=1))
    lacks = np.any(np.isnan(np.stack([found.scale[s].iou for s in scales], axis=1)), axis=1)
    return [c.conf, np.fmin(c.x1 - c.x0, c.y1 - c.y0), -np.where(lacks, 1.0, rounded(1 - np.where(lacks, 0.0, middle)))]


def signals(preds: pa.Array, scales: tuple[int, ...]) -> pa.Array:
    found = Locals(preds, scales)
    values = signal_keys(found, scales)
    return listed(found.c.n, found.c.null, i=int32(found.c.i), **{f"v{k}": double(v, np.isnan(v)) for k, v in enumerate(values)})


def policy_counts(preds: pa.Array, gts: pa.Array, scales: tuple[int, ...], settings: list[tuple[int, float, str]], report: float, images: np.ndarray | None = None, cuts: list | None = None) -> list[tuple[int, ...]]:
    """For each (scale, least, policy) the counts of the candidates after it, against the candidates alone. With cuts, one (signal, (value, image, index)) for each
    setting, only candidates up to it are changed, and their number and the number of their images come first."""
    found, g = Locals(preds, scales), Boxes(gts, ("j", *SIDES))
    c = found.c
    p, q = pairs(c, g)
    plain, moved = overlaps(g, q, c, p), {s: overlaps(g, q, found.scale[s], p) for s in {s for s, _, _ in settings}}
    seen = lambda conf: np.nan_to_num(conf, nan=-np.inf) >= report

    def run(conf: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = o >= 0.5
        order = np.lexsort((c.i, np.where(np.isnan(conf), -np.inf, -conf), c.img))
        return seen(conf), _taken_boxes(c, g, _inverse(order), np.nan_to_num(conf, nan=-np.inf), report, (p[keep], q[keep], o[keep]))

    base = run(c.conf, plain)[1]
    values = signal_keys(found, scales) if cuts else []
    out = []
    for k, (s, least, policy) in enumerate(settings):
        hit, first = found.scale[s].iou >= least, ()
        if cuts:
            routed = _upto(values[cuts[k][0]], images[c.img], c.i, cuts[k][0], cuts[k][1])
            hit, first = hit & routed, (int(routed.sum()), int(np.unique(c.img[routed]).size))
        conf = np.where(hit, np.fmax(c.conf, found.scale[s].conf), c.conf) if policy in ("CONFIRM", "BOTH") else c.conf
        o = np.where(hit[p], moved[s], plain) if policy in ("REFINE", "BOTH") else plain
        out.append((*first, *_counts(g, base, *run(conf, o))))
    return out


def _upto(value: np.ndarray, image: np.ndarray, index: np.ndarray, signal: int, key: tuple) -> np.ndarray:
    """(value, image, index) <= key, null values first; the third signal's images and indices are reversed."""
    sign = -1 if signal == 2 else 1
    low = lambda v: np.where(np.isnan(v), -np.inf, v)
    v, k = low(value), -np.inf if key[0] is None else key[0]
    image, index = image * sign, index * sign
    return (v < k) | ((v == k) & ((image < key[1]) | ((image == key[1]) & (index <= key[2]))))
