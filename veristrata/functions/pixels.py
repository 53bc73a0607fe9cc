"""Pixel kernels on numpy arrays, and a reader of 8-bit indexed BMP files; used inside mapInPandas."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def decode_bmp(content: bytes) -> np.ndarray:
    """Luma (BT.601, rounded) of an uncompressed 8-bit indexed BMP, rows from the top."""
    offset, = struct.unpack_from("<I", content, 10)
    header, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", content, 14)
    if content[:2] != b"BM" or bits != 8 or packed:
        raise ValueError("not an uncompressed 8-bit BMP")
    used, = struct.unpack_from("<I", content, 46)
    palette = np.frombuffer(content, np.uint8, 4 * (used or 256), 14 + header).reshape(-1, 4).astype(float)
    luma = np.rint(palette[:, 2] * 0.299 + palette[:, 1] * 0.587 + palette[:, 0] * 0.114).astype(np.uint8)
    stride = (width + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, stride * abs(height), offset).reshape(abs(height), stride)[:, :width]
    return luma[rows[::-1] if height > 0 else rows]


def luma_stats(image: np.ndarray) -> dict[str, float]:
    q = np.percentile(image, [5, 50, 95])
    return {"mean": float(image.mean()), "std": float(image.std()), "p5": float(q[0]), "median": float(q[1]), "p95": float(q[2])}


def difference_hash(image: np.ndarray, size: int = 16) -> list[int]:
    """size * size bits: whether each cell of a (size, size + 1) grid of means is darker than its right neighbour; in 64-bit words."""
    rows = np.linspace(0, image.shape[0], size + 1).astype(int)
    cols = np.linspace(0, image.shape[1], size + 2).astype(int)
    cells = np.array([[image[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(cols, cols[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)])
    bits = (cells[:, :-1] < cells[:, 1:]).ravel()
    return [int(np.packbits(bits[k : k + 64]).view(">i8")[0]) for k in range(0, bits.size, 64)]


def gradient(image: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Magnitude of central differences; 0 at the border and where a needed neighbour is masked out."""
    x = image.astype(float)
    out = np.zeros_like(x)
    out[1:-1, 1:-1] = np.hypot((x[1:-1, 2:] - x[1:-1, :-2]) / 2, (x[2:, 1:-1] - x[:-2, 1:-1]) / 2)
    if mask is not None:
        ok = np.zeros(mask.shape, bool)
        ok[1:-1, 1:-1] = mask[1:-1, 2:] & mask[1:-1, :-2] & mask[2:, 1:-1] & mask[:-2, 1:-1] & mask[1:-1, 1:-1]
        out[~ok] = 0
    return out


def integral(image: np.ndarray) -> np.ndarray:
    return np.pad(image.astype(float).cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def box_mean(table: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> float:
    area = (x1 - x0) * (y1 - y0)
    return (table[y1, x1] - table[y0, x1] - table[y1, x0] + table[y0, x0]) / area if area > 0 else 0.0


def otsu(image: np.ndarray) -> int:
    """The threshold that maximises the variance between the two sides."""
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    w, m = n.cumsum(), (n * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The largest 4-connected component."""
    label, best, size = np.zeros(mask.shape, int), 0, 0
    number = 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if label[y, x]:
            continue
        number += 1
        todo, count = [(y, x)], 0
        label[y, x] = number
        while todo:
            a, b = todo.pop()
            count += 1
            for c, e in ((a - 1, b), (a + 1, b), (a, b - 1), (a, b + 1)):
                if 0 <= c < mask.shape[0] and 0 <= e < mask.shape[1] and mask[c, e] and not label[c, e]:
                    label[c, e] = number
                    todo.append((c, e))
        if count > size:
            best, size = number, count
    return label == best if best else np.zeros(mask.shape, bool)


def ring(shape: tuple[int, int], box: tuple[int, int, int, int], width: int) -> np.ndarray:
    """Pixels around a box up to width away, the box excluded."""
    x0, y0, x1, y1 = box
    out = np.zeros(shape, bool)
    out[max(0, y0 - width) : y1 + width, max(0, x0 - width) : x1 + width] = True
    out[y0:y1, x0:x1] = False
    return out


def contrast(image: np.ndarray, box: tuple[int, int, int, int], width: int) -> dict[str, float]:
    """Mean and median differences of a box and its ring, and a robust contrast to noise ratio."""
    x0, y0, x1, y1 = box
    inner, outer = image[y0:y1, x0:x1].astype(float).ravel(), image[ring(image.shape, box, width)].astype(float)
    mad = np.median(np.abs(outer - np.median(outer))) if outer.size else 0.0
    d = np.median(inner) - (np.median(outer) if outer.size else 0.0)
    return {"mean_difference": float(inner.mean() - (outer.mean() if outer.size else 0.0)), "median_difference": float(d), "robust_cnr": float(abs(d) / max(1.4826 * mad, 1.0))}


def image_statistics(files: DataFrame) -> DataFrame:
    """Luma statistics and hash words of BMP files (path, content)."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                image = decode_bmp(content)
                rows.append({"path": path, "width": image.shape[1], "height": image.shape[0], **luma_stats(image), "dhash": difference_hash(image)})
            yield pd.DataFrame(rows, columns=["path", "width", "height", "mean", "std", "p5", "median", "p95", "dhash"])

    return files.select("path", "content").mapInPandas(task, "path string, width int, height int, mean double, std double, p5 double, median double, p95 double, dhash array<bigint>")


def chromatic_mask(rgb: np.ndarray, least: int = 200) -> np.ndarray:
    """Pixels whose channels span at least `least`: drawn marks on a grey image."""
    return rgb.max(axis=2).astype(int) - rgb.min(axis=2) >= least


def marks(mask: np.ndarray) -> list[dict]:
    """8-connected components of a mask, largest first: size, box (ends exclusive), shares of its pixels within one of the box's edge and of the box filled, and whether it looks like a drawn rectangle."""
    left, out = mask.copy(), []
    for start in zip(*np.nonzero(mask), strict=True):
        if not left[start]:
            continue
        left[start], todo, held = False, [start], []
        while todo:
            y, x = todo.pop()
            held.append((y, x))
            part = left[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
            near = np.argwhere(part) + (max(0, y - 1), max(0, x - 1))
            part[:] = False
            todo += [tuple(p) for p in near]
        ys, xs = np.array(held).T
        top, bottom, first, last = ys.min(), ys.max(), xs.min(), xs.max()
        width, height = int(last - first + 1), int(bottom - top + 1)
        edge = float(np.mean((xs - first <= 1) | (last - xs <= 1) | (ys - top <= 1) | (bottom - ys <= 1)))
        fill = len(held) / (width * height)
        out.append({"size": len(held), "box": (int(first), int(top), int(last) + 1, int(bottom) + 1), "edge_share": edge, "fill": fill, "rectangle": width >= 4 and height >= 4 and edge >= 0.75 and fill <= 0.65})
    return sorted(out, key=lambda c: (-c["size"], c["box"]))


def palette_statistics(palette_luma: np.ndarray, counts: np.ndarray, qs: tuple[float, ...] = (0.05, 0.5, 0.95)) -> dict[str, float]:
    """Statistics of an indexed image from how often each palette entry occurs: mean, deviation and quantiles between order statistics."""
    luma, order = palette_luma.astype(float), np.argsort(palette_luma, kind="stable")
    total = counts.sum()
    mean = float((luma * counts).sum() / total)
    upto = counts[order].cumsum()

    def at(place: float) -> float:
        lo, hi = (luma[order][np.searchsorted(upto, f(place), side="right")] for f in (np.floor, np.ceil))
        return float(lo + (hi - lo) * (place - np.floor(place)))

    return {"mean": mean, "std": float(np.sqrt((counts * (luma - mean) ** 2).sum() / total)), **{f"q{round(q * 100)}": at(q * (total - 1)) for q in qs}}


def sobel(image: np.ndarray) -> np.ndarray:
    """Magnitude of the 3 by 3 gradient over 8; the border is mirrored without its own row."""
    x = np.pad(image.astype(float), 1, mode="reflect")
    smooth = lambda a, axis: a.take(range(a.shape[axis] - 2), axis) + 2 * a.take(range(1, a.shape[axis] - 1), axis) + a.take(range(2, a.shape[axis]), axis)
    return np.hypot(smooth(x[:, 2:] - x[:, :-2], 0), smooth(x[2:, :] - x[:-2, :], 1)) / 8


def grown(box: tuple[float, float, float, float], factor: float, shape: tuple[int, int]) -> tuple[int, int, int, int]:
    """A box of `factor` times the sides about the same centre, on whole pixels, cut at the image."""
    cx, cy, w, h = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, (box[2] - box[0]) * factor / 2, (box[3] - box[1]) * factor / 2
    return max(0, int(np.floor(cx - w))), max(0, int(np.floor(cy - h))), min(shape[1], int(np.ceil(cx + w))), min(shape[0], int(np.ceil(cy + h)))


def surroundings(shape: tuple[int, int], box: tuple[int, int, int, int], factor: float, mask: np.ndarray | None = None, others: list[tuple[int, int, int, int]] = ()) -> tuple[np.ndarray, dict[str, int]]:
    """Pixels of the grown box outside the box, without masked ones and those of other boxes; and how many there were, were masked, and lay in others."""
    inside = lambda b: (slice(max(0, b[1]), max(0, b[3])), slice(max(0, b[0]), max(0, b[2])))
    out = np.zeros(shape, bool)
    out[inside(grown(box, factor, shape))] = True
    out[inside(box)] = False
    counts = {"candidates": int(out.sum())}
    if mask is not None:
        counts["masked"] = int((out & mask).sum())
        out &= ~mask
    before = int(out.sum())
    for other in others:
        out[inside(other)] = False
    return out, {"masked": 0, **counts, "in_others": before - int(out.sum())}


def local_features(image: np.ndarray, box: tuple[int, int, int, int], factor: float = 2.0, mask: np.ndarray | None = None, others: list[tuple[int, int, int, int]] = (), eps: float = 1e-6) -> dict[str, float]:
    """An object against its surroundings: differences, contrast to noise, spread and entropy of both sides, gradients and share of edges; nan where a side has no pixels."""
    mask = np.zeros(image.shape, bool) if mask is None else mask
    around, _ = surroundings(image.shape, box, factor, mask, others)
    inner = np.zeros(image.shape, bool)
    inner[box[1] : box[3], box[0] : box[2]] = True
    inner &= ~mask
    if not inner.any() or not around.any():
        return dict.fromkeys(("signed_mean", "signed_median", "normalised", "cnr_mean", "cnr_robust", "object_iqr", "object_entropy", "object_range", "object_cv", "object_gradient", "background_iqr", "background_entropy", "background_gradient", "edge_density"), float("nan"))
    a, b, grad = image[inner].astype(float), image[around].astype(float), gradient(image, ~mask)
    spread = lambda v: float(np.median(np.abs(v - np.median(v))))
    iqr = lambda v: float(np.subtract(*np.percentile(v, [75, 25])))
    ga, gb = grad[inner], grad[around]
    dm, dd = float(a.mean() - b.mean()), float(np.median(a) - np.median(b))
    return {"signed_mean": dm, "signed_median": dd, "normalised": dd / max(abs(float(np.median(b))), eps), "cnr_mean": abs(dm) / (float(b.std()) + eps), "cnr_robust": abs(dd) / (1.4826 * spread(b) + eps),
            "object_iqr": iqr(a), "object_entropy": entropy(a), "object_range": float(np.subtract(*np.percentile(a, [90, 10]))), "object_cv": float(a.std()) / max(abs(float(a.mean())), eps), "object_gradient": float(ga.mean()),
            "background_iqr": iqr(b), "background_entropy": entropy(b), "background_gradient": float(gb.mean()), "edge_density": float((gb > np.median(gb) + 1.4826 * spread(gb)).mean())}


def entropy(values: np.ndarray) -> float:
    """Bits of the distribution of the distinct values."""
    p = np.unique(values, return_counts=True)[1] / values.size
    return float(-(p * np.log2(p)).sum())


def box_visibility(image: np.ndarray, box: tuple[float, float, float, float], others: list[tuple[float, float, float, float]] = (), least: int = 50, eps: float = 1e-6) -> dict[str, float]:
    """What can be told of a predicted box without the truth: contrast to the surroundings of twice its sides, and their Sobel gradient; valid with enough of them."""
    whole = lambda b: (max(0, int(np.floor(b[0]))), max(0, int(np.floor(b[1]))), min(image.shape[1], int(np.ceil(b[2]))), min(image.shape[0], int(np.ceil(b[3]))))
    x0, y0, x1, y1 = whole(box)
    around, _ = surroundings(image.shape, (x0, y0, x1, y1), 2.0, None, [whole(b) for b in others])
    inner, outer = image[y0:y1, x0:x1].astype(float), image[around].astype(float)
    if not inner.size or not outer.size:
        return {"contrast": float("nan"), "cnr": float("nan"), "gradient": float("nan"), "valid": False}
    gx0, gy0, gx1, gy1 = grown((x0, y0, x1, y1), 2.0, image.shape)
    middle = float(np.median(outer))
    contrast_ = abs(float(np.median(inner)) - middle)
    edges = sobel(image[gy0:gy1, gx0:gx1])[around[gy0:gy1, gx0:gx1]]
    return {"contrast": contrast_, "cnr": contrast_ / (1.4826 * float(np.median(np.abs(outer - middle))) + eps), "gradient": float(edges.mean()), "valid": outer.size >= least}


def close3(mask: np.ndarray) -> np.ndarray:
    """Grown by one pixel in all eight directions, then shrunk again; the image's border stays empty."""
    around = lambda m: np.lib.stride_tricks.sliding_window_view(m, (3, 3))
    wide = around(np.pad(mask, 1)).any(axis=(2, 3))
    out = np.zeros(mask.shape, bool)
    out[1:-1, 1:-1] = around(wide).all(axis=(2, 3))
    return out


def dark_component(image: np.ndarray, mask: np.ndarray, closed: bool = False) -> tuple[np.ndarray, int]:
    """The largest component of unmasked pixels at or under the Otsu threshold of the unmasked ones, and that threshold."""
    at = otsu(image[~mask]) if (~mask).any() else 0
    dark = ~mask & (image <= at)
    return largest_component(close3(dark) if closed else dark), at


def component_quality(component: np.ndarray) -> dict:
    """Shares of area, extent and border contact of a component, and what speaks against it as a product's outline."""
    if not component.any():
        return {"area": 0.0, "width": 0.0, "height": 0.0, "border": 0.0, "failures": ["empty"]}
    (h, w), (ys, xs) = component.shape, np.nonzero(component)
    got = {"area": xs.size / (h * w), "width": int(np.ptp(xs) + 1) / w, "height": int(np.ptp(ys) + 1) / h, "border": float(np.mean((xs == 0) | (ys == 0) | (xs == w - 1) | (ys == h - 1)))}
    centre = (xs.mean() / w, ys.mean() / h)
    checks = {"area": 0.08 <= got["area"] <= 0.80, "extent": got["width"] >= 0.25 and got["height"] >= 0.20, "centre": all(0.10 <= c <= 0.90 for c in centre), "border": got["border"] <= 0.02}
    return {**got, "failures": [name for name, ok in checks.items() if not ok]}


def outline(component: np.ndarray) -> np.ndarray:
    """Pixels of a component beside the image's end or background that reaches it; holes have no outline."""
    free = np.pad(~component, 1, constant_values=True)
    outside = np.zeros(free.shape, bool)
    outside[0, :] = outside[-1, :] = outside[:, 0] = outside[:, -1] = True
    while True:
        wider = outside.copy()
        wider[1:] |= outside[:-1]
        wider[:-1] |= outside[1:]
        wider[:, 1:] |= outside[:, :-1]
        wider[:, :-1] |= outside[:, 1:]
        wider &= free
        if (wider == outside).all():
            break
        outside = wider
    return component & (outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:])


def component_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union of two masks; nan if both are empty."""
    either = int((a | b).sum())
    return int((a & b).sum()) / either if either else float("nan")


def repair_median(image: np.ndarray, mask: np.ndarray, reaches: tuple[int, ...] = (2, 4)) -> np.ndarray:
    """Masked pixels become the median of the unmasked ones within the first reach that has any; those without any stay."""
    out = image.copy()
    for y, x in zip(*np.nonzero(mask), strict=True):
        for reach in reaches:
            part = (slice(max(0, y - reach), y + reach + 1), slice(max(0, x - reach), x + reach + 1))
            near = image[part][~mask[part]]
            if near.size:
                out[y, x] = np.rint(np.median(near))
                break
    return out


def repair_directions(image: np.ndarray, mask: np.ndarray, steps: int = 5) -> np.ndarray:
    """Masked pixels become the mean of the nearest unmasked ones to the left, right, above and below, each at most `steps` away; those without any stay."""
    out = image.copy()
    for y, x in zip(*np.nonzero(mask), strict=True):
        lines = ((y, slice(None, x), -1), (y, slice(x + 1, None), 1), (slice(None, y), x, -1), (slice(y + 1, None), x, 1))
        found = []
        for row, column, way in lines:
            values, hidden = image[row, column][::way][:steps], mask[row, column][::way][:steps]
            if (at := np.flatnonzero(~hidden)).size:
                found.append(float(values[at[0]]))
        if found:
            out[y, x] = np.rint(np.mean(found))
    return out


def tile_equalise(image: np.ndarray, tile: int = 8, clip: float = 2.0) -> np.ndarray:
    """Histogram equalisation tile by tile with clipped counts, without blending between tiles."""
    out = np.zeros_like(image)
    for y in range(0, image.shape[0], tile):
        for x in range(0, image.shape[1], tile):
            part = image[y : y + tile, x : x + tile]
            counts = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * part.size / 256)
            over = np.maximum(counts - limit, 0).sum()
            steps = np.cumsum(np.minimum(counts, limit) + over / 256)
            out[y : y + tile, x : x + tile] = np.rint(steps / steps[-1] * 255).astype(np.uint8)[part]
    return out


def percentile_window(image: np.ndarray, low: float = 1, high: float = 99) -> np.ndarray:
    """Values between two percentiles stretched to 0..255."""
    a, b = np.percentile(image, [low, high])
    return np.rint(np.clip((image - a) / max(b - a, 1e-9), 0, 1) * 255).astype(np.uint8)


def edge_centroid(grad: np.ndarray, mask: np.ndarray) -> tuple[float, float] | None:
    """Centre (x, y) of a mask's pixels weighted by gradient; None without gradient."""
    y, x = np.nonzero(mask)
    w = grad[y, x]
    return (float((x * w).sum() / w.sum()), float((y * w).sum() / w.sum())) if w.sum() > 0 else None


def replicated_crop(image: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """A crop whose parts outside the image repeat its edge."""
    rows = np.clip(np.arange(y0, y1), 0, image.shape[0] - 1)
    cols = np.clip(np.arange(x0, x1), 0, image.shape[1] - 1)
    return image[np.ix_(rows, cols)]


def gamma(image: np.ndarray, power: float = 0.8) -> np.ndarray:
    return np.rint(255 * (image / 255.0) ** power).astype(np.uint8)


def _neighbourhood(image: np.ndarray, radius: int) -> np.ndarray:
    """For each pixel the square around it, edges repeated."""
    side = 2 * radius + 1
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, radius, mode="edge"), (side, side))


def median_filter(image: np.ndarray, radius: int = 1) -> np.ndarray:
    return np.median(_neighbourhood(image, radius), axis=(2, 3)).astype(image.dtype)


def blur(image: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian mean, as doubles; the kernel ends at three deviations."""
    radius = max(1, int(np.ceil(3 * sigma)))
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weights /= weights.sum()
    return np.einsum("yxij,i,j->yx", _neighbourhood(image.astype(float), radius), weights, weights)


def sharpen(image: np.ndarray, amount: float = 0.5, sigma: float = 1.0) -> np.ndarray:
    """The image and its difference from its blur."""
    return np.clip(np.rint(image + amount * (image - blur(image, sigma))), 0, 255).astype(np.uint8)


#: Named transforms of an image; each returns 8 bits a pixel of the same size.
TRANSFORMS = {
    "identity": lambda image: image,
    "equalise": tile_equalise,
    "stretch": percentile_window,
    "gamma": gamma,
    "median": median_filter,
    "sharpen": sharpen,
    "flip": lambda image: image[:, ::-1],
}


def transformed(image: np.ndarray, name: str) -> np.ndarray:
    if name not in TRANSFORMS:
        raise KeyError(f"no transform {name}; there are {sorted(TRANSFORMS)}")
    return TRANSFORMS[name](image)


def complexity(image: np.ndarray, mask: np.ndarray | None = None, edge: float = 20.0) -> dict[str, float]:
    """Of a mask's pixels: entropy of 16 levels in bits, share with a gradient of at least `edge`, deviation of luma; nan where there are none."""
    chosen = np.ones(image.shape, bool) if mask is None else mask
    if not chosen.any():
        return {"entropy": float("nan"), "edges": float("nan"), "std": float("nan")}
    share = np.bincount(image[chosen] // 16, minlength=16) / chosen.sum()
    share = share[share > 0]
    return {"entropy": float(-(share * np.log2(share)).sum()), "edges": float((gradient(image)[chosen] >= edge).mean()), "std": float(image[chosen].std())}


def usable(mask: np.ndarray, masked: np.ndarray, least: int = 30, most: float = 0.35) -> bool:
    """Whether a region has at least `least` pixels outside the mask and at most a share `most` under it."""
    inside = int(mask.sum())
    hidden = int((mask & masked).sum())
    return inside - hidden >= least and hidden <= most * inside


def shrunk(image: np.ndarray, scale: float = 0.9) -> tuple[np.ndarray, int, int]:
    """The image scaled down between pixel centres, in the middle of a canvas of its old size whose rest mirrors it; and the canvas's left and top margins."""
    height, width = image.shape
    h, w = max(1, round(height * scale)), max(1, round(width * scale))

    def along(values: np.ndarray, size: int, axis: int) -> np.ndarray:
        place = np.clip((np.arange(size) + 0.5) * values.shape[axis] / size - 0.5, 0, values.shape[axis] - 1)
        low = np.floor(place).astype(int)
        share = (place - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return values.take(low, axis) * (1 - share) + values.take(np.minimum(low + 1, values.shape[axis] - 1), axis) * share

    small = along(along(image.astype(float), h, 0), w, 1)
    left, top = (width - w) // 2, (height - h) // 2
    canvas = np.pad(small, ((top, height - h - top), (left, width - w - left)), mode="reflect")
    return np.rint(canvas).astype(image.dtype), left, top


def ring_sensitivity(image: np.ndarray, box: tuple[int, int, int, int], factors: tuple[float, ...], mask: np.ndarray | None = None, others: list[tuple[int, int, int, int]] = (), reference: float = 2.0, least: int = 50) -> list[dict]:
    """One row for each size of the surroundings: pixels, share cut off by the image, middle and its distance from the reference's, contrast, and whether there are enough."""
    def row(factor: float) -> dict:
        around, counts = surroundings(image.shape, box, factor, mask, others)
        outer = image[around].astype(float)
        middle = float(np.median(outer)) if outer.size else float("nan")
        full = (box[2] - box[0]) * (box[3] - box[1]) * (factor**2 - 1)
        inner = float(np.median(image[box[1] : box[3], box[0] : box[2]]))
        return {"factor": factor, "valid": int(outer.size), **counts, "clipped": max(0.0, 1 - counts["candidates"] / full) if full > 0 else 0.0, "median": middle, "contrast": abs(inner - middle), "reliable": outer.size >= least}

    rows = [row(f) for f in factors]
    at = row(reference)["median"]
    return [{**r, "from_reference": abs(r["median"] - at)} for r in rows]


def choose_ring(rows: list[dict]) -> float:
    """The smallest size that is reliable for 95 % of objects, has 100 pixels in the middle and stays within 2 of the reference; else the most reliable, least clipped, smallest one."""
    sizes = sorted({r["factor"] for r in rows})
    of = {f: [r for r in rows if r["factor"] == f] for f in sizes}
    middle = lambda f, name: float(np.median([r[name] for r in of[f]]))
    share = {f: float(np.mean([r["reliable"] for r in of[f]])) for f in sizes}
    good = [f for f in sizes if share[f] >= 0.95 and middle(f, "valid") >= 100 and middle(f, "from_reference") <= 2.0]
    return good[0] if good else max(sizes, key=lambda f: (share[f], -middle(f, "clipped"), -f))


def repair_effects(image: np.ndarray, repaired: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    """What a repair did: pixels changed outside the mask, how far masked pixels still stand out from their neighbours before and after, and the change of gradients beside the mask."""
    beside = np.lib.stride_tricks.sliding_window_view(np.pad(mask, 1), (3, 3)).any(axis=(2, 3)) & ~mask
    kept = float((repaired[~mask] != image[~mask]).mean()) if (~mask).any() else 0.0
    if not mask.any() or not beside.any():
        return {"changed_outside": kept, "leak_before": 0.0, "leak_after": 0.0, "gradient_shift": 0.0}
    near = image[beside].astype(float)
    noise = max(1.0, 1.4826 * float(np.median(np.abs(near - np.median(near)))))
    leak = lambda x: float((np.abs(x[mask].astype(float) - np.median(near)) > 3 * noise).mean())
    return {"changed_outside": kept, "leak_before": leak(image), "leak_after": leak(repaired), "gradient_shift": float(np.abs(gradient(repaired)[beside] - gradient(image)[beside]).mean())}


def updated_histogram(counts: np.ndarray, image: np.ndarray, changed: np.ndarray, mask: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Counts of a region's values in another representation that differs from the image under the mask alone: only those pixels are read."""
    at = mask & region
    return counts - np.bincount(image[at], minlength=256) + np.bincount(changed[at], minlength=256)


def boundary_audit(files: DataFrame) -> DataFrame:
    """For BMP files (path, content) the dark outline with and without closing: overlap of both, quality of each, and whether both pass and agree."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "overlap", "area", "border", "failures", "outline", "passes"]
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                image = decode_bmp(content)
                none = np.zeros(image.shape, bool)
                (raw, _), (closed, _) = dark_component(image, none), dark_component(image, none, closed=True)
                quality = component_quality(closed)
                overlap = component_overlap(raw, closed)
                rows.append((path, overlap, quality["area"], quality["border"], ";".join(quality["failures"]), int(outline(closed).sum()), not quality["failures"] and not component_quality(raw)["failures"] and overlap >= 0.9))
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(task, "path string, overlap double, area double, border double, failures string, outline int, passes boolean")
