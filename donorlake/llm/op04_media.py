"""Copies among images by local descriptors, cropped or edited ones included.

Corners are found on a pyramid of scales (steps of 1.26); each patch is turned by
the direction of its intensity centroid and described by 128 binary tests.  The
Hamming tables file constellations: a corner and two of its nearest neighbours of
the same level, under a key made of one 16-bit segment of each of the three
descriptors.  Images that meet under enough keys are candidates; there all pairs
of descriptors within ``DISTANCE`` bits vote for a similarity transform, and
images with enough of their corners agreeing on one are linked.  A patch that is
common by itself makes no candidates, its neighbourhood has to return as well.

No key is too long.  One of more than ``DENSE`` images ties all of them to its
first image; once these links are known, all its images in different classes
are candidates too.  Equal bytes are one image before that.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .op10_simhash import _small, components

PATCH = 8
#: Corners are the largest response within so many pixels.
SPACING = 7
SECTORS = 12
TESTS = 128
#: Ratio of neighbouring levels of the pyramid, and how many there are at most.
STEP, LEVELS = 1.26, 6
#: Bits that two descriptors of one place may differ in.
DISTANCE = 16
#: Bits of a table's segment, and tables.
SEGMENT, TABLES = 16, 3
#: Spark deletes the shuffle files of a written table when it is written.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a key; more of them only make fewer chance meetings, which are compared like others.
KEY = 40
#: Keys that candidates share at least, and as one in so many of the corners that must agree.
SHARED, SHARED_PART = 2, 16
#: Keys that are unpacked and sorted at once.
ROWS = 1 << 20
#: Images of a key up to which all pairs meet at once.
DENSE = 64
#: Elements of a block of distances.
BLOCK = 1 << 19
#: Transforms that are tried for a pair of images, of the fullest bins of votes.
TRIED = 16
TOLERANCE = 4.0
#: Corners that must agree, and their share of those of the image with fewer.
LEAST_MATCHES, LEAST_SHARE = 6, 0.25
#: Pages with fewer rows of words are rendered with a margin.
LEAST_ROWS = 12

#: An image's corners as they are stored: place in eighths of a pixel, level, angle (256 to a turn), descriptor.
CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("level", "u1"), ("angle", "u1"), ("d", "<u8", (2,))])
IMAGES = "node long, image_id long, digest binary, n int"
MET = "a long, b long, n long, key long, star boolean"
_ROW_BITS = 28
#: Low bits of a key, of which a block has three bytes.
_LOW = 24
#: Bytes of corners that are read at once, and that a task of comparisons holds.
_READ, _HELD = 1 << 21, 1 << 23


def _turns() -> tuple[np.ndarray, np.ndarray]:
    """The turn with its scale, and its part of a bin, for each difference of levels and angles."""
    grow = np.repeat(STEP ** np.arange(1.0 - LEVELS, LEVELS), 511)
    turn = grow * np.exp(2j * np.pi / 256 * np.tile(np.arange(-255.0, 256), 2 * LEVELS - 1))
    return turn, np.rint(np.angle(turn) * 4).astype(np.int64) + 16 << 52 | np.rint(np.log(grow) * 3).astype(np.int64) + 16 << 46


_TURN, _TURN_BIN = _turns()
_GROWN = STEP ** np.arange(float(LEVELS))


def _pattern() -> np.ndarray:
    """Offsets of both points of each test in each sector; drawn by a multiplicative rule, then turned."""
    k = np.arange(TESTS * 4, dtype=np.uint64) + np.uint64(1)
    unit = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.float64) / 2**24
    base = ((unit - 0.5) * 2 * (PATCH - 2) / np.sqrt(2)).reshape(TESTS, 2, 2)
    turned = []
    for s in range(SECTORS):
        c, d = np.cos(2 * np.pi * s / SECTORS), np.sin(2 * np.pi * s / SECTORS)
        turned.append(np.rint(base @ np.array([[c, d], [-d, c]])).astype(np.int64))
    return np.stack(turned)


PATTERN = _pattern()
_DY, _DX = (g.ravel() for g in np.mgrid[-7:8, -7:8])
_DISC = _DX**2 + _DY**2 <= 49
_DX, _DY = _DX[_DISC], _DY[_DISC]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a PGM, PPM or PNG (8 and 16 bits, palettes; not interlaced), of other formats where Pillow is installed; None for what can't be read."""
    try:
        if data is None:
            return None
        if data[:2] in (b"P5", b"P6"):
            head = re.match(rb"P[56]\s+(?:#.*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
            w, h = int(head[1]), int(head[2])
            n = 1 if data[:2] == b"P5" else 3
            grey = np.frombuffer(data, np.uint8, w * h * n, head.end()).reshape(h, w, n).astype(np.float32)
            return grey[..., 0] if n == 1 else grey.mean(axis=2)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        return _other(data)
    except (TypeError, ValueError, IndexError, KeyError, OSError, zlib.error):
        return None


def _other(data: bytes) -> np.ndarray | None:
    """By Pillow, where it is installed."""
    try:
        from PIL import Image
    except ImportError:
        return None
    import io

    return np.asarray(Image.open(io.BytesIO(data)).convert("L"), np.float32)


def _png(data: bytes) -> np.ndarray:
    at, body, w, h, n, depth, palette = 8, b"", 0, 0, 1, 8, None
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, lace = int.from_bytes(chunk[:4], "big"), int.from_bytes(chunk[4:8], "big"), *chunk[8:13]
            if depth not in (8, 16) or lace:
                raise ValueError("depth or interlacing")
            n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.int64)
    for y in range(h):
        line, up = raw[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(w * n, np.int64)
        if (kind := raw[y, 0]) == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(w * n):
                left, corner = (out[y, x - n], up[x - n]) if x >= n else (0, 0)
                p = left + up[x] - corner
                paeth = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                out[y, x] = (line[x] + (left if kind == 1 else (left + up[x]) // 2 if kind == 3 else paeth)) & 255
    if palette is not None and n == 1 and colour == 3:
        return palette[out].mean(axis=2).astype(np.float32)
    pixels = out.reshape(h, w, n)
    if depth == 16:  # the high bytes
        pixels, n = pixels[..., ::2], n // 2
    return pixels[..., : 1 if n < 3 else 3].mean(axis=2).astype(np.float32)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of 3 (r = 1) or 5 (r = 2), of the same size; within r of the edges they are 0, and no corner is taken there."""
    for axis in (0, 1):
        x = a if axis == 0 else a.T
        n = len(x)
        out = np.zeros_like(a)
        if n > 2 * r:
            two = x[:-1] + x[1:]
            inner = (out if axis == 0 else out.T)[r : n - r]
            np.add(two[: n - 2] if r == 1 else two[: n - 4] + two[2 : n - 2], x[2 * r :], out=inner)
        a = out
    return a


def _largest_near(a: np.ndarray, r: int) -> np.ndarray:
    """Maxima over squares of 2r + 1, by doubling windows along each axis; short within r of the edges."""
    for axis in (0, 1):
        n, p, have = a.shape[axis], a, 1
        while have < 2 * r + 1:
            step = min(have, 2 * r + 1 - have)
            lo, hi = (p[:-step], p[step:]) if axis == 0 else (p[:, :-step], p[:, step:])
            p, have = np.maximum(lo, hi), have + step
        out = np.full_like(a, -np.inf)
        (out if axis == 0 else out.T)[r : n - r] = p if axis == 0 else p.T
        a = out
    return a


def _bilinear(size: int, old: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower sample and weight of the upper one, for a side of ``old`` pixels brought to ``size``."""
    at = np.clip((np.arange(size) + 0.5) * old / size - 0.5, 0, old - 1)
    low = np.minimum(at.astype(np.int64), max(0, old - 2))
    return low, (at - low).astype(np.float32)


def _level(tall: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Image number, y, x, angle and descriptor halves of the corners of images that lie one below the other."""
    rows, edge = np.repeat(np.arange(len(heights)), heights), np.cumsum(heights) - heights
    y_in = np.arange(len(tall)) - edge[rows]
    inside = np.minimum(y_in, heights[rows] - 1 - y_in)  # rows to the image's nearer edge
    smooth = _box(tall, 1) / 9
    outer = inside < 1
    smooth[outer], smooth[:, 0], smooth[:, -1] = tall[outer], tall[:, 0], tall[:, -1]
    gx, gy = np.zeros_like(tall), np.zeros_like(tall)
    gx[:, 1:-1] = smooth[:, 2:] - smooth[:, :-2]
    gy[1:-1] = smooth[2:] - smooth[:-2]
    a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    r = a * b - c * c - 0.04 * (a + b) ** 2
    r[inside < 4] = -np.inf  # there the image above or below comes in
    r[:, :4] = r[:, -4:] = -np.inf
    least = np.maximum(0.01 * np.maximum.reduceat(r.max(axis=1), edge), 1e-9)
    corner = (r >= _largest_near(r, SPACING)) & (r > least[rows][:, None])
    corner[inside < PATCH] = False
    corner[:, :PATCH] = corner[:, -PATCH:] = False
    y, x = np.nonzero(corner)
    disc = smooth[y[:, None] + _DY, x[:, None] + _DX]
    angle = np.arctan2((disc * _DY).sum(axis=1), (disc * _DX).sum(axis=1))
    sector = np.rint(angle / (2 * np.pi) * SECTORS).astype(np.int64) % SECTORS
    wide = _box(smooth, 1)
    o = PATTERN[sector]
    first = wide[y[:, None] + o[:, :, 0, 1], x[:, None] + o[:, :, 0, 0]]
    second = wide[y[:, None] + o[:, :, 1, 1], x[:, None] + o[:, :, 1, 0]]
    bits = np.packbits(first < second, axis=1).view(">u8").astype(np.uint64).reshape(-1, 2)
    return rows[y], y_in[y], x, angle, bits


def describe_all(images: list[np.ndarray]) -> list[np.ndarray]:
    """The corners (CORNER) of each image; images of a width are worked on together."""
    found: list[list] = [[] for _ in images]
    by_width: dict[int, list[int]] = {}
    for k, image in enumerate(images):
        if min(image.shape) > 2 * PATCH + 2:
            by_width.setdefault(image.shape[1], []).append(k)
    for width, all_of in by_width.items():
        many = np.cumsum([images[k].shape[0] for k in all_of]) * width // BLOCK
        for part in np.unique(many):
            who = np.array(all_of)[many == part]
            full = np.array([images[k].shape[0] for k in who])
            heights, tall = full, np.concatenate([images[k] for k in who]).astype(np.float32) / 255
            for level in range(LEVELS):
                if level:
                    wanted, w = np.rint(full / STEP**level).astype(np.int64), round(width / STEP**level)
                    ok = wanted > 2 * PATCH + 2
                    if w <= 2 * PATCH + 2 or not ok.any():
                        break
                    starts = np.cumsum(heights) - heights
                    maps = [_bilinear(n, h) for n, h in zip(wanted[ok], heights[ok])]
                    low = np.concatenate([m + s for (m, _), s in zip(maps, starts[ok])])
                    up = np.concatenate([f for _, f in maps])[:, None]
                    tall = tall[low] * (1 - up) + tall[low + 1] * up
                    low, up = _bilinear(w, tall.shape[1])
                    tall = tall[:, low] * (1 - up) + tall[:, low + 1] * up
                    who, full, heights = who[ok], full[ok], wanted[ok]
                image, y, x, angle, bits = _level(tall, heights)
                out = np.empty(len(y), CORNER)
                out["x"] = np.rint((x + 0.5) * 8 * width / tall.shape[1])
                out["y"] = np.rint((y + 0.5) * 8 * full[image] / heights[image])
                out["level"], out["d"] = level, bits
                out["angle"] = np.rint(angle / (2 * np.pi) * 256).astype(np.int64) % 256
                ends = np.searchsorted(image, np.arange(len(who) + 1))
                for k, lo, hi in zip(who, ends[:-1], ends[1:]):
                    if hi > lo:
                        found[k].append(out[lo:hi])
    return [np.concatenate(f) if f else np.zeros(0, CORNER) for f in found]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _three(far: np.ndarray) -> np.ndarray:
    """The three least of the last axis, in order."""
    if far.shape[-1] > 3:
        some = np.argpartition(far, 2, axis=-1)[..., :3]
    else:
        some = np.broadcast_to(np.arange(far.shape[-1]), (*far.shape[:-1], far.shape[-1]))
    return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, -1), axis=-1, kind="stable"), -1)


def _nearest(xy: np.ndarray) -> np.ndarray:
    """Each corner's nearest others in groups (groups x corners x 2); places that aren't there are NaN."""
    far = ((xy[:, :, None] - xy[:, None]) ** 2).sum(axis=3)
    k = np.arange(xy.shape[1])
    far[:, k, k] = np.inf
    return _three(np.where(np.isnan(far), np.inf, far))


def _nearest_of_many(xy: np.ndarray, reach: float) -> np.ndarray:
    """The same for one group in the order of y: blocks of rows look at the corners within ``reach`` of their y, and at all where that isn't enough."""
    out = np.empty((len(xy), 3), np.int64)
    y = xy[:, 1]
    for lo in range(0, len(xy), 128):
        hi = min(len(xy), lo + 128)
        for window in (reach, np.inf):
            a, b = np.searchsorted(y, y[lo] - window, "left"), np.searchsorted(y, y[hi - 1] + window, "right")
            far = ((xy[lo:hi, None] - xy[None, a:b]) ** 2).sum(axis=2)
            far[np.arange(hi - lo), np.arange(lo, hi) - a] = np.inf
            if b - a < 4:
                continue
            some = _three(far)
            if window == np.inf or (np.take_along_axis(far, some, 1)[:, 2] <= window**2).all():
                out[lo:hi] = a + some
                break
    return out


def constellations(owner: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key), each once: triples of a corner with two of its three nearest neighbours of its level."""
    group = owner.astype(np.int64) * LEVELS + corners["level"]
    order = np.argsort(group, kind="stable")
    owner, corners, group = owner[order], corners[order], group[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(group)))
    near = np.full((len(group), 3), -1, np.int64)
    xy = np.stack([corners["x"], corners["y"]], axis=1).astype(np.float64)
    by_size = np.argsort(size, kind="stable")
    by_size = by_size[size[by_size] > 2]
    for g in by_size[size[by_size] > 128]:
        lo, hi = starts[g], starts[g] + size[g]
        near[lo:hi] = lo + _nearest_of_many(xy[lo:hi], 8 * 48 * STEP ** int(corners["level"][lo]))
    by_size = by_size[size[by_size] <= 128]
    at = 0
    while at < len(by_size):
        most = min(128, 2 * int(size[by_size[at]]))
        end = at + int(np.searchsorted(size[by_size[at:]], most, "right"))
        end = min(end, at + max(1, BLOCK // most**2))
        some = by_size[at:end]
        at, wide = end, int(size[some[-1]])
        place = starts[some][:, None] + np.arange(wide)
        there = np.arange(wide) < size[some][:, None]
        got = _nearest(np.where(there[:, :, None], xy[np.minimum(place, len(xy) - 1)], np.nan))
        # of three corners the third neighbour isn't there
        absolute = np.where(np.take_along_axis(np.broadcast_to(there[:, None], got.shape[:2] + (wide,)), got, 2), starts[some][:, None, None] + got, -1)
        absolute = np.where(got == np.arange(wide)[None, :, None], -1, absolute)
        near[place[there]] = absolute[there]
    who, keys = [], []
    for t in range(TABLES):
        segment = corners["d"][:, 0] >> np.uint64(64 - SEGMENT * (t + 1)) & np.uint64((1 << SEGMENT) - 1)
        m = _mixed(segment + np.uint64(1 + t << SEGMENT))
        for a, b in ((0, 1), (1, 2), (0, 2)):
            ok = (near[:, a] >= 0) & (near[:, b] >= 0)
            keys.append((_mixed(m[ok] * np.uint64(3) + m[near[ok, a]] + m[near[ok, b]]) >> np.uint64(64 - KEY)).view(np.int64))
            who.append(owner[ok])
    who, keys = np.concatenate(who), np.concatenate(keys)
    order = np.lexsort((keys, who))
    who, keys = who[order], keys[order]
    once = np.concatenate([np.ones(min(1, len(who)), bool), (who[1:] != who[:-1]) | (keys[1:] != keys[:-1])])
    return who[once], keys[once]


def least_agreeing(na: int, nb: int) -> int:
    """Corners that must agree on a transform of two images with so many."""
    return max(LEAST_MATCHES, int(np.ceil(LEAST_SHARE * min(na, nb))))


class Compared:
    """Corners of some images in plain arrays, each distinct descriptor once."""

    def __init__(self, images: list[np.ndarray]):
        every = np.frombuffer(b"".join(images), CORNER)
        size = np.array([len(c) for c in images], np.int64)
        self.images, self.ends = images, np.cumsum(size)
        self.starts = self.ends - size
        self.place = (every["x"] + 1j * every["y"]) / 8
        self.level, self.angle = every["level"].astype(np.int64), every["angle"].astype(np.int64)
        d0, d1 = every["d"].T.copy()
        order = np.lexsort((d1, d0))
        d0, d1 = d0[order], d1[order]
        new = np.concatenate([np.ones(min(1, len(d0)), bool), (d0[1:] != d0[:-1]) | (d1[1:] != d1[:-1])])
        self.d0, self.d1 = d0[new], d1[new]
        self.of = np.empty(len(order), np.int32)
        self.of[order] = np.cumsum(new, dtype=np.int32) - 1
        self.at = np.zeros(len(self.d0), np.int32)

    def _near(self, here: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(t, h, bits): descriptors there[t] and here[h] within DISTANCE bits, in the order of t and h."""
        left, right, bits = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
        h0, h1 = self.d0[here], self.d1[here]
        for lo in range(0, len(there), tall := max(1, BLOCK // 8 // max(1, len(here)))):
            t = there[lo : lo + tall, None]
            far = np.bitwise_count(self.d0[t] ^ h0)
            far += np.bitwise_count(self.d1[t] ^ h1)
            near = np.flatnonzero(far <= DISTANCE)
            i, j = np.divmod(near, len(here))
            left.append((i + lo).astype(np.int32))
            right.append(j.astype(np.int32))
            bits.append(far.ravel()[near])
        return np.concatenate(left), np.concatenate(right), np.concatenate(bits)

    def _mutual(self, x: int, partners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k, i, j): corners i of image x and j (both as places in the arrays) of the k-th partner within DISTANCE bits, each the likest of the other image to the other; in that order."""
        first, n = self.starts[x], self.ends[x] - self.starts[x]
        here, own = np.unique(self.of[first : first + n], return_inverse=True)
        size = self.ends[partners] - self.starts[partners]
        k = np.repeat(np.arange(len(partners), dtype=np.int32), size)
        corner = np.arange(len(k)) + np.repeat(self.starts[partners] - (np.cumsum(size) - size), size)
        asked = np.zeros(len(self.d0), bool)
        asked[self.of[corner]] = True
        there = np.flatnonzero(asked)
        self.at[there] = np.arange(len(there))
        t, h, far = self._near(here, there)
        edge = np.searchsorted(t, np.arange(len(there) + 1))
        to_there = np.full(len(there), 255, np.uint8)
        np.minimum.at(to_there, t, far)
        at = self.at[self.of[corner]]
        row, edge = _ranges(edge[at], edge[at + 1])
        k, corner, far, h, best = k[row], corner[row], far[edge], h[edge], to_there[t[edge]]
        pair = k * np.int64(len(here)) + h
        to_here = np.full(len(partners) * len(here), 255, np.uint8)
        np.minimum.at(to_here, pair, far)
        mutual = (far == best) & (far == to_here[pair])
        k, corner, h = k[mutual], corner[mutual], h[mutual]
        order, cut = np.argsort(own, kind="stable"), np.searchsorted(np.sort(own), np.arange(len(here) + 1))
        row, i = _ranges(cut[h], cut[h + 1])
        k, i, j = k[row], order[i], corner[row]
        order = np.argsort((k * n + i) * np.int64(len(self.of)) + j)
        return k[order], first + i[order], j[order]

    def agreeing(self, x: int, partners: np.ndarray, enough: list[int | None]) -> list[int]:
        """``agreeing`` of image x with each partner (numbers of images)."""
        room = np.cumsum((self.ends[x] - self.starts[x]) * (1 + self.ends[partners] - self.starts[partners])) // (2 * BLOCK)
        return [n for part in np.split(np.arange(len(partners)), np.flatnonzero(np.diff(room)) + 1) for n in self._agreeing(x, partners[part], [enough[m] for m in part])]

    def _agreeing(self, x: int, partners: np.ndarray, enough: list[int | None]) -> list[int]:
        k, i, j = self._mutual(x, partners)
        cut = np.searchsorted(k, np.arange(len(partners) + 1))
        ok = np.zeros(len(partners), bool)
        for part in np.split(np.arange(len(partners)), np.searchsorted(cut, np.arange(BLOCK // 32, len(k), BLOCK // 32))):  # a bounded part of the matches at once
            if len(part) and cut[part[0]] < cut[part[-1] + 1]:
                at = slice(cut[part[0]], cut[part[-1] + 1])
                if at.stop - at.start > BLOCK // 16:  # a pair with so many is tried piece by piece
                    ok[part] = True
                    continue
                ok[part] = _may_agree(k[at] - part[0], self._transforms(i[at], j[at]), np.array([enough[m] or 1 for m in part]))
        return [self._on_a_transform(i[lo:hi], j[lo:hi], e) if good else 0 for lo, hi, good, e in zip(cut[:-1], cut[1:], ok, enough)]

    def _transforms(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places of matching corners, the turn (with its scale) that each match tells, the bin it votes for, and how far off a corner may be."""
        p, q, here, there = self.place[i], self.place[j], self.level[i], self.level[j]
        which = (there - here + LEVELS - 1) * 511 + (self.angle[j] - self.angle[i] + 255)
        turn = _TURN[which]
        shift = q - turn * p
        bins = _TURN_BIN[which] | (np.rint(shift.real / 16).astype(np.int64) & 0x3FFFFF) << 23 | np.rint(shift.imag / 16).astype(np.int64) & 0x3FFFFF
        return p, q, turn, bins, TOLERANCE * _GROWN[np.maximum(here, there)]

    def _on_a_transform(self, i: np.ndarray, j: np.ndarray, enough: int | None) -> int:
        """``agreeing`` of two images whose corners i and j match."""
        most = min(len(np.unique(i)), len(np.unique(j)))
        if not most or most < (enough or 0):
            return 0
        p, q, turn, bins, bound = self._transforms(i, j)
        _, first, votes = np.unique(bins, return_index=True, return_counts=True)
        tried = first[np.argsort(-votes, kind="stable")[:TRIED]][:, None]
        step = max(1, BLOCK // 8 // len(p))
        near = np.concatenate([np.abs(q - q[k] - turn[k] * (p - p[k])) <= bound for k in np.split(tried, range(step, len(tried), step))])
        count, best = near.sum(axis=1), 0
        here, there = (np.unique(side, return_inverse=True)[1] for side in (p, q)) if count.max() >= (enough or 1) else (None, None)
        for row in np.argsort(-count, kind="stable"):
            if count[row] <= best or count[row] < (enough or 1):
                break
            best = max(best, min(np.count_nonzero(np.bincount(side[near[row]])) for side in (here, there)))
            if best >= (enough or most):
                break
        return int(best)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): each place from lo to hi of each row."""
    size = hi - lo
    row = np.repeat(np.arange(len(lo)), size)
    return row, np.arange(len(row)) + np.repeat(lo - (np.cumsum(size) - size), size)


def _may_agree(k: np.ndarray, told: tuple[np.ndarray, ...], enough: np.ndarray) -> np.ndarray:
    """Whether one of the transforms that ``_on_a_transform`` tries takes ``enough`` matches of pair k to their places; matches lie in the order of k."""
    p, q, turn, bins, bound = told
    n, size = len(enough), np.bincount(k, minlength=len(enough))
    start = np.cumsum(size) - size
    order = np.lexsort((bins, k))
    new = np.flatnonzero(np.concatenate([[True], (k[order[1:]] != k[order[:-1]]) | (bins[order[1:]] != bins[order[:-1]])]))
    first, votes = order[new], np.diff(np.append(new, len(k)))
    fullest = np.lexsort((np.arange(len(first)), -votes, k[first]))
    of = k[first[fullest]]
    place = np.arange(len(of)) - np.searchsorted(of, np.arange(n))[of]
    tried = first[fullest[place < TRIED]]
    of = k[tried]
    row, match = _ranges(start[of], start[of] + size[of])  # each transform with all matches of its pair
    off = turn[tried][row] * p[match]
    off += (q[tried] - turn[tried] * p[tried])[row]
    off -= q[match]
    near = off.real**2 + off.imag**2 <= ((bound + 1e-6) ** 2)[match]
    best = np.zeros(n, np.int64)
    np.maximum.at(best, of, np.bincount(row[near], minlength=len(tried)))
    return best >= enough


def agreeing(a: np.ndarray, b: np.ndarray, enough: int | None = None) -> int:
    """Corners of a that one similarity transform takes to the corner of b that is likest, as they are to it, within DISTANCE bits; places of either side count once.

    Each match tells a transform; those of the fullest bins of votes are tried
    until ``enough`` corners agree.  0 where fewer than ``enough`` corners match.
    """
    return agreeing_of_many(a, [b], [enough])[0]


def agreeing_of_many(a: np.ndarray, many: list[np.ndarray], enough: list[int | None]) -> list[int]:
    """``agreeing`` of an image with each of many; the descriptors of all are compared at once."""
    return Compared([a, *many]).agreeing(0, np.arange(1, len(many) + 1), enough)


class Store:
    """The stored corners of images; reads what is asked for by ranges."""

    def __init__(self, folder: str):
        self.folder, self.places = folder, {}

    def _file(self, number: int):
        fs, path = common.open_fs(f"{self.folder}/{number:016d}.corners")
        f = fs.open_input_file(path)
        if number not in self.places:
            if len(self.places) > 64:
                self.places.clear()
            size = f.size()
            n = int(np.frombuffer(f.read_at(8, size - 8), "<i8")[0])
            self.places[number] = np.frombuffer(f.read_at(8 * n, size - 8 - 8 * n), "<i8")
        return f, self.places[number]

    def read(self, nodes: np.ndarray) -> dict[int, np.ndarray]:
        """Corners by node; places close to each other are read at once."""
        out, nodes = {}, np.unique(nodes)
        number, row = nodes >> _ROW_BITS, nodes & (1 << _ROW_BITS) - 1
        for n in np.unique(number):
            f, places = self._file(int(n))
            with f:
                rows = row[number == n]
                lo, hi = places[rows], places[rows + 1]
                cut = np.flatnonzero((lo[1:] > hi[:-1] + 65536) | (lo[1:] // _READ != lo[:-1] // _READ)) + 1
                for some in np.split(np.arange(len(rows)), cut):
                    base = int(lo[some[0]])
                    data = f.read_at(int(hi[some[-1]]) - base, base)
                    for k in some:
                        # a copy: the bytes between the places that were asked for go
                        out[int(n) << _ROW_BITS | int(rows[k])] = np.frombuffer(data, CORNER, int(hi[k] - lo[k]) // CORNER.itemsize, int(lo[k]) - base).copy()
        return out

    def sizes(self, nodes: np.ndarray) -> np.ndarray:
        """Bytes of each node's corners."""
        out, number, row = np.zeros(len(nodes), np.int64), nodes >> _ROW_BITS, nodes & (1 << _ROW_BITS) - 1
        for n in np.unique(number):
            f, places = self._file(int(n))
            f.close()
            at = number == n
            out[at] = places[row[at] + 1] - places[row[at]]
        return out


def corners_of(images: DataFrame, folder: str, drawn=None) -> DataFrame:
    """Store the corners of ``images(image_id, media)`` below ``folder``; a row per image with its number there (node).

    Null, unreadable and flat images have no corners.  A file bears its task
    attempt's number, and only a finished attempt's rows name it.  ``drawn`` makes
    the batches of pictures from those of ``images`` in the same task.
    """
    spark = images.sparkSession
    common.prepare(spark)

    def work(batches):
        from pyspark import TaskContext

        number, at, places, rows = TaskContext.get().taskAttemptId(), 0, [0], []
        fs, path = common.open_fs(f"{folder}/{number:016d}.corners")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path, compression=None) as out:
            for b in drawn(batches) if drawn else batches:
                ids, data = b.column(0).to_pylist(), b.column(1).to_pylist()
                pictures = [decode(x) if i is not None else None for i, x in zip(ids, data)]
                found = describe_all([np.zeros((0, 0), np.float32) if p is None else p for p in pictures])
                for i, x, f in zip(ids, data, found):
                    out.write(f.tobytes())
                    at += f.nbytes
                    rows.append((number << _ROW_BITS | len(places) - 1, i, None if x is None else hashlib.blake2b(x, digest_size=16).digest(), len(f)))
                    places.append(at)
            out.write(np.array([*places, len(places)], "<i8").tobytes())
        for k in range(0, len(rows), 10_000):
            cols = zip(*rows[k : k + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.int32()))], names=["node", "image_id", "digest", "n"])

    rows = images.select(F.col("image_id").cast("long").alias("image_id"), "media")
    return common.materialize(rows.mapInArrow(work, IMAGES), "media-images")


def filed(nodes: DataFrame, folder: str) -> DataFrame:
    """(key, node) of the constellations of stored images."""

    def work(batches):
        store = Store(folder)
        for b in batches:
            have = store.read(b.column(0).to_numpy(zero_copy_only=False))
            names = np.array(list(have), np.int64)
            size = np.array([len(c) for c in have.values()], np.int64)
            if size.sum():
                who, keys = constellations(np.repeat(np.arange(len(names)), size), np.concatenate(list(have.values())))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "node": pa.array(names[who])})

    return nodes.select("node").mapInArrow(work, "key long, node long")


def packed(nodes: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(bucket, nodes, block): ``filed`` in blocks, one a bucket for some images: how many keys have each of the bucket's high parts, then the low parts, then the images' places in ``nodes``."""

    def work(batches):
        store = Store(folder)
        for b in batches:
            have = store.read(b.column(0).to_numpy(zero_copy_only=False))
            names = np.array(list(have), np.int64)
            size = np.array([len(c) for c in have.values()], np.int64)
            images = np.split(np.arange(len(names)), np.flatnonzero(np.diff(np.cumsum(size) // (BLOCK // 8))) + 1)
            have = list(have.values())
            for part in images:
                if size[part].sum():
                    yield from blocks(names[part], *constellations(np.repeat(np.arange(len(part)), size[part]), np.concatenate([have[k].view(np.dtype((np.void, CORNER.itemsize))) for k in part]).view(CORNER)))

    def blocks(names, who, keys):
        high = keys >> _LOW
        order = np.lexsort((keys, high % buckets))
        who, keys, high = who[order], keys[order], high[order]
        low, ends, out = (keys & (1 << _LOW) - 1).astype("<u4"), np.searchsorted(high % buckets, np.arange(buckets + 1)), []
        for k in np.flatnonzero(np.diff(ends)):
            at = slice(ends[k], ends[k + 1])
            count = np.bincount(high[at] // buckets, minlength=-(-(1 << KEY - _LOW) // buckets)).astype("<u4")
            own, place = np.unique(who[at], return_inverse=True)
            out.append((int(k), names[own].astype("<i8").tobytes(), b"".join(x.tobytes() for x in (count, low[at].astype("<u2"), (low[at] >> 16).astype("u1"), place.astype("<u2")))))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "nodes", "block"])

    return nodes.select("node").mapInArrow(work, "bucket int, nodes binary, block binary")


def _unpacked(bucket: int, nodes: bytes, block: bytes, buckets: int, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, node) of a block, or of its high parts from ``lo`` to ``hi``."""
    highs = -(-(1 << KEY - _LOW) // buckets)
    count, hi = np.frombuffer(block, "<u4", highs), highs if hi is None else hi
    n, at, size = int(count.sum()), int(count[:lo].sum()), int(count[lo:hi].sum())
    low, upper, who = (np.frombuffer(block, t, size, 4 * highs + before * n + width * at) for t, before, width in (("<u2", 0, 2), ("u1", 2, 1), ("<u2", 3, 2)))
    key = (np.repeat(np.arange(lo, hi, dtype=np.int64) * buckets + bucket << 8, count[lo:hi]) | upper) << 16 | low
    return key, np.frombuffer(nodes, "<i8")[who]


def _in_parts(bucket: int, blocks: list[tuple[bytes, bytes]], buckets: int):
    """(key, node) of a bucket's blocks (nodes, block), by ranges of its high parts of about ``ROWS`` keys; a key is in one of them."""
    total = sum(np.frombuffer(block, "<u4", -(-(1 << KEY - _LOW) // buckets)).astype(np.int64) for _, block in blocks)
    part = (np.cumsum(total) - total) // ROWS
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for lo, hi in zip(cuts, cuts[1:]):
        yield tuple(np.concatenate(c) for c in zip(*(_unpacked(bucket, *x, buckets, lo, hi) for x in blocks)))


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))


def _meeting(cols, starts, again):
    """The rows of ``_pairs`` for whole keys: key, node (and root), in order."""
    size = np.diff(np.append(starts, len(cols[0])))
    left, right, have = [], [], 0
    two = starts[size == 2]
    left.append(two)
    right.append(two + 1)
    for k in np.flatnonzero(size > 2):
        lo, n = int(starts[k]), int(size[k])
        if n > DENSE and not again:
            yield from _rows_of(cols, [np.full(n - 1, lo)], [np.arange(lo + 1, lo + n)], [lo], again)
            continue
        if again:
            for i in range(n - 1):
                j = lo + i + 1 + np.flatnonzero(cols[2][lo + i + 1 : lo + n] != cols[2][lo + i])
                left.append(np.full(len(j), lo + i))
                right.append(j)
                have += len(j)
                if have > BLOCK // 2:  # within a key too
                    yield from _rows_of(cols, left, right, [], again)
                    left, right, have = [], [], 0
        else:
            i, j = np.triu_indices(n, 1)
            left.append(lo + i)
            right.append(lo + j)
            have += len(left[-1])
        if have > BLOCK // 2:
            yield from _rows_of(cols, left, right, [], again)
            left, right, have = [], [], 0
    yield from _rows_of(cols, left, right, [], again)


def _rows_of(cols, left, right, dense, again):
    i, j = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (left, right))
    if again and len(i):
        ok = cols[2][i] != cols[2][j]
        i, j = i[ok], j[ok]
    names, place = np.unique(cols[1][np.concatenate([i, j])], return_inverse=True)  # pairs as one number each
    once, n = np.unique(place[: len(i)] * len(names) + place[len(i) :], return_counts=True)
    none = np.zeros(len(dense), np.int64)
    a, b, n = np.concatenate([names[once // max(1, len(names))], none]), np.concatenate([names[once % max(1, len(names))], none]), np.concatenate([n, none])
    key = np.full(len(a), cols[0][dense[0]] if dense else 0)
    real = np.arange(len(a)) < len(once)
    for lo in range(0, len(a), 1 << 16):
        s = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a[s], mask=~real[s]), "b": pa.array(b[s], mask=~real[s]), "n": pa.array(n[s]), "key": pa.array(key[s], mask=np.full(len(a[s]), not dense)), "star": pa.array(np.full(len(a[s]), bool(dense)))})


def _pairs(rows: DataFrame, again: bool) -> DataFrame:
    """(a, b, n, key, star) from rows(key, node) or, again, rows(key, node, root) dealt and sorted by key.

    All pairs of a key's images; of a dense key those with its first image
    (``star``, with the key), and a row with the key alone.  Again: all of
    different roots.
    """
    width = 3 if again else 2
    dealt = rows.repartition(_parts(rows.sparkSession), "key").sortWithinPartitions("key", "node")

    def work(batches):
        held, n = [], 0
        for b in batches:
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in range(width)])
            n += b.num_rows
            if n < 1 << 17:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            starts = _starts(cols[0])
            cut = int(starts[-1])
            held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
            if cut:
                yield from _meeting([c[:cut] for c in cols], starts[:-1], again)
        if held:
            cols = [np.concatenate(c) for c in zip(*held)]
            if len(cols[0]):
                yield from _meeting(cols, _starts(cols[0]), again)

    return dealt.mapInArrow(work, MET)


def met_once(nodes: DataFrame, folder: str) -> DataFrame:
    """``_pairs`` of ``filed``, whose rows go in blocks; a task has one bucket at a time, packed, and unpacks a bounded part of it."""
    buckets = _parts(nodes.sparkSession)

    def work(batches):
        held, bucket = [], None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != bucket:
                    yield from meeting(bucket, held)
                    held, bucket = [], row[0]
                held.append(row[1:])
        yield from meeting(bucket, held)

    def meeting(bucket, held):
        if held:
            for key, node in _in_parts(bucket, held, buckets):
                order = np.lexsort((node, key))
                key, node = key[order], node[order]
                starts = _starts(key)
                size = np.diff(np.append(starts, len(key)))
                many = np.repeat(size > 1, size)
                key, node = key[many], node[many]  # keys of one image make no pairs
                yield from _meeting((key, node), _starts(key), False)

    dealt = packed(nodes, folder, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(work, MET)


def _parts(spark: SparkSession) -> int:
    """Parts of what grows with corners and pairs, of which there are many an image."""
    return 3 * common.shuffle_partitions(spark)


def candidates(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of images that share enough keys for as many corners as must agree."""
    counted = met.where("a is not null").select("a", "b", "n").repartition(_parts(met.sparkSession), "a", "b").groupBy("a", "b").agg(F.sum("n").alias("shared")).where(F.col("shared") >= SHARED)
    side = lambda s: _small(nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}")))
    least = F.greatest(F.lit(LEAST_MATCHES), F.ceil(F.least("n_a", "n_b") * LEAST_SHARE))
    return counted.join(side("a"), "a").join(side("b"), "b").where(F.col("shared") * SHARED_PART >= least).select("a", "b")


def more_candidates(met: DataFrame, again: DataFrame, first: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of images that share enough keys, dense (``again``) and other ones (``met``) together, and weren't candidates ``first``."""
    dense = again.groupBy("a", "b").agg(F.sum("n").alias("n"))
    other = met.where("a is not null and not star").groupBy("a", "b").agg(F.sum("n").alias("other"))
    both = dense.join(other, ["a", "b"], "left").select("a", "b", (F.col("n") + F.coalesce("other", F.lit(0))).alias("n"))
    return candidates(both, nodes).join(first, ["a", "b"], "left_anti")


def verified(pairs: DataFrame, folder: str) -> DataFrame:
    """(a, b, agreed) of pairs (stored ones: they are read twice) of nodes with enough agreeing corners."""

    def checked(store, left, right):
        have = store.read(np.concatenate([left, right]))
        names = np.sort(np.array(list(have), np.int64))
        compared, own, other = Compared([have.pop(n) for n in names.tolist()]), np.searchsorted(names, left), np.searchsorted(names, right)
        size = compared.ends - compared.starts
        agreed = np.zeros(len(left), np.int32)
        starts = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
        for lo, hi in zip(starts, np.append(starts[1:], len(left))):  # all partners of an image
            least = [least_agreeing(size[own[lo]], n) for n in size[other[lo:hi]].tolist()]
            agreed[lo:hi] = [n if n >= e else 0 for n, e in zip(compared.agreeing(own[lo], other[lo:hi], least), least)]
        return pa.RecordBatch.from_pydict({"a": pa.array(left), "b": pa.array(right), "agreed": pa.array(agreed)}).filter(pa.array(agreed > 0))

    def parts(store, left, right):
        """Runs of pairs whose corners take a bounded room."""
        room = np.cumsum(store.sizes(left) * np.append(True, left[1:] != left[:-1]) + store.sizes(right)) // _HELD
        for part in np.unique(room):
            yield checked(store, left[room == part], right[room == part])

    def work(batches):
        store, held, n = Store(folder), [], 0
        for b in batches:
            held.append([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            n += b.num_rows
            if n >= 4096:
                yield from parts(store, *(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
        if n:
            yield from parts(store, *(np.concatenate(c) for c in zip(*held)))

    n = 2 * common.shuffle_partitions(pairs.sparkSession)  # the rows are few, their comparison isn't
    dealt = pairs.select("a", "b").repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b")  # partners of an image stay together, those of one that has many are spread
    return dealt.mapInArrow(work, "a long, b long, agreed int")


def links(nodes: DataFrame, folder: str) -> DataFrame:
    """(a, b, agreed): links of stored images that connect all that are linked by candidates."""
    conf = nodes.sparkSession.conf
    was = conf.get(TIDY) if conf.isModifiable(TIDY) else None
    try:  # every step is written, and its shuffle isn't read again
        conf.set(TIDY, "true")
        met = common.materialize(met_once(nodes.where(F.col("n") >= 3), folder), "media-met")
        first = common.materialize(candidates(met, nodes), "media-candidates")
        good = common.materialize(verified(first, folder), "media-links")
        stars = met.where("star and a is not null")
        dense = common.materialize(stars.select("key", F.col("b").alias("node")).unionByName(stars.select("key", F.col("a").alias("node")).distinct()), "media-dense")
        if not dense.isEmpty():
            group = common.materialize(components(good.select("a", "b")), "media-groups")
            rooted = dense.join(_small(group), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
            more = common.materialize(more_candidates(met, _pairs(rooted, True), first, nodes), "media-candidates")
            good = good.unionByName(common.materialize(verified(more, folder), "media-links"))
    finally:
        conf.unset(TIDY) if was is None else conf.set(TIDY, was)
    return good


def image_copies(images: DataFrame, drawn=None) -> DataFrame:
    """(image_id, class_id, n_corners): the smallest id of each group of images tied by links.

    Images of equal bytes are one group whatever they show, and their corners are
    compared once.  Other images without corners, unreadable ones and null ones
    are groups of their own; a null id has a null class and no corners.  Rows
    with the same id count as one image's, and have one row in the result, with
    the corners of all.  Other columns are ignored; an empty table gives no rows.
    ``drawn``: see corners_of.
    """
    folder = common.shared_dir(images.sparkSession, "media-corners")
    stored = corners_of(images, folder, drawn)
    known = stored.where("image_id is not null")
    same = known.where("digest is not null").groupBy("digest").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("same")).where("same > 1")
    copies = common.materialize(known.join(same, "digest").where("node <> first").select("node", "first"), "media-copies")
    once = common.materialize(known.join(_small(copies.select("node")), "node", "left_anti"), "media-once")
    ids = known.groupBy("image_id").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("same")).where("same > 1")
    own = known.join(ids, "image_id").where("node <> first").select("node", "first")
    edges = links(once, folder).select("a", "b").union(copies).union(own)
    group = components(edges)
    named = known.join(group, "node", "left").select("image_id", "n", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("image_id").alias("class_id"))
    found = named.join(least, "root").groupBy("image_id").agg(F.min("class_id").alias("class_id"), F.sum("n").cast("long").alias("n_corners"))
    none = stored.where("image_id is null").select("image_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_corners")).distinct()
    return found.unionByName(none)


def drawn(batches, across: int = 16, tile: int = 4):
    """(image_id, media) with each whole text as a PGM, a word a tile whose dots are its hash.

    The last row goes on with the first words, and pictures of few rows are
    mirrored at the edges, so that no frame is the same in all.
    """
    import xxhash

    tags = re.compile(rb"<[^>]*>")
    for b in batches:
        out = []
        for html in b.column(1).to_pylist():
            words = tags.sub(b" ", html).split()
            rows = max(1, -(-len(words) // across))
            dots = np.zeros((rows * across, tile * tile), np.uint8)
            if words:
                h = np.array([max(1, xxhash.xxh32_intdigest(w) & 0xFFFF) for w in words], np.uint16)
                dots = np.resize((h[:, None] >> np.arange(tile * tile, dtype=np.uint16) & 1).astype(np.uint8) * 255, dots.shape)
            picture = dots.reshape(rows, across, tile, tile).transpose(0, 2, 1, 3).reshape(rows * tile, across * tile)
            if words and rows < LEAST_ROWS:
                picture = np.pad(picture, 2 * PATCH, mode="symmetric")
            out.append(b"P5 %d %d 255\n" % picture.shape[::-1] + picture.tobytes())
        yield pa.RecordBatch.from_pydict({"image_id": b.column(0), "media": pa.array(out, pa.binary())})


def _texts(pages: DataFrame) -> DataFrame:
    common.prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("image_id"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("media"))


def rendered(pages: DataFrame) -> DataFrame:
    """(image_id, media): each page's whole text as a picture (``drawn``); the tables have no images of their own."""
    return _texts(pages).mapInArrow(drawn, "image_id long, media binary")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (page_id) with the class of copies of their rendered picture, and its corners; see image_copies for nulls and ties."""
    return image_copies(_texts(common.read_table(spark, sf_dir, "pages")), drawn).withColumnRenamed("image_id", "page_id")
