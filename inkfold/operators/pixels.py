"""Pictures of pages: ink, straightening, rules and lines of text, with numpy inside Arrow batches.

A picture is an array of height x width (grey) or x 3 (blue, green, red) bytes. Everything works on runs of ink along one axis,
found by differences and running sums, so no picture library is needed. A page is one row of a table and its picture lives in
one task only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Ink is darker than the mean of a window by this much.
WINDOW, DARKER = 25, 15
#: A rule that tells the page's tilt spans this share of it, and is this flat; tilts beyond or under these degrees are left.
TILT_SPAN, TILT_FLAT, MOST_TILT, LEAST_TILT = 0.25, 0.1, 5.0, 0.05
#: Rules cover this share of the page's height and width; positions this near are one rule; a border of the page has none; columns of a table.
COVER_X, COVER_Y, SAME_RULE, BORDER, LEAST_COLUMNS = 0.12, 0.30, 12.0, 0.02, 6
#: A page lies on its side if rules down outweigh rules across by this; it is upside down if ink below its table outweighs ink above by this.
SIDEWAYS, INVERTED = 1.5, 3.0
#: A pen's colour; specks in pixels; blank lines inside a line of text; a lower band is a mark; a gap between words in line heights.
SATURATED, BRIGHT, SPECK, LINE_GAP, MARK_BAND, WORD_GAP = 50, 120, 6, 2, 0.45, 0.22
#: Dots of a leader: their size, least area, number, and how far apart they stand.
DOT, DOT_AREA, DOTS, DOT_RISE, DOT_STEP = 8, 3, 3, 3, 16
#: Margin around a word that is cut out, and the height of what a reader gets.
PAD, READ_HEIGHT = 4, 48

GRID_DDL = "x_rules array<double>, y_rules array<double>, skew double, width double, height double, rotation int, error string"


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of a picture in blue, green, red."""
    return image if image.ndim == 2 else np.rint(image @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def ink(image: np.ndarray) -> np.ndarray:
    """Where a picture is darker than the mean around it."""
    page, half = grey(image).astype(np.int64), WINDOW // 2
    padded = np.pad(page, half, mode="edge")
    sums = np.pad(padded, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
    around = sums[WINDOW:, WINDOW:] - sums[:-WINDOW, WINDOW:] - sums[WINDOW:, :-WINDOW] + sums[:-WINDOW, :-WINDOW]
    return page <= np.rint(around / WINDOW**2) - DARKER


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, start and end (outside) of each run along the second axis."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    line, start = np.nonzero(edges == 1)
    return line, start, np.nonzero(edges == -1)[1]


def long_runs(mask: np.ndarray, length: int, across: bool = True, grown: bool = True) -> np.ndarray:
    """Runs of at least `length` along an axis, each a half of that longer at both ends if grown, which closes breaks of a rule."""
    own = mask if across else mask.T
    line, start, end = runs(own)
    keep = end - start >= length
    line, start, end = line[keep], start[keep], end[keep]
    more = length // 2 if grown else 0
    marks = np.zeros((own.shape[0], own.shape[1] + 1), np.int32)
    np.add.at(marks, (line, np.maximum(start - more, 0)), 1)
    np.add.at(marks, (line, np.minimum(end + more, own.shape[1])), -1)
    out = marks.cumsum(axis=1)[:, :-1] > 0
    return out if across else out.T


def pieces(mask: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The piece that each run belongs to, and the runs: runs of neighbouring lines that touch, corners included, are one piece."""
    line, start, end = found = runs(mask)
    top = np.arange(len(line))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    heads = np.searchsorted(line, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = heads[y - 1], heads[y]
        while i < heads[y] and j < heads[y + 1]:
            if start[j] <= end[i] and start[i] <= end[j]:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
            i, j = (i + 1, j) if end[i] < end[j] else (i, j + 1)
    return np.array([root(i) for i in range(len(line))], np.int64), found


def tilts(image: np.ndarray) -> list[float]:
    """The angle, in degrees, of each long flat piece of ink across the page."""
    mask = ink(image)
    width = mask.shape[1]
    owner, (line, start, end) = pieces(long_runs(mask, max(width // 25, 20), grown=False))
    out = []
    for piece in np.unique(owner):
        own = owner == piece
        n, middle, y = (end - start)[own].astype(float), (start + end - 1)[own] / 2, line[own].astype(float)
        span, thick = end[own].max() - start[own].min(), np.ptp(line[own]) + 1
        if span < width * TILT_SPAN or thick > span * TILT_FLAT:
            continue
        # least squares over all pixels of the runs
        mx, my = np.average(middle, weights=n), np.average(y, weights=n)
        spread = (n * (middle - mx) ** 2 + (n**3 - n) / 12).sum()
        angle = np.degrees(np.arctan2((n * (middle - mx) * (y - my)).sum(), spread))
        if abs(angle) <= MOST_TILT:
            out.append(float(angle))
    return out


def turned(image: np.ndarray, degrees: float) -> np.ndarray:
    """A picture turned about its centre, with its edges carried on."""
    height, width = image.shape[:2]
    a, cx, cy = np.radians(degrees), width / 2, height / 2
    y, x = np.mgrid[0:height, 0:width].astype(float)
    sx, sy = np.cos(a) * (x - cx) - np.sin(a) * (y - cy) + cx, np.sin(a) * (x - cx) + np.cos(a) * (y - cy) + cy
    sx, sy = np.clip(sx, 0, width - 1), np.clip(sy, 0, height - 1)
    x0, y0 = np.minimum(sx.astype(int), max(width - 2, 0)), np.minimum(sy.astype(int), max(height - 2, 0))
    x1, y1, fx, fy = np.minimum(x0 + 1, width - 1), np.minimum(y0 + 1, height - 1), sx - x0, sy - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    out = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    return np.rint(out).astype(np.uint8)


def deskewed(image: np.ndarray) -> tuple[np.ndarray, float]:
    """The picture with its rules level, and the angle that was taken out."""
    found = tilts(image)
    angle = float(np.median(found)) if found else 0.0
    return (turned(image, angle), angle) if LEAST_TILT <= abs(angle) <= MOST_TILT else (image, 0.0)


def oriented(image: np.ndarray) -> tuple[np.ndarray, int]:
    """The picture upright, and the clockwise turn that it took, in degrees."""
    rotation, (height, width) = 0, image.shape[:2]
    if height > width:
        mask = ink(image)
        down, across = (long_runs(mask, max(n // 15, 20), across=h).sum() for n, h in ((height, False), (width, True)))
        if down > across * SIDEWAYS:
            image, rotation = np.rot90(image, 1), 270
    if upside_down(image):
        image, rotation = np.rot90(image, 2), (rotation + 180) % 360
    return np.ascontiguousarray(image), rotation


def upside_down(image: np.ndarray) -> bool:
    """Whether most ink outside the table, which reaches as far as its upright rules, is under it."""
    mask = ink(image)
    height, width = mask.shape
    side, edge = int(width * BORDER), int(height * BORDER)
    inner = slice(side, width - side)
    spans = np.flatnonzero(long_runs(mask, max(height // 15, 20), across=False)[:, inner].any(axis=1))
    if not len(spans):
        return False
    above = mask[edge : max(spans[0] - 5, edge), inner].sum()
    below = mask[min(spans[-1] + 5, height - edge) : height - edge, inner].sum()
    return bool(255 * below > max(255 * above, 1) * INVERTED)


def merged(positions: np.ndarray, gap: float = SAME_RULE) -> list[float]:
    """The means of runs of sorted positions without a wider gap."""
    if not len(positions):
        return []
    return [float(p.mean()) for p in np.split(positions.astype(float), np.flatnonzero(np.diff(positions) > gap) + 1)]


def rule_positions(mask: np.ndarray, across: bool, cover: float) -> list[float]:
    """Places of rules across (y) or down (x) that cover enough of the page, without its borders."""
    profile, span, extent = mask.sum(axis=1 if across else 0), mask.shape[1 if across else 0], mask.shape[0 if across else 1]
    found = merged(np.flatnonzero(profile >= max(span * cover, 10.0)))
    return [p for p in found if extent * BORDER <= p <= extent * (1 - BORDER)]


def grid_of(image: np.ndarray) -> tuple[np.ndarray, dict]:
    """The straightened picture and its grid: x_rules, y_rules, skew, width, height; error instead of rules without a table."""
    straight, angle = deskewed(image)
    mask = ink(straight)
    height, width = mask.shape
    xs = rule_positions(long_runs(mask, max(height // 30, 20), across=False), False, COVER_X)
    ys = rule_positions(long_runs(mask, max(width // 30, 20)), True, COVER_Y)
    error = None
    if len(xs) - 1 < LEAST_COLUMNS:
        error = f"no table grid: {max(len(xs) - 1, 0)} columns, not {LEAST_COLUMNS}"
    elif len(ys) < 2:
        error = "no table grid: no rules across"
    return straight, {"x_rules": [] if error else xs, "y_rules": [] if error else ys, "skew": angle, "width": float(width), "height": float(height), "error": error}


def pen(image: np.ndarray) -> np.ndarray:
    """Pixels of a pen or marker."""
    own = image.astype(np.int16)
    return (np.ptp(own, axis=2) > SATURATED) & (own.max(axis=2) > BRIGHT)


def printed(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ink, page): printed ink without pen and rules, and the grey page with both painted out."""
    mask, page = ink(image), grey(image).copy()
    if image.ndim == 3:
        marked = pen(image)
        mask, page[marked] = mask & ~marked, 255
    height, width = mask.shape
    for across, length in ((True, max(width // 40, 25)), (False, max(height // 40, 25))):
        rules = long_runs(mask, length, across, grown=False)
        mask = mask & ~rules
        # a rule's grey edges along it
        wide = rules.copy()
        if across:
            wide[:, 1:] |= rules[:, :-1]
            wide[:, :-1] |= rules[:, 1:]
        else:
            wide[1:] |= rules[:-1]
            wide[:-1] |= rules[1:]
        page[wide] = 255
    return mask, page


def _spans(on: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Runs of a row of flags, those that fewer than `gap` unset flags part as one."""
    _, start, end = runs(on[None, :])
    if not len(start):
        return []
    cut = np.flatnonzero(start[1:] - end[:-1] >= gap)
    return list(zip(start[np.r_[0, cut + 1]].tolist(), end[np.r_[cut, len(end) - 1]].tolist()))


def line_bands(mask: np.ndarray) -> list[tuple[int, int]]:
    """Top and bottom of each line of text; a low band (a vowel or tone mark) goes with the nearest band, the upper one of two."""
    bands = [b for b in _spans(mask.any(axis=1), LINE_GAP + 1) if mask[b[0] : b[1]].sum() >= SPECK]
    least = max((b - a for a, b in bands), default=0) * MARK_BAND
    while len(bands) > 1:
        low = next((i for i, (a, b) in enumerate(bands) if b - a < least), None)
        if low is None:
            break
        near = [(bands[low][0] - bands[low - 1][1], low - 1)] * (low > 0) + [(bands[low + 1][0] - bands[low][1], low)] * (low + 1 < len(bands))
        at = min(near)[1]
        bands[at : at + 2] = [(bands[at][0], max(bands[at][1], bands[at + 1][1]))]
    return bands


def word_spans(line: np.ndarray) -> list[tuple[int, int]]:
    """Left and right of each word of a line of text."""
    return [s for s in _spans(line.any(axis=0), max(int(line.shape[0] * WORD_GAP), 4)) if line[:, s[0] : s[1]].sum() >= SPECK]


def without_leaders(mask: np.ndarray) -> np.ndarray:
    """mask without rows of three or more small dots that stand close, as forms leave blanks with; single stops stay."""
    owner, (line, start, end) = pieces(mask)
    dots = []
    for piece in np.unique(owner):
        own = owner == piece
        x0, x1, y0, y1, area = start[own].min(), end[own].max(), line[own].min(), line[own].max() + 1, (end - start)[own].sum()
        if x1 - x0 <= DOT and y1 - y0 <= DOT and area >= DOT_AREA:
            dots.append(((x0 + x1) / 2, (y0 + y1) / 2, piece))
    dots.sort(key=lambda d: (round(d[1] / 4), d[0]))
    follows = [abs(b[1] - a[1]) <= DOT_RISE and 0 < b[0] - a[0] <= DOT_STEP for a, b in zip(dots, dots[1:])]
    out, held = mask.copy(), []
    for n, dot in enumerate(dots):
        held.append(dot[2])
        if n == len(follows) or not follows[n]:
            for i in np.flatnonzero(np.isin(owner, held)) if len(held) >= DOTS else ():
                out[line[i], start[i] : end[i]] = False
            held = []
    return out


def cut(page: np.ndarray, box: tuple[int, int, int, int], height: int = READ_HEIGHT) -> np.ndarray:
    """A word (x0, y0, x1, y1) of a grey page in a white margin, scaled to what a reader gets."""
    x0, y0, x1, y1 = box
    word = np.pad(page[y0:y1, x0:x1], PAD, constant_values=255)
    width = max(1, round(word.shape[1] * height / word.shape[0]))
    rows, columns = (np.arange(height) * word.shape[0] // height), (np.arange(width) * word.shape[1] // width)
    return word[rows[:, None], columns]


def read_cells(image: np.ndarray, x_rules: list[float], y_rules: list[float], read: Callable[[list[np.ndarray]], list[tuple[str, float]]], inset: int = 5) -> list[dict]:
    """Boxes (ord, text, x0, y0, x1, y1, confidence) of the lines of each inked cell of a ruled table, in reading order.

    Words are cut out and read apart, all at once, and joined again: text in x order, the union of boxes, the least confidence.
    """
    mask, page = printed(image)
    words: list[tuple[tuple, tuple[int, int, int, int]]] = []
    for r, (top, bottom) in enumerate(zip(y_rules, y_rules[1:])):
        for c, (left, right) in enumerate(zip(x_rules, x_rules[1:])):
            x, y = int(left) + inset, int(top) + inset
            cell = mask[y : max(int(bottom) - inset, y), x : max(int(right) - inset, x)]
            if min(cell.shape) < 6 or cell.sum() < 20:
                continue
            for a, b in line_bands(cell):
                words += [((r, c, a), (x + p, y + a, x + q, y + b)) for p, q in word_spans(cell[a:b])]
    lines: dict[tuple, list] = {}
    for (group, box), (text, sure) in zip(words, read([cut(page, box) for _, box in words]) if words else []):
        if (text or "").strip():
            lines.setdefault(group, []).append((box, text.strip(), sure))
    out = []
    for own in lines.values():
        boxes = np.array([w[0] for w in sorted(own)])
        sure = [w[2] for w in own if w[2] is not None]
        x0, y0, x1, y1 = boxes[0, 0], boxes[:, 1].min(), boxes[-1, 2], boxes[:, 3].max()
        out.append({"text": " ".join(w[1] for w in sorted(own)), "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1), "confidence": min(sure) if sure else None})
    out.sort(key=lambda b: (round(b["y0"], 1), b["x0"]))
    return [{**b, "ord": n} for n, b in enumerate(out)]


def decoded(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return image[:, :, 0] if channels == 1 else image[:, :, :3]


def grids(images: DataFrame, keys: list[str], turn: bool = True) -> DataFrame:
    """keys and GRID_DDL of pictures (keys, h, w, c, data): upright if `turn`, straightened, ruled. A picture that fails has an error."""
    kinds = ", ".join(f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys)

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                own = {k: row[k] for k in keys}
                try:
                    image, rotation = (oriented if turn else lambda i: (i, 0))(decoded(row["data"], int(row["h"]), int(row["w"]), int(row["c"])))
                    rows.append({**own, "rotation": rotation, **grid_of(image)[1]})
                except Exception as failed:  # noqa: BLE001  one page must not fail the others
                    rows.append({**own, "x_rules": [], "y_rules": [], "skew": 0.0, "width": 0.0, "height": 0.0, "rotation": 0, "error": f"{type(failed).__name__}: {failed}"})
            yield pd.DataFrame(rows, columns=[*keys, "x_rules", "y_rules", "skew", "width", "height", "rotation", "error"])

    return images.mapInPandas(each, f"{kinds}, {GRID_DDL}")
