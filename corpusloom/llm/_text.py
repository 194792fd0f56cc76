"""Vectorised text primitives: code points of whole Arrow batches, look-alike tables, k-gram hashes.

Every function here works on one concatenated array of code points with document offsets, so that
per-character work runs in numpy and never in a Python loop over characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SIZE = 0x110000
#: Letters of other alphabets drawn like Latin ones, and the Latin ones.
LOOKALIKE = dict(
    zip(
        "аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХУІЈЅҮԌԜοναΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳϲԚ",
        "aeopcyxijshdqwlABEKMHOPCTXYIJSYGWovaABEZHIKMNOPTYXCjcQ",
        strict=True,
    )
)
#: Blocks that hold another width or code point of a letter, digit or ideograph.
FORMS = ((0x2E9F, 0x2EA0), (0x2EF3, 0x2EF4), (0x2F00, 0x2FD6), (0xFB00, 0xFB07), (0xFB13, 0xFB18), (0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B), (0xFF66, 0xFFDD), (0x132, 0x134), (0xB5, 0xB6))
#: Code points outside these ranges stand for themselves.
TABLED = ((0x20, 0x3400), (0xA640, 0xABF0), (0xF900, 0x10000), (0x10000, 0x12000), (0x1D400, 0x1D800), (0x1F100, 0x1F200), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))


def slices(lengths: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to about ``most``, so that scratch arrays stay small."""
    begin, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings, character offsets); a null is an empty string."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]]
    data = np.frombuffer(raw, np.uint8)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le", "surrogatepass"), "<u4")
    return points, at[ends - ends[0]]


def batches(column: pa.ChunkedArray | pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of an Arrow string column by bytes."""
    lengths = np.asarray(pc.binary_length(column).fill_null(0))
    for a, b in slices(lengths, most):
        yield a, column.slice(a, b - a)


def code_form(char: str) -> str:
    """One character without width, composition and kind of blank, in its own alphabet; "" for one without width."""
    cp, kind = ord(char), unicodedata.category(char)
    if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp == 0x34F:
        return ""
    if kind == "Zs" and cp != 0x1680:
        return " "
    if any(a <= cp < b for a, b in FORMS):
        char = unicodedata.normalize("NFKC", char)
    return unicodedata.normalize("NFC", char)


def base_form(char: str) -> str:
    """One character in the form that stands for all that look the same; "" for one without width."""
    parts = "".join(LOOKALIKE.get(c, c) for c in unicodedata.normalize("NFD", code_form(char)))
    return unicodedata.normalize("NFC", parts)


def letter_form(char: str) -> str:
    """The letters and digits of a character: look-alikes joined, case and accents removed."""
    base = unicodedata.normalize("NFKD", base_form(char)).casefold()
    return "".join(c for c in unicodedata.normalize("NFKD", base) if c.isalnum())


class Table:
    """A map of code points to short strings, applied to arrays: lengths 0..n per code point."""

    def __init__(self, rule, keep_rest: bool):
        self.first = np.arange(SIZE, dtype=np.uint32)
        self.length = np.full(SIZE, 1, np.uint8)
        self.length[:0x20] = int(keep_rest)
        self.length[0xD800:0xF900] = int(keep_rest)
        self.more: dict[int, str] = {}
        for a, b in TABLED:
            for cp in range(a, b):
                new = rule(chr(cp))
                self.length[cp] = len(new)
                if new:
                    self.first[cp] = ord(new[0])
                if len(new) > 1:
                    self.more[cp] = new
        most = max(map(len, self.more.values()), default=1)
        self.rest = {j: np.array([[cp, ord(s[j])] for cp, s in self.more.items() if len(s) > j], np.uint32) for j in range(1, most)}

    def apply(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(new code points, new offsets)."""
        n = self.length[points]
        new_ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[ends]
        if n.size == 0 or n.max() <= 1:
            return self.first[points][n == 1], new_ends
        source = np.repeat(np.arange(len(points)), n)
        out = self.first[points[source]]
        within = np.arange(len(source)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
        for j, pairs in self.rest.items():
            at = np.flatnonzero(within == j)
            if at.size:
                order = np.argsort(pairs[:, 0])
                out[at] = pairs[order, 1][np.searchsorted(pairs[order, 0], points[source[at]])]
        return out, new_ends


@lru_cache
def look_table() -> Table:
    """Code points to their base form; letter case, punctuation and line ends stay as they are."""
    return Table(base_form, keep_rest=True)


@lru_cache
def code_table() -> Table:
    """Code points to their form in their own alphabet; letter case, punctuation and line ends stay as they are."""
    return Table(code_form, keep_rest=True)


@lru_cache
def letter_table() -> Table:
    """Code points to bare letters and digits; all else goes."""
    return Table(letter_form, keep_rest=False)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(letters and digits of all strings in base form, offsets)."""
    return letter_table().apply(*codepoints(column))


def to_strings(points: np.ndarray, ends: np.ndarray) -> list[str]:
    text = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    e = ends.tolist()
    return [text[a:b] for a, b in zip(e[:-1], e[1:], strict=True)]


BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def kgrams(points: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the k-gram that begins at each position, mask of positions whose k-gram ends in the same document).

    Polynomial hashes of length 1, 2, 4, ... are joined by doubling, so a k-gram costs log2(k) passes.
    """
    n = len(points)
    with np.errstate(over="ignore"):
        powers = {1: BASE}
        hashes = {1: mix(points.astype(np.uint64) + np.uint64(1))}
        step = 1
        while step * 2 <= k:
            h = hashes[step]
            nxt = h * powers[step]
            nxt[: n - step] += h[step:]
            hashes[step * 2], powers[step * 2] = nxt, powers[step] * powers[step]
            step *= 2
        out, done = None, 0
        for size in sorted(hashes, reverse=True):
            if done + size <= k:
                h = hashes[size]
                if out is None:
                    out = h.copy()
                else:
                    out *= powers[size]
                    if n > done:
                        out[: n - done] += h[done:]
                done += size
        valid = np.zeros(n, bool)
        if n:
            counts = np.diff(ends)
            last = np.repeat(ends[1:] - k, counts)
            valid = np.arange(n) <= last
        return mix(out) if out is not None else np.zeros(0, np.uint64), valid


def winnow(hashes: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum hash of every window of ``w`` consecutive k-grams.

    A position is kept if its hash is the minimum of at least one window that holds it; equal minima are
    all kept. Any shared span of w + k - 1 letters therefore shares at least one kept position.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(valid, hashes, top)
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    low = _sliding(np.concatenate([np.full(w - 1, top), h, np.full(w - 1, top)]), w, np.minimum)
    high = _sliding(low, w, np.maximum)[:n]
    return np.flatnonzero(valid & (high == h))


def _sliding(h: np.ndarray, w: int, op) -> np.ndarray:
    """op over h[i : i + w] for every i with a whole window."""
    out, size = h, 1
    while size * 2 <= w:
        out = op(out[: len(out) - size], out[size:])
        size *= 2
    rest = w - size
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def cover(query: np.ndarray, text: np.ndarray, m: int, band: int, gap: int) -> np.ndarray:
    """Mask of the query's letters that recur in ``text`` in order and in one place.

    m-grams that both share are matched; the diagonals within the ``band`` that holds most matches count;
    gaps of at most ``gap`` letters between matched runs (scattered changes) are filled.
    """
    mask = np.zeros(len(query), bool)
    if len(query) < m or len(text) < m:
        return mask
    a, _ = kgrams(query, np.array([0, len(query)]), m)
    b, _ = kgrams(text, np.array([0, len(text)]), m)
    a, b = a[: len(query) - m + 1], b[: len(text) - m + 1]
    order = np.argsort(a, kind="stable")
    s = a[order]
    lo, hi = np.searchsorted(s, b, "left"), np.searchsorted(s, b, "right")
    n = hi - lo
    if not n.any():
        return mask
    at_text = np.repeat(np.arange(len(b)), n)
    at_query = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    diag = at_text - at_query
    d = np.sort(diag)
    inside = np.searchsorted(d, d + band, "right") - np.arange(len(d))
    best = d[np.argmax(inside)]
    hits = at_query[(diag >= best) & (diag <= best + band)]
    for j in range(m):
        mask[hits + j] = True
    return filled(mask, gap)


def filled(mask: np.ndarray, gap: int) -> np.ndarray:
    """The mask with gaps of at most ``gap`` between its runs filled."""
    out, at = mask.copy(), np.flatnonzero(mask)
    step = np.diff(at)
    for i in np.flatnonzero((step > 1) & (step <= gap + 1)):
        out[at[i] : at[i + 1]] = True
    return out
