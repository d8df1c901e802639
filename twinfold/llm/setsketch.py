"""SetSketch registers of word shingles.

A register holds the least of exponentially distributed values, one for each element, truncated to steps of ratio BASE:
``floor(1 - log_BASE(x))``, within 16 bits. Registers of a union are the larger of both, and two registers agree about as
often as the sets overlap, so that runs of registers serve as keys of buckets. How often one sketch's registers are over,
under or equal to the other's gives the likelihood of each Jaccard similarity, as set sizes are known exactly.

Values are drawn by points: the points of an element are a Poisson process of rate REGISTERS whose marks are registers,
so the first point of each mark is exponential. Points beyond the largest least value so far change nothing, so an
element costs few points, not one for each register.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np

BANDS, BAND_ROWS = 40, 5
REGISTERS = BANDS * BAND_ROWS
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
WORDS = 4
PARITIES = 512
SIMILAR = 0.8
#: A pair whose likelihood at SIMILAR is this far (in log) below its best is no candidate: less than one in a million true pairs.
DOUBT = 14.0
#: Bytes of a text that are hashed at once, and elements that are sketched at once.
PIECE = 1 << 16
SLICE = 1 << 14

_U = np.uint64
_STEP, _PLACE = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\r\x0b\x0c")] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_hashes(piece: bytes, with_starts: bool = False) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    if len(piece) > PIECE:  # words that are longer than a piece
        return np.concatenate([np.frombuffer(hashlib.blake2b(w, digest_size=8).digest(), _U) for w in piece.split()] or [np.empty(0, _U)])
    codes = np.frombuffer(piece, np.uint8)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[codes]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # each byte counts by a mix of itself and its place in the word, which no structure of words can cancel as it can powers
    at = np.arange(len(codes), dtype=_U)
    first = np.zeros(len(codes), _U)
    first[starts] = at[starts]
    np.maximum.accumulate(first, out=first)
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(mixed((((at - first) << _U(8)) | codes) * _STEP + _PLACE), out=sums[1:])
    words = mixed(sums[ends] - sums[starts] + (ends - starts).astype(_U) * _STEP)
    return (words, starts) if with_starts else words


def word_hashes(text: bytes) -> np.ndarray:
    """Of the words, A-Z lower-cased."""
    text = text.lower()
    if len(text) <= PIECE:
        return _word_hashes(text)
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut > at:
                end = cut
            else:  # no blank in a whole piece: on to the next one
                later = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := text.find(c, end)) >= 0]
                end = min(later, default=len(text))
        out.append(_word_hashes(text[at:end]))
        at = end
    return np.concatenate(out)


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many words."""
    n = max(0, len(words) - width + 1)
    h = np.full(n, _U(width))
    for k in range(width):
        h = mixed(h * _STEP + words[k : k + n])
    return h


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct runs of WORDS words; of the whole sequence if it is shorter."""
    words = word_hashes(text)
    width = min(WORDS, len(words))
    return np.unique(_runs(words, width)) if width else words


def shingles_of(texts: Sequence[bytes]) -> list[np.ndarray]:
    """``shingles`` of each text; short texts are hashed together, a piece at a time."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and size + len(text) + 1 > PIECE:
            out += _shingles_of_group(group)
            group, size = [], 0
        if len(text) >= PIECE:
            out.append(shingles(text))
        else:
            group.append(text)
            size += len(text) + 1
    return out + (_shingles_of_group(group) if group else [])


def _shingles_of_group(texts: list[bytes]) -> list[np.ndarray]:
    joined = b"\n".join(texts).lower()
    words, starts = _word_hashes(joined, with_starts=True)
    ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    hashes = _runs(words, WORDS)
    out, first = [], 0
    for end in ends.tolist():
        if end - first >= WORDS:
            out.append(np.unique(hashes[first : end - WORDS + 1]))
        else:
            out.append(_runs(words[first:end], end - first) if end > first else words[:0])
        first = end
    return out


def fingerprint(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def sketch(elements: np.ndarray) -> np.ndarray:
    """REGISTERS values of 16 bits. Elements come in slices, each bounded by the least values of those before it."""
    least = np.full((1, REGISTERS), np.inf)
    for at in range(0, len(elements), SLICE):
        part = elements[at : at + SLICE]
        _draw(part, np.zeros(len(part), np.int64), least)
    return _registers(least)[0]


def sketches(sets: Sequence[np.ndarray]) -> np.ndarray:
    """``sketch`` of each set, in rows; small sets are drawn together."""
    out = np.empty((len(sets), REGISTERS), "<u2")
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (n + len(sets[end]) <= SLICE or end == at):
            n += len(sets[end])
            end += 1
        if n > SLICE:
            out[at] = sketch(sets[at])
        else:
            least = np.full((end - at, REGISTERS), np.inf)
            _draw(np.concatenate(sets[at:end]), np.repeat(np.arange(end - at), [len(x) for x in sets[at:end]]), least)
            out[at:end] = _registers(least)
        at = end
    return out


def _draw(active: np.ndarray, owner: np.ndarray, least: np.ndarray) -> None:
    """Lower the least values (a row for each owner) by the points of the elements."""
    flat, x, round_no, rounds = least.reshape(-1), np.zeros(len(active)), 0, 1
    while len(active):
        rounds = min(max(rounds, SLICE // len(active)), 16)
        drawn = mixed(active[:, None] + (np.arange(round_no, round_no + rounds, dtype=_U) + _U(1))[None, :] * _STEP)
        points = x[:, None] + np.cumsum(-np.log(((drawn >> _U(12)) + 0.5) / float(1 << 52)), axis=1) / REGISTERS
        marks = ((mixed(drawn ^ _STEP) >> _U(33)) % _U(REGISTERS)).astype(np.int64) + owner[:, None] * REGISTERS
        np.minimum.at(flat, marks.ravel(), points.ravel())
        x, round_no = points[:, -1], round_no + rounds
        more = x < least.max(axis=1)[owner]
        active, owner, x = active[more], owner[more], x[more]


def _registers(least: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least / RATE) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def parities(elements: np.ndarray) -> np.ndarray:
    """PARITIES bits as 64-bit words: whether an even or odd number of elements falls on each.

    Two sets differ in one element at least for each bit that differs.
    """
    places = (mixed(elements ^ _STEP) >> _U(32)) % _U(PARITIES)
    odd = np.bincount(places.astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, band number included."""
    rows = registers.reshape(BANDS, BAND_ROWS).astype(_U)
    h = np.arange(1, BANDS + 1, dtype=_U)
    for k in range(BAND_ROWS):
        h = mixed(h * _STEP + rows[:, k])
    return h.view(np.int64)


def _share(x: np.ndarray) -> np.ndarray:
    """How likely one register is over the other, x being the share of the union that is only in the one set."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, u: np.ndarray, over: np.ndarray, under: np.ndarray) -> np.ndarray:
    """Of similarity j; u is the first set's share of both sizes' sum."""
    v = 1 - u
    p, q = _share(np.maximum(u - v * j, 0)), _share(np.maximum(v - u * j, 0))
    safe = lambda x: np.log(np.maximum(x, 1e-12))
    return over * safe(p) + under * safe(q) + (REGISTERS - over - under) * safe(1 - p - q)


def candidates(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sketches (rows of a and b) may be SIMILAR or more, by sizes and by likelihood ratio."""
    u = n_a / (n_a + n_b)
    most = np.minimum(u / (1 - u), (1 - u) / u)
    over, under = (a > b).sum(axis=1), (a < b).sum(axis=1)
    low, high, golden = np.zeros(len(u)), most.copy(), (np.sqrt(5) - 1) / 2
    for _ in range(30):
        c, d = high - golden * (high - low), low + golden * (high - low)
        left = log_likelihood(c, u, over, under) >= log_likelihood(d, u, over, under)
        high, low = np.where(left, d, high), np.where(left, low, c)
    best = (low + high) / 2
    doubt = log_likelihood(best, u, over, under) - log_likelihood(np.full(len(u), SIMILAR), u, over, under)
    return (100 * np.minimum(n_a, n_b) >= 80 * np.maximum(n_a, n_b)) & ((best >= SIMILAR) | (doubt <= DOUBT))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exactly: 100 * intersection >= 80 * union, of sorted distinct elements."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= 80 * (len(a) + len(b) - shared) and shared > 0
