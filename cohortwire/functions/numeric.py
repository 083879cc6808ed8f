"""Small numpy routines for short series: Welch spectra, zero-phase filters, elevation anchors."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def detrended(x: np.ndarray) -> np.ndarray:
    """x less its least-squares line."""
    t = np.arange(len(x), dtype=float)
    t -= t.mean()
    slope = (t @ x) / (t @ t) if len(x) > 1 else 0.0
    return x - x.mean() - slope * t


def welch(x: np.ndarray, fs: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density by averaged Hann segments that overlap by half, each less its mean."""
    n = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = max(1, n - n // 2)
    parts = np.stack([x[i : i + n] for i in range(0, len(x) - n + 1, step)])
    parts = parts - parts.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(parts * window, axis=1)) ** 2 / (fs * (window**2).sum())
    power[:, 1 : (None if n % 2 else -1)] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power.mean(axis=0)


def trapezoid(y: np.ndarray, x: np.ndarray) -> float:
    return float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()) if len(x) > 1 else 0.0


@lru_cache(maxsize=256)
def butterworth(order: int, edges: tuple[float, ...], fs: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections (b, a) of a digital Butterworth low-pass (one edge) or band-pass (two), by the bilinear transform.  Those
    of the settings last used are kept, as most series have few rates."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warped = [2 * fs * np.tan(np.pi * f / fs) for f in edges]
    if len(edges) == 1:
        analog, zeros_at_one = poles * warped[0], 0
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        analog, zeros_at_one = np.concatenate([half + root, half - root]), order
    digital = (2 * fs + analog) / (2 * fs - analog)
    upper = sorted((p for p in digital if p.imag > 1e-12), key=abs)
    pairs = [(p, p.conjugate()) for p in upper]
    reals = sorted((p.real for p in digital if abs(p.imag) <= 1e-12))
    pairs += [(a, b) for a, b in zip(reals[::2], reals[1::2])]
    sections = []
    for p, q in pairs:
        zeros = [-1.0, 1.0] if zeros_at_one else [-1.0, -1.0]
        sections.append((np.poly(zeros).real, np.poly([p, q]).real))
    if len(reals) % 2:
        sections.append((np.array([1.0, 1.0]), np.array([1.0, -reals[-1]])))
    at = 1.0 if len(edges) == 1 else np.exp(2j * np.arctan(np.sqrt(warped[0] * warped[1]) / (2 * fs)))
    gain = np.prod([np.polyval(b, at) / np.polyval(a, at) for b, a in sections])
    sections[0] = (sections[0][0] / abs(gain), sections[0][1])
    return sections


#: Samples of a block, within which a section is one matrix product.
BLOCK = 64


def _states(step: np.ndarray, first: np.ndarray, given: np.ndarray) -> np.ndarray:
    """s[0] = first, s[k + 1] = step s[k] + given[k], for all k at once: sums over stretches that double in length."""
    s = np.concatenate([first[None, :], given[:-1]])
    reach, power = 1, step
    while reach < len(s):
        s[reach:] = s[reach:] + s[:-reach] @ power.T
        power, reach = power @ power, 2 * reach
    return s


@lru_cache(maxsize=256)
def _block_matrices(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, ...]:
    """Of a section: a block's response to its samples and to its first state, what a block leaves, its step of the
    state, and the steady state of a series of ones."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    step = np.eye(n - 1, k=1) - np.outer(a[1:], np.eye(1, n - 1))  # of the state, without input
    enter = b[1:] - a[1:] * b[0]  # what a sample adds to it
    gain = b.sum() / a.sum()
    first = np.array([b[k + 1 :].sum() - a[k + 1 :].sum() * gain for k in range(n - 1)])
    powers = [np.eye(n - 1)]
    for _ in range(BLOCK):
        powers.append(step @ powers[-1])
    seen = np.stack([p[0] for p in powers[:BLOCK]])  # what the state at a block's start adds to each of its samples
    response = np.concatenate([[b[0]], seen[: BLOCK - 1] @ enter])
    lag = np.subtract.outer(np.arange(BLOCK), np.arange(BLOCK))
    inside = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    leave = np.stack([powers[BLOCK - 1 - j] @ enter for j in range(BLOCK)])
    return inside, seen, leave, powers[BLOCK], first


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One section from the steady state of the first value.

    Blocks of samples are filtered by the matrix of the impulse response; what a block inherits is its state, and the
    states of all blocks follow from each other by a linear recursion, so no step goes sample by sample.
    """
    inside, seen, leave, step, first = _block_matrices(tuple(b.tolist()), tuple(a.tolist()))
    blocks = np.zeros((-(-len(x) // BLOCK), BLOCK))
    blocks.reshape(-1)[: len(x)] = x
    states = _states(step, first * x[0], blocks @ leave)
    return (blocks @ inside.T + states @ seen.T).reshape(-1)[: len(x)]


def zero_phase(sections, x: np.ndarray, starts: bool = True, ends: bool = True) -> np.ndarray:
    """Forward and backward filtering, with odd extension at both ends; at neither where x is a piece of a longer series
    that goes on there: the result then holds beyond memory_of() samples from that end."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    left, right = pad if starts else 0, pad if ends else 0
    y = np.concatenate([2 * x[0] - x[left:0:-1], x, 2 * x[-1] - x[-2 : -right - 2 : -1]])
    for _ in range(2):
        for b, a in sections:
            y = filtered(b, a, y)
        y = y[::-1]
    return y[left : len(y) - right]


def memory_of(sections, left: float = 1e-15) -> int:
    """Samples after which the filter has forgotten all but the share `left` of what came before."""
    slowest = max(max(abs(np.roots(a))) for _, a in sections)
    return int(np.ceil(np.log(left) / np.log(slowest)))


def elevation_hits(seconds: np.ndarray, elevation: np.ndarray, metres: float = 3.0, least_s: float = 10.0, rest_s: float = 30.0):
    """(index, change) whenever the elevation is `metres` from the anchor for at least least_s since it was set and
    rest_s since the last hit; the anchor moves to each hit."""
    hits, at, anchor, last = [], 1, 0, -np.inf
    while at < len(seconds):
        # The anchor stays until the next hit, so a stretch is tested at once.
        stop = min(len(seconds), at + 4096)
        now, change = seconds[at:stop], elevation[at:stop] - elevation[anchor]
        hit = np.flatnonzero((np.abs(change) >= metres) & (now - seconds[anchor] >= least_s) & (now - last >= rest_s))
        if not len(hit):
            at = stop
            continue
        i = at + int(hit[0])
        hits.append((i, float(change[hit[0]])))
        anchor, last, at = i, seconds[i], i + 1
    return hits
