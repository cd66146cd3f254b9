"""Robust autoregression with outlier and level-shift tests, in numpy.

Pure numerics without Spark: :mod:`millrace.operators.faults` applies
:func:`find_faults` to the shards of each series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NONE, SPIKE, STUCK, LIMIT = 0, 1, 2, 3
DAY_MS = 86_400_000.0


def still_runs(x: np.ndarray, alpha: float = 0.01, least: int = 10) -> np.ndarray:
    """Marks stretches that hold (nearly) one value far longer than the series does.

    Two neighbours are "still" if they differ by at most 15 % of the series' median step (0 for a
    coarse series, whose median step is 0).  With ``p`` the share of still steps outside found
    stretches, a run is too long if one of its length is expected less than ``alpha`` times in a
    series like this.  Runs broken by up to three strays that return to the held value are joined;
    the strays are not marked.
    """
    n = len(x)
    if n <= least:
        return np.zeros(n, bool)
    step = float(np.median(np.abs(np.diff(x))))
    groups, still = _groups(x, step)
    need = longest_still(n, int(still.sum()), np.array([_readings(g) for g in groups]), np.array([_steps(g) for g in groups]), alpha, least)
    return mark_still(x, step, need)


def _tolerance(x: np.ndarray, step: float) -> float:
    return 0.15 * step + 1e-9 * max(1.0, abs(float(np.median(x))))


def _groups(x: np.ndarray, step: float) -> tuple[list[list[list[int]]], np.ndarray]:
    """Runs of still steps, as first and last reading, those that strays break in one group; and which steps are still."""
    tol = _tolerance(x, step)
    still = np.abs(np.diff(x)) <= tol
    edge = np.flatnonzero(np.diff(np.r_[0, still.astype(np.int8), 0]))
    groups: list[list[list[int]]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= 2 and groups and a - groups[-1][-1][1] <= 4 and abs(np.median(x[a : b + 1]) - np.median(x[groups[-1][-1][0] : groups[-1][-1][1] + 1])) <= 2 * tol:
            groups[-1].append([a, b])
        else:
            groups.append([[a, b]])
    return groups, still


def _readings(g: list[list[int]], lo: int = 0, hi: int = 1 << 62) -> int:
    """How many readings of the runs of a group lie from ``lo`` to ``hi``."""
    return sum(max(0, min(b, hi) - max(a, lo) + 1) for a, b in g)


def _steps(g: list[list[int]]) -> int:
    return sum(b - a for a, b in g)


def longest_still(n: int, still: int, sizes: np.ndarray, steps: np.ndarray, alpha: float = 0.01, least: int = 10) -> float:
    """From how many readings on a held stretch is too long for a series of ``n`` readings, ``still`` still steps and such groups."""
    # the share of still steps, without the stretches that are clearly too long
    p = still / max(1, n - 1)
    for _ in range(3):
        lost = int(steps[sizes >= _too_long(p, n, alpha, least)].sum())
        rest = (still - lost) / max(1, n - 1 - lost)
        if abs(rest - p) < 1e-6:
            break
        p = rest
    return _too_long(p, n, alpha, least)


#: What a border of a shard cuts: readings of the group and of the run that lie beyond it, and the longest run of that group there.
NOTHING = (0, 0, 0)


def edges(x: np.ndarray, step: float, first: int, last: int) -> tuple[np.ndarray, np.ndarray, int, list[int]]:
    """Of a shard whose own readings are ``first`` to ``last``: sizes and steps of the groups that begin in it, its still steps,
    and what its borders cut: for left and right (cut or not, readings of the group, of the run, longest run), and whether one
    group and one run go all through."""
    groups, still = _groups(x, step)
    begun = [g for g in groups if first <= g[0][0] <= last]
    cut = []
    for at in (first, last + 1):  # the border is before this reading
        g = next((g for g in groups if g[0][0] < at <= g[-1][1]), None)
        r = next((r for r in g or [] if r[0] < at <= r[1]), None)
        cut += [int(g is not None), _readings(g or [], first, last), _readings([r] if r else [], first, last), max((_readings([q], first, last) for q in g or []), default=0)]
    through = [any(q[0][0] < first and q[-1][1] > last for q in groups), any(r[0] < first and r[1] > last for q in groups for r in q)]
    own = int(still[max(0, first - 1) : last].sum())
    return np.array([_readings(g) for g in begun], int), np.array([_steps(g) for g in begun], int), own, cut + [int(t) for t in through]


def carried(shards: list[list[int]]) -> list[tuple[tuple[int, int, int], tuple[int, int, int]]]:
    """For each shard of a series, of the ``edges`` of all in order, what lies beyond its left and its right border."""

    def along(order: list[int], here: int, there: int) -> dict[int, tuple[int, int, int]]:
        out, before = {}, None
        for k in order:
            out[k] = NOTHING
            if before is not None and shards[k][here] and shards[before][there]:
                e, (size, run, most) = shards[before], out[before]
                # the run goes on only if the border cuts it on this side too
                r = e[there + 2] + (run if e[9] else 0) if shards[k][here + 2] else 0
                out[k] = (e[there + 1] + (size if e[8] else 0), r, max(e[there + 3], r, most if e[8] else 0))
            before = k
        return out

    left, right = along(list(range(len(shards))), 0, 4), along(list(range(len(shards)))[::-1], 4, 0)
    return [(left[k], right[k]) for k in range(len(shards))]


def mark_still(x: np.ndarray, step: float, need: float, first: int = 0, last: int | None = None, left: tuple[int, int, int] = NOTHING, right: tuple[int, int, int] = NOTHING) -> np.ndarray:
    """Marks the stretches of at least ``need`` readings, with those beyond the borders of the shard ``first`` to ``last``."""
    out = np.zeros(len(x), bool)
    if not len(x):
        return out
    last = len(x) - 1 if last is None else last
    tol = _tolerance(x, step)
    for g in _groups(x, step)[0]:

        def whole(runs: list[list[int]], i: int) -> int:
            l, r = runs[0][0] < first <= runs[-1][1], runs[0][0] <= last < runs[-1][1]
            return max(_readings(runs), _readings(runs, first, last) + l * left[i] + r * right[i])

        beyond = max((g[0][0] < first <= g[-1][1]) * left[2], (g[0][0] <= last < g[-1][1]) * right[2])
        if whole(g, 0) >= need and max(beyond, *(whole([r], 1) for r in g)) >= 0.6 * need:
            for a, b in g:
                out[a : b + 1] = True
            lo, hi = g[0][0], g[-1][1]
            held = np.median(x[lo : hi + 1])
            out[lo : hi + 1] |= np.abs(x[lo : hi + 1] - held) <= 2 * tol
    return out


def _too_long(p: float, n: int, alpha: float, least: int) -> float:
    p = min(max(p, 0.02), 0.97)
    return max(least, np.log(n / alpha) / -np.log(p) + 1)


def _design(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    w = 2 * np.pi * (t[2:] % DAY_MS) / DAY_MS
    return np.column_stack([np.ones(len(x) - 2), x[1:-1], x[:-2], np.sin(w), np.cos(w), np.sin(2 * w), np.cos(2 * w)])


def fit_ar(x: np.ndarray, t: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """Robust AR(2) with a daily cycle: coefficients, innovations (0 for the first two), scale.

    Iteratively reweighted least squares with Tukey's weights; the scale is 1.4826 times the
    median absolute innovation.
    """
    a, y = _design(x, t), x[2:]
    step = np.median(np.abs(np.diff(x))) + 1e-12
    med = _median5(x)
    ok = np.abs(x - med) <= 8 * max(step, np.median(np.abs(x - med)) * 1.4826)
    w = (ok[2:] & ok[1:-1] & ok[:-2] & joined(t)).astype(float)
    if w.sum() < 3 * a.shape[1]:
        w[:] = 1.0
    ridge = 1e-9 * np.eye(a.shape[1]) * max(1.0, float((a[:, 1] ** 2 * w).sum()))
    ridge[0, 0] = 0.0
    scale, e = 0.0, y
    base = w
    for _ in range(rounds):
        aw = a * w[:, None]
        try:
            beta = np.linalg.solve(aw.T @ a + ridge, aw.T @ y)
        except np.linalg.LinAlgError:
            beta = np.linalg.lstsq(aw, y * w, rcond=None)[0]
        e = y - a @ beta
        use = np.abs(e[base > 0]) if (base > 0).any() else np.abs(e)
        scale = max(1.4826 * float(np.median(use)), 1e-12)
        u = e / (5.0 * scale)
        w = base * np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0.0)
        if w.sum() < 3 * a.shape[1]:
            break
    return beta, np.r_[0.0, 0.0, e], scale


def reach(t: np.ndarray) -> float:
    """How many ms apart neighbouring readings may be before the course may have changed unseen."""
    return max(6 * float(np.median(np.diff(t))), 7_200_000.0)


def joined(t: np.ndarray) -> np.ndarray:
    """For each reading from the third on, whether no gap parts it from the two before it."""
    ok = np.diff(t) <= reach(t)
    return ok[1:] & ok[:-1]


def _median5(x: np.ndarray) -> np.ndarray:
    """Running median of seven readings."""
    if len(x) < 7:
        return np.full(len(x), np.median(x))
    pad = np.r_[[x[0]] * 3, x, [x[-1]] * 3]
    return np.median(np.lib.stride_tricks.sliding_window_view(pad, 7), axis=1)


def spikes(x: np.ndarray, t: np.ndarray, limit: float = 6.0, apart: float = 5.0, lengths: tuple[int, ...] = (1, 2, 3, 4, 6, 8), rounds: int = 12) -> np.ndarray:
    """Marks brief excursions: additive outliers of about as many readings as ``lengths`` lists.

    On the innovations of :func:`fit_ar`, each round tests for every reading an additive patch of
    each length against a lasting shift of level (Chen and Liu's iterative procedure), takes the
    strongest in each neighbourhood, removes its effect and tests again.  Shifts are removed but
    not marked.
    """
    n = len(x)
    out = np.zeros(n, bool)
    if n < 24:
        return _short(x, limit)
    # values beyond any plausible scale would swamp the fit: clip them around the running median
    med = _median5(x)
    spread = max(1.4826 * float(np.median(np.abs(x - med))), float(np.median(np.abs(np.diff(x)))), 1e-9)
    y = np.clip(x, med - 60 * spread, med + 60 * spread)
    beta, e, scale = fit_ar(y, t)
    grain = _grain(x)
    scale = max(scale, 0.5 * grain, 1e-9)
    phi = beta[1:3]
    boxes = []
    longest = lengths[-1]
    horizon = 3 * longest
    impulse = np.array([1.0, -phi[0], -phi[1]])
    for k in lengths:
        boxes.append(np.convolve(np.ones(k), impulse))
    shift = np.convolve(np.ones(horizon), impulse)[:horizon]
    e = np.r_[e, np.zeros(horizon)]
    for _ in range(rounds):
        stats, size = [], []
        for g in boxes:
            s = np.correlate(e, g, "valid")[:n] / (g @ g)
            stats.append(np.abs(s) * np.sqrt(g @ g) / scale)
            size.append(s)
        s = np.correlate(e, shift, "valid")[:n] / (shift @ shift)
        ls = np.abs(s) * np.sqrt(shift @ shift) / scale
        ls[max(0, n - longest - 2) :] = 0  # too near the end to be told from a patch
        m = np.vstack(stats)
        best = m.argmax(0)
        top = np.maximum(m.max(0), ls)
        cand = np.flatnonzero(top >= limit)
        if not len(cand):
            break
        taken = np.zeros(n + horizon, bool)
        for i in cand[np.argsort(-top[cand])]:
            lo, hi = max(0, i - longest - 2), min(n, i + horizon)
            if taken[lo:hi].any():
                continue
            taken[lo:hi] = True
            if ls[i] > m[best[i], i]:
                e[i : i + horizon] -= s[i] * shift
                # beyond the horizon the shifted level follows the same recursion: nothing is left
            else:
                g = boxes[best[i]]
                e[i : i + len(g)] -= size[best[i]][i] * g
                out[i : i + lengths[best[i]]] = True
    return _confirm(x, t, out, apart * max(scale, spread), longest)


def _grain(x: np.ndarray) -> float:
    """The resolution: the smallest common difference of neighbouring readings."""
    d = np.abs(np.diff(x))
    d = d[d > 1e-9]
    return float(np.quantile(d, 0.02)) if len(d) else 0.0


def _short(x: np.ndarray, limit: float) -> np.ndarray:
    """Series too short for a fit: distance from the median, in robust scale of values and steps."""
    if len(x) < 5:
        return np.zeros(len(x), bool)
    r = np.abs(x - np.median(x))
    scale = max(1.4826 * np.median(r), np.median(np.abs(np.diff(x))), 1e-9)
    return r > (limit + 2) * scale


def _confirm(x: np.ndarray, t: np.ndarray, out: np.ndarray, slack: float, longest: int) -> np.ndarray:
    """Keeps marked readings that lie far off the level on either side of them.

    The level before and after is the median of up to three unmarked readings near in time; across
    a gap the course may have changed, so there only the other side counts.  Runs of marks at more than
    ``longest`` times are no brief excursions, unless the level after them is that before (then twice as many);
    readings at one time count once.
    """
    near, res = reach(t), out.copy()
    for _ in range(8):
        good, marked = np.flatnonzero(~res), np.flatnonzero(res)
        if not len(marked) or len(good) < 5:
            return np.zeros(len(x), bool)
        pos = np.searchsorted(good, marked)

        def level(offsets: list[int]) -> np.ndarray:
            v = np.full((len(offsets), len(marked)), np.nan)
            for r, o in enumerate(offsets):
                j = pos + o
                k = good[np.clip(j, 0, len(good) - 1)]
                ok = (j >= 0) & (j < len(good)) & (np.abs(t[k] - t[marked]) <= near)
                v[r] = np.where(ok, x[k], np.nan)
            return _nanmedian3(v)

        before, after = level([-1, -2, -3]), level([0, 1, 2])
        lo, hi = np.fmin(before, after), np.fmax(before, after)
        far = (x[marked] < lo - slack) | (x[marked] > hi + slack)
        if far.all():
            break
        res[marked[~far]] = False  # and serves as a level in the next round
    edge = np.flatnonzero(np.diff(np.r_[0, res.astype(np.int8), 0]))
    good = np.flatnonzero(~res)
    for a, b in zip(edge[::2], edge[1::2]):
        times = len(np.unique(t[a:b]))
        if times <= longest:
            continue
        at = np.searchsorted(good, a)
        left, right = good[max(0, at - 3) : at], good[at : at + 3]
        returns = len(left) and len(right) and t[right[0]] - t[left[-1]] <= near + (t[b - 1] - t[a]) and abs(np.median(x[left]) - np.median(x[right])) <= slack
        if times > 2 * longest or not returns:
            res[a:b] = False
    return res


def _nanmedian3(v: np.ndarray) -> np.ndarray:
    """Column medians of up to three values; NaN where there are none."""
    s = np.sort(v, axis=0)  # NaN last
    n = (~np.isnan(s)).sum(0)
    two = (s[0] + s[1]) / 2
    return np.where(n == 3, s[1], np.where(n == 2, two, s[0]))


def find_faults(x: np.ndarray, t: np.ndarray, lo: float, hi: float, limit: float = 6.0, still: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The fault of each reading of one series in time order: NONE, SPIKE, STUCK or LIMIT.

    ``lo`` and ``hi`` are the values the quantity can take.  ``still`` marks the held stretches of possible readings, also given
    their places, where more is known of the series than ``x``; else :func:`still_runs` does.
    """
    out = np.zeros(len(x), np.int8)
    bad = ~((x >= lo) & (x <= hi))
    out[bad] = LIMIT
    keep = np.flatnonzero(~bad)
    if len(keep) < 5:
        return out
    y, s = x[keep], t[keep]
    stuck = still(y, keep) if still else still_runs(y)
    # a correction of a held reading stands at its time
    same = np.diff(s) == 0
    stuck[1:] |= same & stuck[:-1]
    stuck[:-1] |= same & stuck[1:]
    out[keep[stuck]] = STUCK
    rest = np.flatnonzero(~stuck)
    if len(rest) < 5:
        return out
    sp = spikes(y[rest], s[rest], limit)
    hit = keep[rest[sp]]
    out[hit[out[hit] == NONE]] = SPIKE
    return out
