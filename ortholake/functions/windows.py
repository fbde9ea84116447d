"""Statistics along a clock, a piece of an ordered group at a time: exponentially decaying, and over a sliding window."""

from __future__ import annotations

import math

import numpy as np

#: Half-lives beyond which weights are taken anew, far inside the range of doubles even squared.
BLOCK_HALF_LIVES = 300.0


def clamped(moment: np.ndarray) -> np.ndarray:
    """A moment that rounding has put just below zero is zero."""
    return np.where((moment < 0) & (moment > -1e-12), 0.0, moment)


def correlation(cross: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """NaN where a side doesn't move; a hair beyond one is one."""
    xx, yy = clamped(xx), clamped(yy)
    moves = (xx > 0) & (yy > 0)
    found = np.where(moves, cross / np.sqrt(np.where(moves, xx * yy, 1)), np.nan)
    return np.where((np.abs(found) > 1) & (np.abs(found) <= 1 + 1e-9), np.sign(found), found)


class Ewm:
    """Decaying sums of weights, values and products; what has been added halves in every half-life."""

    def __init__(self, half_life: float, min_samples: int, bias: bool):
        self.half_life, self.min_samples, self.bias = half_life, min_samples, bias
        self.last = None
        self.count = 0
        # weights, squared weights, plain sum, and about the origins: x, y, xx, yy, xy
        self.held = np.zeros(8)
        self.origin = np.zeros(2)

    def step(self, clock: np.ndarray, x: np.ndarray, y: np.ndarray | None, statistic: str) -> np.ndarray:
        here = ~np.isnan(x) if y is None else ~np.isnan(x) & ~np.isnan(y)
        x = np.where(here, x, 0.0)
        y = x if y is None else np.where(here, y, 0.0)
        out = np.empty(len(clock))
        counts = self.count + np.cumsum(here)
        a = 0
        while a < len(clock):
            start = clock[a] if self.last is None else self.last
            away = (clock[a:] - start) / self.half_life
            b = a + int(np.searchsorted(away, BLOCK_HALF_LIVES, side="right"))
            if b == a:  # further from what is held than a block: decay it first
                fade = 0.5 ** min(float(away[0]), 2000.0)
                self.held *= np.array([fade, fade * fade, *[fade] * 6])
                self.last = clock[a]
                continue
            own = slice(a, b)
            self._centre(x[own], y[own], here[own])
            grow = np.exp2(away[: b - a])
            w = grow * here[own]
            dx, dy = (x[own] - self.origin[0]) * here[own], (y[own] - self.origin[1]) * here[own]
            parts = np.stack([w, w * grow, w * x[own], w * dx, w * dy, w * dx * dx, w * dy * dy, w * dx * dy])
            sums = self.held[:, None] + np.cumsum(parts, axis=1)
            sums /= grow
            sums[1] /= grow
            out[own] = self._statistic(sums, counts[own], statistic)
            self.held, self.last = sums[:, -1].copy(), clock[b - 1]
            a = b
        self.count = int(counts[-1]) if len(counts) else self.count
        return np.where(counts < self.min_samples, np.nan, out)

    def summary(self) -> tuple:
        return self.last, self.count, self.held, self.origin

    def absorb(self, later: tuple) -> None:
        """Go on with what the rows after these add up to."""
        last, count, held, origin = later
        if last is None:
            return
        if self.last is not None:
            fade = 0.5 ** min(float(last - self.last) / self.half_life, 2000.0)
            w, w2, total, ax, ay, xx, yy, xy = self.held * np.array([fade, fade * fade, *[fade] * 6])
            gx, gy = (self.origin - origin) if held[0] > 0 else np.zeros(2)
            origin = origin if held[0] > 0 else self.origin
            moved = np.array([w, w2, total, ax + w * gx, ay + w * gy, xx + 2 * ax * gx + w * gx * gx, yy + 2 * ay * gy + w * gy * gy, xy + ax * gy + ay * gx + w * gx * gy])
            held = held + moved
        self.last, self.count, self.held, self.origin = last, self.count + count, np.array(held), np.array(origin)

    def _centre(self, x: np.ndarray, y: np.ndarray, here: np.ndarray) -> None:
        """Move the origins to the means held, or to the first values of all."""
        w, _, _, ax, ay, *_ = self.held
        if w > 0:
            gap = np.array([ax / w, ay / w])
            self.held[5:] -= np.array([ax * ax, ay * ay, ax * ay]) / w
            self.held[3:5] = 0
            self.origin = self.origin + gap
        elif here.any():
            first = int(here.argmax())
            self.origin = np.array([x[first], y[first]])

    def _statistic(self, sums: np.ndarray, counts: np.ndarray, statistic: str) -> np.ndarray:
        w, w2, total, ax, ay, xx, yy, xy = sums
        if statistic == "sum":
            return total
        some = np.where(w > 0, w, 1.0)
        if statistic == "mean":
            return np.where(w > 0, self.origin[0] + ax / some, np.nan)
        xx, yy, xy = xx - ax * ax / some, yy - ay * ay / some, xy - ax * ay / some
        if statistic == "correlation":
            return np.where(w > 0, correlation(xy, xx, yy), np.nan)
        divisor = w if self.bias else np.where(counts > 1, w - w2 / some, 0.0)
        good = (divisor > 0) & np.isfinite(divisor)
        return np.where(good, (clamped(xx) if statistic == "variance" else xy) / np.where(good, divisor, 1), np.nan)


class Rolling:
    """Rows up to the present one, in order, whose clock is less than ``window`` behind it."""

    def __init__(self, window: float, min_samples: int, min_clock_span: float, ddof: int):
        self.window, self.min_samples, self.min_span, self.ddof = window, max(min_samples, 1), min_clock_span, ddof
        self.held: tuple[np.ndarray, ...] | None = None
        self.cut = False  # whether rows have left the window

    def _left(self, clock: np.ndarray, now: np.ndarray) -> np.ndarray:
        if clock.dtype.kind == "i":  # whole distances, exactly
            return np.searchsorted(clock, now - (math.ceil(self.window) - 1), side="left")
        left = np.searchsorted(clock, now - self.window, side="right")
        while (late := (now - clock[left] >= self.window)).any():
            left = left + late
        while (more := (left > 0) & (now - clock[np.maximum(left - 1, 0)] < self.window)).any():
            left = left - more
        return left

    def step(self, clock: np.ndarray, x: np.ndarray, y: np.ndarray | None, statistic: str) -> np.ndarray:
        y = x if y is None else y
        new = (clock, x, y)
        before = 0 if self.held is None else len(self.held[0])
        clock, x, y = new if self.held is None else (np.concatenate(p) for p in zip(self.held, new, strict=True))
        n, rows = len(clock), np.arange(before, len(clock))
        left = self._left(clock, clock[before:])
        here = ~np.isnan(x) & ~np.isnan(y)
        valid = np.flatnonzero(here)
        if not len(valid):
            out = np.full(len(rows), np.nan)
        else:
            # sums in extended precision about a value of the data, so that differences keep their digits
            dx = np.where(here, x - x[valid[0]], 0).astype(np.longdouble)
            dy = np.where(here, y - y[valid[0]], 0).astype(np.longdouble)

            def within(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
                return sums[rows + 1] - sums[left]

            count = within(here.astype(np.int64))
            some = np.maximum(count, 1)
            sx = within(dx)
            first = np.append(valid, n)[np.searchsorted(valid, left)]
            oldest = np.minimum(first, rows)
            if statistic == "sum":
                out = (sx + count * np.longdouble(x[valid[0]])).astype(float)
            elif statistic == "mean":
                out = (sx / some + x[valid[0]]).astype(float)
            else:
                sy = within(dy)

                def moment(a: np.ndarray, sa: np.ndarray, b: np.ndarray, sb: np.ndarray) -> np.ndarray:
                    return (within(a * b) - sa * sb / some).astype(float)

                still_x, still_y = (self._still(v, here, valid, oldest, rows) for v in (x, y))
                xx = np.where(still_x, 0.0, clamped(moment(dx, sx, dx, sx)))
                if statistic == "variance":
                    top = xx
                else:
                    top = np.where(still_x | still_y, 0.0, moment(dx, sx, dy, sy))
                if statistic == "correlation":
                    out = correlation(top, xx, np.where(still_y, 0.0, clamped(moment(dy, sy, dy, sy))))
                else:
                    out = np.where(count > self.ddof, top / np.maximum(count - self.ddof, 1), np.nan)
            span = clock[rows] - clock[oldest]
            out = np.where((count < self.min_samples) | (span < self.min_span), np.nan, out)
        keep = int(left[-1]) if len(rows) else 0
        self.cut |= keep > 0
        self.held = clock[keep:], x[keep:], y[keep:]
        return out

    def summary(self) -> tuple:
        return self.held, self.cut

    def absorb(self, later: tuple) -> None:
        """Go on with the rows that those after these have left in their window."""
        held, cut = later
        if held is None:
            return
        if self.held is not None and not cut:
            held = tuple(np.concatenate(p) for p in zip(self.held, held, strict=True))
            keep = int(self._left(held[0], held[0][-1:])[0])
            held, cut = tuple(h[keep:] for h in held), self.cut or keep > 0
        self.held, self.cut = held, cut

    @staticmethod
    def _still(v: np.ndarray, here: np.ndarray, valid: np.ndarray, oldest: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether all values of a window are one value."""
        moved = np.concatenate([[True], np.diff(v[valid]) != 0])
        run = np.maximum.accumulate(np.where(moved, np.arange(len(valid)), 0))
        latest = np.searchsorted(valid, rows, side="right") - 1
        return valid[run[np.maximum(latest, 0)]] <= oldest
