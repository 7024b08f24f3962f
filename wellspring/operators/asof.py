"""As-of neighbour counts, nearest distances and value statistics (JN-05 .. JN-09) that hold in dense places.

The globe is cut into tiles as high as the reach and at least as wide; a target's tile meets the sources of the tiles around it in
one group, and numpy compares them there, so pairs are never rows of a table. A tile's targets are dealt into chunks of bounded size.

Where the tiles around hold more than `dense` sources, counts are taken otherwise, radius by radius. Tiles are halved again and again; of
the tiles around a target's tile, those wholly within the radius of all its points send a time table only (instant, count), which is summed up
for the tile and looked up by bisection, and those on the border send their sources. A tile is halved until its border holds no more
than `dense` sources. The nearest distance is searched within the largest radius first, or in small tiles, and in larger ones for targets without a hit only.

A tile's reach is bounded by distances of centres and corners: |km(centres)| minus or plus both tiles' radii.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import degrees, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EARTH_KM, haversine_km
from ..sources.scratch import materialize
from .counting import RangeCounts

FOUND = "id long, radius int, n long, value_n long, median double, p90 double, nearest double"
MOST_LEVELS = 8


class Tiles:
    """Tiles of `size_km` or more in both directions, numbered by band and column."""

    def __init__(self, size_km: float) -> None:
        self.step = degrees(size_km / EARTH_KM) * (1 + 1e-9)

    def band(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.step).cast("long")

    def columns(self, band: Column) -> Column:
        far = F.least(F.greatest(F.abs(band * self.step - 90), F.abs((band + 1) * self.step - 90)), F.lit(90.0))
        return F.greatest(F.floor(F.cos(F.radians(far)) * 360 / self.step), F.lit(1)).cast("long")

    def column(self, lon: Column, columns: Column) -> Column:
        return F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) * columns / 360), columns).cast("long")

    def placed(self, df: DataFrame) -> DataFrame:
        """With band and column."""
        return df.withColumn("band", self.band(F.col("lat"))).withColumn("__n", self.columns(F.col("band"))).withColumn("column", self.column(F.col("lon"), F.col("__n"))).drop("__n")

    def around(self, tiles: DataFrame, km: float, tell: bool = False) -> DataFrame:
        """tiles (band, column) -> band, column, b2, c2 for all tiles that may hold a point within km of one of theirs; with `tell`
        without those that distances rule out, and with `whole`: all their points are within km. Else whole is false. south, north, west, span
        (degrees; longitudes from -180 on) bound what may be within km of the first tile."""
        reach, bands = km / EARTH_KM, int(degrees(km / EARTH_KM) / self.step) + 1
        low, high = (lambda b: F.greatest(b * self.step - 90, F.lit(-90.0))), (lambda b: F.least((b + 1) * self.step - 90, F.lit(90.0)))
        own = tiles.withColumn("n1", self.columns(F.col("band"))).withColumns({"w": F.col("column") * 360 / F.col("n1"), "far": F.greatest(F.abs(low(F.col("band"))), F.abs(high(F.col("band"))))})
        # beyond the poles' circle all columns count
        wide = F.when(F.radians("far") + reach < pi / 2 - 1e-9, F.degrees(F.asin(F.least(F.lit(sin(reach)) / F.cos(F.radians("far")), F.lit(1.0)))) + 1e-9).otherwise(180.0)
        spread = own.withColumn("wide", wide).withColumn("b2", F.explode(F.sequence(F.col("band") - bands, F.col("band") + bands))).where(F.col("b2").between(0, int(180 / self.step))).withColumn("n2", self.columns(F.col("b2")))
        first, last = F.floor((F.col("w") - F.col("wide")) * F.col("n2") / 360), F.floor((F.col("w") + 360 / F.col("n1") + F.col("wide")) * F.col("n2") / 360)
        spread = spread.withColumns({"first": first.cast("long"), "last": last.cast("long")})
        rim = degrees(reach) + 1e-9
        spread = spread.withColumns({"south": low(F.col("band")) - rim, "north": high(F.col("band")) + rim, "west": F.col("w") - F.col("wide"), "span": 360 / F.col("n1") + 2 * F.col("wide")})
        bounds = ("south", "north", "west", "span")
        every = F.when(F.col("last") - F.col("first") + 1 >= F.col("n2"), F.sequence(F.lit(0), F.col("n2") - 1)).otherwise(F.transform(F.sequence("first", "last"), lambda x: F.pmod(x, F.col("n2"))))
        spread = spread.withColumn("c2", F.explode(every))
        if not tell:
            return spread.select("band", "column", "b2", "c2", F.lit(False).alias("whole"), *bounds)
        mid = lambda b: (low(b) + high(b)) / 2
        lon = lambda c, n: (c + 0.5) * 360 / n - 180

        def radius(b: Column, c: Column, n: Column) -> Column:
            corners = [haversine_km(mid(b), lon(c, n), lat, c * 360 / n - 180) for lat in (low(b), high(b))]
            return F.when(n >= 8, F.greatest(*corners)).otherwise(pi * EARTH_KM)

        one, two = (F.col("band"), F.col("column"), F.col("n1")), (F.col("b2"), F.col("c2"), F.col("n2"))
        spread = spread.withColumns({"apart": haversine_km(mid(one[0]), lon(*one[1:]), mid(two[0]), lon(*two[1:])), "rims": radius(*one) + radius(*two)})
        kept = spread.where(F.col("apart") - F.col("rims") <= km * (1 + 1e-9)).withColumn("whole", F.col("apart") + F.col("rims") <= km * (1 - 1e-9))
        return kept.select("band", "column", "b2", "c2", "whole", *bounds)


def _km(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(np.sqrt(h), 1.0))


class Rows:
    """Sources in rows of a plane that touches the globe amid the targets, each row cut along u into cells of few sources, or ordered by u where cells
    would be crowded. Distances (chords of the unit sphere) shrink in the plane, and by no more than `stretch`; so a disc of the plane holds all that are near, and a smaller one only such."""

    CROWD = 32  # sources in a source's cell, on average
    PAD, MOST, AT_ONCE = 1e-9, 1 << 22, 1 << 18  # 6 mm, beyond what rounding moves; pairs held; pairs compared at a time, so few that they stay in a cache

    def __init__(self, targets: np.ndarray, sources: np.ndarray, at: np.ndarray, height: float) -> None:
        mid = targets.sum(axis=0)
        mid = mid / np.linalg.norm(mid) if np.linalg.norm(mid) > 1e-3 * len(targets) else targets[0]
        east = np.cross([0.0, 0.0, 1.0] if abs(mid[2]) < 0.9 else [1.0, 0.0, 0.0], mid)
        axes = np.stack([east / np.linalg.norm(east), np.cross(mid, east / np.linalg.norm(east)), mid])
        place = sources @ axes.T
        self.place = targets @ axes.T
        self.v0 = place[:, 1].min(initial=1.0)
        self.height = max(height, (place[:, 1].max(initial=-1.0) - self.v0) / 4096, 1e-9)
        row = np.floor((place[:, 1] - self.v0) / self.height).astype(np.int64)
        self.last = int(row.max(initial=-1))
        self.cells = max(1, -(-len(row) // (2 * max(1, self.last + 1))))
        self.u0 = place[:, 0].min(initial=1.0)
        self.du = max((place[:, 0].max(initial=-1.0) - self.u0) / self.cells, 1e-12)
        cell = row * self.cells + self.cell(place[:, 0]).clip(0, self.cells - 1)
        held = np.bincount(cell, minlength=max(1, self.last + 1) * self.cells)
        self.even = (held * held).sum() <= self.CROWD * len(row)  # else the ends are sought among ordered sources
        key = cell if self.even else row * 4.0 + 1 + place[:, 0]
        self.order = np.argsort(key)
        self.key, self.starts, self.at = key[self.order], np.concatenate([[0], np.cumsum(held)]), at[self.order]
        self.axes = [(np.ascontiguousarray(targets[:, k]), sources[self.order, k]) for k in range(3)]
        depth = min(place[:, 2].min(initial=1.0), self.place[:, 2].min(initial=1.0))
        self.stretch = 1 / depth if depth > 0.5 else np.inf  # sqrt(1 + slope^2) of the sphere at its farthest place

    def cell(self, u: np.ndarray) -> np.ndarray:
        """Never falls where u rises, so a source beyond u lies in its cell or beyond, and one beyond its cell lies beyond u."""
        return np.floor((u - self.u0) / self.du).clip(-1, self.cells).astype(np.int64)

    def ranges(self, own: np.ndarray, chord: float) -> tuple[np.ndarray, ...]:
        """For rows x targets: places [a, b) that may be within the chord, and [ia, ib) among them that surely are. Targets ordered by u seek
        one cell after another."""
        u, v = self.place[own, 0][None], self.place[own, 1][None]
        first = np.floor((v - chord - self.PAD - self.v0) / self.height).clip(0, self.last + 1)
        width = int((np.floor((v + chord + self.PAD - self.v0) / self.height).clip(-1, self.last) - first).max(initial=-1)) + 1
        row = first + np.arange(width)[:, None]
        low = self.v0 + row * self.height
        near = np.maximum(0, np.maximum(low - v, v - low - self.height) - self.PAD)
        far = np.maximum(np.abs(v - low), np.abs(v - low - self.height)) + self.PAD
        half = np.sqrt(np.maximum(chord**2 - near**2, 0)) + self.PAD
        inner = np.sqrt(np.maximum((chord / self.stretch) ** 2 - far**2, 0)) - self.PAD
        some = near <= chord
        if self.even:
            base, last = np.clip(row, 0, max(0, self.last)).astype(np.int64) * self.cells, self.cells - 1
            seek = lambda x, low, more: self.starts[base + self.cell(x).clip(low, last) + more]
            a, b = seek(u - half, 0, 0), seek(u + half, -1, 1)
            ia, ib = seek(u - inner, -1, 1), seek(u + inner, 0, 0)
        else:
            seek = lambda x, side: np.searchsorted(self.key, row * 4 + (x + 1).clip(-0.5, 2.5), side)
            a, b = seek(u - half, "left"), seek(u + half, "right")
            ia, ib = seek(u - inner, "left"), seek(u + inner, "right")
        b = np.where(some & (row <= self.last), np.maximum(a, b), a)
        some = (inner > 0) & (b > a)
        ia = np.where(some, ia.clip(a, b), b)
        return a, ia, np.where(some, np.maximum(ia, ib.clip(a, b)), b), b

    def strips(self, size: int) -> Iterator[np.ndarray]:
        """The targets, neighbours together: `size` of them along v, ordered by u."""
        order = np.argsort(self.place[:, 1])
        for begin in range(0, len(order), size):
            own = order[begin : begin + size]
            yield own[np.argsort(self.place[own, 0])]

    def pairs(self, own: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in own, source, squared chord) of all pairs in rows x targets, a bounded number at a time."""
        sizes = (end - first).ravel()
        some = np.flatnonzero(sizes)
        owner, starts, sizes = some % max(1, len(own)), first.ravel()[some], sizes[some]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        cuts = np.unique([0, *np.searchsorted(upto, np.arange(self.AT_ONCE, total, self.AT_ONCE), "right"), len(sizes)]) if total else []
        here = [(t[own], s) for t, s in self.axes]
        for begin, stop in zip(cuts[:-1], cuts[1:], strict=True):
            n = sizes[begin:stop]
            index = np.repeat(starts[begin:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            who = np.repeat(owner[begin:stop], n)
            gap = np.zeros(len(who))
            for t, s in here:
                apart = t[who]
                apart -= s[index]
                apart *= apart
                gap += apart
            yield who, index, gap


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def _chord(km: float) -> float:
    return 2 * sin(min(km / EARTH_KM, pi) / 2)


def _inside(t: tuple, s: tuple, rows: Rows, who: np.ndarray, index: np.ndarray, gap: np.ndarray, radius: float, as_of: bool) -> np.ndarray:
    """Whether the pairs (target, place in rows) of squared chords `gap` are within the radius, the source before the target."""
    chord = _chord(radius)
    slack = chord**2 * 1e-9 + chord * 1e-14
    good = gap <= chord**2 + slack
    close = np.flatnonzero(good & (gap >= chord**2 - slack))
    i, j = who[close], rows.order[index[close]]
    good[close] = _km(t[0][i], t[1][i], s[0][j], s[1][j]) <= radius
    return good & (rows.at[index] < t[2][who]) if as_of else good


def _count_within(t: tuple, s: tuple, radius: float, as_of: bool) -> np.ndarray:
    """For each target (lat, lon, at) the number of sources (lat, lon, at) within the radius, and before it. Whole stretches of rows
    are counted by ranks of their instants, and only sources near the circle are compared."""
    (t_lat, t_lon, t_at), (s_lat, s_lon, s_at), chord = t, s, _chord(radius)
    n = np.zeros(len(t_lat), np.int64)
    if not len(s_lat) or not len(t_lat):
        return n
    targets, sources = _unit(t_lat, t_lon), _unit(s_lat, s_lon)
    box = np.maximum(np.ptp(sources, axis=0), chord)
    crowd = len(s_lat) * chord**2 / np.sort(box)[1:].prod()  # sources in a square of the chord, about
    rows = Rows(targets, sources, s_at, 2 * chord / min(max(4.0, (0.6 * crowd) ** 0.5), 256.0))
    counts = RangeCounts(rows.at) if as_of else None
    sliced = max(1, (1 << 17) // (int(2 * chord / rows.height) + 3))
    for own in rows.strips(sliced):
        a, ia, ib, b = rows.ranges(own, chord)
        if as_of:
            whole = np.flatnonzero(ib > ia)
            who = whole % len(own)
            below = counts.below(ia.ravel()[whole], ib.ravel()[whole], counts.rank(t_at[own])[who])
            n[own] += np.bincount(who, below, len(own)).astype(np.int64)  # exact: far below 2^53
        else:
            n[own] += (ib - ia).sum(axis=0)
        for first, end in ((a, ia), (ib, b)):
            for who, index, gap in rows.pairs(own, first, end):
                good = _inside(t, s, rows, own[who], index, gap, radius, as_of)
                n[own] += np.bincount(who[good], minlength=len(own))
    return n


def _nearest_within(t: tuple, s: tuple, cap_km: float, as_of: bool, self_gap: float | None) -> np.ndarray:
    """For each target the distance of its nearest source within the cap (before it, beyond the gap), else infinity; in widening discs for those left."""
    (t_lat, t_lon, t_at), (s_lat, s_lon, s_at) = t, s
    best, left = np.full(len(t_lat), np.inf), np.arange(len(t_lat))
    targets, sources = _unit(t_lat, t_lon), _unit(s_lat, s_lon)
    box = np.sort(np.maximum(np.ptp(sources, axis=0), 1e-6))[1:].prod() if len(s_lat) else 1.0
    radius = min(cap_km, max(1e-3, EARTH_KM * (4 * box / max(1, len(s_lat))) ** 0.5))
    edge = _chord(self_gap) if self_gap is not None else 0.0
    while len(left) and len(s_lat):
        kept = np.flatnonzero(s_at < t_at[left].max()) if as_of else np.arange(len(s_lat))
        if not len(kept):
            break
        chord = _chord(radius)
        rows = Rows(targets[left], sources[kept], s_at[kept], chord / 2)
        for own in rows.strips(1 << 15):
            a, _, _, b = rows.ranges(own, chord)
            for who, index, gap in rows.pairs(own, a, b):
                if as_of:
                    good = rows.at[index] < t_at[left[own[who]]]
                    who, index, gap = who[good], index[good], gap[good]
                if self_gap is not None:
                    good = np.ones(len(who), bool)
                    close = np.flatnonzero(gap <= (edge * 1.001 + 1e-15) ** 2)
                    i, j = left[own[who[close]]], kept[rows.order[index[close]]]
                    good[close] = _km(t_lat[i], t_lon[i], s_lat[j], s_lon[j]) > self_gap
                    who, index, gap = who[good], index[good], gap[good]
                if len(who):
                    starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                    least = np.repeat(np.minimum.reduceat(gap, starts), np.diff(np.concatenate([starts, [len(who)]])))
                    first = gap <= least * (1 + 1e-9) + np.sqrt(least) * 1e-14 + 1e-30
                    i, j = left[own[who[first]]], kept[rows.order[index[first]]]
                    np.minimum.at(best, i, _km(t_lat[i], t_lon[i], s_lat[j], s_lon[j]))
        if radius >= cap_km:
            break
        left = left[best[left] > radius]
        radius = min(2 * radius, cap_km)
    return np.where(best <= cap_km, best, np.inf)


def _counts(t: tuple, s: tuple, radius: float, as_of: bool, self_gap: float | None) -> np.ndarray:
    """As `_count_within`, without sources within the gap."""
    n = _count_within(t, s, radius, as_of)
    return n if self_gap is None else n - (n if self_gap >= radius else _count_within(t, s, self_gap, as_of))


def _listed(t: tuple, s: tuple, radius: float, as_of: bool, self_gap: float | None, who: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each (target, rank from 0) the place of that source among the few sources, of those within the radius, in the sources' order."""
    some, back = np.unique(who, return_inverse=True)
    t = tuple(c[some] for c in t)
    chord, place = _chord(radius), np.empty(len(who), np.int64)
    rows = Rows(_unit(*t[:2]), _unit(*s[:2]), s[2], chord / 2)
    by_target = np.argsort(back, kind="stable")
    first = np.searchsorted(back[by_target], np.arange(len(some) + 1))
    sliced = max(1, Rows.MOST // max(1, len(s[0])))
    for begin in range(0, len(some), sliced):
        own = np.arange(begin, min(begin + sliced, len(some)))
        a, _, _, b = rows.ranges(own, chord)
        found = [np.zeros(0, np.int64)]
        for i, index, gap in rows.pairs(own, a, b):
            good = _inside(t, s, rows, own[i], index, gap, radius, as_of)
            i, j = own[i[good]], rows.order[index[good]]
            if self_gap is not None:
                apart = _km(t[0][i], t[1][i], s[0][j], s[1][j]) > self_gap
                i, j = i[apart], j[apart]
            found.append(i * len(s[0]) + j)
        pairs = np.sort(np.concatenate(found))
        asked = by_target[first[begin] : first[own[-1] + 1]]
        place[asked] = pairs[np.searchsorted(pairs, back[asked] * len(s[0])) + rank[asked]] % len(s[0])
    return place


def _ordered_within(t: tuple, s: tuple, values: np.ndarray, radius: float, as_of: bool, self_gap: float | None, who: np.ndarray, rank: np.ndarray, few: int = 1024) -> np.ndarray:
    """For each (target, rank from 0) the value of that rank among the sources within the radius, and before the target. `values` ascend.

    The ordered sources are halved again and again: the number of near ones in the lower half tells in which half a rank lies, so near sources are
    never listed but of the last few."""
    out = np.empty(len(who))
    work = [(0, len(values), np.arange(len(who)), rank)] if len(who) else []
    while work:
        low, high, asked, k = work.pop()
        if values[low] == values[high - 1]:
            out[asked] = values[low]
            continue
        if high - low <= few:
            out[asked] = values[low + _listed(t, tuple(c[low:high] for c in s), radius, as_of, self_gap, who[asked], k)]
            continue
        mid = (low + high) // 2
        some, back = np.unique(who[asked], return_inverse=True)
        n = _counts(tuple(c[some] for c in t), tuple(c[low:mid] for c in s), radius, as_of, self_gap)[back]
        lower = k < n
        work += [part for part in ((low, mid, asked[lower], k[lower]), (mid, high, asked[~lower], (k - n)[~lower])) if len(part[2])]
    return out


def _quantiles(t: tuple, s: tuple, values: np.ndarray, radius: float, as_of: bool, self_gap: float | None, shares: tuple[float, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of known values within the radius of each target and their linear quantiles, NaN where there is none."""
    n = _counts(t, s, radius, as_of, self_gap)
    some = np.flatnonzero(n)
    at = [q * (n[some] - 1) for q in shares]
    ranks = np.concatenate([f(x).astype(np.int64) for x in at for f in (np.floor, np.ceil)]) if shares else np.zeros(0, np.int64)
    got = _ordered_within(t, s, values, radius, as_of, self_gap, np.tile(some, 2 * len(shares)), ranks).reshape(len(shares), 2, len(some))
    out = []
    for x, (low, high) in zip(at, got, strict=True):
        full = np.full(len(n), np.nan)
        with np.errstate(invalid="ignore"):
            full[some] = np.where(np.floor(x) == np.ceil(x), low, (np.ceil(x) - x) * low + (x - np.floor(x)) * high)
        out.append(full)
    return n, out


def _count(radii: tuple[float, ...], cap_km: float | None, as_of: bool, self_gap: float | None, values: bool = False):
    """A group's targets (id, lat, lon, at) and what the tiles around sent, sources (lat, lon, at, value) and time tables (at, n; lat null):
    counts, nearest distances and (with `values`) quantiles, by ranges of ordered sources and not by all pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        floats = lambda t, c: t.column(c).cast(pa.float64()).combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)
        far = np.iinfo(np.int64).max
        times = lambda t: t.column("at").combine_chunks().fill_null(far).to_numpy(zero_copy_only=False)
        ids, t_at = left.column("id").to_numpy(), times(left)
        s_lat, s_lon, s_at, s_n = floats(right, "lat"), floats(right, "lon"), times(right), floats(right, "n")
        whole, points = np.isnan(s_lat), ~np.isnan(s_lat)
        dated = np.flatnonzero(t_at < far) if as_of else np.arange(len(ids))
        t = (floats(left, "lat")[dated], floats(left, "lon")[dated], t_at[dated])
        s = (s_lat[points], s_lon[points], s_at[points])
        order = np.argsort(s_at[whole], kind="stable")
        table, before = s_at[whole][order], np.concatenate([[0], np.cumsum(s_n[whole][order])]).astype(np.int64)
        listed = before[np.searchsorted(table, t[2], "left")] if as_of else np.full(len(dated), before[-1])
        n, at_gap = np.zeros((len(radii), len(ids)), np.int64), _count_within(t, s, self_gap, as_of) if self_gap is not None and radii else 0
        for r, radius in enumerate(radii):
            n[r, dated] = listed + _count_within(t, s, radius, as_of) - (at_gap if self_gap is None or self_gap <= radius else _count_within(t, s, radius, as_of))
        value_n, quantiles = np.zeros((len(radii), len(ids)), np.int64), np.full((2, len(radii), len(ids)), np.nan)
        if values:
            s_value = floats(right, "value")
            kept = np.flatnonzero(points & ~np.isnan(s_value))
            kept = kept[np.argsort(s_value[kept], kind="stable")]
            known = (s_lat[kept], s_lon[kept], s_at[kept])
            for r, radius in enumerate(radii):
                value_n[r, dated], quantiles[:, r, dated] = _quantiles(t, known, s_value[kept], radius, as_of, self_gap, (0.5, 0.9))
        nearest = np.full(len(ids), np.inf)
        if cap_km is not None:
            nearest[dated] = _nearest_within(t, s, cap_km, as_of, self_gap)
        m, none = len(ids), cap_km is not None
        kinds = np.repeat([*range(len(radii)), *([-1] if none else [])], m).astype(np.int32)
        far_away = np.concatenate([np.full(len(radii) * m, np.inf), *([nearest] if none else [])])
        tail = np.zeros(m if none else 0)
        statistics = {n: pa.array(np.concatenate([q.ravel(), tail]), mask=np.concatenate([value_n.ravel() == 0, tail == 0])) for n, q in zip(("median", "p90"), quantiles, strict=True)}
        whole_n, whole_value_n = (np.concatenate([c.ravel(), tail.astype(np.int64)]) for c in (n, value_n))
        return pa.table({"id": pa.array(np.tile(ids, len(radii) + none), pa.int64()), "radius": pa.array(kinds), "n": pa.array(whole_n), "value_n": pa.array(whole_value_n),
                         **statistics, "nearest": pa.array(far_away, mask=np.isinf(far_away))})

    return run


def _met(targets: DataFrame, sent: DataFrame, function, chunk: int) -> DataFrame:
    """targets (band, column, id, lat, lon, at) and what is sent to (band, column), compared in chunks of about `chunk` targets."""
    keys = ("band", "column", "chunk")
    chunks = targets.groupBy("band", "column").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    left = targets.join(chunks, ["band", "column"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    right = sent.join(chunks, ["band", "column"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = right.select(*[F.col(k).alias(k) for k in keys], "lat", "lon", "at", "value", "n")  # columns of their own, told apart from the targets'
    return left.select(*keys, "id", "lat", "lon", "at").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(function, FOUND)


def _sent(tiles: DataFrame, sources: DataFrame, dense: bool = False) -> DataFrame:
    """What the tiles (see `Tiles.around`) receive: the sources within their bounds, and where `dense` time tables of the tiles that are wholly near, summed up."""
    there = sources.withColumnsRenamed({"band": "b2", "column": "c2"})
    point = tiles.where(~F.col("whole")) if dense else tiles
    near = F.col("lat").between(F.col("south"), F.col("north")) & (F.pmod(F.col("lon") + 180 - F.col("west"), F.lit(360.0)) <= F.col("span"))
    out = point.join(there, ["b2", "c2"]).where(near).select("band", "column", "lat", "lon", "at", "value", F.lit(None).cast("long").alias("n"))
    if dense:
        tables = there.groupBy("b2", "c2", "at").agg(F.count("*").alias("n"))
        whole = tiles.where("whole").join(tables, ["b2", "c2"]).groupBy("band", "column", "at").agg(F.sum("n").alias("n"))
        none = F.lit(None).cast("double")
        out = out.unionByName(whole.select("band", "column", none.alias("lat"), none.alias("lon"), "at", none.alias("value"), "n"))
    return out


def _crowded(tiles: DataFrame, sources: DataFrame, dense: int) -> DataFrame:
    """(band, column) of the tiles whose bordering tiles hold more than `dense` sources."""
    counts = sources.groupBy(F.col("band").alias("b2"), F.col("column").alias("c2")).agg(F.count("*").alias("n"))
    return tiles.where(~F.col("whole")).join(counts, ["b2", "c2"]).groupBy("band", "column").agg(F.sum("n").alias("n")).where(F.col("n") > dense).select("band", "column")


def _dense_counts(targets: DataFrame, sources: DataFrame, radius: float, function, dense: int, chunk: int) -> Iterator[DataFrame]:
    """Counts within one radius, tiles halved until their borders are small."""
    for level in range(MOST_LEVELS + 1):
        grid = Tiles(radius / 2 ** (level + 1))
        near, there = grid.placed(targets), grid.placed(sources)
        tiles = materialize(grid.around(near.select("band", "column").distinct(), radius, tell=True), "tiles")
        last = level == MOST_LEVELS
        if last:
            yield _met(near, _sent(tiles, there, True), function, chunk)
            return
        crowded = materialize(_crowded(tiles, there, dense), "crowded")
        ready = tiles.join(crowded, ["band", "column"], "left_anti")
        yield _met(near.join(crowded, ["band", "column"], "left_anti"), _sent(ready, there, True), function, chunk)
        if not crowded.take(1):
            return
        targets = materialize(near.join(crowded, ["band", "column"], "left_semi").select("id", "lat", "lon", "at"), "crowded-targets")


def _widening(targets: DataFrame, sources: DataFrame, first_km: float, cap_km: float, function_of, chunk: int, factor: int = 2) -> Iterator[DataFrame]:
    """Nearest distances within the cap: tiles of first_km, then wider ones for the targets that are left. A tile gets the sources before the last of its targets only."""
    radius = min(first_km, cap_km)
    while True:
        grid = Tiles(radius)
        near, there = grid.placed(targets), grid.placed(sources)
        own = near.groupBy("band", "column").agg(F.max("at").alias("last"))
        tiles = grid.around(own.select("band", "column"), radius)
        sent = _sent(tiles, there).join(own, ["band", "column"]).where(F.col("at") <= F.col("last")).drop("last")
        found = materialize(_met(near, sent, function_of(radius), chunk).where("nearest is not null"), "nearest")
        yield found
        if radius >= cap_km:
            return
        targets = materialize(targets.join(found.select("id"), "id", "left_anti"), "left")
        if not targets.take(1):
            return
        radius = min(radius * factor, cap_km)


def neighbour_stats(targets: DataFrame, sources: DataFrame, key: str, radii: list[float], cap_km: float, as_of: tuple[str, str] | None = None, value: str | None = None, self_gap: float | None = None, dense: int = 1 << 21, chunk: int | None = None) -> DataFrame:
    """JN-05 .. JN-09: for each target counts within each radius, the nearest distance within the cap, and (with value) count, median and 90 %
    quantile of known values within each radius. Both tables have latitude, longitude; key is unique among the targets.

    as_of: (target date, source date): only sources dated strictly before; a null on either side matches nothing.
    self_gap: leave out sources nearer than that (JN-07's self exclusion). Targets without neighbours, or without a place, keep count 0 and null otherwise.
    A quantile needs a target's values together, so with `value` a chunk of targets meets all sources of the tiles around it; there it is found
    by counts among ever fewer ordered values (`_ordered_within`).
    """
    instant = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    place = (F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon"))
    known = "latitude is not null and longitude is not null"
    numbered = materialize(targets.where(known).select(F.col(key).alias("key"), *place, (instant(as_of[0]) if as_of else F.lit(0)).cast("long").alias("at")).withColumn("id", F.monotonically_increasing_id()), "targets")
    there = sources.where(known).select(*place, (instant(as_of[1]) if as_of else F.lit(0)).cast("long").alias("at"), (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("value"))
    there = materialize(there.where("at is not null"), "sources")
    here = numbered.select("id", "lat", "lon", "at")
    reach = max(radii) if radii else cap_km / 4
    if value or cap_km <= reach:
        reach = max([cap_km, *radii])
    grid = Tiles(2 * reach)  # few large groups; crowded ones are bounded below
    near, around = grid.placed(here), grid.placed(there)
    tiles = grid.around(near.select("band", "column").distinct(), reach)
    chunk = chunk or 65_536
    compare = lambda rs, cap, gap=self_gap: _count(tuple(rs), cap, as_of is not None, gap, value is not None)
    parts = []
    if value is None and there.count() > dense:
        crowded = materialize(_crowded(tiles, around, dense), "crowded")
        if crowded.take(1):
            full = materialize(near.join(crowded, ["band", "column"], "left_semi").select("id", "lat", "lon", "at"), "crowded-targets")
            near, tiles = (df.join(crowded, ["band", "column"], "left_anti") for df in (near, tiles))
            parts += list(_widening(full, there, cap_km / 2**7, cap_km, lambda r: compare((), r), chunk))
            for r, radius in enumerate(radii):
                parts += [df.withColumn("radius", F.lit(r)) for df in _dense_counts(full, there, radius, compare((radius,), None, None), dense, chunk)]
            if self_gap is not None:  # what the time tables counted within the gap goes again
                small = Tiles(max(self_gap, 0.05))
                spots = small.placed(full)
                gap = _met(spots, _sent(small.around(spots.select("band", "column").distinct(), self_gap), small.placed(there)), compare((self_gap,), None, None), chunk)
                parts += [gap.withColumn("radius", F.lit(r)).withColumn("n", -F.col("n")) for r in range(len(radii))]
    found = _met(near, _sent(tiles, around), compare(radii, min(cap_km, reach)), chunk)
    if cap_km > reach:
        found = materialize(found, "near")
        left = materialize(near.select("id", "lat", "lon", "at").join(found.where("nearest is not null").select("id"), "id", "left_anti"), "left")
        if left.take(1):
            parts += list(_widening(left, there, 4 * reach, cap_km, lambda r: compare((), r), chunk, 4))
    for df in parts:
        found = found.unionByName(df)
    pick = lambda r, c, f: f(F.when(F.col("radius") == r, F.col(c)))
    out = [F.min("nearest").alias("nearest_km")]
    for r, radius in enumerate(radii):
        if value:
            out += [pick(r, "value_n", F.sum).alias(f"value_count_{radius:g}km"), pick(r, "median", F.max).alias(f"median_{radius:g}km"), pick(r, "p90", F.max).alias(f"p90_{radius:g}km")]
        out.append(pick(r, "n", F.sum).alias(f"count_{radius:g}km"))
    stats = numbered.select("id", "key").join(found.groupBy("id").agg(*out), "id", "left").drop("id").withColumnRenamed("key", key)
    got = targets.select(key).join(stats, key, "left")
    return got.fillna(0, [c for c in got.columns if "count_" in c])
