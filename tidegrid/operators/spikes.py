"""Implausible spikes, stuck values and impossible readings, relative to each source's normal behaviour."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import gathered, pieces, starts, whole_groups
from ..functions.pursuit import low_rank
from ..session import broadcast_if_small, materialise, width

S = ("src", "e", "i")  # a source
OUT = "kind INT, src INT, rid BIGINT, e BIGINT, i BIGINT, t DOUBLE, v DOUBLE, x DOUBLE, step DOUBLE, n BIGINT, r DOUBLE, apart DOUBLE, run BIGINT, a ARRAY<DOUBLE>, own BOOLEAN"
CANDIDATE, STATISTICS, BORDER = range(3)
DAY = 86400.0
PIECE = 200_000  # rows a task works on at a time
SIDE = 7  # readings on either side that make the level around a reading: more than twice the longest spike
POINTS = 256  # quantiles that stand for the residuals of a part of a source


def daily_profile(r: DataFrame, least_days: int = 4, errors: float = 3.0) -> DataFrame:
    """Low-rank normal behaviour of every source's matrix of days by times of day: (src, e, i, day, slot, p), where p is not 0.

    Robust principal components of each whole source. The matrix is centred on the medians of days and of times of day, in turn; the level of
    a day is no part of p, the centre of a time of day is, if more than half of its days lie more than `errors` standard errors off. What is left is split into a
    low-rank part (as many components as stand out of the scatter, scores of either sign), a sparse part and scatter (functions/pursuit.py).
    Only times with at least least_days days and days of more than two cells count. A source is fitted in one task, as sparse cells.
    """
    # the shuffle by source also serves the cells
    cells = r.select(*S, "day", "slot", "v", "step").repartition(width(r.sparkSession), *S).groupBy(*S, "day", "slot").agg(F.avg("v").alias("z"), F.max("step").alias("step"))
    cells = cells.sortWithinPartitions(*S, "day", "slot")
    return materialise(cells.mapInArrow(_profiles(least_days, errors), "src INT, e BIGINT, i BIGINT, day BIGINT, slot BIGINT, p DOUBLE"), "profile")


def _profiles(least_days: int, errors: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in gathered(whole_groups(batches, S), PIECE):
            p = profile(c, least_days, errors)
            ok = p != 0
            out = [pa.array(c["src"][ok], pa.int32()), *[pa.array(c[k][ok], pa.int64()) for k in ("e", "i", "day", "slot")], pa.array(p[ok])]
            yield pa.RecordBatch.from_arrays(out, names=[*S, "day", "slot", "p"])

    return run


def profile(c: dict[str, np.ndarray], least_days: int, errors: float) -> np.ndarray:
    """p of each cell; c: cells of whole sources, sorted by source, day and slot."""
    p, z = np.zeros(len(c["z"])), c["z"].copy()
    source, slot = np.cumsum(starts(*(c[k] for k in S))) - 1, c["slot"]
    day = np.cumsum(starts(source, c["day"])) - 1
    n = np.bincount(day)
    z -= _group_median(day, n, z)[day]
    use = np.flatnonzero((n > 2)[day] & (np.abs(z) < 1e150))
    at = _numbered(source[use], slot[use])
    use = use[(np.bincount(at) >= least_days)[at]]
    if not len(use):
        return p
    z, source, day, slot = z[use], np.cumsum(starts(source[use])) - 1, np.cumsum(starts(day[use])) - 1, _numbered(source[use], slot[use])
    n, n_day, n_slot = np.bincount(source), np.bincount(day), np.bincount(slot)
    of_day, of_slot = source[starts(day)], np.zeros(len(n_slot), int)
    of_slot[slot] = source
    by_slot, centre = np.lexsort((slot,)), np.zeros(len(n_slot))
    for _ in range(2):
        z -= _group_median(day, n_day, z, True)[day]
        off = _group_median(slot[by_slot], n_slot, z[by_slot], True)
        z -= off[slot]
        centre += off
    # the medians taken off hide some of the scatter
    free = np.maximum(n - np.bincount(of_day) - np.bincount(of_slot) + 1, n / 2)
    sigma = np.maximum(1.4826 * _group_median(source, n, np.abs(z)) * np.sqrt(n / free), np.maximum.reduceat(c["step"][use], np.flatnonzero(starts(source))))
    sigma = np.where(sigma > 0, sigma, 0.05 * np.sqrt(np.bincount(source, z * z) / n))
    normal = np.where(np.abs(centre) > errors * 1.2533 * sigma[of_slot] / np.sqrt(n_slot), centre, 0.0)
    p[use] = normal[slot] + low_rank(day, slot, of_day, of_slot, z + (centre - normal)[slot], sigma)
    return p


def _numbered(source: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Numbers of the pairs that occur, in their order."""
    at = np.lexsort((slot, source))
    out = np.empty(len(at), int)
    out[at] = np.cumsum(starts(source[at], slot[at])) - 1
    return out


def _medians(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of each row without NaN, and how many values it has."""
    k = (~np.isnan(a)).sum(1)
    s = np.sort(a, axis=1)
    at = np.arange(len(a))
    top = np.maximum(k, 1)
    return np.where(k > 0, (s[at, (top - 1) // 2] + s[at, top // 2]) / 2, np.nan), k


def _group_median(g: np.ndarray, n: np.ndarray, x: np.ndarray, majority: bool = False) -> np.ndarray:
    """Median of x per group; groups are numbered and consecutive. majority: what no more than half of x exceed, on either side of 0."""
    s = x[np.lexsort((x, g))]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    a, b = s[first + (n - 1) // 2], s[first + n // 2]
    return np.maximum(a, 0) + np.minimum(b, 0) if majority else (a + b) / 2


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))


def examine(c: dict[str, np.ndarray], k: float, longest: int, stuck: int, least: int, opened: bool, goes_on: bool, borders: bool) -> pa.RecordBatch:
    """Candidates, statistics of the sources and, of sources that may go on outside, the readings near the ends.

    c: sorted rows; x is v less the daily profile. A reading whose neighbours lie outside is left to the second pass, in which (borders)
    only rows marked `own` count and the others are their neighbours."""
    gstart = starts(*(c[x] for x in S))
    rstart = gstart | starts(c["t"], c["v"])  # equal time and value: one reading
    at = np.cumsum(rstart) - 1
    v, x, step = (c[y][rstart] for y in ("v", "x", "step"))
    g = (np.cumsum(gstart) - 1)[rstart]
    groups, m = int(g[-1]) + 1, len(v)
    n = np.bincount(g, minlength=groups)
    idx = np.arange(m)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    pos, size = idx - first[g], n[g]
    context = max(SIDE, stuck - 1)
    cut = np.full(groups, borders)
    sure = c["own"][rstart].copy() if borders else np.ones(m, bool)
    near = np.zeros(m, bool)
    for is_cut, which, dist in ((opened, 0, pos), (goes_on, groups - 1, size - 1 - pos)):
        if is_cut:
            cut[which] = True
            sure &= ~((g == which) & (dist < context))
            near |= (g == which) & (dist < 2 * context)

    def side(sign: int) -> np.ndarray:
        a = np.full((m, SIDE), np.nan)
        for o in range(1, SIDE + 1):
            ok = pos >= o if sign < 0 else pos + o < size
            a[ok, o - 1] = x[idx[ok] + sign * o]
        return a

    left, right = side(-1), side(1)
    level, _ = _medians(np.concatenate([left, right], axis=1))
    (ml, kl), (mr, kr) = _medians(left), _medians(right)
    r = np.where(np.isnan(level), 0.0, x - level)
    scatter = 1.4826 * _group_median(g, n, np.abs(r))
    # apart from the level on both sides where both are known, and back after at most `longest` readings
    # a side says what is normal if the rest of a spike can't be half of it; alone, if a whole spike can't
    known_l, known_r = kl >= 2 * longest - 1, kr >= 2 * longest - 1
    both, only_l, only_r = known_l & known_r, known_l & ~known_r & (kl > 2 * longest), known_r & ~known_l & (kr > 2 * longest)
    dl, dr = np.abs(x - ml), np.abs(x - mr)
    apart = np.select([both, only_l, only_r], [np.minimum(dl, dr), dl, dr], np.abs(r))
    ref = np.select([both, only_l, only_r], [(ml + mr) / 2, ml, mr], level)
    # how far the next readings on either side, up to each, stay from the level at least
    stay = [np.minimum.accumulate(np.nan_to_num(np.abs(a[:, :longest] - ref[:, None]), nan=0.0), axis=1) for a in (left, right)]
    stay = np.concatenate(stay, axis=1)
    # safe bounds: the scatter in use is no less than this, and beyond apart / k there is no spike
    low = np.where(cut, 0.0, n / (n + 8.0) * scatter)[g]
    cand = sure & (apart > k * np.maximum(low, step)) & (1 + (stay > (k - 1) / k * apart[:, None]).sum(1) <= longest)
    run = np.cumsum(starts(g, v)) - 1
    run_n = np.bincount(run)[run]
    rows = np.flatnonzero((sure & (cand | (run_n >= stuck)))[at] & (cut | (n >= least))[g][at])
    ends = np.flatnonzero(near[at])
    known = np.bincount(g, sure, minlength=groups).astype(np.int64)
    stat = np.flatnonzero((cut | (n >= least)) & (known > 0))
    sketches = [np.quantile(np.abs(r[a : a + b][sure[a : a + b]]), np.linspace(0, 1, min(q, POINTS)), method="nearest") if w else np.array([s / 1.4826]) for a, b, q, w, s in zip(first[stat], n[stat], known[stat], cut[stat], scatter[stat], strict=True)]
    stat_rows = np.flatnonzero(gstart)[stat]
    every = np.concatenate([rows, stat_rows, ends])
    q = at[every]
    sizes = (len(rows), len(stat), len(ends))
    a = pa.concat_arrays([
        pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * stay.shape[1] + 1, stay.shape[1], dtype=np.int32)), pa.array(stay[at[rows]].ravel())), _lists(sketches), pa.nulls(sizes[2], pa.list_(pa.float64())),
    ])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.arange(3, dtype=np.int32), sizes)), pa.array(c["src"][every], pa.int32()), *[pa.array(c[y][every], pa.int64()) for y in ("rid", "e", "i")],
            *[pa.array(y) for y in (c["t"][every], v[q], x[q], step[q])], pa.array(np.concatenate([np.zeros(sizes[0], np.int64), known[stat], np.zeros(sizes[2], np.int64)])),
            pa.array(r[q]), pa.array(np.where(cand, apart, 0.0)[q]), pa.array(run_n[q].astype(np.int64)), a, pa.array(~sure[q]),
        ],
        names=[y.split()[0] for y in OUT.split(", ")],
    )


def flag_readings(rows: DataFrame, k: float = 6.0, longest: int = 3, stuck: int = 10, least: int = 9, range_k: float = 8.0) -> DataFrame:
    """Readings that are spikes, stuck or out of range, one row each.

    rows: src INT, rid, e, i (source = src, e, i), t (seconds), v, step (smallest reported step), period (usual seconds between readings).
    The readings of a source by days and times of day form a matrix; its low-rank part (a level per day, a centre per time of day and
    robust principal components, see daily_profile) is normal behaviour, the rest is sparse. The day's level is followed closer: it is that of the seven
    readings on either side, less their profile. spike: the sparse part lies apart from that level on both sides by more than k times the
    source's scatter (its median absolute residual, drawn towards the item's usual one in short series, at least `step`) for at most
    `longest` readings in a row. stuck: the reading belongs to a run of `stuck` or more consecutive equal readings. out_of_range: it lies
    more than range_k interquartile ranges (at least `step`) away from the quartiles of its src and i. Spikes, runs and ranges are tested
    apart from each other; a row may have several reasons.

    Sources are whole: length, scatter, level and runs are those of the source, however long or sparse it is. Rows are sorted by source
    and time over all partitions, so a busy source spreads over tasks; readings near the end of a partition are examined in a second
    pass together with their neighbours from the next one. Scatter merges from quantiles of the parts (256 of each part of a source that
    is cut, the median of one that is not).
    Rows with NULL or NaN in v, e, i or t do not count; a missing step is 0, a missing period one hour. Rows of equal source, time and
    value are one reading, each such row is flagged. Sources of fewer than `least` readings have no spike and no run.
    Result: src, rid, e, i, t, v, spike, stuck, out_of_range BOOLEAN. An empty table gives an empty result.
    """
    num = lambda c: F.col(c).cast("double")
    usable = rows.select(
        F.col("src").cast("int").alias("src"), F.col("rid").cast("bigint").alias("rid"), F.col("e").cast("bigint").alias("e"), F.col("i").cast("bigint").alias("i"), num("t").alias("t"), num("v").alias("v"),
        F.coalesce(num("step"), F.lit(0.0)).alias("step"), F.when(num("period") > 0, num("period")).otherwise(3600.0).alias("period"),
    ).dropna().where("NOT isnan(v) AND NOT isnan(t)")
    timed = usable.withColumns({"day": F.floor(F.col("t") / DAY), "slot": F.floor(F.pmod("t", F.lit(DAY)) / F.least("period", F.lit(DAY)))})
    profile = daily_profile(timed)
    if profile.isEmpty():
        r = usable.withColumn("x", F.col("v"))
    else:
        r = timed.join(broadcast_if_small(profile, 20_000), [*S, "day", "slot"], "left").withColumn("x", F.col("v") - F.coalesce("p", F.lit(0.0)))
    order = [*S, "t", "v"]
    r = r.select(*order, "rid", "x", "step").repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order)

    def first_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, opened, goes_on in pieces(batches, S, tuple(order), PIECE):
            yield examine(c, k, longest, stuck, least, opened, goes_on, False)

    def second_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in whole_groups(batches, S):
            yield examine(c, k, longest, stuck, least, False, False, True)

    seen = materialise(r.mapInArrow(first_pass, OUT), "readings")
    ends = seen.where(F.col("kind") == BORDER).select(*order, "rid", "x", "step", "own").repartition(width(rows.sparkSession), *S).sortWithinPartitions(*order)
    seen = seen.where(F.col("kind") != BORDER).unionByName(materialise(ends.mapInArrow(second_pass, OUT), "borders"))
    stats = seen.where((F.col("kind") == STATISTICS) & (F.col("n") > 0)).select(*S, F.explode("a").alias("q"), (F.col("n") / F.size("a")).alias("w"))
    stats = stats.groupBy(*S).agg(F.round(F.sum("w")).alias("n"), (1.4826 * F.percentile("q", 0.5, F.ceil(F.col("w") * 1000))).alias("own_scatter")).where(F.col("n") >= least)
    stats = materialise(stats, "sources")
    usual = stats.groupBy("src", "i").agg(F.percentile_approx("own_scatter", 0.5).alias("usual"))
    scatter = F.greatest("step", (F.col("n") * F.col("own_scatter") + 8 * F.col("usual")) / (F.col("n") + 8))
    cand = seen.where(F.col("kind") == CANDIDATE).select(*S, "rid", "t", "v", "step", "r", "apart", "run", "a").join(stats, list(S)).join(usual, ["src", "i"]).withColumn("s", scatter)
    length = F.size(F.filter("a", lambda d: d > (k - 1) * F.col("s"))) + 1
    spike = (F.col("apart") > k * F.col("s")) & (F.abs("r") > k / 2 * F.col("s")) & (length <= longest)
    out = ["src", "rid", "e", "i", "t", "v"]
    flagged = cand.select(*out, spike.alias("spike"), (F.col("run") >= stuck).alias("stuck"), F.lit(False).alias("out_of_range")).where("spike OR stuck")
    quart = usable.groupBy("src", "i").agg(F.percentile_approx("v", [0.25, 0.75], 1000).alias("q"), F.max("step").alias("least"))
    wide = range_k * F.greatest(F.col("q")[1] - F.col("q")[0], F.col("least"))
    odd = usable.join(quart, ["src", "i"]).where((F.col("v") < F.col("q")[0] - wide) | (F.col("v") > F.col("q")[1] + wide))
    odd = odd.select(*out, F.lit(False).alias("spike"), F.lit(False).alias("stuck"), F.lit(True).alias("out_of_range"))
    return flagged.unionByName(odd).groupBy(*out).agg(*[F.max(x).alias(x) for x in ("spike", "stuck", "out_of_range")])
