"""Whole fits: the recipe that turns an image's pixels into another rendition of them.

Ten sliders and, if wanted, three points of the tone curve are searched for by damped
least-squares steps within their bounds, on perceptual differences (CIEDE2000) of every pixel.
Pixels are dealt by image into pieces of at most PIECE pixels. An image that is one piece, and whole
in a task, is searched there at once. The others, images of any size, are many rows: in each round
every piece meets the trial of each start of its image, works out residuals and their numerical
derivatives, and gives sums: J'J, J'r, the squared and the plain residuals. Sums over pieces are
decimals, so their order doesn't matter; a 13 by 13 system for each image and start gives the next
trial. Both ways take the same steps.

Defined results: an image with a missing or NaN channel is one row with a message and no recipe;
a null image is an image; repeated pixels count each time; an empty table gives an empty one;
of equal fits the first start's wins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import colour_arrays as arrays

from .kept import kept
from .pieces import dealt, runs

#: The offsets of the ten sliders where searches begin, and those of a second pass over bad fits.
STARTS, MORE_STARTS = (0.05, -0.05), (0.05, -0.05, 0.15, -0.15, 0.3, -0.3)
DIFF_STEP = 3e-3
#: Trials (a few hundred bytes each) up to which they are broadcast to the pieces.
BROADCAST_TRIALS = 100_000
#: A step or a relative gain below these ends a search, as does a damping beyond MOST_DAMPING.
LEAST_STEP, LEAST_GAIN, MOST_DAMPING = 1e-4, 1e-5, 1e7


def bounds(width: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(arrays.SLIDERS)
    return np.concatenate((-np.ones(n), np.zeros(width - n))), np.ones(width)


def start_vector(offset: float, curve: bool) -> list[float]:
    return [offset] * len(arrays.SLIDERS) + (list(arrays.STRAIGHT) if curve else [])


_RAW = "image {}, x array<double>, target array<double>, n long, missing long, vector array<double>, error double, done boolean"


def _dealt(starts: Sequence[float], curve: bool, rounds: int):
    """Of an image that is whole in its task the fit; of others the pieces: x (r, g, b of each pixel, end to end) and target (their CIELAB values in the other rendition)."""
    names = ["image", "x", "target", "n", "missing", "vector", "error", "done"]
    doubles = pa.list_(pa.float64())
    kinds = (doubles, doubles, pa.int64(), pa.int64(), doubles, pa.float64(), pa.bool_())

    def row(values: np.ndarray, whole: bool) -> tuple:
        missing = np.isnan(values).any(1)
        pixels, target = values[~missing, :3], arrays.lab(values[~missing, 3:])
        lost = int(missing.sum())
        if not whole:
            return pixels.reshape(-1), target.reshape(-1), len(values), lost, None, None, False
        vector, error = (None, None) if lost else _searched(arrays.Pixels(pixels, target), starts, curve, rounds)
        return None, None, len(values), lost, vector, error, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, values, whole in runs(batches):
            columns = [pa.array([v], kind) for v, kind in zip(row(values, whole), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([name, *columns], names)

    return run


def _sums_schema(width: int) -> list[str]:
    return [f"s{i}" for i in range(width * (width + 1) // 2 + width + 3)]


def _moves(at: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.where(at + DIFF_STEP <= high, DIFF_STEP, -DIFF_STEP)


def _parts(pixels: arrays.Pixels, at: np.ndarray, residual: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper half of J'J, and J'r."""
    moves = _moves(at, high)
    slopes = (pixels.differences(at, moves) - residual) / moves[:, None]
    return (slopes @ slopes.T)[np.triu_indices(len(at))], slopes @ residual


def _measured(width: int):
    """For pieces beside trials: the upper half of J'J, then J'r, the squared residuals, the residuals and the number of pixels."""
    _, high = bounds(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, target, trial in zip(batch.column("x"), batch.column("target"), batch.column("trial"), strict=True):
                pixels = arrays.Pixels(*(v.values.to_numpy(zero_copy_only=False).reshape(-1, 3) for v in (x, target)))
                at = trial.values.to_numpy(zero_copy_only=False)
                residual = pixels.differences(at)[0]
                out.append(np.concatenate((*_parts(pixels, at, residual, high), [residual @ residual, residual.sum(), len(residual)])))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("start"), *map(pa.array, np.array(out).T)], ["image", "start", *_sums_schema(width)])

    return run


def _step(x: np.ndarray, slope: np.ndarray, matrix: np.ndarray, damp: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The damped step from x, cut back to the bounds; what its bound holds back stays where it is."""
    free = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
    if not free.any():
        return x
    own = matrix[np.ix_(free, free)]
    move = np.zeros(len(x))
    move[free] = np.linalg.solve(own + damp * np.diag(np.diag(own) + 1e-6 * (1 + np.diag(own).max())), -slope[free])
    return np.clip(x + move, low, high)


class Search:
    """A search from one start: where it stands, its sums there, and the trial ahead."""

    def __init__(self, x, trial, h, d, loss: float, total: float, damp: float):
        self.x, self.trial, self.h, self.d = (np.asarray(v, float) for v in (x, trial, h, d))
        self.loss, self.total, self.damp, self.active = loss, total, damp, True

    def taken(self, squares: float, total: float, parts) -> None:
        """Takes the trial if it is better, with parts() for its J'J and J'r, and finds the next one."""
        low, high = bounds(len(self.x))
        better, first = squares < self.loss, np.isinf(self.loss)
        done = not first and np.abs(self.trial - self.x).max() < LEAST_STEP
        if better:
            done |= not first and self.loss - squares < LEAST_GAIN * self.loss
            self.h, self.d = parts()
            self.x, self.loss, self.total = self.trial, squares, total
        self.damp = self.damp if first else self.damp / 3 if better else self.damp * 4
        matrix = np.zeros((len(self.x), len(self.x)))
        matrix[np.triu_indices(len(self.x))] = self.h
        matrix = matrix + np.triu(matrix, 1).T
        self.trial = _step(self.x, self.d, matrix, self.damp, low, high)
        self.active = not (done or self.damp > MOST_DAMPING or self.loss == 0)


def _searched(pixels: arrays.Pixels, starts: Sequence[float], curve: bool, rounds: int) -> tuple[np.ndarray, float]:
    """The vector and mean difference of the best start, with all pixels at hand. Derivatives are needed only where a trial is taken, and not in the last round."""
    found = []
    for start in starts:
        begin = start_vector(start, curve)
        _, high = bounds(len(begin))
        half = len(begin) * (len(begin) + 1) // 2
        search = Search(begin, begin, np.zeros(half), np.zeros(len(begin)), float("inf"), 0.0, 1e-2)
        for left in range(rounds - 1, -1, -1):
            at, residual = search.trial, pixels.differences(search.trial)[0]
            # rounded like the decimals of the rounds
            squares, total = np.round([residual @ residual, residual.sum()], 9)
            if not left:
                if squares < search.loss:
                    search.x, search.loss, search.total = at, squares, total
                break
            search.taken(squares, total, lambda: [np.round(p, 9) for p in _parts(pixels, at, residual, high)])  # noqa: B023
            if not search.active:
                break
        found.append((search.loss, search.x, search.total / len(residual)))
    return min(found, key=lambda f: f[0])[1:]


def _next(width: int, names: list[str]):
    """Takes each trial if it is better and finds the next one."""
    half = width * (width + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            sums = np.stack([batch.column(s).to_numpy(zero_copy_only=False).astype(float) for s in _sums_schema(width)], 1) if batch.num_rows else []
            for row, s in zip(batch.select(["x", "trial", "h", "d", "loss", "total", "damp"]).to_pylist(), sums, strict=True):
                # nothing is summed before the first trial
                row["h"], row["d"] = row["h"] or [0.0] * half, row["d"] or [0.0] * width
                search = Search(**row)
                search.taken(s[-3], s[-2], lambda: (s[:half], s[half : half + width]))  # noqa: B023
                rows.append((*(v.tolist() for v in (search.x, search.trial, search.h, search.d)), search.loss, search.total, search.damp, s[-1], search.active))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("start"), *map(pa.array, zip(*rows, strict=True))], names)

    return run


def fit(pixels: DataFrame, starts: Sequence[float] = STARTS, curve: bool = True, rounds: int = 30) -> DataFrame:
    """image, vector, error (the mean difference over every pixel), pixels, message: the best of all starts."""
    width = len(start_vector(0, curve))
    kind = pixels.schema["image"].dataType.simpleString()
    raw = kept(dealt(pixels).mapInArrow(_dealt(starts, curve, rounds), _RAW.format(kind)), "dealt")
    pieces = raw.where("not done").select("image", "x", "target")
    # of the images that no task had as a whole: far fewer than pieces or tasks
    counts = kept(raw.where("not done").groupBy("image").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing")), "fit-images")
    vector = lambda v: F.array(*[F.lit(float(x)) for x in v])
    begin = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), vector(start_vector(s, curve)).alias("x")) for i, s in enumerate(starts)]))
    first = counts.where("missing = 0").select("image", begin.alias("s")).select("image", "s.start", "s.x", F.col("s.x").alias("trial"))
    nothing = F.array().cast("array<double>")
    names = ["image", "start", "x", "trial", "h", "d", "loss", "total", "damp", "n", "active"]
    schema = f"image {kind}, start int, x array<double>, trial array<double>, h array<double>, d array<double>, loss double, total double, damp double, n double, active boolean"
    state = kept(first.select("*", nothing.alias("h"), nothing.alias("d"), F.lit(float("inf")).alias("loss"), F.lit(0.0).alias("total"), F.lit(1e-2).alias("damp"), F.lit(0.0).alias("n"), F.lit(True).alias("active")), "fit-state")
    ended, sums = [], _sums_schema(width)
    for _ in range(rounds):
        trials = state.where("active").select(F.col("image").alias("_image"), "start", "trial")
        found = trials.limit(BROADCAST_TRIALS + 1).count()
        if not found:
            break
        # beyond the bound the join is shuffled, and adaptive execution splits an image with many pieces
        beside = pieces.join(F.broadcast(trials) if found <= BROADCAST_TRIALS else trials, F.col("image").eqNullSafe(F.col("_image")))
        measured = beside.select("image", "start", "x", "target", "trial").mapInArrow(_measured(width), f"image {kind}, start int, {', '.join(f'{s} double' for s in sums)}")
        total = measured.groupBy("image", "start").agg(*[F.sum(F.col(s).cast("decimal(28, 9)")).cast("double").alias(s) for s in sums])
        last = state.where("active").withColumnsRenamed({"image": "_image", "start": "_start"})
        met = total.join(last, F.col("image").eqNullSafe(F.col("_image")) & (F.col("start") == F.col("_start"))).drop("_image", "_start", "n")
        state = kept(met.mapInArrow(_next(width, names), schema), "fit-state")
        ended.append(state.where("not active"))
    found = reduce(DataFrame.unionAll, ended, state.where("active"))
    best = found.groupBy("image").agg(F.min_by(F.struct("x", "total", "n"), F.struct("loss", "start")).alias("b"))
    fits = best.select("image", F.col("b.x").alias("vector"), (F.col("b.total") / F.col("b.n")).alias("error"), F.col("b.n").cast("long").alias("pixels"), F.lit(None).cast("string").alias("message"))
    lacks = F.when(F.col("missing") > 0, F.concat("missing", F.lit(" pixels lack a channel")))
    bad = counts.where("missing > 0").select("image", F.lit(None).cast("array<double>"), F.lit(None).cast("double"), "n", lacks)
    return kept(raw.where("done").select("image", "vector", "error", F.col("n").alias("pixels"), lacks.alias("message")).unionAll(fits).unionAll(bad), "fits")


def recipe_of(vector: Column) -> Column:
    """The recipe of a vector, as JSON with every key."""
    group = lambda g: F.struct(*[(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.get(vector, F.lit(i)))) * limit).alias(k) for i, (of, k, limit) in enumerate(arrays.SLIDERS) if of == g])
    y, points, room = F.lit(0.0), [F.array(F.lit(0.0), F.lit(0.0))], F.lit(1.0)
    for i, x in enumerate(arrays.CURVE_X):
        # without fractions the line is straight
        fraction = F.coalesce(F.get(vector, F.lit(len(arrays.SLIDERS) + i)), F.lit(arrays.STRAIGHT[i]))
        room = room * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction)))
        y = 1 - room
        points.append(F.array(F.lit(x), y))
    points.append(F.array(F.lit(1.0), F.lit(1.0)))
    return F.when(vector.isNotNull(), F.to_json(F.struct(F.lit(1).alias("schema"), group("white_balance").alias("white_balance"), group("tone").alias("tone"), group("color").alias("color"), F.struct(F.array(*points).alias("points")).alias("tone_curve"))))


def at_bounds(vector: Column, tolerance: float = 0.02) -> Column:
    """The names of the sliders that stand at the end of their range."""
    return F.filter(F.array(*[F.when(F.abs(F.get(vector, F.lit(i))) >= 1 - tolerance, F.lit(name)) for i, (_, name, _) in enumerate(arrays.SLIDERS)]), lambda x: x.isNotNull())


def refit_worst(pixels: DataFrame, fits: DataFrame, chosen: DataFrame, starts: Sequence[float] = MORE_STARTS, curve: bool = True, rounds: int = 30) -> DataFrame:
    """fits with better ones, and `replaced`: the chosen images (a column, image) are searched again from more starts, and a new fit stands only where its error is smaller."""
    some = pixels.join(chosen.select(F.col("image").alias("_image")), F.col("image").eqNullSafe(F.col("_image")), "left_semi")
    again = fit(kept(some, "chosen-pixels"), starts, curve, rounds).select(F.col("image").alias("_image"), F.struct("vector", "error").alias("new"))
    both = fits.join(again, F.col("image").eqNullSafe(F.col("_image")), "left")
    better = F.coalesce(F.col("new.error") < F.col("error"), F.lit(False))
    pick = lambda c: F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    return both.select("image", pick("vector"), pick("error"), "pixels", "message", F.col("_image").isNotNull().alias("searched"), better.alias("replaced"))
