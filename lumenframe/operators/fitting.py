"""Fits of a few parameters per edit over all its pixels: a two by two system per image, start and round.

Pixels are dealt by image into pieces. Images that are one piece, and whole in a task, are fitted there,
many at a time, through all rounds, so their pixels move once. The others, images of any size, are many
rows: every round joins the trial parameters of each image and start to their pieces, and sums J'J, J'r and
the squared residual with partial results. Both ways take the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kept import kept
from .pieces import CHANNELS, TASK_ROWS, dealt, one_type, runs
from .recipe_fit import BROADCAST_TRIALS

STARTS = ((0.05, 0.05), (-0.05, -0.05), (1.0, 0.5))
LOWER, UPPER = np.array([-5.0, -1.0]), np.array([5.0, 1.0])
_RGB = CHANNELS[:3]
_NUMBERS = ("e", "c", "loss", "h11", "h12", "h22", "d1", "d2", "damp", "te", "tc")
_SUMS = ("rr", "s11", "s12", "s22", "s1", "s2")
_STATE = f"image {{}}, start int, {', '.join(f'{n} double' for n in _NUMBERS)}, active boolean"


def _sums(values: np.ndarray, e: np.ndarray, c: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The sums of each image, from the rows of its first one on, at the parameters of each row; derivatives in closed form."""
    terms = dict.fromkeys(_SUMS, 0.0)
    gain = np.exp2(e)
    for k in range(3):
        x = values[:, k] * gain
        i = np.clip(x, 0, 1)
        j2 = i * i * (3 - 2 * i) - i
        j1 = float(np.log(2)) * x * (1 + np.where((x > 0) & (x < 1), c * (6 * x - 6 * x * x - 1), 0.0))
        r = x + c * j2 - values[:, k + 3]
        for name, term in zip(_SUMS, (r * r, j1 * j1, j1 * j2, j2 * j2, j1 * r, j2 * r), strict=True):
            terms[name] = terms[name] + term
    return {name: np.add.reduceat(t, first) for name, t in terms.items()}


def _away(values: np.ndarray, e: np.ndarray, c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sums of absolute residuals over rows and channels."""
    x = values[:, :3] * np.exp2(e)[:, None]
    i = np.clip(x, 0, 1)
    return np.add.reduceat(np.abs(x + c[:, None] * (i * i * (3 - 2 * i) - i) - values[:, 3:]).sum(1), first)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _first_trial(e: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    zero = np.zeros(len(e))
    return {n: zero for n in _NUMBERS} | {"e": e, "c": c, "te": e, "tc": c, "loss": zero + np.inf, "damp": zero + 1e-2}


def _fitted(values: np.ndarray, sizes: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exposure, contrast and error of images whose rows lie end to end: the best of all starts."""
    found = []
    for e, c in STARTS:
        state = _first_trial(np.full(len(sizes), e), np.full(len(sizes), c))
        best, live, rows, here = np.empty((2, len(sizes))), np.arange(len(sizes)), values, sizes
        for _ in range(rounds + 1):
            sums = _sums(rows, np.repeat(state["te"], here), np.repeat(state["tc"], here), _firsts(here))
            state, active = _advanced(state | sums)
            best[:, live] = state["e"], state["c"]
            if not active.all():
                rows, here, live = rows[np.repeat(active, here)], here[active], live[active]
                state = {n: v[active] for n, v in state.items()}
            if not len(live):
                break
        away = _away(values, *np.repeat(best, sizes, 1), _firsts(sizes)) / (3 * sizes)
        found.append((*best, away))
    e, c, away = (np.array(x) for x in zip(*found, strict=True))
    pick = np.argmin(np.where(np.isnan(away), np.inf, away), 0), np.arange(len(sizes))
    return e[pick], c[pick], away[pick]


_RAW = "image {}, values array<double>, missing long, e double, c double, error double, done boolean"


def _dealt(rounds: int):
    """Of images that are whole in their task the fits, of others the pieces."""
    names = ["image", "values", "missing", "e", "c", "error", "done"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, n = None, [], 0

        def fitted() -> pa.RecordBatch:
            known, sizes = [k for k, _ in held], np.array([len(v) for _, v in held])
            values = np.concatenate([v for _, v in held])
            missing = np.add.reduceat(np.isnan(values).any(1).astype(np.int64), _firsts(sizes))
            ok = missing == 0
            e, c, error = (np.full(len(sizes), np.nan) for _ in range(3))
            if ok.any():
                e[ok], c[ok], error[ok] = _fitted(values[np.repeat(ok, sizes)], sizes[ok], rounds)
            columns = [pa.array(x, pa.float64(), mask=~ok) for x in (e, c, error)]
            return pa.RecordBatch.from_arrays([one_type(known, kind), pa.nulls(len(sizes), pa.list_(pa.float64())), pa.array(missing), *columns, pa.array([True] * len(sizes))], names)

        for name, values, whole in runs(batches):
            kind = name.type
            if whole:
                held.append((name, values))
                n += len(values)
                if n >= TASK_ROWS // 4:
                    yield fitted()
                    held, n = [], 0
            else:
                none = pa.nulls(1, pa.float64())
                yield pa.RecordBatch.from_arrays([name, pa.array([values.reshape(-1)], pa.list_(pa.float64())), pa.array([int(np.isnan(values).any(1).sum())]), none, none, none, pa.array([False])], names)
        if held:
            yield fitted()

    return run


def _of_pieces(measure):
    """measure(values, e, c, first) of each piece beside the trials te and tc of an image and start, with its number of rows as n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flat, te, tc in zip(batch.column("values"), batch.column("te").to_pylist(), batch.column("tc").to_pylist(), strict=True):
                values = flat.values.to_numpy(zero_copy_only=False).reshape(-1, 2 * len(_RGB))
                found = measure(values, np.full(len(values), te), np.full(len(values), tc), np.zeros(1, np.int64))
                out.append({name: x[0] for name, x in found.items()} | {"n": float(len(values))})
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("start"), *[pa.array([o[k] for o in out], pa.float64()) for k in out[0]]], ["image", "start", *out[0]])

    return run


def _beside(pieces: DataFrame, trials: DataFrame) -> DataFrame:
    """Every piece beside each start of its image; a null image is an image. Beyond the bound the join is shuffled."""
    trials = trials.withColumnRenamed("image", "_image")
    few = trials.limit(BROADCAST_TRIALS + 1).count() <= BROADCAST_TRIALS
    return pieces.join(F.broadcast(trials) if few else trials, F.col("image").eqNullSafe(F.col("_image"))).select("image", "start", "values", "te", "tc")


def _advanced(old: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Takes each trial if it is better, and the next damped step, cut back to the bounds; done after a step under 1e-7 or at a damping over 1e9."""
    x, trial = np.stack((old["e"], old["c"]), 1), np.stack((old["te"], old["tc"]), 1)
    first = np.isinf(old["loss"])
    small = ~first & (np.abs(trial - x).max(1) < 1e-7)
    better = old["rr"] < old["loss"]
    x = np.where(better[:, None], trial, x)
    loss, h11, h12, h22, d1, d2 = (np.where(better, old[n], old[k]) for n, k in zip(_SUMS, ("loss", "h11", "h12", "h22", "d1", "d2"), strict=True))
    damp = np.where(first, old["damp"], np.where(better, old["damp"] / 3, old["damp"] * 4))
    a, d = h11 + damp * (h11 + 1e-9), h22 + damp * (h22 + 1e-9)
    # a parameter that its bound holds back stays, and the other one is solved alone
    slope = np.stack((d1, d2), 1)
    held = ((x <= LOWER) & (slope > 0)) | ((x >= UPPER) & (slope < 0))
    slope, both = np.where(held, 0.0, slope), np.where(held.any(1), 0.0, h12)
    with np.errstate(all="ignore"):
        det = a * d - both * both
        move = np.stack(((both * slope[:, 1] - d * slope[:, 0]) / det, (both * slope[:, 0] - a * slope[:, 1]) / det), 1)
    usable = np.isfinite(loss) & np.isfinite(move).all(1)
    ahead = np.clip(x + np.where(usable[:, None], move, 0.0), LOWER, UPPER)
    new = (x[:, 0], x[:, 1], loss, h11, h12, h22, d1, d2, damp, ahead[:, 0], ahead[:, 1])
    return dict(zip(_NUMBERS, new, strict=True)), usable & ~small & (damp <= 1e9)


def _next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new, active = _advanced({n: batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in (*_NUMBERS, *_SUMS)})
        yield pa.RecordBatch.from_arrays([batch.column("image"), batch.column("start"), *map(pa.array, new.values()), pa.array(active)], ["image", "start", *_NUMBERS, "active"])


def fit_edits(pixels: DataFrame, rounds: int = 40) -> DataFrame:
    """image, exposure, contrast, error, message: the best of three starts over every pixel.

    The exposure and contrast that turn r, g, b into r2, g2, b2 with the least squared residual, and
    the mean absolute residual. An image with a missing channel is a row with a message.
    """
    kind = pixels.schema["image"].dataType.simpleString()
    raw = kept(dealt(pixels).mapInArrow(_dealt(rounds), _RAW.format(kind)), "dealt")
    pieces = raw.where("not done").select("image", "values")
    # of the images that no task had as a whole: far fewer than pieces or tasks
    images = kept(raw.where("not done").groupBy("image").agg(F.sum("missing").alias("missing")), "fit-images")
    starts = F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.lit(e).alias("te"), F.lit(c).alias("tc")) for i, (e, c) in enumerate(STARTS)]))
    first = images.where("missing = 0").select("image", starts.alias("s")).select("image", "s.start", "s.te", "s.tc")
    unset = {n: F.lit(0.0) for n in _NUMBERS} | {"e": F.col("te"), "c": F.col("tc"), "te": F.col("te"), "tc": F.col("tc"), "loss": F.lit(float("inf")), "damp": F.lit(1e-2)}
    state = kept(first.select("image", "start", *[unset[n].alias(n) for n in _NUMBERS], F.lit(True).alias("active")), "fit-state")
    schema, per = _STATE.format(kind), f"image {kind}, start int, {{}}, n double"
    total = lambda found, *names: found.groupBy("image", "start").agg(*[F.sum(n).alias(n) for n in names]).withColumnsRenamed({"image": "_image", "start": "_start"})
    same = F.col("image").eqNullSafe(F.col("_image")) & (F.col("start") == F.col("_start"))
    ended = []
    for _ in range(rounds + 1):
        live = state.where("active")
        if live.limit(1).count() == 0:
            break
        measured = _beside(pieces, live.select("image", "start", "te", "tc")).mapInArrow(_of_pieces(_sums), per.format(", ".join(f"{n} double" for n in _SUMS)))
        state = kept(live.join(total(measured, *_SUMS), same).drop("_image", "_start").mapInArrow(_next, schema), "fit-state")
        ended.append(state.where("not active"))
    found = reduce(DataFrame.unionAll, ended, state.where("active"))
    off = _beside(pieces, found.select("image", "start", F.col("e").alias("te"), F.col("c").alias("tc"))).mapInArrow(_of_pieces(lambda *at: {"away": _away(*at)}), per.format("away double"))
    errors = found.join(total(off, "away", "n"), same).select("image", "start", "e", "c", (F.col("away") / (3 * F.col("n"))).alias("error"))
    best = errors.groupBy("image").agg(F.min_by(F.struct("e", "c", "error"), F.struct("error", "start")).alias("x"))
    none = F.lit(None).cast("double")
    every = best.select("image", "x.*", F.lit(0).cast("long").alias("missing")).unionAll(images.where("missing > 0").select("image", none, none, none, "missing"))
    every = every.unionAll(raw.where("done").select("image", "e", "c", "error", "missing"))
    lacks = F.when(F.col("missing") > 0, F.concat("missing", F.lit(" pixels lack a channel")))
    return every.select("image", F.col("e").alias("exposure"), (F.col("c") * 100).alias("contrast"), "error", lacks.alias("message"))
