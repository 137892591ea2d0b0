"""Comparison of response models by course and horizon: a registry, tagged runs, and a keyed store of predictions."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.functions.parsing import sigmoid
from learntrail.operators import estimators as M
from learntrail.operators.evaluation import binary_metrics, roc_auc

PREDICTIONS = "student_id long, item_id long, attempt_id long, y long, p double"
MANIFEST = "course string, model string, horizon long, status string, error string, n long, seconds double, estimate_minutes double"
Model = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Entry:
    """A registered model: observations and a cutoff week to the later answers' chances, and the minutes it is thought to take."""

    name: str
    fit: Model
    minutes: float


REGISTRY: dict[str, Entry] = {}


def model(name: str, minutes: float = 1.0):
    """Register a function ``(observations, cutoff week) -> PREDICTIONS`` that fits on weeks up to the cutoff and predicts the later ones."""

    def add(f: Model) -> Model:
        REGISTRY[name] = Entry(name, f, minutes)
        return f

    return add


def chosen(names: Iterable[str] | None = None, most_minutes: float | None = None) -> list[Entry]:
    """Registered models by name, all if none are named; an unknown name is an error. Those thought to take longer than ``most_minutes`` are left out."""
    names = list(REGISTRY) if names is None else list(names)
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown models {unknown}; known are {sorted(REGISTRY)}")
    return [REGISTRY[n] for n in names if most_minutes is None or REGISTRY[n].minutes < most_minutes]


def cutoffs(obs: DataFrame, wanted: Iterable[int] | None = None) -> list[int]:
    """Cutoff weeks with answers on both sides: those ``wanted``, or all from 1 to the last week but one. Weeks come to the driver."""
    weeks = sorted(r[0] for r in obs.where("week > 0").select("week").distinct().collect())
    if not weeks:
        return []
    return [w for w in (range(1, weeks[-1]) if wanted is None else wanted) if weeks[0] <= w < weeks[-1]]


class Store:
    """Predictions and manifests under ``root``, a folder of any file system that Spark writes; a cell has results once its manifest is there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, course: str, name: str, horizon: int, what: str) -> str:
        return f"{self.root}/{what}/course={course}/model={name}/horizon={horizon}"

    def _file(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def manifest(self, course: str, name: str, horizon: int) -> dict | None:
        system, path = self._file(self.path(course, name, horizon, "manifest") + "/manifest.json")
        if not system.exists(path):
            return None
        return json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])

    def write(self, found: DataFrame, course: str, name: str, horizon: int) -> int:
        """Write a cell's predictions and give their number."""
        path = self.path(course, name, horizon, "predictions")
        found.selectExpr(*[f"CAST({x.split()[0]} AS {x.split()[1]}) AS {x.split()[0]}" for x in PREDICTIONS.split(", ")]).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(PREDICTIONS).parquet(path).count()

    def close(self, row: dict) -> None:
        """Write a cell's manifest, after everything else."""
        system, path = self._file(self.path(row["course"], row["model"], row["horizon"], "manifest") + "/manifest.json")
        out = system.create(path, True)
        out.write(bytearray(json.dumps(row).encode()))
        out.close()

    def manifests(self) -> DataFrame:
        """All cells' MANIFEST rows."""
        return self._read("manifest", lambda r, p: r.schema(MANIFEST).json(p), MANIFEST)

    def predictions(self, names: Iterable[str] | None = None) -> DataFrame:
        """``course, model, horizon`` and PREDICTIONS of all cells whose manifest says ok, of the named models or all."""
        kept = self.manifests().where("status = 'ok'").select("course", "model", "horizon")
        if names is not None:
            kept = kept.where(F.col("model").isin(list(names)))
        rows = self._read("predictions", lambda r, p: r.schema(f"{PREDICTIONS}, course string, model string, horizon long").option("basePath", p).parquet(p), f"{PREDICTIONS}, course string, model string, horizon long")
        return rows.join(F.broadcast(kept), ["course", "model", "horizon"], "left_semi").select("course", "model", "horizon", *[x.split()[0] for x in PREDICTIONS.split(", ")])

    def _read(self, what: str, reader, schema: str) -> DataFrame:
        system, path = self._file(f"{self.root}/{what}")
        if not system.exists(path):
            return self.spark.createDataFrame([], schema)
        return reader(self.spark.read.option("recursiveFileLookup", what == "manifest"), f"{self.root}/{what}")


def run_cell(store: Store, obs: DataFrame, course: str, entry: Entry, horizon: int, seconds: float | None = None) -> dict:
    """One cell's manifest row: that of an earlier run if it succeeded, else a new run's.

    The run's jobs carry the cell as tag; after ``seconds`` they are cancelled. A model that fails or is cancelled gives a row with the error; other cells aren't touched.
    """
    known = store.manifest(course, entry.name, horizon)
    if known and known["status"] == "ok":
        return known
    context, tag = store.spark.sparkContext, f"harness-{course}-{entry.name}-{horizon}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        while not over.wait(0.5):  # a model may begin more jobs
            context.cancelJobsWithTag(tag)

    over, timer = threading.Event(), threading.Timer(seconds, stop) if seconds else None
    row = {"course": course, "model": entry.name, "horizon": horizon, "status": "ok", "error": None, "n": 0, "estimate_minutes": entry.minutes}
    began = time.monotonic()
    context.addJobTag(tag)
    try:
        if timer:
            timer.start()
        row["n"] = store.write(entry.fit(obs, horizon), course, entry.name, horizon)
        if not row["n"]:
            raise ValueError("no answers after the cutoff")
    except Exception as e:
        row |= {"status": "late" if late.is_set() else "error", "error": f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:500], "n": 0}
    finally:
        over.set()
        if timer:
            timer.cancel()
        context.removeJobTag(tag)
    row["seconds"] = round(time.monotonic() - began, 3)
    store.close(row)
    return row


def run(store: Store, obs: DataFrame, names: Iterable[str] | None = None, courses: dict[str, str] | None = None, horizons: Iterable[int] | None = None, seconds: float | None = None, most_minutes: float | None = None) -> list[dict]:
    """Manifest rows of all cells of (course, model, horizon).

    ``courses`` maps a name to a filter of ``obs`` (one course ``all`` if it is not given). Horizons are ``cutoffs`` of the
    course's answers. Cells with results aren't run again, so a run that ended early goes on where it was.
    """
    rows = []
    for course, condition in (courses or {"all": "true"}).items():
        own = obs.where(condition)
        for horizon in cutoffs(own, horizons):
            rows += [run_cell(store, own, course, entry, horizon, seconds) for entry in chosen(names, most_minutes)]
    return rows


def metrics(predictions: DataFrame) -> DataFrame:
    """``course, model, horizon, auc`` and the binary metrics of stored predictions, all cells in one pass each."""
    keys = ["course", "model", "horizon"]
    return binary_metrics(predictions, keys).join(roc_auc(predictions, keys), keys)


def _later(obs: DataFrame, week: int) -> DataFrame:
    return obs.where(F.col("week") > week).select("student_id", "item_id", "attempt_id", "y", "t_days")


def _timed(obs: DataFrame, week: int) -> tuple[DataFrame, DataFrame]:
    """Training answers, and later ones, with the share of the training days that had passed."""
    last = F.broadcast(obs.where(F.col("week") <= week).agg(F.greatest(F.max("t_days"), F.lit(1e-9)).alias("last")))  # one row
    timed = obs.join(last, how="cross").withColumn("t", F.col("t_days") / F.col("last"))
    return timed.where(F.col("week") <= week), timed.where(F.col("week") > week)


def _with(rows: DataFrame, logit) -> DataFrame:
    return rows.select("student_id", "item_id", "attempt_id", "y", sigmoid(logit).alias("p"))


@model("attempt_mean", 0.1)
def attempt_mean(obs: DataFrame, week: int) -> DataFrame:
    """The training mean of all answers of the same attempt number."""
    train = obs.where(F.col("week") <= week)
    rate = train.groupBy("attempt_id").agg(F.avg("y").alias("p"))
    return _later(obs, week).join(F.broadcast(train.agg(F.avg("y").alias("q"))), how="cross").join(rate, "attempt_id", "left").select("student_id", "item_id", "attempt_id", "y", F.coalesce("p", "q").alias("p"))


@model("student_mean", 0.1)
def student_mean(obs: DataFrame, week: int) -> DataFrame:
    """The learner's training mean; that of all learners for one without answers."""
    train = obs.where(F.col("week") <= week)
    rate = train.groupBy("student_id").agg(F.avg("y").alias("p"))
    return _later(obs, week).join(F.broadcast(train.agg(F.avg("y").alias("q"))), how="cross").join(rate, "student_id", "left").select("student_id", "item_id", "attempt_id", "y", F.coalesce("p", "q").alias("p"))


@model("elo", 1)
def elo(obs: DataFrame, week: int) -> DataFrame:
    return M.elo_predictions(obs, week)


@model("irt", 2)
def irt(obs: DataFrame, week: int) -> DataFrame:
    """Learners' abilities; items that training didn't see are of middle difficulty."""
    ability, item = M.rasch(obs.where(F.col("week") <= week).select("student_id", "item_id", "y"))
    return _with(_later(obs, week).join(ability, "student_id", "left").join(M.copied(item), "item_id", "left"), F.coalesce("theta", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))


@model("cirt", 3)
def cirt(obs: DataFrame, week: int) -> DataFrame:
    """Items whose difficulty drifts."""
    train, later = _timed(obs, week)
    trend, level = M.trend_model(train, "item_id", "student_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return _with(later.join(level, "student_id", "left").join(trend, "item_id", "left"), zero("level") + zero("start") + zero("slope") * F.col("t"))


@model("dirt", 3)
def dirt(obs: DataFrame, week: int) -> DataFrame:
    """Learners whose ability grows."""
    train, later = _timed(obs, week)
    trend, level = M.trend_model(train, "student_id", "item_id", many="student_id")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return _with(later.join(trend, "student_id", "left").join(level, "item_id", "left"), zero("level") + zero("start") + zero("slope") * F.col("t"))


@model("bkt", 3)
def bkt(obs: DataFrame, week: int) -> DataFrame:
    return M.bkt_later(obs, week)
