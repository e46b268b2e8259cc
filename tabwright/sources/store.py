"""Tables of runs and data sets, and the artefacts of finished runs, under one folder."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwright.functions.small import local_frame
from tabwright.operators.board import leaderboard
from tabwright.session import remove_path

# What a run's state holds; each change of one of these is an event of its own.
RUN_FIELDS = {
    "dataset_id": "string",
    "status": "string",
    "progress": "double",
    "message": "string",
    "problem_type": "string",
    "best_model": "string",
    "best_score": "double",
    "metrics": "string",
    "config": "string",
}
CHANGE_SCHEMA = "run_id string, field string, value string, seq bigint, writer string, at timestamp"
MANY_FILES = 200
DATASET_SCHEMA = "dataset_id string, path string, profile string, at timestamp"
BOARD_ORDER = "position"


def latest(events: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` per key. Aggregates before the shuffle, so a busy key is no burden."""
    kept = [c for c in events.columns if c not in key]
    newest = events.groupBy(*key).agg(F.max_by(F.struct(*kept), seq).alias("_row"))
    return newest.select(*key, *[F.col(f"_row.{c}").alias(c) for c in kept]).select(*events.columns)


def merged_changes(changes: DataFrame, key: Sequence[str], fields: dict[str, str], order: Sequence[str]) -> DataFrame:
    """One row per key from single changes (key, field, value, ...): each field's last value in ``order``, typed.

    Changes of different fields don't undo each other, whoever wrote them and in whatever order they are read.
    """
    last = changes.groupBy(*key, "field").agg(F.max_by("value", F.struct(*order)).alias("value"))
    wide = last.groupBy(*key).pivot("field", list(fields)).agg(F.first("value"))
    return wide.select(*key, *[F.col(f).cast(kind).alias(f) for f, kind in fields.items()])


class Store:
    """Append-only log of changes and data set list, plus one folder of artefacts per run.

    Several stores may write to one folder: an update writes the fields it changes and reads nothing, so none is lost.
    ``compact`` merges the log's many small files into one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.writer = uuid.uuid4().hex
        self._last = 0

    # Data sets

    def register_dataset(self, path: str, profile: dict) -> str:
        dataset_id = str(uuid.uuid4())
        row = [(dataset_id, path, json.dumps(profile, default=str))]
        added = local_frame(self.spark, row, "dataset_id string, path string, profile string")
        added.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/datasets")
        return dataset_id

    def datasets(self) -> DataFrame:
        return self._table("datasets", DATASET_SCHEMA)

    def dataset(self, dataset_id: str) -> dict | None:
        found = self.datasets().where(F.col("dataset_id") == dataset_id).first()
        return None if found is None else {**found.asDict(), "profile": json.loads(found["profile"])}

    # Runs

    def start_run(self, dataset_id: str = "", config: dict | None = None) -> str:
        run_id = str(uuid.uuid4())
        self.update_run(
            run_id, dataset_id=dataset_id, status="queued", progress=0.0, message="Waiting", config=json.dumps(config or {})
        )
        return run_id

    def update_run(self, run_id: str, **changes) -> None:
        """Append ``changes`` of the run's state, and nothing else."""
        unknown = set(changes) - set(RUN_FIELDS)
        if unknown:
            raise ValueError(f"a run has no field {', '.join(sorted(unknown))}")
        self._last = max(self._last + 1, time.time_ns())
        rows = []
        for field, value in changes.items():
            text = json.dumps(value) if isinstance(value, dict) else value if value is None else str(value)
            rows.append((run_id, field, text, self._last, self.writer))
        added = local_frame(self.spark, rows, "run_id string, field string, value string, seq bigint, writer string")
        added.coalesce(1).withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/runs")

    def run_log(self) -> DataFrame:
        """All changes: run_id, field, value, seq, writer, at."""
        return self._table("runs", CHANGE_SCHEMA)

    def _states(self, changes: DataFrame) -> DataFrame:
        touched = changes.groupBy("run_id").agg(F.max("seq").alias("seq"), F.max("at").alias("at"))
        return merged_changes(changes, ["run_id"], RUN_FIELDS, ["seq", "writer"]).join(touched, "run_id")

    def runs(self) -> DataFrame:
        """The state of every run."""
        return self._states(self.run_log())

    def run(self, run_id: str) -> dict | None:
        found = self._states(self.run_log().where(F.col("run_id") == run_id)).first()
        return None if found is None else found.asDict()

    def current_run(self) -> dict | None:
        """State of the run that was touched last."""
        found = self.run_log().orderBy(F.desc("seq"), "writer").limit(1).first()
        return None if found is None else self.run(found["run_id"])

    def compact(self, more_than: int = 1) -> int:
        """Replace the log's files by one with each run's last changes, if there are ``more_than`` of them.

        Changes that are written meanwhile stay, as only the files read are deleted. The merged file holds the changes
        with their own numbers, so a reader that finds both sees the same states; one that began before the deletion may
        have to begin again. Returns how many files were merged.
        """
        folder, files = self._place("runs")
        if not files.exists(folder):
            return 0
        names = [f.getPath().toString() for f in files.listStatus(folder) if f.getPath().getName().endswith(".parquet")]
        if len(names) <= more_than:
            return 0
        log = self.spark.read.schema(CHANGE_SCHEMA).parquet(*names)
        last = log.groupBy("run_id", "field").agg(F.max_by(F.struct("value", "seq", "writer", "at"), F.struct("seq", "writer")).alias("r"))
        last.select("run_id", "field", "r.*").coalesce(1).write.mode("append").parquet(f"{self.root}/runs")
        for name in names:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(name), False)
        return len(names)

    # Artefacts

    def _artefact(self, run_id: str, name: str) -> str:
        return f"{self.root}/artefacts/{run_id}/{name}"

    def save_model(self, run_id: str, pipeline: PipelineModel) -> str:
        path = self._artefact(run_id, "pipeline")
        pipeline.write().overwrite().save(path)
        return path

    def load_model(self, run_id: str) -> PipelineModel:
        return PipelineModel.load(self._artefact(run_id, "pipeline"))

    # What an ended run goes on from

    def prepared_path(self, run_id: str) -> str:
        return self._artefact(run_id, "prepared")

    def has(self, path: str) -> bool:
        """Whether a table at ``path`` was written to its end."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def save_trained(self, run_id: str, position: int, record: dict, pipeline: PipelineModel) -> None:
        """Journal one trained model. The record comes last: a model without it counts as not trained."""
        path = self._artefact(run_id, f"trained/{position}")
        pipeline.write().overwrite().save(f"{path}/pipeline")
        text = json.dumps(record, default=str)
        local_frame(self.spark, [(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")

    def trained(self, run_id: str, positions: int) -> dict[int, tuple[dict, PipelineModel]]:
        """The journal: records and pipelines of the models trained so far, by position."""
        out = {}
        for i in range(positions):
            path = self._artefact(run_id, f"trained/{i}")
            if self.has(f"{path}/record"):
                out[i] = (json.loads(self.spark.read.text(f"{path}/record").first()["value"]), PipelineModel.load(f"{path}/pipeline"))
        return out

    def forget_journal(self, run_id: str, prepared: bool = False) -> None:
        """Delete the journal of a completed run, and its prepared rows if nothing reads its test part any more."""
        for name in ("trained", "prepared") if prepared else ("trained",):
            remove_path(self.spark, self._artefact(run_id, name))

    def save_report(self, run_id: str, report: dict) -> str:
        path = self._artefact(run_id, "report")
        local_frame(self.spark, [(json.dumps(report, default=str),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(path)
        return path

    def report(self, run_id: str) -> dict:
        return json.loads(self.spark.read.text(self._artefact(run_id, "report")).first()["value"])

    def save_board(self, run_id: str, rows: DataFrame, metric: str) -> str:
        path = self._artefact(run_id, "leaderboard")
        ranked = leaderboard(rows, metric).coalesce(1).withColumn(BOARD_ORDER, F.monotonically_increasing_id())
        ranked.write.mode("overwrite").parquet(path)
        return path

    def board(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self._artefact(run_id, "leaderboard")).orderBy(BOARD_ORDER).drop(BOARD_ORDER)

    def save_importance(self, run_id: str, importance: DataFrame) -> str:
        path = self._artefact(run_id, "importance")
        importance.write.mode("overwrite").parquet(path)
        return path

    def importance(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self._artefact(run_id, "importance")).orderBy(F.desc("importance"), "feature")

    def exports(self, run_id: str) -> dict[str, str]:
        """Artefact folders of a completed run by name."""
        state = self.run(run_id)
        if state is None or state["status"] != "completed":
            return {}
        return {n: self._artefact(run_id, n) for n in ("pipeline", "report", "leaderboard", "importance")}

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _table(self, name: str, schema: str) -> DataFrame:
        place, files = self._place(name)
        if not files.exists(place):
            return local_frame(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
