"""Row counts of a job's steps, taken while the job runs."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

_GROUP = "spark.jobGroup.id"


class StepCounts:
    """Counts the rows that pass named steps inside the one job that writes the result.

    ``watch`` marks a step and ``write`` runs the job. Counting is narrow and needs no scan of its
    own. Tasks that ran more than once, say after a lost executor, may have counted their rows
    twice; if any task of the job failed or ran again, the steps are counted anew by scans.
    """

    def __init__(self) -> None:
        self._steps: list[tuple[str, DataFrame, Observation]] = []

    def watch(self, step: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self._steps.append((step, df, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def write(self, df: DataFrame, path: str, **options: str) -> DataFrame:
        """Writes ``df`` as Parquet to ``path``; ``(step, n)`` of the steps in the order watched."""
        context = df.sparkSession.sparkContext
        group, before = f"steps-{uuid.uuid4().hex}", context.getLocalProperty(_GROUP)
        context.setLocalProperty(_GROUP, group)
        try:
            df.write.parquet(path, **options)
        finally:
            context.setLocalProperty(_GROUP, before)
        again = _ran_again(context, group)
        rows = [(step, frame.count() if again else _seen(seen, frame)) for step, frame, seen in self._steps]
        return df.sparkSession.createDataFrame(rows, "step string, n long")


def _seen(seen: Observation, frame: DataFrame) -> int:
    try:
        return int(seen.get["n"])
    except Py4JJavaError:
        # Spark drops a step from the plan whose rows or partner it finds empty: nothing was seen.
        return frame.count()


def _ran_again(context, group: str) -> bool:
    """Whether a task of the group's jobs failed or was run once more, as the status store tells."""
    tracker = context.statusTracker()
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else []:
            s = tracker.getStageInfo(stage)
            if s is not None and (s.currentAttemptId or s.numFailedTasks or s.numCompletedTasks > s.numTasks):
                return True
    return False
