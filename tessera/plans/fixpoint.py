"""Loops over DataFrames: each round's state goes to the checkpoint folder, so plans stay small and lost executors cost a round."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, from spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(df: DataFrame) -> None:
    """Delete the files of a checkpoint, as cut() returned it, that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def repeat(state: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, every: int = 5) -> DataFrame:
    """state after so many rounds, checkpointed after every few; a checkpoint goes when the next is there."""
    before = None
    for i in range(rounds):
        state = step(state)
        if (i + 1) % every == 0 and i + 1 < rounds:
            state = cut(state)
            if before is not None:
                drop(before)
            before = state
    return state


def until_unchanged(state: DataFrame, step: Callable[[DataFrame], DataFrame], most: int | None = None) -> tuple[DataFrame, int]:
    """(state, rounds): step applied until it marks no row as changed; the last, empty round counts. state and step's result have a boolean column changed.

    The checkpoint of a round is deleted when the next is there.
    """
    rounds = 0
    state = cut(state)
    while most is None or rounds < most:
        before, state = state, cut(step(state))
        drop(before)
        rounds += 1
        if state.filter("changed").isEmpty():
            break
    return state.drop("changed"), rounds
