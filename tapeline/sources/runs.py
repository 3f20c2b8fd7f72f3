"""Tables that grow by batches, stored as runs that are put together when read.

A batch writes a run of its own changes. Every eighth run of a level is put together with the seven before it as one
run of the next level, so a row is rewritten once for each power of eight that the number of batches passes and
a table never stands in more than seven runs of a level. Which runs make up the table after batch b follows from b
alone: a retried batch writes the same runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeline.session import exists, folders, remove

FAN = 8
Run = tuple[int, int]                         # first and last batch
Tables = dict[str, DataFrame]


def runs_after(batch: int) -> list[Run]:
    """The runs that make up a table once `batch` is done, oldest and largest first; none for -1."""
    out, first, left, width = [], 0, batch + 1, 1
    while width * FAN <= left:
        width *= FAN
    while left:
        while width > left:
            width //= FAN
        out.append((first, first + width - 1))
        first, left = first + width, left - width
    return out


def _folder(root: str, run: Run) -> str:
    return f"{root}/{run[0]}-{run[1]}"


def _there(spark: SparkSession, root: str) -> list[Run]:
    names = [name.split("-") for name in folders(spark, root)]
    return [(int(n[0]), int(n[1])) for n in names if len(n) == 2 and n[0].isdigit() and n[1].isdigit()]


def _whole(spark: SparkSession, root: str, run: Run) -> bool:
    return exists(spark, f"{_folder(root, run)}/whole")


def newest(spark: SparkSession, root: str) -> int:
    """The last batch of which all runs are there; -1 if there is none."""
    whole = {run for run in _there(spark, root) if _whole(spark, root, run)}
    return max((last for _, last in whole if whole.issuperset(runs_after(last))), default=-1)


def check(spark: SparkSession, root: str, batch: int) -> None:
    """Batch b goes on from all batches before it: a missing run, or a beginning where there are runs already (a
    checkpoint that was reset), is an error and not an empty table."""
    for run in runs_after(batch - 1):
        if not _whole(spark, root, run):
            raise FileNotFoundError(f"the run {_folder(root, run)} is missing")
    if not batch and set(folders(spark, root)) - {"0-0"}:
        raise FileExistsError(f"{root} has versions, but the stream begins anew: its checkpoint was reset")


def read(spark: SparkSession, root: str, name: str, schema: str, runs: list[Run]) -> DataFrame:
    """One of the stored tables, of all these runs."""
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{_folder(root, run)}/{name}" for run in runs])


def _write(spark: SparkSession, root: str, run: Run, tables: Tables) -> None:
    remove(spark, _folder(root, run))
    for name, df in tables.items():
        df.write.parquet(f"{_folder(root, run)}/{name}")
    spark.range(0).write.parquet(f"{_folder(root, run)}/whole")        # last of all: the run counts from here on


def add(spark: SparkSession, root: str, batch: int, tables: Tables, together: Callable[[list[Run]], Tables]) -> None:
    """Write a batch's run and the larger run that it completes; `together` makes the tables of several runs. Runs that
    neither the last FAN states nor this one are made of are deleted, so readers have FAN batches of time."""
    _write(spark, root, (batch, batch), tables)
    larger = runs_after(batch)[-1]
    if larger != (batch, batch):
        parts = [run for run in runs_after(batch - 1) if run[0] >= larger[0]]
        _write(spark, root, larger, together([*parts, (batch, batch)]))
    kept = {run for b in range(max(0, batch - FAN), batch + 1) for run in runs_after(b)} | {(batch, batch)}
    for run in set(_there(spark, root)) - kept:
        remove(spark, _folder(root, run))
