"""Iterative fits over rows that stay in their tasks.

A fit goes in rounds: each task makes a small message of its rows, the messages are merged, and the merged
one takes the fit a step further. Either one barrier stage runs all rounds, its tasks holding their rows
and handing the messages to each other, or each round is a job of its own over persisted rows and the
driver takes the steps. Both run the same code on the same partitions, as many as the rows are worth.

The barrier's own exchange waits a second each time. So tasks use it once, to agree on a new folder in the
shared scratch folder, and exchange the messages as files there.

A lost task restarts the barrier stage from the first round; the rows, and so the outcome, are the same.
"""

from __future__ import annotations

import copy
import pickle
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.sources.scratch import scratch_path, shared_file

# Rows that make a task worth starting.
TASK_ROWS = 20_000
# What a task of a barrier stage may hold, and what one exchange of all its tasks may send.
HELD_BYTES = 256 << 20
SENT_BYTES = 64 << 20
# Messages that are merged on the driver; more are merged in tasks first.
FAN_IN = 64
# Seconds between two looks for a message, at first and at most, and after which a task gives up.
LOOK, LOOK_MOST, PATIENCE = 0.001, 0.05, 1800


class Rounds:
    """A fit in rounds. ``done`` ends it; ``error`` tells why it failed."""

    done = False
    error: str | None = None

    def __init__(self):
        self._since = time.perf_counter()

    def message(self, blocks: Iterable):
        """What the rows of one task add to this round."""
        raise NotImplementedError

    def merge(self, messages: list):
        """One message in place of several."""
        raise NotImplementedError

    def advance(self, merged) -> None:
        raise NotImplementedError

    def outcome(self) -> dict:
        """What the fit has found, in plain values and arrays."""
        raise NotImplementedError

    def take(self, outcome: dict) -> None:
        """Stand where another instance of this fit has come to."""
        raise NotImplementedError

    def rows(self, df: DataFrame) -> DataFrame:
        """The rows that this round needs, for rounds that are jobs."""
        return df

    def lap(self) -> float:
        """Seconds since the last round."""
        now = time.perf_counter()
        since, self._since = self._since, now
        return now - since


def tasks_for(spark: SparkSession, rows: float) -> int:
    """Tasks for about so many rows, no more than the session shuffles to or runs at once."""
    most = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(1, min(most, -(-int(rows) // TASK_ROWS)))


def can_meet(spark: SparkSession, tasks: int) -> bool:
    """Whether all tasks of a stage can run at once, as a barrier stage needs, and share a folder."""
    if tasks == 1:
        return True
    fixed = str(spark.conf.get("spark.dynamicAllocation.enabled", "false")).lower() != "true"
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.master.startswith("local[")
    return bool(fixed and shared and tasks <= spark.sparkContext.defaultParallelism)


def run(rounds: Rounds, rows: DataFrame, load: Callable[[Iterator[pa.RecordBatch]], Iterator], tasks: int,
        held_bytes: float, sent_bytes: float, one_job: bool | None = None) -> Rounds:
    """Take ``rounds`` to its end over ``rows`` in ``tasks`` partitions. ``load`` turns Arrow batches into
    blocks. ``held_bytes`` and ``sent_bytes`` are the sizes of all rows and of a message; what is too much
    for tasks that hold their rows, or a session that cannot run them all at once, goes job by job."""
    spark = rows.sparkSession
    if one_job is None:
        one_job = (can_meet(spark, tasks) and held_bytes <= HELD_BYTES * tasks
                   and sent_bytes * tasks <= SENT_BYTES)
    held = rows.repartition(tasks)
    rounds = _one_job(rounds, held, load, tasks) if one_job else _job_each(rounds, held, load, tasks)
    if rounds.error:
        raise RuntimeError(rounds.error)
    return rounds


class Meeting:
    """The tasks of one attempt of a barrier stage, exchanging messages in a folder."""

    def __init__(self, folder: str, me: int, tasks: int):
        self.me, self.tasks, self.turn = me, tasks, 0
        self.files, self.folder = shared_file(folder, "")
        self.files.create_dir(self.folder, recursive=True)

    def exchange(self, message: bytes) -> list[bytes]:
        """The messages of all tasks in their order."""
        mine = f"{self.folder}{self.turn}-{self.me}"
        with self.files.open_output_stream(f"{mine}.part", compression=None) as out:
            out.write(message)
        self.files.move(f"{mine}.part", mine)  # seen whole or not at all
        found = [message if k == self.me else self._read(f"{self.folder}{self.turn}-{k}") for k in range(self.tasks)]
        if self.turn:  # who has written this turn's message has read those of the last
            self.files.delete_file(f"{self.folder}{self.turn - 1}-{self.me}")
        self.turn += 1
        return found

    def _read(self, path: str) -> bytes:
        wait, until = LOOK, time.monotonic() + PATIENCE
        while time.monotonic() < until:
            try:
                with self.files.open_input_stream(path, compression=None) as f:
                    return f.read()
            except FileNotFoundError:
                time.sleep(wait)
                wait = min(2 * wait, LOOK_MOST)
        raise TimeoutError(f"no message in {path}")


def _one_job(rounds: Rounds, held: DataFrame, load, tasks: int) -> Rounds:
    folder = scratch_path(held.sparkSession, "meeting") if tasks > 1 else ""

    def work(batches):
        blocks, mine, me = list(load(batches)), copy.deepcopy(rounds), 0
        if tasks > 1:
            context = BarrierTaskContext.get()
            me = context.partitionId()
            # A name of this attempt's own: a restarted stage must not find the messages of the last.
            meeting = Meeting(f"{folder}/{context.allGather(uuid.uuid4().hex)[0]}", me, tasks)
        mine.lap()
        while not mine.done:
            message = mine.message(blocks)
            if tasks > 1:
                message = mine.merge([pickle.loads(m) for m in meeting.exchange(pickle.dumps(message))])
            else:
                message = mine.merge([message])
            mine.advance(message)
        if me == 0:
            found = pickle.dumps((mine.error, mine.outcome()))
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["outcome"])

    # Spark runs a failed barrier stage again only where its output is shuffled.
    [row] = held.mapInArrow(work, "outcome binary", barrier=tasks > 1).repartition(1).collect()
    rounds.done = True
    rounds.error, outcome = pickle.loads(row["outcome"])
    rounds.take(outcome)
    return rounds


def _sent(messages: list[tuple[int, bytes]]) -> pa.RecordBatch:
    at, data = zip(*messages) if messages else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], ["at", "message"])


def _merged(rounds: Rounds):
    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["at"].to_pylist(), table["message"].to_pylist()))
        whole = rounds.merge([pickle.loads(m) for _, m in rows])
        return pa.Table.from_batches([_sent([(rows[0][0], pickle.dumps(whole))])])
    return merge


def _job_each(rounds: Rounds, held: DataFrame, load, tasks: int) -> Rounds:
    held = held.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rounds.lap()
        while not rounds.done:
            def part(batches, now=rounds):
                yield _sent([(TaskContext.get().partitionId(), pickle.dumps(now.message(load(batches))))])

            sent = rounds.rows(held).mapInArrow(part, "at int, message binary")
            if tasks > FAN_IN:
                sent = sent.groupBy(F.col("at") % FAN_IN).applyInArrow(_merged(rounds), "at int, message binary")
            rows = sorted((r["at"], bytes(r["message"])) for r in sent.collect())
            rounds.advance(rounds.merge([pickle.loads(m) for _, m in rows]))
    finally:
        held.unpersist()
    return rounds


def run_here(rounds: Rounds, blocks: list) -> Rounds:
    """The same rounds over blocks in this process."""
    while not rounds.done:
        rounds.advance(rounds.merge([rounds.message(blocks)]))
    if rounds.error:
        raise RuntimeError(rounds.error)
    return rounds
