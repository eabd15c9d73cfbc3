"""The leased job queue and the latest-wins pointer as keyed streaming state.

Events carry their own time; a job's state is one row, and leases are checked
against the event times and, between events, by a processing-time timer.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import classify

JOB = "status string, attempts int, available_ms long, token string, lease_ms long, error string"
CLAIMED = "id long, event string, status string, attempts int, available_ms long, token string, outcome string, seq long"
#: Ids of a block of jobs, and blocks of a group.
BLOCK = 4096
OUTPUT = "id long, event string, status string, attempts int, available_ms long, token string, outcome string"


def step(job: tuple, event: str, at: int, token: str | None, kind: str | None) -> tuple[tuple, str]:
    """One transition of a job: its new state, and ``ok`` or why nothing changed.

    job: status, attempts, available_ms, token, lease_ms, error.
    """
    status, attempts, available, held, lease, error = job
    if event == "enqueue":
        return (job, "known") if status else (("pending", 0, at, None, None, None), "ok")
    if event == "claim":
        if status != "pending" or available > at:
            return job, "not due"
        return ("running", attempts + 1, available, token, at + classify.LEASE * 1000, None), "ok"
    if event == "tick":
        if status != "running" or lease >= at:
            return job, "leased"
        return _back(job, "worker_lost", at), "ok"
    if status != "running" or held != token:
        return job, "lost lease"
    if event == "complete":
        return ("completed", attempts, available, None, None, None), "ok"
    if event == "fail":
        return _back(job, kind, at), "ok"
    return job, "unknown event"


def _back(job: tuple, kind: str, at: int) -> tuple:
    _, attempts, available, *_ = job
    if kind in ("transient", "timeout", "worker_lost") and attempts < classify.MAX_ATTEMPTS:
        wait = classify.FIRST_BACKOFF if attempts <= 1 else classify.LATER_BACKOFF
        return "pending", attempts, at + wait * 1000, None, None, kind
    return "failed", attempts, available, None, None, kind


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "event", "status", "attempts", "available_ms", "token", "outcome"])


def _apply(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """T3-T6 for one job id: its events in order of their time, or the end of its lease."""
    text = lambda x: x if isinstance(x, str) else None
    job = tuple(state.get) if state.exists else (None, 0, 0, None, None, None)
    out = []
    if state.hasTimedOut:
        job, outcome = step(job, "tick", state.getCurrentProcessingTimeMs(), None, None)
        out.append((key[0], "tick", *job[:4], outcome))
    else:
        for e in pd.concat(list(batches)).sort_values(["at_ms", "seq"]).itertuples():
            job, outcome = step(job, e.event, int(e.at_ms), text(e.token), text(e.kind))
            out.append((key[0], e.event, *job[:4], outcome))
    state.update(job)
    if job[0] == "running":  # what is left of its lease, which later events don't make longer
        state.setTimeoutDuration(max(1, job[4] + 1 - state.getCurrentProcessingTimeMs()))
    yield _frame(out)


def jobs(events: DataFrame) -> DataFrame:
    """The outcome of each event of a stream (id, seq, event, at_ms, token, kind); leases end by a processing-time timer.

    As timers are always awaited, the stream runs until it is stopped, or one batch with ``trigger(once=True)``.
    """
    return events.groupBy("id").applyInPandasWithState(_apply, OUTPUT, JOB, "append", GroupStateTimeout.ProcessingTimeTimeout)


class _Lane:
    """A type's jobs while its events are handled: what they touch is read once, and written once at the end.

    ``blocks`` holds BLOCK ids in an entry: which were told, which wait, which
    run. ``groups`` lists the waiting blocks of BLOCK blocks, ``top`` the groups that have some.
    """

    def __init__(self, blocks, groups, top):
        self.stored, self.listed, self.root = blocks, groups, top
        self.blocks: dict[int, list] = {}
        self.groups: dict[int, list[int]] = {}
        self.dirty: set[int] = set()
        self.moved: set[int] = set()
        self.top = list(top.get()[0]) if top.exists() else []
        self.before = list(self.top)

    def block(self, n: int) -> list:
        """The told ids as bits, the waiting jobs (id, available_ms, attempts) by id, and the running ones."""
        if n not in self.blocks:
            row = self.stored.getValue((n,))
            told, pending, running = row if row is not None else (b"", (), ())
            self.blocks[n] = [int.from_bytes(told, "little"), [tuple(j) for j in pending], {j[0]: ("running", *j[1:], None) for j in running}]
        return self.blocks[n]

    def group(self, n: int) -> list[int]:
        if n not in self.groups:
            row = self.listed.getValue((n,))
            self.groups[n] = list(row[0]) if row is not None else []
        return self.groups[n]

    def put(self, id_: int, available: int, attempts: int) -> None:
        n = id_ // BLOCK
        pending = self.block(n)[1]
        if not pending:
            waiting = self.group(n // BLOCK)
            if not waiting:
                bisect.insort(self.top, n // BLOCK)
            bisect.insort(waiting, n)
            self.moved.add(n // BLOCK)
        bisect.insort(pending, (id_, available, attempts))
        self.dirty.add(n)

    def take(self, at: int) -> tuple[int, int, int] | None:
        for g in self.top:
            for n in self.group(g):
                pending = self.block(n)[1]
                i = next((i for i, j in enumerate(pending) if j[1] <= at), None)
                if i is None:
                    continue
                due = pending.pop(i)
                self.dirty.add(n)
                if not pending:
                    self.group(g).remove(n)
                    self.moved.add(g)
                    if not self.group(g):
                        self.top.remove(g)
                return due
        return None

    def save(self) -> None:
        for n in self.dirty:
            told, pending, running = self.blocks[n]
            self.stored.updateValue((n,), (told.to_bytes(BLOCK // 8, "little"), pending, [(i, *j[1:5]) for i, j in running.items()]))
        for n in self.moved:
            if self.groups[n]:
                self.listed.updateValue((n,), (self.groups[n],))
            elif self.listed.containsKey((n,)):
                self.listed.removeKey((n,))
        if self.top != self.before:
            self.root.update((self.top,))


class Claims(StatefulProcessor):
    """T3, O6 on a stream: the jobs of a type; a claim takes the due one with the lowest id.

    Jobs lie in blocks of BLOCK ids, each an entry of a map: a claim looks
    through the blocks in order, and stops at the first due job; other events
    touch one block. A batch reads and writes each block that it touches once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "block long", "told binary, pending array<struct<id: long, available_ms: long, attempts: int>>, running array<struct<id: long, attempts: int, available_ms: long, token: string, lease_ms: long>>")
        self.groups = handle.getMapState("groups", "group long", "waiting array<long>")
        self.top = handle.getValueState("top", "groups array<long>")

    def close(self) -> None:
        pass

    @staticmethod
    def _one(lane: _Lane, e: Row) -> tuple[int | None, tuple, str]:
        if e.event == "claim":
            due = lane.take(e.at_ms)
            if due is None:
                return None, (None,) * 4, "nothing due"
            job, outcome = step(("pending", due[2], due[1], None, None, None), "claim", e.at_ms, e.token, None)
            lane.block(due[0] // BLOCK)[2][due[0]] = job
            return due[0], job[:4], outcome
        n = e.id // BLOCK
        held = lane.block(n)
        if e.event == "enqueue":
            bit = 1 << (e.id - n * BLOCK)
            if held[0] & bit:
                return e.id, (None,) * 4, "known"
            held[0] |= bit
            lane.put(e.id, e.at_ms, 0)
            return e.id, ("pending", 0, e.at_ms, None), "ok"
        if e.id not in held[2]:
            return e.id, (None,) * 4, "lost lease"
        job, outcome = step(held[2][e.id], e.event, e.at_ms, e.token, e.kind)
        if job[0] == "running":
            return e.id, job[:4], outcome
        del held[2][e.id]
        lane.dirty.add(n)
        if job[0] == "pending":
            lane.put(e.id, job[2], job[1])
        return e.id, job[:4], outcome

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        lane = _Lane(self.blocks, self.groups, self.top)
        for e in sorted(rows, key=lambda r: (r.at_ms, r.seq)):
            id_, job, outcome = self._one(lane, e)
            yield Row(id=id_, event=e.event, status=job[0], attempts=job[1], available_ms=job[2], token=job[3], outcome=outcome, seq=e.seq)
        lane.save()


def claimed(events: DataFrame) -> DataFrame:
    """The outcome of each event of a stream (job_type, seq, event, id, at_ms, token, kind): enqueue, claim (without an id), tick, complete, fail.

    A type's events follow one another, as claims of its lowest due job must.
    The end of a lease is a ``tick`` of the job, which its worker's caller sends.
    """
    from .ingest import ROCKSDB

    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.groupBy("job_type").transformWithState(Claims(), CLAIMED, "append", "none")


def latest(requests: DataFrame) -> DataFrame:
    """T7 as a stream: the desired state of each pointer, the latest request by version winning."""
    from pyspark.sql import functions as F

    rest = [c for c in requests.columns if c not in ("repo_id", "pull_request_number")]
    return requests.groupBy("repo_id", "pull_request_number").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("repo_id", "pull_request_number", "r.*")
