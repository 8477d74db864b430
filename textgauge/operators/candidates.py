"""The candidates of agent runs: one ordered fold of each run's events.

Rows are shuffled by run and sorted; a task then walks its rows in order and
carries the state of the run at hand, so what it holds is one run's candidates,
however long the log.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GONE = ("rejected", "rolled_back")


@dataclass
class Candidate:
    kind: str | None
    parent_id: str | None
    status: str = "active"
    observations: int = 0
    added: int = 0


@dataclass
class Run:
    """Candidates of one run, and its latest selection."""

    candidates: dict[str | None, Candidate] = field(default_factory=dict)
    selected: str | None = None
    finalisations: int = 0
    refused: int = 0

    def apply(self, event: str | None, candidate_id: str | None, kind: str | None, parent_id: str | None) -> str | None:
        """Take one event in; what is wrong with it, if anything, and then nothing changes."""
        fault = self._fault(event, candidate_id, parent_id)
        if fault:
            self.refused += 1
            return fault
        own = self.candidates.get(candidate_id)
        if event == "add":
            self.candidates[candidate_id] = Candidate(kind, parent_id or None, added=len(self.candidates))
        elif event == "observe":
            own.observations += 1
        elif event == "reject":
            own.status = "rejected"
        elif event == "rollback":
            own.status = "rolled_back"
        elif event == "finalize":
            before = self.candidates.get(self.selected)
            if before and before.status == "finalized":
                before.status = "active"
            own.status, self.selected, self.finalisations = "finalized", candidate_id, self.finalisations + 1
        return None

    def _fault(self, event: str | None, candidate_id: str | None, parent_id: str | None) -> str | None:
        own = self.candidates.get(candidate_id)
        if event == "add":
            if own:
                return "exists"
            return "unknown_parent" if parent_id and parent_id not in self.candidates else None
        if event not in ("observe", "reject", "rollback", "finalize"):
            return None
        if not own:
            return "unknown"
        if event == "finalize":
            if own.kind != "video":
                return "not_a_video"
            if own.status in GONE:
                return "gone"
        return None


_OUT = ["place", "part", "event", "candidate_id", "kind", "parent_id", "status", "fault", "count", "completed"]


def _rows_of(run: Run) -> Iterator[tuple]:
    """A row for each candidate, in the order of their adding, and one for the run."""
    for name, c in run.candidates.items():
        yield c.added, "candidate", None, name, c.kind, c.parent_id, c.status, None, c.observations, None
    yield None, "run", None, run.selected, None, None, None, None, run.refused, run.finalisations > 0


def folded(events: DataFrame, key: str = "case_id", order: str = "seq") -> DataFrame:
    """All that the fold of an event log tells, as rows of three parts.

    Events have ``key``, ``order``, ``event``, ``candidate_id``; ``place`` orders those
    of one ``order``, ``parent_id`` and ``kind`` count for added candidates.  Without a
    ``kind`` column all are videos.  Parts: ``event`` has each event with its ``fault``
    and the candidate's ``status`` after it; ``candidate`` each added candidate's last
    state, its ``place`` among the run's and its observations as ``count``; ``run`` the
    latest selection, the refused events as ``count``, and whether it is ``completed``.

    Events add, observe, reject, rollback and finalize; others change nothing.
    Refused are: adding what exists, a parent that does not, anything on what was not
    added, and finalising what is no video or was rejected or rolled back.  A
    finalisation makes what was final before active again.  A rolled back selection stays
    the run's selection.  Ties of order and place go by event and candidate.  Rows
    of null ``key`` are one run.
    """
    kinds = dict(events.dtypes)
    given = lambda name, otherwise: F.col(name).cast("string").alias(name) if name in kinds else F.lit(otherwise).cast("string").alias(name)
    place = F.col("place").cast("bigint") if "place" in kinds else F.lit(0).cast("bigint")
    rows = events.select(key, order, place.alias("place"), given("event", None), given("candidate_id", None), given("kind", "video"), given("parent_id", None))
    rows = rows.repartition(key).sortWithinPartitions(key, order, "place", "event", "candidate_id")

    def run(batches):
        now, at, kind = Run(), None, None
        for b in batches:
            kind = b.schema
            out: list[tuple] = []
            for k, o, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at is not None and at[0] != k:
                    out += [(at[0], None, *r) for r in _rows_of(now)]
                    now = Run()
                at = (k,)
                place, event, candidate, what, parent = rest
                fault = now.apply(event, candidate, what, parent)
                own = now.candidates.get(candidate)
                out.append((k, o, place, "event", event, candidate, own.kind if own else what, parent, own.status if own else None, fault, None, None))
            yield _batch(out, kind)
        if at is not None:
            yield _batch([(at[0], None, *r) for r in _rows_of(now)], kind)

    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, place bigint, part string, event string, candidate_id string, kind string, parent_id string, status string, fault string, count bigint, completed boolean"
    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], read: pa.Schema) -> pa.RecordBatch:
    types = [read.field(0).type, read.field(1).type, pa.int64(), *[pa.string()] * 7, pa.int64(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [read.field(0).name, read.field(1).name, *_OUT])


def event_faults(events: DataFrame, key: str = "case_id", order: str = "seq") -> DataFrame:
    """Each event with its ``fault`` and the candidate's ``status`` after it (see ``folded``)."""
    return folded(events, key, order).where("part = 'event'").select(key, order, "place", "event", "candidate_id", "kind", "parent_id", "fault", "status")


def candidate_states(events: DataFrame, key: str = "case_id", order: str = "seq") -> DataFrame:
    """Last state of each candidate that was added: ``state``, kind, parent, observations."""
    out = folded(events, key, order).where("part = 'candidate'")
    return out.select(key, "candidate_id", F.col("status").alias("state"), "kind", "parent_id", F.col("count").alias("observations"))


def selections(events: DataFrame, key: str = "case_id", order: str = "seq") -> DataFrame:
    """Each run's latest selection, refused events, and whether it was completed."""
    out = folded(events, key, order).where("part = 'run'")
    return out.select(key, F.col("candidate_id").alias("final_candidate_id"), "completed", F.col("count").alias("refused"))
