"""Planning the published paths: which file is copied, replaced, kept, removed or refused."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a path can hold when it is looked at.
ABSENT, REGULAR, DIRECTORY, OTHER = "absent", "regular", "directory", "other"


def actions(pending: DataFrame, current: DataFrame, observed: DataFrame, recovering: bool = False) -> DataFrame:
    """(path_name, action, artifact_sha256) of every pending, current or observed path.

    pending: path_name, artifact_sha256, size_bytes. current: the same and signature. observed: path_name, kind, signature,
    and the observed file's sha256 and size. A path that is managed but was changed is replaced; one that
    is to go must be as it was left. recovering: an earlier run was cut off while it applied the plan.
    """
    p = pending.select("path_name", F.lit(True).alias("p"), F.col("artifact_sha256").alias("p_sha"), F.col("size_bytes").alias("p_size"))
    c = current.select("path_name", F.lit(True).alias("c"), F.col("artifact_sha256").alias("c_sha"), F.col("signature").alias("c_sig"))
    o = observed.select("path_name", F.col("kind").alias("kind"), F.col("signature").alias("o_sig"), F.col("sha256").alias("o_sha"), F.col("size_bytes").alias("o_size"))
    rows = p.join(c, "path_name", "full_outer").join(o, "path_name", "full_outer")
    rows = rows.withColumn("kind", F.coalesce("kind", F.lit(ABSENT)))
    wanted, managed = F.col("p").isNotNull(), F.col("c").isNotNull()
    absent, same_sig = F.col("kind") == ABSENT, (F.col("kind") == REGULAR) & F.col("c_sig").eqNullSafe(F.col("o_sig"))
    same_sha = F.col("p_sha") == F.col("c_sha")
    matches = (F.col("kind") == REGULAR) & (F.col("p_sha") == F.col("o_sha")) & (F.col("p_size") == F.col("o_size"))
    unknown = F.when(F.coalesce(matches, F.lit(False)), "ADOPT_RECOVERED").otherwise("REFUSE_MISMATCH") if recovering else F.lit("REFUSE_UNKNOWN")
    action = (
        F.when(wanted & ~managed & absent, "COPY_NEW")
        .when(wanted & ~managed, unknown)
        .when(wanted & managed & (F.col("kind") == DIRECTORY), "REFUSE_DIRECTORY")
        .when(wanted & managed & same_sha & same_sig, "KEEP")
        .when(wanted & managed & same_sha & (F.col("kind") == OTHER), "REFUSE_NOT_REGULAR")
        .when(wanted & managed, "REPLACE_MANAGED")
        .when(managed & absent, "STALE_GONE")
        .when(managed & same_sig, "DELETE_STALE")
        .when(managed, "REFUSE_CHANGED_STALE")
        .otherwise("UNTOUCHED")
    )
    return rows.select("path_name", action.alias("action"), F.coalesce("p_sha", "c_sha").alias("artifact_sha256"))


def pending_current(pending: DataFrame, current: DataFrame) -> DataFrame:
    """Pending paths with the artifact they hold now, if any."""
    now = current.select("path_name", F.col("artifact_sha256").alias("current_sha256"))
    return pending.select("path_name", "artifact_sha256").join(now, "path_name", "left")


def stale(pending: DataFrame, current: DataFrame) -> DataFrame:
    """Current paths that the pending plan has no more."""
    return current.join(pending.select("path_name"), "path_name", "left_anti").select("path_name", "artifact_sha256")


def collectable(present: DataFrame, *holders: DataFrame) -> DataFrame:
    """Artifacts that no holder (published, active, protected, pending, friendly) needs."""
    rows = present.select("artifact_sha256").distinct()
    for holder in holders:
        rows = rows.join(holder.select("artifact_sha256").distinct(), "artifact_sha256", "left_anti")
    return rows


# --- the phase machine ---------------------------------------------------------------

#: Phases of a projection. Events: begin, append, seal, reconcile, crash (cut off while applying).
OPEN, SEALED, APPLYING, IDLE = "OPEN", "SEALED", "APPLYING", "IDLE"


LOG = "projection string, seq bigint, event string, result string, phase string, current_revision bigint, pending_revision bigint, cursor string"


@dataclass
class Phases:
    """One projection: its phase, what is current, what is pending, and the last key of the pending pages."""

    phase: str = IDLE
    current: int = 0
    current_receipt: str | None = None
    pending: int | None = None
    pending_receipt: str | None = None
    cursor: str | None = None

    def step(self, event: str, revision: int | None, receipt: str | None, key: str | None) -> str:
        """The event's result; a refused event changes nothing."""
        if event == "begin":
            return self._begin(revision, receipt)
        mine = revision is not None and revision == self.pending
        if event == "append":
            if self.phase != OPEN or not mine:
                return "ERROR_PHASE"
            if self.cursor is not None and (key is None or key <= self.cursor):
                return "ERROR_ORDER"
            self.cursor = key
            return "APPENDED"
        if event == "seal":
            if self.phase != OPEN or not mine:
                return "ERROR_PHASE"
            self.phase = SEALED
            return "SEALED"
        if event not in ("reconcile", "crash"):
            return "ERROR_EVENT"
        if self.phase not in (SEALED, APPLYING) or not mine:
            return "ERROR_PHASE"
        if event == "crash":
            self.phase = APPLYING
            return "INTERRUPTED"
        self.phase, self.current, self.current_receipt = IDLE, self.pending, self.pending_receipt
        self.pending = self.pending_receipt = self.cursor = None
        return "INSTALLED"

    def _begin(self, revision: int | None, receipt: str | None) -> str:
        if revision is None or revision < self.current:
            return "ERROR_OLDER"
        if self.phase != IDLE:
            if revision != self.pending:
                return "ERROR_UNFINISHED"
            if receipt != self.pending_receipt:
                return "ERROR_RECEIPT"
            return "SPOOL" if self.phase == OPEN else "RECONCILE"
        if revision == self.current:
            return "COMPLETE" if receipt == self.current_receipt else "ERROR_RECEIPT"
        self.phase, self.pending, self.pending_receipt, self.cursor = OPEN, revision, receipt, None
        return "OPENED"


def timeline(events: DataFrame) -> DataFrame:
    """Fold each projection's events by seq: (projection, seq, event, result, phase, current_revision, pending_revision, cursor).

    events: projection, seq, event, revision, receipt, key. Each event's result hangs on all before it, so a
    projection's events are folded in order, one by one, while sorted batches pass by; a task
    holds a batch and one state, however long the log is.
    """

    def fold(batches):
        name, state = None, Phases()
        for pdf in batches:
            out = []
            for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False):
                if r.projection != name:
                    name, state = r.projection, Phases()
                revision = None if r.revision is None else int(r.revision)
                result = state.step(r.event, revision, r.receipt, r.key)
                out.append((name, int(r.seq), r.event, result, state.phase, state.current, state.pending, state.cursor))
            columns = [part.split()[0] for part in LOG.split(", ")]
            made = pd.DataFrame(out, columns=columns)
            yield made.astype({"current_revision": "Int64", "pending_revision": "Int64"})

    rows = events.select("projection", "seq", "event", "revision", "receipt", "key").repartition("projection")
    return rows.sortWithinPartitions("projection", "seq").mapInPandas(fold, LOG)


def checkpoint(log: DataFrame) -> DataFrame:
    """(projection, phase, current_revision, pending_revision, resume): where a restart goes on."""
    last = F.max(F.struct("seq", "phase", "current_revision", "pending_revision", "cursor")).alias("s")
    rows = log.groupBy("projection").agg(last).select("projection", "s.phase", "s.current_revision", "s.pending_revision", "s.cursor")
    resume = F.when(F.col("phase") == OPEN, "SPOOL").when(F.col("phase").isin(SEALED, APPLYING), "RECONCILE").otherwise("COMPLETE")
    return rows.withColumn("resume", resume)
