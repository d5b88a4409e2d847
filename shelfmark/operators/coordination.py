"""Runs under a lease: heartbeat, step loop, resident loop and what must hold before and after."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

logger = logging.getLogger("shelfmark")

#: The phases of a run, in order.
PHASES = ("SOURCE", "ANALYSIS", "PUBLICATION", "FINALIZATION")


def phase_checks(steps: DataFrame) -> DataFrame:
    """steps (run, seq, phase) with valid: a step keeps its run's furthest phase so far or goes on to the next.

    Without a column run all steps are those of one run.
    """
    runs = [c for c in steps.columns if c == "run"]
    order = F.array_position(F.array(*[F.lit(p) for p in PHASES]), F.col("phase"))
    before = F.max(order).over(Window.partitionBy(*runs).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    step = order - F.coalesce(before, F.lit(1))
    return steps.withColumn("valid", (order > 0) & step.between(0, 1))


class LeaseLost(RuntimeError):
    """The lease is not ours any more."""


class Lease:
    """One owner at a time; renewals extend, completion frees at once, failure only by running out."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock = seconds, clock
        self._lock, self._generation, self._owner, self._until = threading.Lock(), 0, None, 0.0

    def claim(self, owner: str) -> int | None:
        """A receipt, or None while another owner's lease lives."""
        with self._lock:
            if self._owner is not None and self.clock() <= self._until:
                return None
            self._owner, self._until = owner, self.clock() + self.seconds
            self._generation += 1
            return self._generation

    def _check(self, receipt: int) -> None:
        if receipt != self._generation or self._owner is None or self.clock() > self._until:
            raise LeaseLost("expired or taken over")

    def renew(self, receipt: int) -> int:
        with self._lock:
            self._check(receipt)
            self._until = self.clock() + self.seconds
            return receipt

    def complete(self, receipt: int) -> None:
        with self._lock:
            self._check(receipt)
            self._owner = None


class Session:
    """Calls under a lease. The first failed renewal stays and fails all later calls."""

    def __init__(self, lease: Lease, receipt: int):
        self.lease, self.receipt, self.failure = lease, receipt, None
        self._lock = threading.Lock()

    def _healthy(self) -> None:
        if self.failure is not None:
            raise self.failure

    def renew(self) -> None:
        with self._lock:
            self._healthy()
            try:
                self.receipt = self.lease.renew(self.receipt)
            except Exception as e:
                self.failure = e
                raise

    def call(self, f: Callable):
        """f() with the lock held: one bounded metadata step."""
        with self._lock:
            self._healthy()
            return f()

    def outside(self, f: Callable):
        """f() without the lock, such as a Spark job; a lease lost meanwhile shows afterwards."""
        self._healthy()
        out = f()
        self._healthy()
        return out

    def complete(self) -> None:
        with self._lock:
            self._healthy()
            self.lease.complete(self.receipt)


class Heartbeat:
    """Renews a session every interval until it is left."""

    def __init__(self, session: Session, seconds: float):
        self.session, self.seconds, self._stop = session, seconds, threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self._stop.wait(self.seconds):
            try:
                self.session.renew()
            except Exception as e:
                logger.warning("renewal failed: %s", e)
                return

    def __enter__(self):
        self._thread.start()
        return self

    def __exit__(self, *_):
        self._stop.set()
        self._thread.join()


@dataclass(frozen=True)
class StepResult:
    phase: str
    terminal: bool
    value: object = None


def run_steps(session: Session, phase: str, issue: Callable, prepare: Callable, commit: Callable) -> object:
    """Issue, prepare and commit until a step is terminal: prepare is the Spark job, the others are metadata."""
    while True:
        work = session.call(issue)
        prepared = session.outside(lambda work=work: prepare(work))
        result = session.call(lambda prepared=prepared: commit(prepared))
        if not isinstance(result, StepResult):
            raise TypeError("a step returns a StepResult")
        if result.phase != phase:
            raise RuntimeError(f"a step of {result.phase} in {phase}")
        if result.terminal:
            return result.value


def check_receipts(sealed_source: bool, last_stage: str, phase: str) -> None:
    """What must hold before a run counts as complete."""
    if not sealed_source:
        raise RuntimeError("the source is not sealed")
    if last_stage != "snapshot_manifest":
        raise RuntimeError("the analysis did not end with its snapshot")
    if phase != "FINALIZATION":
        raise RuntimeError("the publication did not reach its end")


def exists(rows: DataFrame) -> bool:
    """Whether there is any row; the scan ends with the first."""
    return rows.limit(1).count() > 0


def bootstrap_preflight(revision: int, publications: int, source_is_empty: bool) -> None:
    """A first publication only: nothing published yet, and something to publish."""
    if revision or publications:
        raise RuntimeError("something is published already")
    if source_is_empty:
        raise RuntimeError("the source is empty")


def preflight_of(revision: int, publications: DataFrame, galleries: DataFrame) -> None:
    """bootstrap_preflight with what the relations hold."""
    bootstrap_preflight(revision, int(exists(publications)), not exists(galleries))


class Resident:
    """Polls for work; scans at once and then every scan interval; after a success it goes on without waiting."""

    def __init__(self, work: Callable[[bool], bool], poll: float, scan: float, clock=time.monotonic, wait: Callable[[float], bool] | None = None):
        self.work, self.poll, self.scan, self.clock = work, poll, scan, clock
        self.stop = threading.Event()
        self.wait = wait or self.stop.wait
        self._next_scan = clock()

    def once(self) -> bool:
        due = self.clock() >= self._next_scan
        if due:
            self._next_scan = self.clock() + self.scan
        done = self.work(due)
        logger.info("turn done=%s scan=%s", done, due)
        return done

    def run(self) -> None:
        while not self.stop.is_set():
            if not self.once() and self.wait(self.poll):
                return


def attempt(lease: Lease, owner: str, preflight: Callable[[], None], service: Callable[[Session], None]) -> bool:
    """One claimed run. A failed preflight gives the lease back; a failed service keeps it until it runs out."""
    receipt = lease.claim(owner)
    if receipt is None:
        return False
    session = Session(lease, receipt)
    try:
        preflight()
    except Exception:
        session.complete()
        raise
    service(session)
    session.complete()
    return True
