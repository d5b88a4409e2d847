"""Full evaluation of a snapshot, and exact evaluation of a new one on top of an old one.

Each relation is computed when first asked for and written to the scratch folder, so that no plan holds another
one's whole history and lost executors cost no recomputation from the start.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import artifacts, delta, evidence, winners
from shelfmark.schema import Context, Policy, Snapshot
from shelfmark.session import written


class Evaluation:
    """What follows from a snapshot under a policy, evaluated in full."""

    def __init__(self, snapshot: Snapshot, policy: Policy = Policy(), context: Context | None = None, ascii_names: bool = False):
        self.snapshot, self.policy, self.context, self.ascii_names = snapshot, policy, context, ascii_names

    @cached_property
    def evidence(self) -> DataFrame:
        return written(evidence.evidence_digest(self.snapshot), "evidence")

    @cached_property
    def spam(self) -> DataFrame:
        return written(evidence.spam(self.snapshot, self.policy), "spam")

    @cached_property
    def content(self) -> DataFrame:
        return written(winners.effective_content(self.snapshot.galleries, self.snapshot.files, self.spam), "content")

    @cached_property
    def candidates(self) -> DataFrame:
        return written(winners.candidates(self.snapshot, self.content), "candidates")

    @cached_property
    def owners(self) -> DataFrame:
        return written(winners.owners(self.candidates), "owners")

    @cached_property
    def competing(self) -> DataFrame:
        return written(winners.gid_candidates(self.candidates, self.owners), "competing")

    @cached_property
    def winners(self) -> DataFrame:
        return written(winners.winners(self.competing), "winners")

    @cached_property
    def manifests(self) -> DataFrame:
        return written(artifacts.source_manifest(self.snapshot, self.ascii_names), "manifests")

    @cached_property
    def inputs(self) -> DataFrame:
        found = artifacts.artifact_inputs(
            self.snapshot, self.spam, self.content, self.owners, self.winners, self.manifests, self.policy, self.ascii_names
        )
        return written(found, "inputs")


def carry(old: DataFrame, recomputed: DataFrame, workset: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """recomputed rows for the workset; old ones for what is still present outside it."""
    kept = old.join(workset, key, "left_anti").join(present.select(key).distinct(), key, "left_semi")
    return recomputed.unionByName(kept.select(recomputed.columns))


class Step(Evaluation):
    """A new snapshot on top of an old evaluation: only what old evidence, content and groups no longer decide is recomputed."""

    def __init__(self, old: Evaluation, snapshot: Snapshot, policy: Policy | None = None, context: Context | None = None, baseline: Context | None = None):
        super().__init__(snapshot, policy or old.policy, context, old.ascii_names)
        self.old = old
        if old.context is not None and context is not None:
            error = delta.context_error(old.context, baseline or old.context, context, old.policy, self.policy)
        else:
            error = "policy" if self.policy != old.policy else None
        if error:
            raise ValueError(f"{error} changed: evaluate the snapshot in full")

    @cached_property
    def evidence_delta(self) -> DataFrame:
        return written(delta.evidence_delta(self.old.evidence, self.evidence), "evidence-delta")

    @cached_property
    def spam(self) -> DataFrame:
        again = self.evidence_delta.select("sha256")
        occurred = evidence.occurrences(self.snapshot.files).join(again, "sha256", "left_semi")
        verdicts = evidence.classify(occurred, self.snapshot.tags, self.policy)
        return written(carry(self.old.spam, verdicts, again, self.evidence, "sha256"), "spam")

    @cached_property
    def changed_spam(self) -> DataFrame:
        return written(delta.changed_spam(self.old.spam, self.spam), "changed-spam")

    @cached_property
    def impacted(self) -> DataFrame:
        """Galleries that came, went or changed in any fact, or that use a hash whose verdict changed."""
        facts = delta.changed_keys(self.old.manifests, self.manifests, "gallery_key")
        using = evidence.policy_files(self.snapshot.files).join(self.changed_spam, "sha256", "left_semi").select("gallery_key")
        return written(facts.union(using).distinct(), "impacted")

    @cached_property
    def content(self) -> DataFrame:
        some = self.snapshot.galleries.join(self.impacted, "gallery_key", "left_semi")
        files = self.snapshot.files.join(self.impacted, "gallery_key", "left_semi")
        found = winners.effective_content(some, files, self.spam)
        return written(carry(self.old.content, found, self.impacted, self.snapshot.galleries, "gallery_key"), "content")

    @cached_property
    def owner_workset(self) -> DataFrame:
        has = "content_sha256 is not null"
        return written(delta.group_workset(self.old.candidates.where(has), self.candidates.where(has), "content_sha256"), "owner-workset")

    @cached_property
    def owners(self) -> DataFrame:
        found = winners.owners(self.candidates.join(self.owner_workset, "content_sha256", "left_semi"))
        return written(carry(self.old.owners, found, self.owner_workset, self.candidates, "content_sha256"), "owners")

    @cached_property
    def owner_tombstones(self) -> DataFrame:
        return delta.tombstones(self.old.owners, self.owners, "content_sha256")

    @cached_property
    def winner_workset(self) -> DataFrame:
        return written(delta.group_workset(self.old.competing, self.competing, "gid"), "winner-workset")

    @cached_property
    def winners(self) -> DataFrame:
        found = winners.winners(self.competing.join(self.winner_workset, "gid", "left_semi"))
        return written(carry(self.old.winners, found, self.winner_workset, self.competing, "gid"), "winners")

    @cached_property
    def winner_tombstones(self) -> DataFrame:
        return delta.tombstones(self.old.winners, self.winners, "gid")

    @cached_property
    def artifact_delta(self) -> DataFrame:
        return delta.artifact_delta(self.old.inputs, self.inputs)


def stored(snapshot: Snapshot) -> Snapshot:
    """The snapshot read from written tables."""
    return Snapshot(written(snapshot.galleries, "galleries"), written(snapshot.files, "files"), written(snapshot.tags, "tags"))


def sharded_spam(snapshot: Snapshot, policy: Policy, shards: int) -> DataFrame:
    """(sha256, is_spam, shard): the verdict of each shard of hashes; a hash lies in one shard whole."""
    occurred = evidence.occurrences(snapshot.files).repartition(shards, "sha256")
    shard = F.pmod(F.conv(F.substring("sha256", 1, 8), 16, 10).cast("bigint"), F.lit(shards)).cast("int")
    return evidence.classify(occurred, snapshot.tags, policy).withColumn("shard", shard)
