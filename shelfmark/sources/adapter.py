"""A frozen tree as bounded pages with cursors.

Every page is read off the written tables by key, with its predicate pushed to them; no page scans a directory. The
cursor after a page is its last key, or None after the last page; tags are paged by their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from shelfmark.functions.codec import locator_payload
from shelfmark.operators.paging import Page, keyset_page, offset_page
from shelfmark.session import written
from shelfmark.sources.tree import FrozenTree, TreeChanged


class SourceAdapter:
    def __init__(self, tree: FrozenTree):
        self.tree = tree
        rows = tree.relation("galleries").withColumn("payload", locator_payload(F.col("locator")))
        self._galleries = written(rows.repartitionByRange("payload").sortWithinPartitions("payload"), "adapter-galleries")
        self._relations: dict[str, DataFrame] = {}

    def _of(self, what: str, locator: list[str]) -> DataFrame:
        if what not in self._relations:
            rows = self.tree.relation(what).withColumn("payload", locator_payload(F.col("locator")))
            self._relations[what] = written(rows.repartitionByRange("payload").sortWithinPartitions("payload"), f"adapter-{what}")
        self.observe_gallery(locator)
        return self._relations[what].where(F.col("payload") == self._payload(locator))

    @staticmethod
    def _payload(locator: list[str]):
        return locator_payload(F.array(*[F.lit(x) for x in locator]))

    def list_galleries(self, after: list[str] | None, limit: int) -> Page:
        """Galleries in the order of their locators; the cursor is a locator."""
        rows = self._galleries
        if after is not None:
            rows = rows.where(F.col("payload") > self._payload(after))
        page = keyset_page(rows, "payload", None, limit)
        if page.terminal:
            return page
        last = page.items.orderBy(F.col("payload").desc()).first()["locator"]
        return Page(page.items, False, list(last))

    def observe_gallery(self, locator: list[str]) -> Row:
        """A gallery's metadata; a locator that the walk did not find is an error."""
        found = self._galleries.where(F.col("payload") == self._payload(locator)).first()
        if found is None:
            raise TreeChanged(f"outside the frozen tree: {locator}")
        return found

    def list_files(self, locator: list[str], after: bytes | None, limit: int) -> Page:
        return keyset_page(self._of("files", locator), "name_bytes", None if after is None else bytearray(after), limit)

    def list_entries(self, locator: list[str], after: bytes | None, limit: int) -> Page:
        return keyset_page(self._of("entries", locator), "name_bytes", None if after is None else bytearray(after), limit)

    def list_tags(self, locator: list[str], after: int | None, limit: int) -> Page:
        """Tags by place; the cursor is the last place of the page."""
        return offset_page(self._of("tags", locator), "ordinal", 0 if after is None else after + 1, limit)
