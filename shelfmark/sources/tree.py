"""A Spark data source of gallery trees: galleries, files, entries and tags of a directory.

A directory is a gallery if it directly holds a regular metadata file. Directories are walked depth first without
following links. The upper levels are walked on the driver until there are enough directories to share out,
which are dealt to a bounded number of partitions. Every directory is looked at before and
after its walk, and every file before and after its hash; what changed meanwhile is an error. The tree must
lie at the same path for all executors.

`freeze` walks a tree once and writes what it found; everything else is read off that table, so that later pages
and relations see one tree and scan no directory again.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
from dataclasses import dataclass
from datetime import datetime, timezone
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type

from shelfmark.functions.codec import gallery_key
from shelfmark.operators.audit import STAT
from shelfmark.schema import METADATA_FILE, Snapshot
from shelfmark.session import scratch, written

#: Fixed value: bytes read at a time.
BLOCK = 4 << 20

_STAT = "device decimal(20,0), inode decimal(20,0), size_bytes bigint, modified_ns bigint, changed_ns bigint"
SCHEMAS = {
    "galleries": f"locator array<string>, gid bigint, title string, comment string, upload_account string, upload_time bigint, download_time bigint, modified_time bigint, scan_version int, source_file_count bigint, page_count bigint, {_STAT}",
    "files": f"locator array<string>, name_bytes binary, sha256 string, {_STAT}",
    "entries": f"locator array<string>, name_bytes binary, file_type int, {_STAT}",
    "tags": "locator array<string>, ordinal int, namespace string, value string",
    "discovery": f"locator array<string>, {_STAT}",
}
#: Partitions of a tree's walk at most, and directories that the driver walks before it shares out the rest.
PARTITIONS, FRONTIER = 256, 1_024


class TreeChanged(RuntimeError):
    """The tree is not what it was, or cannot be read as one."""


def facts(value: os.stat_result) -> tuple:
    return value.st_dev, value.st_ino, value.st_size, value.st_mtime_ns, value.st_ctime_ns


def entry_type(mode: int) -> int:
    """0 regular, 1 directory, 2 symbolic link, 3 other."""
    return 0 if stat.S_ISREG(mode) else 1 if stat.S_ISDIR(mode) else 2 if stat.S_ISLNK(mode) else 3


def component(name: str) -> str:
    raw = name.encode("utf-8", "surrogateescape")
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        raise TreeChanged(f"not UTF-8: {name!r}") from None
    if not 1 <= len(raw) <= 255 or name in (".", "..") or "/" in name:
        raise TreeChanged(f"no path component: {name!r}")
    return name


def look(path: str, want: int) -> os.stat_result:
    value = os.lstat(path)
    if entry_type(value.st_mode) != want:
        raise TreeChanged(f"not of the kind that is expected: {path}")
    return value


def walk(directory: str, locator: tuple[str, ...], deep: bool = True):
    """(locator, path, facts) of each gallery at or below directory."""
    before = facts(look(directory, 1))
    found, below = False, []
    with os.scandir(directory) as entries:
        for e in entries:
            if e.name == METADATA_FILE:
                kind = entry_type(e.stat(follow_symlinks=False).st_mode)
                if kind == 2:
                    raise TreeChanged(f"the metadata file is a symbolic link: {e.path}")
                found |= kind == 0
            if e.is_dir(follow_symlinks=False):
                below.append(e.name)
    if found:
        if not locator:
            raise TreeChanged("the root cannot be a gallery")
        yield locator, directory, before
    if deep:
        for name in sorted(below):
            yield from walk(os.path.join(directory, name), (*locator, component(name)))
    if facts(look(directory, 1)) != before:
        raise TreeChanged(f"changed while it was walked: {directory}")


def content_parts(path: str, sha256: str | None = None):
    """The bytes of a regular file, in blocks, if it stays what it is and, where a digest is given, has that digest."""
    fd = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    digest = hashlib.sha256()
    try:
        before = facts(os.fstat(fd))
        if before != facts(look(path, 0)):
            raise TreeChanged(f"changed before it was read: {path}")
        while part := os.read(fd, BLOCK):
            if sha256 is not None:
                digest.update(part)
            yield part
        if facts(os.fstat(fd)) != before:
            raise TreeChanged(f"changed while it was read: {path}")
        if sha256 is not None and digest.hexdigest() != sha256:
            raise TreeChanged(f"not the bytes that were observed: {path}")
    finally:
        os.close(fd)


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    for part in content_parts(path):
        digest.update(part)
    return digest.hexdigest()


def listing(directory: str, before: tuple) -> list[tuple[bytes, os.stat_result]]:
    """Direct entries by name bytes."""
    out = []
    with os.scandir(os.fsencode(directory)) as entries:
        for e in entries:
            out.append((e.name, e.stat(follow_symlinks=False)))
    if facts(look(directory, 1)) != before:
        raise TreeChanged(f"changed while it was listed: {directory}")
    return sorted(out, key=lambda x: x[0])


def micros(text: str) -> int:
    """Microseconds since 1970 of `YYYY-MM-DD HH:MM`, taken as UTC."""
    at = datetime.strptime(text.strip(), "%Y-%m-%d %H:%M").replace(tzinfo=timezone.utc)
    if at.timestamp() < 0:
        raise TreeChanged(f"before 1970: {text}")
    return int(at.timestamp()) * 1_000_000


def parse_metadata(text: str) -> dict:
    """Fields of a metadata file, a field a line; comments run from their heading to the last line."""
    lines = text.split("\n")
    found = {"title": "", "account": "", "upload": 0, "download": 0, "tags": [], "comment": ""}
    for i, line in enumerate(lines):
        head, _, rest = line.partition(":")
        head, rest = head.strip(), rest.strip()
        if head == "Title":
            found["title"] = rest
        elif head == "Upload Time":
            found["upload"] = micros(rest)
        elif head == "Uploaded By":
            found["account"] = rest
        elif head == "Downloaded":
            found["download"] = micros(rest)
        elif head == "Tags":
            pairs = [t.strip().partition(":") for t in rest.split(",") if t.strip()]
            found["tags"] = [(a, c) if b else ("", a) for a, b, c in pairs]
        elif line.strip().startswith("Uploader's Comments"):
            found["comment"] = "\n".join(lines[i + 1 : -1]).strip()
            break
    return found


def gid_of(locator: tuple[str, ...]) -> int:
    """The number that ends the gallery's folder name."""
    digits = re.search(r"([0-9]+)\]?$", locator[-1])
    if not digits or int(digits[1]) <= 0:
        raise TreeChanged(f"no gallery number in {locator[-1]!r}")
    return int(digits[1])


def observe(locator: tuple[str, ...], path: str, before: tuple) -> dict:
    """One gallery as it is: rows of each relation, its metadata read and hashed once more after all files."""
    entries = listing(path, before)
    info = os.path.join(path, METADATA_FILE)
    raw = b"".join(content_parts(info))
    found = parse_metadata(raw.decode("utf-8"))
    regular = [(name, value) for name, value in entries if entry_type(value.st_mode) == 0]
    files = [(name, file_sha256(os.path.join(path, os.fsdecode(name))), *facts(value)) for name, value in regular]
    changed = os.lstat(info).st_mtime_ns // 1000
    if file_sha256(info) != hashlib.sha256(raw).hexdigest():
        raise TreeChanged(f"the metadata changed while its gallery was read: {path}")
    if facts(look(path, 1)) != before:
        raise TreeChanged(f"changed while it was read: {path}")
    metadata = (gid_of(locator), found["title"], found["comment"], found["account"], found["upload"], found["download"], changed, 1, len(regular), len(regular) - 1)
    return {
        "galleries": [(*metadata, *before)],
        "files": files,
        "entries": [(name, entry_type(value.st_mode), *facts(value)) for name, value in entries],
        "tags": [(i, namespace, value) for i, (namespace, value) in enumerate(found["tags"])],
        "discovery": [before],
    }


class Part(InputPartition):
    """Directories to walk: (names below the root, whether to walk below them too)."""

    def __init__(self, directories: list[tuple[tuple[str, ...], bool]]):
        self.directories = directories


class TreeReader(DataSourceReader):
    def __init__(self, root: str, what: str):
        self.root, self.what = root, what

    def partitions(self):
        done, todo = [], [((), True)]
        while todo and len(todo) < PARTITIONS and len(done) < FRONTIER:
            names, _ = todo.pop(0)
            path = os.path.join(self.root, *names)
            list(walk(path, names, deep=False))  # the root must not be a gallery
            with os.scandir(path) as entries:
                below = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
            if names:
                done.append((names, False))
            todo += [((*names, component(n)), True) for n in below]
        every = done + todo
        return [Part(every[i::PARTITIONS]) for i in range(min(PARTITIONS, len(every)))] or [Part([])]

    def read(self, partition):
        for names, deep in partition.directories:
            for locator, path, before in walk(os.path.join(self.root, *names), names, deep):
                rows = [before] if self.what == "discovery" else observe(locator, path, before)[self.what]
                for row in rows:
                    yield (list(locator), *row)


class TreeSource(DataSource):
    """spark.read.format("gallery_tree").option("what", "files").load(root)"""

    @classmethod
    def name(cls):
        return "gallery_tree"

    def schema(self):
        return SCHEMAS[self.options.get("what", "galleries")]

    def reader(self, schema):
        rows = TreeReader(os.path.realpath(self.options["path"]), self.options.get("what", "galleries"))
        return _typed(rows, schema)


def _schema(what: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[what])


def _typed(reader: TreeReader, schema) -> TreeReader:
    places = [i for i, f in enumerate(schema.fields) if f.name in ("device", "inode")]
    plain = reader.read

    def read(partition):
        for row in plain(partition):
            row = list(row)
            for i in places:
                row[i] = Decimal(row[i])
            yield tuple(row)

    reader.read = read
    return reader


def load(spark: SparkSession, root: str, what: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("gallery_tree").option("what", what).load(root)


@dataclass(frozen=True)
class FrozenTree:
    """A tree as one walk found it. observed: a row per gallery with its relations as arrays, written once."""

    root: str
    observed: DataFrame

    def relation(self, what: str) -> DataFrame:
        """The rows of a relation, as `load` has them; no directory is looked at."""
        rows = self.observed.select("locator", F.explode(what).alias("row"))
        return rows.select("locator", "row.*")

    def verify(self) -> None:
        """Look at every gallery again; anything that is not as it was is an error."""
        again = _observed(self.observed.sparkSession, self.root, self.observed.select("locator", F.col("galleries")[0].alias("g")).select("locator", "g.*"))
        digest = [F.xxhash64(F.to_json(F.struct(c))).alias(c) for c in RELATIONS]
        old, new = (df.select(F.array_join("locator", "/").alias("locator"), *digest) for df in (self.observed, again))
        found = old.join(new.toDF("locator", *[f"{c}_again" for c in RELATIONS]), "locator", "full_outer")
        same = [F.col(c).eqNullSafe(F.col(f"{c}_again")) for c in RELATIONS]
        bad = found.where(~reduce(lambda a, b: a & b, same)).select("locator").limit(5).collect()
        if bad:
            raise TreeChanged(f"not as it was: {[r[0] for r in bad]}")
        seen = load(self.observed.sparkSession, self.root, "discovery").select(F.array_join("locator", "/").alias("locator"))
        added = seen.join(old, "locator", "left_anti").limit(5).collect()
        if added:
            raise TreeChanged(f"appeared since: {[r[0] for r in added]}")

    def snapshot(self, scope: str) -> Snapshot:
        """The policy's relations, with stable gallery keys."""
        key = gallery_key(F.lit(scope), F.col("locator")).alias("gallery_key")
        download = F.timestamp_micros("download_time").cast("timestamp_ntz").alias("download_time")
        galleries = self.relation("galleries").select(key, F.element_at("locator", -1).alias("gallery_name"), "gid", "title", download)
        files = self.relation("files").select(key, F.col("name_bytes").cast("string").alias("name"), "sha256", "size_bytes")
        tags = self.relation("tags").select(key, "ordinal", "namespace", "value")
        return Snapshot(galleries, files, tags)


#: The relations that one observation of a gallery yields.
RELATIONS = ("galleries", "files", "entries", "tags")


def _observed(spark: SparkSession, root: str, discovery: DataFrame) -> DataFrame:
    """Each gallery of a discovery with its relations as arrays, if its directory is still the one discovered."""
    shapes = {c: T.StructType(_schema(c).fields[1:]) for c in RELATIONS}
    out = T.StructType([T.StructField("locator", T.ArrayType(T.StringType())), *[T.StructField(c, T.ArrayType(shapes[c])) for c in RELATIONS]])

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                locator, before = tuple(r["locator"]), tuple(int(r[c]) for c in STAT)
                path = os.path.join(root, *locator)
                if facts(look(path, 1)) != before:
                    raise TreeChanged(f"changed since it was discovered: {path}")
                found = observe(locator, path, before)
                arrays = [pa.array([list(locator)], pa.list_(pa.string()))]
                for c in RELATIONS:
                    names = shapes[c].fieldNames()
                    cells = [{n: Decimal(v) if n in ("device", "inode") else v for n, v in zip(names, row)} for row in found[c]]
                    arrays.append(pa.array([cells], pa.list_(to_arrow_type(shapes[c]))))
                yield pa.RecordBatch.from_arrays(arrays, ["locator", *RELATIONS])

    spread = discovery.select("locator", *STAT).repartition(max(1, spark.sparkContext.defaultParallelism * 4), "locator")
    return spread.mapInArrow(rows, out)


def freeze(spark: SparkSession, root: str) -> FrozenTree:
    """Walk a tree once and write it. Locators found twice, and a root that changed meanwhile, are errors."""
    root = os.path.realpath(root)
    before = facts(look(root, 1))
    discovery = written(load(spark, root, "discovery"), "tree-discovery")
    twice = discovery.groupBy("locator").count().where("count > 1").limit(1).collect()
    if twice:
        raise TreeChanged(f"found twice: {twice[0]['locator']}")
    observed = written(_observed(spark, root, discovery), "tree-observed")
    if facts(look(root, 1)) != before:
        raise TreeChanged(f"the root changed while it was walked: {root}")
    return FrozenTree(root, observed)


def snapshot(spark: SparkSession, root: str, scope: str) -> Snapshot:
    """The policy's relations of a tree, all from one walk."""
    return freeze(spark, root).snapshot(scope)


def plant(root: str, galleries: dict[str, dict]) -> None:
    """Write galleries (relative path: title, tags, files) for tests and demonstrations."""
    for path, g in galleries.items():
        folder = os.path.join(root, path)
        os.makedirs(folder, exist_ok=True)
        lines = [f"Title: {g['title']}", "Upload Time: 2024-01-02 03:04", "Uploaded By: someone", "Downloaded: 2024-02-03 04:05", "Tags: " + ", ".join(g["tags"]), "Uploader's Comments", "", "end"]
        with open(os.path.join(folder, METADATA_FILE), "w", encoding="utf-8") as f:
            f.write("\n".join(lines))
        for name, content in g["files"].items():
            with open(os.path.join(folder, name), "wb") as f:
                f.write(content)


def local_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the scratch folder, for what reads and writes folders rather than tables."""
    path = scratch(spark, name)
    if not re.match("file:/|/", path):
        raise RuntimeError("this takes a folder; spark.checkpoint.dir is none")
    return re.sub("^file:/+", "/", path)


def planted(spark: SparkSession) -> FrozenTree:
    """A small tree, written for the purpose and frozen."""
    root = local_folder(spark, "tree")
    plant(root, {
        "nested/1001": {"title": "A title", "tags": ["artist:first", "plain"], "files": {"002.jpg": b"second", "001.jpg": b"first"}},
        "1002": {"title": "B", "tags": [], "files": {"001.jpg": b"first"}},
    })
    os.mkdir(os.path.join(root, "1002/child"))
    os.symlink(os.path.join(root, "nested"), os.path.join(root, "1002/linked"))
    return freeze(spark, root)
