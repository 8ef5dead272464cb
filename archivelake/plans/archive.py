"""An archive as immutable snapshots: Parquet tables files and dirs, shards, and a manifest that names the current ones.

A change is a transformation of the tables. ``commit`` writes the new tables next to the old and then replaces the manifest in
one rename, so a reader sees the old state or the new one, and a job that fails leaves the old one. What replaces something is
one commit, made after the new contents are written. Old tables stay for readers that still hold them until ``vacuum``; shards
are never written again.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, paths
from ..functions.codecs import Codecs
from ..operators import algebra, integrity, layout, listing, lookup, stats, sync
from ..schema import DIRS, FILE_COLUMNS, FILES, NO_LIMIT, SCHEMA_VERSION, ArchiveError, EntryExists, EntryNotFound
from ..sources import packed, shards, stores, trees

#: Bytes of a new shard, about, where no limit is set: a shard is written by one task.
SHARE = 128 << 20
MODES = {"r", "r+", "w+", "x+", "a+", "ax+"}


class EntryFile(io.BytesIO):
    """An entry's bytes; store, if any, gets them once when the file is closed."""

    def __init__(self, data: bytes, store: Callable[[bytes], None] | None):
        super().__init__(data)
        self.store = store

    def writable(self) -> bool:
        return self.store is not None

    def write(self, data) -> int:
        if self.store is None:
            raise io.UnsupportedOperation("not writable")
        return super().write(data)

    def truncate(self, size: int | None = None) -> int:
        """To size bytes, zeros behind what was there."""
        if self.store is None:
            raise io.UnsupportedOperation("not writable")
        size = self.tell() if size is None else size
        held = len(self.getbuffer())
        if size > held:
            at = self.tell()
            self.seek(held)
            super().write(bytes(size - held))
            self.seek(at)
            return size
        return super().truncate(size)

    def close(self) -> None:
        store, self.store = self.store, None
        if store is not None and not self.closed:
            store(self.getvalue())
        super().close()


class Archive:
    """Opens the archive at root. Modes: r reads; r+ changes; w+ makes a new one, x+ only where there is none; a+ and ax+ only add
    (a+ makes one if there is none)."""

    def __init__(self, spark: SparkSession, root: str, mode: str = "r", shard_size_limit: int | None = None, codecs: Codecs | None = None):
        if mode not in MODES:
            raise ValueError(f"mode {mode!r}")
        self.spark, self.root, self.mode, self.codecs = spark, stores.qualified(spark, root).rstrip("/"), mode, codecs or Codecs(strict=False)
        there = self._exists("manifest.json")
        if mode in ("x+", "ax+") and there:
            raise EntryExists(root)
        if mode in ("r", "r+") and not there:
            raise EntryNotFound(root)
        if mode == "w+" and there:
            self._fs().delete(self._path(""), True)
            there = False
        if there:
            self.manifest = json.loads(self._read("manifest.json"))
            if self.manifest["version"][0] != SCHEMA_VERSION[0]:
                raise ArchiveError(f"version {self.manifest['version']} can't be read")
        else:
            self.manifest = {"version": list(SCHEMA_VERSION), "limit": NO_LIMIT, "tables": None, "shards": {}, "next_shard": 0}
            self.commit(spark.createDataFrame([], FILES))
        if shard_size_limit is not None and shard_size_limit != self.limit:
            self.shard_size_limit = shard_size_limit

    # -- storage

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def _read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """In one step: readers see the old file or the new one."""
        fs, part = self._fs(), f"{name}.{uuid.uuid4().hex}"
        out = fs.create(self._path(part))
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._path(part), self._path(name), options)

    def _may(self, change: bool = False) -> None:
        if self.mode == "r":
            raise PermissionError("the archive is open for reading")
        if change and self.mode in ("a+", "ax+"):
            raise PermissionError("the archive is open for adding")

    def commit(self, files: DataFrame, known_dirs: DataFrame | None = None, shard_uris: dict[int, str] | None = None, next_shard: int | None = None) -> None:
        """Makes files the archive's state: directories are completed and all counts recomputed."""
        name = uuid.uuid4().hex
        files.select(*FILE_COLUMNS).repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{self.root}/{name}/files")
        stored = self.spark.read.schema(FILES).parquet(f"{self.root}/{name}/files")
        stats.complete_dirs(stored, known_dirs).repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{self.root}/{name}/dirs")
        self.manifest = self.manifest | {"tables": name, "shards": {str(k): v for k, v in (self._uris() if shard_uris is None else shard_uris).items()}}
        if next_shard is not None:
            self.manifest["next_shard"] = next_shard
        self._write("manifest.json", json.dumps(self.manifest))

    def _next_shard(self) -> int:
        """The first number that no shard has had, in this snapshot or one before it."""
        return max(self.manifest.get("next_shard", 0), lookup.used_shards(self.files).first()[0])

    def scope(self):
        """For the tables that a change needs on its way."""
        return stores.scope(self.spark, f"{self.root}/scratch")

    def _uris(self) -> dict[int, str]:
        return {int(k): v for k, v in self.manifest["shards"].items()}

    # -- tables

    @property
    def files(self) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(f"{self.root}/{self.manifest['tables']}/files")

    @property
    def dirs(self) -> DataFrame:
        return self.spark.read.schema(DIRS).parquet(f"{self.root}/{self.manifest['tables']}/dirs")

    @property
    def entries(self) -> DataFrame:
        return lookup.entries(self.files, self.dirs)

    def contents(self, files: DataFrame | None = None, check: bool = True) -> DataFrame:
        return shards.read_contents(self.files if files is None else files, f"{self.root}/data", self._uris(), check)

    def extract(self, target: str, files: DataFrame | None = None) -> DataFrame:
        """Writes files (or those given, of this archive) below a folder: path and size of what a run of the result writes. An
        action counts them first, so that tasks have shares of about the same size."""
        files = self.files if files is None else files
        held, n = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        rows = files.repartitionByRange(trees.tasks(self.spark, held, n), "shard", "offset").sortWithinPartitions("shard", "offset")
        return trees.write_folder(rows, target, shards.reader(rows.columns, stores.qualified(self.spark, f"{self.root}/data"), self._uris()))

    @property
    def limit(self) -> int:
        return self.manifest["limit"]

    @property
    def shard_size_limit(self) -> int:
        return self.limit

    @shard_size_limit.setter
    def shard_size_limit(self, limit: int) -> None:
        self._may()
        held = self.files.agg(F.max(F.col("offset") + F.col("size"))).first()[0] or 0
        if held > limit:
            raise ValueError(f"a shard holds {held} bytes already")
        self.manifest["limit"] = limit
        self._write("manifest.json", json.dumps(self.manifest))

    # -- reading

    def read(self, path: str, offset: int = 0, size: int = -1) -> bytes:
        """An entry's bytes, checked against its checksum; of a part only its bytes are read, unchecked."""
        rows = lookup.lookup(self.files, path)
        whole = offset == 0 and size < 0
        found = self.contents(rows) if whole else shards.read_ranges(rows, f"{self.root}/data", offset, size if size >= 0 else NO_LIMIT, self._uris())
        row = found.select("content").first()
        if row is None:
            raise EntryNotFound(path)
        return bytes(row[0])

    def readinto(self, path: str, buffer, offset: int = 0) -> int:
        """Fills a writable buffer with an entry's bytes from offset on; how many there were."""
        view = memoryview(buffer).cast("B")
        data = self.read(path, offset, len(view))
        view[: len(data)] = data
        return len(data)

    def __getitem__(self, path: str):
        try:
            return self.codecs.decode(path, self.read(path))
        except EntryNotFound:
            raise KeyError(path) from None

    def get(self, path: str, default=None):
        try:
            return self[path]
        except KeyError:
            return default

    def __contains__(self, path: str) -> bool:
        return self.isfile(path)

    def isfile(self, path: str) -> bool:
        return not lookup.lookup(self.files, path).isEmpty()

    def isdir(self, path: str) -> bool:
        return not lookup.lookup(self.dirs, path).isEmpty()

    def exists(self, path: str) -> bool:
        return self.isfile(path) or self.isdir(path)

    def __len__(self) -> int:
        return lookup.lookup(self.dirs, "").select("num_files_tree").first()[0]

    @property
    def total_size(self) -> int:
        return lookup.lookup(self.dirs, "").select("size_tree").first()[0]

    def __iter__(self) -> Iterator[str]:
        return (r[0] for r in self.files.select("path").toLocalIterator())

    def keys(self) -> Iterator[str]:
        return iter(self)

    def items(self) -> Iterator[tuple[str, object]]:
        return ((r["path"], self.codecs.decode(r["path"], bytes(r["content"]))) for r in self.contents().select("path", "content").toLocalIterator())

    def values(self) -> Iterator[object]:
        return (v for _, v in self.items())

    def glob(self, pattern: str, recursive: bool = False, include_hidden: bool = False) -> DataFrame:
        return listing.glob_paths(self.files, self.dirs, pattern, recursive, include_hidden)

    def walk(self, root: str = "") -> DataFrame:
        return listing.walk(self.files, self.dirs, root)

    def stat(self, path: str) -> dict:
        """The entry's row; a directory's size is that of its tree."""
        row = lookup.lookup(self.entries, path).first()
        if row is None:
            raise EntryNotFound(path)
        return row.asDict()

    def info(self) -> dict:
        """Totals, and bytes on disk against bytes of files."""
        row = lookup.totals(self.files, self.dirs).first().asDict()
        return row | {"num_shards": lookup.used_shards(self.files).first()[0], "limit": self.limit, "physical_size": sum(self.physical_sizes().values())}

    def physical_sizes(self) -> dict[int, int]:
        """Bytes on disk of each shard that files lie in."""
        known, out = self._uris(), {}
        for (shard,) in self.files.select("shard").distinct().orderBy("shard").toLocalIterator():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(known.get(shard) or shards.shard_uri(f"{self.root}/data", shard))
            out[shard] = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        return out

    def needs_defrag(self) -> bool:
        return sum(self.physical_sizes().values()) > self.total_size

    def usage_json(self) -> str:
        """The nested report that disk-usage browsers read. Children come sorted by directory, so the text grows as they stream."""
        rows = listing.json_tree(self.files, self.dirs)
        below = {r["parent"]: r["children"] for r in rows.toLocalIterator()}

        def nest(path: str, own: str) -> list:
            out = [json.loads(own)]
            for child in below.get(path, []):
                c = json.loads(child)
                inner = f"{path}/{c['name']}" if path else c["name"]
                out.append(nest(inner, child) if c["type"] == "d" else c)
            return out

        return json.dumps([1, 0, {"progname": "archivelake"}, nest("", json.dumps({"name": "/", "asize": self.total_size, "type": "d"}))])

    # -- changes

    def open(self, path: str, mode: str = "r", encoding: str = "utf-8"):
        """A file object of one entry, held in memory: r reads, w and x write, a goes on at the end, + does both; t is text. What
        was written is stored when it is closed."""
        kind, text = mode.replace("b", "").replace("t", ""), "t" in mode
        if kind not in {"r", "r+", "w", "w+", "x", "x+", "a", "a+"}:
            raise ValueError(f"mode {mode!r}")
        there = self.isfile(path)
        if kind[0] == "r" and not there:
            raise EntryNotFound(path)
        if kind[0] == "x" and there:
            raise EntryExists(path)
        data = self.read(path) if there and kind[0] in "ra" else b""
        store = None if kind == "r" else lambda content: self.update(path, content)
        file = EntryFile(data, store)
        if kind[0] == "a":
            file.seek(0, io.SEEK_END)
        return io.TextIOWrapper(file, encoding=encoding) if text else file

    def update(self, path: str, content: bytes) -> None:
        """Another content under the same path; the rest of its metadata stays. The old bytes become a gap. One commit: if the
        new content can't be stored, the old one stays."""
        old = lookup.lookup(self.files, path)
        there = old.select("mode", "uid", "gid", "mtime_ns").first()
        self._may(change=there is not None)
        new = self.spark.createDataFrame([(paths.normalize(path), bytearray(content), *(there or (None,) * 4))], "path string, content binary, mode int, uid int, gid int, mtime_ns long")
        self.add(new, gone=old if there else None)

    def fill_checksums(self) -> None:
        """Computes the checksums of files that have none."""
        new = integrity.checksums(self.contents(self.files.filter("crc32c is null"), check=False))
        self.change(lambda f: algebra.update(f, new))

    def vacuum(self) -> list[str]:
        """Removes shards of its own that no file lies in, and tables of earlier snapshots; the shards' names."""
        self._may(change=True)
        used = {r[0] for r in self.files.select("shard").distinct().toLocalIterator()}
        fs, gone = self._fs(), []
        for status in fs.globStatus(self._path("data-shard-*")) or []:
            name = status.getPath().getName()
            if not name.rpartition("-")[2].isdigit() or int(name.rpartition("-")[2]) not in used:
                fs.delete(status.getPath(), False)
                gone.append(name)
        for status in fs.listStatus(self._path("")):
            name = status.getPath().getName()
            if status.isDirectory() and (name == "scratch" or len(name) == 32 and name != self.manifest["tables"]):
                fs.delete(status.getPath(), True)
        return gone

    def add(self, new: DataFrame, exist_ok: bool = False, gone: DataFrame | None = None) -> None:
        """Adds files (path, content, and any of mode, uid, gid, mtime_ns): written behind what is there, with checksums. gone:
        files (path) that go in the same commit."""
        path = F.regexp_replace(F.regexp_replace("path", "/+", "/"), "^/|/$", "")
        new = new.withColumn("path", path)
        with self.scope():
            rows = new.withColumn("size", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long"))
            self._store(rows.drop("content"), lambda placed: placed.join(new.select("path", "content"), "path"), None, exist_ok, gone)

    def add_folder(self, root: str, include: list[str] | None = None, exclude: list[str] | None = None, exist_ok: bool = False) -> None:
        """Adds a folder's files and directories with their metadata, empty ones too; contents are read once, where shards are
        written. With rules, directories follow from the files."""
        with self.scope():
            tree = stores.stored(trees.read_tree(self.spark, root), "tree")
            files = tree.filter("type = 'f'").filter(globs.build_filter(F.col("path"), include or [], exclude or []))
            found = self.dirs if include or exclude else self._with_dirs(tree.filter("type = 'd'"))
            self._store(files.drop("type"), None, lambda names: trees.reader(names, stores.qualified(self.spark, root)), exist_ok, dirs=found)

    def _with_dirs(self, more: DataFrame) -> DataFrame:
        """dirs and those of more (path and metadata) that are not there."""
        new = more.join(self.dirs.select("path"), "path", "left_anti").select("path", "mode", "uid", "gid", "mtime_ns")
        return self.dirs.unionByName(new, allowMissingColumns=True)

    def _store(self, new: DataFrame, join: Callable | None, fetch: Callable | None, exist_ok: bool = False, gone: DataFrame | None = None, dirs: DataFrame | None = None, order: tuple[str, ...] = ("path",)) -> None:
        """Adds files (path, size and metadata, in a scope), whose contents come from join (placed rows with content) or fetch
        (what adds it to batches of rows with given columns, in the tasks that write). Rows are read once and stored; what can fail does so before
        anything is replaced, which is one commit at the end."""
        self._may()
        kept = self.files if gone is None else stores.stored(self.files.join(gone.select("path"), "path", "left_anti"), "kept")
        new = stores.stored(new, "new")
        new = algebra.check_new(kept, self.dirs, new, exist_ok, self.limit)
        # new shards only: those that are there are never written again
        first = self._next_shard()
        free = self.limit == NO_LIMIT
        placed = layout.place(new, SHARE if free else self.limit, list(order), alone=free)
        made, held, n = placed.agg(F.max("new_shard"), F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        if made is None:
            return self.commit(kept, dirs if dirs is not None else self.dirs)
        placed = placed.withColumns({"shard": (F.col("new_shard") + first).cast("int"), "offset": F.col("new_offset")}).drop("new_shard", "new_offset")
        if fetch:
            sums = shards.write_shards(placed, f"{self.root}/data", fetch(placed.columns), min(made + 1, trees.tasks(self.spark, held, n)))
        else:
            sums = shards.write_shards(join(placed), f"{self.root}/data")
        sums = stores.stored(sums, "checksums")
        rows = placed.select(*[c for c in placed.columns if c in FILE_COLUMNS and c not in ("crc32c", "parent")]).join(sums, "path").withColumn("parent", paths.parent(F.col("path")))
        for field in FILES.fields:
            if field.name not in rows.columns:
                rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
        self.commit(kept.unionByName(rows.select(*FILE_COLUMNS)), dirs if dirs is not None else self.dirs, next_shard=first + made + 1)

    def plan_sync(self, root: str, options: sync.Options | None = None) -> DataFrame:
        """What sync() of a folder would do: path and action, and sizes and times of both sides."""
        return sync.actions(trees.read_folder(self.spark, root, content=False), self.files, options)

    def sync(self, root: str, options: sync.Options | None = None) -> dict[str, int]:
        """Makes the archive like a folder, in one commit; how many files had each action."""
        self._may(change=True)
        with self.scope():
            source = stores.stored(trees.read_folder(self.spark, root, content=False), "source")
            plan = stores.stored(sync.actions(source, self.files, options).select("path", "action"), "plan")
            done = {r[0]: r[1] for r in plan.groupBy("action").count().collect()}
            if {"add", "update", "delete"} & set(done):
                gone = plan.filter("action in ('update', 'delete')")
                new = source.join(plan.filter("action in ('add', 'update')").select("path"), "path", "left_semi").drop("parent")
                self._store(new, None, lambda names: trees.reader(names, stores.qualified(self.spark, root)), gone=gone)
            return done

    def __setitem__(self, path: str, value) -> None:
        data = self.codecs.encode(path, value)
        self.add(self.spark.createDataFrame([(paths.normalize(path), bytearray(data))], "path string, content binary"))

    def setdefault(self, path: str, value):
        if path not in self:
            self[path] = value
        return self[path]

    def change(self, files: Callable[[DataFrame], DataFrame], dirs: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Any transformation of the tables, committed."""
        self._may(change=True)
        self.commit(files(self.files), (dirs or (lambda d: d))(self.dirs))

    def remove(self, path: str) -> None:
        if not self.isfile(path):
            raise EntryNotFound(path)
        self.change(lambda f: f.filter(F.col("path") != paths.normalize(path)))

    def __delitem__(self, path: str) -> None:
        try:
            self.remove(path)
        except EntryNotFound:
            raise KeyError(path) from None

    def rmtree(self, path: str) -> None:
        self.change(lambda f: algebra.remove_tree(f, path), lambda d: algebra.remove_tree(d, path))

    def rmdir(self, path: str) -> None:
        self._may(change=True)
        self.commit(self.files, algebra.remove_dir(self.dirs, path))

    def mkdir(self, path: str, exist_ok: bool = False, **meta: int) -> None:
        """A directory with mode, uid, gid and mtime_ns; of one that is there already these are replaced, if that is allowed."""
        self._may()
        path = paths.normalize(path)
        if self.isfile(path) or self.isdir(path) and not exist_ok:
            raise EntryExists(path)
        new = self.spark.createDataFrame([(path,)], "path string").withColumns({c: F.lit(v).cast("long" if c == "mtime_ns" else "int") for c, v in meta.items()})
        known = algebra.update(self.dirs, new) if meta else self.dirs
        self.commit(self.files, known.unionByName(new.join(self.dirs.select("path"), "path", "left_anti"), allowMissingColumns=True))

    def rename(self, old: str, new: str, overwrite: bool = False) -> None:
        if not self.exists(old):
            raise EntryNotFound(old)
        if self.exists(new):
            if not overwrite:
                raise EntryExists(new)
            keep = ~paths.in_subtree(F.col("path"), paths.normalize(new))
            self.change(lambda f: algebra.rename(f.filter(keep), old, new), lambda d: algebra.rename(d.filter(keep), old, new))
        else:
            self.change(lambda f: algebra.rename(f, old, new), lambda d: algebra.rename(d, old, new))

    def set_meta(self, path: str, **values: int) -> None:
        """mode, uid, gid, mtime_ns of a file, or else a directory."""
        if not self.exists(path):
            raise EntryNotFound(path)
        self.change(lambda f: algebra.set_meta(f, path, **values), lambda d: algebra.set_meta(d, path, **values))

    def attach(self, other: Archive, prefix: str = "", ignore_duplicates: bool = False) -> None:
        """Takes over another archive's index; its shards are referred to where they are."""
        self._may()
        algebra.check_conflicts(other.files, other.dirs, self.files, self.dirs, prefix)
        first, count = lookup.used_shards(self.files).first()[0], lookup.used_shards(other.files).first()[0]
        theirs = {first + i: other._uris().get(i) or shards.shard_uri(f"{other.root}/data", i) for i in range(count)}
        merged = algebra.merge_indexes(self.files, other.files, prefix, ignore_duplicates)
        self.commit(merged, algebra.merge_dirs(self.dirs, other.dirs, prefix), self._uris() | theirs, max(self._next_shard(), first + count))

    def merge(self, other: Archive, prefix: str = "", ignore_duplicates: bool = False, where=None, rules: list[tuple[bool, str]] | None = None, default: bool = True) -> None:
        """Copies another archive's files and directories behind what is there; with a condition or rules (the first that matches
        a path decides) the files that they choose, and no further directories. Contents are read once, at their addresses."""
        chosen = other.files if where is None else other.files.filter(where)
        chosen = chosen.filter(globs.first_match(F.col("path"), rules, default)) if rules else chosen
        part = where is not None or bool(rules)
        no_dirs = other.dirs.limit(0)
        algebra.check_conflicts(chosen, no_dirs if part else other.dirs, self.files, self.dirs, prefix)
        rows = algebra.prefixed(chosen.withColumnsRenamed({"shard": "_shard", "offset": "_offset"}), prefix).drop("parent")

        def fetch(names: list[str]):
            # where a file is, for the reader, and where it goes, for the writer, under the same two names
            theirs = {"_shard": "shard", "_offset": "offset", "shard": "_to", "offset": "_at"}
            ours = {v: k for k, v in theirs.items()}
            read = shards.reader([theirs.get(c, c) for c in names], stores.qualified(self.spark, f"{other.root}/data"), other._uris())

            def both(batches):
                for batch in read(b.rename_columns([theirs.get(c, c) for c in names]) for b in batches):
                    yield batch.rename_columns([ours.get(c, c) for c in batch.schema.names])

            return both

        with self.scope():
            dirs = self.dirs if part else algebra.merge_dirs(self.dirs, other.dirs, prefix)
            self._store(rows, None, fetch, exist_ok=ignore_duplicates, dirs=dirs, order=("_shard", "_offset"))

    def rewrite(self, target: str, limit: int | None = None) -> Archive:
        """A copy without gaps, and with another limit if one is given: defragmentation and resharding."""
        out = Archive(self.spark, target, "w+", shard_size_limit=self.limit if limit is None else limit)
        out.merge(self)
        return out

    def verify(self, quick: bool = False) -> DataFrame:
        """problem and path of all that is wrong. quick: of contents only the last file's."""
        chosen = lookup.last_file(self.files) if quick else self.files
        return integrity.problems(self.files, self.dirs, self.contents(chosen, check=False))

    def views(self) -> None:
        """files, dirs and entries as temporary views for SQL."""
        self.files.createOrReplaceTempView("files")
        self.dirs.createOrReplaceTempView("dirs")
        self.entries.createOrReplaceTempView("entries")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, files=self.files, dirs=self.dirs, entries=self.entries)

    def to_packed(self, target: str, wrapper: str = "", where=None, rules: list[tuple[bool, str]] | None = None, default: bool = True) -> int:
        """One tar or zip file of all entries, or of the files that meet a condition or rules, and all directories."""
        where = globs.first_match(F.col("path"), rules, default) if rules else where
        kind = next(e[1:] for e in (".tar.gz", ".tar.bz2", ".tar.xz", ".tar", ".zip") if target.endswith(e))
        both = self.contents(self.files if where is None else self.files.filter(where)).withColumn("type", F.lit("f")).unionByName(self.dirs.withColumn("type", F.lit("d")), allowMissingColumns=True)
        return packed.write_packed(both, target, kind, wrapper)

    @classmethod
    def from_packed(cls, spark: SparkSession, source: str, root: str, shard_size_limit: int | None = None, rules: list[tuple[bool, str]] | None = None, default: bool = True) -> Archive:
        """An archive of tar or zip files, or of the entries in them that rules choose. Headers are read first, contents once."""
        out = cls(spark, root, "x+", shard_size_limit)
        rows = packed.read_packed(spark, source)
        if rules:
            rows = rows.filter(globs.first_match(F.col("path"), rules, default))
        meta = packed.read_packed(spark, source, content=False)
        meta = meta.filter(globs.first_match(F.col("path"), rules, default)) if rules else meta
        contents = rows.filter("type = 'f'").select("path", "content")
        with out.scope():
            found = out._with_dirs(meta.filter("type = 'd' and path <> ''"))
            out._store(meta.filter("type = 'f'").select("path", "size", "mode", "uid", "gid", "mtime_ns"), lambda placed: placed.join(contents, "path"), None, dirs=found)
        return out


def write_index(spark: SparkSession, index: dict[str, tuple[int, int, int]]) -> DataFrame:
    """The table files of a mapping from path to (shard, offset, size)."""
    return spark.createDataFrame([(p, paths.parent_of(p), *a, None, None, None, None, None) for p, a in index.items()], FILES)


def read_index(files: DataFrame) -> dict[str, tuple[int, int, int]]:
    """The mapping of a small archive."""
    return {r[0]: (r[1], r[2], r[3]) for r in files.select("path", "shard", "offset", "size").collect()}


def destroy(spark: SparkSession, root: str) -> None:
    """Removes an archive; only what has a manifest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(os.path.join(root, "manifest.json"))):
        raise EntryNotFound(root)
    fs.delete(path, True)
