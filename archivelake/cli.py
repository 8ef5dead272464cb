"""A thin command line: python -m archivelake.cli COMMAND ARCHIVE ..."""

from __future__ import annotations

import argparse
import sys
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.formatting import human_size, parse_size
from .functions.globs import directory_pattern
from .operators import layout, listing, lookup, sync
from .plans.archive import Archive
from .sources import trees


class _Rule(argparse.Action):
    """Keeps -i and -x in the order in which they are given."""

    def __call__(self, parser, namespace, value, option=None):
        namespace.rules = [*(namespace.rules or []), (option in ("-i", "--include"), directory_pattern(value))]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="archivelake")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, rules: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("archive")
        for a in arguments:
            c.add_argument(a.rstrip("?"), **({"nargs": "?", "default": ""} if a.endswith("?") else {}))
        if rules:
            c.set_defaults(rules=None)
            c.add_argument("-i", "--include", action=_Rule)
            c.add_argument("-x", "--exclude", action=_Rule)
        return c

    for name in ("create", "add"):
        command(name, "folder", rules=True).add_argument("-s", "--shard-size-limit")
    c = command("extract", "target", rules=True)
    c.add_argument("--path", default="")
    c = command("list", "path?")
    c.add_argument("-l", action="store_true")
    c.add_argument("-R", action="store_true")
    c.add_argument("--jsonl", action="store_true")
    command("cat", "path")
    command("head", "path").add_argument("-n", type=int, default=10)
    c = command("find", "path?")
    for o in ("name", "path-pattern", "type", "size"):
        c.add_argument(f"--{o}")
    c.add_argument("--maxdepth", type=int)
    c.add_argument("--print0", action="store_true")
    c = command("du", "path?")
    c.add_argument("-a", action="store_true")
    c.add_argument("-d", type=int)
    c.add_argument("-s", action="store_true")
    c.add_argument("-H", action="store_true")
    c = command("tree", "path?")
    c.add_argument("-L", type=int)
    c.add_argument("-d", action="store_true")
    command("ncdu", "path?")
    command("lss", "path?")
    command("verify").add_argument("--quick", action="store_true")
    command("gaps")
    command("defrag", "target")
    command("reshard", "target", "limit")
    c = command("merge", "source", rules=True)
    c.add_argument("--prefix", default="")
    c.add_argument("--as-subdirs", action="store_true")
    c.add_argument("--ignore-duplicates", action="store_true")
    c.add_argument("--index-only", action="store_true")
    command("subset", "target", rules=True)
    command("index-to-csv", "target")
    command("convert", "target", rules=True).add_argument("--wrapper", default="")
    command("import", "source", rules=True).add_argument("-s", "--shard-size-limit")
    c = command("sync", "folder")
    c.add_argument("--delete", action="store_true")
    c.add_argument("--update", action="store_true")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--include", action="append", default=[])
    c.add_argument("--exclude", action="append", default=[])
    command("sql", "text")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a, out = parser().parse_args(argv), out or sys.stdout
    spark = spark or SparkSession.builder.appName("archivelake").getOrCreate()
    say = lambda x, end="\n": print(x, end=end, file=out)
    include = [p for keep, p in getattr(a, "rules", None) or [] if keep]
    exclude = [p for keep, p in getattr(a, "rules", None) or [] if not keep]
    if a.command in ("create", "add"):
        limit = parse_size(a.shard_size_limit) if a.shard_size_limit else None
        archive = Archive(spark, a.archive, "x+" if a.command == "create" else "a+", limit)
        archive.add_folder(a.folder, include, exclude)
        return 0
    if a.command == "import":
        Archive.from_packed(spark, a.source, a.archive, parse_size(a.shard_size_limit) if a.shard_size_limit else None, a.rules, not include)
        return 0
    archive = Archive(spark, a.archive, "r+" if a.command in ("merge", "sync") else "r")
    files, dirs = archive.files, archive.dirs
    if a.command == "extract":
        from .functions import globs, paths

        where = globs.first_match(F.col("path"), a.rules or [], not include) & paths.in_subtree(F.col("path"), paths.normalize(a.path) if a.path else "")
        say(archive.extract(a.target, files.filter(where)).count())
    elif a.command == "list":
        if any(c in a.path for c in "*?["):
            rows = listing.glob_entries(files, dirs, a.path, recursive="**" in a.path).orderBy("path")
        else:
            rows = listing.scandir(files, dirs, a.path) if not a.R else lookup.find(archive.entries, a.path, kind="f").orderBy("path")
        rows = rows.drop("shown", "num_subdirs", "num_files", "num_files_tree")
        if a.l and not a.jsonl:
            say(f"total {rows.count()}")
        lines = rows.toJSON().toLocalIterator() if a.jsonl else ("\t".join(map(str, r)) for r in (listing.long_listing(rows) if a.l else rows.select("path")).toLocalIterator())
        for line in lines:
            say(line)
    elif a.command == "cat":
        getattr(out, "buffer", out).write(archive.read(a.path) if hasattr(out, "buffer") else archive.read(a.path).decode())
    elif a.command == "head":
        for line in islice(archive.open(a.path, "rt"), a.n):
            say(line, "" if line.endswith("\n") else "\n")
    elif a.command == "find":
        rows = lookup.find(archive.entries, a.path, a.name, a.path_pattern, a.type, a.size, a.maxdepth).orderBy("path")
        for r in rows.select("shown").toLocalIterator():
            say(r[0], "\0" if a.print0 else "\n")
    elif a.command == "du":
        rows = listing.disk_usage(files, dirs, a.path, a.a, 0 if a.s else a.d)
        for r in rows.withColumn("shown", human_size(F.col("size")) if a.H else F.col("size").cast("string")).toLocalIterator():
            say(f"{r['shown']}\t{r['path'] or '.'}")
    elif a.command == "tree":
        say(a.path or ".")
        for r in listing.tree(files, dirs, a.path, a.L, a.d).toLocalIterator():
            say(r["shown"])
    elif a.command == "verify":
        rows = archive.verify(a.quick).collect()
        for r in rows:
            say(f"{r[0]}: {r[1]}")
        return int(bool(rows))
    elif a.command in ("merge",):
        other = Archive(spark, a.source)
        prefix = sync.subdirectory(a.source) if a.as_subdirs else a.prefix
        if a.index_only:
            archive.attach(other, prefix, a.ignore_duplicates)
        else:
            archive.merge(other, prefix, a.ignore_duplicates, rules=a.rules, default=not include)
    elif a.command in ("defrag", "reshard"):
        archive.rewrite(a.target, parse_size(a.limit) if a.command == "reshard" else None)
    elif a.command == "subset":
        from .functions import globs

        Archive(spark, a.target, "x+", archive.limit).merge(archive, where=globs.first_match(F.col("path"), a.rules or [], not include))
    elif a.command == "index-to-csv":
        trees.write_index_csv(files, a.target)
    elif a.command == "convert":
        say(archive.to_packed(a.target, a.wrapper, rules=a.rules, default=not include))
    elif a.command == "sync":
        options = sync.Options(delete=a.delete, update=a.update, include=a.include, exclude=a.exclude)
        todo = archive.plan_sync(a.folder, options).filter("action in ('add', 'update', 'delete')").orderBy("path").select("action", "path")
        for r in todo.toLocalIterator():
            say(f"{r[0]}\t{r[1]}")
        if not a.dry_run:
            archive.sync(a.folder, options)
    else:
        rows = {"ncdu": lambda: listing.shares(files, dirs, a.path), "lss": lambda: listing.sequences(files, a.path or None), "gaps": lambda: layout.gap_stats(files), "sql": lambda: archive.sql(a.text)}[a.command]()
        for r in rows.toLocalIterator():
            say("\t".join(map(str, r)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
