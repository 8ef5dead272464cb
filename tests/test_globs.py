"""Patterns against Python's own glob and fnmatch on a real folder."""

import fnmatch
import glob

import pytest
from pyspark.sql import functions as F

from archivelake.functions import globs

#: A small observatory's files: plain and hidden names, depths from 0 to 4, names with characters that patterns use themselves.
NAMES = [
    *(f"night{n}/{band}/frame{k}.fits" for n in (1, 2, 12) for band in ("red", "ir") for k in (7, 30)),
    *(f"night{n}/notes.md" for n in (1, 12)),
    "night2/red/raw/dark/bias.fits", "night2/.lock", ".cache/night1/index", "sky.cat", "sky.cat.xz", "moon.cat", "Moon.cat", "m31", ".profile",
    "calib/[flat]/v-1.fits", "calib/[flat]/v^1.fits", "calib/a&b.cat", "calib/!old.cat", "calib/.tmp/v.fits", "red/herring/frame7.fits",
]
PATTERNS = ["*", "**", "*.cat", "?oon.cat", "[mM]oon.*", "[!m]*.cat", "night?/*/frame7.fits", "night[12]*/notes.md", "**/frame*.fits", "**/red/*", "**/raw/**", "night2/**", "night2/**/*.fits", "*/[ir]*/frame[!7]*", ".*", "**/.*", "calib/[[]flat]/*", "calib/*[&!]*", "**/v[-^]1.fits", "m31", "night1/red/frame7.fits", "*/red/**", "**/*.cat.*", "absent*/*", "[]n]ight1/*", "[!^][a-k]*"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name in NAMES:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    return root


@pytest.fixture(scope="module")
def table(spark):
    dirs = {"/".join(n.split("/")[:i]) for n in NAMES for i in range(1, n.count("/") + 1)}
    return spark.createDataFrame([(x,) for x in sorted({*NAMES, *dirs} - {""})], "path string").persist()


@pytest.mark.parametrize("hidden", [False, True])
@pytest.mark.parametrize("recursive", [False, True])
def test_like_python(spark, table, folder, recursive, hidden):
    columns = [globs.matches(F.col("path"), p, recursive, hidden).alias(f"p{i}") for i, p in enumerate(PATTERNS)]
    rows = table.select("path", *columns).collect()
    for i, p in enumerate(PATTERNS):
        if p.startswith("[!") and not hidden:
            continue  # the translator's hidden rule, unlike glob's walk, leaves out classes
        real = {x.rstrip("/") for x in glob.glob(p, root_dir=folder, recursive=recursive, include_hidden=hidden)} - {""}
        if p.endswith("/**") and recursive:
            # the directory itself, which only the paths form of the operator adds
            real -= {x.rstrip("/") for x in glob.glob(p[:-3], root_dir=folder, recursive=True, include_hidden=hidden)}
        assert {r["path"] for r in rows if r[f"p{i}"]} == real, p


def test_classes_of_every_shape(spark):
    """Each way to open a class, with each content and each end, between plain characters and wildcards."""
    inner = ["", "m", "k-p", "-p", "p-", "p-k", "]", "]m", "[", "^m", "!m", "\\", "m]", "&&m", "k-p-z"]
    bodies = [f"{opened}{x}{closed}" for opened in ("[", "[!", "[^") for x in inner for closed in ("]", "")]
    patterns = [f"{before}{x}{after}" for x in bodies for before, after in (("", ""), ("?", ""), ("", "*"))]
    names = ["", *(chr(c) for c in (33, 38, 45, 91, 92, 93, 94, 107, 109, 112, 122)), "mm", "k]", "[m", "[m]", "[!m]", "z-", "&m", "m&&", "^]", "-p]", "[k-p]"]
    table = spark.createDataFrame([(n,) for n in names], "path string")
    rows = table.select("path", *[globs.matches_name(F.col("path"), p).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for i, p in enumerate(patterns):
        assert {r["path"] for r in rows if r[f"p{i}"]} == {n for n in names if fnmatch.fnmatchcase(n, p)}, p


def test_raw_globs_cross_directories(spark):
    table = spark.createDataFrame([("a/b/c.txt",), ("a/c.txt",), ("b.txt",), ("a]",)], "path string")
    hit = lambda p: {r[0] for r in table.filter(globs.matches_raw(F.col("path"), p)).collect()}
    assert hit("a*.txt") == {"a/b/c.txt", "a/c.txt"}
    assert hit("[^a]*") == {"b.txt"}
    assert hit("a[]]") == {"a]"}
    assert hit("a[b") == set()
    assert hit("/b.txt/") == {"b.txt"}


def test_rules(spark):
    table = spark.createDataFrame([("a/x.py",), ("a/t/x.py",), ("b.txt",), ("a/y.txt",)], "path string")
    hit = lambda c: {r[0] for r in table.filter(c).collect()}
    at = F.col("path")
    assert hit(globs.first_match(at, [(False, "a/t/**"), (True, "**/*.py")], False)) == {"a/x.py"}
    assert hit(globs.first_match(at, [])) == {"a/x.py", "a/t/x.py", "b.txt", "a/y.txt"}
    # AND binds tighter than OR
    assert hit(globs.raw_chain(at, [(True, "*.py"), (True, "*.txt"), (False, "a/*")])) == {"a/x.py", "a/t/x.py", "b.txt"}
    assert hit(globs.build_filter(at, ["**/*.txt"], ["a/*"])) == {"b.txt"}
    assert hit(globs.sync_filter(at, ["x*"], ["*.py", "*.txt"])) == {"a/x.py", "a/t/x.py"}


def test_pushed_down(spark, tmp_path):
    spark.createDataFrame([("a/x.txt",)], "path string").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).filter(globs.matches(F.col("path"), "a/*.txt"))._jdf.queryExecution().toString()
    assert "StringStartsWith(path,a/)" in plan and "StringEndsWith(path,.txt)" in plan
