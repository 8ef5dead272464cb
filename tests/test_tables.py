"""Roll-ups, layout, algebra and sync against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from archivelake.functions import formatting, paths
from archivelake.functions.checksums import crc32c, crc32c_rows
from archivelake.operators import algebra, layout, listing, lookup, stats, sync
from archivelake.schema import FILES, DirectoryNotEmpty, EntryExists, EntryNotFound, FileTooLarge, MergeConflict, NotADirectory


def make(spark, rows):
    """files of (path, shard, offset, size)."""
    return spark.createDataFrame([(p, paths.parent_of(p), s, o, n, None, None, None, None, 1) for p, s, o, n in rows], FILES)


def tree(rows):
    out = {}
    for path, *_, size in rows:
        for a in paths.ancestors_of(path)[:-1]:
            n, b = out.get(a, (0, 0))
            out[a] = n + 1, b + size
    return out


ROWS = [("a.txt", 0, 0, 5), ("b.txt", 0, 5, 5), ("dir/c.txt", 0, 10, 3), ("dir/sub/d.txt", 1, 0, 7), ("dir.x/e", 1, 20, 0)]


def test_golden_counts(spark):
    dirs = {r["path"]: r for r in stats.complete_dirs(make(spark, ROWS)).collect()}
    assert {k: (r["num_files_tree"], r["size_tree"]) for k, r in dirs.items()} == tree(ROWS)
    assert (dirs[""]["num_subdirs"], dirs[""]["num_files"], dirs[""]["parent"]) == (2, 2, None)
    assert (dirs["dir"]["num_subdirs"], dirs["dir"]["num_files"]) == (1, 1)


def test_empty_tables(spark):
    files = make(spark, [])
    dirs = stats.complete_dirs(files)
    assert [tuple(r)[:6] for r in dirs.collect()] == [("", None, 0, 0, 0, 0)]
    assert layout.gaps(files).count() == layout.islands(files).count() == stats.index_problems(files, dirs).count() == 0
    assert layout.place(files, 10, ["path"]).count() == 0
    assert layout.outlier_threshold(files).first()[0] is None


def test_differences_equal_recomputation(spark):
    random.seed(1)
    rows = [("/".join(random.choices("abc", k=random.randint(1, 4))) + f"/{i}", 0, 0, random.randint(0, 9)) for i in range(60)]
    before, gone, new = rows[:40], rows[:10], rows[40:]
    dirs = stats.complete_dirs(make(spark, before))
    after = stats.apply_changes(dirs, make(spark, new), make(spark, gone))
    real = stats.complete_dirs(make(spark, rows[10:]), dirs)
    columns = ["path", *stats.STATS]
    assert sorted(map(tuple, after.select(columns).collect())) == sorted(map(tuple, real.select(columns).collect()))


def test_problems_are_found(spark):
    files = make(spark, [*ROWS, ("dir", 2, 0, 1), ("a.txt", 3, 0, 1)])
    dirs = stats.complete_dirs(make(spark, ROWS)).filter("path <> 'dir/sub'")
    found = {tuple(r) for r in stats.index_problems(files, dirs).collect()}
    assert {("no parent", "dir/sub/d.txt"), ("file and directory", "dir"), ("path twice", "a.txt"), ("stale counts", "")} <= found


@pytest.mark.parametrize("seed,limit,alone,chunk,few", [(1, 30, 1000, 16, 64), (2, 50, 1000, 16, 64), (3, 1000, 1000, 16, 64), (4, 30, 0, 2, 0), (5, 45, 0, 1, 0), (6, 300, 0, 16, 64), (7, 5000, 0, 16, 64)])
def test_next_fit(spark, monkeypatch, seed, limit, alone, chunk, few):
    """In one task, in chunks that begin from guesses, and with each shard's end looked up."""
    for name, value in (("ALONE", alone), ("CHUNK", chunk), ("FEW", few)):
        monkeypatch.setattr(layout, name, value)
    random.seed(seed)
    rows = [(f"{i:04}", 0, i, random.choice([0, 1, 5, 10, 30])) for i in range(300)]
    got = {r["path"]: (r["new_shard"], r["new_offset"]) for r in layout.place(make(spark, rows), limit, ["offset"]).collect()}
    shard = at = 0
    for path, _, _, size in rows:
        if at + size > limit:
            shard, at = shard + 1, 0
        assert got[path] == (shard, at), path
        at += size


def test_next_fit_of_equal_files_takes_few_jobs(spark, monkeypatch):
    """Layouts of equal files never meet: nothing may hang on that they do."""
    for name, value in (("ALONE", 0), ("CHUNK", 1), ("FEW", 0)):
        monkeypatch.setattr(layout, name, value)
    files = make(spark, [(f"{i:04}", 0, 7 * i, 7) for i in range(1000)])
    spark.sparkContext.setJobGroup("equal files", "")
    try:
        got = {tuple(r) for r in layout.place(files, 100, ["offset"]).select("path", "new_shard", "new_offset").collect()}
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("equal files")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(f"{i:04}", i // 14, 7 * (i % 14)) for i in range(1000)} and len(jobs) < 40


@pytest.mark.parametrize("alone,few", [(1000, 64), (0, 0), (0, 64)])
def test_large_files_alone(spark, monkeypatch, alone, few):
    for name, value in (("ALONE", alone), ("CHUNK", 1), ("FEW", few)):
        monkeypatch.setattr(layout, name, value)
    rows = [(f"{i:02}", 0, i, size) for i, size in enumerate([50, 3, 4, 5, 60, 70, 0, 10, 1])]
    got = {r["path"]: (r["new_shard"], r["new_offset"]) for r in layout.place(make(spark, rows), 10, ["offset"], alone=True).collect()}
    # an empty file stays behind the large one before it only if that is within the limit
    shard = at = 0
    for path, _, _, size in rows:
        if at and at + size > 10:
            shard, at = shard + 1, 0
        assert got[path] == (shard, at), path
        at += size


def test_too_large(spark):
    with pytest.raises(FileTooLarge):
        layout.place(make(spark, ROWS), 6, ["path"])


def test_gaps_islands_and_copies(spark):
    files = make(spark, [("a", 0, 2, 3), ("b", 0, 5, 5), ("z", 0, 7, 0), ("c", 0, 20, 1), ("d", 1, 0, 4)])
    assert sorted(map(tuple, layout.gaps(files).collect())) == [(0, 0, 2), (0, 10, 10)]
    assert sorted(map(tuple, layout.gaps(files, 25).collect())) == [(0, 0, 2), (0, 10, 10), (0, 21, 4), (1, 4, 21)]
    plan = layout.defrag_plan(files.filter("path <> 'z'"), 100)
    assert {r["path"]: (r["new_shard"], r["new_offset"]) for r in plan.collect()} == {"a": (0, 0), "b": (0, 3), "c": (0, 8), "d": (0, 9)}
    assert sum(r["size"] for r in layout.copies(plan).collect()) == 13
    assert layout.defrag_quick(files.filter("path <> 'z'")) == [("d", 0, 10), ("c", 0, 0), ("a", 0, 1), ("b", 0, 4)]
    files = files.filter("path <> 'z'")
    assert layout.find_space_for(files, "b", 15, 100) == (0, 5) and layout.find_space_for(files, "a", 9, 100) == (0, 10)
    assert layout.find_space_for(files, "a", 90, 100) == (1, 4) and layout.find_space_for(files, "a", 99, 100) == (2, 0)


def test_quick_defrag_leaves_a_sound_layout(spark):
    """Moves one by one: none overlaps a file, none goes up, freed places are used again, and a budget of no time moves little."""
    r = random.Random(3)
    rows, at = [], 0
    for i in range(120):
        at += r.choice([0, 0, 5, 40])
        size = r.choice([1, 3, 8, 20, 60])
        rows.append((f"{i:03}", at // 800, at % 800, size))
        at += size
        if at // 800 != (at - size) // 800:
            at = (at // 800 + 1) * 800
    files = make(spark, rows)
    place = {p: (s, o, n) for p, s, o, n in rows}
    moves = layout.defrag_quick(files)
    for path, shard, offset in moves:
        old, size = place[path][:2], place[path][2]
        assert (shard, offset) < old
        assert not any(s == shard and offset < o + n and o < offset + size for p, (s, o, n) in place.items() if p != path), path
        place[path] = (shard, offset, size)
    end = lambda x: max((s, o + n) for s, o, n in x)
    assert len(moves) > 10 and end(place.values()) < end((s, o, n) for _, s, o, n in rows)
    assert layout.defrag_quick(files, seconds=0) == []


def test_quick_defrag_passes_over_many_small_gaps(spark):
    """Each file of the tail fits only behind all the small gaps; looking at each of these for each file takes minutes."""
    import time

    n = 40000
    front = spark.range(n).selectExpr("concat('a', id) as path", "0 as shard", "id * 3 + 1 as offset", "2L as size")
    back = spark.range(n).selectExpr("concat('b', id) as path", "1 as shard", f"{8 * n}L + id * 5 as offset", "5L as size")
    files = front.unionByName(back)
    began = time.monotonic()
    moves = layout.defrag_quick(files)
    assert time.monotonic() - began < 40
    assert moves[:n] == [(f"b{n - 1 - i}", 1, 5 * i) for i in range(n)]


def test_ranks_when_parts_are_evaluated_twice(spark):
    """Every evaluation of range partitions may draw other bounds; running totals over them have to be of one of them."""
    conf = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60000).selectExpr("id * 7919 % 60013 as size")
        real = sorted(i * 7919 % 60013 for i in range(60000))
        picks = {f"p{i}": (i, 40) for i in range(1, 40)}
        got = layout.at_ranks(rows, "size", picks).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [got[f"p{i}"] for i in range(1, 40)] == [real[60000 * i // 40] for i in range(1, 40)]


def test_sequences(spark):
    rows = [(f"v/shot{s}_{i:03}.png", 0, 0, 1) for s in (1, 2) for i in range(6)] + [("v/one.png", 0, 0, 1), ("w/a1.x", 0, 0, 1)]
    got = {(r["parent"], r["pattern"], r["n"], r["first"], r["last"]) for r in listing.sequences(make(spark, rows)).collect()}
    one = [("v", "one.png", 1, None, None), ("w", "a1.x", 1, None, None)]
    assert got == {("v", "shot1_***.png", 6, "000", "005"), ("v", "shot2_***.png", 6, "000", "005"), *one}
    # a tie stars the first number; fewer than five that agree in the others stand by themselves
    rows = [(f"t/{i}-{5 - i}.x", 0, 0, 1) for i in range(5)] + [(f"u/{i % 5}_{i // 5}.x", 0, 0, 1) for i in range(8)]
    got = {tuple(r) for r in listing.sequences(make(spark, rows)).collect()}
    assert got == {*(("t", f"{i}-{5 - i}.x", 1, None, None) for i in range(5)), ("u", "*_0.x", 5, "0", "4"), *(("u", f"{i}_1.x", 1, None, None) for i in range(3))}


def test_walk_and_tree(spark):
    files = make(spark, ROWS)
    dirs = stats.complete_dirs(files)
    assert [r["path"] for r in listing.walk(files, dirs).collect()] == ["", "dir", "dir/sub", "dir.x"]
    assert [r["shown"].strip() for r in listing.tree(files, dirs).collect()][:3] == ["├── dir", "├── sub", "└── d.txt"]
    assert {tuple(r) for r in listing.disk_usage(files, dirs, maxdepth=1).collect()} == {("", 20), ("dir", 10), ("dir.x", 0)}
    assert listing.glob_paths(files, dirs, "dir/**", recursive=True).filter("path = 'dir/'").count() == 1


def test_find(spark):
    files = make(spark, ROWS)
    both = lookup.entries(files, stats.complete_dirs(files))
    names = lambda **k: {r["shown"] for r in lookup.find(both, **k).collect()}
    assert names(maxdepth=0) == {"."}
    assert names(root="dir", kind="f") == {"dir/c.txt", "dir/sub/d.txt"}
    assert names(size="+6", kind="f") == {"dir/sub/d.txt"}
    assert names(name="*.txt", maxdepth=1) == {"a.txt", "b.txt"}


def test_lookups_keep_order_and_repetition(spark):
    wanted = spark.createDataFrame([(0, "b.txt"), (1, "a.txt"), (2, "b.txt")], "pos int, path string")
    assert [r["path"] for r in lookup.require_all(lookup.lookup_many(make(spark, ROWS), wanted)).collect()] == ["b.txt", "a.txt", "b.txt"]
    with pytest.raises(EntryNotFound):
        lookup.require_all(lookup.lookup_many(make(spark, ROWS), wanted.union(spark.createDataFrame([(3, "no")], "pos int, path string"))))
    with pytest.raises(ValueError):
        lookup.scan_dirs(stats.complete_dirs(make(spark, ROWS)), "address")


def test_merge(spark):
    target, source = make(spark, [("x", 0, 0, 2)]), make(spark, [("a.txt", 0, 0, 5), ("x", 0, 5, 9)])
    with pytest.raises(EntryExists):
        algebra.merge_files(target, source, 100)
    got = {r["path"]: (r["shard"], r["offset"], r["size"]) for r in algebra.merge_files(target, source, 100, ignore_duplicates=True).collect()}
    assert got == {"x": (0, 0, 2), "a.txt": (0, 2, 5)}
    got = {r["path"]: r["shard"] for r in algebra.merge_indexes(target, source, "p").collect()}
    assert got == {"x": 0, "p/a.txt": 1, "p/x": 1}
    with pytest.raises(EntryExists):
        algebra.merge_indexes(target, source, ignore_duplicates=False)


def test_merge_conflicts(spark):
    target, source = make(spark, [("a/b", 0, 0, 1), ("f", 0, 1, 1)]), make(spark, [("a", 0, 0, 1), ("f/x", 0, 1, 1)])
    both = [source, stats.complete_dirs(source), target, stats.complete_dirs(target)]
    assert {tuple(r) for r in algebra.conflicts(*both).collect()} == {("file over directory", "a"), ("directory over file", "f")}
    assert algebra.conflicts(*both, prefix="new/one").isEmpty()
    assert {tuple(r) for r in algebra.conflicts(*both, prefix="f/deep").collect()} == {("file over prefix", "f")}
    with pytest.raises(MergeConflict):
        algebra.check_conflicts(*both, prefix="a/b")


def test_merged_directories(spark):
    """Counts add up, modes are joined, the source's owner and the later time stay; what one side has alone is as it was."""
    a, b = stats.complete_dirs(make(spark, [("d/x", 0, 0, 3), ("e/y", 0, 3, 1)])), stats.complete_dirs(make(spark, [("x", 0, 0, 4)]))
    a = algebra.set_meta(a, "d", mode=0o40700, uid=1, gid=None, mtime_ns=9)
    b = algebra.set_meta(b, "", mode=0o40055, uid=2, mtime_ns=5)
    got = {r["path"]: r for r in algebra.merge_dirs(a, b, "d").collect()}
    assert set(got) == {"", "d", "e"}
    d = got["d"]
    assert (d["num_files"], d["size_tree"], d["mode"], d["uid"], d["mtime_ns"]) == (2, 7, 0o40755, 2, 9) and got["e"]["size_tree"] == 1


def test_checks_and_renames(spark):
    files = make(spark, ROWS)
    dirs = stats.complete_dirs(files)
    new = lambda p: spark.createDataFrame([(p, 1)], "path string, size long")
    with pytest.raises(NotADirectory):
        algebra.check_new(files, dirs, new("a.txt/x"))
    with pytest.raises(DirectoryNotEmpty):
        algebra.remove_dir(dirs, "dir")
    with pytest.raises(ValueError):
        algebra.remove_tree(files, "")
    got = {r["path"]: r["parent"] for r in algebra.rename(files, "dir", "new/home").collect()}
    assert got["new/home/sub/d.txt"] == "new/home/sub" and "dir.x/e" in got


def test_sync_rules(spark):
    row = "path string, size long, mtime_ns long, crc32c long"
    a = spark.createDataFrame([("new", 1, 1, 1), ("same", 1, 1, 1), ("newer", 1, 5, 1), ("older", 1, 0, 2), ("x.log", 1, 1, 1)], row)
    b = spark.createDataFrame([("same", 1, 1, 1), ("newer", 1, 1, 1), ("older", 1, 1, 1), ("gone", 1, 1, 1), ("x.log", 2, 1, 1)], row)
    act = lambda **k: {r["path"]: r["action"] for r in sync.actions(a, b, sync.Options(**k)).collect()}
    assert act(delete=True) == {"new": "add", "same": "skip", "newer": "update", "older": "update", "gone": "delete", "x.log": "update"}
    assert act(update=True)["older"] == "skip" and act()["gone"] == "keep"
    assert act(checksum=True)["newer"] == "skip" and act(checksum=True)["older"] == "update"
    assert act(exclude=["*.log"], delete=True)["x.log"] == "exclude"
    assert act(existing=True)["new"] == "skip" and act(ignore_existing=True)["newer"] == "skip"
    e = sync.endpoint("data.archive::in/side/")
    assert (e.location, e.inner, e.contents, e.kind) == ("data.archive", "in/side", True, "archive")
    assert sync.endpoint("a\\::b").location == "a::b" and sync.subdirectory("/x/Train.TAR.gz") == "train"


def test_checksums():
    data = bytes(range(256)) * 700
    assert crc32c(b"123456789") == 0xE3069283
    assert crc32c(data[77:], crc32c(data[:77])) == crc32c(data)
    assert crc32c_rows([b"", None, b"123456789", data]) == [0, None, 0xE3069283, crc32c(data)]


def test_sizes_and_modes(spark):
    assert formatting.parse_size("1.5K") == 1536
    row = spark.range(1).select(formatting.mode_string(F.lit(0o100750), F.lit(False)), formatting.human_size(F.lit(1536)), formatting.modified(F.lit(1700000000123456789)).cast("string")).first()
    assert tuple(row) == ("-rwxr-x---", "1.5K", "2023-11-14 22:13:20.123456")


def test_checksums_make_no_copies():
    import tracemalloc

    import pyarrow as pa

    from archivelake.functions.checksums import crc32c_array

    small = [None, b"", b"1", b"123456789", bytes(range(256)), bytes(257), b"x" * 70000]
    plain = lambda x: None if x is None else crc32c(x)
    assert crc32c_array(pa.array(small, pa.binary()).slice(2, 4)).to_pylist() == [plain(x) for x in small[2:6]]
    assert crc32c_array(pa.array(small, pa.large_binary())).to_pylist() == [plain(x) for x in small]
    assert crc32c_array(pa.array([], pa.binary())).to_pylist() == [] and crc32c_array(pa.array([None], pa.binary())).to_pylist() == [None]
    large = pa.array([bytes([i]) * (1 << 20) for i in range(32)], pa.binary())
    tracemalloc.start()
    crc32c_array(large)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20
