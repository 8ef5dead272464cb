"""Snapshots, contents, packed files and the command line, end to end."""

import io
import os
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from archivelake.cli import main
from archivelake.functions.codecs import Codecs, arrays, json_values
from archivelake.plans.archive import Archive, read_index, write_index
from archivelake.operators import sync
from archivelake.schema import EntryExists, EntryNotFound, FileTooLarge, IntegrityError, MergeConflict
from archivelake.sources import packed, shards
from archivelake.streaming import ingest

CONTENTS = {"x.txt": b"hello", "a/y z+1.txt": bytes(range(256)), "a/b/z.json": b"[1, 2]", "ü/é.bin": b"\0"}


@pytest.fixture
def archive(spark, tmp_path):
    out = Archive(spark, str(tmp_path / "one é%20"), "x+", shard_size_limit=260)
    out.add(spark.createDataFrame([(k, bytearray(v)) for k, v in CONTENTS.items()], "path string, content binary"))
    return out


def test_contents(archive):
    assert {r["path"]: bytes(r["content"]) for r in archive.contents().collect()} == CONTENTS
    assert archive["a/b/z.json"] == [1, 2] and archive.read("x.txt", 1, 3) == b"ell"
    assert len(archive) == 4 and archive.total_size == sum(map(len, CONTENTS.values()))
    assert archive.files.agg(F.max(F.col("offset") + F.col("size"))).first()[0] <= 260
    assert archive.get("no", 7) == 7 and "a" not in archive and archive.isdir("a")
    with pytest.raises(KeyError):
        archive["no"]
    assert archive.verify().count() == archive.verify(quick=True).count() == 0


def test_changes(archive, spark):
    with pytest.raises(EntryExists):
        archive["x.txt"] = b"again"
    archive["new/k.json"] = {"q": 1}
    assert archive["new/k.json"] == {"q": 1}
    archive.rename("a", "c/d")
    del archive["x.txt"]
    archive.mkdir("empty")
    assert set(archive) == {"c/d/y z+1.txt", "c/d/b/z.json", "ü/é.bin", "new/k.json"}
    assert archive.isdir("empty") and archive.verify().count() == 0
    moved = archive.rewrite(archive.root + "-moved", 300)
    assert set(moved) == set(archive) and moved.verify().count() == 0
    read = Archive(spark, archive.root)
    with pytest.raises(PermissionError):
        read["y"] = b"1"
    with pytest.raises(EntryNotFound):
        Archive(spark, archive.root + "-none")


def test_file_objects(archive):
    with archive.open("new.txt", "xt") as f:
        f.write("one\n")
    with archive.open("new.txt", "at") as f:
        f.write("zwö\n")
    with archive.open("new.txt", "rt") as f:
        assert f.read() == "one\nzwö\n"
    with archive.open("x.txt", "r+b") as f:
        f.seek(1)
        f.write(b"E")
        f.truncate(3)
    assert archive.read("x.txt") == b"hEl"
    with pytest.raises(io.UnsupportedOperation):
        archive.open("x.txt").write(b"")
    with pytest.raises(EntryExists):
        archive.open("x.txt", "x")
    assert archive.verify().count() == 0 and archive.needs_defrag() and archive.stat("a")["size"] == 262
    archive.change(lambda f: f.withColumn("crc32c", F.lit(None).cast("long")))
    archive.fill_checksums()
    assert archive.files.filter("crc32c is null").count() == 0 and archive.verify().count() == 0
    archive.rmtree("a")
    archive.vacuum()
    assert archive.verify().count() == 0 and archive.info()["num_files"] == 3
    assert '"name": "new.txt"' in archive.usage_json()
    assert write_index(archive.spark, read_index(archive.files)).count() == 3


def test_without_a_limit_tasks_share_the_work(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("archivelake.plans.archive.SHARE", 100)
    a = Archive(spark, str(tmp_path / "free"), "x+")
    rows = {f"{i:02}": bytes([i]) * (250 if i == 7 else 30) for i in range(20)}
    a.add(spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "path string, content binary"))
    assert {r["path"]: bytes(r["content"]) for r in a.contents().collect()} == rows and a.verify().isEmpty()
    held = a.physical_sizes()
    assert len(held) == 8 and sum(held.values()) == sum(map(len, rows.values())) and sorted(held.values())[-2:] == [90, 250]


def test_update_that_fails_keeps_the_old_content(archive):
    with pytest.raises(FileTooLarge):
        archive.update("x.txt", bytes(1000))
    assert archive.read("x.txt") == b"hello"
    archive.set_meta("x.txt", mode=0o100600)
    archive.update("x.txt", b"other")
    assert archive.read("x.txt") == b"other" and archive.stat("x.txt")["mode"] == 0o100600 and len(archive) == 4


def test_readers_keep_their_snapshot(archive):
    before = archive.contents()
    archive.update("x.txt", b"new")
    archive.remove("ü/é.bin")
    assert {r["path"]: bytes(r["content"]) for r in before.collect()} == CONTENTS
    archive.vacuum()
    assert archive.read("x.txt") == b"new" and archive.verify().isEmpty()
    # a number that a shard has had is never given again
    numbers = [r[0] for r in archive.files.select("shard").distinct().collect()]
    archive.rmtree("a")
    archive.remove("x.txt")
    archive["k"] = b"1"
    assert archive.files.first()["shard"] > max(numbers)


def test_parts_of_entries(archive):
    room = bytearray(6)
    assert archive.readinto("x.txt", room, 2) == 3 and bytes(room) == b"llo\0\0\0"
    assert archive.read("a/y z+1.txt", 250) == bytes(range(250, 256)) and archive.read("x.txt", 9, 4) == b"" and archive.read("x.txt", 4, 99) == b"o"
    with archive.open("x.txt", "r+b") as f:
        assert f.truncate(8) == 8
    assert archive.read("x.txt") == b"hello\0\0\0"


def test_folders_with_empty_files_and_directories(spark, tmp_path):
    src = tmp_path / "src"
    for d in ("d/deep/er", "void"):
        (src / d).mkdir(parents=True)
    (src / "d" / "empty").write_bytes(b"")
    (src / "d" / "deep" / "x").write_bytes(b"x")
    (src / "d" / "deep" / "x").chmod(0o640)
    os.utime(src / "d" / "deep" / "x", ns=(1, 1700000000123456789))
    archive = Archive(spark, str(tmp_path / "t"), "x+")
    archive.add_folder(str(src))
    assert set(archive) == {"d/empty", "d/deep/x"} and archive.read("d/empty") == b""
    assert archive.isdir("void") and archive.isdir("d/deep/er")
    row = archive.stat("d/deep/x")
    assert (row["mode"], row["mtime_ns"], row["size"]) == (0o100640, 1700000000123456789, 1)
    # what the folder has stays, empty or not
    assert archive.sync(str(src), sync.Options(delete=True)) == {"skip": 2}
    (src / "d" / "deep" / "x").unlink()
    (src / "d" / "more").write_bytes(b"more")
    assert archive.sync(str(src), sync.Options(delete=True)) == {"skip": 1, "delete": 1, "add": 1}
    assert set(archive) == {"d/empty", "d/more"} and archive.verify().isEmpty()


def test_damage_is_found(archive):
    with open(shards.shard_uri(f"{archive.root}/data", 0).removeprefix("file://"), "r+b") as f:
        f.write(b"\xff\xff")
    assert [r["problem"] for r in archive.verify().collect()] == ["checksum"]
    with pytest.raises(Exception, match=IntegrityError.__name__):
        archive.contents().collect()


@pytest.mark.parametrize("end", ["tar", "tar.gz", "zip"])
def test_packed(archive, spark, tmp_path, end):
    target = str(tmp_path / f"o.{end}")
    archive.to_packed(target, "w")
    names = zipfile.ZipFile(target).namelist() if end == "zip" else tarfile.open(target).getnames()
    assert "w/a/b/z.json" in names
    back = Archive.from_packed(spark, target, str(tmp_path / f"back-{end}"))
    assert {k[2:]: v for k, v in ((r["path"], bytes(r["content"])) for r in back.contents().collect())} == CONTENTS
    few = Archive.from_packed(spark, target, str(tmp_path / f"few-{end}"), rules=[(True, "w/a/**")], default=False)
    assert set(few) == {"w/a/y z+1.txt", "w/a/b/z.json"}
    if end == "tar":
        files, uris = packed.wrap(packed.read_packed(spark, target, content=False))
        assert {bytes(r["content"]) for r in shards.read_contents(files, "", uris).collect()} == set(CONTENTS.values())


@pytest.mark.parametrize("end,wide", [("tar", False), ("tar.gz", False), ("tar.bz2", False), ("tar.xz", False), ("zip", False), ("zip", True)])
def test_packed_in_parts(spark, tmp_path, monkeypatch, end, wide):
    """Entries don't pass through the driver, several tasks write and read one file, and other programs can read it."""
    from pyspark.sql import DataFrame

    if wide:
        monkeypatch.setattr(packed, "WIDE", 0)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    long = "l/" + "é" * 150
    rows = [("d", "k/d", None), *(("f", f"k/{i:03}.bin", bytearray([i % 251]) * (i * 37)) for i in range(120)), ("f", long, bytearray(b"x" * 70000))]
    both = spark.createDataFrame([(*r, 0o100640 if r[0] == "f" else 0o40750, 7, 8, 1700000000123456789) for r in rows], "type string, path string, content binary, mode int, uid int, gid int, mtime_ns long")
    target = str(tmp_path / f"p.{end}")
    real = {"w/" + p: bytes(c) for k, p, c in rows if k == "f"}
    with packed_conf(spark):
        assert packed.write_packed(both, target, end, "w") == len(rows)
    assert os.listdir(tmp_path) == [f"p.{end}"]
    if end == "zip":
        with zipfile.ZipFile(target) as z:
            assert z.testzip() is None and {n: z.read(n) for n in z.namelist() if not n.endswith("/")} == real and z.namelist() == sorted(z.namelist())
    else:
        with tarfile.open(target) as t:
            assert {m.name: t.extractfile(m).read() for m in t if m.isfile()} == real
    assert {r["path"]: bytes(r["content"]) for r in packed.read_packed(spark, target).filter("type = 'f'").collect()} == real
    whole = list(packed.entries(target, True))
    monkeypatch.setattr(packed, "STRETCH", 2000)
    cut = packed.stretches(target)
    assert len(cut) > 20 or end not in ("tar", "zip")
    assert [r for x in cut for r in packed.entries(target, True, x)] == whole
    stream = io.BytesIO()
    packed.write_packed(both, stream, end)
    assert len(stream.getvalue()) > 1000


class packed_conf:
    """Parts of an order that stay as many as there are shuffle partitions."""

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")

    def __exit__(self, *_):
        self.spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_merge_and_attach(archive, spark, tmp_path):
    other = Archive(spark, str(tmp_path / "two"), "x+")
    other["k.txt"] = b"k"
    archive.merge(other, prefix="p")
    archive.attach(other, prefix="q")
    assert {bytes(r["content"]) for r in archive.contents().filter("path in ('p/k.txt', 'q/k.txt')").collect()} == {b"k"}
    assert archive.verify().count() == 0
    assert archive.sql("select count(*) from {files} where path like '%k.txt'").first()[0] == 2
    other.mkdir("bare", mode=0o40711)
    archive.merge(other, prefix="r", rules=[(False, "k.*")])
    assert not archive.exists("r/k.txt") and not archive.isdir("r/bare")
    archive.merge(other, prefix="r")
    assert archive.read("r/k.txt") == b"k" and archive.stat("r/bare")["mode"] == 0o40711 and archive.verify().isEmpty()
    with pytest.raises(EntryExists):
        archive.merge(other, prefix="r")
    archive.merge(other, prefix="r", ignore_duplicates=True)
    with pytest.raises(MergeConflict):
        archive.merge(other, prefix="x.txt/in")
    with pytest.raises(EntryExists):
        archive.attach(other, prefix="q")


def test_codecs(spark):
    codecs = Codecs()
    for name, value in (("a.json", {"x": [1]}), ("a.json.gz", [1]), ("a.JSON.XZ", "s"), ("b.bz2", b"raw")):
        assert codecs.decode(name, codecs.encode(name, value)) == value
    assert (codecs.decode("m.npy.gz", codecs.encode("m.npy.gz", np.eye(2))) == np.eye(2)).all()
    with pytest.raises(ValueError):
        codecs.decode("a.pkl", b"")
    assert Codecs(strict=False).decode("a.unknown", b"1") == b"1"
    rows = spark.createDataFrame([("m.npy", bytearray(codecs.encode("m.npy", np.arange(6).reshape(2, 3)))), ("j.json", bytearray(b'{"k": 3}'))], "path string, content binary")
    assert tuple(arrays(rows).first())[1] == [2, 3]
    assert json_values(rows).select(F.expr("variant_get(value, '$.k', 'int')")).first()[0] == 3


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("one")
    archive = Archive(spark, str(tmp_path / "s"), "x+")
    for _ in range(2):
        ingest.ingest(ingest.arriving(spark, str(src)), archive, str(tmp_path / "ck")).awaitTermination()
        (src / "b.txt").write_text("two")
    assert {r["path"]: bytes(r["content"]) for r in archive.contents().collect()} == {"a.txt": b"one", "b.txt": b"two"}


def test_command_line(spark, tmp_path):
    src = tmp_path / "src"
    (src / "d").mkdir(parents=True)
    (src / "x.txt").write_text("hello")
    (src / "d" / "y.log").write_text("log")

    def run(*args):
        out = io.StringIO()
        assert main([str(a) for a in args], spark, out) == 0
        return out.getvalue()

    run("create", tmp_path / "a", src)
    assert run("list", tmp_path / "a", "-R").split() == ["d/y.log", "x.txt"]
    assert "8\t." in run("du", tmp_path / "a")
    assert run("cat", tmp_path / "a", "x.txt") == "hello" and run("head", tmp_path / "a", "x.txt", "-n", 1) == "hello\n"
    assert run("du", tmp_path / "a", "-s", "-H") == "8\t.\n" and run("list", tmp_path / "a", "*/*.log") == "d/y.log\n"
    assert run("list", tmp_path / "a", "-l").startswith("total 2\n")
    run("index-to-csv", tmp_path / "a", tmp_path / "csv")
    lines = "".join(f.read_text() for f in sorted((tmp_path / "csv").glob("*.csv"))).splitlines()
    assert lines[0] == '"path","shard","offset","size","crc32c"' and any(x.startswith('"x.txt",0,') for x in lines)
    run("extract", tmp_path / "a", tmp_path / "out", "-x", "d/")
    assert os.listdir(tmp_path / "out") == ["x.txt"]
    (src / "x.txt").unlink()
    (src / "z").write_text("z")
    run("sync", tmp_path / "a", src, "--delete")
    assert run("list", tmp_path / "a", "-R").split() == ["d/y.log", "z"]
    assert run("verify", tmp_path / "a") == ""


def test_contents_are_read_a_few_mb_at_a_time_and_not_kept(spark, tmp_path):
    import pyarrow as pa

    a = Archive(spark, str(tmp_path / "some"), "x+")
    a.add(spark.range(60).selectExpr("concat('d', id % 3, '/', id) path", "encode(repeat(char(65 + id % 26), 500000), 'UTF-8') content"))
    rows = a.files.orderBy("shard", "offset").toArrow().combine_chunks().to_batches()
    read = shards.reader(rows[0].schema.names, a.root + "/data")
    before, sizes = pa.total_allocated_bytes(), []
    for batch in read(iter(rows)):
        sizes.append(batch.column("content").nbytes)
        del batch
        assert pa.total_allocated_bytes() - before < 4 * shards.BATCH_BYTES
    assert sum(sizes) > 30_000_000 and max(sizes) < 2 * shards.BATCH_BYTES


def test_one_process_of_a_task_reads_and_writes(spark, archive, tmp_path, capsys):
    target = str(tmp_path / "out ü%20")
    rows = archive.extract(target)
    rows.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    assert {r["path"]: r["size"] for r in rows.collect()} == {k: len(v) for k, v in CONTENTS.items()}
    again = Archive(spark, str(tmp_path / "again"), "x+", 300)
    again.add_folder(target)
    assert {r["path"]: bytes(r["content"]) for r in again.contents().collect()} == CONTENTS and again.verify().isEmpty()
    assert archive.extract(target + "2", archive.files.filter("size > 100")).select("path").collect() == [("a/y z+1.txt",)]


def test_many_small_shards_are_not_a_task_each(spark, archive, tmp_path, monkeypatch):
    target, seen, real = str(tmp_path / "out"), [], shards.write_shards
    archive.extract(target).collect()
    monkeypatch.setattr("archivelake.sources.trees.tasks", lambda *_: 2)
    monkeypatch.setattr(shards, "write_shards", lambda placed, root, fetch=None, tasks=None: seen.append(tasks) or real(placed, root, fetch, tasks))
    a = Archive(spark, str(tmp_path / "again"), "x+", 256)
    a.add_folder(target)
    assert seen == [2] and len(a.physical_sizes()) > 2 and a.verify().isEmpty()
    assert {r["path"]: bytes(r["content"]) for r in a.contents().collect()} == CONTENTS


def test_tasks_have_shares_that_do_not_grow(spark):
    from archivelake.sources.trees import tasks

    few = 4 * spark.sparkContext.defaultParallelism
    assert tasks(spark, 0, 0) == tasks(spark, 1000, 3) == few
    assert tasks(spark, 6 << 30, 1000) == 193 and tasks(spark, 1000, 3_000_000) == 301
