"""Queries over archives that are really written: shards, folders, packed files and indexes made of the same tables, and
operators that the virtual archives of ``queries`` don't reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .functions import formatting, globs
from .functions.codecs import Codecs, json_values
from .operators import algebra, integrity, layout, listing, lookup, stats
from .plans.archive import Archive, read_index, write_index
from .queries import _ARCHIVE, _DOC, _EVENT, _LIVE, _SYNC, LIMIT, _next_fit, _up, query
from .sources import packed, shards, stores, trees, views

_made: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    """What several queries read is made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def doc_archive(spark: SparkSession, d: str) -> Archive:
    """The documents as an archive of many shards, in path order."""

    def make() -> Archive:
        out = Archive(spark, stores.new_path(spark, "doc-archive"), "x+", LIMIT)
        out.add(views.doc_files(spark, d, content=True).select("path", "content", "mode", "uid", "gid", "mtime_ns"))
        return Archive(spark, out.root)

    return _once(spark, d, "archive", make)


def doc_tar(spark: SparkSession, d: str) -> str:
    def make() -> str:
        target = stores.new_path(spark, "packed") + ".tar"
        doc_archive(spark, d).to_packed(target)
        return target

    return _once(spark, d, "tar", make)


def doc_folder(spark: SparkSession, d: str) -> str:
    def make() -> str:
        target = stores.new_path(spark, "folder")
        doc_archive(spark, d).extract(target).write.format("noop").mode("overwrite").save()
        return target

    return _once(spark, d, "folder", make)


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.sha2("content", 256).alias("sha256"))


_SHA = f"WITH {_DOC} SELECT path, sha256(text) AS sha256 FROM doc_files JOIN documents USING (doc_id)"
_EN = "regexp_matches(path, '^(.*/)?en/[^/]*$')"

# ---------------------------------------------------------------- contents


@query("S5_keys", f"WITH {_DOC} SELECT path FROM doc_files")
def keys(spark, d):
    return doc_archive(spark, d).files.select("path")


@query("S6_items", f"WITH {_DOC} SELECT path, strlen(text)::BIGINT AS n_bytes, length(text)::BIGINT AS n_chars FROM doc_files JOIN documents USING (doc_id)")
def items(spark, d):
    return doc_archive(spark, d).contents().select("path", F.octet_length("content").cast("long").alias("n_bytes"), F.length(F.decode("content", "UTF-8")).cast("long").alias("n_chars"))


@query("S8_read_address", f"WITH RECURSIVE {_DOC}, {_next_fit('doc_files', 'path', LIMIT)} SELECT p.path, p.shard, p.\"offset\"::BIGINT AS \"offset\", sha256(text) AS sha256 FROM placed p JOIN doc_files f ON p.path = f.path JOIN documents USING (doc_id)")
def read_address(spark, d):
    return doc_archive(spark, d).contents().select("path", "shard", "offset", F.sha2("content", 256).alias("sha256"))


@query("S9_read_range", f"WITH {_DOC} SELECT path, substr(hex(encode(text)), 15, 40) AS part FROM doc_files JOIN documents USING (doc_id)")
def read_range(spark, d):
    a = doc_archive(spark, d)
    return shards.read_ranges(a.files, f"{a.root}/data", 7, 20).select("path", F.hex("content").alias("part"))


@query("S10_read", f"{_SHA} WHERE path = (SELECT max(path) FROM doc_files)")
def read(spark, d):
    a = doc_archive(spark, d)
    path = a.files.agg(F.max("path")).first()[0]
    return _digest(spark.createDataFrame([(path, bytearray(a.read(path)))], "path string, content binary"))


@query("S12_add", f"WITH {_DOC} SELECT path, size, mode, uid FROM doc_files")
def add(spark, d):
    """In two steps, the second behind the first."""
    rows = views.doc_files(spark, d, content=True)
    a = Archive(spark, stores.new_path(spark, "two-steps"), "x+", LIMIT)
    for where in ("doc_id % 10 = 3", "doc_id % 10 <> 3"):
        a.add(rows.filter(where).select("path", "content", "mode", "uid", "gid", "mtime_ns"))
    return a.contents().select("path", F.octet_length("content").cast("long").alias("size"), "mode", "uid")


@query("S13_add_folder", f"WITH {_DOC} SELECT path, size FROM doc_files")
def add_folder(spark, d):
    a = Archive(spark, stores.new_path(spark, "from-folder"), "x+", LIMIT)
    a.add_folder(doc_folder(spark, d))
    return a.files.select("path", "size")


@query("S14_setitem", "SELECT * FROM (VALUES ('new/a.json', '{\"k\": 1}'), ('new/b.txt', 'two')) t(path, text)")
def setitem(spark, d):
    a = Archive(spark, stores.new_path(spark, "mapping"), "x+")
    a["new/a.json"] = {"k": 1}
    a.setdefault("new/a.json", {"k": 2})
    a.setdefault("new/b.txt", b"two")
    return a.contents().select("path", F.decode("content", "UTF-8").alias("text"))


@query("S15_create_filtered", f"WITH {_DOC} SELECT path, size FROM doc_files WHERE {_EN} AND NOT regexp_matches(path, '9\\.txt$')")
def create_filtered(spark, d):
    a = Archive(spark, stores.new_path(spark, "filtered"), "x+", LIMIT)
    a.add_folder(doc_folder(spark, d), ["**/en/*"], ["**/*9.txt"])
    return a.files.select("path", "size")


@query("S16_path_list", f"WITH {_DOC} SELECT path FROM doc_files")
def path_list(spark, d):
    target = stores.new_path(spark, "list")
    views.doc_files(spark, d).select("path").write.option("lineSep", "\0").text(target)
    return trees.read_list(spark, target, "\0")


@query("S18_packed_contents", _SHA)
def packed_contents(spark, d):
    return _digest(packed.read_packed(spark, doc_tar(spark, d)).filter("type = 'f'"))


@query("S19_packed_headers", f"{_ARCHIVE} SELECT 'f' AS type, path, size FROM doc_files UNION ALL SELECT 'd', path, 0 FROM doc_dirs WHERE path <> ''")
def packed_headers(spark, d):
    return packed.read_packed(spark, doc_tar(spark, d), content=False).select("type", "path", "size")


@query("S20_wrap", _SHA)
def wrap(spark, d):
    files, uris = packed.wrap(packed.read_packed(spark, doc_tar(spark, d), content=False))
    return _digest(shards.read_contents(files, "", uris))


@query("S21_from_packed", f"{_ARCHIVE} SELECT path, size_tree, num_files_tree FROM doc_dirs")
def from_packed(spark, d):
    return Archive.from_packed(spark, doc_tar(spark, d), stores.new_path(spark, "unpacked")).dirs.select("path", "size_tree", "num_files_tree")


def _zip(spark, d, name: str, **how) -> DataFrame:
    target = stores.new_path(spark, name) + ".zip"
    doc_archive(spark, d).to_packed(target, **how)
    return packed.read_packed(spark, target)


@query("S22_to_packed", f"WITH {_DOC} SELECT 'top/' || path AS path, sha256(text) AS sha256 FROM doc_files JOIN documents USING (doc_id)")
def to_packed(spark, d):
    return _digest(_zip(spark, d, "zipped", wrapper="top").filter("type = 'f'"))


@query("S23_filtered_packed", f"WITH {_DOC} SELECT path, size FROM doc_files WHERE path GLOB 'src1/*' OR path GLOB '*/fr/*' AND NOT path GLOB '*3.txt'")
def filtered_packed(spark, d):
    where = globs.raw_chain(F.col("path"), [(True, "src1/*"), (True, "*/fr/*"), (False, "*3.txt")])
    return _zip(spark, d, "some", where=where).filter("type = 'f'").select("path", "size")


@query("G14_filtered_import", f"WITH {_DOC} SELECT path, size FROM doc_files WHERE {_EN} AND NOT starts_with(path, 'src1/')")
def filtered_import(spark, d):
    rules = [(False, "src1/**"), (True, "**/en/*")]
    return Archive.from_packed(spark, doc_tar(spark, d), stores.new_path(spark, "unpacked"), rules=rules, default=False).files.select("path", "size")


@query("S24_index_csv", f"WITH RECURSIVE {_DOC}, {_next_fit('doc_files', 'path', LIMIT)} SELECT path, shard, \"offset\"::BIGINT AS \"offset\", size FROM placed")
def index_csv(spark, d):
    target = stores.new_path(spark, "csv")
    trees.write_index_csv(doc_archive(spark, d).files, target)
    return spark.read.csv(target, "path string, shard int, offset long, size long, crc32c long", header=True).drop("crc32c")


@query("S26_jsonl", f"{_ARCHIVE} SELECT 'd' AS type, path, size_tree AS size FROM doc_dirs UNION ALL SELECT 'f', path, size FROM doc_files")
def jsonl(spark, d):
    target = stores.new_path(spark, "jsonl")
    trees.write_jsonl(doc_archive(spark, d).entries, target)
    return spark.read.json(target, "type string, path string, size long")


@query("S27_extract", _SHA)
def extract(spark, d):
    return _digest(trees.read_folder(spark, doc_folder(spark, d)))


@query("S28_head", f"WITH {_DOC} SELECT path, substr(hex(encode(text)), 1, 2048) AS head FROM doc_files JOIN documents USING (doc_id)")
def head(spark, d):
    return doc_archive(spark, d).contents().select("path", F.hex(F.substring("content", 1, 1024)).alias("head"))


@query("S29_index_mapping", f"WITH {_DOC} SELECT path, parent, shard, \"offset\", size FROM doc_files")
def index_mapping(spark, d):
    return write_index(spark, read_index(views.doc_files(spark, d))).select("path", "parent", "shard", "offset", "size")


# ---------------------------------------------------------------- lookups and listings


@query("L3_lookup_dir", f"{_ARCHIVE} SELECT path, num_subdirs, num_files, num_files_tree, size_tree FROM doc_dirs WHERE path = 'src3'")
def lookup_dir(spark, d):
    return lookup.lookup(doc_archive(spark, d).dirs, "/src3/").select("path", *stats.STATS)


@query("L4_lookup", f"{_ARCHIVE} SELECT 'd' AS type, path, size_tree AS size FROM doc_dirs WHERE path = 'src3/en' UNION ALL SELECT 'f', path, size FROM doc_files WHERE path = (SELECT min(path) FROM doc_files)")
def lookup_any(spark, d):
    a = doc_archive(spark, d)
    path = a.files.agg(F.min("path")).first()[0]
    return lookup.lookup(a.entries, "src3/en").unionByName(lookup.lookup(a.entries, path)).select("type", "path", "size")


@query("L6_get", f"WITH {_DOC} SELECT path, text FROM doc_files JOIN documents USING (doc_id) WHERE path = (SELECT min(path) FROM doc_files) UNION ALL SELECT 'none', 'default'")
def get(spark, d):
    a = doc_archive(spark, d)
    path = a.files.agg(F.min("path")).first()[0]
    return spark.createDataFrame([(path, bytes(a[path]).decode()), ("none", a.get("none", "default"))], "path string, text string")


@query("L10_limit", f"SELECT {LIMIT}::BIGINT AS shard_size_limit")
def limit(spark, d):
    return spark.createDataFrame([(doc_archive(spark, d).shard_size_limit,)], "shard_size_limit long")


@query("L11_physical_sizes", f"WITH RECURSIVE {_DOC}, {_next_fit('doc_files', 'path', LIMIT)} SELECT shard, sum(size)::BIGINT AS physical_size FROM placed GROUP BY shard")
def physical_sizes(spark, d):
    return spark.createDataFrame(list(doc_archive(spark, d).physical_sizes().items()), "shard int, physical_size long")


@query("L12_stat", f"WITH {_DOC} SELECT path, size, mode, uid, gid, mtime_ns FROM doc_files WHERE path = (SELECT max(path) FROM doc_files)")
def stat(spark, d):
    a = doc_archive(spark, d)
    row = a.stat(a.files.agg(F.max("path")).first()[0])
    names = ["path", "size", "mode", "uid", "gid", "mtime_ns"]
    return spark.createDataFrame([tuple(row[c] for c in names)], "path string, size long, mode int, uid int, gid int, mtime_ns long")


@query("W6_ls_glob", f"{_ARCHIVE} SELECT 'd' AS type, path, size_tree AS size FROM doc_dirs WHERE regexp_matches(path, '^src1[^/]*/e[^/]$') UNION ALL SELECT 'f', path, size FROM doc_files WHERE regexp_matches(path, '^src1[^/]*/e[^/]$')")
def ls_glob(spark, d):
    a = doc_archive(spark, d)
    return listing.glob_entries(a.files, a.dirs, "src1*/e?").select("type", "path", "size")


@query("W13_completion", f"{_ARCHIVE} SELECT path FROM (SELECT path, parent FROM doc_dirs UNION ALL SELECT path, parent FROM doc_files) WHERE parent = 'src2/en' AND starts_with(path, 'src2/en/000') ORDER BY path LIMIT 200")
def completion(spark, d):
    a = doc_archive(spark, d)
    return listing.complete(a.files, a.dirs, "src2/en/000")


@query("W15_modes", f"WITH {_DOC} SELECT path, CASE WHEN size % 2 = 0 THEN '-rw-r--r--' ELSE '-rwxr-x---' END AS mode, (mtime_ns // 1000)::BIGINT AS modified FROM doc_files")
def modes(spark, d):
    rows = views.doc_files(spark, d).withColumn("mode", F.expr("if(size % 2 = 0, 33188, 33256)"))
    return rows.select("path", formatting.mode_string(F.col("mode"), F.lit(False)).alias("mode"), F.unix_micros(formatting.modified(F.col("mtime_ns"))).alias("modified"))


@query("G0_glob_question", f"WITH {_DOC} SELECT path FROM doc_files WHERE regexp_matches(path, '^src[^/]/[^/][^/]/0000[^/]*[37]\\.txt$')")
def glob_question(spark, d):
    return views.doc_files(spark, d).filter(F.col("path").rlike(globs.glob_regex("src?/??/0000*[37].txt"))).select("path")


@query("G3_glob_infos", f"{_ARCHIVE} SELECT 'd' AS type, path, size_tree AS size FROM doc_dirs WHERE regexp_matches(path, '(^|/)e[ns]$') UNION ALL SELECT 'f', path, size FROM doc_files WHERE regexp_matches(path, '(^|/)e[ns]$')")
def glob_infos(spark, d):
    return listing.glob_entries(views.doc_files(spark, d), views.doc_dirs(spark, d), "**/e[ns]", recursive=True).select("type", "path", "size")


@query("G7_preselection", f"WITH {_DOC} SELECT path FROM doc_files WHERE regexp_matches(path, '^src17/(.*/)?[^/]*7\\.txt$')")
def preselection(spark, d):
    return doc_archive(spark, d).files.filter(globs.matches(F.col("path"), "src17/**/*7.txt", recursive=True)).select("path")


@query("G9_raw_brackets", f"WITH {_DOC} SELECT path FROM doc_files WHERE regexp_matches(path, '^src[^1-5].*[02468]\\.txt$')")
def raw_brackets(spark, d):
    return views.doc_files(spark, d).filter(globs.matches_raw(F.col("path"), "src[^1-5]*[02468].txt")).select("path")


@query("G10_directory_pattern", f"WITH {_DOC} SELECT path FROM doc_files WHERE starts_with(path, 'src2/')")
def directory_pattern(spark, d):
    return views.doc_files(spark, d).filter(globs.matches(F.col("path"), globs.directory_pattern("src2/"), recursive=True)).select("path")


@query("G11_rules_in_order", f"WITH {_DOC} SELECT path FROM doc_files WHERE CASE WHEN regexp_matches(path, '^src1/(.*/)?[^/]*5\\.txt$') THEN true WHEN starts_with(path, 'src1/') THEN false WHEN regexp_matches(path, '^(.*/)?en/[^/]*$') THEN true ELSE false END")
def rules_in_order(spark, d):
    rules = cli.parser().parse_args("subset a b -i src1/**/*5.txt -x src1/ -i **/en/*".split()).rules
    return views.doc_files(spark, d).filter(globs.first_match(F.col("path"), rules, False)).select("path")


# ---------------------------------------------------------------- joins and roll-ups


@query("J2_stored_and_recomputed", f"{_ARCHIVE} SELECT path, size_tree AS stored, size_tree AS recomputed FROM doc_dirs")
def stored_and_recomputed(spark, d):
    a = doc_archive(spark, d)
    return a.dirs.select("path", F.col("size_tree").alias("stored")).join(stats.tree_stats(views.doc_files(spark, d)).select("path", F.col("size_tree").alias("recomputed")), "path")


@query("J3_write_back", f"{_ARCHIVE} SELECT path, size_tree, num_files FROM doc_dirs")
def write_back(spark, d):
    files, dirs = views.doc_files(spark, d), views.doc_dirs(spark, d)
    stale = dirs.withColumns({"size_tree": F.lit(0).cast("long"), "num_files": F.lit(7).cast("long")})
    return algebra.update(stale, dirs.select("path", "size_tree", "num_files")).select("path", "size_tree", "num_files")


@query("J4_contiguous", f'WITH {_DOC}, {_LIVE}, m AS (SELECT *, CASE WHEN "offset" = lag("offset" + size) OVER (PARTITION BY shard ORDER BY "offset", size) THEN 0 ELSE 1 END AS n FROM doc_live), r AS (SELECT *, sum(n) OVER (PARTITION BY shard ORDER BY "offset", size ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT max(k)::BIGINT AS longest, count(*) AS runs FROM (SELECT count(*) AS k FROM r GROUP BY shard, run)')
def contiguous(spark, d):
    return layout.islands(views.doc_live(spark, d)).agg(F.max("n_files").alias("longest"), F.count("*").alias("runs"))


@query("J5_semi_affected", f"{_ARCHIVE} SELECT path FROM doc_dirs WHERE path IN (SELECT parent FROM doc_files WHERE doc_id % 13 = 1) OR path IN (SELECT regexp_replace(parent, '/[^/]*$', '') FROM doc_files WHERE doc_id % 13 = 1) OR path = ''")
def semi_affected(spark, d):
    return stats.affected(views.doc_dirs(spark, d), views.doc_files(spark, d).filter("doc_id % 13 = 1")).select("path")


@query("J6_exists", f"WITH {_DOC} SELECT path FROM doc_files WHERE doc_id % 9 = 4")
def exists(spark, d):
    wanted = views.doc_files(spark, d).select("path", "doc_id").withColumn("path", F.expr("if(doc_id % 9 = 4, path, concat(path, '.no'))")).select("path")
    return lookup.exists(views.doc_files(spark, d), wanted)


@query("J7_keep_first", f"WITH {_DOC}, {_SYNC} SELECT path, size FROM a UNION ALL SELECT path, size FROM b WHERE path NOT IN (SELECT path FROM a)")
def keep_first(spark, d):
    a, b = views.sync_sides(spark, d)
    both = a.select("path", "size", F.lit(0).alias("side")).unionByName(b.select("path", "size", F.lit(1).alias("side")))
    return algebra.keep_first(both, [F.col("side")]).select("path", "size")


@query("J8_room_to_limit", f'WITH {_DOC}, {_LIVE} SELECT shard, max("offset" + size)::BIGINT AS "offset", 1099511627776 - max("offset" + size)::BIGINT AS size FROM doc_live GROUP BY shard')
def room_to_limit(spark, d):
    live = views.doc_live(spark, d)
    return layout.gaps(live, 2**40).join(lookup.shard_ends(live).select("shard", F.col("logical_end").alias("offset")), ["shard", "offset"])


@query("J9_counts_of_children", f"{_ARCHIVE} SELECT t.path, (SELECT count(*) FROM doc_files f WHERE f.parent = t.path) AS num_files FROM doc_dirs t")
def counts_of_children(spark, d):
    dirs = views.doc_dirs(spark, d)
    return dirs.select("path").join(stats.direct_counts(views.doc_files(spark, d), dirs), "path", "left").select("path", F.coalesce("num_files", F.lit(0)).cast("long").alias("num_files"))


@query("J10_probe", f"WITH {_DOC}, {_SYNC} SELECT a.path, a.size AS source_size, b.size AS target_size FROM a LEFT JOIN b USING (path)")
def probe(spark, d):
    from .operators import sync

    a, b = views.sync_sides(spark, d)
    return sync.actions(a, b).filter("source_size is not null").select("path", "source_size", "target_size")


@query("J11_merge_dirs", f"WITH {_DOC}, {_SYNC}, fa AS (SELECT path, size FROM a), fb AS (SELECT path, size FROM b), {_up('fa').replace('up AS', 'ua AS')}, {_up('fb').replace('up AS', 'ub AS')} SELECT dir AS path, count(*) AS num_files_tree, sum(size)::BIGINT AS size_tree FROM (SELECT * FROM ua UNION ALL SELECT * FROM ub) GROUP BY 1")
def merge_dirs(spark, d):
    a, b = views.sync_sides(spark, d)
    return algebra.merge_dirs(stats.complete_dirs(a), stats.complete_dirs(b)).select("path", "num_files_tree", "size_tree")


@query("T5_affected_counts", f"{_ARCHIVE} SELECT path, num_files_tree, size_tree FROM doc_dirs")
def affected_counts(spark, d):
    """Counts after an addition: of the branches that it touches anew, of the others as they were."""
    files = views.doc_files(spark, d)
    old, new = files.filter("path not like 'src7/%'"), files.filter("path like 'src7/%'")
    before = stats.complete_dirs(old)
    known = before.unionByName(stats.close_dirs(new).join(before.select("path"), "path", "left_anti"), allowMissingColumns=True)
    touched = stats.affected(known, new).select("path")
    fresh = stats.tree_stats(files).join(touched, "path", "left_semi")
    return algebra.update(known, fresh).select("path", "num_files_tree", "size_tree")


@query("T6_scalars", f"WITH {_DOC} SELECT max(size)::BIGINT AS most, min(size)::BIGINT AS least, sum(size)::BIGINT AS total, count(*) AS n FROM doc_files")
def scalars(spark, d):
    return views.doc_files(spark, d).agg(F.max("size").alias("most"), F.min("size").alias("least"), F.sum("size").alias("total"), F.count("*").alias("n"))


@query("T7_distinct_dirs", f"WITH {_EVENT}, {_up('event_files')} SELECT DISTINCT dir AS path FROM up")
def distinct_dirs(spark, d):
    return stats.close_dirs(views.event_files(spark, d))


@query("T11_defrag_info", f"WITH {_DOC} SELECT sum(size)::BIGINT AS physical_size, sum(CASE WHEN doc_id % 7 <> 3 THEN size END)::BIGINT AS logical_size, true AS needs_defrag FROM doc_files")
def defrag_info(spark, d):
    a = doc_archive(spark, d)
    live = a.files.join(views.doc_live(spark, d).select("path"), "path", "left_semi").agg(F.sum("size")).first()[0]
    physical = sum(a.physical_sizes().values())
    return spark.createDataFrame([(physical, live, physical > live)], "physical_size long, logical_size long, needs_defrag boolean")


@query("O1_scan_path", f"WITH {_DOC} SELECT path FROM doc_files ORDER BY path")
def scan_path(spark, d):
    return lookup.ordered(views.doc_files(spark, d), "path").select("path")


@query("O2_scan_address", f"WITH {_DOC} SELECT path, shard, \"offset\" FROM doc_files ORDER BY shard DESC, \"offset\" DESC")
def scan_address(spark, d):
    return lookup.ordered(views.doc_files(spark, d), "address", descending=True).select("path", "shard", "offset")


@query("O3_scan_random", f"WITH {_DOC} SELECT path FROM doc_files")
def scan_random(spark, d):
    return lookup.ordered(views.doc_files(spark, d), "random", seed=3).select("path")


@query("O4_scan_any", f"WITH {_DOC} SELECT path FROM doc_files")
def scan_any(spark, d):
    return lookup.ordered(views.doc_files(spark, d), "any", descending=True).select("path")


@query("O5_offset", f"WITH {_DOC} SELECT path, size FROM doc_files ORDER BY path LIMIT 1 OFFSET 40")
def offset(spark, d):
    return lookup.ordered(views.doc_files(spark, d), "path").select("path", "size").offset(40).limit(1)


@query("O6_largest_first", f"WITH {_DOC} SELECT regexp_replace(path, '^.*/', '') AS name, size FROM doc_files WHERE parent = 'src2/en' ORDER BY size DESC, name")
def largest_first(spark, d):
    return listing.shares(views.doc_files(spark, d), views.doc_dirs(spark, d), "src2/en").select("name", "size")


# ---------------------------------------------------------------- changes


@query("P8_defrag_quick")
def defrag_quick(spark, d):
    moves = layout.defrag_quick(views.doc_live(spark, d))
    return spark.createDataFrame(moves, "path string, new_shard int, new_offset long")


@query("M1_add_files", f"WITH {_DOC} SELECT path, size FROM doc_files")
def add_files(spark, d):
    files = views.doc_files(spark, d)
    old = files.filter("doc_id % 4 <> 1")
    new = algebra.check_new(old, stats.complete_dirs(old), files, exist_ok=True)
    return old.unionByName(new.select(*old.columns)).select("path", "size")


@query("M2_mkdir", f"{_ARCHIVE} SELECT path, num_subdirs FROM (SELECT path, CASE WHEN path = '' THEN num_subdirs + 1 ELSE num_subdirs END AS num_subdirs FROM doc_dirs UNION ALL SELECT 'zz', 1 UNION ALL SELECT 'zz/deep', 0)")
def mkdir(spark, d):
    files = views.doc_files(spark, d)
    known = views.doc_dirs(spark, d).unionByName(spark.createDataFrame([("zz/deep",)], "path string"), allowMissingColumns=True)
    return stats.complete_dirs(files, known).select("path", "num_subdirs")


@query("M3_update_index", f"WITH {_DOC} SELECT path, CASE WHEN doc_id % 6 = 2 THEN 33152 ELSE mode END AS mode, CASE WHEN doc_id % 6 = 2 THEN 5 ELSE uid END AS uid, gid FROM doc_files")
def update_index(spark, d):
    files = views.doc_files(spark, d)
    changes = files.filter("doc_id % 6 = 2").select("path", F.lit(33152).alias("mode"), F.lit(5).alias("uid"), F.lit(None).cast("int").alias("gid"))
    return algebra.update(files, changes).select("path", "mode", "uid", "gid")


@query("M4_update_data", "SELECT * FROM (VALUES ('a.txt', 'longer than before'), ('b.txt', 'two')) t(path, text)")
def update_data(spark, d):
    a = Archive(spark, stores.new_path(spark, "updated"), "x+", 100)
    a.add(spark.createDataFrame([("a.txt", bytearray(b"one")), ("b.txt", bytearray(b"two"))], "path string, content binary"))
    a.update("a.txt", b"longer than before")
    return a.contents().select("path", F.decode("content", "UTF-8").alias("text"))


@query("M6_rmdir", f"{_ARCHIVE} SELECT path FROM doc_dirs")
def rmdir(spark, d):
    files = views.doc_files(spark, d)
    dirs = stats.complete_dirs(files, views.doc_dirs(spark, d).unionByName(spark.createDataFrame([("void",)], "path string"), allowMissingColumns=True))
    return algebra.remove_dir(dirs, "void").select("path")


@query("M8_rename_file", f"WITH {_DOC} SELECT CASE WHEN path = (SELECT min(path) FROM doc_files) THEN 'moved/here.txt' ELSE path END AS path, size FROM doc_files")
def rename_file(spark, d):
    files = views.doc_files(spark, d)
    return algebra.rename(files, files.agg(F.min("path")).first()[0], "moved/here.txt").select("path", "size")


@query("M15_prefix", f"{_ARCHIVE} SELECT CASE WHEN path = '' THEN 'in/side' ELSE 'in/side/' || path END AS path FROM doc_dirs")
def prefix(spark, d):
    return algebra.prefixed(views.doc_dirs(spark, d), "in/side").select("path")


@query("M20_complete_index", f"WITH {_EVENT}, {_up('event_files')} SELECT dir AS path, count(*) AS num_files_tree, sum(size)::BIGINT AS size_tree FROM up GROUP BY 1")
def complete_index(spark, d):
    """All directories and counts of an index that has files alone."""
    return stats.complete_dirs(views.event_files(spark, d)).select("path", "num_files_tree", "size_tree")


@query("V2_verify", "SELECT 'x' AS problem, 'x' AS path WHERE false")
def verify(spark, d):
    return doc_archive(spark, d).verify()


@query("V4_mismatches", f"WITH {_DOC} SELECT path FROM doc_files WHERE size % 5 = 0")
def mismatches(spark, d):
    wrong = doc_archive(spark, d).contents(check=False).withColumn("crc32c", F.expr("crc32c + if(size % 5 = 0, 1, 0)"))
    return integrity.mismatches(wrong).select("path")


@query("U2_stacked", "SELECT 'v' || i::VARCHAR || '.json.gz' AS path, i * i AS value FROM range(20) t(i)")
def stacked(spark, d):
    codecs = Codecs()
    packed_up = [(f"v{i}.json.gz", codecs.encode(f"v{i}.json.gz", i * i)) for i in range(20)]
    return spark.createDataFrame([(n, codecs.decode(n, b)) for n, b in packed_up], "path string, value long")


@query("U3_json", "SELECT 'e/' || event_id::VARCHAR || '.json' AS path, json_extract(props, '$.k')::INTEGER AS k FROM events")
def json_of_events(spark, d):
    rows = views.read(spark, d, "events").select(F.concat(F.lit("e/"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.encode("props", "UTF-8").alias("content"))
    return json_values(rows).select("path", F.expr("variant_get(value, '$.k', 'int')").alias("k"))
