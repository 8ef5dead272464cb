"""The library's queries over archives made of ordinary tables, each with its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import globs, paths
from .operators import algebra, integrity, layout, listing, lookup, stats, sync
from .sources import views

LIMIT = 200_000  # bytes of a shard in the queries over documents
ORDER_LIMIT = 20_000_000

FILE_META = ["path", "parent", "shard", "offset", "size", "mode", "uid", "gid", "mtime_ns"]

# ---------------------------------------------------------------- SQL of the archives

_DOC = """doc_files AS (SELECT doc_id, source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path, source || '/' || lang AS parent,
 (doc_id % 3)::INTEGER AS shard, coalesce(sum(strlen(text)) OVER (PARTITION BY doc_id % 3 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
 strlen(text)::BIGINT AS size, 33188 AS mode, (1000 + doc_id % 5)::INTEGER AS uid, 100 AS gid, (1700000000000000000 + doc_id * 1000000007)::BIGINT AS mtime_ns FROM documents)"""
_EVENT = "event_files AS (SELECT 'events/' || strftime(ts, '%Y/%m/%d/%H') || '/' || event_type || '/' || event_id::VARCHAR || '.json' AS path, strlen(props)::BIGINT AS size FROM events)"
_ORDER = "order_files AS (SELECT 'orders/' || year(o_orderdate)::VARCHAR || '/' || o_orderstatus || '/' || lpad(o_orderkey::VARCHAR, 8, '0') || '.json' AS path, floor(o_totalprice)::BIGINT AS size FROM orders)"
_CONV = "conv_files AS (SELECT 'conv/' || lpad(conv_id::VARCHAR, 5, '0') || '/' || lpad(turn::VARCHAR, 3, '0') || '_' || role || '.txt' AS path, 'conv/' || lpad(conv_id::VARCHAR, 5, '0') AS parent, strlen(text)::BIGINT AS size FROM conversations)"
_PAGE = "page_files AS (SELECT 'web/' || regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '') || '/' || page_id::VARCHAR || '.html' AS path, strlen(html)::BIGINT AS size FROM pages)"


def _up(files: str) -> str:
    """Each file of a table with each of its ancestors."""
    return f"up AS (SELECT array_to_string(p[1:i], '/') AS dir, path, size FROM (SELECT path, size, string_split(path, '/') AS p, unnest(range(0, len(string_split(path, '/')))) AS i FROM {files}))"


_PARENT = "CASE WHEN path = '' THEN NULL ELSE regexp_replace(path, '/?[^/]*$', '') END"
_DIRS = f"""tree AS (SELECT dir AS path, count(*)::BIGINT AS num_files_tree, sum(size)::BIGINT AS size_tree FROM up GROUP BY 1),
doc_dirs AS (SELECT t.path, {_PARENT.replace('path', 't.path')} AS parent, (SELECT count(*) FROM tree c WHERE c.path <> '' AND regexp_replace(c.path, '/?[^/]*$', '') = t.path)::BIGINT AS num_subdirs,
 (SELECT count(*) FROM doc_files f WHERE f.parent = t.path)::BIGINT AS num_files, t.num_files_tree, t.size_tree FROM tree t)"""
_ARCHIVE = f"WITH {_DOC}, {_up('doc_files')}, {_DIRS}"
_LIVE = "doc_live AS (SELECT * FROM doc_files WHERE doc_id % 7 <> 3)"
_GAPS = """gaps AS (SELECT shard, from_ AS "offset", "offset" - from_ AS size FROM (SELECT shard, "offset", coalesce(lag("offset" + size) OVER (PARTITION BY shard ORDER BY "offset"), 0) AS from_ FROM doc_live WHERE size > 0) WHERE "offset" > from_)"""
_SYNC = "a AS (SELECT * FROM doc_files WHERE doc_id % 10 <> 0), b AS (SELECT path, size + CASE WHEN doc_id % 5 = 2 THEN 1 ELSE 0 END AS size, mtime_ns + CASE WHEN doc_id % 4 = 3 THEN 1 ELSE 0 END AS mtime_ns, shard, \"offset\", doc_id FROM doc_files WHERE doc_id % 10 <> 1)"


def _next_fit(files: str, order: str, limit: int) -> str:
    """shard, first_file, n_files, used of files in an order, by a recursion with one step a shard."""
    return f"""sizes AS (SELECT path, size, sum(size) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS e, row_number() OVER (ORDER BY {order}) AS n FROM {files}),
shards AS (SELECT 0 AS shard, 0::BIGINT AS base, 1::BIGINT AS first UNION ALL
 SELECT s.shard + 1, (SELECT x.e - x.size FROM sizes x WHERE x.n = (SELECT min(y.n) FROM sizes y WHERE y.e - s.base > {limit})), (SELECT min(y.n) FROM sizes y WHERE y.e - s.base > {limit})
 FROM shards s WHERE EXISTS (SELECT 1 FROM sizes y WHERE y.e - s.base > {limit})),
placed AS (SELECT z.path, z.size, s.shard, z.e - z.size - s.base AS "offset" FROM sizes z ASOF JOIN shards s ON z.n >= s.first)"""


# ---------------------------------------------------------------- queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


_META = 'path, parent, shard, "offset", size, mode, uid, gid, mtime_ns'


@query("S1_scan_files", f"WITH {_DOC} SELECT {_META} FROM doc_files")
def scan_files(spark, d):
    return lookup.scan_files(views.doc_files(spark, d), "address").select(*FILE_META)


@query("S2_scan_dirs", f"{_ARCHIVE} SELECT * FROM doc_dirs")
def scan_dirs(spark, d):
    return lookup.scan_dirs(views.doc_dirs(spark, d), "path").select("path", "parent", *stats.STATS)


@query("S3_union_entries", f"{_ARCHIVE} SELECT 'd' AS type, path, parent, size_tree AS size FROM doc_dirs UNION ALL SELECT 'f', path, parent, size FROM doc_files")
def union_entries(spark, d):
    return lookup.entries(views.doc_files(spark, d), views.doc_dirs(spark, d)).select("type", "path", "parent", "size")


@query("S4_all_paths", f"{_ARCHIVE} SELECT path FROM doc_dirs UNION ALL SELECT path FROM doc_files")
def all_paths(spark, d):
    return lookup.all_paths(views.doc_files(spark, d), views.doc_dirs(spark, d))


@query("S7_totals", f"{_ARCHIVE} SELECT (SELECT count(*) FROM doc_files) AS num_files, (SELECT count(*) FROM doc_dirs) AS num_dirs, (SELECT sum(size)::BIGINT FROM doc_files) AS total_size")
def totals(spark, d):
    return lookup.totals(views.doc_files(spark, d), views.doc_dirs(spark, d))


@query("S9_partial_read", f"WITH {_DOC} SELECT path, substr(text, 1, 8) AS head FROM doc_files JOIN documents USING (doc_id)")
def partial_read(spark, d):
    rows = views.doc_files(spark, d, content=True)
    return rows.select("path", F.substring(F.decode("content", "UTF-8"), 1, 8).alias("head"))


@query("S25_json_tree", f"{_ARCHIVE}, e AS (SELECT path, parent, size_tree AS size, 'd' AS type FROM doc_dirs UNION ALL SELECT path, parent, size, 'f' FROM doc_files) SELECT parent, count(*) AS n, sum(size)::BIGINT AS asize FROM e WHERE parent IS NOT NULL GROUP BY parent")
def json_tree(spark, d):
    rows = listing.json_tree(views.doc_files(spark, d), views.doc_dirs(spark, d))
    child = F.transform("children", lambda c: F.get_json_object(c, "$.asize").cast("long"))
    return rows.select("parent", F.size("children").cast("long").alias("n"), F.aggregate(child, F.lit(0).cast("long"), lambda a, x: a + x).alias("asize"))


_WANTED = "wanted AS (SELECT part_row AS pos, 'src' || (part_row % 20) || '/en/' || lpad((part_row % 25)::VARCHAR, 8, '0') || '.txt' AS path FROM (SELECT p_partkey AS part_row FROM part))"


def _wanted(spark, d):
    k = F.col("p_partkey")
    return views.read(spark, d, "part").select(k.alias("pos"), F.concat(F.lit("src"), (k % 20).cast("string"), F.lit("/en/"), F.lpad((k % 25).cast("string"), 8, "0"), F.lit(".txt")).alias("path"))


@query("L1_lookup_path", f'WITH {_DOC} SELECT path, shard, "offset", size FROM doc_files WHERE path = (SELECT max(path) FROM doc_files)')
def lookup_path(spark, d):
    files = views.doc_files(spark, d)
    return files.join(files.agg(F.max("path").alias("path")), "path").select("path", "shard", "offset", "size")


@query("L2_lookup_many", f"WITH {_DOC}, {_WANTED} SELECT pos, path, shard, size FROM wanted LEFT JOIN doc_files USING (path)")
def lookup_many(spark, d):
    return lookup.lookup_many(views.doc_files(spark, d), _wanted(spark, d)).select("pos", "path", "shard", "size")


@query("L5_exists_batch", f"WITH {_DOC}, {_WANTED} SELECT pos, path IN (SELECT path FROM doc_files) AS is_file FROM wanted")
def exists_batch(spark, d):
    wanted = _wanted(spark, d)
    kinds = lookup.membership(wanted.select("path").distinct(), views.doc_files(spark, d), views.doc_dirs(spark, d))
    return wanted.join(kinds, "path").select("pos", "is_file")


@query("L7_last_file", f'WITH {_DOC} SELECT path, shard, "offset", size FROM doc_files ORDER BY shard DESC, "offset" DESC, size DESC, path DESC LIMIT 1')
def last_file(spark, d):
    return lookup.last_file(views.doc_files(spark, d)).select("path", "shard", "offset", "size")


@query("L8_shard_ends", f'WITH {_DOC} SELECT shard, max("offset" + size)::BIGINT AS logical_end FROM doc_files GROUP BY shard')
def shard_ends(spark, d):
    return lookup.shard_ends(views.doc_files(spark, d))


@query("L9_used_shards", f"WITH {_DOC} SELECT (coalesce(max(shard), -1) + 1)::BIGINT AS num_used_shards FROM doc_files")
def used_shards(spark, d):
    return lookup.used_shards(views.doc_files(spark, d))


@query("L13_size_filter", f"WITH {_DOC} SELECT path, size FROM doc_files WHERE size > 4096")
def size_filter(spark, d):
    return lookup.find(lookup.entries(views.doc_files(spark, d), views.doc_dirs(spark, d)), kind="f", size="+4K").select("path", "size")


@query("L14_depth_hist", f"WITH {_EVENT} SELECT (length(path) - length(replace(path, '/', '')) + 1)::INTEGER AS depth, count(*) AS n FROM event_files GROUP BY 1")
def depth_hist(spark, d):
    return lookup.depths(views.event_files(spark, d))


@query("L15_subtree", f"WITH {_DOC} SELECT path FROM doc_files WHERE starts_with(path, 'src1/')")
def subtree(spark, d):
    return views.doc_files(spark, d).filter(paths.in_subtree(F.col("path"), "src1")).select("path")


@query("W1_direct_files", f"WITH {_DOC} SELECT path, size FROM doc_files WHERE parent = 'src3/en'")
def direct_files(spark, d):
    return listing.direct(views.doc_files(spark, d), "src3/en").select("path", "size")


@query("W2_subdirs", f"{_ARCHIVE} SELECT path, num_files, num_files_tree, size_tree FROM doc_dirs WHERE parent = 'src3'")
def subdirs(spark, d):
    return listing.direct(views.doc_dirs(spark, d), "src3").select("path", "num_files", "num_files_tree", "size_tree")


@query("W3_listdir", f"{_ARCHIVE} SELECT regexp_replace(path, '^.*/', '') AS name FROM (SELECT path, parent FROM doc_dirs UNION ALL SELECT path, parent FROM doc_files) WHERE parent = 'src3'")
def listdir(spark, d):
    return listing.names(views.doc_files(spark, d), views.doc_dirs(spark, d), "src3")


@query("W4_scandir", f"{_ARCHIVE} SELECT type, path, size FROM (SELECT 'd' AS type, path, parent, size_tree AS size FROM doc_dirs UNION ALL SELECT 'f', path, parent, size FROM doc_files) WHERE parent = 'src2/en'")
def scandir(spark, d):
    return listing.scandir(views.doc_files(spark, d), views.doc_dirs(spark, d), "src2/en").select("type", "path", "size")


@query("W5_walk", f"{_ARCHIVE} SELECT path, coalesce((SELECT string_agg(regexp_replace(c.path, '^.*/', ''), ',' ORDER BY c.path) FROM doc_dirs c WHERE c.parent = t.path), '') AS subdirs, coalesce((SELECT string_agg(regexp_replace(f.path, '^.*/', ''), ',' ORDER BY f.path) FROM doc_files f WHERE f.parent = t.path), '') AS files FROM doc_dirs t")
def walk(spark, d):
    rows = listing.walk(views.doc_files(spark, d), views.doc_dirs(spark, d))
    return rows.select("path", F.array_join("subdirs", ",").alias("subdirs"), F.array_join("files", ",").alias("files"))


@query("W7_find", f"{_ARCHIVE} SELECT path, size FROM doc_files WHERE starts_with(path, 'src1/') AND regexp_matches(path, '/[0-9]*1\\.txt$') AND size > 1024")
def find(spark, d):
    both = lookup.entries(views.doc_files(spark, d), views.doc_dirs(spark, d))
    return lookup.find(both, "src1", name="*1.txt", kind="f", size="+1K", maxdepth=2).select("path", "size")


@query("W8_tree", f"{_ARCHIVE} SELECT path, (length(path) - length(replace(path, '/', '')) + 1)::INTEGER AS depth FROM doc_dirs WHERE path <> ''")
def tree(spark, d):
    return listing.tree(views.doc_files(spark, d), views.doc_dirs(spark, d), dirs_only=True).select("path", "depth")


@query("W9_du", f"WITH {_EVENT}, {_up('event_files')} SELECT dir AS path, sum(size)::BIGINT AS size FROM up WHERE length(dir) - length(replace(dir, '/', '')) <= 2 GROUP BY 1")
def du(spark, d):
    files = views.event_files(spark, d)
    return listing.disk_usage(files, stats.tree_stats(files), maxdepth=3)


@query("W10_ncdu", f"{_ARCHIVE} SELECT path AS name, size_tree AS size, round(size_tree / sum(size_tree) OVER (), 9) AS share FROM doc_dirs WHERE parent = ''")
def ncdu(spark, d):
    return listing.shares(views.doc_files(spark, d), views.doc_dirs(spark, d)).select("name", "size", F.round("share", 9).alias("share"))


@query("W12_lss", f"WITH {_DOC} SELECT parent, '********.txt' AS pattern, count(*) AS n, min(regexp_extract(path, '([0-9]+)\\.txt$', 1)) AS first, max(regexp_extract(path, '([0-9]+)\\.txt$', 1)) AS last FROM doc_files GROUP BY parent HAVING count(*) >= 5 UNION ALL SELECT parent, regexp_replace(path, '^.*/', ''), 1, NULL, NULL FROM doc_files WHERE parent IN (SELECT parent FROM doc_files GROUP BY parent HAVING count(*) < 5)")
def lss(spark, d):
    return listing.sequences(views.doc_files(spark, d))


def _glob(name: str, pattern: str, sql: str, view: str = "doc", **how):
    source = {"doc": ("doc_files", _DOC, views.doc_files), "page": ("page_files", _PAGE, views.page_files), "conv": ("conv_files", _CONV, views.conv_files)}[view]

    @query(name, f"WITH {source[1]} SELECT path FROM {source[0]} WHERE {sql}")
    def run(spark, d):
        return source[2](spark, d).filter(globs.matches(F.col("path"), pattern, **how)).select("path")


_glob("G1_glob_star", "src1*/en/*1.txt", "regexp_matches(path, '^src1[^/]*/en/[^/]*1\\.txt$')")
_glob("G1_glob_recursive", "**/de/*[02468].txt", "regexp_matches(path, '(^|/)de/[^/]*[02468]\\.txt$')", recursive=True)
_glob("G1_glob_bracket", "src[!1-9]*/??/*.txt", "regexp_matches(path, '^src[^/1-9][^/]*/[^/][^/]/[^/]*\\.txt$')")
_glob("G1_glob_pages", "web/**/en/**/*.html", "regexp_matches(path, '^web/(.*/)?en/(.*/)?[^/]*\\.html$') AND NOT regexp_matches(path, '/\\.')", view="page", recursive=True)
_glob("G2_globfiles", "conv/*/00[0-3]_user.txt", "regexp_matches(path, '^conv/[^/]+/00[0-3]_user\\.txt$')", view="conv")


@query("G4_raw_glob", f"WITH {_DOC} SELECT path FROM doc_files WHERE path GLOB 'src*en*[0-4].txt'")
def raw_glob(spark, d):
    return views.doc_files(spark, d).filter(globs.matches_raw(F.col("path"), "src*en*[0-4].txt")).select("path")


@query("G5_raw_incl_excl", f"WITH {_DOC} SELECT path FROM doc_files WHERE path GLOB 'src1/*' OR path GLOB '*/fr/*' AND NOT path GLOB '*3.txt' AND NOT path GLOB 'src5*' OR path GLOB '*/es/*7.txt'")
def raw_incl_excl(spark, d):
    rules = [(True, "src1/*"), (True, "*/fr/*"), (False, "*3.txt"), (False, "src5*"), (True, "*/es/*7.txt")]
    return views.doc_files(spark, d).filter(globs.raw_chain(F.col("path"), rules)).select("path")


@query("G6_first_match_wins", f"WITH {_DOC} SELECT path FROM doc_files WHERE CASE WHEN regexp_matches(path, '^src1/[^/]*/[^/]*[24]1\\.txt$') THEN true WHEN regexp_matches(path, '^src1(/.*)?$') THEN false WHEN regexp_matches(path, '^(.*/)?de/[^/]*$') THEN false ELSE true END")
def first_match_wins(spark, d):
    rules = [(True, "src1/*/*[24]1.txt"), (False, "src1/**"), (False, "**/de/*")]
    return views.doc_files(spark, d).filter(globs.first_match(F.col("path"), rules)).select("path")


@query("G12_build_filter", f"WITH {_DOC} SELECT path FROM doc_files WHERE (regexp_matches(path, '^(.*/)?en/[^/]*$') OR regexp_matches(path, '^src2/.*$')) AND NOT regexp_matches(path, '^(.*/)?[^/]*9\\.txt$')")
def build_filter(spark, d):
    return views.doc_files(spark, d).filter(globs.build_filter(F.col("path"), ["**/en/*", "src2/**"], ["**/*9.txt"])).select("path")


@query("G13_rsync_filter", f"WITH {_DOC} SELECT path FROM doc_files WHERE NOT (regexp_matches(path, '[0-4]\\.txt$') AND NOT regexp_matches(path, '/[^/]*12[^/]*$'))")
def rsync_filter(spark, d):
    return views.doc_files(spark, d).filter(globs.sync_filter(F.col("path"), ["*12*"], ["*[0-4].txt"])).select("path")


@query("T1_treestats", f"WITH {_EVENT}, {_up('event_files')} SELECT dir AS path, count(*) AS num_files_tree, sum(size)::BIGINT AS size_tree FROM up GROUP BY 1")
def treestats(spark, d):
    return stats.tree_stats(views.event_files(spark, d))


@query("T2_dir_closure", f"WITH {_PAGE}, {_up('page_files')} SELECT DISTINCT dir AS path FROM up")
def dir_closure(spark, d):
    return stats.close_dirs(views.page_files(spark, d))


@query("T3_direct_counts", f"{_ARCHIVE} SELECT path, num_files, num_subdirs FROM doc_dirs")
def direct_counts(spark, d):
    files = views.doc_files(spark, d)
    return stats.direct_counts(files, stats.complete_dirs(files)).select("path", "num_files", "num_subdirs")


@query("T4_delta_maintenance", f"WITH {_DOC}, live AS (SELECT * FROM doc_files WHERE doc_id % 11 <> 4), {_up('live')} SELECT dir AS path, count(*) AS num_files_tree, sum(size)::BIGINT AS size_tree FROM up GROUP BY 1")
def delta_maintenance(spark, d):
    files = views.doc_files(spark, d)
    before = stats.complete_dirs(files.filter("doc_id % 11 <> 5"))
    after = stats.apply_changes(before, files.filter("doc_id % 11 = 5"), files.filter("doc_id % 11 = 4"))
    return after.filter("num_files_tree > 0").select("path", "num_files_tree", "size_tree")


@query("T8_outlier_threshold", f"WITH {_ORDER} SELECT size AS threshold FROM (SELECT size, row_number() OVER (ORDER BY size) AS r, count(*) OVER () AS n FROM order_files) WHERE r = n * 95 // 100 + 1")
def outlier_threshold(spark, d):
    return layout.outlier_threshold(views.order_files(spark, d))


@query("T9_gap_stats", f'WITH {_DOC}, {_LIVE}, {_GAPS}, g AS (SELECT shard, sum(size)::BIGINT AS gap_bytes, count(*) AS gaps, max(size)::BIGINT AS largest FROM gaps GROUP BY 1), u AS (SELECT shard, sum(size)::BIGINT AS used_bytes, max("offset" + size) AS extent FROM doc_live GROUP BY 1) SELECT shard, coalesce(gap_bytes, 0) AS gap_bytes, coalesce(gaps, 0) AS gaps, coalesce(largest, 0) AS largest, used_bytes, round(used_bytes / extent, 9) AS density FROM u LEFT JOIN g USING (shard)')
def gap_stats(spark, d):
    return layout.gap_stats(views.doc_live(spark, d)).withColumn("density", F.round("density", 9))


@query("T10_gap_distribution", f"WITH {_DOC}, {_LIVE}, {_GAPS}, r AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM gaps) SELECT count(*) AS n, min(size)::BIGINT AS least, max(size)::BIGINT AS most, " + ", ".join(f"min(CASE WHEN i = least(n * {a} // {b}, n - 1) THEN size END)::BIGINT AS p{a * 100 // b}" for a, b in ((1, 4), (1, 2), (3, 4), (9, 10), (99, 100))) + " FROM r")
def gap_distribution(spark, d):
    return layout.gap_distribution(views.doc_live(spark, d)).drop("mean")


@query("P1_next_fit", f"WITH RECURSIVE {_DOC}, {_next_fit('doc_files', 'doc_id', LIMIT)} SELECT path, shard, \"offset\" FROM placed")
def next_fit(spark, d):
    rows = layout.place(views.doc_files(spark, d), LIMIT, ["doc_id"])
    return rows.select("path", F.col("new_shard").cast("int").alias("shard"), F.col("new_offset").alias("offset"))


@query("P3_gaps", f'WITH {_DOC}, {_LIVE}, {_GAPS} SELECT shard, "offset", size FROM gaps')
def gaps(spark, d):
    return layout.gaps(views.doc_live(spark, d))


@query("P4_find_space", f'WITH {_DOC}, {_LIVE}, {_GAPS}, holes AS (SELECT * FROM gaps UNION ALL SELECT shard, max("offset" + size), 1099511627776 - max("offset" + size) FROM doc_live GROUP BY shard) SELECT shard, "offset"::BIGINT AS "offset", size::BIGINT AS size FROM holes WHERE size >= 5000 ORDER BY shard, "offset" LIMIT 1')
def find_space(spark, d):
    return layout.find_space(views.doc_live(spark, d), 5000, 2**40)


@query("P5_islands", f'WITH {_DOC}, {_LIVE}, m AS (SELECT *, CASE WHEN "offset" = lag("offset" + size) OVER (PARTITION BY shard ORDER BY "offset", size) THEN 0 ELSE 1 END AS n FROM doc_live), r AS (SELECT *, sum(n) OVER (PARTITION BY shard ORDER BY "offset", size ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT shard, min("offset")::BIGINT AS "offset", sum(size)::BIGINT AS size, count(*) AS n_files FROM r GROUP BY shard, run')
def islands(spark, d):
    return layout.islands(views.doc_live(spark, d))


@query("P6_defrag_plan", f'WITH RECURSIVE {_DOC}, {_LIVE}, {_next_fit("doc_live", chr(34) + "shard" + chr(34) + ", " + chr(34) + "offset" + chr(34) + ", size, path", LIMIT)} SELECT path, shard AS new_shard, "offset" AS new_offset FROM placed')
def defrag_plan(spark, d):
    return layout.defrag_plan(views.doc_live(spark, d), LIMIT).select("path", "new_shard", "new_offset")


@query("P7_defrag_copies", f'WITH {_DOC}, {_LIVE}, n AS (SELECT *, sum(size) OVER (ORDER BY shard, "offset", size, path ROWS UNBOUNDED PRECEDING)::BIGINT - size AS new_offset FROM doc_live) SELECT sum(size)::BIGINT AS moved_bytes, count(*) AS moved_files FROM n WHERE shard <> 0 OR "offset" <> new_offset')
def defrag_copies(spark, d):
    moved = layout.copies(layout.defrag_plan(views.doc_live(spark, d)))
    return moved.agg(F.sum("size").alias("moved_bytes"), F.sum("n_files").alias("moved_files"))


@query("P9_reshard", f"WITH RECURSIVE {_ORDER}, {_next_fit('order_files', 'path', ORDER_LIMIT)} SELECT shard, count(*) AS n_files, sum(size)::BIGINT AS used FROM placed GROUP BY shard")
def reshard(spark, d):
    rows = layout.place(views.order_files(spark, d), ORDER_LIMIT, ["path"])
    return rows.groupBy(F.col("new_shard").cast("int").alias("shard")).agg(F.count("*").alias("n_files"), F.sum("size").alias("used"))


@query("M5_remove", f"WITH {_DOC} SELECT path FROM doc_files WHERE doc_id % 7 <> 3")
def remove(spark, d):
    files = views.doc_files(spark, d)
    return algebra.remove(files, files.filter("doc_id % 7 = 3")).select("path")


@query("M7_rmtree", f"WITH {_DOC} SELECT path FROM doc_files WHERE NOT starts_with(path, 'src1/')")
def rmtree(spark, d):
    return algebra.remove_tree(views.doc_files(spark, d), "src1").select("path")


@query("M9_rename_dir", f"WITH {_DOC} SELECT CASE WHEN starts_with(path, 'src1/') THEN 'old/one/' || substr(path, 6) ELSE path END AS path, CASE WHEN starts_with(path, 'src1/') THEN 'old/one/' || substr(parent, 6) ELSE parent END AS parent, size FROM doc_files")
def rename_dir(spark, d):
    return algebra.rename(views.doc_files(spark, d), "src1", "old/one").select("path", "parent", "size")


@query("M10_chmod", f"WITH {_DOC} SELECT path, CASE WHEN path = 'src0/fr/00000000.txt' THEN 33152 ELSE mode END AS mode FROM doc_files")
def chmod(spark, d):
    return algebra.set_meta(views.doc_files(spark, d), "src0/fr/00000000.txt", mode=33152).select("path", "mode")


@query("M11_merge_keep_first", f"WITH {_DOC}, {_SYNC} SELECT path, size FROM a UNION ALL SELECT path, size FROM b WHERE path NOT IN (SELECT path FROM a)")
def merge_keep_first(spark, d):
    a, b = views.sync_sides(spark, d)
    return algebra.merge_files(a, b.select(*a.columns), 2**40, ignore_duplicates=True).select("path", "size")


@query("M12_subset", f"WITH RECURSIVE {_DOC}, en AS (SELECT * FROM doc_files WHERE regexp_matches(path, '^(.*/)?en/[^/]*$')), {_next_fit('en', 'shard, ' + chr(34) + 'offset' + chr(34) + ', size, path', LIMIT)} SELECT path, shard, \"offset\" FROM placed")
def subset(spark, d):
    return algebra.subset(views.doc_files(spark, d), LIMIT, "**/en/*").select("path", "shard", "offset")


@query("M13_merge_indexes", f"WITH {_DOC}, {_SYNC} SELECT path, shard FROM a UNION ALL SELECT 'b/' || path, shard + (SELECT max(shard) + 1 FROM a) FROM b")
def merge_indexes(spark, d):
    a, b = views.sync_sides(spark, d)
    return algebra.merge_indexes(a, b.select(*a.columns), prefix="b").select("path", "shard")


@query("M14_conflicts", f"{_ARCHIVE} SELECT 'file over directory' AS kind, path FROM doc_dirs WHERE num_files > 0 AND num_files % 3 = 0")
def conflicts(spark, d):
    files, dirs = views.doc_files(spark, d), views.doc_dirs(spark, d)
    source = dirs.filter("num_files > 0 and num_files % 3 = 0").select("path")
    return algebra.conflicts(source, dirs.select("path").limit(0), files, dirs)


@query("M16_sync_actions", f"WITH {_DOC}, {_SYNC} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'delete' WHEN b.path IS NULL THEN 'add' WHEN a.size = b.size AND a.mtime_ns = b.mtime_ns THEN 'skip' ELSE 'update' END AS action FROM a FULL JOIN b ON a.path = b.path")
def sync_actions(spark, d):
    a, b = views.sync_sides(spark, d)
    return sync.actions(a, b, sync.Options(delete=True)).select("path", "action")


@query("M17_sync_delete", f"WITH {_DOC}, {_SYNC} SELECT path FROM b WHERE path NOT IN (SELECT path FROM a)")
def sync_delete(spark, d):
    a, b = views.sync_sides(spark, d)
    return sync.to_delete(a, b)


@query("V3_verify_stats", f"{_ARCHIVE} SELECT 'stale counts' AS problem, path FROM doc_dirs WHERE num_files_tree % 5 = 2")
def verify_stats(spark, d):
    files, dirs = views.doc_files(spark, d), views.doc_dirs(spark, d)
    bad = dirs.withColumn("size_tree", F.expr("size_tree + if(num_files_tree % 5 = 2, 1, 0)"))
    return stats.index_problems(files, bad)


def _crc32c_sql() -> str:
    """CRC32C a half byte at a time: hexadecimal digits, the lower one of each byte first, through a table of 16."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    digits = "CASE WHEN strlen(text) = 0 THEN [] ELSE list_transform(string_split(regexp_replace(hex(encode(text)), '(.)(.)', '\\2\\1', 'g'), ''), lambda c: (instr('0123456789ABCDEF', c) - 1)::BIGINT) END"
    step = f"lambda c, x: xor(({table}::BIGINT[])[xor(c & 15, x) + 1], c >> 4)"
    return f"WITH {_DOC} SELECT path, xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), {step}), 4294967295::BIGINT)::BIGINT AS crc32c FROM doc_files JOIN documents USING (doc_id)"


@query("V1_crc32c", _crc32c_sql())
def crc32c(spark, d):
    return integrity.checksums(views.doc_files(spark, d, content=True))


@query("U5_sql", f"WITH {_DOC} SELECT parent, count(*) AS n, sum(size)::BIGINT AS bytes FROM doc_files GROUP BY parent HAVING count(*) > 3")
def ad_hoc_sql(spark, d):
    return spark.sql("SELECT parent, count(*) AS n, sum(size) AS bytes FROM {files} GROUP BY parent HAVING count(*) > 3", files=views.doc_files(spark, d))


@query("J1_attach_stats", f"{_ARCHIVE} SELECT path, num_subdirs, num_files, num_files_tree, size_tree FROM doc_dirs")
def attach_stats(spark, d):
    return views.doc_dirs(spark, d).select("path", *stats.STATS)


@query("O1_order_path", f"WITH {_DOC} SELECT path, row_number() OVER (PARTITION BY parent ORDER BY path)::INTEGER AS place FROM doc_files")
def order_path(spark, d):
    return views.doc_files(spark, d).select("path", F.row_number().over(Window.partitionBy("parent").orderBy("path")).alias("place"))


from . import archive_queries  # noqa: E402, F401  registers its queries here
