"""Chat formatting by quotation linking.

Lines that start with ``>`` are quotes, as many levels deep as they have marks (spaces between them allowed). Quoted lines of one
level that follow each other are a passage, parted at blank lines into paragraphs. Each passage and paragraph is normalised
(words of letters and digits in lower case, whatever lines they stand on) and hashed, and so is each of its lines of ``LEAST``
words or more, for passages that are quoted in part. They are joined to the latest earlier message of their conversation that
has the same as its whole text, paragraph or line. A message replies to the message that most words of its outermost linked
quotes come from (the latest of several), without any to the message before it. Conversations come out in reply order: a
message is followed by the thread that goes on from it, then by what else replies to it, the later place first; quotes are
left out.

A passage meets its originals in a running window over (conversation, hash), never as pairs. Messages are numbered in range
partitions with the counts of earlier ones carried over, so a hot conversation, or a hot turn in it, is many groups. Where
threads branch, their places follow from a tour of the tree of branches, ranked by pointer jumping: rounds grow with the
logarithm of the branches of a conversation, however deep these are nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKET, PART = 4096, 1000
#: Words of a line that links by itself.
LEAST = 3

_MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.S)
_WORD = re.compile(r"[^\W_]+")


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, str]], list[int]]:
    """The body without quoted lines (blank lines at its ends and repeated ones folded), the quoted lines with their levels, and
    the numbers of the lines on which they stand. An attribution line (one that ends in a colon right before a quote) is not part of the body."""
    own, quotes, places = [], [], []
    for n, line in enumerate((text or "").split("\n")):
        m = _MARKS.match(line)
        if m:
            if own and not (quotes and own[-1] is None) and (own[-1] or "").rstrip().endswith(":"):
                own.pop()
            quotes.append((m.group(1).count(">"), m.group(2)))
            places.append(n)
            own.append(None)
        else:
            own.append(line)
    body = "\n".join(x for x in own if x is not None)
    return re.sub(r"\n\s*\n+", "\n\n", body).strip("\n") if quotes else body, quotes, places


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def passage_hash(words: list[str]) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63)


def units(lines: list[str]) -> dict[int, int]:
    """Hash and number of words of a passage, its paragraphs, and its lines of LEAST words or more."""
    each = [words_of(x) for x in lines]
    found, paragraph = [[w for x in each for w in x]], []
    for words, line in zip([*each, []], [*lines, ""]):
        if line.strip():
            paragraph += words
        else:
            found.append(paragraph)
            paragraph = []
    found += [x for x in each if len(x) >= LEAST]
    return {passage_hash(x): len(x) for x in found if x}


def quoted_units(quotes: list[tuple[int, str]], places: list[int]) -> list[tuple[int, int, int, int]]:
    """(passage, level, hash, words) of each unit of each quoted passage: lines of one level at places that follow each other."""
    out, n, i = [], 0, 0
    while i < len(quotes):
        j = i + 1
        while j < len(quotes) and quotes[j][0] == quotes[i][0] and places[j] == places[j - 1] + 1:
            j += 1
        found = units([x for _, x in quotes[i:j]])
        out += [(n, quotes[i][0], h, k) for h, k in found.items()]
        n, i = n + bool(found), j
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over conv_id, turn, role, text, bucket in order: bodies and hashes, and n, a row's number in its conversation's part."""
    n, last = 0, ()
    quote = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("line", pa.int64()), ("words", pa.int32())]))
    for batch in common.pieces(batches):
        bodies, own, quoted = [], [], []
        for text in batch.column(3):
            body, quotes, places = split_quotes(text.as_py())
            bodies.append(body)
            own.append(sorted(units(body.split("\n"))))
            quoted.append([dict(zip(("passage", "level", "line", "words"), x)) for x in quoted_units(quotes, places)])
        numbers = []
        for conversation in batch.column(0).to_pylist():
            n, last = n + 1 if (conversation,) == last else 1, (conversation,)
            numbers.append(n)
        arrays = [*(batch.column(i) for i in range(3)), pa.array(bodies, pa.string()), pa.array(own, pa.list_(pa.int64())), pa.array(quoted, quote), batch.column(4), pa.array(numbers, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "role", "body", "own", "quotes", "bucket", "n"])


def _offsets(branches: DataFrame) -> DataFrame:
    """branches (key, branch, size, over: the branch that it hangs on, hangs: where; null for the first) -> key, branch, offset:
    how many messages stand before it in reply order. A tour enters and leaves each branch (elements 2 * branch and 2 * branch +
    1), its own branches in their order between; what lies behind an element is summed up by pointer jumping."""
    order = Window.partitionBy("key", "over").orderBy(F.desc("hangs"), "branch")
    kin = branches.withColumns({"beside": F.lead("branch").over(order), "_r": F.row_number().over(order)})
    first = kin.filter("over is not null and _r = 1").select("key", F.col("over").alias("branch"), F.col("branch").alias("child"))
    kin = common.stored(kin.join(first, ["key", "branch"], "left"), "branch-kin")
    enter = kin.select("key", (F.col("branch") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("branch") * 2 + 1).alias("next"), F.col("size").alias("w"))
    beside = F.when(F.col("over").isNotNull(), F.coalesce(F.col("beside") * 2, F.col("over") * 2 + 1))
    leave = kin.select("key", (F.col("branch") * 2 + 1).alias("e"), beside.alias("next"), F.lit(0).cast("long").alias("w"))
    tour = common.stored(enter.unionByName(leave), "branch-tour")
    while not tour.filter("next is not null").isEmpty():
        to = tour.select("key", F.col("e").alias("next"), F.col("next").alias("_next"), F.col("w").alias("_w"))
        before, tour = tour, common.stored(tour.join(to, ["key", "next"], "left").select("key", "e", F.col("_next").alias("next"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")), "branch-tour")
        common.discard(before)
    total = branches.groupBy("key").agg(F.sum("size").alias("total"))
    return tour.filter("e % 2 = 0").join(total, "key").select("key", F.expr("e div 2").alias("branch"), (F.col("total") - F.col("w")).alias("offset"))


def link_messages(conversations: DataFrame) -> DataFrame:
    """Per row of conversations: conv_id, turn, role, seq (its number in the conversation), reply_to (the seq it replies to, null
    for the first), parent_turn, n_quoted and n_linked (quoted passages with words; those found, whole or in part), position (from
    1, in reply order), body.

    Null conversations are one conversation, null turns come first, a null role is 'unknown', a null text is empty. Rows of the
    same turn are ordered by role and text; repeated rows each count. An empty table gives no rows. Other columns are left out,
    whatever their names.
    """
    # range partitions in the order of messages: however hot a conversation or a turn is, its rows are in many
    order = ["conv_id", "turn", "role", "_h"]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("unknown")).alias("role"), "text")
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("bucket", F.spark_partition_id()).drop("_h")
    rows = rows.mapInArrow(_parsed, "conv_id long, turn long, role string, body string, own array<long>, quotes array<struct<passage:int,level:int,line:long,words:int>>, bucket int, n long")
    rows = common.stored(rows, "messages")
    base = rows.groupBy("conv_id", "bucket").count().select(F.col("conv_id").alias("_c"), F.col("bucket").alias("_b"), F.coalesce(F.sum("count").over(Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = common.joinable(common.stored(base, "message-counts"))
    rows = rows.join(base, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("bucket").eqNullSafe(F.col("_b"))).withColumn("seq", F.col("base") + F.col("n")).drop("_c", "_b", "base", "n")
    rows = common.stored(rows, "messages")
    # bodies come back at the end; until then rows are narrow
    bodies = rows.select(F.col("conv_id").alias("_c"), F.col("seq").alias("_s"), "body")

    quoted = rows.select("conv_id", "seq", F.explode("quotes").alias("q")).select("conv_id", "seq", F.col("q.level").alias("level"), F.col("q.line").alias("line"), F.col("q.words").alias("words"), F.col("q.passage").alias("passage"))
    own = rows.select("conv_id", "seq", F.explode("own").alias("line"))
    wanted = quoted.select(F.col("conv_id").alias("_c"), F.col("line").alias("_l")).distinct()
    own = own.join(wanted, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("line") == F.col("_l")), "left_semi")
    lines = quoted.withColumn("origin", F.lit(None).cast("long")).unionByName(own.withColumn("level", F.lit(0)).withColumn("origin", F.col("seq")), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "line").orderBy("seq", F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    linked = lines.withColumn("origin", F.last("origin", ignorenulls=True).over(before)).filter("level > 0 and origin is not null and origin < seq")
    votes = linked.groupBy("conv_id", "seq", "level", "origin").agg(F.sum("words").alias("words"), F.collect_set("passage").alias("passages"))
    best = votes.groupBy("conv_id", "seq").agg(F.min_by("origin", F.struct(F.col("level"), -F.col("words"), -F.col("origin"))).alias("origin"), F.size(F.array_distinct(F.flatten(F.collect_list("passages")))).cast("long").alias("n_linked"))
    best = best.select(F.col("conv_id").alias("_c"), F.col("seq").alias("_s"), "origin", "n_linked")
    rows = rows.join(best, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seq") == F.col("_s")), "left").drop("_c", "_s")
    rows = rows.withColumn("reply_to", F.coalesce("origin", F.when(F.col("seq") > 1, F.col("seq") - 1)))

    # a branch starts where a message does not go on from the one before it
    rows = rows.withColumn("start", F.when((F.col("seq") == 1) | (F.col("reply_to") != F.col("seq") - 1), F.col("seq"))).withColumn("_k", F.floor(F.col("seq") / BUCKET))
    rows = common.stored(rows.select("conv_id", "turn", "role", "seq", "reply_to", F.size(F.array_distinct("quotes.passage")).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "start", "_k"), "replies")
    top = rows.groupBy("conv_id", "_k").agg(F.max("start").alias("start"))
    top = top.select(F.col("conv_id").alias("_c"), F.col("_k").alias("_b"), F.max("start").over(Window.partitionBy("conv_id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)).alias("so_far"))
    running = F.max("start").over(Window.partitionBy("conv_id", "_k").orderBy("seq"))
    rows = rows.withColumn("branch", running).join(top, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_k") == F.col("_b")))
    rows = common.stored(rows.withColumn("branch", F.coalesce("branch", "so_far")).drop("_c", "_b", "_k", "so_far", "start"), "branches")

    # branches: where each hangs, then its offset in reply order
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")
    sizes = rows.groupBy("conv_id", "branch").agg(F.count("*").alias("size"), F.min_by("reply_to", "seq").alias("hangs")).select(key, "branch", "size", "hangs")
    sizes = common.stored(sizes, "branch-sizes")
    many = sizes.filter("hangs is not null").select("key").distinct()
    if many.isEmpty():
        offsets = sizes.select("key", "branch", F.lit(0).cast("long").alias("offset"))
    else:
        hanging = sizes.join(many, "key", "left_semi")
        place = rows.select(key, F.col("seq").alias("hangs"), F.col("branch").alias("over"))
        tree = common.stored(hanging.join(place, ["key", "hangs"], "left"), "branch-tree")
        offsets = _offsets(tree).unionByName(sizes.join(many, "key", "left_anti").select("key", "branch", F.lit(0).cast("long").alias("offset")))
    offsets = offsets.select(F.col("key").alias("_c"), F.col("branch").alias("_b"), "offset")
    rows = rows.withColumn("key", key).join(offsets, (F.col("key") == F.col("_c")) & (F.col("branch") == F.col("_b"))).withColumn("position", F.col("offset") + F.col("seq") - F.col("branch") + 1).drop("key")
    turns = rows.select(F.col("conv_id").alias("_p"), F.col("seq").alias("_q"), F.col("turn").alias("parent_turn"))
    rows = rows.drop("_c", "_b", "offset", "branch").join(turns, F.col("conv_id").eqNullSafe(F.col("_p")) & (F.col("reply_to") == F.col("_q")), "left")
    rows = rows.join(bodies, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seq") == F.col("_s")))
    return rows.select("conv_id", "turn", "role", "seq", "reply_to", "parent_turn", "n_quoted", "n_linked", "position", "body")


def chat_texts(linked: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, part, n_messages, chat: linked messages in reply order as ``<|role|>`` and body, part messages a row at most."""
    turn = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>\n"))
    rows = linked.select("conv_id", F.floor((F.col("position") - 1) / part).alias("part"), F.struct("position", turn.alias("said")).alias("m"))
    return rows.groupBy("conv_id", "part").agg(F.count("*").alias("n_messages"), F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["said"]), "").alias("chat"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in reply order: conv_id, part, n_messages, n_chars, chat_sha256. Nulls, repeated rows, empty tables and
    further columns (clashing names too) as in ``link_messages``; a message of any length is whole."""
    chats = chat_texts(link_messages(common.table(spark, sf_dir, "conversations")))
    return chats.select("conv_id", "part", "n_messages", F.length("chat").cast("long").alias("n_chars"), F.sha2(F.col("chat").cast("binary"), 256).alias("chat_sha256"))
