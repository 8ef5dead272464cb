"""Token-ID output: Parquet list columns that allow selective reads of tokens and of metadata.

Layout of the files, in ascending order of (doc_id, hash of the text) from file to file and within each:

- ``doc_id``, ``part``, ``local_start``, ``n_tokens``: delta-encoded integers (format version 2);
- ``ids``: list of 32-bit ids, dictionary-encoded (a vocabulary of 50 k ids fits one dictionary page, so an id takes 16
  bits or fewer before compression).

Row groups and pages are bounded (``ROW_GROUP``, ``PAGE``, ``PAGE_ROWS``) and carry page indexes, so that a reader of a
few documents or of the metadata alone touches only their pages. A document's start in the whole corpus is
``local_start`` plus the tokens of all earlier parts: the sums of the parts are read from the metadata columns alone.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from string import punctuation
from struct import Struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 128 << 10, 500
#: Pieces of up to so many characters are remembered with their ids, up to so many of them in each of two generations.
WORD, WORDS = 48, 300_000
#: Documents in a batch that goes back to Spark; bytes of texts that are encoded at once (a longer text by itself).
ROWS, BYTES_AT_ONCE = 256, 4 << 20

#: The characters by which a byte-level BPE writes bytes: printable ones stand for themselves, the others follow from 256 on.
BYTES = {}
for _byte in range(256):
    if not (33 <= _byte <= 126 or 161 <= _byte <= 172 or _byte >= 174):
        BYTES[_byte] = 256 + len(BYTES)

#: Classes of bytes: of longer characters, white space and control characters, letters, digits, the apostrophe, other signs, and
#: first bytes of characters some of which are white space.
_LONG, _BLANK, _LETTER, _DIGIT, _APOSTROPHE, _SIGN, _LEAD = range(7)
_CLASS = np.array(
    [_BLANK if c <= 32 or c == 127 else _LEAD if c in (0xC2, 0xE1, 0xE2, 0xE3) else _LONG if c > 127 else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _APOSTROPHE if c == 39 else _SIGN for c in range(256)],
    np.uint8,
)
#: Whether a piece may begin between two bytes, by 8 * the first one's class + the second one's.
_CUT = np.zeros(64, bool)
for _a, _b in ((_LETTER, _DIGIT), (_LETTER, _APOSTROPHE), (_LETTER, _SIGN), (_DIGIT, _LETTER), (_DIGIT, _APOSTROPHE), (_DIGIT, _SIGN), (_APOSTROPHE, _DIGIT), (_SIGN, _LETTER), (_SIGN, _DIGIT)):
    _CUT[8 * _a + _b] = True
_PACK = [Struct(f"<{n}i").pack for n in range(WORD + 1)]


class Pieces(dict):
    """Ids by piece of a text, as little-endian 32-bit integers.

    When this younger generation is full, it becomes the older and what the older held is forgotten, so frequent pieces stay
    and memory is bounded.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.tokenize, self.old, self.space = tokenizer, tokenizer.model.tokenize, {}, " ".translate(BYTES)

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            word = piece[1:] if piece[:1] == " " else piece
            if len(piece) <= WORD // 2 and word.isalpha():  # one piece of the pattern: it needs only the library's model and its byte alphabet
                raw = piece.replace(" ", self.space) if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES)
                found = [x.id for x in self.tokenize(raw)]
                ids = _PACK[len(found)](*found) if len(found) <= WORD else array("i", found).tobytes()
            else:
                bare = piece.rstrip(punctuation)
                if len(bare) < len(piece) and bare.removeprefix(" ").isalpha():
                    ids = self[bare] + self[piece[len(bare) :]]
                else:
                    ids = array("i", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= WORD:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """The ids of whole texts, as the tokenizer gives them.

    A byte-level BPE never joins across a single white-space character between two others that are not: its pattern starts
    a new piece at a space, and before and after a line end. Nor does it join ASCII letters, digits and other signs to each
    other, but for what follows an apostrophe. So texts are cut there (where anything else meets, they are not), and of many
    texts at once each distinct piece (with its space) is looked up once, and goes through the tokenizer if it isn't known. A
    text with white space outside ASCII goes through whole, and so does one with the string of an added token, such as
    <|endoftext|>, in which the library sees that token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self.known = Pieces(tokenizer)

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts (a null has none), one text's after the other's, and how many each has."""
        texts = texts.cast(pa.string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
        size = int(at[-1] - at[0])
        if not size:
            return np.empty(0, "<i4"), np.zeros(len(texts), np.int64)
        raw, at = texts.buffers()[2].slice(int(at[0]), size), at - at[0]
        starts = np.append(np.flatnonzero(self._cuts(raw, at, texts)), size).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), raw]).dictionary_encode()
        which = pieces.indices.to_numpy()
        ids = list(map(self.known.__getitem__, pieces.dictionary.to_numpy(zero_copy_only=False)))
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begins = (np.cumsum(counts) - counts)[which]
        counts = counts[which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = np.frombuffer(b"".join(ids), "<i4")[np.repeat(begins - ends[:-1], counts) + np.arange(ends[-1])]
        return flat, np.diff(ends[np.searchsorted(starts, at)])

    def _cuts(self, raw: pa.Buffer, at: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Where in raw pieces begin. at: where texts begin, and its end."""
        byte = np.frombuffer(raw, np.uint8)
        kind = _CLASS[byte]
        cut = np.zeros(len(byte) + 1, bool)
        cut[1:-1] = _CUT[kind[:-1] << 3 | kind[1:]]
        blank = np.concatenate([[False], kind == _BLANK, [False]])
        single = np.flatnonzero(blank[1:-1] & ~blank[:-2] & ~blank[2:])
        line_end = single[byte[single] == 10]
        cut[single[byte[single] == 32]] = cut[line_end] = cut[line_end + 1] = True
        whole = set()
        lead = np.flatnonzero(kind == _LEAD)
        if len(lead):
            a, b, c = (np.append(byte, [0, 0])[lead + k].astype(np.int64) for k in range(3))
            code = np.where(a == 0xC2, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63)
            spaces = lead[np.isin(code, _SPACES)]
            whole.update((np.searchsorted(at, spaces, "right") - 1).tolist())
        for token in self.added:
            if token.encode() in memoryview(raw).tobytes():
                whole.update(np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist())
        for i in whole:
            cut[at[i] : at[i + 1]] = False
        cut[at] = True
        return cut[:-1]


#: White space outside ASCII.
_SPACES = np.array([c for c in range(128, 0x3001) if chr(c).isspace()])


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The keys and texts of a batch, at most about BYTES_AT_ONCE of texts at a time."""
    keys, texts = batch.column(0), batch.column(1)
    sizes, first = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()), 0
    while first < len(keys):
        last = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + BYTES_AT_ONCE, "right")))
        yield keys.slice(first, last - first), texts.slice(first, last - first)
        first = last


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, appends end_id, writes the files to path and returns them as a table.

    A null or empty text has the end id alone. A null id sorts first. Repeated ids are kept as rows of their own, in
    the order of their texts' hashes. Other columns of docs are left out.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, start = common.held(f"encoder {tokenizer_path}", lambda: Encoder(tokenizer_path)), TaskContext.get().partitionId(), 0
        for batch in batches:
            for keys, texts in _portions(batch):
                ids, counts = known.encode_all(texts)
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                ends = np.concatenate([[0], np.cumsum(counts)])
                for at in range(0, len(keys), ROWS):
                    some = ends[at : at + ROWS + 1]
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(at, ROWS), pa.array(np.full(len(some) - 1, part, np.int32)), pa.array(start + some[:-1]), pa.array(counts[at : at + ROWS]), pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(ids[some[0] : some[-1]]))],
                        ["doc_id", "part", "local_start", "n_tokens", "ids"],
                    )
                start += int(ends[-1])

    order = [F.col("doc_id"), F.xxhash64("text")]
    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(encode, "doc_id long, part int, local_start long, n_tokens long, ids array<int>")
        .write.option("compression", "snappy")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .parquet(path)
    )
    return read_token_files(docs.sparkSession, path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, local_start long, n_tokens long, ids array<int>").parquet(path)


def with_start(files: DataFrame) -> DataFrame:
    """files with start: the ids of all documents before each. The window runs over one row a part."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return files.join(common.joinable(parts), "part").withColumn("start", F.col("base") + F.col("local_start"))


def digests(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.held("digests")
        for batch in batches:
            ids = batch.column(3)
            raw, at = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_start(files).select("doc_id", "start", "n_tokens", "ids").mapInArrow(sums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame) -> DataFrame:
    """The files of docs, written to shared storage and read back, as digests."""
    return digests(write_token_files(docs, common.new_path(docs.sparkSession, "token-ids"), tokenizer_file()))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of documents, from the files: nulls, repeated ids, empty tables and further
    columns as in ``write_token_files``."""
    return encode_documents(common.table(spark, sf_dir, "documents"))
