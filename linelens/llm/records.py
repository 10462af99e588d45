"""Token ids as length-delimited binary records, with an offset index written beside them.

Documents are range-partitioned and sorted by doc_id; every partition becomes one file, and the files' names
are in the same order. One record is

    length of the payload   u64, little-endian
    masked CRC-32 of those 8 bytes   u32
    payload: doc_id i64, flags u8 (1: doc_id is null), bytes per id u8, then the ids
    masked CRC-32 of the payload   u32
    line feed (the frame's end mark; Spark's text sink writes it)

The mask rotates the checksum right by 15 bits and adds a constant, so a stored checksum is not taken for
data. Ids take 2 bytes if the vocabulary allows it, else 4. Spark's sink commits whole files, so lost
executors and repeated attempts leave no partial record. The index is made from the written files alone:
file, place, offset and length of each record, its document and its number of ids, so a shuffled reader
can seek to any record.

Defined cases: null text is empty and gives the end id alone; null doc_ids come last; rows with the same
doc_id are ordered by their text, repeated rows stay as they are; an empty table writes no record.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linelens.llm.common import bounded_batches, table
from linelens.session import shared_dir

NAME = "op6_token_records"
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
MASK = 0xA282EAD8
#: Encoded pre-tokens of one generation, with and without a blank each; a Python worker remembers two.
REMEMBERED = 400_000
#: Longest pre-token that is remembered.
LONG = 64
#: A blank beside white space, where it need not begin a pre-token.
_GAP = r" [ \t\n\r]|[\t\n\r] "
_LETTER = {2: "H", 4: "I"}

INDEX = "file string, place long, offset long, length long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The record of a payload, without the end mark."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def frames(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of every record in a file; a wrong checksum or a cut record is an error."""
    view, at = memoryview(data), 0
    while at < len(view):
        if len(view) - at < 17:
            raise ValueError(f"cut record at {at}")
        head = view[at : at + 8]
        (n,), (check,) = struct.unpack("<Q", head), struct.unpack("<I", view[at + 8 : at + 12])
        if masked(zlib.crc32(head)) != check or at + n + 17 > len(view):
            raise ValueError(f"wrong length at {at}")
        payload = view[at + 12 : at + 12 + n]
        if masked(zlib.crc32(payload)) != struct.unpack("<I", view[at + 12 + n : at + 16 + n])[0] or view[at + 16 + n] != 10:
            raise ValueError(f"wrong payload at {at}")
        yield at, payload
        at += n + 17


class _Memory(dict):
    """Bytes of the ids of pre-tokens, made when first asked for; what the older generation has moves to this one."""

    def __init__(self, make: Callable[[str], bytes], older: dict[str, bytes]):
        self.make, self.older = make, older

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece) or self.make(piece)
        if len(piece) <= LONG:
            self[piece] = out
        return out

    def turned(self) -> _Memory:
        """This memory, or an empty one before it where it is full."""
        if len(self) <= REMEMBERED:
            return self
        self.older = {}
        return _Memory(self.make, self)


class _Encoder:
    """Texts to the bytes of their ids; remembers the pre-tokens it has encoded, those behind a blank apart.

    A single blank between other characters is always the first letter of a pre-token, so the words between such blanks,
    each with the blank before it, have their ids by themselves: a batch is split into words by Arrow, and each different
    word is looked up once. Texts where blanks meet white space are cut one by one, and texts with rare characters or
    special strings go to the library whole.
    """

    def __init__(self, path: str, width: int):
        from linelens.llm.pieces import load

        self.pieces, self.width = load(path), width
        self.known, self.words = _Memory(self._piece, {}), _Memory(self._after_blank, {})
        self.by_word = self.pieces.blank_first

    def bytes_of(self, ids: list[int]) -> bytes:
        return array(_LETTER[self.width], ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self.bytes_of(self.pieces.one(piece))

    def _after_blank(self, piece: str) -> bytes:
        return self._piece(" " + piece)

    def _word(self, word: str) -> bytes | None:
        """A word with the blank before it; none if the library has to see the text whole."""
        if found := self.pieces.marked(word):
            return self.words[found[1]] + self.known[found[2]] if found[2] else self.words[word]
        cut = self.pieces.cut(" " + word)
        return None if cut is None else self.words[cut[0][1:]] + b"".join(map(self.known.__getitem__, cut[1:]))

    def _cut(self, text: str) -> bytes | None:
        cut = self.pieces.cut(text)
        return None if cut is None else b"".join(map(self.known.__getitem__, cut))

    def _by_words(self, texts: pa.Array) -> list[bytes | None]:
        parts = pc.split_pattern(texts, " ")
        flat, starts = parts.flatten().dictionary_encode(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        firsts = [self._cut(t.split(" ", 1)[0]) for t in texts.to_pylist()]
        known, word = self.words.get, self._word
        values = pa.array([known(w) or word(w) for w in flat.dictionary.to_numpy(zero_copy_only=False)] + firsts, pa.binary())
        spots = flat.indices.to_numpy().copy()
        spots[starts[:-1]] = len(flat.dictionary) + np.arange(len(firsts))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values.take(pa.array(spots))), b"").to_pylist()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids' bytes of every text."""
        texts = pc.fill_null(texts, "")
        plain = pc.invert(pc.match_substring_regex(texts, _GAP)) if self.by_word else pa.array([False] * len(texts))
        done = iter(self._by_words(texts.filter(plain)))
        out = [next(done) if p else self._cut(t.as_py()) for p, t in zip(plain.to_pylist(), texts)]
        self.known, self.words = self.known.turned(), self.words.turned()
        return [self.bytes_of(self.pieces.whole(texts[k].as_py())) if o is None else o for k, o in enumerate(out)]


_ENCODERS: dict[tuple[str, int], _Encoder] = {}


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, path: str | None = None) -> str:
    """Encode every text, append the end id, and write the records in doc_id order; returns the folder."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or f"{shared_dir(spark)}/records/{uuid.uuid4().hex}"
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(True), end_id + 1) <= 1 << 16 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer_path, width) not in _ENCODERS:
            _ENCODERS[tokenizer_path, width] = _Encoder(tokenizer_path, width)
        encoder = _ENCODERS[tokenizer_path, width]
        end = encoder.bytes_of([end_id])
        for b in batches:
            out = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1))):
                head = struct.pack("<qBB", doc_id or 0, doc_id is None, width)
                out.append(frame(b"".join((head, ids, end))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    ordered.mapInArrow(encode, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)
    return path


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX.split(", ")]
    for b in batches:
        for file, content in zip(b.column(0).to_pylist(), b.column(1)):
            rows, start = [], 0
            for place, (offset, payload) in enumerate(frames(content.as_py())):
                doc_id, no_id, width = struct.unpack("<qBB", payload[:10])
                ids = np.frombuffer(payload[10:], dtype={2: "<u2", 4: "<u4"}[width])
                rows.append((file, place, offset, len(payload) + 17, None if no_id else doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            if rows:
                kinds = [pa.string()] + [pa.int64()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Read all records back, check them, and write the offset index at ``<path>_index``; returns the index.

    A task holds one file, or several small ones up to spark.sql.files.maxPartitionBytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = files.select("path", "content").mapInArrow(_index_rows, INDEX)
    rows.write.parquet(f"{path}_index")
    return spark.read.schema(INDEX).parquet(f"{path}_index")


def positions(index: DataFrame) -> DataFrame:
    """The index with each record's global start. The window sees one row per file."""
    ends = index.groupBy("file").agg(F.sum("n_tokens").alias("words"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select(F.col("file").alias("_file"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_base"))
    return index.join(bases, F.col("file") == F.col("_file")).withColumn("start", (F.col("_base") + F.col("start_in_file")).cast("long")).drop("_file", "_base")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files written."""
    import public_tokenizers

    folder = write_records(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return positions(build_index(spark, folder)).select("doc_id", "start", "n_tokens", "ids_crc32")


ORACLE_SQL = None
