"""Token counts per document, every distinct pre-token encoded once.

Documents are cut into pre-tokens in blocks (one block per input partition, or several for large ones).
A block keeps its vocabulary as rows (block, local number, pre-token) and its documents as frequencies of
local numbers. The vocabulary rows of all blocks are brought together and sorted by pre-token, each distinct one is
encoded once to learn its number of tokens, and the numbers go back to their blocks by a join; a document's
count is the sum of frequency times number. No id list of a document is ever built, except for texts with
rare characters or special strings, which only the library itself can cut: those are counted whole.

A frequent pre-token has one row per block, however many documents use it, so no key is hot.

Defined cases: null text is empty and has 0 tokens; doc_id may be null or repeated, rows are never merged;
an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.llm.common import bounded_batches, table
from linelens.session import materialize

NAME = "op7_token_counts"
TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: A block ends when it holds this many bytes of text.
BLOCK_BYTES = 48 << 20

#: kind 0: a part of a block's vocabulary; kind 1: the block's documents as packed arrays.
STAGE = "block long, kind int, first int, pieces array<string>, doc_ids array<long>, n_bytes array<long>, fixed array<long>, packed binary"
VOCABULARY_ROW = 20_000


def pack(ends: list[int], ids: list[int], freqs: list[int]) -> bytes:
    """Documents' numbers and frequencies: numbers ascend within a document and are kept as differences, byte by byte."""
    import numpy as np

    ends, ids, freqs = np.asarray(ends, dtype=np.int64), np.asarray(ids, dtype=np.int64), np.asarray(freqs, dtype="<u4")
    order = np.argsort(np.repeat(np.arange(len(ends) - 1), np.diff(ends)) << 32 | ids)
    ids, freqs = ids[order], freqs[order]
    steps = np.diff(ids, prepend=0)
    firsts = ends[:-1][ends[:-1] < ends[1:]]
    steps[firsts] = ids[firsts]
    planes = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (np.diff(ends), steps, freqs)]
    return b"".join([np.array([len(ends) - 1, len(ids)], dtype="<u8").tobytes(), *planes])


def unpack(raw: bytes):
    """(ends, ids, freqs) of ``pack``."""
    import numpy as np

    docs, n = np.frombuffer(raw[:16], dtype="<u8").astype(np.int64)
    at, out = 16, []
    for size in (docs, n, n):
        out.append(np.frombuffer(raw[at : at + 4 * size], dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64))
        at += 4 * size
    sizes, steps, freqs = out
    ends = np.concatenate([[0], np.cumsum(sizes)])
    upto = np.cumsum(steps)
    firsts = np.repeat(np.where(sizes > 0, upto[np.minimum(ends[:-1], max(0, n - 1))] - steps[np.minimum(ends[:-1], max(0, n - 1))], 0) if n else sizes, sizes)
    return ends, upto - firsts, freqs


class _Block:
    def __init__(self, name: int):
        self.name, self.size = name, 0
        self.vocabulary: dict[str, int] = {}
        self.doc_ids, self.n_bytes, self.fixed, self.ids, self.freqs, self.ends = [], [], [], [], [], [0]

    def add(self, doc_id: int | None, text: str, pieces) -> None:
        n = len(text.encode())
        self.size += n
        self.doc_ids.append(doc_id)
        self.n_bytes.append(n)
        cut = pieces.cut(text)
        self.fixed.append(len(pieces.whole(text)) if cut is None else 0)
        if cut:
            number = self.vocabulary
            held = Counter(cut)
            self.ids.extend([number.setdefault(p, len(number)) for p in held])
            self.freqs.extend(held.values())
        self.ends.append(len(self.ids))

    def rows(self) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import zstandard

        schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("first", pa.int32()), ("pieces", pa.list_(pa.string())), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("fixed", pa.list_(pa.int64())), ("packed", pa.binary())])
        words = list(self.vocabulary)
        for k in range(0, len(words), VOCABULARY_ROW):
            yield pa.RecordBatch.from_pylist([{"block": self.name, "kind": 0, "first": k, "pieces": words[k : k + VOCABULARY_ROW]}], schema)
        packed = zstandard.ZstdCompressor(level=1).compress(pack(self.ends, self.ids, self.freqs))
        yield pa.RecordBatch.from_pylist([{"block": self.name, "kind": 1, "first": len(words), "doc_ids": self.doc_ids, "n_bytes": self.n_bytes, "fixed": self.fixed, "packed": packed}], schema)


def blocks(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Vocabularies and packed documents of all blocks."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from linelens.llm.pieces import load

        first = TaskContext.get().partitionId() << 32
        pieces, block = load(tokenizer_path), _Block(first)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                block.add(doc_id, text.as_py() or "", pieces)
                if block.size >= BLOCK_BYTES:
                    yield from block.rows()
                    block = _Block(block.name + 1)
        if block.doc_ids:
            yield from block.rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, STAGE)


def piece_counts(vocabulary: DataFrame, tokenizer_path: str) -> DataFrame:
    """block, local, n: the number of tokens of every vocabulary row.

    All rows of a pre-token meet in one partition and stand together there, and it is encoded at the first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from linelens.llm.pieces import load

        known, last, last_n = load(tokenizer_path), None, 0
        for b in batches:
            pieces = b.column("piece").to_pylist()
            new = [p for k, p in enumerate(pieces) if p != (pieces[k - 1] if k else last)]
            counts, n = map(len, known.encode(new)), []
            for p in pieces:
                if p != last:
                    last, last_n = p, next(counts)
                n.append(last_n)
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("local"), pa.array(n, pa.int32())], ["block", "local", "n"])

    together = vocabulary.select("block", "local", "piece").repartition("piece").sortWithinPartitions("piece")
    return together.mapInArrow(count, "block long, local int, n int")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import zstandard

    for b in batches:
        for row in b.to_pylist():
            ends, ids, freqs = unpack(zstandard.ZstdDecompressor().decompress(row["packed"]))
            n = np.zeros(max(row["first"], 1), dtype=np.int64)
            n[np.asarray(row["locals"] or [], dtype=np.int64)] = row["values"] or []
            upto = np.concatenate([[0], np.cumsum(n[ids] * freqs)])
            total = upto[ends[1:]] - upto[ends[:-1]] + np.asarray(row["fixed"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(total, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    stage = materialize(blocks(docs, tokenizer_path))
    vocabulary = stage.where("kind = 0").select("block", "first", F.posexplode("pieces").alias("at", "piece")).select("block", (F.col("first") + F.col("at")).alias("local"), "piece")
    by_block = piece_counts(vocabulary, tokenizer_path).groupBy("block").agg(F.collect_list("local").alias("locals"), F.collect_list("n").alias("values"))
    packed = stage.where("kind = 1").select("block", "first", "doc_ids", "n_bytes", "fixed", "packed")
    joined = packed.join(by_block, "block", "left").select("first", "doc_ids", "n_bytes", "fixed", "packed", "locals", "values")
    return joined.mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


ORACLE_SQL = None
