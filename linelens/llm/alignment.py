"""Alignment of two tokenizers' tokens over whole documents, and corpus-wide counts of linked ids.

Both tokenizers encode the same bytes, a blank and the text. The byte offsets where a token of A and one of B
both end cut the tokens into groups, and tokens whose byte ranges overlap are linked.

Groups are found by diagonal run skipping. At places i and j that begin together, with index shift j - i, the
arrays of ends are compared over 8, 16, 32, ... places at once while they agree (by the tokens' sizes, which
agree as long as the ends do), and the one-to-one stretch up to the first difference is jumped. What follows is
an irregular group: the side that is behind steps on until both end together, and the shift becomes that of
the places after it.

Whole texts go to the libraries. A byte-level file whose ids are in the order of its merges is read into
tiktoken, which gives the same ids in a quarter of the time; any other goes to the tokenizers library.

A count is the number of documents that hold an id pair linked. Documents are worked on in blocks; a block
lists its distinct pairs once, with its own counts, so the shuffles carry pairs of blocks and not links of
documents. No pair holds more than one row a block, whatever its share of the links. Results come back to the
blocks by their number. Only the largest count of each id of A is broadcast: at most A's vocabulary.

Defined cases: null and empty texts have no tokens; nor have texts whose tokens' bytes, joined, differ from the
blank and the text (a tokenizer changed something); such rows have zeros and an empty digest. Every row is a
document, repeated rows too; doc_id may be null; extra columns are dropped; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linelens.llm.common import bounded_batches, table
from linelens.llm.pieces import byte_letters
from linelens.session import materialize

NAME = "op12_tokenizer_alignment"
TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links of the documents of one block.
BLOCK_LINKS = 2_000_000

# What a byte-level file must state to mean the same as its merges in order, and the pattern of its pre-tokens.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoders:
    """Both tokenizers and the bytes of all their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import numpy as np
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        library = Tokenizer.from_file(path_a)
        library.encode_special_tokens = True  # their strings in a text are plain text
        letters = {c: b for b, c in enumerate(byte_letters())}
        vocabulary = library.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        fast = self._by_ranks(path_a)
        self.ids_a = fast.encode_ordinary if fast else lambda text: library.encode(text, add_special_tokens=False).ids
        self.b = SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        sizes = [[len(x) for x in t] for t in (self.bytes_a, self.bytes_b)]
        if max(map(max, sizes)) > 255:
            raise ValueError("tokens of more than 255 bytes are not aligned")
        self.size_a, self.size_b = (np.array(x, dtype=np.uint8) for x in sizes)
        self.names = [f"{k}{mark}" for k in range(max(map(len, sizes))) for mark in ",|;"]

    def _by_ranks(self, path: str):
        """The same tokenizer for tiktoken, if the file's ids are in the order of its merges and nothing else is done."""
        from tiktoken import Encoding

        spec = json.loads(open(path, encoding="utf-8").read())
        model, order = spec["model"], {k: v for k, v in spec["model"].items() if k in MODEL}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if spec["normalizer"] or spec["pre_tokenizer"] != PRE_TOKENIZER or order != MODEL or any(model["vocab"].get(t) != 256 + k for k, t in enumerate(merged)):
            return None
        ranks = {self.bytes_a[k]: k for k in model["vocab"].values() if k < 256 + len(merged)}
        return Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str):
        """Ids of A of a blank and the text, ids of B of the text; both empty if their bytes are not those."""
        import numpy as np

        none = np.zeros(0, dtype=np.int64)
        if not text:
            return none, none
        a, b = self.ids_a(" " + text), self.b.encode(text, num_threads=1)
        data = (" " + text).encode()
        same = b"".join(map(self.bytes_b.__getitem__, b)) == data and b"".join(map(self.bytes_a.__getitem__, a)) == data
        return (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)) if same else (none, none)


def stretch(a: bytes, b: bytes, i: int, j: int) -> int:
    """Number of one-to-one tokens from places i and j on, which begin together: as long as the sizes agree,
    so do the ends. Windows double while they are equal; the first difference is the lowest bit of their xor."""
    n, width = 0, 8
    while True:
        x, y = a[i + n : i + n + width], b[j + n : j + n + width]
        if x != y:
            z = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + ((z & -z).bit_length() - 1 >> 3)
        n += len(x)
        if len(x) < width:
            return n
        width *= 2


def align(a: bytes, b: bytes) -> tuple[list[int], list[int]]:
    """The places in A and in B of the tokens that do not end a group, given the sizes of all tokens in bytes.

    The g-th other token of A and the g-th other token of B end group g together.
    """
    inner_a, inner_b, i, j = [], [], 0, 0
    while True:
        n = stretch(a, b, i, j)
        i, j = i + n, j + n
        if i >= len(a):
            return inner_a, inner_b
        d = a[i] - b[j]
        while d:  # an irregular group: the side that is behind steps on
            if d < 0:
                inner_a.append(i)
                i += 1
                d += a[i]
            else:
                inner_b.append(j)
                j += 1
                d -= b[j]
        i, j = i + 1, j + 1


def group_text(a, b, last_a, last_b, names: list[str]) -> str:
    """All groups as ``a1,a2|b1,b2``, joined by semicolons; ``last`` marks the tokens that end a group."""
    import numpy as np

    group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))
    count_a, count_b = np.bincount(group_a), np.bincount(group_b)
    code = np.empty(len(a) + len(b), dtype=np.int64)  # A's tokens of a group, then B's
    code[np.arange(len(a)) + (np.cumsum(count_b) - count_b)[group_a]] = a * 3 + last_a
    code[np.arange(len(b)) + np.cumsum(count_a)[group_b]] = b * 3 + last_b * 2
    return "".join(map(names.__getitem__, code.tolist()))[:-1]


def overlaps(size_a, size_b):
    """Places in A and in B of all pairs of tokens whose byte ranges overlap: one pair for each byte at which
    a token of either ends."""
    import numpy as np

    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    ends = np.zeros((2, int(ends_a[-1]) + 1), dtype=np.int32)
    ends[0, ends_a] = 1
    ends[1, ends_b] = 1
    at = np.flatnonzero(ends[0] | ends[1])
    return [(np.cumsum(x) - x)[at] for x in ends]


_LOADED: dict[tuple[str, str], Encoders] = {}


def _encoders(path_a: str, path_b: str) -> Encoders:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Encoders(path_a, path_b)
    return _LOADED[path_a, path_b]


def _aligned(encoders: Encoders, text: str):
    """Ids of A and B, groups as one text and their number, and the places in A and B of all links of a text."""
    import numpy as np

    a, b = encoders.encode(text)
    if not len(a):
        return a, b, "", 0, a, b
    size_a, size_b = encoders.size_a[a], encoders.size_b[b]
    last = []
    for ids, inner in zip((a, b), align(size_a.tobytes(), size_b.tobytes())):
        x = np.ones(len(ids), dtype=np.int64)
        x[inner] = 0
        last.append(x)
    return a, b, group_text(a, b, *last, encoders.names), int(last[0].sum()), *overlaps(size_a, size_b)


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a and b (ids), groups (``a1,a2|b1`` each, in order) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(path_a, path_b)
        for batch in batches:
            out = [_aligned(encoders, t.as_py() or "")[:3] for t in batch.column("text")]
            out = [(a, b, groups.split(";") if groups else []) for a, b, groups in out]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]], ["doc_id", "a", "b", "groups"])

    return _texts(docs).mapInArrow(run, "doc_id long, a array<int>, b array<int>, groups array<string>")


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


FACTS = ("n_a", "n_b", "n_groups", "n_links")
BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, sizes array<int>, places binary, times binary, pairs array<long>, docs array<long>"


def _planes(x) -> bytes:
    """32-bit numbers as four planes of bytes: small numbers leave three planes of zeros, which compress away."""
    import numpy as np

    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes):
    import numpy as np

    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)


def _blocks(path_a: str, path_b: str, block_links: int):
    """Documents as blocks: each document's facts and its distinct links, as places in the block's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encoders, schema = _encoders(path_a, path_b), None
        base, done = TaskContext.get().partitionId() << 32, 0
        rows, links, held = [], [], 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(p) for p, _ in links])
            every, times = (np.concatenate([x[k] for x in links]) for k in (0, 1))
            pairs, place, docs = np.unique(every, return_inverse=True, return_counts=True)
            first = np.cumsum(sizes) - sizes
            step = np.diff(place, prepend=0)
            step[first[sizes > 0]] = place[first[sizes > 0]]  # each document's places begin anew
            columns = [[base + done], *[[list(c)] for c in zip(*rows)], [sizes], [_planes(step)], [_planes(times)], [pairs], [docs]]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                a, b, groups, n_groups, at_a, at_b = _aligned(encoders, text.as_py() or "")
                digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                rows.append((doc_id, len(a), len(b), n_groups, len(at_a), digest))
                linked = (a[at_a] << 32) | b[at_b]
                links.append(np.unique(linked, return_counts=True))
                held += len(at_a) + 1
                if held >= block_links:
                    yield flush()
                    rows, links, held, done = [], [], 0, done + 1
        if rows:
            yield flush()

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block with the counts of their links added up."""
    import numpy as np

    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.array(row["sizes"], dtype=np.int64)
            step, times = _from_planes(row["places"]), _from_planes(row["times"])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            total = np.cumsum(step)
            first = np.cumsum(sizes) - sizes
            before = np.concatenate([[0], total])[first]
            place = total - before[owner]
            at, value = (np.array(row[c] or [], dtype=np.int64) for c in ("at", "value"))
            count = np.zeros(len(at), dtype=np.int64)
            count[at] = value
            n_best, count_sum = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
            np.add.at(n_best, owner, (count[place] & 1) * times)
            np.add.at(count_sum, owner, (count[place] >> 1) * times)
            out = [row["doc_id"], *[row[c] for c in FACTS], n_best, count_sum, row["groups_sha256"]]
            kinds = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [c.split()[0] for c in RESULT.split(", ")])


def linked_counts(docs: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Per document: tokens, groups, links, the links that are their A id's most frequent, the sum of the links'
    corpus-wide counts, and the digest of the groups (their texts joined by semicolons; see ``alignments``)."""
    blocks = materialize(_texts(docs).mapInArrow(_blocks(path_a, path_b, block_links), BLOCK))
    listed = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "s")).select("block", "at", F.col("s.pairs").alias("pair"), F.col("s.docs").alias("n"))
    counts = materialize(listed.groupBy("pair").agg(F.sum("n").alias("n")))
    id_a = F.shiftright("pair", 32)
    most = counts.groupBy(id_a.alias("id_a")).agg(F.max("n").alias("most"))  # a row per id of A at most
    value = (F.col("n") * 2 + F.when(F.col("n") == F.col("most"), 1).otherwise(0)).alias("value")
    valued = materialize(counts.join(F.broadcast(most), id_a == F.col("id_a")).select("pair", value))
    back = listed.drop("n").join(valued, "pair").groupBy("block").agg(F.collect_list(F.struct("at", "value")).alias("found"))
    back = back.select("block", F.col("found.at").alias("at"), F.col("found.value").alias("value"))
    return blocks.drop("pairs", "docs").join(back, "block", "left").drop("block").mapInArrow(_sums, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment facts and link counts of every document."""
    import public_tokenizers

    return linked_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B))


ORACLE_SQL = None
