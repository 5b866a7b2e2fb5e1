"""Token-ID output: documents are tokenised and packed into rows of equal length.

Best-fit decreasing: pieces are placed longest first, each into the open row that it fills best.  A
segment tree over the rows' free room finds that row in a logarithmic number of steps.  Documents
longer than a row are split into pieces without loss.  Packing happens where a task reads its
documents, in groups of bounded size, so no text or token is shuffled.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
#: Fixed value: the split pattern that this public vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def tokenizer(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file, read once per worker process; special tokens are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """Segment tree over free room 0..size: how many open rows have each room, and which."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _shift(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._shift(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``, and that room; it is closed until put back."""
        count, node = self.count, self.leaves + need
        while not count[node]:
            # Up to the next subtree to the right; running out of them means that no row has the room.
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:
                return None
        while node < self.leaves:
            node *= 2
            if not count[node]:
                node += 1
        room = node - self.leaves
        row = self.rows[room].pop()
        self._shift(room, -1)
        return row, room


def best_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Items of each row; every size is at most ``room``.  Equal sizes keep their order."""
    tree, rows = RoomTree(room), []
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = tree.take(sizes[item])
        if found is None:
            rows.append([item])
            row, left = len(rows) - 1, room - sizes[item]
        else:
            row, left = found[0], found[1] - sizes[item]
            rows[row].append(item)
        if left:
            tree.put(left, row)
    return rows


def pack(documents: DataFrame, row_tokens: int = 2048, vocabulary: str = VOCABULARY, end: int = END_OF_TEXT, group_tokens: int = 1_000_000) -> DataFrame:
    """documents(doc_id, text) -> one output row per packed row of at most ``row_tokens`` tokens.

    shard, row      number of the task that packed it and of the row there
    n_tokens        tokens in use; the rest of the row is padding with ``end``
    ids             ``row_tokens`` unsigned 16-bit numbers, little-endian (the vocabulary has fewer than 65,536 tokens)
    position_ids    as many positions, from 0 again at every segment
    cu_seqlens      cumulative segment lengths from 0
    doc_ids         document of every segment (null where it has no id)
    starts          token offset of every segment in its document

    Each document's tokens are followed by ``end``; a document without tokens (null or empty text) gives no segment.  Pieces of
    one document in order of ``starts`` restore its tokens.  Repeated rows are packed each; an empty table gives
    an empty result; further columns are ignored.  A lost task packs the same documents again in the same way.

    Rows are packed from what one task reads, in groups of ``group_tokens``: which documents share a row, and how many last rows of
    a group stay part-filled, follows from the table's files and their order; ``fill`` tells the share in use.  ``vocabulary`` is
    a file of the driver, which Spark hands to every executor once.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    ranks = os.path.basename(vocabulary)

    def rows_of(shard: int, first: int, pieces: list[tuple]) -> pa.RecordBatch:
        sizes = [len(p[2]) for p in pieces]
        packed = best_fit_decreasing(sizes, row_tokens)
        ids, positions = np.full((len(packed), row_tokens), end, "<u2"), np.zeros((len(packed), row_tokens), "<u2")
        cumulative, doc_ids, starts = [], [], []
        for r, items in enumerate(packed):
            at, ends = 0, [0]
            for item in items:
                n = sizes[item]
                ids[r, at : at + n] = pieces[item][2]
                positions[r, at : at + n] = ramp[:n]
                at += n
                ends.append(at)
            positions[r, at:] = ramp[: row_tokens - at]
            cumulative.append(ends)
            doc_ids.append([pieces[item][0] for item in items])
            starts.append([pieces[item][1] for item in items])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(packed), shard, np.int32)), pa.array(np.arange(first, first + len(packed))), pa.array([c[-1] for c in cumulative], pa.int32()),
                pa.array([r.tobytes() for r in ids], pa.binary()), pa.array([r.tobytes() for r in positions], pa.binary()),
                pa.array(cumulative, pa.list_(pa.int32())), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())),
            ],
            names=["shard", "row", "n_tokens", "ids", "position_ids", "cu_seqlens", "doc_ids", "starts"],
        )

    ramp = np.arange(row_tokens).astype("<u2")

    def run(batches):
        encode = tokenizer(SparkFiles.get(ranks)).encode_ordinary
        shard, done, held, pieces, out = TaskContext.get().partitionId(), 0, 0, [], None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = encode(text.as_py())
                if not tokens:
                    continue
                tokens.append(end)
                tokens = np.array(tokens, "<u2")
                for at in range(0, len(tokens), row_tokens):
                    pieces.append((doc, at, tokens[at : at + row_tokens]))
                held += len(tokens)
                if held >= group_tokens:
                    out = rows_of(shard, done, pieces)
                    done, held, pieces = done + out.num_rows, 0, []
                    yield from (out.slice(k, 256) for k in range(0, out.num_rows, 256))
        if pieces:
            out = rows_of(shard, done, pieces)
            yield from (out.slice(k, 256) for k in range(0, out.num_rows, 256))
        pieces = out = None
        pa.default_memory_pool().release_unused()

    if not 0 <= end < 65_536 or row_tokens > 65_536:
        raise ValueError("ids and positions are kept in 16 bits")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "shard int, row long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>")


def fill(packed: DataFrame) -> DataFrame:
    """(rows, tokens, share): rows packed, tokens in use, and their share of all places."""
    out = packed.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.sum(F.octet_length("ids") / 2).alias("places"))
    return out.select("rows", "tokens", F.try_divide(F.col("tokens"), F.col("places")).alias("share"))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: one fixed-width binary row of ids per row of the matrix, next to its lengths and positions."""
    packed.write.option("compression", "zstd").parquet(path)
