"""Packing by minimum bin slack.

A document is its token ids and one end id. Whole windows are cut off its front;
what remains, shorter than a window, is packed: a subset-sum dynamic program on
bit sets (one bit for each reachable fill) picks the multiset of remaining
lengths that comes closest to a window, and the counts are found by walking back
through the stored bit sets. The pattern is used as often as the counts allow, so
a block needs at most one program for each distinct length. Where the closest fill
leaves slack, the next remainder is cut to close it; what a block has left for its last
window is cut into sequences of powers of two, which need no padding. So nothing is
padded, however many partitions and blocks there are.

Blocks are runs of rows of one input partition, closed at BLOCK_TOKENS of held
remainders, so that memory is bounded whatever the partition holds and nothing is
shuffled. Null text counts as empty (one end id). Repeated rows are packed as
often as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.batches import pieces
from lectern.llm.common import release
from lectern.llm.token_ids import ids_bytes

WINDOW, END_ID = 2048, 1
#: Token ids held for remainders before a block is closed (4 bytes each).
BLOCK_TOKENS = 4_000_000
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = pa.schema([(c, pa.int64()) for c in COLUMNS])


def closest_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length (ascending, counts above 0) fill capacity as closely as their sums can.

    Bit i of ``reach`` says that some choice sums to i. Counts are split in binary, so
    that a length with many copies takes few steps. Long lengths come first; the program
    ends as soon as the whole capacity is reached.
    """
    mask, full, reach, steps = (1 << (capacity + 1)) - 1, 1 << capacity, 1, []
    for i in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[i]
        left, take = min(counts[length], capacity // length), 1
        while left > 0 and not reach & full:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:  # not to be had without this step
            used[length] += take
            at -= length * take
    return dict(used)


def fill_patterns(counts: dict[int, int], window: int = WINDOW):
    """Yields (how many of each length a window holds, times); the longest length left is in each. Uses up all counts."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    while lengths:
        first = lengths[-1]
        left[first] -= 1
        spare = lengths if left[first] else lengths[:-1]
        used = closest_fill(spare, left, window - first)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del lengths[bisect_left(lengths, k)]
        yield used, times


def pack_block(remainders: list[tuple], window: int = WINDOW) -> Iterator[list[tuple]]:
    """Windows, each a list of pieces (doc_id, start, ids, doc_tokens), of remainders alike; ids as 4-byte little-endian bytes."""
    by_length: dict[int, list] = defaultdict(list)
    while remainders:
        x = remainders.pop()
        by_length[len(x[2]) // 4].append(x)
    short = []
    for used, times in fill_patterns({k: len(v) for k, v in by_length.items()}, window):
        exact = sum(k * n for k, n in used.items()) == window
        for _ in range(times):
            pieces = [by_length[k].pop() for k, n in sorted(used.items(), reverse=True) for _ in range(n)]
            if exact:
                yield pieces
            else:
                short.append(pieces)
    # windows with slack are run together and cut at window boundaries
    open_, room = [], window
    for pieces in short:
        for doc, start, ids, total in pieces:
            while ids:
                head, ids = ids[: 4 * room], ids[4 * room :]
                open_.append((doc, start, head, total))
                start, room = start + len(head) // 4, room - len(head) // 4
                if not room:
                    yield open_
                    open_, room = [], window
    yield from halves(open_)


def halves(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """A window that isn't full, as sequences whose lengths are powers of two, the largest first."""
    left = sum(len(ids) // 4 for _, _, ids, _ in pieces)
    part, room = [], 1 << (left.bit_length() - 1) if left else 0
    for doc, start, ids, total in pieces:
        while ids:
            head, ids = ids[: 4 * room], ids[4 * room :]
            part.append((doc, start, head, total))
            n = len(head) // 4
            start, room, left = start + n, room - n, left - n
            if not room:
                yield part
                part, room = [], 1 << (left.bit_length() - 1) if left else 0


def _windows(tokenizer: str, window: int, batches) -> Iterator[list[tuple]]:
    """All windows of a partition: those cut off the documents' fronts as they are read, the rest by blocks."""
    encode, end = ids_bytes(tokenizer), struct.pack("<I", END_ID)
    held, size = [], 0
    for batch in (piece for batch in batches for piece in pieces(batch)):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + end
            total = len(ids) // 4
            whole = total - total % window
            for start in range(0, whole, window):
                yield [(doc, start, memoryview(ids)[4 * start : 4 * (start + window)], total)]
            if whole < total:
                held.append((doc, whole, ids[4 * whole :], total))
                size += total - whole
            if size >= BLOCK_TOKENS:
                yield from pack_block(held, window)
                held, size = [], 0
    yield from pack_block(held, window)


#: Rows of a result batch.
BATCH_ROWS = 5000


def _pack(tokenizer: str, window: int, batches):
    context = TaskContext.get()
    next_id, rows = (context.partitionId() if context else 0) << 33, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=SCHEMA)

    for found in _windows(tokenizer, window, batches):
        offset = 0
        for doc, start, ids, total in found:
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, next_id, offset))
            offset += len(ids) // 4
        next_id += 1
        if len(rows) >= BATCH_ROWS:
            yield out()
            rows = []
    if rows:
        yield out()
    release()


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_pack, tokenizer, window), ", ".join(f"`{c}` long" for c in COLUMNS))
