"""Packing tokenised documents into windows of a fixed capacity.

A document's ids, followed by the end id, are cut at every ``capacity`` ids; full cuts fill a
window each. What is left of each document is cut once more at ``cut`` ids, and these pieces
are packed block by block: multiway differencing (Karmarkar and Karp) keeps partial
partitions into ``k`` windows, and merges the two of largest spread so that the fullest
windows of one meet the emptiest of the other, until one partition of near-equal windows is
left. ``k`` starts at the fewest windows that can hold the block, and rises by one whenever a
window exceeds the capacity.

A block belongs to one task and holds ``block_windows`` windows of ids at most (and one
document's remainder), so memory is bounded and nothing is shuffled: work and padding do not
depend on which documents are alike. Window ids are unique over all tasks.

Rules: null texts are empty and give one piece, the end id. Null document ids stay null.
Repeated rows are packed as often as they come. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from itertools import count

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.bpe import CACHE_ENTRIES, encoded_rows
from panelspark.llm.common import batched, text_column, to_arrow

CAPACITY = 2048
END_ID = 1
#: Remainders of documents are cut at this many ids, so that windows can be near-equal.
CUT = 512
#: Windows in a block that is packed at once.
BLOCK_WINDOWS = 96


def difference(lengths: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Items in ``k`` groups of near-equal sums: ``(sum, item numbers)`` of the groups in use."""
    number = count()
    # A partial partition: its groups in use, fullest first. Empty groups are implied.
    heap = [(-n, next(number), [(n, (item,))]) for item, n in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # The i-th fullest group of one meets the i-th emptiest of the other.
        alone_a, alone_b = max(0, min(len(a), k - len(b))), max(0, min(len(b), k - len(a)))
        merged = a[:alone_a] + b[:alone_b]
        for (x, items), (y, more) in zip(a[alone_a:], reversed(b[alone_b:])):
            merged.append((x + y, (items, more)))
        merged.sort(key=lambda group: -group[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, next(number), merged))
    return [(total, _flat(items)) for total, items in heap[0][2]] if heap else []


def _flat(tree: tuple) -> list[int]:
    out, open_ = [], [tree]
    while open_:
        node = open_.pop()
        if isinstance(node, tuple):
            open_.extend(node)
        else:
            out.append(node)
    return sorted(out)


def windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each window; no window exceeds the capacity. No item may."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        groups = difference(lengths, k)
        if not groups or max(total for total, _ in groups) <= capacity:
            return [items for _, items in groups]
        k += 1


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    cut: int = CUT,
    block_windows: int = BLOCK_WINDOWS,
    memo: int = CACHE_ENTRIES,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit numbers, ``start`` its
    document's ids before it, ``doc_tokens`` all its document's ids with the end id. ``memo``
    bounds the chunks of text that a worker remembers, and its memory; no row depends on it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long"
    )
    arrow = to_arrow(docs.sparkSession, schema)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        numbers = count(TaskContext.get().partitionId() << 33)

        def closed(block):
            for items in windows([row[2] for row in block], capacity):
                number, offset = next(numbers), 0
                for item in items:
                    yield (*block[item], number, offset)
                    offset += block[item][2]

        def rows():
            block, held = [], 0
            for key, _, packed in encoded_rows(batches, path, memo):
                packed += end
                size = len(packed) // 4
                full = size - size % capacity
                for start in range(0, full, capacity):
                    yield key, start, capacity, packed[4 * start : 4 * (start + capacity)], size, next(numbers), 0
                for start in range(full, size, cut):
                    piece = packed[4 * start : 4 * (start + cut)]
                    block.append((key, start, len(piece) // 4, piece, size))
                held += size - full
                if held >= block_windows * capacity:
                    yield from closed(block)
                    block, held = [], 0
            yield from closed(block)

        yield from batched(rows(), arrow)

    return docs.select("doc_id", text_column().alias("text")).mapInArrow(run, schema)


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """Packed pieces with a checksum in place of their ids."""
    return pack(docs, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
