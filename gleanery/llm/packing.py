"""Best-fit packing of documents into token sequences, online and in bounded space.

Every scan partition packs its own documents in the order in which they arrive. Open bins are kept in
stacks by free space, and one integer has bit f set while some open bin has f tokens free; the best bin
for n tokens is the lowest set bit at or above n. At most ``open_bins`` are open: when one more is
needed, the fullest (lowest set bit) closes and its pieces are handed out. When the partition ends, the
bins still open are themselves packed into each other, largest first, before they close.

Nothing is shuffled and nothing but the open bins is held: open_bins x 2048 ids, 4 bytes each, for
each running task. A retried task reads the same split and makes the same sequences, for a sequence's
id is the partition's number (upper bits) and a running count (lower 33 bits).

Cases: a null or empty text is the end token alone, one piece of length 1; a document longer than a
sequence is cut into full pieces and a last one that may be shorter; rows repeated are packed as often
as they occur; a null doc_id is kept as null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import bpe
from gleanery.llm.common import release, ship, text_of

LENGTH, OPEN_BINS, END, ROWS = 2048, 512, 0, 512
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"


class BestFit:
    """Bounded-space online best-fit. ``add`` returns the bin that had to close, or None; ``drain`` closes all that are left."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most, self.open = capacity, open_bins, 0
        self.by_free: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def _put(self, items: list, free: int) -> None:
        self.by_free[free].append(items)
        self.bits |= 1 << free
        self.open += 1

    def _take(self, free: int) -> list:
        items = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return items

    def _fit(self, size: int) -> int:
        """Least free space of an open bin that takes this size; -1 if there is none."""
        at = self.bits >> size
        return size + (at & -at).bit_length() - 1 if at else -1

    def add(self, item, size: int) -> list | None:
        free = self._fit(size)
        if free >= 0:
            items, free = self._take(free), free - size
        else:
            items, free = [], self.capacity - size
        items.append((item, size))
        if not free:
            return items
        closed = self._take((self.bits & -self.bits).bit_length() - 1) if self.open >= self.most else None
        self._put(items, free)
        return closed

    def drain(self) -> Iterator[list]:
        """Pack what the open bins hold anew, largest first, and close all."""
        items = sorted((i for bins in self.by_free for b in bins for i in b), key=lambda i: -i[1])
        self.by_free, self.bits, self.open = [[] for _ in range(self.capacity + 1)], 0, 0
        for item in items:
            free = self._fit(item[1])
            if free >= 0:
                self._put([*self._take(free), item], free - item[1])
            else:
                self._put([item], self.capacity - item[1])
        for bins in self.by_free:
            yield from bins


def pack_documents(docs: DataFrame, encode: Callable[[], Callable[[str], bytes]] | str = "word_bpe_49k.json", length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Pack ``docs`` (doc_id, text): a row per piece with its ids (little-endian unsigned 32-bit), sequence and offset.

    ``encode`` is a lower-casing word vocabulary, or a function that makes a worker's encoder from text to such bytes.
    The pieces of a sequence are adjacent in the output.
    """
    ship(docs.sparkSession)
    make = (lambda: bpe.word_ids(encode)) if isinstance(encode, str) else encode
    end = END.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        to_ids, bins = make(), BestFit(length, open_bins)
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def close(items: list) -> None:
            nonlocal sequence
            at = 0
            for (doc, piece, start, ids), _ in items:
                rows.append((doc, piece, start, len(ids) // 4, ids, sequence, at))
                at += len(ids) // 4
            sequence += 1

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
            rows.clear()
            return made

        batch = None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = to_ids(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    if closed := bins.add((doc, piece, at // 4, part), len(part) // 4):
                        close(closed)
                        if len(rows) >= ROWS:
                            yield out()
        for items in bins.drain():
            close(items)
            if len(rows) >= ROWS:
                yield out()
        if rows:
            yield out()
        del bins, batch
        release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def packed_digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of the ids."""
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
