"""Bounded-space online packing of token sequences.

Each partition keeps OPEN windows open. A document's remaining piece goes to the window it fits best; when none fits,
the fullest window is topped up by cutting the piece and emitted. Windows still open at the end are leftovers: those of
MERGE partitions at a time are merged by the same rule, and what then remains is cut at powers of two, where a sequence
needs no padding, so that no task grows with the number of partitions.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import mapped, prepare, table_batch, texts, whole, written
from lodestone.llm.tokens import lookup, splits_at_spaces, tokenizer

#: Open windows of a partition, partitions whose leftovers are merged together, and the least gap that is filled by a cut.
OPEN, MERGE, LEAST_CUT = 16, 8, 8


def schemas(id_type: pa.DataType) -> tuple[pa.Schema, str]:
    """The columns of pieces, for Arrow and for Spark."""
    rest = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("left", pa.bool_()), ("ids", pa.binary())]
    return pa.schema([("doc_id", id_type), *rest]), f"doc_id {'string' if id_type == pa.string() else 'long'}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, left boolean, ids binary"


class Windows:
    """Open windows of at most `size` ids, each a list of pieces (doc_id, start, ids as bytes of 4, doc_tokens)."""

    def __init__(self, size: int, most: int, least: int = LEAST_CUT):
        self.size, self.most, self.least = size, most, least
        self.open: list[tuple[int, list]] = []

    def add(self, doc, start: int, ids: bytes, total: int) -> Iterator[list]:
        """Place a piece; yields the windows that are emitted."""
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                yield [(doc, start, ids[: 4 * self.size], total)]
                start, ids = start + self.size, ids[4 * self.size :]
                continue
            fits = [(self.size - used - n, k) for k, (used, _) in enumerate(self.open) if used + n <= self.size]
            if fits:
                gap, k = min(fits)
                used, pieces = self.open[k]
                pieces.append((doc, start, ids, total))
                self.open[k] = (used + n, pieces)
                if not gap:
                    yield self.open.pop(k)[1]
                return
            if len(self.open) < self.most:
                self.open.append((n, [(doc, start, ids, total)]))
                return
            k = max(range(len(self.open)), key=lambda i: (self.open[i][0], -i))
            used, pieces = self.open.pop(k)
            room = self.size - used
            if room >= self.least:
                pieces.append((doc, start, ids[: 4 * room], total))
                start, ids = start + room, ids[4 * room :]
            yield pieces


def halves(pieces: list, size: int) -> Iterator[list]:
    """Cut what a window holds into sequences whose lengths are powers of two."""
    left = sum(len(x[2]) // 4 for x in pieces)
    queue = list(pieces)
    while left:
        want = min(size, 1 << (left.bit_length() - 1))
        out, room = [], want
        while room:
            doc, start, ids, total = queue.pop(0)
            n = min(room, len(ids) // 4)
            out.append((doc, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                queue.insert(0, (doc, start + n, ids[4 * n :], total))
            room -= n
        left -= want
        yield out


def rows(window: list, sequence: int, part: int, left: bool, keep_ids: bool) -> Iterator[tuple]:
    at = 0
    for doc, start, ids, total in window:
        yield doc, start, len(ids) // 4, None if left else zlib.crc32(ids), total, sequence, at, part, left, ids if left or keep_ids else None
        at += len(ids) // 4


def pack(docs: DataFrame, tokenizer_file: str, *, size: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids (unsigned 32-bit, little-endian; null with keep_ids=False).

    A null or empty text is the end id alone; null ids stay null. Texts longer than a window fill windows of their own
    and place the rest. Windows that fit equally well are taken in order. Repeated rows are packed as often as they come;
    an empty table gives no rows. Sequences are unique numbers of partition and window, so a task that runs again gives the same rows.
    """
    prepare(docs.sparkSession)
    pieces, ddl = schemas(pa.string() if docs.schema[id_col].dataType.simpleString() == "string" else pa.int64())
    parted, end = splits_at_spaces(tokenizer_file), end_id.to_bytes(4, "little")

    def as_bytes(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def out(found: list[tuple]) -> pa.RecordBatch:
        return table_batch(pieces, list(zip(*found, strict=True)) if found else [[] for _ in pieces])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, windows, number = TaskContext.get().partitionId(), Windows(size, OPEN), 0
        tok, found = tokenizer(tokenizer_file), []
        for batch in batches:
            data = texts(batch, 1)
            coded = lookup(tokenizer_file, "ids").ids(data) if parted else [as_bytes(e.ids) for e in tok.encode_batch_fast([x.decode("utf-8", "replace") for x in data], add_special_tokens=False)]
            for doc, ids in zip(batch.column(0).cast(pieces.types[0]).to_pylist(), coded, strict=True):
                for window in windows.add(doc, 0, ids + end, len(ids) // 4 + 1):
                    found += rows(window, (part << 32) + number, part, False, keep_ids)
                    number += 1
            if found:
                yield out(found)
                found = []
        for k, (_, window) in enumerate(windows.open):
            found += rows(window, k, part, True, keep_ids)
        if found:
            yield out(found)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        group, windows, number, found = key[0].as_py(), Windows(size, OPEN), 0, []
        base = (1 << 62) + (group << 32)
        for row in table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            for window in windows.add(row["doc_id"], row["start"], row["ids"], row["doc_tokens"]):
                found += rows(window, base + number, group, False, keep_ids)
                number += 1
        rest = Windows(size, 1, 1)  # the last open windows: filled up by cuts, then cut at powers of two
        done = [w for _, held in windows.open for p in held for w in rest.add(*p)]
        done += [w for _, held in rest.open for w in halves(held, size)]
        for window in done:
            found += rows(window, base + number, group, False, keep_ids)
            number += 1
        return pa.Table.from_batches([out(found)], pieces)

    first = written(mapped(whole(docs, id_col, text_col), place, ddl), "pack")
    merged = first.where("left").groupBy(F.floor(F.col("part") / MERGE).cast("long").alias("g")).applyInArrow(merge, ddl)
    done = first.where("not left").unionByName(merged).drop("part", "left")
    return done.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else done
