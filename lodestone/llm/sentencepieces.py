"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece holds a space marker after another character, a merge can't cross from a word to the marker of the next
one, and a line break that no piece holds stands alone: a text's ids are those of its chunks (a word with the spaces
before it, or a line break) in order. Each distinct chunk is segmented once, and its ids are joined back at every
position where it stands:

1. Every task counts the distinct chunks of its texts; those that several tasks met are added up by a shuffle of
   distinct chunks alone, segmented once, and broadcast, the most frequent first, up to TABLE entries.
2. The texts are read again. Chunks that the table lacks were met by one task or lie beyond the bound: a worker segments
   them when they first occur and keeps them in its own bounded table.

A model without these properties (other normalisation, pieces across markers, unigram scores) is applied to whole texts.

Null text counts as empty: no ids, and decoded empty; null ids decode to the empty text. Texts are taken whole at any
length; chunks beyond LONG_BYTES are segmented, but not kept. Repeated rows come out as often as they come in, an empty
table gives no rows, ties only change what the table holds, never an id. The output has the columns named in each
function; further columns of the input, also of those names, are dropped.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import free, in_parts, mapped, table_batch, texts, whole, written

#: Bounds: entries of the broadcast table, entries of a worker's own table beside it, chunks that a task counts at once, bytes of a chunk that is kept.
TABLE, CACHE, COUNTED, LONG_BYTES = 131_072, 100_000, 200_000, 64
#: The space marker is written U+2581; a text that holds it means a space to the model.
MARKER = "▁".encode()
CHUNKS = re.compile(rb" +[^ \n]*|[^ \n]+|\n")
_models: dict = {}


class Model:
    """A model file's processor and what its pieces allow, once for each process."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            held = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        normal, trained = held.normalizer_spec, held.trainer_spec
        kinds = type(held).SentencePiece
        pieces = [p.piece for p in held.pieces if p.type == kinds.NORMAL]
        self.dummy = b" " if normal.add_dummy_prefix else b""
        self.parted = (
            trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix
            and not normal.precompiled_charsmap and normal.escape_whitespaces and not normal.remove_extra_whitespaces
            and not any(p.type == kinds.USER_DEFINED for p in held.pieces)
            and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        )
        #: For decoding: the bytes of each piece, empty for control pieces.
        control = {kinds.CONTROL}
        raw = [b"" if p.type in control else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.encode().replace(MARKER, b" ") for p in held.pieces]
        self.simple = np.array([p.type in (kinds.NORMAL, kinds.BYTE) for p in held.pieces])
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        self.fixed: dict[bytes, bytes] = {}
        self.own: dict[bytes, bytes] = {}

    def segment(self, chunks: list[bytes]) -> list[bytes]:
        """Each chunk's ids, little-endian of 4 bytes.

        Many chunks are one text, each behind a line break: that keeps the dummy prefix off, and parts the ids again.
        """
        out, lead = [], self.processor.encode("\n")
        for i in range(0, len(chunks), 1024):
            part = chunks[i : i + 1024]
            words = [x for x in part if x != b"\n"]
            ids = np.array(self.processor.encode("\n" + "\n".join([x.decode("utf-8", "replace") for x in words])), "<u4")
            cuts = np.append(np.flatnonzero(ids == lead[-1]), len(ids))
            data, at = ids.tobytes(), iter(zip((4 * cuts[:-1] + 4).tolist(), (4 * cuts[1:]).tolist(), strict=True))
            line = np.array(lead[-1:], "<u4").tobytes()
            out += [line if x == b"\n" else data[slice(*next(at))] for x in part]
        return out

    def encode(self, data: list[bytes]) -> list[bytes]:
        """Each text's ids; what the table lacks is segmented once for all the texts given."""
        if not self.parted:
            return [np.array(self.processor.encode(x.decode("utf-8", "replace")), "<u4").tobytes() for x in data]
        out = []
        for part in in_parts(data):
            texts_ = [chunked(self.dummy + x) if x else [] for x in part]
            new = list({x for chunks in texts_ for x in chunks if x not in self.own})
            if len(self.own) + len(new) > CACHE + len(self.fixed):
                self.own = dict(self.fixed)
                new = list({x for chunks in texts_ for x in chunks if x not in self.own})
            learnt = dict(zip(new, self.segment(new), strict=True))
            self.own.update(learnt)
            out += [b"".join(map(self.own.__getitem__, chunks)) for chunks in texts_]
            if len(self.own) > CACHE + len(self.fixed):
                self.own = dict(self.fixed)
            else:
                for x in learnt:
                    if len(x) > LONG_BYTES:
                        del self.own[x]
        return out

    def fix(self, table: dict[bytes, bytes]) -> None:
        """Entries that are known already."""
        if table is not self.fixed:
            self.fixed, self.own = table, dict(table)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of lists of ids that end at `ends` in one array."""
        bad = (ids < 0) | (ids >= len(self.sizes))
        if bad.any():
            raise ValueError(f"no piece has the id {ids[bad][0]}")
        sizes = self.sizes[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        data = self.pool[np.repeat(self.starts[ids] - total[:-1], sizes) + np.arange(total[-1])].tobytes()
        plain = np.concatenate([[0], np.cumsum(~self.simple[ids])])
        out, lo = [], 0
        for hi in ends.tolist():
            part = data[total[lo] : total[hi]]
            try:
                if plain[hi] > plain[lo]:
                    raise ValueError  # control and unknown pieces: as the library has them
                text = part.decode()
                out.append(text[1:] if self.dummy and text.startswith(" ") and self.sizes[ids[lo]] > 0 else text)
            except ValueError:
                out.append(self.processor.decode(ids[lo:hi].tolist()))
            lo = hi
        return out


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def chunked(text: bytes) -> list[bytes]:
    return CHUNKS.findall(text.replace(MARKER, b" ") if MARKER in text else text)


def distinct_chunks(docs: DataFrame, dummy: bytes, text_col: str = "text") -> DataFrame:
    """chunk and n: the chunks that several tasks met, and how often they occur."""
    schema = pa.schema([("chunk", pa.binary()), ("n", pa.int64()), ("task", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()

        def drained():
            rows = iter(seen.items())
            while some := list(itertools.islice(rows, 1 << 15)):
                some = [x for x in some if len(x[0]) <= LONG_BYTES]
                yield table_batch(schema, [[x for x, _ in some], [n for _, n in some], [part] * len(some)])
            seen.clear()

        for batch in batches:
            for text in texts(batch, 0):
                seen.update(chunked(dummy + text) if text else ())
                if len(seen) > COUNTED:
                    yield from drained()
        yield from drained()

    found = mapped(whole(docs, text_col), count, "chunk binary, n long, task long")
    return found.groupBy("chunk").agg(F.sum("n").alias("n"), F.min("task").alias("lo"), F.max("task").alias("hi")).where("lo < hi").select("chunk", "n")


def segmented(chunks: DataFrame, path: str) -> DataFrame:
    """chunk and ids (little-endian of 4 bytes) of distinct chunks."""
    schema = pa.schema([("chunk", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield table_batch(schema, [batch.column(0), model(path).segment(batch.column(0).to_pylist())])

    return mapped(chunks.select("chunk"), run, "chunk binary, ids binary", 1 << 14)


def chunk_table(docs: DataFrame, path: str, text_col: str = "text", most: int = TABLE) -> dict[bytes, bytes]:
    """The shared table: at most `most` entries of at most LONG_BYTES each, cut at a power of two of their counts."""
    found = written(distinct_chunks(docs, model(path).dummy, text_col), "chunks")
    levels = dict(found.groupBy(F.floor(F.log2("n")).alias("level")).count().collect())  # at most 63 rows
    least, held = 64, 0
    for level in sorted(levels, reverse=True):
        if held + levels[level] > most:
            break
        least, held = level, held + levels[level]
    rows = segmented(found.where(F.floor(F.log2("n")) >= least), path).collect() if held else []  # bounded by `most`
    free(found)
    return {bytes(x): bytes(ids) for x, ids in rows}


def encode(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", most: int = TABLE) -> DataFrame:
    """id and ids (array of int) of every text, as the model gives them without begin and end, no sampling."""
    parted = model(model_file).parted
    held = docs.sparkSession.sparkContext.broadcast(chunk_table(docs, model_file, text_col, most) if parted else {})
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema([(id_col, id_type), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_file)
        own.fix(held.value)
        for batch in batches:
            yield table_batch(schema, [batch.column(0).cast(id_type), _lists(own.encode(texts(batch, 1)))])

    return mapped(whole(docs, id_col, text_col), run, f"`{id_col}` {'string' if kind == 'string' else 'long'}, ids array<int>")


def _lists(data: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in data)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), np.int32)))


def decode(encoded: DataFrame, model_file: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and decoded (text) of every list of ids, as the model's decode gives it: each id's piece in its place."""
    kind = encoded.schema[id_col].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema([(id_col, id_type), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(model_file)
        for batch in batches:
            lists = batch.column(1).cast(pa.list_(pa.int32()))
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            yield table_batch(schema, [batch.column(0).cast(id_type), lists, own.decode(lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes))])

    return mapped(whole(encoded, id_col, ids_col), run, f"`{id_col}` {'string' if kind == 'string' else 'long'}, ids array<int>, decoded string", 64)


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of decode()'s rows."""
    ids = F.coalesce(F.col("ids"), F.array().cast("array<int>"))
    return decoded.select(id_col, F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
