"""Token counts by a map-side two-tier lookup.

The unit of lookup is the pre-token: for a tokenizer that lower-cases and drops white space, a text's ids are those of
its pre-tokens in order. Tier one is a broadcast table of the frequent pre-tokens' lengths (bounded: TABLE entries);
tier two is each Python worker's own bounded cache, filled by encoding those that miss. No pre-token is ever shuffled:
the frequent ones are found by bounded summaries (one row for each partition) that are merged as a tree.

Null text counts as empty; texts are taken whole at any length. Ties among equally frequent pre-tokens only change what
is looked up where, never a count.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import in_parts, mapped, span_hashes, table_batch, texts, whole

#: Bounds: entries of the broadcast table, of one partition's summary, and of a worker's cache; bytes of an entry that is kept; summaries merged at a time.
TABLE, SUMMARY, CACHE, LONG_BYTES, FAN = 16_384, 2_048, 1_000_000, 256, 32
SPACES = bytes.maketrans(b"\t\n\r", b"   ")
#: Fixed values, the tokenizer's: pre-tokens are 's 't 're 've 'm 'll 'd, runs of letters, single digits, and runs of other characters.
PRE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[!-/:-@\[-`{-~]+|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+")
ONE = np.frombuffer(b"stmd", np.uint8)
#: Kinds of bytes of lower-case text; characters beyond ASCII stay with the letters around them, control characters alone.
LETTER, DIGIT = 1, 2
KINDS = np.array([0 if c in b" \t\n\r" else 4 if c < 32 or c == 127 else 1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
#: Below this character all versions of Unicode's tables since 5 agree on what a letter is.
SURE = "\u0530"
_tokenizers: dict = {}
_tables: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, once for each process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(path)
        held.no_truncation()
        held.no_padding()
        _tokenizers[path] = held
    return _tokenizers[path]


def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer lower-cases, and drops white space before it splits, so that runs between spaces are independent."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    pre = json.dumps(held.get("pre_tokenizer") or {})
    return '"Lowercase"' in json.dumps(held.get("normalizer")) and held["model"].get("end_of_word_suffix") == "</w>" and '"invert": true' in pre and '"behavior": "Removed"' in pre and not any(x["lstrip"] or x["rstrip"] or any(c.isspace() for c in x["content"]) for x in held["added_tokens"])


def sure(token: bytes) -> bool:
    """Whether letters beyond ASCII are one pre-token of the tokenizer's too: still letters after normalising and lower-casing, of scripts on whose letters all Unicode tables agree."""
    text = token.decode("utf-8", "replace")
    return max(text) < SURE and text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


class Slots:
    """Open addressing in arrays: 64-bit hash -> number."""

    def __init__(self, bits: int):
        self.keys, self.at, self.shift, self.mask = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), np.uint64(64 - bits), (1 << bits) - 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's number, -1 where it isn't here."""
        out, slot = np.full(len(h), -1, np.int32), (h >> self.shift).astype(np.int64)
        held = self.keys[slot]
        hit = held == h
        out[hit] = self.at[slot[hit]]
        rest = np.flatnonzero(~hit & (held != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self.mask
            held = self.keys[slot[rest]]
            hit = held == h[rest]
            out[rest[hit]] = self.at[slot[rest[hit]]]
            rest = rest[~hit & (held != 0)]
        return out

    def put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """New hashes, each once."""
        slot, rest = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(rest):
            free = rest[self.keys[slot[rest]] == 0]
            self.keys[slot[free]] = h[free]
            won = self.keys[slot[rest]] == h[rest]
            self.at[slot[rest[won]]] = numbers[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & self.mask


class Lookup:
    """pre-token -> its ids, in flat arrays: pre-tokens are found in the bytes of many texts at once and looked up by 64-bit hashes.

    Fixed entries stay. When the others reach `bound`, all of them go and are learnt anew. Pre-tokens beyond LONG_BYTES
    aren't kept, so memory doesn't grow with their length. A text that holds one, or anything that isn't sure to be one
    pre-token, or an added token's string, is taken run by run between white space, and such runs are encoded as they are.
    """

    def __init__(self, path: str, bound: int = CACHE):
        self.bound, self.tok = bound, tokenizer(path)
        self.added = [x.content.encode() for x in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, np.bool_)
        self.ends[[i for x, i in vocab.items() if x.endswith("</w>")]] = True
        self.fixed: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        """Fixed entries have lengths alone: a process that takes ids fixes none."""
        self.slots = Slots((2 * self.bound).bit_length())
        self.n, self.size = len(self.fixed), 0
        self.counts_, self.first = np.zeros(self.bound + self.n + 1, np.int32), np.zeros(self.bound + self.n + 1, np.int64)
        self.pool = np.zeros(4 * self.bound, np.uint32)
        if self.fixed:
            buf = b" ".join(self.fixed) + b" "
            h, *_ = _tokens(buf)
            self.slots.put(h, np.arange(self.n, dtype=np.int32))
            self.counts_[: self.n] = list(self.fixed.values())

    def fix(self, entries: dict[bytes, int]) -> None:
        """Lengths that are known already, of pre-tokens."""
        if entries != self.fixed:
            self.fixed = dict(entries)
            self.clear()

    def counts(self, data: list[bytes]) -> list[int]:
        """Each text's number of ids."""
        out = []
        for part in in_parts(data):
            first, number, odd = self._numbers(part)
            total = np.concatenate([[0], np.cumsum(self.counts_[number], dtype=np.int64)])
            n = (total[first[1:]] - total[first[:-1]]).tolist()
            out += [len(self._odd(x)) // 4 if bad else k for x, k, bad in zip(part, n, odd, strict=True)]
        return out

    def ids(self, data: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian bytes of 4."""
        out = []
        for part in in_parts(data):
            first, number, odd = self._numbers(part)
            counts = self.counts_[number].astype(np.int64)
            counts[counts < 0] = 0
            total = np.concatenate([[0], np.cumsum(counts)])
            held = self.pool[np.repeat(self.first[number] - total[:-1], counts) + np.arange(total[-1])].astype("<u4").tobytes()
            ends = (4 * total[first]).tolist()
            out += [self._odd(x) if bad else held[lo:hi] for x, lo, hi, bad in zip(part, ends[:-1], ends[1:], odd, strict=True)]
        return out

    def _numbers(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts: where each one's pre-tokens begin, each pre-token's entry, and the texts that must be taken by runs."""
        buf = b"\n".join(data).lower() + b"\n"
        h, start, end = _tokens(buf)
        first = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in data)]))
        number = self.slots.find(h)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            new, at = np.unique(h[miss], return_index=True)
            if self.n + len(new) > self.bound + len(self.fixed):
                self.clear()
                number = self.slots.find(h)
                miss = np.flatnonzero(number < 0)
                new, at = np.unique(h[miss], return_index=True)
            self._learn(new, [buf[i:j] for i, j in zip(start[miss[at]].tolist(), end[miss[at]].tolist(), strict=True)])
            number[miss] = self.slots.find(h[miss])
        bad = np.concatenate([[0], np.cumsum(self.counts_[number] < 0)])
        odd = bad[first[1:]] > bad[first[:-1]]
        for k, text in enumerate(data):
            odd[k] |= any(x in text for x in self.added)
        return first, number, odd

    def _learn(self, hashes: np.ndarray, tokens: list[bytes]) -> None:
        words, others, counts, held = [], [], np.full(len(tokens), -1, np.int64), {}
        for k, x in enumerate(tokens):
            if len(x) > LONG_BYTES:
                continue
            if x.isalpha() or not x.isascii() and sure(x):  # ASCII letters, or others
                words.append(k)
            elif x.isascii() and 32 < x[0] < 127:
                others.append(k)
        for i in range(0, len(words), 512):  # letters alone are one pre-token each: many are encoded as one text, and parted where a word ends
            part = words[i : i + 512]
            ids = np.array(self.tok.encode_batch_fast([b" ".join([tokens[k] for k in part]).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                counts[part] = np.diff(ends, prepend=0)
                held[part[0]] = part, ids
            else:
                others += part
        for k in others:
            ids = self._encode(tokens[k])
            counts[k] = len(ids)
            held[k] = [k], ids
        for part, ids in held.values():
            if self.size + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
            self.pool[self.size : self.size + len(ids)] = ids
            own = counts[part]
            self.first[self.n + np.array(part)] = self.size + np.cumsum(own) - own
            self.size += len(ids)
        self.counts_[self.n : self.n + len(tokens)] = counts
        self.slots.put(hashes, np.arange(self.n, self.n + len(tokens), dtype=np.int32))
        self.n += len(tokens)

    def _encode(self, run: bytes) -> np.ndarray:
        return np.array(self.tok.encode(run.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)

    def _odd(self, text: bytes) -> bytes:
        """A text's ids run by run."""
        runs = text.translate(SPACES).split(b" ")
        known: dict[bytes, bytes] = {}
        new = list(dict.fromkeys(runs))
        for i in range(0, len(new), 4096):
            part = [x for x in new[i : i + 4096] if len(x) <= LONG_BYTES]
            _, number, odd = self._numbers(part) if part else (None, None, [])
            good = [x for x, bad in zip(part, odd, strict=True) if not bad]
            known.update(zip(good, self.ids(good), strict=True) if good else ())
        return b"".join(known[x] if x in known else known.setdefault(x, self._encode(x).astype("<u4").tobytes()) for x in runs)


def _tokens(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each pre-token of lower-case bytes that end with white space."""
    x = np.frombuffer(buf, np.uint8)
    kind = KINDS[x]
    begin = np.empty(len(x), np.bool_)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= kind == DIGIT
    # a contraction begins with an apostrophe that begins a pre-token
    mark = np.flatnonzero((x[:-1] == 39) & begin[:-1])
    if len(mark):
        y = np.concatenate([x, np.zeros(3, np.uint8)])
        one, two = y[mark + 1], y[mark + 2]
        size = np.where(np.isin(one, ONE), 2, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 3, 0))
        mark, size = mark[size > 0], size[size > 0]
        begin[mark + 1] = False
        after = mark + size
        begin[after[kind[after] == LETTER]] = True
    at = np.flatnonzero(begin)
    end = np.append(at[1:], len(x))
    own = kind[at] > 0
    at, end = at[own], end[own]
    return span_hashes(x, at, end), at, end


def lookup(path: str, kind: str) -> Lookup:
    """The process's table for lengths ("n") or for ids."""
    if (path, kind) not in _tables:
        _tables[path, kind] = Lookup(path)
    return _tables[path, kind]


def pack_table(values: dict[bytes, int]) -> bytes:
    """A compact form: key lengths and values, then all keys."""
    keys = sorted(values)
    return struct.pack("<I", len(keys)) + struct.pack(f"<{len(keys)}I", *map(len, keys)) + struct.pack(f"<{len(keys)}Q", *(values[k] for k in keys)) + b"".join(keys)


def unpack_table(data: bytes) -> dict[bytes, int]:
    n = struct.unpack_from("<I", data)[0]
    sizes, values = struct.unpack_from(f"<{n}I", data, 4), struct.unpack_from(f"<{n}Q", data, 4 + 4 * n)
    out, at = {}, 4 + 12 * n
    for size, v in zip(sizes, values, strict=True):
        out[data[at : at + size]] = v
        at += size
    return out


def frequent(docs: DataFrame, table: Lookup, tokenizer_file: str, text_col: str = "text", most: int = TABLE) -> bytes:
    """The packed lengths of the most frequent pre-tokens of all texts (heavy hitters: exact for those that lead in their partitions)."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in texts(batch, 0):
                seen.update(PRE.findall(text.lower()))
            if len(seen) > 64 * SUMMARY:
                seen = Counter(dict(seen.most_common(16 * SUMMARY)))
        part = TaskContext.get().partitionId()
        yield table_batch(pa.schema([("part", pa.int64()), ("summary", pa.binary())]), [[part], [pack_table({x: c for x, c in seen.most_common(SUMMARY) if len(x) < 64})]])

    def merge(table: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for data in table.column("summary"):
            seen.update(unpack_table(data.as_py()))
        part = table.column("part")[0].as_py() // FAN
        return pa.table({"part": pa.array([part], pa.int64()), "summary": pa.array([pack_table(dict(seen.most_common(most)))], pa.binary())})

    level = mapped(whole(docs, text_col), summarise, "part long, summary binary")
    parts = max(1, docs.rdd.getNumPartitions())
    while parts > 1:
        level, parts = level.groupBy(F.floor(F.col("part") / FAN).alias("g")).applyInArrow(merge, "part long, summary binary"), -(-parts // FAN)
    rows = level.select("summary").collect()  # one row of at most TABLE entries
    leading = list(unpack_table(bytes(rows[0][0]))) if rows else []
    leading = [x for x in leading if 32 < x[0] and (x.isascii() or sure(x))]
    return pack_table(dict(zip(leading, table.counts(leading), strict=True)))


def count_tokens(docs: DataFrame, tokenizer_file: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every text, as the tokenizer gives them without added special tokens.

    Null text: 0 bytes and 0 tokens. Repeated rows come out as often as they come in; an empty table gives no rows.
    A tokenizer that keeps white space is applied to whole texts instead of runs.
    """
    spark = docs.sparkSession
    parted = splits_at_spaces(tokenizer_file)
    held = spark.sparkContext.broadcast(frequent(docs, lookup(tokenizer_file, "n"), tokenizer_file, text_col) if parted else b"")
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()
    schema = pa.schema([(id_col, id_type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_file)
        if parted:
            table = lookup(tokenizer_file, "n")
            table.fix(unpack_table(held.value))
        for batch in batches:
            data = texts(batch, 1)
            n = table.counts(data) if parted else [len(e.ids) for e in tok.encode_batch_fast([x.decode("utf-8", "replace") for x in data], add_special_tokens=False)]
            yield table_batch(schema, [batch.column(0).cast(id_type), list(map(len, data)), n, [x > limit for x in n]])

    return mapped(whole(docs, id_col, text_col), count, f"`{id_col}` {'string' if kind == 'string' else 'long'}, n_bytes long, n_tokens long, over_limit boolean")
