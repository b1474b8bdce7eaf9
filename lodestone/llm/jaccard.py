"""N-gram Jaccard join with set-relation skipping: exact links of sets of word shingles, their components and counts.

Every text is taken apart once. Equal sets are one class and joined once. The join of the classes:

* Order. Chunks of texts send their distinct shingles, as sorted keys, to shards by key range; shards answer with each
  key's exact frequency. The number of shards follows the data, and nothing of this is broadcast or sent to the
  driver. Ordered by frequency, a set's prefix must share a key with every partner, so only prefixes are indexed, and
  of them only keys that another class has too.
* Position. An index list is sorted by position and walked in blocks: a pair of blocks is skipped if their positions
  and sizes leave no pair of sets enough overlap.
* Answers. A set joins the family of a hub that shares min-hashes with it and with many others. Distances of Jaccard
  obey the triangle inequality: sets near their hub are linked with each other, which is derived and counted without a
  comparison. Lists don't yield pairs of sets, but which sets a family has to meet. Sets that meet are compared in
  blocks: one set's overlaps are computed, and the others' follow from their differences to it, as one matrix product.

A pair of sets meets in the pair of their families and nowhere else, so each link is derived or verified exactly
once. Links are counted where they are found and never written as pairs: a block gives each set's number of links and
the smallest set that it reaches there.

Null texts, and texts without words, have no shingles and link with nothing. Ids are integers; a row with a null id is
measured and takes no part (null class and component). Repeated rows give repeated rows; rows of one id are taken to
have one text. Texts of any length are taken whole. An empty table gives no rows. Shingles are compared by 64-bit
hashes, whole sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bundle, free, in_parts, mapped, mix64, prepare, span_hashes, table_batch, texts, unbundle, whole, written
from lodestone.llm.components import components

WORDS, PERCENT = 5, 75
#: Min-hashes of a set, and how many a set shares with its hub at least.
MINS, SHARED = 12, 4
#: Bits of a key; keys of a chunk and of a shard.
KEY_BITS, FLUSH, SHARD_KEYS = 48, 1 << 19, 1 << 21
#: Sets of a block when families meet; entries of a list's block; length from which a list is dealt out, in parts of DEAL.
BLOCK, STEP, LONG, DEAL = 512, 64, 8192, 2048
WHITE = [bytes([c]) for c in (32, *range(9, 14))]
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_MULTIPLIERS = mix64(np.arange(1, MINS + 1, dtype=np.uint64)) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts: the hashes of all words, in ASCII lower case; and where each text's begin."""
    buf = b" ".join(data).lower() + b" "
    x = np.frombuffer(buf, np.uint8)
    edge = np.diff((~SPACE[x]).view(np.int8), prepend=np.int8(0))
    at, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(x, at, end), np.searchsorted(at, np.cumsum([0, *(len(t) + 1 for t in data)]))


def pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text cut at white space, so that its words are taken apart in bounded memory."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(c, at, at + most) for c in WHITE)
        if cut <= at:
            cut = min((i for c in WHITE if (i := text.find(c, at + most)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def shingles(data: list[bytes]) -> list[np.ndarray]:
    """Each text's set of hashes of WORDS-word shingles, sorted; of fewer words, the whole sequence's."""
    out = []
    for part in in_parts(data):
        if len(part) == 1:
            h = np.concatenate([word_hashes([x])[0] for x in pieces(part[0])])
            first = np.array([0, len(h)])
        else:
            h, first = word_hashes(part)
        held = _windows(h, WORDS)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            n = min(WORDS, hi - lo)
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            x = held[lo : hi - n + 1] if n == WORDS else _windows(h[lo:hi], n)
            x = np.sort(x)
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
    return out


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    if len(h) < n:
        return np.zeros(0, np.uint64)
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = x * _P + h[k : len(h) - n + 1 + k]
    return mix64(x)


def needed(n, percent: int = PERCENT):
    """The least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("chunk", pa.int64()), ("held", pa.binary())])
PACKET, PACKET_DDL = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("held", pa.binary())]), "chunk long, shard long, held binary"


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (size, signature), and rows of chunks: keys in order, how many sets have each, and which; ids, sizes and signatures."""
    chunk, size, kept, info = TaskContext.get().partitionId() << 32, 0, [], []

    def flush() -> pa.RecordBatch:
        keys = np.concatenate(kept) >> np.uint64(64 - KEY_BITS)
        owner = np.repeat(np.arange(len(kept), dtype=np.uint16 if len(kept) <= 1 << 16 else np.uint32), [len(x) for x in kept])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times = np.diff(np.append(first, len(keys))).astype(np.uint32)
        held = bundle(np.diff(keys[first], prepend=np.uint64(0)), times, owner, *(np.array(x) for x in zip(*info, strict=True)))
        return table_batch(PROFILE, [[None], [None], [None], [None], [chunk], [held]])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        sets = shingles(texts(batch, 1))
        n, at = np.array([len(x) for x in sets], np.int64), [k for k, x in enumerate(sets) if len(x)]
        sigs = np.zeros((2, len(sets)), np.int64)
        if at:
            x, first = np.concatenate([sets[k] for k in at]), np.concatenate([[0], np.cumsum(n[at])[:-1]])
            for k, salt in enumerate((_P, _MULTIPLIERS[0])):
                sigs[k, at] = mix64(np.add.reduceat(mix64(x ^ salt), first) + n[at].astype(np.uint64) * _P).view(np.int64)
        none = [None] * len(sets)
        yield table_batch(PROFILE, [batch.column(0), n, sigs[0], sigs[1], none, none])
        for k in at:
            if ids[k] is not None:
                kept.append(sets[k])
                info.append((ids[k], n[k], sigs[0, k], sigs[1, k]))
                size += len(sets[k])
        if size >= FLUSH:
            yield flush()
            chunk, size, kept, info = chunk + 1, 0, [], []
    if size:
        yield flush()


def _requests(shards: int):
    edges = np.array([-(-(s << KEY_BITS) // shards) for s in range(shards)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                gaps, times = unbundle(held.as_py())[:2]
                keys = np.cumsum(gaps, dtype=np.uint64)
                ends = np.append(np.searchsorted(keys, edges), len(keys))
                rows = [(chunk, s, bundle(np.diff(keys[lo:hi], prepend=keys[lo : lo + 1]), keys[lo : lo + 1], times[lo:hi])) for s, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if hi > lo]
                yield table_batch(PACKET, list(zip(*rows, strict=True)))

    return run


def _answers(key: tuple, table: pa.Table) -> pa.Table:
    """Each chunk's keys of one shard with their frequencies in all chunks, in the order of the request."""
    parts = [unbundle(x.as_py()) for x in table.column("held")]
    keys = np.concatenate([np.cumsum(gaps, dtype=np.uint64) + first[0] for gaps, first, _ in parts])
    _, at = np.unique(keys, return_inverse=True)
    f = np.bincount(at, np.concatenate([x[2] for x in parts])).astype(np.int64)[at]
    ends = np.cumsum([len(x[2]) for x in parts])[:-1]
    return pa.table([table.column("chunk"), table.column("shard"), pa.array([bundle(x) for x in np.split(f, ends)], pa.binary())], schema=PACKET)


ENTRY = pa.struct([("key", pa.int64()), ("pos", pa.int64()), ("f", pa.int64())])
ENTRIES = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("sig2", pa.int64()), ("entries", pa.list_(ENTRY))])


def _entries(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Of a chunk and its answers: each set's prefix, as far as its keys occur more than once; equal sets of a chunk are taken once."""
        rows = [x for _, x in sorted(zip(table.column("shard").to_pylist(), table.column("held").to_pylist(), strict=True), key=lambda r: r[0])]
        gaps, times, owner, ids, n, sig, sig2 = unbundle(rows[0])
        f = np.repeat(np.concatenate([unbundle(x)[0] for x in rows[1:]]), times)
        lead = np.zeros(len(ids), np.bool_)
        lead[np.unique(np.ascontiguousarray(np.stack([sig, sig2], axis=1)).view("V16").ravel(), return_index=True)[1]] = True
        at = np.flatnonzero((f > 1) & lead[owner])
        keys, f, owner = np.repeat(np.cumsum(gaps, dtype=np.uint64), times)[at], f[at], owner[at].astype(np.int64)
        order = np.lexsort((keys, f, owner))
        keys, f, owner = keys[order].view(np.int64), f[order], owner[order]
        many = np.bincount(owner, minlength=len(ids))
        pos = n[owner] - many[owner] + np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
        kept = pos <= (n - needed(n, percent))[owner]
        keys, f, owner, pos = keys[kept], f[kept], owner[kept], pos[kept]
        own, first = np.unique(owner, return_index=True)
        flat = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (keys, pos, f)], fields=list(ENTRY))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)), pa.int32()), flat)
        return pa.table([*(pa.array(x[own], pa.int64()) for x in (ids, n, sig, sig2)), lists.cast(ENTRIES.field("entries").type)], schema=ENTRIES)

    return run


SETS = pa.schema([("id", pa.int64()), ("mins", pa.list_(pa.int64())), ("held", pa.binary())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingles(texts(batch, 1))
        yield table_batch(SETS, [batch.column(0), [[int((x * m).min().view(np.int64)) for m in _MULTIPLIERS] if len(x) else None for x in sets], [x.tobytes() for x in sets]])


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, hub, set, hub's set): whether the distance is at most half of what a link may have."""
        schema = pa.schema([("id", pa.int64()), ("hub", pa.int64()), ("near", pa.bool_())])
        for batch in batches:
            near = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (left, right))
                union = len(x) + len(y) - (same := overlap(x, y))
                near.append(200 * (union - same) <= (100 - percent) * union)
            yield table_batch(schema, [batch.column(0), batch.column(1), near])

    return run


MEETS = pa.schema([("lo", pa.int64()), ("hi", pa.int64()), ("id", pa.int64()), ("hub", pa.int64()), ("near", pa.bool_())])


def _meets(percent: int):
    """From rows (key, id, n, pos, hub, near) by key and pos: which sets two families (or one) have to compare."""

    def able(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of rows a and b (id, n, pos, hub, near): size, position, and what the hub has answered."""
        n, m = a[1], b[1]
        good = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        good &= np.minimum(n - a[2], m - b[2]) >= -(-percent * (n + m) // (100 + percent))
        return good & ((a[3] != b[3]) | (a[4] == 0) | (b[4] == 0))

    def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.minimum(a[3], b[3]), np.maximum(a[3], b[3])
        return np.concatenate([np.stack([lo, hi, x[0], x[3], x[4]]) for x in (a, b)], axis=1)

    def short(key: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
        at, k = np.arange(len(key) - 1), 1
        while len(at := at[(at + k < len(key))]) and len(at := at[key[at] == key[at + k]]):
            a, b = rows[:, at], rows[:, at + k]
            good = able(a, b)
            yield met(a[:, good], b[:, good])
            k += 1

    def long(rows: np.ndarray) -> Iterator[np.ndarray]:
        starts = np.arange(0, rows.shape[1], STEP)
        n, left = rows[1], rows[1] - rows[2]
        most, low, high = np.maximum.reduceat(left, starts), np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
        far = np.minimum.reduceat(rows[4], starts) == 0
        hub, top = np.minimum.reduceat(rows[3], starts), np.maximum.reduceat(rows[3], starts)
        for i in range(len(starts)):
            least = -(-percent * (low[i] + low[i:]) // (100 + percent))
            open_ = (np.minimum(most[i], most[i:]) >= least) & (100 * high[i:] >= percent * low[i]) & (100 * high[i] >= percent * low[i:])
            open_ &= far[i] | far[i:] | (hub[i] != top[i]) | (hub[i:] != top[i:]) | (hub[i] != hub[i:])
            for j in (i + np.flatnonzero(open_)).tolist():
                x, y = np.indices((min(STEP, len(n) - starts[i]), min(STEP, len(n) - starts[j]))).reshape(2, -1)
                x, y = x + starts[i], y + starts[j]
                if i == j:
                    x, y = x[x < y], y[x < y]
                a, b = rows[:, x], rows[:, y]
                good = able(a, b)
                if good.any():
                    yield np.unique(met(a[:, good], b[:, good]), axis=1)

    def lists(rows: np.ndarray) -> Iterator[np.ndarray]:
        key = rows[0]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        few = np.repeat(sizes <= STEP, sizes) & np.repeat(sizes > 1, sizes)
        yield from short(key[few], rows[1:, few])
        for at in np.flatnonzero(sizes > STEP):
            yield from long(rows[1:, first[at] : first[at] + sizes[at]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, found, size = np.zeros((6, 0), np.int64), [], 0

        def flush() -> pa.RecordBatch:
            x = np.concatenate(found, axis=1)
            x = x[:, np.lexsort(x[:3])]
            x = x[:, np.concatenate([[True], (x[:3, 1:] != x[:3, :-1]).any(axis=0)])]
            return table_batch(MEETS, [*x[:4], x[4].astype(np.bool_)])

        for batch in _ended(batches):
            if batch is not None:
                carry = np.concatenate([carry, np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            last = carry.shape[1] if batch is None else int(np.searchsorted(carry[0], carry[0, -1], "left")) if carry.shape[1] else 0
            for x in lists(carry[:, :last]) if last else ():
                if x.shape[1]:
                    found.append(x)
                    size += x.shape[1]
                if size > 1 << 20:
                    yield flush()
                    found, size = [], 0
            carry = carry[:, last:]
        if size:
            yield flush()

    return run


def _ended(batches: Iterator) -> Iterator:
    yield from batches
    yield None


LINKS = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("c", pa.int64())])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Overlaps of the left with the right sets, from their differences to the first set: with what a lacks and has beyond it,
    |a & b| = |first| - lacks(a) - lacks(b) + |both lack| + |both have beyond|."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    u, at = np.unique(values, return_inverse=True)
    inside = np.zeros(len(u), np.bool_)
    inside[np.searchsorted(u, sets[0])] = True
    has = np.bincount(at, minlength=len(u))
    lacks = len(sets[0]) - np.bincount(owner[inside[at]], minlength=len(sets))
    column = np.cumsum(np.where(inside, len(sets) - has, has) >= 2) - 1  # a difference of one set alone is in no product
    used = np.where(inside, len(sets) - has, has) >= 2
    keep = used[at]
    owner, column, inside_ = owner[keep], column[at[keep]], inside[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column, inside_ = owner[order], column[order], inside_[order]
    whole_columns = inside[used]
    out = (len(sets[0]) - lacks[left][:, None] - lacks[right][None, :]).astype(np.float32)
    for lo in range(0, len(whole_columns), 4096):
        base = whole_columns[lo : lo + 4096]
        d = np.repeat(base[None, :].astype(np.float32), len(sets), axis=0)
        i, j = np.searchsorted(column, [lo, lo + 4096])
        d[owner[i:j], column[i:j] - lo] = ~inside_[i:j]
        out += d[left] @ d[right].T
    return out.astype(np.int64)


def _compare(percent: int):
    """From rows (g, lo, hi, one, two, own, id, hub, near, held) by group: each set's links in it, and the smallest set that it reaches there."""

    def block(rows: list[tuple]) -> list[tuple]:
        one, two = rows[0][3:5]
        sets = [np.frombuffer(r[9], np.uint64) for r in rows]
        own, ids, hub, near = (np.array([r[k] for r in rows]) for k in (5, 6, 7, 8))
        if len(rows) < 2 or one != two and (own == own[0]).all():
            return []
        left, right = (np.flatnonzero(own == x) for x in (one, two)) if one != two else (np.arange(len(rows)),) * 2
        n = np.array([len(x) for x in sets])
        same = overlaps(sets, left, right) if len(rows) > 2 else np.array([[overlap(sets[a], sets[b]) for b in right] for a in left])
        link = 100 * same >= percent * (n[left][:, None] + n[right][None, :] - same)
        link &= ids[left][:, None] != ids[right][None, :]
        # within a family the hub has answered pairs of near sets; two families compare across
        link &= (hub[left][:, None] != hub[right][None, :]) if rows[0][1] != rows[0][2] else ~(near[left][:, None] & near[right][None, :])
        full = np.zeros((len(rows), len(rows)), np.bool_)
        full[np.ix_(left, right)] = link
        full |= full.T
        c, root = full.sum(axis=1), ids.copy()
        at = np.flatnonzero(c)
        full, root = full[np.ix_(at, at)], root[at]
        while len(at):
            least = np.minimum(root, np.where(full, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (least == root).all():
                break
            root = least
        return list(zip(ids[at].tolist(), root.tolist(), c[at].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = [], []
        for batch in _ended(batches):
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)) if batch is not None else [(None,) * 5]
            for row in rows:
                if held and held[0][1:5] != row[1:5]:
                    found += block(held)
                    held = []
                held.append(row)
            if len(found) > 8192 or batch is None and found:
                yield table_batch(LINKS, list(zip(*found, strict=True)))
                found = []

    return run


def join(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, class_id (smallest id with an equal set), component_id (smallest id reachable by links) and n_links (classes that its class is linked with)."""
    spark = prepare(docs.sparkSession)
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col}: ids are integers")
    docs = whole(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    profiles = written(mapped(docs, _profiles, "doc_id long, n long, sig long, sig2 long, chunk long, held binary"), "profiles")
    rows = written(profiles.where("chunk is null").select("doc_id", "n", "sig", "sig2"), "rows")
    sums = rows.where("doc_id is not null").agg(F.sum("n")).first()[0] or 0
    same = ["sig", "sig2", "n"]
    reps = written(rows.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")), "reps")

    # the index: prefixes by exact frequencies, of keys that another class has too
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(parts, -(-sums * 32 // SHARD_KEYS)), -(-sums // SHARD_KEYS))
    chunks = profiles.where("chunk is not null").select("chunk", "held")
    answers = written(mapped(chunks, _requests(shards), PACKET_DDL, rows=1).groupBy("shard").applyInArrow(_answers, PACKET_DDL), "frequencies")
    asked = chunks.select("chunk", F.lit(-1).cast("long").alias("shard"), "held").unionAll(answers.select("chunk", "shard", "held"))
    entries = asked.groupBy("chunk").applyInArrow(_entries(percent), "id long, n long, sig long, sig2 long, entries array<struct<key:bigint,pos:bigint,f:bigint>>")
    entries = entries.join(reps.select(*same, F.col("rep").alias("id"), "k"), [*same, "id"])
    entries = entries.select("id", "n", F.expr("filter(entries, e -> e.f > k)").alias("entries")).where("size(entries) > 0")
    index = written(entries.dropDuplicates(["id"]), "index")
    free(profiles, answers)

    # the sets that have entries, and their families
    sets = written(mapped(docs.join(index.select("id").hint("merge"), "id", "left_semi").dropDuplicates(["id"]).select("id", "text"), _sets, "id long, mins array<bigint>, held binary"), "sets")
    mins = sets.select("id", F.posexplode("mins").alias("i", "m"))
    hubs = mins.groupBy("i", "m").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").select("i", "m", "hub")
    stars = written(mins.join(hubs, ["i", "m"]).groupBy("id", "hub").agg(F.count("*").alias("c")).where(f"c >= {SHARED}").select("id", "hub"), "stars")
    sizes = stars.groupBy("hub").agg(F.count("*").alias("size"))
    homes = stars.join(sizes, "hub").groupBy("id").agg(F.max(F.struct("size", (-F.col("hub")).alias("hub"))).alias("best")).select("id", (-F.col("best.hub")).alias("hub"))
    away = homes.where("id <> hub").join(sets.select("id", F.col("held").alias("x")), "id").join(sets.select(F.col("id").alias("hub"), F.col("held").alias("y")), "hub")
    away = written(mapped(away.select("id", "hub", "x", "y"), _near(percent), "id long, hub long, near boolean"), "away")
    homes = written(index.select("id").join(away, "id", "left").select("id", F.coalesce("hub", "id").alias("hub"), F.coalesce("near", F.lit(True)).alias("near")), "homes")
    free(stars, away)

    # which sets have to meet: from index lists, the longest dealt out as pairs of parts
    entries = index.join(homes, "id").select("id", "n", "hub", "near", F.inline("entries"))
    columns, ddl = ("key", "id", "n", "pos", "hub", "near"), "lo long, hi long, id long, hub long, near boolean"
    long = entries.where(f"f > {LONG}")
    parted = long.groupBy("key").agg(F.ceil(F.count("*") / DEAL).alias("s"))
    long = long.join(parted, "key").withColumn("own", F.pmod(F.xxhash64("id"), "s")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)))
    long = long.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    listed = entries.where(f"f <= {LONG}").select(*columns).unionAll(long.select(*columns))
    meets = mapped(listed.repartition(parts, "key").sortWithinPartitions("key", "pos"), _meets(percent), ddl, rows=1 << 16)
    meets = written(meets.distinct(), "meets")

    # the sets that meet are compared in blocks; each gives counts of links and what is reached by them
    many = meets.groupBy("lo", "hi").agg(F.ceil(F.count("*") / BLOCK).alias("s")).where("s > 1")
    dealt = meets.join(many, ["lo", "hi"], "left").withColumn("s", F.coalesce("s", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("id"), "s"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1))).select("lo", "hi", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "id", "hub", "near")
    dealt = dealt.join(sets.select("id", "held"), "id").select(F.xxhash64("lo", "hi", "one", "two").alias("g"), "lo", "hi", "one", "two", "own", "id", "hub", "near", "held")
    found = mapped(dealt.repartition(parts, "g").sortWithinPartitions("g", "lo", "hi", "one", "two"), _compare(percent), "id long, root long, c long")
    found = written(found, "links")

    # a near set is linked with its hub and with all others near it
    derived = homes.where("near").groupBy("hub").agg((F.count("*") - 1).alias("c")).where("c > 0")
    derived = written(homes.where("near").join(derived, "hub").select("id", F.col("hub").alias("root"), "c"), "derived")
    links = found.unionAll(derived)
    counts = links.groupBy(F.col("id").alias("rep")).agg(F.sum("c").alias("n_links"))
    comps = components(links.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    classes = reps.select(*same, "rep").join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").join(counts, "rep", "left")
    classes = written(classes.select(*same, "rep", F.coalesce("comp", "rep").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    free(index, sets, homes, meets, found, derived, reps)
    out = rows.join(classes, same, "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), own("rep").alias("class_id"), own("comp").alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
