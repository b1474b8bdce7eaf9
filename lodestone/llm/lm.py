"""Language-model scoring by a weighted backoff automaton that is sharded by history.

Counts of words and of all n-grams up to three cover every training document; none is pruned. Probabilities interpolate
by absolute discounting: an n-gram is an arc of its history's state, and what a history leaves over is the weight of its
failure arc to the shorter history.

Nothing that is learnt is held on the driver or broadcast. Texts are cut into chunks of at most CHUNK words (or one
text), written once as word numbers. Each chunk sends its distinct histories with the arcs it takes to the shards that
their hashes name; a shard adds up the training counts of all chunks and answers with each history's count and number of
arcs, and each arc's count; one chunk of those that hold a history counts it as an arc of its first word. Words do the
same. From the answers a chunk builds the part of the automaton that its texts can reach: a state for the empty history,
each word and each pair of words, arcs in one sorted array with their log weights and ends, and each state's failure arc.
One pass from left to right carries the state through each text, many texts side by side: a word that has no arc takes
failure arcs until one has. A shard's size is bounded: there are at least as many shards as chunks / CHUNKS_A_SHARD.

Words are compared by 64-bit hashes, histories by 56 bits, the arcs of one history by 40. Null texts count as empty:
the end alone. A text of any length is one piece of its chunk. Repeated rows are scored each; ids are hashed as text to
choose held-out rows. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bundle, mapped, mix64, prepare, table_batch, texts, unbundle, whole, written

DISCOUNT = 0.75
#: Words of a chunk; chunks for each of which there is a shard.
CHUNK, CHUNKS_A_SHARD = 1 << 20, 2
#: Bits of the hashes by which histories, and the arcs of one history, are compared.
HISTORY_BITS, ARC_BITS = 56, 40
END = b" "  # the end as a word that no text has
#: Words that one lane of the traversal reads; a longer text takes several, each led in by the two words before it, which fix the state.
LANE = 128


def held_out(doc) -> bool:
    return zlib.crc32(str(doc).encode()) % 7 == 2


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


#: A chunk's words 0, 1 and 2: the begin, the end, and what follows the end so that each word is a history's last. No text has them.
_MARKS = (b"\n", END, b"\t")
_P = np.uint64(0x9E3779B97F4A7C15)


class _Local(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _chunks(id_type: pa.DataType, most: int):
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(id_type)), ("held", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, local, ids, kept = TaskContext.get().partitionId() << 33, 0, _Local(), [], []

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, local), np.uint64, len(local))
            held = bundle(np.array([len(x) for x in kept], np.int64), np.array([not held_out(d) for d in ids]), np.concatenate(kept), hashes)
            return table_batch(schema, [[chunk], [ids], [held]])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True):
                if not ids:
                    local = _Local({w: k for k, w in enumerate(_MARKS)})
                words = [*words_of(text), END]
                kept.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
                ids.append(doc)
                size += len(words)
                if size >= most:
                    yield flush()
                    chunk, size, ids, kept = chunk + 1, 0, [], []
        if ids:
            yield flush()

    return run


class _Chunk:
    """A chunk's texts as numbers of its distinct pairs and triples of words. Pair k of the texts ends with word k."""

    def __init__(self, held: bytes, shards: int):
        self.lens, train, self.words, self.hashes = unbundle(held)
        n, self.first = len(self.hashes), np.cumsum(self.lens) - self.lens
        self.train = np.repeat(train, self.lens).astype(np.int64)
        starts = self.first + 2 * np.arange(len(self.lens))
        inner = np.ones(len(self.words) + 2 * len(self.lens), np.bool_)
        inner[starts] = inner[starts + self.lens + 1] = False
        row = np.zeros(len(inner), np.int64)
        row[inner] = self.words
        row[starts + self.lens + 1] = 2
        at = np.flatnonzero(inner) - 1
        self.n_train = int(train.sum())
        pairs, self.pair = np.unique(row[at] * n + row[at + 1], return_inverse=True)
        triples, self.triple = np.unique(self.pair * n + row[at + 2], return_inverse=True)
        self.u, self.v = np.divmod(pairs, n)
        self.history, self.w = np.divmod(triples, n)
        self.times = np.bincount(self.triple, self.train, len(triples)).astype(np.int64)
        # the order of requests, and of answers: by shard, then by hash
        keys = mix64(mix64(self.hashes[self.u]) + self.hashes[self.v] * _P) >> np.uint64(64 - HISTORY_BITS)
        shard = ((keys >> np.uint64(HISTORY_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        self.order = np.argsort(keys, kind="stable")  # by shard, too: shards are ranges
        place = np.empty(len(pairs), np.int64)
        place[self.order] = np.arange(len(pairs))
        self.arc_order = np.argsort(place[self.history], kind="stable")
        self.keys, self.shard = keys[self.order], shard[self.order]

    def requests(self) -> Iterator[tuple[int, bytes]]:
        arcs = np.bincount(self.history, minlength=len(self.u))[self.order]
        hw, times = self.hashes[self.w[self.arc_order]] >> np.uint64(64 - ARC_BITS), self.times[self.arc_order]
        ends = np.concatenate([[0], np.cumsum(arcs)])
        for s, lo, hi in _runs(self.shard):
            yield s, bundle(np.diff(self.keys[lo:hi], prepend=np.uint64(0)), arcs[lo:hi], hw[ends[lo] : ends[hi]], times[ends[lo] : ends[hi]])


def _runs(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of a sorted array."""
    if len(x):
        edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(x[lo]), lo, hi


def _word_order(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, shard[order]


PACKET = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("kind", pa.string()), ("held", pa.binary())])
PACKET_DDL = "chunk long, shard long, kind string, held binary"


def _packets(rows: list[tuple]) -> pa.RecordBatch:
    return table_batch(PACKET, list(zip(*rows, strict=True)) if rows else [[], [], [], []])


def _pair_requests(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _packets([(chunk, s, "pairs", x) for s, x in _Chunk(held.as_py(), shards).requests()])

    return run


def _pair_answers(key: tuple, table: pa.Table) -> pa.Table:
    """Each chunk's histories with count and number of arcs, and whether the chunk counts them as arcs; and its arcs with counts."""
    parts = [unbundle(x.as_py()) for x in table.column("held")]
    keys, arcs, hw, times = (np.concatenate(x) for x in zip(*((np.cumsum(gaps, dtype=np.uint64), *rest) for gaps, *rest in parts), strict=True))
    keys, first, pair = np.unique(keys, return_index=True, return_inverse=True)
    of = np.repeat(pair, arcs)
    _, arc_first, arc = np.unique(mix64(keys[of] + mix64(hw) * _P), return_index=True, return_inverse=True)
    c3 = np.bincount(arc, times).astype(np.int64)
    history = of[arc_first]
    c2, n2 = (np.bincount(history, x, len(keys)).astype(np.int64) for x in (c3, c3 > 0))
    own = np.zeros(len(pair), np.uint8)
    own[first[c2 > 0]] = 1
    rows, lo, at = [], 0, 0
    for chunk, (mine, own_arcs, _, _) in zip(table.column("chunk").to_pylist(), parts, strict=True):
        hi, to = lo + len(mine), at + int(own_arcs.sum())
        rows.append((chunk, key[0].as_py(), "pairs", bundle(c2[pair[lo:hi]], n2[pair[lo:hi]], own[lo:hi], c3[arc[at:to]])))
        lo, at = hi, to
    return pa.Table.from_batches([_packets(rows)])


def _gathered(table: pa.Table, kind: str) -> Iterator[np.ndarray]:
    """The answers of one kind, in the order of requests."""
    rows = zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "held")), strict=True)
    return (np.concatenate(x) for x in zip(*(unbundle(h) for _, h in sorted((s, h) for k, s, h in rows if k == kind)), strict=True))


def _put(order: np.ndarray, x: np.ndarray) -> np.ndarray:
    back = np.empty(len(order), np.float64)
    back[order] = x
    return back


def _word_requests(shards: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """A chunk's words with their training count and the number of histories that the chunk counts as their arcs."""
        chunk = _Chunk(table.column("held")[table.column("kind").to_pylist().index("texts")].as_py(), shards)
        _, _, own, _ = _gathered(table, "pairs")
        times = np.bincount(chunk.words, chunk.train, len(chunk.hashes)).astype(np.int64)
        times[0] = chunk.n_train  # the begin
        follow = np.bincount(chunk.u, _put(chunk.order, own), len(chunk.hashes)).astype(np.int64)
        order, shard = _word_order(chunk.hashes, shards)
        rows = [(key[0].as_py(), s, "words", bundle(*(x[order[lo:hi]] for x in (chunk.hashes, times, follow)))) for s, lo, hi in _runs(shard)]
        return pa.Table.from_batches([_packets(rows)])

    return run


def _word_answers(key: tuple, table: pa.Table) -> pa.Table:
    """Each chunk's words with count and number of arcs; and the shard's sum of counts and number of training words."""
    parts = [unbundle(x.as_py()) for x in table.column("held")]
    hashes, times, follow = (np.concatenate(x) for x in zip(*parts, strict=True))
    words, at = np.unique(hashes, return_inverse=True)
    c1, n1 = (np.bincount(at, x, len(words)).astype(np.int64) for x in (times, follow))
    rows, lo = [], 0
    for chunk, (own, _, _) in zip(table.column("chunk").to_pylist(), parts, strict=True):
        mine = at[lo : lo + len(own)]
        rows.append((chunk, key[0].as_py(), "words", bundle(c1[mine], n1[mine])))
        lo += len(own)
    real = words != np.uint64(xxhash.xxh3_64_intdigest(_MARKS[0]))
    rows.append((None, key[0].as_py(), "sums", bundle(np.array([c1[real].sum(), (c1[real] > 0).sum()], np.int64))))
    return pa.Table.from_batches([_packets(rows)])


class Automaton:
    """A weighted backoff automaton over words 0..n-1: state 0 is the empty history, 1 + v the history v, 1 + n + k the k-th pair.

    `keys` are the arcs as state * n + word, rising; the empty history has an arc for every word, at `root`. Weights are
    log10. An arc's end is the longest history that training knows.
    """

    def __init__(self, n: int, root: np.ndarray, keys: np.ndarray, weights: np.ndarray, ends: np.ndarray, failure: np.ndarray, back: np.ndarray):
        self.n, self.root, self.keys, self.weights, self.ends, self.failure, self.back = n, root, keys, weights, ends, failure, back
        self.failures = 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each lane's log weight of its word, failure arcs included, and its next state."""
        add, nxt = np.empty(len(state)), np.empty(len(state), np.int32)
        left, gone = np.arange(len(state)), np.zeros(len(state))
        while len(left):
            empty = state == 0
            if empty.any():
                at = left[empty]
                add[at], nxt[at] = gone[empty] + self.root[word[empty]], 1 + word[empty]
                left, state, word, gone = left[~empty], state[~empty], word[~empty], gone[~empty]
            if not len(left) or not len(self.keys):
                if not len(left):
                    break
                hit = np.zeros(len(left), np.bool_)
            else:
                key = state.astype(np.int64) * self.n + word
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[arc] == key
                at = left[hit]
                add[at], nxt[at] = gone[hit] + self.weights[arc[hit]], self.ends[arc[hit]]
            miss = ~hit
            self.failures += int(miss.sum())
            left, word, gone, state = left[miss], word[miss], gone[miss] + self.failure[state[miss]], self.back[state[miss]]
        return add, nxt

    def traverse(self, words: np.ndarray, first: np.ndarray, lens: np.ndarray, begin: int) -> np.ndarray:
        """Each text's sum of log weights; a text begins in the state of `begin`, a later lane in that of the two words before it."""
        lanes = -(-lens // LANE)
        text = np.repeat(np.arange(len(lens)), lanes)
        skip = (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        lead = np.minimum(skip, 2)
        at, size = first[text] + skip - lead, np.minimum(LANE, lens[text] - skip) + lead
        order = np.argsort(-size, kind="stable")
        at, size, lead, text = at[order], size[order], lead[order], text[order]
        state = np.where(skip[order] == lead, 1 + begin, 0).astype(np.int32)
        total = np.zeros(len(text))
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
        for j, k in enumerate(active.tolist()):
            add, state[:k] = self.step(state[:k], words[at[:k] + j])
            total[:k] += np.where(lead[:k] <= j, add, 0.0)
        return np.bincount(text, total, len(lens))


def _automaton(chunk: _Chunk, below: int, c1, n1, c2, n2, c3) -> Automaton:
    """The chunk's part of the automaton, from the counts that the shards answered with."""
    n = len(chunk.hashes)
    # an arc's probability, interpolated with the shorter history's; what discounting leaves over is the failure arc's
    step = lambda c, of, arcs, lower: (np.maximum(c - DISCOUNT, 0) + DISCOUNT * arcs * lower) / np.maximum(of, 1)
    p1 = (c1 + 1) / below
    p2 = np.where(c1[chunk.u] > 0, step(c2, c1[chunk.u], n1[chunk.u], p1[chunk.v]), p1[chunk.v])
    two = np.flatnonzero(c2 > 0)
    keys2 = (1 + chunk.u[two]) * n + chunk.v[two]
    three = np.flatnonzero(c3 > 0)
    history, w = chunk.history[three], chunk.w[three]
    after = chunk.v[history] * n + w
    pairs = chunk.u * n + chunk.v
    shorter = np.minimum(np.searchsorted(pairs, after), len(pairs) - 1)  # behind an end there is no pair, and no text goes on
    p3 = step(c3[three], c2[history], n2[history], p2[shorter])
    keys3 = (1 + n + history) * n + w
    weigh = lambda of, arcs: np.log10(np.where((of > 0) & (arcs > 0), DISCOUNT * arcs / np.maximum(of, 1), 1.0))
    failure = np.concatenate([[0.0], weigh(c1, n1), weigh(c2, n2)])
    back = np.concatenate([np.zeros(1 + n, np.int32), (1 + chunk.v).astype(np.int32)])
    ends = np.concatenate([1 + n + two, 1 + n + shorter]).astype(np.int32)
    return Automaton(n, np.log10(p1), np.concatenate([keys2, keys3]), np.log10(np.concatenate([p2[two], p3])), ends, failure, back)


def _scores(shards: int, total: int, distinct: int, out: pa.Schema):
    below = total + distinct + 1

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = table.column("kind").to_pylist().index("texts")
        chunk, ids = _Chunk(table.column("held")[at].as_py(), shards), table.column("ids")[at].as_py()
        c2, n2, _, c3 = _gathered(table, "pairs")
        c2, n2, c3 = _put(chunk.order, c2), _put(chunk.order, n2), _put(chunk.arc_order, c3)
        order, _ = _word_order(chunk.hashes, shards)
        c1, n1 = (_put(order, x) for x in _gathered(table, "words"))
        del table, chunk.pair, chunk.triple, chunk.train
        own = _automaton(chunk, below, c1, n1, c2, n2, c3)
        score = own.traverse(chunk.words, chunk.first, chunk.lens, 0)
        add = lambda x: np.add.reduceat(x, chunk.first)
        base, known = add(own.root[chunk.words]), add((c1 > 0)[chunk.words].astype(np.int64))
        return pa.Table.from_batches([table_batch(out, [ids, [held_out(d) for d in ids], chunk.lens, known, np.full(len(ids), total), base, score])])

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text, trained on the texts that aren't held out."""
    spark = prepare(docs.sparkSession)
    docs = whole(docs, id_col, text_col)
    id_type, ddl_id = (pa.string(), "string") if docs.schema[id_col].dataType.simpleString() == "string" else (pa.int64(), "long")
    chunks = written(mapped(docs, _chunks(id_type, CHUNK), f"chunk long, ids array<{ddl_id}>, held binary"), "chunks")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() // CHUNKS_A_SHARD))
    packets = mapped(chunks.select("chunk", "held"), _pair_requests(shards), PACKET_DDL)
    pairs = written(packets.groupBy("shard").applyInArrow(_pair_answers, PACKET_DDL), "pair_answers")
    rows = chunks.select("chunk", F.lit(None).cast("long").alias("shard"), F.lit("texts").alias("kind"), "held", "ids").unionByName(pairs, allowMissingColumns=True)
    asked = rows.groupBy("chunk").applyInArrow(_word_requests(shards), PACKET_DDL)
    words = written(asked.groupBy("shard").applyInArrow(_word_answers, PACKET_DDL), "word_answers")
    sums = [unbundle(bytes(r[0]))[0] for r in words.where("kind = 'sums'").select("held").toLocalIterator()]
    total, distinct = (int(sum(x[k] for x in sums)) for k in (0, 1))
    rows = rows.unionByName(words.where("kind = 'words'"), allowMissingColumns=True)
    out = pa.schema([(id_col, id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    ddl = f"`{id_col}` {ddl_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").applyInArrow(_scores(shards, total, distinct, out), ddl)
