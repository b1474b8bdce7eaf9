"""Secret scans by one combined deterministic automaton.

All rules are compiled, by subset construction and minimisation, into one transition array that runs over the UTF-8
bytes of a text once and tells at each byte which rules have a match that ends there. A small reversed automaton of
the rule then gives the match's leftmost start, a small anchored one its longest end. Matches of a kind don't overlap.

Null or empty text: no spans. Repeated rows come out as often as they come in; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.automata import Dfa
from lodestone.llm.common import mapped, table_batch, texts, whole

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind -> (pattern, least length), in the order in which kinds are listed; shorter matches are dropped. The first
#: three are the base rules. Runs of hex digits have their least length in the pattern, as they need no prefix and
#: every word would match; a maximal run is the same match either way.
RULES = {
    "assign": (ASSIGN, 0),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    "git_token": (r"gh[pousr]_[A-Za-z0-9]+", 36),
    "chat_token": (r"xox[abprs]-[A-Za-z0-9-]+", 20),
}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


class Scanner:
    """The combined automaton and, for each rule, the two small ones."""

    def __init__(self, rules: dict[str, tuple[str, int]] = RULES):
        self.kinds = list(rules)
        self.least = [n for _, n in rules.values()]
        patterns = [p for p, _ in rules.values()]
        self.automata = [Dfa(patterns, anchored=False)], [Dfa([p], anchored=True, backwards=True) for p in patterns], [Dfa([p], anchored=True) for p in patterns]
        self.rows = None

    def link(self) -> Scanner:
        """The transition arrays travel as they are; a process links their rows once."""
        if self.rows is None:
            (whole_,), *sides = self.automata
            self.rows, self.sides = whole_.linked(), [[(d.linked(), d.dead) for d in side] for side in sides]
        return self

    def hits(self, data: bytes) -> list[tuple[int, int]]:
        """(end, rules' bits) of every byte at which a match ends."""
        row, found = self.rows[0], []
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                found.append((i + 1, row[256]))
        return found

    @staticmethod
    def _far(side: tuple, data: memoryview) -> int:
        """Bytes of the longest prefix that the automaton accepts, or -1."""
        rows, dead = side
        row, best = rows[0], -1
        stop = rows[dead] if dead is not None else None
        for i, b in enumerate(data):
            row = row[b]
            if row is stop:
                break
            if row[256]:
                best = i + 1
        return best

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, kind number, end) in bytes, by start and then kind."""
        found, last, view = [], [0] * len(self.kinds), memoryview(data)  # slices of a view copy nothing
        for end, bits in self.hits(data):
            for k in range(len(self.kinds)):
                if bits >> k & 1 and end > last[k]:
                    back = self._far(self.sides[0][k], view[last[k] : end][::-1])
                    if back < 0:
                        continue
                    start = end - back
                    last[k] = start + self._far(self.sides[1][k], view[start:])
                    if last[k] - start >= self.least[k]:
                        found.append((start, k, last[k]))
        return sorted(found)


def scan(docs: DataFrame, rules: dict[str, tuple[str, int]] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and `spans`, an array of (kind, start, end): code points, end exclusive, by start and then kind as listed.

    Null and empty texts have no spans; texts of any length are scanned whole. Matches of several kinds may overlap, those
    of one kind don't: the leftmost is taken. Repeated rows come out alike; an empty table gives no rows. Only the two
    columns are read, so other names don't matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # a few MB: its size depends on the rules alone
    ddl_id = docs.schema[id_col].dataType.simpleString()
    value = re.compile(ASSIGN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value.link()
        for batch in batches:
            out = []
            for data in texts(batch, 1):
                spans = []
                for start, k, end in own.spans(data):
                    kind = own.kinds[k]
                    if kind == "assign" and len(value.fullmatch(data[start:end].decode("ascii"))[2]) < LEAST_VALUE:
                        continue
                    spans.append((start, kind, end))
                if spans and not data.isascii():
                    at = {x: 0 for s in spans for x in (s[0], s[2])}
                    done = n = 0
                    for x in sorted(at):
                        n += len(data[done:x].decode("utf-8", "replace"))
                        at[x], done = n, x
                    spans = [(at[s], kind, at[e]) for s, kind, e in spans]
                out.append([{"kind": kind, "start": s, "end": e} for s, kind, e in spans])
            yield table_batch(pa.schema([(id_col, batch.column(0).type), ("spans", pa.list_(SPAN))]), [batch.column(0), out])

    return mapped(whole(docs, id_col, text_col), run, f"`{id_col}` {ddl_id}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
