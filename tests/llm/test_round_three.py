"""Encoding, the filter audit and variant grouping against brute-force versions: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import filters, linededup, sentencepieces, variants
from lodestone.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import EXTRA, LOW, made
from tests.oracle import compare

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [" lead", "two  spaces \n\n next ", "▁ marker▁▁x", "tab\tcr\r\nend", "<s></s><unk><0x0A>", "日本語 ไทย 🙂 é \x00 �", "\n", " ", "   \n   ", "x" * 3000 + " y", "a" * 100 + "\n" + "a" * 100, "<|endoftext|>"]
#: Names that the three operators add or use themselves.
CLASH = ", ids string, part string, mask long, word string, n long, digest string, id long"


@pytest.fixture(scope="module")
def rows():
    own = made(5, 40)
    at = max(r[0] for r in own)
    return own + [(at + 1 + k, t, "xx") for k, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, 7, "s", "i", "p", 1, "w", 2, "d", 3) for r in rows], "doc_id long, text string, lang string" + EXTRA + CLASH).repartition(3).cache()


@pytest.mark.parametrize("most", [sentencepieces.TABLE, 16, 0])
def test_encoding(docs, rows, most):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter((i, tuple(ids := library.encode(t or "")), library.decode(ids)) for i, t, _ in rows)
    got = sentencepieces.decode(sentencepieces.encode(docs, MODEL, most=most), MODEL)
    assert Counter((r[0], tuple(r[1]), r[2]) for r in got.collect()) == want
    digest = {r[0]: tuple(r)[1:] for r in sentencepieces.digest(got).collect()}
    for i, ids, text in want:
        assert digest[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab thé▁\n\t 🙂<0xA>日")))
def test_encoding_of_any_text(text):
    own = sentencepieces.model(MODEL)
    ids = np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist()
    assert own.parted and ids == own.processor.encode(text)
    assert own.decode(np.array(ids, np.int64), np.array([len(ids)])) == [own.processor.decode(ids)]


def test_a_full_table_is_learnt_anew(monkeypatch):
    monkeypatch.setattr(sentencepieces, "CACHE", 8)
    own = sentencepieces.Model(MODEL)
    for k in range(40):
        text = f"word{k} of {k % 3} words, again word{k}"
        assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == own.processor.encode(text)
        assert len(own.own) <= 8


def test_decoding_of_odd_ids(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    lists = [[], [1, 264, 2], [0, 264], [228, 264], [3, 4], [28705], [28705, 28705, 264], None]
    got = sentencepieces.decode(spark.createDataFrame([(str(k), x) for k, x in enumerate(lists)], "doc_id string, ids array<int>"), MODEL)
    assert {r[0]: r[2] for r in got.collect()} == {str(k): library.decode(x or []) for k, x in enumerate(lists)}
    assert sentencepieces.digest(got).where("doc_id = '7'").select("n_tokens").first()[0] == 0


def test_no_documents(docs, spark):
    empty = docs.limit(0)
    assert sentencepieces.digest(sentencepieces.decode(sentencepieces.encode(empty, MODEL), MODEL)).collect() == []
    assert filters.audit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    assert variants.group(empty).collect() == []


def audited(rows, labels):
    """The contract's rule, order by order and document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    smallest: dict = {}
    for i, t, _ in rows:
        smallest[t or ""] = min(i, smallest.get(t or "", i))
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        f = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i > smallest[t])
        fails.append((lang or "", {"ABCDE"[k] for k in range(5) if f[k]}, i))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(f, i) for p, f, i in fails if p == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                left = [(f, i) for f, i in own if not f & set(order[:k])]
                gone = [(f, i) for f, i in left if x in f]
                shapley[x] += len(gone)
                out[part, order, k + 1] = [len(left) - len(gone), len(gone), sum(x in f for f, _ in own) - len(gone), sum(f == {x} for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark, docs, rows):
    long = [(900 + k, " ".join(f"w{(7 * j) % (90 + 40 * k)}" for j in range(260)) + tail, "fr") for k, tail in enumerate(["", " #", " A" * 40, "é" * 900 + "A" * 40])]
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(long + [(905, long[1][1], None), (899, long[1][1], "zz")], "doc_id long, text string, lang string")).withColumn("quality", docs.doc_id)
    labels = [(i, i % 2, int(i % 5 == 0)) for i, _, _ in rows if i % 3 == 0] + [(0, 0, 0), (900, 1, None), (902, None, 1), (None, 1, 1)]
    got = filters.audit(more, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    have = {tuple(r[:3]): tuple(r[3:]) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}
    assert have == audited([tuple(r) for r in more.select("doc_id", "text", "lang").collect()], labels)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab\x0b \né日A$ "), max_size=60), max_size=8))
def test_masks_of_any_texts(data):
    at = np.cumsum([0, *(len(t.encode()) for t in data)])
    x = np.frombuffer("".join(data).encode(), np.uint8)
    begin, end, doc = filters.word_spans(x, at)
    assert [x[i:j].tobytes().decode() for i, j in zip(begin, end, strict=True)] == [w for t in data for w in WORD.findall(t)]
    assert filters.distinct_words(x, begin, end, doc, len(data)).tolist() == [len(set(WORD.findall(t))) for t in data]
    assert filters.class_counts(x, at, filters.POINT).tolist() == list(map(len, data))


def test_colliding_hashes_are_verified(monkeypatch):
    monkeypatch.setattr(filters, "span_hashes", lambda x, a, b: np.zeros(len(a), np.uint64))
    x = np.frombuffer(b"one two one twelve-letters twelve-letterx", np.uint8)
    begin, end, doc = filters.word_spans(x, np.array([0, len(x)]))
    assert filters.distinct_words(x, begin, end, doc, 1).tolist() == [4]


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def grouped(rows):
    """The contract's rule over all pairs of words."""
    counts: Counter = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


@pytest.fixture(scope="module")
def spelt():
    rnd = random.Random(8)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(4, 9))) for _ in range(60)] + ["z" * 300, "z" * 300 + "a", "z" * 299 + "b", "×÷×÷×", "ÀBCDE"]
    rows = []
    for i in range(80):
        words = []
        for _ in range(60):
            w = stems[min(int(rnd.expovariate(0.08)), len(stems) - 1)]
            if rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + "c" + w[k:], w[:k] + "d" + w[k + 1 :]])
            words.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((i, " ".join(words), "en"))
    return [*rows, rows[0], (None, rows[1][1], None), (500, None, "en"), (501, "", "en")]


@pytest.mark.parametrize("part", [variants.PART, 5])
def test_variants(spark, spelt, part, monkeypatch):
    monkeypatch.setattr(variants.near_pairs, "__defaults__", (part,))
    docs = spark.createDataFrame([(*r, "w", 1, "f") for r in spelt], "doc_id long, text string, lang string, word string, n long, form string").repartition(3)
    got = [tuple(r) for r in variants.group(docs).collect()]
    want = grouped(spelt)
    assert any(f for _, f, *_ in want) and any(r not in (w, f) for w, f, r, *_ in want), "the fixture has chains of forms"
    assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(st.sampled_from("abc"), max_size=6), max_size=25))
def test_trie_pairs(words):
    words = sorted(words)
    got = [(words[i], words[j]) for i, j in variants.trie_pairs(words)]
    assert len(got) == len(set(map(frozenset, got)))
    assert {frozenset(p) for p in got} == {frozenset(p) for p in itertools.combinations(words, 2) if one_apart(*p)}


def test_registered_queries(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES["op12_filter_audit"](spark, sf), ORACLES["op12_filter_audit"], sf) == ""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = QUERIES["op13_spelling_variants"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    words = defaultdict(int)
    for r in got.collect():
        words[r["word"]] += 1
    counts: Counter = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    assert dict(words) == {w: 1 for w, c in counts.items() if len(w) >= 5 and c >= 3}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = {}
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in QUERIES["op11_sentencepieces"](spark, sf).collect()} == want


def test_line_dedup_words_and_variants_of_odd_lines(spark):
    lines = ["", " ", "a", " A  b\tc ", "a\x0b\x0cb", "\u00a0x y", "One two three four five", "\u0130 \u00c9 z", "x\ry", "a" + " b" * 9 + "  c", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "at long, t string").withColumn("w", linededup.words_of(F.col("t")))
    plain = F.split(F.btrim(F.lower("t"), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+")
    assert df.where(~F.col("w").eqNullSafe(plain)).count() == 0
    # a variant's key is the hash of the words that are left, which another line may have as its own
    words = [f"w{k}" for k in range(9)]
    own = spark.createDataFrame([(0, words, True, True)] + [(k, words[: k - 1] + words[k:], True, True) for k in range(1, 10)], "at long, w array<string>, first boolean, last boolean")
    keys = linededup._variants(own).where("kind <> 's'").collect()
    whole = {r["key"] for r in keys if r["kind"] == "f" and r["at"] > 0}
    assert {r["key"] for r in keys if r["kind"] == "d" and r["at"] == 0} == whole and len(whole) == 9
