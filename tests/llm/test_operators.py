"""Every operator against a brute-force version on a small fixture: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import automata, decontam, jaccard, linededup, lm, packing, pii, quality, secrets, tokens, urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SYLLABLES = "an er the on re ti lo ka mu ße éa ño".split()
#: Columns whose names clash with those that operators add.
EXTRA = ", n_words long, score double, sig long, spans string"


def made(seed: int = 3, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3)))
    line = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    shared = [line(12) for _ in range(4)]
    rows = []
    for i in range(n):
        body = [line(rnd.randint(1, 16)) for _ in range(rnd.randint(1, 8))]
        if rnd.random() < 0.5:
            body.insert(rnd.randint(0, len(body)), rnd.choice(shared))
        rows.append((i, "\n".join(body), rnd.choice(["en", "fr", None, "xx"])))
    for i in range(n, n + 12):  # exact and near copies
        text = rows[i - n][1]
        if i % 2:
            w = text.split(" ")
            w[len(w) // 2] = "CHANGED"
            text = " ".join(w)
        rows.append((i, text, "en"))
    special = [None, "", " \t\n ", "one", "A b c d", "<|endoftext|> It's 12 Times\x0bx\x1cy ﬁ Ǆ ΑΣ", "word " * 6000, "x" * 5000, rows[0][1]]
    return rows + [(n + 20 + k, t, "en") for k, t in enumerate(special)] + [rows[0]]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, 7, "s") for r in rows], "doc_id long, text string, lang string" + EXTRA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_token_counts(docs, rows, empty):
    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in rows)
    assert Counter(map(tuple, tokens.count_tokens(docs, TOKENIZER).collect())) == want
    assert tokens.count_tokens(empty, TOKENIZER).collect() == []
    whole = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(whole)
    got = {r[0]: r[2] for r in tokens.count_tokens(docs, whole).collect()}
    assert got == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows}


def test_packing(docs, rows, empty):
    tok = Tokenizer.from_file(TOKENIZER)
    size = 256
    got = packing.pack(docs, TOKENIZER, size=size).collect()
    want = Counter(struct.pack(f"<{len(ids) + 1}I", *ids, 2) for ids in (tok.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows))
    texts = defaultdict(list)
    windows = defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        texts[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    twice = rows[0][0]
    built = Counter(b"".join(x.ids for x in sorted(own, key=lambda x: x.start)) for doc, own in texts.items() if doc != twice)
    assert built == want - Counter({k: v for k, v in want.items() if v and k not in built}) - (want - built) and sum(built.values()) == len({r[0] for r in rows}) - 1
    total = pad = 0
    for own in windows.values():
        own.sort(key=lambda x: x.offset)
        at = 0
        for x in own:
            assert x.offset == at
            at += x.length
        assert at <= size
        total += at
        pad += 0 if at & (at - 1) == 0 else size - at
    assert total == sum(len(k) // 4 * v for k, v in want.items()) and pad <= 0.04 * total
    assert packing.pack(empty, TOKENIZER).collect() == []


def test_automata_match_regexes():
    rnd = random.Random(5)
    patterns = [r"ab+c?", r"(?i:key|pin)=[0-9]+", r"[0-9a-f]{5,}", r"x(y|zz){2,3}"]
    both = automata.Dfa(patterns, anchored=False)
    rows_ = both.linked()
    for _ in range(400):
        s = "".join(rnd.choice(["ab", "b", "c", "KEY", "pin", "=", "7", "xyzz", "zz", "y", "ff", "-"]) for _ in range(rnd.randint(1, 12)))
        row, ends = rows_[0], set()
        for i, b in enumerate(s.encode()):
            row = row[b]
            ends |= {(i + 1, k) for k in range(len(patterns)) if row[256] >> k & 1}
        want = {(e, k) for k, p in enumerate(patterns) for b in range(len(s)) for e in range(b + 1, len(s) + 1) if re.fullmatch(p, s[b:e])}
        assert ends == want
    assert len(automata.Dfa(["a", "a"], anchored=True).next) == 3  # start, accepted, dead


def test_secret_scan(spark):
    rnd = random.Random(9)
    pieces = ["token", "secret", "api_key", "PassWord", "=", ":", " ", '"', "abc", "abcdefg", "AKIA", "ABCDEFGHIJ0123456", "0123456789abcdef", "deadbeef", "é", "\n", "ghp_" + "a" * 36]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14))) for _ in range(400)] + [None, "", "token=é", "token='" + "a" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = (("assign", re.compile(secrets.ASSIGN), lambda m: len(m[2]) >= 6), ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24))
    for r in secrets.digest(secrets.scan(df)).collect():
        t = texts[r.doc_id] or ""
        found = sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, ok) in enumerate(kinds) for m in p.finditer(t) if ok(m))
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x[1] for x in found) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(x[2] for x in found).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in secrets.BASE] == [x[2] for x in found]
    assert secrets.scan(df.limit(0)).collect() == []


def brute_sets(rows):
    out = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(LOW))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_components(sets):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("long", [8192, 2])
def test_jaccard_join(docs, rows, empty, long, monkeypatch):
    for name, value in (("LONG", long), ("DEAL", 2), ("BLOCK", 2)):  # 2: lists and meetings are dealt out in parts
        monkeypatch.setattr(jaccard, name, value if long == 2 or name == "LONG" else getattr(jaccard, name))
    sets = brute_sets(rows)
    want = brute_components(sets)
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    if long > 2:
        assert jaccard.join(empty).collect() == []
        nameless = docs.selectExpr("if(doc_id < 3, null, doc_id) AS doc_id", "text", "1 AS n", "2 AS sig")
        got = jaccard.join(nameless).collect()
        assert len(got) == len(rows) and {(r.class_id, r.component_id, r.n_links) for r in got if r.doc_id is None} == {(None, None, 0)}
        with pytest.raises(TypeError):
            jaccard.join(docs.selectExpr("cast(doc_id AS string) AS doc_id", "text"))


@pytest.mark.parametrize("long", [8192, 4])
def test_jaccard_counts_every_link(spark, long, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "DEAL", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 512 if long > 4 else 8)
    rnd = random.Random(4)
    rows = []
    for group in range(3):  # near copies, some so far from the rest that only a part of the group's pairs link
        body = [f"w{group}x{k}" for k in range(80)]
        for _ in range(14):
            cut = rnd.randint(0, 14)
            rows.append((len(rows), " ".join(body[: len(body) - cut] if rnd.random() < 0.5 else body[cut:])))
    body = [f"v{k}" for k in range(90)]
    for _ in range(150):  # lists of more than one block
        own = list(body)
        for _ in range(rnd.randint(1, 4)):
            own[rnd.randrange(90)] = f"u{rnd.randrange(40)}"
        rows.append((len(rows), " ".join(own)))
    sets = brute_sets([(i, t, None) for i, t in rows])
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    reps = sorted(first.values())
    want = {a: sum(a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for b in reps) for a in reps}
    assert len(set(want.values())) > 20
    for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r.class_id, r.n_links) == (first[frozenset(sets[r.doc_id])], want[r.class_id])


def test_line_dedup(docs, rows, empty):
    low = [(i, k, tuple(WORD.findall(x.lower()))) for i, t in sorted({(i, t or "") for i, t, _ in rows}) for k, x in enumerate(t.split("\n"))]
    good = [x for x in low if len(x[2]) >= 5]

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 7 or max(len(a), len(b)) < 8 or len(a) < 8 or len(b) < 8 or abs(len(a) - len(b)) > 1:
            return False
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p + 1 :] == b[p:] if len(a) > len(b) else a[p:] == b[p + 1 :]

    drop = {(i, k) for n, (i, k, w) in enumerate(good) if any(near(v, w) for _, _, v in good[:n])}
    assert any(near(v, w) and v != w for n, (_, _, w) in enumerate(good) for _, _, v in good[:n])
    out = linededup.dedup(docs)
    assert set(docs.columns) < set(out.columns)
    texts = {i: t for i, t, _ in rows}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id]
        want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (r.doc_id, k) not in drop)
        assert r.text == want
    assert linededup.dedup(empty).collect() == []


def test_quality(docs, rows, empty):
    out = quality.judge(docs)
    assert set(docs.columns) < set(out.columns)
    texts = {i: t or "" for i, t, _ in rows}
    got = quality.digest(out).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        again = {j for v in at.values() if len(v) > 1 for k in v for j in (k, k + 1, k + 2)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty).collect() == []


def test_repeated_words_by_either_way(spark):
    texts = [" ".join(f"w{k % 150}" for k in range(1000)), "a b c a b c d e f", "a a a a", "a b", "a b c a b c " * 200]
    df = quality.with_words(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, t string"), "t", "w")
    for r in quality._repeated(df, "w", "r").collect():
        w = texts[r.i].split()
        at = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert r.r == len({j for k in range(len(w) - 2) if at[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)})


def test_js_distance_rejects_what_is_unlike_its_language(spark):
    rnd = random.Random(2)
    plain = [" ".join(rnd.choice("the of and to in is was house river stone".split()) for _ in range(80)) for _ in range(40)]
    odd = [re.sub(r"(\w+)", r"\1$$$", plain[0]), "qzx" + " qzx blorp".join(str(k) for k in range(70))]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(plain + odd)], "doc_id long, text string, lang string")
    kept = {r.doc_id: (r.quality.base_failed, r.quality.kept) for r in quality.judge(df).collect()}
    assert sum(k for f, k in kept.values() if not f) == sum(1 for i, (f, _) in kept.items() if not f and i < 40)
    assert not kept[40][1] and not kept[41][1]


def test_decontamination(spark, rows):
    rnd = random.Random(4)
    items = [" ".join(WORD.findall(r[1])[:30]) for r in rows[:20]] + ["short item here", "", None, "!!!"]
    docs = [(k, t) for k, t in enumerate([r[1] for r in rows] + ["x y " + items[3] + " z", "SHORT, Item--here again", items[0].split(" ")[0]])]
    rnd.shuffle(docs)
    bench = spark.createDataFrame([(100 + k, t) for k, t in enumerate(items)], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for k, t in enumerate(items):
        w = word.findall((t or "").translate(LOW))
        for j in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[j : j + 13])].add(100 + k)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    texts = dict(docs)
    for r in decontam.digest(decontam.find(df, bench)).collect():
        w = word.findall((texts[r.doc_id] or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit) and 20 * len(hit) >= len(w))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    spans = {r.doc_id: r.hits.spans for r in decontam.find(df, bench).collect()}
    last = len(rows) + 1
    assert [texts[last][s.start : s.end] for s in spans[last]] == ["SHORT, Item--here"]
    assert decontam.find(df.limit(0), bench).collect() == []
    assert all(r.n_hit == 0 for r in decontam.digest(decontam.find(df, bench.limit(0))).collect())


def test_decontamination_in_small_shards_and_blocks(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(k, rows[k][1]) for k in range(10)], "item_id long, text string")
    whole = {r.doc_id: tuple(r) for r in decontam.digest(decontam.find(df, bench)).collect()}
    monkeypatch.setattr(decontam, "SHARD_WORDS", 1)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 20)
    assert {r.doc_id: tuple(r) for r in decontam.digest(decontam.find(df, bench)).collect()} == whole


def test_lm_scores(docs, rows, empty):
    words = {i: [*(t or "").encode().lower().split(), lm.END] for i, t, _ in rows}
    train = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in words[i])
    total, distinct = sum(c.values()), len(c)
    got = lm.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), total, r.doc_id not in train)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert lm.score(empty).collect() == []


@pytest.mark.parametrize("chunk", [lm.CHUNK, 300])
def test_lm_scores_use_every_n_gram(docs, rows, chunk, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", chunk)  # 300: many chunks share their counts
    words = {i: [None, *(t or "").encode().lower().split(), lm.END] for i, t, _ in rows}
    grams = [Counter(), Counter(), Counter()]
    for i, _, _ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for n, c in enumerate(grams):
                c.update(tuple(words[i][k : k + n + 1]) for k in range(len(words[i]) - n))
    own = Counter({g: c for g, c in grams[0].items() if g[0] is not None})
    below = sum(own.values()) + len(own) + 1
    arcs = [Counter(g[:-1] for g in c) for c in grams]

    def p(gram):
        n = len(gram) - 1
        if not n:
            return (own[gram] + 1) / below
        of = grams[n - 1][gram[:-1]]
        return (max(grams[n][gram] - lm.DISCOUNT, 0) + lm.DISCOUNT * arcs[n][gram[:-1]] * p(gram[1:])) / of if of else p(gram[1:])

    for r in lm.score(docs).collect():
        w = words[r.doc_id]
        want = sum(math.log10(p(tuple(w[max(0, k - 2) : k + 1]))) for k in range(1, len(w)))
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_automaton_takes_failure_arcs():
    """Words 0 (begin), 1 and 2; pairs (0, 1) and (1, 2), the triple (0, 1, 2): failure arcs are taken one by one, and only where an arc lacks."""
    n = 3
    own = lm.Automaton(n, np.log10([0.2, 0.3, 0.5]), np.array([(1 + 0) * n + 1, (1 + 1) * n + 2, (1 + n + 0) * n + 2]), np.log10([0.6, 0.7, 0.8]), np.array([1 + n, 2 + n, 2 + n], np.int32), np.log10([1.0, 0.1, 0.2, 1.0, 0.4, 0.9]), np.array([0, 0, 0, 0, 2, 3], np.int32))
    score = own.traverse(np.array([1, 2, 1]), np.array([0]), np.array([3]), 0)
    # 1 by the pair's arc, 2 by the triple's, then from (1, 2) by its failure arc to 2 and by that one's to the empty history
    assert math.isclose(score[0], math.log10(0.6 * 0.8 * (0.9 * 1.0 * 0.3))) and own.failures == 2
    own.failures = 0
    score = own.traverse(np.array([2, 2]), np.array([0, 1]), np.array([1, 1]), 0)
    assert np.allclose(score, math.log10(0.1 * 0.5)) and own.failures == 2


def test_long_texts_are_read_in_lanes(monkeypatch):
    rng = np.random.default_rng(1)
    n, words = 4, np.random.default_rng(2).integers(1, 4, 1000)
    pairs = [(u, v) for u in range(n) for v in range(1, n) if (u + v) % 3]
    keys = [(1 + u) * n + v for u, v in pairs] + [(1 + n + k) * n + w for k, _ in enumerate(pairs) for w in range(1, n) if (k + w) % 2]
    ends = [1 + n + k for k in range(len(pairs))] + [1 + n + pairs.index((pairs[k][1], w)) if (pairs[k][1], w) in pairs else 1 + w for k, _ in enumerate(pairs) for w in range(1, n) if (k + w) % 2]
    make = lambda: lm.Automaton(n, root, np.array(keys), weights, np.array(ends, np.int32), failure, np.array([0] * (1 + n) + [1 + v for _, v in pairs], np.int32))
    root, weights, failure = -rng.random(n), -rng.random(len(keys)), -rng.random(1 + n + len(pairs))
    first, lens = np.array([0, 700, 701]), np.array([700, 1, 299])
    want = make().traverse(words, first, lens, 0)
    for lane in (1, 2, 7, 1000):
        monkeypatch.setattr(lm, "LANE", lane)
        assert np.allclose(make().traverse(words, first, lens, 0), want)


def test_url_filter(spark):
    page = lambda *links: "".join(f'<a class="x" href="{x}">l</a>' for x in links)
    data = [
        (1, "http://EXAMPLE.com/en/7?x", page("http://far.io/a")), (2, "http://a.example.com/en/70", None), (3, "http://x.com/en/1", page("http://victim.io/z", "/rel")),
        (4, "http://example.net/de/8", ""), (5, "http://net/de/", ""), (6, "x", ""), (7, None, ""), (8, "http://notexample.net/de/81#q", ""), (9, "http://spam.io/x", page("http://x.com/en/1")), (10, "http://far.io", ""), (10, "http://far.io", ""),
        (11, "http://h://p/q?r", ""),
    ]
    got = defaultdict(list)
    for r in urls.judge(spark.createDataFrame(data, "page_id long, url string, html string")).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert got[1] == [("example.com", "/en/7", "example.com/en/7", "allow")]
    assert got[2] == [("a.example.com", "/en/70", "example.com/en/7", "allow")]
    assert got[3] == [("x.com", "/en/1", "com/en/", "block")]
    assert got[4] == [("example.net", "/de/8", "example.net/de/8", "block")]
    assert got[5] == [("net", "/de/", "net/de/", "allow")]
    assert got[6] == [("", "", None, "allow")] == got[7]
    assert got[8] == [("notexample.net", "/de/81", "net/de/", "allow")]
    assert got[9] == [("spam.io", "/x", None, "block")]  # links to a blocked host
    assert got[10] == [("far.io", "", None, "allow")] * 2
    assert got[11] == [("h:", "//p/q", None, "allow")]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_url_ranks_reach_far_hosts(spark):
    edges = spark.createDataFrame([(f"h{k}", f"h{k + 1}", 1) for k in range(24)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("h24", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: r.distrust for r in urls.propagate(seeds, edges).collect()}
    assert all(math.isclose(got[f"h{k}"], 0.15 * 0.85 ** (24 - k), rel_tol=1e-6) for k in range(25))


def test_pii_surrogates(spark):
    text = "Call Mr. John Smith or Mrs. Anna Smith; Mr. Smith said 4532015112830366, a.b@x.com, A.B@x.com and c@x.com, +1 (017) 555-7713, 97.51.17.173. SSN 123-45-6789 DE89 3704 0044 0532 0130 00"
    many = " ".join(f"Mr. Name{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60))
    data = [(1, text, "k"), (2, None, ""), (3, "", ""), (4, "nothing here, 12 or 1.5", ""), (5, "Mr. Иван Петров met Frau Müller and Mr. Иван Петров.", ""), (6, many, ""), (1, text, "k")]
    out = pii.replace(spark.createDataFrame(data, "doc_id long, text string, entities string"), "key").collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(data) and got[2].text is None and got[3].text == "" and got[4].text == data[3][1]
    new = got[1].text
    for old in ("John", "Anna", "Smith", "4532015112830366", "a.b@x.com", "c@x.com", "555-7713", "97.51.17.173", "123-45-6789", "3704"):
        assert old not in new
    s = [e.surrogate for e in got[1].entities]
    assert s[0].split(" ")[2] == s[1].split(" ")[2] == s[2].split(" ")[1]  # one family
    assert s[0].split(" ")[1].endswith(tuple(pii.END["m", "latin"])) and s[1].split(" ")[1].endswith(tuple(pii.END["f", "latin"]))
    assert s[4] == s[5] != s[6]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", s[7]) and re.fullmatch(r"10(\.\d{1,3}){3}", s[8])
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", s[9]) and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", s[10])
    digits = [int(c) for c in s[3]]
    assert sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    names = got[5].text.split(" ")
    assert re.fullmatch(r"[\u0400-\u04ff]+", names[1]) and names[1:3] == [x.strip(".") for x in names[-2:]]
    people = [e.surrogate for e in got[6].entities]
    assert len(set(people)) == 60 and all(re.fullmatch(r"Mr\. [A-Z][a-z]+", x) for x in people)
    assert len({r.text for r in out if r.doc_id == 1}) == 1


def test_lookup_equals_the_library_on_every_kind_of_letter():
    """Letters whose lower case isn't letters alone (such as U+0130), other scripts, marks, controls and added tokens, beside ASCII marks."""
    table, tok = tokens.lookup(TOKENIZER, "n"), Tokenizer.from_file(TOKENIZER)
    codes = [*range(0x21, 0x250), *range(0x250, 0x11000, 37), 0x130, 0x301, 0x307, 0x212A, 0x3A3]
    odd = [c for c in map(chr, codes) if not 0xD800 <= ord(c) < 0xE000]
    data = [f"a{c}{m}b ({c}{m}" for c in odd for m in ("", ".", "'s", ")")] + ["It's DON'T o'clock ''s \"'s", "x y\x85z\x1c\x0b\x0cq", "<|endoftext|>a B<|startoftext|>.", "<|EndOfText|>", "(İ)", "İİ!"]
    for i in range(0, len(data), 256):
        assert table.counts([x.encode() for x in data[i : i + 256]]) == [len(e.ids) for e in tok.encode_batch(data[i : i + 256], add_special_tokens=False)]


def test_lookup_keeps_bounds():
    table, tok = tokens.Lookup(TOKENIZER, bound=400), Tokenizer.from_file(TOKENIZER)
    rnd = random.Random(5)
    for _ in range(20):
        data = [" ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(40)) + " '" + "z" * rnd.randint(1, 900) for _ in range(3)] + ["", "'", "s's't'", "12's"]
        want = [tok.encode(x, add_special_tokens=False).ids for x in data]
        assert table.counts([x.encode() for x in data]) == list(map(len, want))
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in table.ids([x.encode() for x in data])] == want
        assert table.n <= 400 and len(table.pool) <= 8000


def brute_surrogates(text: str, key: str) -> str:
    """Emails, addresses, numbers and titled names, with the names' later mentions, one candidate after the other."""
    import hmac

    def candidate(kind, value, b):
        h = hmac.new(key.encode(), f"{kind}\x1f{value}\x1f{b}".encode(), "sha256").hexdigest()
        number = lambda at: int(h[at - 1 : at + 6], 16)
        digits, letters = h.translate(str.maketrans("abcdef", "271828")), h.translate(str.maketrans("0123456789", "ghijklmnop"))
        if kind == "email":
            return f"{letters[: max(8, min(24, value.index('@')))]}@mail{digits[49:51]}.example.org"
        if kind == "ip":
            return ".".join(["10", *(str(number(k) % 256) for k in (1, 8, 15))])
        if kind == "ssn":
            return digits[: len(value)]
        role, script = kind.split("-")
        pick = lambda at, words: words[number(at) % len(words)]
        extra = "" if number(50) % 2 == 0 else pick(43, pii.MIDDLE[script])
        return pick(1, pii.BEGIN[script]) + pick(8, pii.MIDDLE[script]) + extra + pick(22, pii.END[role, script])

    titles = {"Mr": "m", "Mrs": "f", "Dr": "n"}
    name = r"(Mrs|Mr|Dr)\. ([A-ZА-Я][a-zа-я]+)(?: ([A-ZА-Я][a-zа-я]+))?"
    pattern = rf"(?P<email>[\w.]+@[\w.-]+\.\w+)|(?P<ip>\d+\.\d+\.\d+\.\d+)|(?P<ssn>\d{{3}}-\d\d-\d{{4}})|(?P<person>{name})"
    script = lambda w: "cyrillic" if re.search("[А-я]", w) else "latin"

    def units(m):
        if m["person"]:
            words = [x for x in re.fullmatch(name, m["person"]).groups()[1:] if x]
            role = titles[m["person"].split(".")[0]]
            return [(f"{role if k < len(words) - 1 else 'last'}-{script(w)}", w) for k, w in enumerate(words)]
        kind = m.lastgroup if m.lastgroup in ("email", "ip", "ssn") else next(k for k in ("email", "ip", "ssn") if m[k])
        return [(kind, m[0].lower() if kind == "email" else m[0].replace("-", "") if kind == "ssn" else m[0])]

    every = sorted({u for m in re.finditer(pattern, text) for u in units(m)})
    taken, held = {v for _, v in every}, {}
    for u in every:
        held[u] = next(s for b in range(pii.TRIES + 1) if (s := candidate(*u, b)) not in taken)
        taken.add(held[u])
    words = sorted({v for k, v in every if "-" in k})
    alone = {w: held[next(u for u in every if u[1] == w)] for w in words}
    if words:
        pattern += "|(?P<bare>(?<![A-Za-zА-я])(?:" + "|".join(words) + ")(?: (?:" + "|".join(words) + "))?(?![A-Za-zА-я]))"

    def new(m):
        if words and m["bare"]:
            return " ".join(alone[w] for w in m["bare"].split(" "))
        own = [held[u] for u in units(m)]
        if m["person"]:
            return m["person"].split(" ")[0] + " " + " ".join(own)
        return f"{own[0][:3]}-{own[0][3:5]}-{own[0][5:]}" if m["ssn"] else own[0]

    return re.sub(pattern, new, text)


def test_pii_against_brute_force(spark):
    texts = [
        "Mr. John Smith met Mrs. Anna Smith. John Smith and Smith left; Smithson stayed. Anna wrote to a.b@x.com.",
        "Dr. Иван Петров, 123-45-6789, saw Mr. Lee at 8.8.8.8 and 8.8.4.4. Петров said Lee knew Иван.",
        "no one here", "Mr. Rose likes rose and Rose.", " ".join(f"Mr. Na{chr(97 + k % 26)}{chr(97 + k // 26)} Kim" for k in range(200)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for key in ("key", "k" * 99):
        got = {r.doc_id: r.text for r in pii.replace(df, key).collect()}
        assert got == {k: brute_surrogates(t, key) for k, t in enumerate(texts)}
    assert pii.replace(df.limit(0), "key").collect() == []


def test_pii_leaves_no_part_of_a_name_and_no_number(spark):
    texts = {
        "Mr. McDonald spoke.": ["McDonald", "Donald"], "Mr. O'Brien and Mr. O’Neill left.": ["Brien", "Neill"], "Frau Müller-Lüdenscheidt kam.": ["Müller", "Lüdenscheidt"], "Mr. John Fitzgerald Kennedy won.": ["John", "Fitzgerald", "Kennedy"],
        "Dr. Ada B. Lovelace wrote.": ["Ada", " B.", "Lovelace"], "Call 020 7946 0958 or 5551234567.": ["7946", "5551234567"], "Host fe80::1 and 2001:db8:0:0:1:2:3:4.": ["fe80", "2001:db8"], "Mr. Smith's hat; Smith's.": ["Smith"],
    }
    stay = ["At 12:30:45 and 10:20, std::vector, a ratio of 1:2:3, 1700000000 s, ids 55512345678 and x5551234567.", "It is May. Will you come in June?"]
    df = spark.createDataFrame(list(enumerate([*texts, *stay, "Mr. May left in May. May you rest."])), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace(df, "k").collect()}
    for k, (text, gone) in enumerate(texts.items()):
        assert not any(g in got[k] for g in gone), (text, got[k])
    assert re.fullmatch(r"Call \d{3} \d{4} \d{4} or \d{10}\.", got[5]) and re.fullmatch(r"Mr\. (\w+)'s hat; \1's\.", got[7])
    assert [got[len(texts) + k] for k in range(2)] == stay
    assert got[len(texts) + 2].endswith(" left in May. May you rest.") and not got[len(texts) + 2].startswith("Mr. May")
    with pytest.raises(ValueError):
        pii.replace(df, "")
