from __future__ import annotations

import pytest

from lodestone.operators import segment


@pytest.mark.parametrize("most", [20_000, 0])
def test_quotes_are_found_as_comparing_all_does(spark, monkeypatch, most):
    monkeypatch.setattr(segment, "BROADCAST_QUOTES", most)
    texts = [(1, "The  quick\nbrown fox jumps over it"), (2, "prefixTHE quick brown foxes"), (3, None), (4, ""), (1, "The quick brown fox"), (5, "onlytwo wordsand"), (6, "single-word-quote!")]
    quotes = ["the quick brown fox", "quick brown", "brown  FOX jumps", "short", "a b", "two wordsan", "word-quote", "", None, "the quick brown fox", "fox jumps under it"]
    plain = lambda x: " ".join((x or "").lower().split())
    want = sorted((k, i) for k, q in enumerate(quotes) for i, t in texts if len(plain(q)) >= 8 and plain(q) in plain(t))
    got = segment.grounded_quotes(spark.createDataFrame(list(enumerate(quotes)), "k long, q string"), spark.createDataFrame(texts, "i long, t string"), quote_id="k", quote="q", id_col="i", text_col="t")
    assert sorted((r["k"], r["i"]) for r in got.collect()) == want
