"""Quality rules with distribution divergence, by DataFrame functions alone.

Each text's histogram of character classes and of its language's common words is compared with the language's
reference, the mean histogram of all documents of that language with enough words, by Jensen-Shannon distance (base 2).
A distance counts only for texts of at least MIN_WORDS words. Base rules come first: too few words, or too many words
in repeated 3-word windows.

Null text or text without words: all counts 0, base_failed. A null or unknown language has the shared reference of all
such documents. Repeated rows are judged alike; an empty table gives no rows. Columns of the input other than the
named ones are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written


#: Common words of each language.
COMMON = {
    "en": "the of and to in is was that it on for with",
    "fr": "de la le et les des en un une du est que",
    "de": "der die und in den von zu das mit sich ist ein",
    "es": "de la que el en y los se del las un por",
}
#: For any other language: the leading words of each list.
OTHER = "the of and de la le der die und que el en"
#: Character classes, stripped one after the other; what is left is the last class.
CLASSES = (r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"\p{Nd}+", r"[.,;:!?'\"()-]+")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
MIN_WORDS, MAX_CHARACTER_DISTANCE, MAX_WORD_DISTANCE = 50, 0.28, 0.38


def _names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for columns of our own that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"_q_{name}"
        while name in have:
            name += "_"
        out.append(name)
    return out


def _normal(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """The square root of the Jensen-Shannon divergence in bits; null if either is."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _language(df: DataFrame, lang_col: str) -> Column:
    return F.when(F.col(f"`{lang_col}`").isin(*COMMON), F.col(f"`{lang_col}`")).otherwise("other") if lang_col in df.columns else F.lit("other")


def with_words(df: DataFrame, text_col: str, name: str) -> DataFrame:
    trimmed = f"trim(BOTH '{SPACES}' FROM coalesce(`{text_col}`, ''))"
    return df.withColumn(name, F.expr(trimmed)).withColumn(name, F.when(F.col(name) == "", F.array().cast("array<string>")).otherwise(F.split(name, r"[\x20\x09-\x0D]+")))


def with_histograms(df: DataFrame, text_col: str, lang_col: str, words: str, chars_out: str, words_out: str) -> DataFrame:
    """Add the normalised histograms of character classes and of common words (the rest as the last bin)."""
    at, texts = words_out, [F.coalesce(F.col(f"`{text_col}`"), F.lit(""))]
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"{chars_out}{k}", F.regexp_replace(texts[-1], pattern, ""))
        texts.append(F.col(f"{chars_out}{k}"))
    sizes = [F.length(t) for t in texts]
    df = df.withColumn(chars_out, _normal(F.array(*[(a - b).cast("double") for a, b in zip(sizes, sizes[1:], strict=False)], sizes[-1].cast("double"))))
    lists = F.lit(None)
    for lang, known in COMMON.items():
        lists = F.when(_language(df, lang_col) == lang, F.array(*map(F.lit, known.split()))).otherwise(lists)
    lists = F.coalesce(lists, F.array(*map(F.lit, OTHER.split())))
    df = df.withColumn(at, F.concat(F.lit(" "), ascii_lower_join(F.col(words)), F.lit(" ")))
    n = F.octet_length(F.col(at))
    found = F.transform(lists, lambda w: (n - F.octet_length(F.replace(F.col(at), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2))
    df = df.withColumn(at, found)
    rest = F.size(words) - F.aggregate(F.col(at), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(at, _normal(F.concat(F.col(at), F.array(rest))))


def ascii_lower_join(words: Column) -> Column:
    """The words between two spaces each, so that every word can be found with a space at either end."""
    return F.lower(F.array_join(words, "  "))


def references(features: DataFrame, feature: str) -> DataFrame:
    """The mean histograms of each language, of documents with at least MIN_WORDS words: five rows at most."""
    own = features.select(F.col(f"`{feature}`").alias("f")).select("f.*").where(F.col("n_words") >= MIN_WORDS)
    means = [F.array(*[F.avg(F.col(col)[i]) for i in range(n)]).alias(name) for col, n, name in (("chars", len(CLASSES) + 1, "ref_chars"), ("common", 13, "ref_words"))]
    return own.groupBy(F.col("lang").alias("ref_lang")).agg(*means)


def _repeated(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add how many words are in 3-word windows that are found twice or more in the text.

    Windows are compared by 64-bit hashes. Those found twice are looked up in a list where it is short, else hashes
    are sorted with their positions; both ways give the same positions.
    """
    w = F.col(words)
    hashes = F.when(F.size(w) >= 4, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = df.withColumn(out, hashes)
    twice, ordered = f"{out}_t", f"{out}_s"
    df = df.withColumn(ordered, F.sort_array(F.col(out)))
    df = df.withColumn(twice, F.array_distinct(F.filter(ordered, lambda x, k: x == F.get(F.col(ordered), k + 1))))
    h, u = F.col(out), F.col(twice)
    few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(u, x), i)), lambda x: x.isNotNull())
    df = df.withColumn(ordered, F.when(F.size(u) > 64, F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col(ordered)
    many = F.filter(F.transform(s, lambda e, k: F.when((e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"]), e["i"])), lambda x: x.isNotNull())
    df = df.withColumn(out, F.when(F.size(u) > 64, F.sort_array(many)).when(F.size(u) > 0, few))
    d = F.col(out)
    gaps = F.transform(d, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(d, k + 1) - x, F.lit(3))))
    return df.withColumn(out, F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop(twice, ordered)


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", verdict: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """All rows, with all columns of the input (or those of `keep`), and the struct `verdict`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    Null and empty texts have no words and fail the base rules; texts of any length are taken whole. Repeated rows come
    out alike, equal histograms get equal verdicts, and an empty table gives no rows. Columns keep their names, but for
    one called as `verdict`, whose place it takes. The rows are written once with their histograms, so that texts are taken apart only once for references and verdicts.
    """
    words, repeated, chars, common, feature, ref_lang, ref_chars, ref_words = _names(docs, "w", "r", "c", "h", "f", "rl", "rc", "rw")
    df = with_words(docs, text_col, words)
    df = _repeated(df, words, repeated)
    df = with_histograms(df, text_col, lang_col, words, chars, common)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.col(repeated).alias("n_repeat_words"),
        _language(docs, lang_col).alias("lang"),
        F.col(chars).alias("chars"),
        F.col(common).alias("common"),
    )
    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c != verdict]
    features = written(df.select(*columns, found.alias(feature)), "quality")
    refs = references(features, feature).select(F.col("ref_lang").alias(ref_lang), F.col("ref_chars").alias(ref_chars), F.col("ref_words").alias(ref_words))
    df = features.join(F.broadcast(refs), F.col(feature)["lang"] == F.col(ref_lang), "left")
    f = F.col(feature)
    failed = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    far = [js_distance(f["chars"], F.col(ref_chars)), js_distance(f["common"], F.col(ref_words))]
    odd = (f["n_words"] >= MIN_WORDS) & ((F.coalesce(far[0], F.lit(0.0)) > MAX_CHARACTER_DISTANCE) | (F.coalesce(far[1], F.lit(0.0)) > MAX_WORD_DISTANCE))
    counts = [f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out = F.struct(*counts, failed.alias("base_failed"), far[0].alias("char_distance"), far[1].alias("word_distance"), (~failed & ~odd).alias("kept"))
    return df.select(*columns, out.alias(verdict))


def digest(judged: DataFrame) -> DataFrame:
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col("quality")[c].alias(c) for c in cols])
