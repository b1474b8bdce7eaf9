"""String, regex and hashing expressions. Each takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Null codes, stop and keep words, unit spellings, polarity words.
NULL_CODES = ("NR", "NA", "UNC")
TIME_TO_H = {"h": 1.0, "hr": 1.0, "hrs": 1.0, "hour": 1.0, "hours": 1.0, "min": 1 / 60, "mins": 1 / 60, "minute": 1 / 60, "minutes": 1 / 60, "d": 24.0, "day": 24.0, "days": 24.0, "week": 168.0, "weeks": 168.0}
MASS_MOLAR = ("m", "mm", "um", "nm", "µm", "ng", "ug", "mg", "g")
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
RANGE = rf"({NUMBER})\s*(?:-|–|—|to)\s*({NUMBER})\s*([^\s,;]*)"
SINGLE = rf"({NUMBER})\s*(%|[^\s,;]*)"
DOSE_PREFIX = r"(?i)^\d+(?:\.\d+)?\s*(?:%|x|×|ng/ml|ug/ml|µg/ml|mg/ml|g/l|mg/l|mm|um|µm|nm|pm|u/ml|iu/ml|units?/ml)\s+"
DOSE_TAIL = r"(?i)\s+at\s+[\d.].*$"
QUALIFIER = r"\s*\([^)]*\)"
POSITIVE = ("increase", "increased", "enhance", "enhanced", "improve", "improved", "higher", "greater", "faster", "promote", "promoted", "support", "supported", "boost", "accelerat", "superior", "better")
NEGATIVE = ("decrease", "decreased", "reduce", "reduced", "reduction", "lower", "slower", "impair", "impaired", "inhibit", "inhibited", "suppress", "suppressed", "detrimental", "worse", "decline", "loss")


def collapse(x: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"[\s\x{00A0}]+", " "))


def is_code(x: Column) -> Column:
    """NR, NA or UNC."""
    return F.coalesce(F.trim(x).isin(*NULL_CODES), F.lit(False))


def is_inference(x: Column) -> Column:
    """Marked as inferred."""
    return F.coalesce(F.ltrim(x).startswith("INF:"), F.lit(False))


def grounded(quote: Column, text: Column, least: int = 8) -> Column:
    """The quote is in the text, apart from white space and case; short quotes never are."""
    q = collapse(quote)
    return F.coalesce((F.length(q) >= least) & F.contains(F.lower(collapse(text)), F.lower(q)), F.lit(False))


def dose_supported(component: Column, dose: Column, unit: Column, quote: Column, text: Column) -> Column:
    """Component, a dose with a digit and its unit in one grounded quote."""
    q = F.lower(collapse(quote))
    has = lambda x: (F.length(F.trim(x)) > 0) & F.contains(q, F.lower(collapse(x)))
    return F.coalesce(has(component) & has(dose) & dose.rlike(r"\d") & has(unit) & grounded(quote, text), F.lit(False))


def controlled(value: Column, vocabulary: list[str]) -> Column:
    """The canonical spelling of a vocabulary; codes, INF: and unknown values pass through trimmed."""
    v = F.trim(value)
    held = F.create_map(*[F.lit(x) for w in vocabulary for x in (w.lower(), w)])
    return F.when(is_code(v) | is_inference(v), v).otherwise(F.coalesce(F.element_at(held, F.lower(v)), v))


def is_missing(x: Column) -> Column:
    """Empty, unknown or a code."""
    return F.coalesce(F.lower(F.trim(x)), F.lit("")).isin("", "unknown", "nr", "na", "unc")


def is_stat_candidate(x: Column) -> Column:
    """P10: looks like a statistic."""
    return x.rlike(r"(?i)±|\+/-|\b(?:SD|SEM|standard deviation|standard error)\b|\bn\s*=\s*\d")


def is_range(x: Column) -> Column:
    """P16: "a-b" with a before b."""
    lo, hi = F.try_to_number(F.regexp_extract(x, r"^(\d+)-(\d+)$", 1), F.lit("999999999999")), F.try_to_number(F.regexp_extract(x, r"^(\d+)-(\d+)$", 2), F.lit("999999999999"))
    return F.coalesce(x.rlike(r"^\d+-\d+$") & (hi > lo), F.lit(False))


def is_float(x: Column) -> Column:
    """Reads as a number."""
    return F.trim(x).try_cast("double").isNotNull()


def signals(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that match, in their order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())


def signal_score(found: Column, weights: dict[str, int]) -> Column:
    """sum of the signals' weights."""
    held = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.aggregate(found, F.lit(0), lambda a, s: a + F.coalesce(F.element_at(held, s), F.lit(0)))


def retrieval_tokens(x: Column) -> Column:
    """lower-case tokens of two or more of a-z, 0-9, - and /, the first no sign."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9\-/]+)"), 1)


def review_tokens(x: Column, stop: tuple[str, ...], keep: tuple[str, ...] = ()) -> Column:
    """distinct review tokens in order: signs stripped, short and stop words dropped unless kept."""
    raw = F.transform(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"([a-z0-9][a-z0-9\-_/]*)"), 1), lambda t: F.regexp_replace(t, r"^[-_/]+|[-_/]+$", ""))
    good = lambda t: ((F.length(t) >= 3) | t.isin("b8", "b9")) & (~t.isin(*stop) | t.isin(*(keep or ("",))))
    return F.array_distinct(F.filter(raw, good))


def normalize_doi(x: Column) -> Column:
    """lower case, resolver or "doi:" prefix and trailing marks dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), r"[ .;,]+$", "")


def normalize_doi_simple(x: Column) -> Column:
    """only the https resolver and "doi:" are dropped; no tail is stripped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"^https://doi\.org/", ""), r"^doi:", "")


def normalize_title(x: Column) -> Column:
    """ASCII letters and digits, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9]+", " "))


def strip_component(x: Column) -> Column:
    """parentheses, then a dose tail, then a leading dose go."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, QUALIFIER, "")), DOSE_TAIL, ""), DOSE_PREFIX, ""))


def component_terms(x: Column) -> Column:
    """the whole and its parts of three or more characters, longest first, then by name."""
    parts = F.filter(F.transform(F.split(x, r"[^A-Za-z0-9+\-]+"), lambda p: F.lower(F.trim(p))), lambda p: F.length(p) >= 3)
    terms = F.array_distinct(F.concat(F.array(F.lower(F.trim(x))), parts))
    return F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("k"), t.alias("t")))), lambda s: s["t"])


def normalize_value(x: Column) -> Column:
    """lower case, single spaces, hours and minutes short, no space before %."""
    v = F.lower(collapse(x))
    v = F.regexp_replace(F.regexp_replace(v, r"\bhours?\b|\bhrs?\b", "h"), r"\bminutes?\b|\bmins?\b", "min")
    return F.regexp_replace(v, r"(\d)\s+%", "$1%")


def snippet(text: Column, tokens: list[str], width: int = 240) -> Column:
    """the text around the first token that is found, else its beginning."""
    low = F.lower(text)
    hit = F.coalesce(*[F.nullif(F.instr(low, t), F.lit(0)) for t in tokens]) if tokens else F.lit(None)
    start = F.greatest(F.lit(1), F.coalesce(hit, F.lit(1)) - width // 3)
    return F.trim(F.substr(text, start, F.lit(width)))


def excerpt(x: Column, limit: int) -> Column:
    """at most limit characters, with an ellipsis when cut."""
    v = collapse(x)
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.rtrim(F.substring(v, 1, limit - 3)), F.lit("...")))


def short_locator(x: Column, words: int = 12) -> Column:
    """the first words."""
    return F.array_join(F.slice(F.split(collapse(x), " "), 1, words), " ")


def scrub(x: Column) -> Column:
    """keys and bearer values hidden."""
    return F.regexp_replace(F.regexp_replace(x, r"(?i)\b(sk-[A-Za-z0-9_-]{6,})", "[REDACTED]"), r"(?i)(bearer\s+)[A-Za-z0-9._-]+", "$1[REDACTED]")


#: Licences by what names them, the first that does; $1 and $2 are a deed's kind and version.
LICENCES = (
    (r"creativecommons\.org/licenses/(by(?:-nc)?(?:-nd|-sa)?)/(2\.0|2\.5|3\.0|4\.0)(?:/|\b)", "CC-$1-$2"),
    (r"creativecommons\.org/publicdomain/zero/1\.0()()", "CC0-1.0"),
    (r"creative commons attribution 4\.0()()", "CC-BY-4.0"),
)


def licence_code(text: Column, url: Column) -> Column:
    """F16: a Creative Commons code such as CC-BY-4.0, or null; what the URL says comes before what the text says."""
    said = F.lower(F.concat_ws(" ", url, text))
    codes = [F.when(said.rlike(p), F.upper(F.regexp_replace(F.regexp_extract(said, p, 0), f"^{p}$", code))) for p, code in LICENCES]
    return F.coalesce(*codes)


def _any(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def direction_from_text(x: Column) -> Column:
    """1 or -1 if only words of one polarity occur (as substrings), else null."""
    v = F.lower(F.coalesce(x, F.lit("")))
    pos, neg = _any(v, POSITIVE), _any(v, NEGATIVE)
    return F.when(pos & ~neg, 1).when(neg & ~pos, -1)


def matched_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """the terms that the text has, sorted."""
    return F.array_sort(F.filter(F.array(*map(F.lit, sorted(terms))), lambda t: F.contains(F.lower(text), t)))


def first_number(x: Column) -> Column:
    """the first number of a text."""
    return F.regexp_extract(x, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def relative_path(x: Column, base: str) -> Column:
    """a path relative to a base, where it is below it."""
    return F.when(x.startswith(base.rstrip("/") + "/"), F.substring(x, len(base.rstrip("/")) + 2, 1 << 20)).otherwise(x)


def lenient(x: Column, *, positive: bool = False) -> Column:
    """A number if the value reads as one (and is positive), else null."""
    v = F.trim(x.cast("string")).try_cast("double")
    return F.when(v > 0, v) if positive else v


def iso_utc(t: Column) -> Column:
    """A time as text in UTC."""
    return F.date_format(t.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parse_quantity(x: Column) -> Column:
    """Value, bounds, unit, dimension, normalised value and unit, comparable; the original stays as it was.

    A range gives its middle. Times become hours; concentrations are recognised but not comparable.
    """
    t = F.trim(F.coalesce(x, F.lit("")))
    # each shape is matched once: its groups are what a replacement leaves; a lambda's argument is evaluated once
    groups = lambda p, n: F.split(F.regexp_replace(t, rf"(?s)^.*?{p}.*$", "\x1f".join(f"${k}" for k in range(1, n + 1)) + "\x1f"), "\x1f")
    read = F.struct(t.alias("t"), groups(RANGE, 3).alias("r"), groups(SINGLE, 2).alias("s"))
    return F.get(F.transform(F.array(read), lambda m: _quantity(m["t"], m["r"], m["s"])), F.lit(0))


def _quantity(t: Column, r: Column, s: Column) -> Column:
    ranged = F.size(r) == 4
    part = lambda a, n, k: F.when(F.size(a) == n, F.get(a, F.lit(k)))
    lo, hi = part(r, 4, 0).try_cast("double"), part(r, 4, 1).try_cast("double")
    value = F.when(ranged, (lo + hi) / 2).otherwise(part(s, 3, 0).try_cast("double"))
    unit = F.nullif(F.when(ranged, part(r, 4, 2)).otherwise(part(s, 3, 1)), F.lit(""))
    u = F.lower(unit)
    hours = F.element_at(F.create_map(*[F.lit(v) for kv in TIME_TO_H.items() for v in kv]), u)
    there = unit.isNotNull() & value.isNotNull()
    percent = u.isin("%", "percent", "pct")
    dimension = F.when(~there, None).when(hours.isNotNull(), "time").when(percent, "percent").when(F.contains(unit, F.lit("/")) | u.isin(*MASS_MOLAR), "concentration")
    normal = F.when(there & hours.isNotNull(), value * hours).when(there & percent, value)
    return F.struct(
        t.alias("original"),
        value.alias("value"),
        lo.alias("lo"),
        hi.alias("hi"),
        unit.alias("unit"),
        dimension.alias("dimension"),
        normal.alias("normalized_value"),
        F.when(dimension == "time", "h").when(dimension == "percent", "%").alias("normalized_unit"),
        F.coalesce(dimension.isin("time", "percent"), F.lit(False)).alias("comparable"),
    )


def parse_cell_number(x: Column, role: str) -> Column:
    """A table cell's number for a role (mean, dispersion or n): n=..., a±b, c×10^e, or plain with thousands commas."""
    t = collapse(x)
    plain = F.regexp_replace(F.regexp_extract(t, r"^([-+]?\d[\d,]*(?:\.\d+)?|[-+]?\.\d+)\s*[*†‡§a-z%]?$", 1), ",", "").try_cast("double")
    pm = r"^([-+]?[\d.,]+)\s*(?:±|\+/-)\s*([\d.,]+)$"
    part = F.regexp_replace(F.regexp_extract(t, pm, 1 if role == "mean" else 2), ",", "").try_cast("double")
    sci = r"^([-+]?\d+(?:\.\d+)?)\s*[×x]\s*10\s*\^?\s*([-+]?\d+)$"
    scientific = F.regexp_extract(t, sci, 1).try_cast("double") * F.pow(F.lit(10.0), F.regexp_extract(t, sci, 2).try_cast("int"))
    n = F.regexp_extract(t, r"(?i)\bn\s*=\s*(\d+)", 1).try_cast("double")
    out = F.when(t.rlike(pm), part if role in ("mean", "dispersion") else F.lit(None)).when(t.rlike(sci), scientific).otherwise(plain)
    return F.when(t.rlike(r"(?i)\bn\s*=\s*\d+"), n).otherwise(out) if role == "n" else out


def supported_by(value: Column, quote: Column) -> Column:
    """The number stands in the quote, within 1e-9 or a millionth, not inside another token."""
    found = F.transform(F.regexp_extract_all(quote, F.lit(r"(?<![A-Za-z0-9_.])([-+]?\d+(?:\.\d+)?)(?![A-Za-z0-9_])"), 1), lambda t: t.try_cast("double"))
    return F.coalesce(F.exists(found, lambda t: F.abs(t - value) <= F.greatest(F.lit(1e-9), F.abs(value) * 1e-6)), F.lit(False))


def timepoint(quote: Column) -> Column:
    """N12: "48 h" of "at 48 h"."""
    return F.regexp_extract(quote, r"(?i)\b(?:at|after|for)\s+(\d+(?:\.\d+)?\s*(?:h|hr|hours?|d|days?|weeks?|min))\b", 1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 when either is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def json_from_prose(x: Column) -> Column:
    """The JSON text in prose: the first fence that parses, the whole, from the first brace to the last, or bracket; null if none parses."""

    def text(t: Column) -> Column:
        """A candidate that is one JSON value and nothing after it: as the element of a list it must stand alone."""
        own = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        return F.when(F.try_variant_get(own, "$[0]", "variant").isNotNull() & F.try_variant_get(own, "$[1]", "variant").isNull(), F.trim(t, F.lit(" \t\r\n")))

    fences = F.transform(F.regexp_extract_all(x, F.lit(r"(?s)```(?:json)?\s*(.*?)```"), F.lit(1)), text)
    rest = [x, F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.regexp_extract(x, r"(?s)(\[.*\])", 1)]
    return F.coalesce(F.get(F.array_compact(fences), F.lit(0)), *map(text, rest))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, |error| < 1.5e-7."""
    z = F.abs(x)
    t = 1 / (1 + 0.3275911 * z)
    y = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return F.when(x < 0, -y).otherwise(y)


def norm_cdf(z: Column) -> Column:
    return 0.5 * (1 + erf(z / 2**0.5))


def norm_pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / (2 * 3.141592653589793) ** 0.5


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is zero."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
