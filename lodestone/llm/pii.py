"""Surrogates for personal data, by DataFrame functions alone.

Entities are found by one pattern. Each distinct unit (a number, an address, a name's word) of a text gets a surrogate
that is keyed, of the same type and format, and for names of the same gender and script; equal units get equal
surrogates, in every text (coreference), and within a text unequal units get unequal ones: a candidate that another
unit has, or that stands in the text itself, is passed over for the next one of the keyed sequence. People are found by
their titles, with up to three words (initials, inner capitals, apostrophes, hyphens), and again wherever a word of such
a name stands alone, unless that word is an ordinary one (AMBIGUOUS). Names without any title stay.

Null texts stay null. Texts without entities stay as they are. Repeated rows come out alike; an empty table gives no
rows. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "phone", "card", "ssn", "iban", "person")
#: Titles by gender, and names by gender and script.
TITLES = {"m": "Mr Herr Monsieur Señor Sr", "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra", "n": "Dr Prof"}
#: Syllables that names are composed of, by script: beginnings, middles, and ends by role; any order gives a name that reads like one.
BEGIN = {
    "latin": "Al Ba Bel Ca Cor Da Del Do El Fa Fer Ga Gre Ha Hel Jo Ka Lan Le Lin Ma Mar Mel Mi Na No Or Pa Per Ra Ro Sa Sel So Ta Tor Va Ver Vi Wen".split(),
    "cyrillic": "Ал Ба Бе Ва Ви Га Да До Ел За Зо Ка Ки Ко Ла Ле Ли Ма Ми Мо На Ни Но Ол Па Пе Ра Ро Са Се Си Та Ти То Фе Ха Че Ша Яс Ян".split(),
    "greek": "Αλ Βα Γα Δα Ελ Ζα Θε Ιω Κα Λε Μα Νι Ορ Πα Ρο Σα Τε Φα Χα Ωρ".split(),
}
MIDDLE = {
    "latin": "ba be bi da de di do fa fe ga ge la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе ва ве ви га да де ди ка ки ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си та те ти то".split(),
    "greek": "βα γε δα δε κα κι λα λε λι μα με νι νο ρα ρε ρι σα σι τα τε".split(),
}
END = {
    ("m", "latin"): "n r s d k ld rt ton".split(), ("f", "latin"): "na la ra ta lia nia ria sa".split(), ("n", "latin"): "ley lyn ris len ren lis".split(), ("last", "latin"): "mer sen ler ner wick ford land bert".split(),
    ("m", "cyrillic"): "н р м л слав мир".split(), ("f", "cyrillic"): "на ла ра та ия ся".split(), ("n", "cyrillic"): "ня ша ля ся".split(), ("last", "cyrillic"): "ко чук ых ряк ман дюк".split(),
    ("m", "greek"): "ς ος ης ων".split(), ("f", "greek"): "α η ια ίνα".split(), ("n", "greek"): "ις υ".split(), ("last", "greek"): "δης κης λος νος".split(),
}
#: Names that are words or months too: only behind a title are they names.
AMBIGUOUS = "April August Bill Dean Faith Grace Hope Joy June Mark May Will".split()
_TITLE = "|".join(t for ts in TITLES.values() for t in ts.split())
#: A name's word: inner capitals, and parts behind an apostrophe or hyphen ("O'Brien", "Müller-Lüdenscheidt"; not a genitive); or an initial.
_WORD = r"\p{Lu}(?:['’]\p{Lu}\p{L}+|\p{L}+(?:['’-]\p{L}{2,})*)"
_HEX = r"[0-9A-Fa-f]{1,4}"
PATTERN = "|".join(
    (
        r"(?<![\p{L}\p{Nd}._%+-])[\p{L}\p{Nd}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
        r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
        r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
        r"(?<![\d])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\d)",
        r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\d+.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)"
        r"|(?<![\p{L}\d+.,-])0\d{2,4} \d{3,4} \d{3,4}(?!\d)|(?<![\p{L}\d+.,-])[2-9]\d{9}(?![\p{L}\d-])",
        rf"(?<![\p{{L}}\d:])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\p{{L}}\d:])",
        rf"(?<!\p{{L}})(?:{_TITLE})\.?(?: (?!(?:{_TITLE})\b)(?:\p{{Lu}}\.(?= \p{{Lu}})|{_WORD})){{1,3}}",
    )
)
COUNTRY = r"^\+\d{1,3}(?=[ .(-])"
TRIES = 12


def _kind(e: Column) -> Column:
    return (
        F.when(F.contains(e, F.lit("@")), "email")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | e.rlike(r"^[0-9A-Fa-f]*:[0-9A-Fa-f:]+$"), "ip")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}$"), "card")
        .when(e.rlike(r"^[+(\d]"), "phone")
        .otherwise("person")
    )


def _number(h: Column, at: int) -> Column:
    """A number of 28 bits from a hex digest."""
    return F.conv(F.substring(h, at, 7), 16, 10).cast("int")


def _pick(h: Column, at: int, words: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, words)), _number(h, at) % len(words))


def _name(h: Column, role: str, script: str, more: Column) -> Column:
    """A composed name of three or four syllables, of more where `more` spells a number: those never run out."""
    middle = MIDDLE[script]
    digits = F.transform(F.split(more, ""), lambda c: F.get(F.array(*map(F.lit, middle)), c.cast("int")))
    extra = F.when(more == "", F.when(_number(h, 50) % 2 == 0, "").otherwise(_pick(h, 43, middle))).otherwise(F.array_join(digits, ""))
    return F.concat(_pick(h, 1, BEGIN[script]), _pick(h, 8, middle), extra, _pick(h, 22, END[role, script]))


def keyed(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, as hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (bytearray(c ^ x for c in raw) for x in (0x36, 0x5C))
    said = F.encode(F.concat_ws("\x1f", *parts), "UTF-8")
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), said), 256))), 256)


def _digits_like(form: Column, digits: Column) -> Column:
    """The form with its digits replaced, in order; other characters stay."""
    n = F.length(form)
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.when(F.substr(form, i, F.lit(1)).rlike(r"\d"), F.substr(digits, F.length(F.regexp_replace(F.substr(form, F.lit(1), i), r"\D", "")), F.lit(1))).otherwise(F.substr(form, i, F.lit(1))),
        ),
        "",
    )


def _luhn(digits: Column) -> Column:
    """The check sum of a number of an even count of digits, last digit included, modulo 10."""
    terms = F.transform(F.split(digits, ""), lambda c, i: F.when(i % 2 == 0, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10


def _candidate(key: str, unit: Column, b: Column, more: Column | None = None) -> Column:
    """The b-th surrogate of a unit (kind, value): a canonical form of the same type."""
    kind, value = unit["kind"], unit["value"]
    h = keyed(key, kind, value, b.cast("string"))
    digits = F.translate(h, "abcdef", "271828")
    card = F.concat(F.substring(value, 1, 1), F.substring(digits, 2, 14))
    check = (10 - _luhn(F.concat(card, F.lit("0")))) % 10
    card = F.concat(card, F.when(_luhn(value) == 0, check.cast("string")).otherwise(F.substring(digits, 16, 1)))
    letters = F.translate(h, "0123456789", "ghijklmnop")
    email = F.concat(F.substr(letters, F.lit(1), F.greatest(F.lit(8), F.least(F.lit(24), F.locate("@", value) - 1))), F.lit("@mail"), F.substring(digits, 50, 2), F.lit(".example.org"))
    iban = F.concat(F.substring(value, 1, 2), F.substring(digits, 1, 2), F.substr(F.concat(digits, digits), F.lit(3), F.length(value) - 4))
    ip = F.concat_ws(".", F.lit("10"), *[(_number(h, k) % 256).cast("string") for k in (1, 8, 15)])
    ip = F.when(F.contains(value, F.lit(":")), F.concat(F.lit("fd00:"), F.array_join(F.array(*[F.substring(h, k, 4) for k in (30, 34, 38)]), ":"), F.lit("::"), F.substring(h, 42, 4))).otherwise(ip)
    initial = F.concat(F.get(F.split(F.when(value.rlike(r"\p{IsCyrillic}"), "АБВГДЕКЛМНОПРСТФ").when(value.rlike(r"\p{IsGreek}"), "ΑΒΓΔΕΖΘΙΚΛΜΝΟΠΡΣΤ").otherwise("ABCDEFGHJKLMNPRSTVW"), ""), _number(h, 1) % 16), F.lit("."))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "initial", initial).when(kind == "card", card).when(kind == "iban", iban)
    out = out.when(kind.isin("phone", "ssn"), F.substr(digits, F.lit(1), F.length(value)))
    for role, script in END:
        out = out.when(kind == f"{role}-{script}", _name(h, role, script, F.lit("") if more is None else more))
    return out


def _units(e: Column) -> Column:
    """The units of an entity: one, or a name's words."""
    kind = _kind(e)
    title = F.regexp_extract(e, rf"^({_TITLE})\.? ", 1)
    role = F.when(title.isin(*TITLES["m"].split()), "m").when(title.isin(*TITLES["f"].split()), "f").otherwise("n")
    words = F.split(F.regexp_replace(e, rf"^(?:{_TITLE})\.? ", ""), " ")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    names = F.transform(words, lambda w, i: F.struct(F.when(F.endswith(w, F.lit(".")), "initial").otherwise(F.concat_ws("-", F.when(i < F.size(words) - 1, role).otherwise("last"), script(w))).alias("kind"), w.alias("value")))
    value = F.when(kind == "email", F.lower(e)).when(kind.isin("phone", "ssn", "card"), F.regexp_replace(F.regexp_replace(e, COUNTRY, ""), r"\D", "")).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).otherwise(e)
    return F.when(kind == "person", names).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def _rendered(e: Column, held: Column) -> Column:
    """An entity's replacement in its own format, from a map of surrogates by unit, and by a name's word alone for later mentions."""
    units, kind = _units(e), _kind(e)
    new = F.transform(units, lambda u: F.coalesce(F.element_at(held, F.concat_ws("\x1f", u["kind"], u["value"])), F.element_at(held, u["value"])))
    first = F.get(new, F.lit(0))
    prefix = F.regexp_extract(e, COUNTRY, 0)  # a phone number keeps its country's code
    phone = F.concat(prefix, _digits_like(F.substr(e, F.length(prefix) + 1, F.length(e)), first))
    iban = F.when(F.contains(e, F.lit(" ")), F.trim(F.regexp_replace(first, r"(.{4})", "$1 "))).otherwise(first)
    person = F.concat(F.regexp_extract(e, rf"^(?:{_TITLE})\.? ", 0), F.array_join(new, " "))
    return F.when(kind.isin("email", "ip"), first).when(kind == "phone", phone).when(kind.isin("card", "ssn"), _digits_like(e, first)).when(kind == "iban", iban).otherwise(person)


def replace(docs: DataFrame, key: str, *, text_col: str = "text", found_col: str = "entities") -> DataFrame:
    """All rows of the input, texts with surrogates, and `found_col`: an array of (kind, surrogate) in order.

    Columns keep their names, but for one called as `found_col`, whose place it takes. Texts of any length are taken
    whole; of units that tie for a surrogate, the first in order of kind and value has it.
    """
    if not key:
        raise ValueError("surrogates need a key: without one, anyone could build the same")
    names = []
    for base in ("_p_found", "_p_units", "_p_held", "_p_new", "_p_all"):
        while base in docs.columns:
            base += "_"
        names.append(base)
    found, units, held, new, pattern = names
    text = F.col(f"`{text_col}`")
    df = docs.withColumn(found, F.regexp_extract_all(text, F.lit(PATTERN), 0))
    some = F.size(found) > 0
    df = df.withColumn(units, F.when(some, F.array_sort(F.array_distinct(F.flatten(F.transform(found, _units))))))
    # a name that a title introduces is found again without it
    person = F.filter(units, lambda u: F.contains(u["kind"], F.lit("-")))
    words = F.array_sort(F.array_except(F.array_distinct(F.transform(person, lambda u: u["value"])), F.array(*map(F.lit, AMBIGUOUS))))
    bare = F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(words, "|"), F.lit(")(?: (?:"), F.array_join(words, "|"), F.lit(r"))?(?!\p{L})"))
    df = df.withColumn(pattern, F.when(some & (F.size(words) > 0), bare).otherwise(F.lit(PATTERN)))
    df = df.withColumn(found, F.when(F.size(words) > 0, F.regexp_extract_all(text, F.col(pattern), 0)).otherwise(F.col(found)))

    # first candidates, and for those that meet another or a value of the text, later ones, in order
    none = F.struct(F.create_map().cast("map<string,string>").alias("by"), F.create_map().cast("map<string,boolean>").alias("taken"))
    taken = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.col(units), lambda u: u["value"])), lambda v: F.struct(v.alias("key"), F.lit(True).alias("value"))))
    tries = lambda u: F.transform(F.sequence(F.lit(0), F.lit(TRIES)), lambda b: _candidate(key, u, b))
    first = F.transform(F.col(units), lambda u: _candidate(key, u, F.lit(0)))
    plain = (F.size(F.array_distinct(first)) == F.size(first)) & ~F.arrays_overlap(first, F.map_keys(taken))
    ids = F.transform(F.col(units), lambda u: F.concat_ws("\x1f", u["kind"], u["value"]))

    def add(acc: Column, u: Column) -> Column:
        free = F.filter(tries(u), lambda s: ~F.array_contains(F.map_keys(acc["taken"]), s))
        last = _candidate(key, u, F.lit(TRIES + 1), F.size(acc["by"]).cast("string"))
        one = F.coalesce(F.get(free, F.lit(0)), last)
        by = F.map_concat(acc["by"], F.create_map(F.concat_ws("\x1f", u["kind"], u["value"]), one))
        return F.struct(by.alias("by"), F.when(F.array_contains(F.map_keys(acc["taken"]), one), acc["taken"]).otherwise(F.map_concat(acc["taken"], F.create_map(one, F.lit(True)))).alias("taken"))

    start = none.withField("taken", taken)
    slow = F.aggregate(F.col(units), start, add)["by"]
    by_unit = F.when(plain, F.map_from_arrays(ids, first)).otherwise(slow)
    df = df.withColumn(held, F.when(some, by_unit))
    # a name's word alone means its first unit
    alone = F.transform(words, lambda w: F.struct(w.alias("key"), F.element_at(F.col(held), F.concat_ws("\x1f", F.get(F.filter(units, lambda u: u["value"] == w), F.lit(0))["kind"], w)).alias("value")))
    df = df.withColumn(held, F.when(some & (F.size(words) > 0), F.map_concat(F.col(held), F.map_from_entries(alone))).otherwise(F.col(held)))
    df = df.withColumn(new, F.when(some, F.transform(found, lambda e: F.struct(_kind(e).alias("kind"), _rendered(e, F.col(held)).alias("surrogate")))))
    gaps = F.split(text, F.col(pattern), -1)
    joined = F.array_join(F.zip_with(gaps, F.transform(new, lambda x: x["surrogate"]), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    own = F.when(some, joined).otherwise(text)
    out = [own.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != found_col]
    return df.select(*out, F.coalesce(F.col(new), F.array().cast("array<struct<kind:string,surrogate:string>>")).alias(found_col))
