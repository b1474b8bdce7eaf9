"""The closed list of Arrow functions: what the JVM has no built-in for."""

from __future__ import annotations

import difflib
import html
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.functions import effects
from lodestone.sources.bibtex import slugify as _slugify


@pandas_udf(StringType())
def slugify(x: pd.Series) -> pd.Series:
    """F03."""
    return x.map(lambda v: None if v is None else _slugify(v))


@pandas_udf(StringType())
def normalize_markup_title(x: pd.Series) -> pd.Series:
    """entities and tags resolved, compatibility forms, case folded, words apart by one space."""
    one = lambda v: " ".join(re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", re.sub(r"<[^>]+>", " ", html.unescape(v or ""))).casefold()).split())
    return x.map(one)


@pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype=float)


@pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    """N09 in full precision."""
    return z.map(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))) if v is not None and v == v else None).astype(float)


@pandas_udf(StringType())
def short_number(x: pd.Series) -> pd.Series:
    """%.12g."""
    return x.map(lambda v: f"{v:.12g}" if v is not None and v == v else None)


@pandas_udf(StructType([StructField("effect", DoubleType()), StructField("variance", DoubleType()), StructField("source", StringType())]))
def infer_effect(quote: pd.Series, direction: pd.Series, component: pd.Series) -> pd.DataFrame:
    """A fold, else a percentage, else group statistics, else plain means, as a log response ratio."""
    out = [effects.infer_again(q or "", None if d is None or d != d else int(d), c or "") for q, d, c in zip(quote, direction, component, strict=True)]
    effect, variance, source = zip(*out, strict=True) if out else ((), (), ())
    return pd.DataFrame({"effect": pd.Series(effect, dtype=float), "variance": pd.Series(variance, dtype=float), "source": pd.Series(source, dtype=object)})
