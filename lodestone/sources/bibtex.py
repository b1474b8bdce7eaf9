"""Bibliography entries as rows, parsed where the files are read."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "paper_id string, slug string, kind string, title string, authors array<string>, year int, journal string, doi string, keywords array<string>"


def slugify(text: str, most: int = 80) -> str:
    """ASCII letters and digits, white space and signs between them as one hyphen; "untitled" if nothing is left."""
    letters = unicodedata.normalize("NFKD", (text or "").strip()).encode("ascii", "ignore").decode().lower()
    spaced = "".join(c if c.isalnum() else "-" if c in "-_" or c.isspace() else "" for c in letters)
    return re.sub("-{2,}", "-", spaced)[:most].strip("-") or "untitled"


def entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, key, fields) of each entry; values nest braces or stand in quotes."""
    for head in re.finditer(r"@(\w+)\s*\{\s*([^,\s]*)\s*,", text):
        fields, at = {}, head.end()
        while m := re.compile(r"\s*,?\s*(\w[\w-]*)\s*=\s*").match(text, at):
            at, quote = m.end(), text[m.end() : m.end() + 1]
            if quote == "{":
                depth, end = 0, at
                while end < len(text):
                    depth += {"{": 1, "}": -1}.get(text[end], 0)
                    end += 1
                    if not depth:
                        break
                value, at = text[at + 1 : end - 1], end
            elif quote == '"':
                end = text.find('"', at + 1)
                end = len(text) if end < 0 else end
                value, at = text[at + 1 : end], end + 1
            else:
                bare = re.compile(r"[^,}\s]*").match(text, at)
                value, at = bare[0], bare.end()
            fields[m[1].lower()] = " ".join(value.replace("{", "").replace("}", "").split())
        yield head[1].lower(), head[2], fields


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["value"]:
                for n, (kind, key, f) in enumerate(entries(text), 1):
                    slug = slugify(f.get("title", "")) or slugify(key)
                    year = re.search(r"\d{4}", f.get("year", ""))
                    listed = lambda name, sep: [x.strip() for x in re.split(sep, f.get(name, "")) if x.strip()]  # noqa: E731, B023
                    rows.append((key or slug or f"paper-{n:04d}", slug, kind, f.get("title"), listed("author", r"\s+and\s+"), int(year[0]) if year else None, f.get("journal"), f.get("doi"), listed("keywords", r"[;,]")))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")]).astype({"year": "Int64"})

    return spark.read.text(path, wholetext=True).mapInPandas(parse, SCHEMA)
