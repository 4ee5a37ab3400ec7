"""Parsers by kind of source. The first that accepts a source gets it; later ones can be put in front.

Formats that need tools Spark lacks (PDF pages, pixels, speech, vision models) are registered by who has them, as
functions from an iterator of pandas frames (source_id, content) to frames of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import media as M

from . import office

Parse = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass
class Parser:
    name: str
    accepts: Callable[[Column, Column], Column]
    parse: Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    parsers: list[Parser] = field(default_factory=list)

    def register(self, name: str, accepts: Callable[[Column, Column], Column], parse: Callable[[DataFrame], DataFrame], first: bool = True) -> None:
        self.parsers.insert(0 if first else len(self.parsers), Parser(name, accepts, parse))

    def external(self, name: str, accepts: Callable[[Column, Column], Column], function: Parse) -> None:
        """A parser that runs outside Spark, given Arrow batches."""
        self.register(name, accepts, lambda df: df.select("source_id", "content").mapInPandas(function, office.PART_SCHEMA))

    def chosen(self) -> Column:
        """Name of the first parser that accepts a row's (content_type, filename)."""
        out = F.lit(None).cast("string")
        for parser in reversed(self.parsers):
            out = F.when(parser.accepts(F.col("content_type"), F.col("filename")), parser.name).otherwise(out)
        return out

    def parse(self, sources: DataFrame) -> DataFrame:
        """Parts of all sources (source_id, filename, content_type, content); those nobody accepts get an error."""
        named = sources.withColumn("_parser", self.chosen())
        lost = named.filter("_parser is null").select("source_id", F.lit(0).alias("ord"), *[F.lit(None).cast("string").alias(c) for c in ("unit", "kind", "text")], F.lit("unsupported_source").alias("error"))
        for parser in self.parsers:
            lost = lost.unionByName(parser.parse(named.filter(F.col("_parser") == parser.name)))
        return lost


def _text(df: DataFrame) -> DataFrame:
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return df.select("source_id", F.lit(0).alias("ord"), F.lit("body").alias("unit"), F.lit("text").alias("kind"), F.when(good, F.decode("content", "UTF-8")).alias("text"), F.when(~good, "source_unreadable").alias("error"))


def default() -> Registry:
    """Texts and Office files."""
    out = Registry()
    out.register("text", M.is_text, _text)
    for name, kind in (("docx", M.DOCX), ("pptx", M.PPTX), ("xlsx", M.XLSX)):
        out.register(name, lambda declared, path, kind=kind, name=name: (M.media_type(declared) == kind) | (M.suffix(path) == f".{name}"), lambda df, name=name: office.read_office(df, name))
    return out
