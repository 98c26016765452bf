"""Markup to text. Tags are handled in the JVM; entity names need the full table, so they are decoded in
Arrow batches by the standard library: only the references themselves go to Python, never the texts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldnote.functions.text import let, running_sums, strip

_BLOCK_TAG = r"(?i)</?(p|br|li|pre|blockquote|h\d)[^>]*>"  # fixed pattern
_ANY_TAG = r"<[^>]+>"  # fixed pattern


_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"  # what html.unescape looks at


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decoded(references: pd.Series) -> pd.Series:
    return references.map(lambda rs: None if rs is None else [html.unescape(r) for r in rs])


def _filled_in(text: Column, decoded: Column) -> Column:
    """The text cut at its references, with what they stand for between the pieces."""
    pieces = F.split(text, _REFERENCE, -1)
    whole = F.array_join(F.zip_with(pieces, decoded, lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")
    return F.when(F.size(decoded) > 0, whole).otherwise(text)


def _references(text: Column) -> Column:
    return F.when(text.contains("&"), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))).otherwise(F.array().cast("array<string>"))


def unescape(text: Column) -> Column:
    return _filled_in(text, _decoded(_references(text)))


def unescape_each(texts: Column) -> Column:
    """The texts of a list, decoded. Their references make one list for Python; each text takes its own back."""
    sizes = F.transform(texts, lambda t: F.size(_references(F.coalesce(t, F.lit("")))))
    held = F.struct(texts.alias("texts"), running_sums(sizes).alias("ends"), _decoded(F.flatten(F.transform(texts, lambda t: _references(F.coalesce(t, F.lit("")))))).alias("all"))

    def each(h: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            start = F.when(i > 0, F.get(h["ends"], i - 1)).otherwise(0)
            return _filled_in(t, F.slice(h["all"], start + 1, F.get(h["ends"], i) - start))

        return F.transform(h["texts"], one)

    return let(held, each)


def strip_tags(text: Column) -> Column:
    """Block tags become line breaks, all other tags go."""
    broken = F.regexp_replace(F.coalesce(text, F.lit("")), _BLOCK_TAG, "\n")
    return F.regexp_replace(broken, _ANY_TAG, "")


def html_to_text(text: Column) -> Column:
    return strip(unescape(strip_tags(text)))
