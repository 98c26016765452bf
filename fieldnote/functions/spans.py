"""Finding a quote inside a text: white space and quote marks may differ, nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldnote import vocab

_ESCAPE = "([\\\\.\\[\\]{}()*+?^$|#&~<>=!:-])"


def quote_pattern(quote: Column) -> Column:
    """A pattern for a quote: any white space between words, any form of each quote mark."""
    words = F.filter(F.split(quote, "(?U)\\s+"), lambda w: w != "")

    def literal(w: Column) -> Column:
        w = F.regexp_replace(w, _ESCAPE, "\\\\$1")
        w = F.regexp_replace(w, "['’‘]", "['’‘`]")
        return F.regexp_replace(w, '["“”]', '["“”]')

    return F.when(F.size(words) > 0, F.concat(F.lit("(?U)"), F.array_join(F.transform(words, literal), "\\s+")))


def clean_quote(quote: Column) -> Column:
    """White space squeezed, edge dots and quote marks dropped."""
    q = F.trim(F.regexp_replace(F.coalesce(quote, F.lit("")), "(?U)\\s+", " "))
    return F.regexp_replace(q, "^[ .…\"'“”]+|[ .…\"'“”]+$", "")


def find_in(text: Column, pattern: Column) -> Column:
    """``struct(start, end)`` of the first match in code points, or NULL."""
    hit = F.regexp_substr(text, pattern)
    before = F.get(F.split(text, pattern, 2), 0)
    return F.when(
        hit.isNotNull(),
        F.struct(F.length(before).alias("start"), (F.length(before) + F.length(hit)).alias("end")),
    )


def region_text(text: Column, region: Column) -> Column:
    return F.substring(text, region["start"] + 1, region["end"] - region["start"])


def verify(text: Column, quote: Column, regions: Column, shortest: int = vocab.MIN_SPAN) -> Column:
    """The exact slice a quote matches in the first region that holds it, or NULL."""
    q = clean_quote(quote)
    pattern = quote_pattern(q)
    hits = F.transform(regions, lambda r: F.regexp_substr(region_text(text, r), pattern))
    good = F.filter(hits, lambda h: h.isNotNull() & (F.length(h) >= shortest))
    return F.when(F.length(q) >= shortest, F.get(good, 0))


def locate(text: Column, posts: Column, post_no: Column, start: Column, end: Column) -> Column:
    """``struct(start, end)`` of a span named by its first and last words inside one post, or NULL.

    The end is searched from where the start was found, and the span never ends before its start anchor.
    """
    post = F.get(posts, post_no - 1)
    body = region_text(text, post)
    first = find_in(body, quote_pattern(start))
    rest = F.substring(body, first["start"] + 1, F.length(body))
    last = find_in(rest, quote_pattern(end))
    found = (post_no >= 1) & first.isNotNull() & last.isNotNull()
    at = post["start"] + first["start"]
    return F.when(
        found,
        F.struct(at.alias("start"), F.greatest(at + last["end"], post["start"] + first["end"]).alias("end")),
    )


def post_at(posts: Column, offset: Column) -> Column:
    """The post that contains an offset (end exclusive), or NULL."""
    return F.get(F.filter(posts, lambda p: (p["start"] <= offset) & (offset < p["end"])), 0)


def later_regions(posts: Column, offset: Column, author: Column) -> Column:
    """Posts by the same author after the one that contains the offset."""
    here = post_at(posts, offset)
    later = F.filter(posts, lambda p: (p["start"] > here["start"]) & (p["author_key"] == author))
    ok = author.isNotNull() & (author != "") & (F.size(posts) > 1) & here.isNotNull()
    return F.transform(
        F.when(ok, later).otherwise(F.filter(posts, lambda p: F.lit(False))),
        lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")),
    )


def allowed_regions(posts: Column, char_start: Column, char_end: Column, author: Column) -> Column:
    """Where a story's quotes may come from: its own span, then its author's later posts."""
    own = F.array(F.struct(char_start.cast("int").alias("start"), char_end.cast("int").alias("end")))
    return F.concat(own, later_regions(posts, char_start, author))


def later_text(text: Column, posts: Column, char_start: Column, author: Column, most: int | None = None) -> Column:
    """The posts of ``later_regions`` joined; whole, unless ``most`` characters are asked for."""
    parts = F.transform(later_regions(posts, char_start, author), lambda r: region_text(text, r))
    joined = F.array_join(parts, "\n---\n")
    return joined if most is None else F.substring(joined, 1, most)
