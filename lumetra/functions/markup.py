"""Elements, links and texts of well-formed page parts by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS


def inner(html: Column, tag: str) -> Column:
    """What the first element of a tag holds."""
    return F.regexp_extract(html, rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)


def plain(fragment: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fragment, "<[^>]+>", " "), BLANKS, " "))


def first_text(html: Column, tag: str, default: str) -> Column:
    text = plain(inner(html, tag))
    return F.when(text == "", default).otherwise(text)


def all_texts(html: Column, container: str, tag: str) -> Column:
    """The non-empty texts of a tag's elements inside a container, one a line."""
    found = F.regexp_extract_all(inner(html, container), F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.array_join(F.filter(F.transform(found, plain), lambda x: x != ""), "\n")


def links(html: Column, container: str) -> Column:
    return F.regexp_extract_all(inner(html, container), F.lit('href="([^"]*)"'), F.lit(1))
