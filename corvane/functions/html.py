"""Titles, descriptions and snippets of HTML, as chains of native regular expressions.

Tags are stripped without leaving a blank, entities stay as they are, only the first matching element is tried, and meta
attributes must be in double quotes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, first_bytes

_TRIM = rf"^{SPACE}+|{SPACE}+$"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, _TRIM, "")


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def strip_tags(html: Column) -> Column:
    """Drops what stands between < and > (or the end), and stray closing brackets."""
    return F.regexp_replace(html, r"<[^>]*>?|>", "")


def tag_text(html: Column, tag: str, keep_inner_tags: bool = False) -> Column:
    """The text of the first element whose name begins with `tag`; null if empty or never closed."""
    inner = _trim(F.regexp_extract(html, rf"(?is)^.*?<{tag}[^>]*>(.*?)</{tag}>", 1))
    return _filled(inner if keep_inner_tags else _trim(strip_tags(inner)))


def _meta(html: Column, attribute: str, value: str) -> Column:
    """The content of the tag around the first attribute="value". The page is cut at that, the tag is what stands between the
    last < before and the first > after: nothing is repeated over a group, which Java's expressions would do by recursion."""
    needle = f'{attribute}="{value}"'
    parts = F.split(html, f"(?i){needle}", 2)
    before, after = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    tag = F.concat(F.substring_index(before, "<", -1), F.lit(needle), F.substring_index(after, ">", 1))
    in_tag = before.contains("<") & F.coalesce(after, F.lit("")).contains(">")
    return F.when(in_tag, _filled(F.regexp_extract(tag, r'(?is)content="([^"]*)"', 1)))


def meta_content(html: Column, name: str) -> Column:
    return _meta(html, "name", name)


def meta_property(html: Column, name: str) -> Column:
    return _meta(html, "property", name)


def title(html: Column, keep_inner_tags: bool = False) -> Column:
    return F.coalesce(tag_text(html, "title", keep_inner_tags), meta_property(html, "og:title"), meta_content(html, "application-name"), tag_text(html, "h1"))


def description(html: Column) -> Column:
    return F.coalesce(meta_content(html, "description"), meta_property(html, "og:description"))


def _without_code(html: Column) -> Column:
    """Without script and style elements; one that is never closed stays."""
    for tag in ("script", "style"):
        html = F.regexp_replace(html, rf"(?is)<{tag}.*?</{tag}>", "")
    return html


def visible_text(html: Column) -> Column:
    """All text outside tags, scripts and styles, white space collapsed."""
    return F.trim(F.regexp_replace(strip_tags(_without_code(html)), rf"{SPACE}+", " "))


def snippet(html: Column, limit: int = 2000) -> Column:
    """The visible text, at most `limit` bytes."""
    return first_bytes(visible_text(html), limit)


def body_text(html: Column, limit: int = 200) -> Column:
    """The visible text of the body (of all where there is none), for pages without a description; null if empty."""
    code_free = _without_code(html)
    body = F.regexp_extract(code_free, r"(?is)<body[^>]*>(.*?)(?:</body>|$(?![\r\n]))", 1)
    inner = F.when(code_free.rlike(r"(?is)<body[^>]*>"), body).otherwise(code_free)
    text = F.trim(F.regexp_replace(strip_tags(inner), rf"{SPACE}+", " "))
    return _filled(F.regexp_replace(first_bytes(text, limit), rf"{SPACE}+$", ""))


def head(html: Column, limit: int = 10_240) -> Column:
    return first_bytes(html, limit)
