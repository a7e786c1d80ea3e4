"""Text of a page's element of a class or id, by expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def element_text(page: Column, tag: str, name: str | None = None, least: int = 50, most: int = 3000) -> Column:
    """The text of the first element of the tag (of the class or id `name`) up to its end tag: markup off, white space
    squeezed; null if it has no more than `least` characters; its first `most`, as a description field takes them."""
    opening = rf"<{tag}\b[^>]*" + (rf"(?:class|id)\s*=\s*[\"']?[^\"'>]*\b{re.escape(name)}\b[^>]*" if name else "") + ">"
    inner = F.regexp_extract(page, rf"(?is){opening}(.*?)(?:</{tag}\s*>|\z)", 1)
    text = F.regexp_replace(F.regexp_replace(inner, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(text) > least, F.substring(text, 1, most))
