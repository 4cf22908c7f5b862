"""String columns: whitespace, tokens, summaries, citations, prompts, HTML."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope import constants as C

# White space as Python's str.strip() sees it: the Unicode property and the four ASCII
# separators.  Spark's trim() removes only spaces unless it is told what to remove.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_INK = r"(?U)[^\s\x1c-\x1f]"
_WORD = r"[\p{L}\p{N}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def has_text(text: Column) -> Column:
    """False for null, empty and white-space-only text (a no-break space is white space)."""
    return F.coalesce(text.rlike(_INK), F.lit(False))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def nonblank_lines(text: Column) -> Column:
    """Stripped lines of ``text`` that are not blank."""
    return F.filter(F.transform(lines(text), strip), lambda line: line != "")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def distinct_words(text: Column) -> Column:
    return F.array_distinct(words(text))


def summary_cut(text: Column) -> Column:
    """The first 200 characters and an ellipsis, whatever the length."""
    return F.concat(F.substring(text, 1, C.SUMMARY_CHARS), F.lit(C.SUMMARY_SUFFIX))


def summary_cut_if_long(text: Column) -> Column:
    return F.when(F.length(text) > C.SUMMARY_CHARS, summary_cut(text)).otherwise(text)


def has_suffix(name: Column, suffix: str = C.FILE_SUFFIX) -> Column:
    """Case-insensitive file-extension test."""
    return F.endswith(F.lower(name), F.lit(suffix.lower()))


def embed_endpoint(url: Column) -> Column:
    """Service address with trailing slashes removed, then ``/embed``."""
    return F.concat(F.rtrim(url, F.lit("/")), F.lit("/embed"))


def citation_label(rank: Column) -> Column:
    return F.concat(F.lit("["), rank.cast("string"), F.lit("]"))


def cite_suffix(text: Column, label: Column) -> Column:
    return F.concat(text, F.lit(" "), label)


def cite_prefix(text: Column, source: Column, page: Column) -> Column:
    return F.concat(F.lit("[Source: "), source, F.lit(", page "), page, F.lit("]\n"), text)


def reference_line(position: Column, source: Column, page: Column) -> Column:
    return F.concat(citation_label(position), F.lit(" "), source, F.lit(", page "), page)


def fill_template(template: str, values: Mapping[str, Column]) -> Column:
    """Concatenate the literal parts of ``template`` with columns for its ``{slots}``.

    The values are never scanned for slots, so a question that contains
    ``{context}`` stays as it is.
    """
    parts = re.split(r"\{(\w+)\}", template)
    missing = set(parts[1::2]) - set(values)
    if missing:
        raise ValueError(f"template slots without a value: {sorted(missing)}")
    columns = [
        values[part] if i % 2 else F.lit(part) for i, part in enumerate(parts) if part or i % 2
    ]
    return F.concat(*columns)


PROMPTS = {
    "default": C.PROMPT_DEFAULT,
    "cited": C.PROMPT_CITED,
    "cited_with_references": C.PROMPT_CITED_WITH_REFERENCES,
}


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def message_html(template: str, content: Column, escape: bool = True) -> Column:
    """Put a message into the page template; ``escape=False`` inserts it as raw HTML."""
    return F.replace(
        F.lit(template), F.lit(C.MESSAGE_SLOT), escape_html(content) if escape else content
    )


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def three_decimals(number: Column) -> Column:
    return F.format_number(number, 3)


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, as lower-case hex: the identity of a file."""
    return F.sha2(content.cast("binary"), 256)


def point_id(file_hash: Column, page_number: Column, chunk_index: Column) -> Column:
    """Content-derived point id, so that a rerun writes the same ids."""
    return F.sha2(
        F.concat_ws(":", file_hash, page_number.cast("string"), chunk_index.cast("string")), 256
    )
