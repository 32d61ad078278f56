"""Cleaning and budgeting of document text.

Unicode decomposition, the suffix scan for reference lists and the assembly of sections under a running budget have no
built-in form; they are row-local and run as Arrow UDFs on whole batches. All else is column expressions.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import ship_active

#: Headers that begin a reference list, weights, exclusions and caps of sections.
REFERENCE_HEADERS = [r"\n\s*references?\s*\n", r"\n\s*bibliography\s*\n", r"\n\s*works?\s+cited\s*\n", r"\n\s*literature\s+cited\s*\n", r"\n\s*reference\s+list\s*\n"]
SECTION_WEIGHT = {"abstract": 100, "introduction": 90, "background": 70, "results": 85, "discussion": 88, "conclusion": 82, "conclusions": 82}
EXCLUDED = [
    "references", "bibliography", "acknowledgments", "acknowledgements", "funding", "competing interests", "author contributions", "data availability",
    "methods", "materials", "materials and methods", "supplementary", "appendix", "conflict of interest", "acknowledgement", "statistical analysis",
    "experimental setup", "datasets",
]
SECTION_CAP = {"abstract": 4000, "introduction": 6000, "background": 6000, "discussion": 6000, "conclusion": 6000, "conclusions": 6000}
OTHER_CAP = 7000
FALLBACK_KEYS = ["full text", "processing", "error", "publishing", "pdf", "fallback", "extraction"]
URL = r"https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"


@F.pandas_udf(T.StringType())
def _to_ascii(x: pd.Series) -> pd.Series:
    """Compatibility decomposition; what then isn't ASCII is left out."""
    return x.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"), na_action="ignore")


def to_ascii(x: Column) -> Column:
    ship_active()
    return _to_ascii(x)


def clean_ascii(x: Column) -> Column:
    """Clean ASCII text: spaces, blank lines, page numbers, stray captions, links, addresses and DOIs."""
    for pattern, by in (
        (r" +", " "),
        (r"\n\s*\n\s*\n+", "\n\n"),
        (r"\n\s*\d+\s*\n", "\n"),
        (r"\n\s*(Fig\.|Figure|Table|Supplementary)\s+\d+[A-Za-z]?\s*[:\.]?\s*\n", "\n"),
        (URL, ""),
        (r"\S+@\S+", ""),
        (r"(?i)doi:\s*\S+", ""),
        (r"^\s+|\s+$", ""),
    ):
        x = F.regexp_replace(x, pattern, by)
    return x


def clean_text(x: Column) -> Column:
    """Null becomes the empty text."""
    return F.coalesce(clean_ascii(to_ascii(x)), F.lit(""))


def cut_references(text: str | None) -> str:
    """``text`` up to its reference list: the first header in the order of REFERENCE_HEADERS, then dense numbered lines.

    The shortest suffix of more than five of the last fifty lines, over half of which look like references, is cut off.
    """
    if not text:
        return ""
    for header in REFERENCE_HEADERS:
        if m := re.search(header, text, re.I):
            text = text[: m.start()]
            break
    lines = text.split("\n")
    seen = hits = 0
    for i in range(len(lines) - 1, max(0, len(lines) - 50), -1):
        seen += 1
        hits += bool(re.search(r"^\s*\[\d+\]|\d+\.\s+\w+.*\(\d{4}\)", lines[i]))
        if seen > 5 and 2 * hits > seen:
            text = "\n".join(lines[:i])
            break
    return text.strip()


@F.pandas_udf(T.StringType())
def _remove_references(x: pd.Series) -> pd.Series:
    return x.map(cut_references)


def remove_references(x: Column) -> Column:
    ship_active()
    return _remove_references(x)


def _sampled(text: str, most: int) -> str:
    if len(text) <= most:
        return text
    head = int(most * 0.6)
    return f"{text[:head]}\n[...]\n{text[head - most :]}"


def join_sections(raw: str | None, reduce: bool = True, budget: int | None = None, blob_budget: int = 40000) -> str:
    """Text of a JSON list or object of sections, the weightier ones first, within a budget of characters.

    Unparseable JSON gives the empty text. A lone section that looks like a dump of the whole is cut to ``blob_budget``.
    """
    if not raw:
        return ""
    try:
        parsed = json.loads(raw)
    except ValueError:
        return ""
    if isinstance(parsed, list):
        parts = [[x] if isinstance(x, str) else list(x.values()) if isinstance(x, dict) else [] for x in parsed]
        return "\n\n".join(t for p in parts for t in p if isinstance(t, str))
    if not isinstance(parsed, dict) or not parsed:
        return ""
    if len(parsed) == 1:
        (key, blob), *_ = parsed.items()
        if any(w in key.lower() for w in FALLBACK_KEYS) or len(key) > 50:
            return blob[:blob_budget] + "\n" if isinstance(blob, str) and blob else ""
    ranked = []
    for key, value in parsed.items():
        low = key.lower()
        if not value or not isinstance(value, str) or any(w in low for w in EXCLUDED):
            continue
        weight = SECTION_WEIGHT.get(low, 50) + 15 * bool(re.search("theor|model|hypoth", low)) + 15 * bool(re.search("result|analysis", low))
        ranked.append((25 * bool(re.search("method|materials", low)) - weight, low, key, value))
    room = budget if budget is not None else 20000 if reduce else 50000
    out, used = [], 0
    for _, low, key, value in sorted(ranked, key=lambda r: r[:2]):
        if used >= room:
            break
        chunk = f"{key}\n{_sampled(value, SECTION_CAP.get(low, OTHER_CAP)) if reduce else value}\n\n"
        chunk = chunk[: room - used] if reduce else chunk
        out.append(chunk)
        used += len(chunk)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _assemble_sections(x: pd.Series) -> pd.Series:
    return x.map(join_sections)


@F.pandas_udf(T.StringType())
def _assemble_sections_whole(x: pd.Series) -> pd.Series:
    return x.map(lambda t: join_sections(t, reduce=False))


def assemble_sections(x: Column) -> Column:
    """``join_sections`` within the smaller budget."""
    ship_active()
    return _assemble_sections(x)


def assemble_sections_whole(x: Column) -> Column:
    """``join_sections`` of whole sections."""
    ship_active()
    return _assemble_sections_whole(x)


def preprocessed(full_text: Column, sections: Column, abstract: Column, reduce: bool = True) -> Column:
    """The text that annotators see: sections, else full text; with the abstract; without references; within budget.

    Null where neither is there or fewer than 100 characters are left.
    """
    own = F.nullif((assemble_sections if reduce else assemble_sections_whole)(sections), F.lit(""))
    headed = own.rlike(r"(?im)^\s*abstract\s*$")
    with_abstract = F.when(headed | (F.coalesce(abstract, F.lit("")) == ""), own).otherwise(F.concat(F.lit("Abstract\n"), abstract, F.lit("\n\n"), own))
    text = F.coalesce(with_abstract, F.nullif(full_text, F.lit("")))
    text = F.left(clean_text(remove_references(text)), F.lit(40000 if reduce else 50000))
    return F.when(F.length(F.trim(text)) >= 100, text)


def unfenced(x: Column) -> Column:
    """The content of the first ``` fence, else the text itself; trimmed."""
    inner = F.regexp_extract(x, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(x))


def trimmed_fence(x: Column) -> Column:
    """The other way with fences: a leading ```json or ``` and a trailing ``` are cut off, whatever stands between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), "^```json", ""), "^```", ""), "```$", ""))


def token_estimate(x: Column, reserve: int = 0) -> Column:
    """A quarter of the characters, plus what is reserved for the reply."""
    return F.floor(F.length(F.coalesce(x, F.lit(""))) / 4) + reserve


def concept_text(concepts: Column) -> Column:
    """'concept: description' of each named concept, joined by ' | '."""
    named = F.filter(concepts, lambda c: F.coalesce(c["concept"], F.lit("")) != "")
    return F.array_join(F.transform(named, lambda c: F.concat(c["concept"], F.lit(": "), F.coalesce(c["description"], F.lit("")))), " | ")


def enriched_text(name: Column, concepts: Column, description: Column) -> Column:
    """Name, concepts and description joined by '. ', blanks left out."""
    return F.concat_ws(". ", *[F.when(F.trim(x) != "", x) for x in (name, concept_text(concepts), description)])
