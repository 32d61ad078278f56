"""Name and label normalisers as column expressions. They differ on purpose; each serves one comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import ship_active

#: Words that the fuzzy key leaves out.
GENERIC = [
    "hypotheses", "hypothesis", "theories", "theory", "models", "model", "frameworks", "framework", "paradigms", "paradigm", "approaches", "approach", "concepts", "concept", "mechanisms", "mechanism",
    "aging", "ageing", "senescence",
]
CORE_STOP = ["of", "the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "with", "by"]
SUFFIXES = ["theory", "hypothesis", "model", "framework", "paradigm", "approach"]
ABBREVIATION = r"[A-Z]{2,6}[0-9]*"


#: White space of any kind, no-break and thin spaces among it.
WS = r"[\s\p{Z}]"


def strip(x: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def squeezed(x: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, f"{WS}+", " "))


def fuzzy_key(name: Column) -> Column:
    """Key of exact lookups: bracketed abbreviations, punctuation, possessives and generic words left out."""
    x = strip(F.lower(name))
    x = F.regexp_replace(x, WS + r"*[\(\[][a-z]{2,6}[0-9]*[\)\]]" + WS + "*", " ")
    x = F.regexp_replace(x, r"[-_/\\()\[\]{}]", " ")
    x = F.regexp_replace(x, r"[‘’]", "'")
    x = F.regexp_replace(squeezed(x), r"'s |s' ", " ")
    x = F.regexp_replace(squeezed(x), r"'s|s'", "")
    x = F.regexp_replace(x, r"\b(" + "|".join(GENERIC) + r")\b", "")
    return squeezed(F.regexp_replace(x, r"\b(of cellular|of|the|a|an)\b", ""))


def grouping_key_sql(name: Column) -> Column:
    """The grouping key before title case: upper-case abbreviations, 'ageing' and a trailing 'of aging' left out."""
    x = F.regexp_replace(strip(name), WS + r"*[\(\[]" + ABBREVIATION + r"[\)\]]" + WS + "*", " ")
    x = F.regexp_replace(x, r"(?i)\bageing\b", "aging")
    return squeezed(F.regexp_replace(x, "(?i)" + WS + "+of" + WS + "+aging" + WS + "*$", ""))


@F.pandas_udf(T.StringType())
def title_case(x: pd.Series) -> pd.Series:
    """Every letter after a non-letter in upper case, all others in lower case (initcap only looks at spaces)."""
    return x.str.title()


def grouping_key(name: Column) -> Column:
    ship_active()
    return title_case(grouping_key_sql(name))


def final_name(name: Column) -> Column:
    """Name as published: 'ageing' spelled 'aging'; a trailing 'of aging' goes unless a hallmark is meant."""
    x = F.regexp_replace(strip(name), r"(?i)\bageing\b", "aging")
    x = F.when(F.lower(name).contains("hallmark"), x).otherwise(F.regexp_replace(x, "(?i)" + WS + "+of" + WS + "+aging" + WS + "*$", ""))
    return F.when(name == "SINE Retrotransposon Activation Theory", "Retrotransposon Activation Theory").otherwise(squeezed(x))


def clustering_key(name: Column) -> Column:
    """Key for comparing cluster names: lower case, no punctuation, no generic word, 'aging'."""
    x = F.regexp_replace(F.lower(name), r"[^\w\s]", "")
    x = F.regexp_replace(x, r"\b(theory|hypothesis|model|framework|the)\b", "")
    return squeezed(F.replace(x, F.lit("ageing"), F.lit("aging")))


def voting_key(name: Column) -> Column:
    """Key under which mappings are voted on: trailing dots and British spellings left out."""
    x = F.rtrim(strip(name), F.lit("."))
    for a, b in (("Signalling", "Signaling"), ("signalling", "signaling"), ("Ageing", "Aging"), ("ageing", "aging")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return squeezed(x)


def doi_key(doi: Column) -> Column:
    """DOI for comparisons: trimmed, lower case, without a resolver's prefix; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(strip(doi)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", ""), F.lit(""))


def doi_of_file(file_name: Column) -> Column:
    """The DOI that a file is named after: base name without its last extension, the first underscore a slash."""
    base = F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*$", "")
    return F.lower(strip(F.regexp_replace(base, r"^([^_]+)_", "$1/")))


def strip_batch_suffix(name: Column) -> Column:
    """'X (Batch 3)' as 'X'."""
    return F.regexp_replace(name, "(?i)" + WS + r"*\(Batch\s+[0-9]+\)" + WS + "*$", "")


def file_name(name: Column) -> Column:
    """Name fit for a file: slashes and spaces as underscores, colons left out."""
    return F.replace(F.translate(name, "/ ", "__"), F.lit(":"), F.lit(""))


def abbreviations(name: Column) -> Column:
    """All abbreviations in round or square brackets, in order; a bare upper-case name is none."""
    return F.regexp_extract_all(name, F.lit(r"[\(\[](" + ABBREVIATION + r")[\)\]]"), F.lit(1))


def core_tokens(name: Column) -> Column:
    """The distinct words of the fuzzy key that carry meaning, sorted."""
    x = fuzzy_key(name)
    for s in SUFFIXES:
        x = F.replace(x, F.lit(s), F.lit(""))
    return F.array_sort(F.array_distinct(F.filter(F.split(x, " "), lambda t: (F.length(t) > 2) & ~t.isin(CORE_STOP))))


def confidence_level(label: Column) -> Column:
    """high, medium, low or unknown of a free confidence label; two levels count as the lower one."""
    s = F.lower(strip(label))
    head = strip(F.split_part(s, F.lit("("), F.lit(1)))
    has = {w: s.contains(w) for w in ("high", "medium", "low")}
    return (
        F.when(s.isNull() | (s == ""), "unknown")
        .when(s.isin("high", "medium", "low", "unknown"), s)
        .when(s.contains("(") & head.isin("high", "medium", "low"), head)
        .when(has["high"] & has["medium"], "medium")
        .when(has["low"] & (has["medium"] | has["high"]), "low")
        .when(has["high"], "high")
        .when(has["medium"], "medium")
        .when(has["low"], "low")
        .when(s.contains("classical") | s.contains("established"), "high")
        .otherwise("unknown")
    )


def focus(value: Column) -> Column:
    """Paper focus 0..10 of a free value: its first one or two digits, at most 10; 0 where there are none."""
    digits = F.regexp_extract(value.cast("string"), r"([0-9]{1,2})", 1)
    return F.least(F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(0)), F.lit(10))


def falsy(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def answer_option(answer: Column, options: Column, question: Column, extended: tuple[str, ...] = ("aging_biomarker",)) -> Column:
    """The allowed option that a free answer means, else null. Questions with extended options take exact answers only.

    Tried in order: the answer itself; what stands before ``, ; ( [ - :`` or before but, however, although, compared
    without case; an option at the answer's start.
    """
    a = strip(answer)
    picks = []
    for d in (",", ";", "(", "[", "-", ":"):
        head = F.regexp_replace(strip(F.split_part(a, F.lit(d), F.lit(1))), r"\)+$", "")
        picks.append(F.when(a.contains(d), _option(head, options)))
    for d in ("but", "however", "although"):
        head = F.regexp_replace(strip(F.split_part(a, F.lit(f" {d} "), F.lit(1))), r"\)+$", "")
        picks.append(F.when(F.lower(a).contains(d), _option(head, options)))
    start = F.element_at(F.filter(options, lambda o: F.lower(a).startswith(F.lower(o))), 1)
    exact = F.when(F.array_contains(options, a), a)
    free = F.when(~question.isin(*extended), F.coalesce(*picks, F.when(F.size(F.filter(options, lambda o: F.lower(a).startswith(F.lower(o)))) > 0, start)))
    return F.when(F.coalesce(a, F.lit("")) != "", F.coalesce(exact, free))


def _option(head: Column, options: Column) -> Column:
    same = F.filter(options, lambda o: F.lower(o) == F.lower(head))
    return F.when(F.array_contains(options, head), head).when(F.size(same) > 0, same[0])


def scored_answer(answer: Column) -> Column:
    """Answer as scored: the two shades of yes count as Yes."""
    a = strip(answer)
    return F.when(a.contains("Yes, quantitatively shown") | a.contains("Yes, but not shown"), "Yes").otherwise(a)
