"""Text expressions: labels, answer keys, questions, replies, JSON in free text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import _c

# Default texts of a yes/no question.
YES_TEXT = "Yes, the condition holds."
NO_TEXT = "No, the condition does not hold."


def humanize(col) -> Column:
    return F.trim(F.replace(_c(col), F.lit("_"), F.lit(" ")))


def entity_key(col) -> Column:
    """Option key of a class name: humanised, lower case, spaces as underscores."""
    return F.replace(F.lower(humanize(col)), F.lit(" "), F.lit("_"))


def answer_key(col) -> Column:
    """Key of a free answer: letters and digits of any script kept, the rest underscores, 40 characters at most."""
    raw = F.regexp_replace(F.lower(F.trim(_c(col))), r"[^\p{L}\p{N}]", "_")
    key = F.substring(F.regexp_replace(raw, "^_+|_+$", ""), 1, 40)
    return F.when(key == "", F.lit("empty")).otherwise(key)


def passage_question(col) -> Column:
    """One question mark at the end, first letter in upper case."""
    q = F.concat(F.regexp_replace(F.trim(_c(col)), r"\?+$", ""), F.lit("?"))
    return F.concat(F.upper(F.substring(q, 1, 1)), q.substr(F.lit(2), F.length(q)))


def outermost_json(col) -> Column:
    """The text from the first { to the last }, or null when that is not valid JSON."""
    body = F.regexp_extract(_c(col), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def reply_label(reply, labels) -> Column:
    """First token of a reply that is one of the offered labels (letters, or two-digit codes); null if none is."""
    text = F.trim(F.coalesce(_c(reply), F.lit("")))
    letters = F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z])\b"), F.lit(1))
    codes = F.regexp_extract_all(text, F.lit(r"\b(\d{2})\b"), F.lit(1))
    tokens = F.when(F.get(_c(labels), F.lit(0)).rlike("^[A-Z]$"), letters).otherwise(codes)
    return F.get(F.filter(tokens, lambda t: F.array_contains(_c(labels), t)), F.lit(0))


def lettered_options(col) -> Column:
    """['A) text', ...] as entries (key, text); strings without a letter A to E in front are left out."""
    entries = F.transform(_c(col), lambda s: F.struct(
        F.regexp_extract(s, r"^\s*([A-E])\s*\)\s*(.*)", 1).alias("key"),
        F.trim(F.regexp_extract(s, r"^\s*([A-E])\s*\)\s*(.*)", 2)).alias("text")))
    return F.filter(entries, lambda e: e["key"] != "")


def camel(col) -> Column:
    """snake_case as camelCase."""
    words = F.split(_c(col), "_")
    return F.concat(F.get(words, F.lit(0)),
                    F.array_join(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                                             lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), ""))


def pretty_json(col) -> Column:
    """JSON text indented by one space, non-ASCII characters kept; text that is not JSON becomes a JSON string.

    to_json has no such layout, so this one expression runs in Arrow batches. The function is nested, which ships it to the
    workers by value.
    """
    def layout(states: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            try:
                value = json.loads(s)
            except ValueError:
                value = s
            return json.dumps(value, ensure_ascii=False, indent=1)
        return states.map(one)
    return F.pandas_udf(layout, T.StringType())(_c(col))
