"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a hedged statement.
HEDGES = ["possibly", "potentially", "could", "might", "may ", "in theory", "perhaps", "seems", "appears to"]
# Lengths of hexadecimal digests that are never secrets.
DIGEST_LENGTHS = [32, 40, 56, 64, 96, 128]
LINE_END = "\r\n|[\n\u000b\u000c\r\u001c-\u001e\u0085  ]"


def as_col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines_of(text: str | Column) -> Column:
    """Lines of a text; a final line end makes no further line. Null or empty: no lines."""
    text = as_col(text)
    body = F.regexp_replace(text, f"(?:{LINE_END})\\z", "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def n_lines_of(text: str | Column) -> Column:
    """How many lines a text has. Where it has no line end but the newline, these are counted without making the lines."""
    text = as_col(text)
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    plain = newlines + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    return F.when(text.isNull() | (text == ""), 0).when(text.rlike(LINE_END.split("|")[1].replace("\n", "")), F.size(lines_of(text))).otherwise(plain)


def squeezed(x: str | Column) -> Column:
    """White space runs as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(as_col(x), r"\s+", " "))


def hedged(x: str | Column) -> Column:
    low = F.lower(as_col(x))
    out = F.lit(False)
    for word in HEDGES:
        out = out | low.contains(word)
    return out


def entropy(token: str | Column) -> Column:
    """Shannon entropy of the characters in bits; empty: 0."""
    token = as_col(token)
    chars = F.regexp_extract_all(token, F.lit("(?s)."), 0)
    n = F.size(chars).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(token) == 0, 0.0).otherwise(-F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def is_digest(token: str | Column) -> Column:
    token = as_col(token)
    return F.length(token).isin(DIGEST_LENGTHS) & token.rlike("^[0-9A-Fa-f]+$")


def placeholder(label: str, value: str | Column) -> Column:
    """``<LABEL_6hex>``, filled with stars to the value's length where that is longer."""
    value = as_col(value)
    base = F.concat(F.lit(f"<{label.upper()}_"), F.substring(F.sha2(value.cast("binary"), 256), 1, 6), F.lit(">"))
    return F.rpad(base, F.greatest(F.length(base), F.length(value)), "*")


def slug(title: str | Column, category: str | Column) -> Column:
    """At most 60 characters of lower-case letters, digits and single dashes; ``finding`` if nothing is left."""
    base = F.lower(F.coalesce(F.nullif(as_col(title), F.lit("")), as_col(category)))
    short = F.substring(F.regexp_replace(F.regexp_replace(base, "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("finding"))


def numbered(line_no: str | Column, line: str | Column) -> Column:
    return F.concat(F.lpad(as_col(line_no).cast("string"), 6, " "), F.lit(" | "), as_col(line))
