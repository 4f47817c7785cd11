"""Small text helpers shared by the column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.rules import formats


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def found_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any script."""
    return F.regexp_replace(text, f"^{formats.WHITESPACE}+|{formats.WHITESPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Collapse runs of white space into one blank and strip."""
    return F.trim(F.regexp_replace(text, f"{formats.WHITESPACE}+", " "))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return found_all(text, formats.WORD)


def strings(values) -> Column:
    """An array literal of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """A map literal lookup; missing keys give the default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    value = F.try_element_at(F.create_map(*pairs), key)
    return value if default is None else F.coalesce(value, F.lit(default))


def first_match(text: Column, rules, flags: str = "(?i)") -> Column:
    """Name of the first (name, regex) rule found in the text, else null."""
    out = F.lit(None).cast("string")
    for name, regex in reversed(list(rules)):
        out = F.when(text.rlike(flags + regex), F.lit(name)).otherwise(out)
    return out


def count_of(text: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a fixed string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit(""))))
            / len(needle)).cast("bigint")


def contains_any(text: Column, needles) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def bound(value: Column, use) -> Column:
    """``use`` of a costly value that it names several times; as an element of a list it is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_sign(text: Column, sign) -> Column:
    """Whether a text holds one of some fixed strings (a tuple) or a match of a regex (a string)."""
    return contains_any(text, sign) if isinstance(sign, tuple) else text.rlike(sign)


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns that later filters must not repeat.

    A filter on a plain projected column is pushed below the projection with the whole
    expression copied into it.  One generated row per input row keeps the value instead.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*kept, F.inline(F.array(row)).alias(*columns))
