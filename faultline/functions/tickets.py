"""Expressions over ticket text: keywords, app, priority, steps, symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import (as_col, bound, contains_any, count_of, first_match, found, found_all,
                                      lookup, strings, strip, words)
from faultline.rules import formats, vocab


def _terms_if(condition: Column, terms) -> Column:
    return F.when(condition, strings(terms)).otherwise(strings([]))


def ticket_text(summary, description, labels=None) -> Column:
    """Summary, description and labels as one text."""
    text = F.concat(as_col(summary), F.lit(" "), as_col(description))
    if labels is None:
        return text
    labels = as_col(labels)
    return F.when(F.size(labels) > 0, F.concat(text, F.lit(" "), F.array_join(labels, " "))).otherwise(text)


def intake_keywords(text: Column | str) -> Column:
    """Sorted technical keywords: phrases, component names, codes, quoted identifiers, priority."""
    text = as_col(text)
    lower = F.lower(text)
    parts = [_terms_if(lower.contains(p), t) for p, t in vocab.INTAKE_PHRASES.items()]
    parts.append(F.array_intersect(words(lower), strings(vocab.INTAKE_COMPONENTS)))
    parts += [_terms_if(text.rlike(p), t) for p, t in vocab.INTAKE_CODES]
    quoted = found_all(text, r"""["`]([^"`]{3,50})["`]""", 1)
    parts.append(F.transform(F.filter(quoted, lambda q: q.rlike(r"^[\p{L}\p{N}_:/\-.]+$")), F.lower))
    parts.append(_terms_if(text.rlike(r"\bP0\b|\bP1\b"), ["critical"]))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def context_keywords(text: Column | str, top_k: int = 10) -> Column:
    """Weighted technical keywords, heaviest first, then by name."""
    def terms(tokens):
        parts = [_terms_if(F.array_contains(tokens, t), k) for t, k in vocab.CONTEXT_TERMS.items()]
        return F.concat(*parts, F.array_intersect(tokens, strings(vocab.KEYWORD_WEIGHTS)))

    ranked = F.array_sort(F.transform(
        F.array_distinct(bound(words(F.lower(as_col(text))), terms)),
        lambda k: F.struct((-keyword_weight(k)).alias("w"), k.alias("k"))))
    return F.transform(F.slice(ranked, 1, top_k), lambda s: s["k"])


def keyword_weight(keyword: Column) -> Column:
    return lookup(vocab.KEYWORD_WEIGHTS, keyword, vocab.DEFAULT_KEYWORD_WEIGHT)


def engine_keywords(text: Column | str) -> Column:
    """Sorted terms of every phrase contained in the text."""
    lower = F.lower(as_col(text))
    parts = [_terms_if(lower.contains(p), t) for p, t in vocab.ENGINE_PHRASES.items()]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def seed_keywords(text: Column | str, limit: int = 20) -> Column:
    """Lower-cased all-letter words of four letters or more, the first ``limit``."""
    parts = F.split(as_col(text), f"{formats.WHITESPACE}+")
    return F.transform(F.slice(F.filter(parts, lambda w: w.rlike(r"^\p{L}{4,}$")), 1, limit), F.lower)


def detect_app(text: Column | str) -> Column:
    return first_match(F.lower(as_col(text)), vocab.APP_PATTERNS, flags="")


def ticket_priority(priority: Column | str) -> Column:
    name = F.upper(F.coalesce(F.nullif(as_col(priority), F.lit("")), F.lit("P2")))
    return F.when(name.isin("P0", "P1", "P2", "P3"), name).otherwise(
        lookup(vocab.PRIORITY_NAMES, name, "P2"))


def issue_priority(name: Column | str) -> Column:
    return lookup(vocab.ISSUE_PRIORITY_NAMES, F.coalesce(as_col(name), F.lit("")), "P2")


def repro_step(text: Column | str) -> Column:
    """One step text as a struct (action, argument, seconds, description)."""
    text = strip(as_col(text))
    lower = F.lower(text)
    app = F.when(lower.contains("launch"), found(text, r"(?i)launch\s+([\p{L}\p{N}_]+)"))
    key = F.when(lower.contains("press") | lower.contains("key"),
                 found(text, r"(?i)(?:press|key)\s+([\p{L}\p{N}_]+)"))
    key = F.concat(F.upper(F.left(key, F.lit(1))), F.lower(F.substring(key, 2, 1 << 20)))
    seconds = F.coalesce(found(text, r"(?i)(\d+)\s*(?:sec|second)").try_cast("bigint"), F.lit(5))
    wait = F.when(lower.contains("wait"), seconds).otherwise(F.lit(2)).cast("bigint")
    is_wait = app.isNull() & key.isNull()
    return F.struct(
        F.when(app.isNotNull(), "launch_app").when(key.isNotNull(), "send_key").otherwise("wait").alias("action"),
        F.coalesce(app, key).alias("argument"),
        F.when(is_wait, wait).alias("seconds"),
        text.alias("description"),
    )


def parse_repro_steps(tickets: DataFrame, ticket_id: str = "ticket_id", steps: str = "repro_steps",
                      app: str = "streaming_app") -> DataFrame:
    """One row per step; tickets without steps get the default exploration steps."""
    def default(action, argument, seconds, description):
        return F.struct(F.lit(action).alias("action"), argument.alias("argument"),
                        F.lit(seconds).cast("bigint").alias("seconds"), description.alias("description"))

    none = F.lit(None).cast("string")
    app_col = F.col(app)
    with_app = F.array(
        default("launch_app", app_col, None, F.concat(F.lit("Launch "), app_col)),
        default("wait", none, 10, F.lit("Wait for app to load and error to manifest")))
    without = F.array(default("wait", none, 5, F.lit("Wait for error to manifest")))
    explicit = F.coalesce(F.size(F.col(steps)) > 0, F.lit(False))
    return tickets.select(
        F.col(ticket_id),
        F.when(explicit, "DETERMINISTIC").otherwise("EXPLORATORY").alias("strategy"),
        F.posexplode(F.when(explicit, F.transform(F.col(steps), repro_step))
                     .when(app_col.isNotNull(), with_app).otherwise(without)).alias("step_no", "step"),
    ).select(ticket_id, "strategy", "step_no", "step.*")


def firmware_compatible(device: Column | str, required: Column | str) -> Column:
    device, required = as_col(device), as_col(required)
    minor = r"^(\d+\.\d+)"
    same = found(device, minor) == found(required, minor)
    return (F.coalesce(required, F.lit("")) == "") | F.coalesce(device == required, F.lit(False)) \
        | F.coalesce(same, F.lit(False))


def api_version(version: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("v"), found(as_col(version), r"^(\d+\.\d+)")), F.lit("v3.0"))


def code_symbols(text: Column | str, files: Column | str | None = None) -> Column:
    """Sorted distinct function, class and file names named in a text, with the given files."""
    text = as_col(text)
    parts = [found_all(text, p, 1) for p in
             (formats.SYMBOL_CALL, formats.SYMBOL_CLASS, formats.SYMBOL_FILE)]
    if files is not None:
        parts.append(F.coalesce(as_col(files), strings([])))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def target_error_present(text: Column | str, category: Column | str, table: str = "device") -> Column:
    """Whether any keyword of the category occurs in the text, ignoring case."""
    rules = vocab.TARGET_ERRORS_DEVICE if table == "device" else vocab.TARGET_ERRORS_BROWSER
    lower, category = F.lower(as_col(text)), as_col(category)
    out = F.lit(False)
    for name, needles in rules.items():
        out = out | (F.coalesce(category == name, F.lit(False))
                     & contains_any(lower, [n.lower() for n in needles]))
    return out


def error_present(text: Column | str, matched: Column | str) -> Column:
    """A matched pattern name occurs in the text, or any generic error word does."""
    lower = F.lower(as_col(text))
    named = F.exists(F.coalesce(as_col(matched), strings([])), lambda p: F.contains(lower, F.lower(p)))
    return named | contains_any(lower, vocab.GENERIC_ERROR_WORDS)


def count_errors(text: Column | str, matched: Column | str) -> Column:
    """Occurrences of the matched names plus ``error``, ``exception`` and ``fatal``."""
    lower = F.lower(as_col(text))
    named = F.aggregate(
        F.coalesce(as_col(matched), strings([])), F.lit(0).cast("bigint"),
        lambda acc, p: acc + F.when(F.length(p) > 0, (
            (F.length(lower) - F.length(F.replace(lower, F.lower(p), F.lit("")))) / F.length(p)
        ).cast("bigint")).otherwise(F.lit(0)))
    return named + count_of(lower, "error") + count_of(lower, "exception") + count_of(lower, "fatal")


def is_log_file(name: Column | str) -> Column:
    """Extension or name looks like a log."""
    base = F.lower(F.regexp_extract(as_col(name), r"([^/]*)$", 1))
    extension = F.regexp_extract(base, r"[^.](\.[^.]+)$", 1)
    return extension.isin(formats.LOG_EXTENSIONS) | base.rlike(formats.LOG_NAME)


def is_binary(content: Column | str) -> Column:
    """Fewer than 70 % of the bytes are printable ASCII, tab, newline or return."""
    content = as_col(content)
    size = F.octet_length(content)
    printable = F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit(r"[\x09\x0a\x0d\x20-\x7e]"))
    return (size > 0) & (printable / F.greatest(size, F.lit(1)) < 0.70)


def fix_description(description, layer, category, strategy, files, root_cause) -> Column:
    """Searchable text of a fix record."""
    return F.concat(
        F.lit("Bug: "), as_col(description), F.lit(" Layer: "), as_col(layer),
        F.lit(" Category: "), as_col(category), F.lit(" Strategy: "), as_col(strategy),
        F.lit(" Files: "), F.array_join(F.slice(as_col(files), 1, 5), " "),
        F.lit(" Root cause: "), F.left(as_col(root_cause), F.lit(200)))


def correction_text(description, what_went_wrong, correct_approach, lesson) -> Column:
    """Searchable text of a correction record."""
    return F.concat(
        F.lit("CORRECTION: "), as_col(description), F.lit("\nMISTAKE: "), as_col(what_went_wrong),
        F.lit("\nCORRECT APPROACH: "), as_col(correct_approach), F.lit("\nLESSON: "), as_col(lesson))
