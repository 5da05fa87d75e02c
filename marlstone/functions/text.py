"""Scalar functions over texts: normal forms, relations, statistics of one text. All are Columns; none needs Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VOWELS = "[aeiouy]+"


def normalize(text: Column) -> Column:
    """Lower case, outer blanks gone, white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0))


def count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def path_typo(failed: Column, success: Column, most: int = 2) -> Column:
    """Whether two paths differ like a typo: the same folder and names of a small distance, or one name in two folders."""
    same_dir, same_name = dirname(failed) == dirname(success), basename(failed) == basename(success)
    return (failed != success) & ((same_dir & (F.levenshtein(basename(failed), basename(success)) <= most)) | (~same_dir & same_name))


def token_estimate(text: Column) -> Column:
    """Estimated tokens: 3.2 characters for JSON, 3.5 for code, 4 for prose; 0 for nothing, else 1 at least."""
    ratio = F.when(F.trim(text).rlike(r"^[\[{]"), 3.2).when(text.rlike(r"(?m)^\s*(def|class|import|function|const|func|fn) "), 3.5).otherwise(4.0)
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / ratio + 0.5))).cast("long")


def anonymized(query: Column) -> Column:
    """field:value and field=value with a star for the value; null for an empty query."""
    out = F.regexp_replace(query, "([A-Za-z0-9_]+)[=:](?:\"[^\"]*\"|'[^']*'|[A-Za-z0-9_]+)", "$1:*")
    return F.nullif(F.nullif(out, F.lit("")), F.lit("*"))


def query_operator(query: Column) -> Column:
    out = F.lit("=")
    for op in ("contains", "<", ">", "<=", ">=", "!="):
        out = F.when(F.lower(query).contains(op), op).otherwise(out)
    return out


def sanitized_name(name: Column, longest: int = 40) -> Column:
    """A name of letters, digits, dots, dashes and underscores; "unknown" if nothing is left."""
    out = F.substring(F.regexp_replace(F.regexp_replace(F.trim(name), "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""), 1, longest)
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("unknown"))


def escaped_label(value: Column) -> Column:
    """A label value of the Prometheus text format."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return value


def syllables(word: Column) -> Column:
    """Vowel groups, one fewer for a final e, at least one."""
    return F.greatest(F.lit(1), count(word, VOWELS) - F.when(word.rlike("[^aeiouy]e$") & (count(word, VOWELS) > 1), 1).otherwise(0))


def flesch(words: Column, sentences: Column, syllables_: Column) -> tuple[Column, Column]:
    """(reading ease from 0 to 100, grade level)."""
    a, b = words / F.greatest(sentences, F.lit(1)), syllables_ / F.greatest(words, F.lit(1))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * a - 84.6 * b)), 0.39 * a + 11.8 * b - 15.59


# Coefficients of Abramowitz and Stegun 7.1.26.
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, to about 1e-7."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = sum((c * F.pow(t, F.lit(i + 1)) for i, c in enumerate(_ERF)), F.lit(0.0))
    return F.when(x >= 0, 1 - poly * F.exp(-z * z) / 2).otherwise(poly * F.exp(-z * z) / 2)


def error_category(text: Column) -> Column:
    """The first category whose words a text names; other."""
    low = F.lower(text)
    cases = {"timeout": "timeout|timed out", "permission": "permission|denied|forbidden", "not_found": "not found|no such file|does not exist", "syntax": "syntax|parse|unexpected token", "network": "connection|network|refused", "memory": "out of memory|oom"}
    out = F.lit("other")
    for name, pattern in reversed(cases.items()):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out
