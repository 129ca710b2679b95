"""Column-level text helpers (JVM-side built-ins only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a maximal run of letters or digits, lower-cased.  The same
# pattern is used by the SQL oracles (RE2 and java.util.regex agree on it).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


TOKEN_RE = r"[\p{L}\p{N}]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased word tokens of a text as ``array<string>`` (all maximal
    runs of letters/digits: the same list as splitting on TOKEN_SPLIT and
    dropping empty pieces, without an interpreted lambda)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_RE), 0)


def token_count(text: Column | str) -> Column:
    """Number of tokens of a text without materializing them."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.lower(c), F.lit(TOKEN_RE))


def sql_tokens(expr: str) -> str:
    """DuckDB twin of :func:`tokens` (for oracles)."""
    return (f"list_filter(string_split_regex(lower({expr}), '{TOKEN_SPLIT}'), "
            f"lambda x: x <> '')")
