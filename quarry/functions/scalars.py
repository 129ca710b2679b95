"""Scalar column functions (ops 13-34).

All are compositions of built-in expressions, so they stay inside
whole-stage codegen; vector maths uses higher-order array functions
(``aggregate``, ``zip_with``, ``transform``) evaluated in double precision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ vectors
def sq_norm(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(v) -> Column:
    """Op 13: v / ||v||; a zero vector is returned unchanged (norm taken as 1).
    ``v`` and its norm are bound by a transform over one element each, so both
    are computed once per row, not once per component."""
    def scaled(a: Column) -> Column:
        n = F.sqrt(sq_norm(a))
        d = F.when(n == 0, F.lit(1.0)).otherwise(n)
        return F.get(F.transform(F.array(d), lambda m: F.transform(a, lambda x: x.cast("double") / m)), F.lit(0))
    return F.get(F.transform(F.array(_c(v)), scaled), F.lit(0))


def truncate_dims(v, k: int) -> Column:
    """Op 14: keep the first k dims when 0 < k < len(v), then renormalize."""
    c = _c(v)
    cut = l2_normalize(F.slice(c, 1, k))
    return F.when((F.lit(k) > 0) & (F.lit(k) < F.size(c)), cut).otherwise(
        F.transform(c, lambda x: x.cast("double")))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def cosine(a, b) -> Column:
    """Op 15: dot / (|a| |b|); NaN for null, empty, unequal-length or zero-norm input."""
    a, b = _c(a), _c(b)
    na, nb = F.sqrt(sq_norm(a)), F.sqrt(sq_norm(b))
    bad = (a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b))
           | (na == 0) | (nb == 0))
    return F.when(bad, F.lit(float("nan"))).otherwise(dot(a, b) / (na * nb))


def kendall_tau(a, b) -> Column:
    """Op 16: (concordant - discordant) / (n(n-1)/2) on two equal-length rankings.

    Evaluated inside the row with nested ``aggregate`` (O(n^2), n is a
    rerank list).  NaN when n < 2, lengths differ or an input is null.
    """
    a, b = _c(a), _c(b)
    n = F.size(a)

    def inner(i):
        return F.aggregate(
            F.sequence(i + 1, n - 1), F.lit(0).cast("long"),
            lambda acc, j: acc + (F.signum(a[i] - a[j]) * F.signum(b[i] - b[j])).cast("long"))

    s = F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0).cast("long"),
                    lambda acc, i: acc + inner(i))
    bad = a.isNull() | b.isNull() | (n < 2) | (n != F.size(b))
    return F.when(bad, F.lit(float("nan"))).otherwise(s.cast("double") / (n * (n - 1) / 2.0))


# ------------------------------------------------------------------ text
def clip_text(text, max_tokens: int = 8192) -> Column:
    """Op 17: character guard, first ``max_tokens * 4`` characters."""
    return F.substring(_c(text), 1, max_tokens * 4)


def approx_tokens(text) -> Column:
    """Op 18: max(1, floor(len / 4)) per text."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(_c(text)) / 4).cast("long"))


# The instruction prepended to queries for the instruction-
# tuned embedding family, and the model-name markers that select it.
QUERY_INSTRUCTION = ("Instruct: Given a web search query, retrieve relevant passages that "
                     "answer the query\nQuery: ")
QUERY_PREFIX_MODELS = ("qwen3", "octen")


def query_prefix(text, model, input_type) -> Column:
    """Op 19: prepend the instruction only for queries of the marked models."""
    m = F.lower(_c(model))
    hit = F.lit(False)
    for marker in QUERY_PREFIX_MODELS:
        hit = hit | (F.instr(m, marker) > 0)
    return F.when((_c(input_type) == "query") & hit,
                  F.concat(F.lit(QUERY_INSTRUCTION), _c(text))).otherwise(_c(text))


def sigmoid(x) -> Column:
    """Op 20."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


# ------------------------------------------------------------------ money
WEI_PER_GWEI = 10 ** 9


def gwei_to_wei(g) -> Column:
    """Op 21: exact, in decimal(38,0)."""
    return _c(g).cast("decimal(38,0)") * F.lit(WEI_PER_GWEI).cast("decimal(38,0)")


def wei_to_gwei(w) -> Column:
    """Op 21: floor division, back to long."""
    return F.floor(_c(w) / F.lit(WEI_PER_GWEI).cast("decimal(38,0)")).cast("long")


def float_to_bps(f) -> Column:
    """Op 21: fraction in 0..1 -> basis points 0..10000 (rounded)."""
    return F.round(F.least(F.greatest(_c(f), F.lit(0.0)), F.lit(1.0)) * 10000).cast("int")


def bps_to_float(b) -> Column:
    return _c(b).cast("double") / 10000.0


def split_slash(locked, fraction) -> tuple[Column, Column]:
    """Op 22: slashed = round(locked * f) half away from zero; returned = rest."""
    slashed = F.round(_c(locked).cast("double") * _c(fraction)).cast("long")
    return slashed, _c(locked) - slashed


MAX_COMBINED_TAX = 0.5


def split_tax(value, net_rate, pool_rate) -> dict[str, Column]:
    """Op 23: each tax rounded, paid is the rest; status flags the errors."""
    v = _c(value)
    net = F.round(v.cast("double") * _c(net_rate)).cast("long")
    pool = F.round(v.cast("double") * _c(pool_rate)).cast("long")
    paid = v - net - pool
    status = (F.when(_c(net_rate) + _c(pool_rate) > MAX_COMBINED_TAX, F.lit("tax_cap_exceeded"))
              .when(paid <= 0, F.lit("tax_rates_too_high")).otherwise(F.lit("ok")))
    return {"network_tax": net, "pool_tax": pool, "paid": paid, "status": status}


def split_tax_bps(gross, bps) -> dict[str, Column]:
    """Op 24: integer form, floor(gross * bps / 10000); the rest by subtraction."""
    g = _c(gross).cast("decimal(38,0)")
    tax = F.floor(g * _c(bps).cast("decimal(38,0)") / F.lit(10000).cast("decimal(38,0)")).cast(
        "decimal(38,0)")
    return {"tax": tax, "net": (g - tax).cast("decimal(38,0)")}


# ------------------------------------------------------------------ audit
def severity(similarity, threshold) -> Column:
    """Op 25: max(0, (t - s) / t)."""
    t = _c(threshold)
    return F.greatest(F.lit(0.0), (t - _c(similarity)) / t)


def slash_fraction(sev, audited=None) -> Column:
    """Op 26: piecewise fraction; unaudited (or null severity) -> 0."""
    s = _c(sev)
    f = (F.when(s.isNull() | (s <= 0), F.lit(0.0))
         .when(s < 0.3, s)
         .when(s < 0.7, F.lit(0.5) + s / 2)
         .otherwise(F.lit(1.0)))
    if audited is not None:
        f = F.when(_c(audited), f).otherwise(F.lit(0.0))
    return f


# Similarity thresholds per declared precision.
EMBEDDING_THRESHOLD = {"fp32": 0.9999, "fp16": 0.999, "int8": 0.99}
RERANK_THRESHOLD = 0.95


def audit_threshold(category, precision) -> Column:
    """Op 27: threshold by category and declared precision (null if unknown)."""
    p = F.lower(_c(precision))
    emb = F.lit(None).cast("double")
    for k in ("int8", "fp16", "fp32"):
        emb = F.when(p == k, F.lit(EMBEDDING_THRESHOLD[k])).otherwise(emb)
    return (F.when(_c(category) == "rerank", F.lit(RERANK_THRESHOLD))
            .when(_c(category) == "embedding", emb))


# ------------------------------------------------------------------ review
# Critical-file and test-file patterns, extension -> language.
CRITICAL_FILE_RE = (r"(^|/)(main\.go|main\.py|index\.js|Makefile|Dockerfile|package\.json|\.env)$"
                    r"|(^|/)(config\.[^/]*|docker-compose\.[^/]*)$|(^|/)(systemd|scripts)/")
TEST_FILE_RE = (r"(_test\.go$)|(\.test\.js$)|(\.spec\.js$)|(\.test\.ts$)|(\.spec\.ts$)"
                r"|((^|/)test_[^/]*\.py$)|(/tests?/)|(^tests?/)|(__test__)")
CONFIG_FILE_RE = (r"(^|/)(Makefile|Dockerfile|package\.json|\.env)$|(^|/)(config\.[^/]*|docker-compose\.[^/]*)$"
                  r"|\.(ya?ml|toml|ini|json)$")
EXT_LANGUAGE = {
    "go": "Go", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++",
    "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript",
    "py": "Python", "java": "Java", "rs": "Rust", "rb": "Ruby", "php": "PHP", "cs": "C#",
    "swift": "Swift", "kt": "Kotlin", "zig": "Zig", "nim": "Nim", "cr": "Crystal",
}


def path_extension(path) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))


def language_of(path) -> Column:
    m = F.create_map(*[x for kv in EXT_LANGUAGE.items() for x in map(F.lit, kv)])
    return F.coalesce(F.element_at(m, path_extension(path)), F.lit("unknown"))


def classify_path(path) -> dict[str, Column]:
    """Op 28: test-file flag, critical-file flag, language from the extension."""
    p = _c(path)
    return {"is_test": p.rlike(TEST_FILE_RE), "is_critical": p.rlike(CRITICAL_FILE_RE),
            "language": language_of(p)}


def file_kind(path) -> Column:
    """Op 28: ``test``, ``config`` or ``production`` file."""
    p = _c(path)
    return (F.when(p.rlike(TEST_FILE_RE), "test").when(p.rlike(CONFIG_FILE_RE), "config")
            .otherwise("production"))


def complexity_score(lines, files, funcs) -> Column:
    return _c(lines) + 5 * _c(files) + 10 * _c(funcs)


def complexity_level(lines, files, funcs) -> Column:
    """Op 29: score = lines + 5 files + 10 functions; levels at 50 / 150 / 300."""
    s = complexity_score(lines, files, funcs)
    return F.when(s < 50, 1).when(s < 150, 2).when(s < 300, 3).otherwise(4)


def parse_verdict(text) -> dict[str, Column]:
    """Op 30: VERDICT / CONFIDENCE / SEVERITY / RATIONALE block -> columns."""
    t = _c(text)

    def grab(key, pat):
        v = F.regexp_extract(t, rf"(?m)^\s*{key}:\s*({pat})\s*$", 1)
        return F.when(v == "", F.lit(None)).otherwise(v)

    return {"verdict": F.upper(grab("VERDICT", r"[A-Za-z_]+")),
            "confidence": grab("CONFIDENCE", r"[0-9.]+").try_cast("double"),
            "severity": F.upper(grab("SEVERITY", r"[A-Za-z_]+")),
            "rationale": grab("RATIONALE", r".*?")}


def image_tag(ref) -> Column:
    """Op 31: text after the last ':'; no colon -> '<no-tag>'; empty stays empty."""
    r = _c(ref)
    return (F.when(r.isNull() | (r == ""), F.lit(""))
            .when(F.instr(r, ":") == 0, F.lit("<no-tag>"))
            .otherwise(F.substring_index(r, ":", -1)))


VAR_REF_RE = r"\$\{([A-Za-z_][A-Za-z0-9_]*)(:?-[^}]*)?\}"


def extract_refs(text, pattern: str, group: int = 1) -> Column:
    """Op 32: all matches of ``pattern`` (capture ``group``) as an array."""
    return F.regexp_extract_all(_c(text), F.lit(pattern), group)


def var_refs(text) -> Column:
    """Op 32: ``${VAR}`` / ``${VAR:-default}`` references of a text as an
    array of ``struct(name, required)``; a reference with a default is not
    required."""
    names = F.regexp_extract_all(_c(text), F.lit(VAR_REF_RE), 1)
    defaults = F.regexp_extract_all(_c(text), F.lit(VAR_REF_RE), 2)
    return F.zip_with(names, defaults, lambda n, d: F.struct(n.alias("name"),
                                                             (d == F.lit("")).alias("required")))


def bib_key(doi, arxiv, title) -> Column:
    """Op 33: DOI, else arXiv id, else md5 of the normalized title."""
    norm_title = F.regexp_replace(F.lower(_c(title)), r"[^\p{L}\p{N}]", "")
    d = F.lower(F.trim(_c(doi)))
    a = F.lower(F.trim(_c(arxiv)))
    return F.coalesce(
        F.when(d != "", F.concat(F.lit("doi:"), d)),
        F.when(a != "", F.concat(F.lit("arxiv:"), a)),
        F.concat(F.lit("title:"), F.md5(norm_title)))


def sql_title_key(title: str) -> str:
    """DuckDB text of the title part of :func:`bib_key`."""
    return f"'title:' || md5(regexp_replace(lower({title}), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


DOI_RE = r"(10\.[0-9]{4,9}/[^\s]+)"
ARXIV_RE = r"arXiv:([0-9]{4}\.[0-9]{4,5})"


def md5_uniform(x) -> Column:
    """Uniform in [0, 1) from the first 8 hex digits of md5 (engine-portable)."""
    return F.conv(F.substring(F.md5(_c(x).cast("string")), 1, 8), 16, 10).cast("long") / 4294967296.0


def error_rule_class(msg, rules: Sequence[tuple[str, str]]) -> Column:
    """Op 34 (first half): first matching ordered regex rule, else 'other'."""
    out = F.lit("other")
    for name, pat in reversed(list(rules)):
        out = F.when(_c(msg).rlike(pat), F.lit(name)).otherwise(out)
    return out
