"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over ``host + path + ?query`` with the literal
tokens that every URL it matches must contain whole.  The rules are indexed by
the token of theirs that the fewest URLs contain (counted over all URLs); a
URL's tokens fetch the rules indexed under them, and only those run their
regular expression.  Host rules (a host, its subdomains and a path prefix) win
over patterns (words of a host, of a path, names of a query), longer rules over
shorter ones, ``block`` over ``allow`` in a tie.

Only DataFrame operations.  URLs are judged once each, whatever their number
of rows.  Rules are a list or a table (:data:`RULES`; :func:`read_rules` reads
one).  Up to ``BROADCAST_RULES`` rules are broadcast; beyond, rules under a
token of more than ``HOT_URLS`` URLs are copied under ``SALTS`` keys, so that
no token's URLs meet in one task, and all others are joined on their token.

Edge cases: a null URL and one without ``://`` have an empty host and path
and get the default verdict; repeated rows get the same verdict; other columns
pass through, and input columns named like an output are replaced; an empty
table gives an empty result; a rule without a whole token is tried on every
URL; without rules every URL gets the default verdict.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
HOT_URLS = 1_000_000
SALTS = 64
#: Columns of a rule table, as the fields of :class:`Rule`.
RULES = "name string, action string, pattern string, tokens array<string>, host boolean"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``tokens``: lower-case literals of ``[a-z0-9]+``, each bounded by other
    characters in every URL that ``pattern`` (Java syntax) matches.  ``host``
    marks host rules; ``name`` tells the rule in the result."""
    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    host: bool = False


def _escaped(literal: str) -> str:
    return "".join(re.escape(c) if not c.isalnum() else c for c in literal)


def _whole(literal: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in re.split("[^a-z0-9]+", literal.lower()) if t))


def host_rule(action: str, host: str, path: str = "") -> Rule:
    """The host and all its subdomains, where the path starts with ``path``."""
    pattern = rf"^(?:[^/?]*\.)?{_escaped(host + path)}" + ("" if path else r"(?:[/?]|\z)")
    # what follows the last delimiter of the path may go on in the URL
    tokens = _whole(host) + tuple(t.lower() for t in re.split("[^A-Za-z0-9]+", path)[:-1] if t)
    return Rule(host + path, action, pattern, tuple(dict.fromkeys(tokens)), True)


def host_word_rule(action: str, words: str) -> Rule:
    """Hosts with a label that contains these words, joined by hyphens, whole."""
    return Rule(words, action, rf"^(?:[^/?]*[.-])?{_escaped(words)}(?:[.-][^/?]*)?(?:[/?]|\z)", _whole(words))


def path_word_rule(action: str, words: str) -> Rule:
    """Paths with a segment that contains these words whole, in any case."""
    return Rule(f"/{words}", action,
                rf"(?i)^[^/?]*/(?:[^?]*[/._-])?{_escaped(words)}(?:[/._-][^?]*)?(?:\?|\z)", _whole(words))


def query_rule(action: str, name: str) -> Rule:
    """Queries with a parameter of this name, in any case."""
    return Rule(f"?{name}=", action, rf"(?i)^[^?]*\?(?:[^#]*&)?{_escaped(name)}=", _whole(name))


# Words of unwanted kinds, and parameters of session and
# affiliate links, which lead to copies of pages.
UNWANTED_WORDS = ["spam", "pills", "viagra", "casino", "bets", "betting", "poker", "porn", "xxx", "escort", "warez",
                  "malware", "phishing", "payday-loans", "adult"]
UNWANTED_PATH_WORDS = ["viagra", "casino", "poker", "porn", "xxx", "escort", "warez", "keygen", "payday-loans",
                       "wp-login", "cgi-bin"]
UNWANTED_PARAMETERS = ["affid", "aff_id", "clickid", "phpsessid", "jsessionid"]

UNWANTED_HOSTS = [host_word_rule("block", w) for w in UNWANTED_WORDS]
UNWANTED = (UNWANTED_HOSTS + [path_word_rule("block", w) for w in UNWANTED_PATH_WORDS]
            + [query_rule("block", w) for w in UNWANTED_PARAMETERS])


def _lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def parse_host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def parse_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def parse_query(url: Column) -> Column:
    """The query with its ``?``; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1), F.lit(""))


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.split(_lower(subject), "[^a-z0-9]+"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule table from JSON lines."""
    return spark.read.schema(RULES).json(path)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A short list of rules as rows, built from literals."""
    rows = F.array(*[F.struct(
        F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"),
        F.array(*map(F.lit, r.tokens)).cast("array<string>").alias("tokens"), F.lit(r.host).alias("host"))
        for r in rules])
    return spark.range(1).select(F.inline(rows.cast("array<struct<" + RULES.replace(" ", ":").replace(",:", ",") + ">>")))


def url_subjects(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Every different URL with the ``subject`` that the patterns read."""
    urls = pages.select(F.col(url_col).alias("url")).filter(F.col(url_col).isNotNull()).distinct()
    subject = F.concat(parse_host(F.col("url")), parse_path(F.col("url")), parse_query(F.col("url")))
    return urls.select("url", subject.alias("subject")).filter("subject != ''")


def candidate_rules(subjects: DataFrame, table: DataFrame, n_rules: int) -> DataFrame:
    """The (``url``, ``subject``, rule) rows whose regular expression is run."""
    small = n_rules <= BROADCAST_RULES
    sent = F.broadcast if small else lambda df: df
    table = sent(table.select(F.sha2(F.concat_ws("\n", "name", "action", "pattern"), 256).alias("id"), "*"))
    # every URL also offers the empty token, under which rules without one lie
    offered = subjects.select("url", "subject", F.explode(
        F.array_union(F.array(F.lit("")), _tokens(F.col("subject")))).alias("token"))
    literal = table.select("id", F.explode("tokens").alias("token"))
    count = (offered.select("token").join(sent(literal.select("token").distinct()), "token")
             .groupBy("token").agg(F.count("*").alias("n")))
    rarest = (literal.join(count, "token", "left")
              .groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest")))
    index = (table.join(rarest, "id", "left")
             .select(F.coalesce("rarest.token", F.lit("")).alias("token"),
                     (F.coalesce("rarest.n", F.lit(HOT_URLS + 1)) > HOT_URLS).alias("hot"),
                     "name", "action", "pattern", "host"))
    if small:
        return offered.join(F.broadcast(index), "token").drop("hot")
    cold = offered.join(index.filter("NOT hot"), "token").drop("hot")
    copies = index.filter("hot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = offered.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
    return cold.unionByName(salted.join(copies, ["token", "salt"]).drop("salt", "hot"))


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` (name of the
    host rule that decides, else null), ``pattern`` (name of the pattern that
    decides, else null) and ``verdict``."""
    listed = isinstance(rules, list)
    table = rule_table(pages.sparkSession, rules) if listed else rules.distinct()
    met = candidate_rules(url_subjects(pages, url_col), table, len(rules) if listed else rules.count())
    best = F.max(F.struct("host", F.char_length("name").alias("size"), (F.col("action") == "block").alias("block"),
                          "name", "action"))
    decided = (met.filter(F.expr("subject RLIKE pattern"))
               .groupBy("url").agg(best.alias("win")).select(F.col("url").alias("decided"), "win"))
    # the input row travels as one struct, so that no name of it can clash
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "pattern", "verdict")]
    rows = pages.select(F.struct(*keep).alias("row"), F.col(url_col).alias("url"))
    made = F.struct(parse_host(F.col("url")).alias("host"), parse_path(F.col("url")).alias("path"),
                    F.when(F.col("win.host"), F.col("win.name")).alias("rule"),
                    F.when(~F.col("win.host"), F.col("win.name")).alias("pattern"),
                    F.coalesce("win.action", F.lit(default)).alias("verdict"))
    return (rows.join(decided, F.col("url") == F.col("decided"), "left")
            .select("row", made.alias("new")).select("row.*", "new.*"))
