"""URL filter: pattern rules indexed by their rarest literal token.

A pattern is literal text with three signs: ``*`` stands for any text, ``^`` for one separator (anything but letters,
digits and ``_ . % -``) or the end, ``||`` at the start for a host or any of its subdomains; a single ``|`` at either end
pins the pattern to that end. It is held against the host (A-Z lower-cased) followed by the rest of the url.

1. A literal token is a run of digits and letters that cannot be part of a longer run in a matching url: both its
   neighbours in the pattern are separators or pinned ends. Every url that matches holds it as a whole token.
2. The urls that hold each such token are counted, and a rule is stored under its rarest token (ties: the smaller text). A
   rule without one is stored under the empty token, which every url has.
3. The distinct tokens of a url fetch the rules stored under them, and only those run as regular expressions.
4. Of the matching rules the one of the lowest tier wins, then the longest pattern, then ``block``, then the smaller text.

Each distinct url is judged once. The index is broadcast only if it is counted to be at most ``BROADCAST_RULES`` rows;
beyond that both sides are shuffled by token. A url that many pages share is joined back by its text, a side Spark may
split. All steps are DataFrame plans.

Defined cases: a url that is NULL or lacks ``://`` has empty host and path and meets no rule; a NULL id is kept; repeated rows
are repeated in the result; an empty table of pages gives no rows, an empty table of rules lets every page pass; a rule whose
pattern is NULL or empty never matches; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.common import stage

# Host rules (host, path, verdict) and the pattern rules that judge what they leave open.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
PATTERNS = (
    ("||spam-farm.", "block"), ("||cheap-pills.", "block"), (".cheap-pills.", "block"), ("||casino*.", "block"), ("^adserver^", "block"),
    ("/banners/*.gif|", "block"), ("^track^click^", "block"), ("?utm_source=spam", "block"), ("*porn*", "block"), ("/xxx/", "block"),
    ("/search?*q=", "block"), ("^login^", "block"), (".cheap-pills.*/reviews^", "allow"), ("||wiki*/porno-film", "allow"))
DEFAULT = "allow"
#: Most rows of the index that are sent to every executor: some 10 MB.
BROADCAST_RULES = 50_000
RULES = "rule string, pattern string, verdict string, tier int, match_case boolean"


def default_rules(spark: SparkSession) -> DataFrame:
    hosts = [(h + p, f"||{h}{p}", v, 0, True) for h, p, v in HOST_RULES]
    return spark.createDataFrame(hosts + [(None, p, v, 1, False) for p, v in PATTERNS], RULES)


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> dict[str, Column]:
    """host, path and the text that rules are held against."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = _lower(F.regexp_extract(after, r"\A[^/?#]*", 0))
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    return {"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, r"\A[^?#]*", 0), F.lit("")), "target": F.concat(host, rest)}


def compiled(rules: DataFrame) -> DataFrame:
    """The rules with their regular expression and their literal tokens."""
    pattern = F.col("pattern")
    domain, start, end = pattern.startswith("||"), pattern.startswith("|"), pattern.endswith("|") & (F.length("pattern") > 1)
    body = F.regexp_replace(F.regexp_replace(pattern, r"\A\|\|?", ""), r"\|\z", "")
    literal = F.regexp_replace(body, r"([\\.+?()\[\]{}$|])", r"\\$1")
    signs = F.regexp_replace(F.regexp_replace(literal, r"\^", r"(?:[^0-9A-Za-z_.%-]|\\z)"), r"\*", ".*")
    lead = F.when(domain, r"\A(?:[^/?#]*\.)?").when(start, r"\A").otherwise("")
    flags = F.when(F.col("match_case"), "(?s)").otherwise("(?si)")
    pinned = F.concat(F.when(start, "|").otherwise("*"), _lower(body), F.when(end, "|").otherwise("*"))
    return rules.where(F.length(body) > 0).select(
        "rule", "pattern", "verdict", "tier", F.concat(flags, lead, signs, F.when(end, r"\z").otherwise("")).alias("regex"),
        F.array_distinct(F.regexp_extract_all(pinned, F.lit(r"(?<![0-9a-z*])[0-9a-z]+(?![0-9a-z*])"), F.lit(0))).alias("literals"))


def url_tokens(target: Column) -> Column:
    """Distinct runs of digits and letters, lower-cased, and the empty token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(_lower(target), "[^0-9a-z]+")))


def rarest_token_index(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """(token, rule, pattern, verdict, tier, regex): each rule under the one of its tokens that the fewest urls hold."""
    named = compiled(rules).withColumn("key", F.xxhash64("tier", "pattern", "verdict", "rule"))
    literals = named.select("key", F.explode("literals").alias("token"))
    seen = targets.select(F.explode(url_tokens(F.col("target"))).alias("token"))
    counts = seen.join(_small(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = literals.join(counts, "token", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return named.join(rarest, "key", "left").select(F.coalesce("token", F.lit("")).alias("token"), "rule", "pattern", "verdict", "tier", "regex")


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_RULES else rows


def candidates(targets: DataFrame, index: DataFrame) -> DataFrame:
    """(url, target, rule columns): the rules that a token of the url fetches, before any regular expression."""
    tokens = targets.select("url", "target", F.explode(url_tokens(F.col("target"))).alias("token"))
    return tokens.join(_small(index), "token")


def judge(pages: DataFrame, rules: DataFrame | None = None, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every page; ``rule`` and ``pattern`` are those of the winning rule."""
    rules = default_rules(pages.sparkSession) if rules is None else rules
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    pieces = parts(F.col("url"))
    targets = stage(rows.select("url").where(F.instr("url", "://") > 0).distinct().select("url", pieces["target"].alias("target")))
    index = stage(rarest_token_index(rules, targets))
    matching = candidates(targets, index).where(F.expr("target rlike regex"))
    order = F.struct("tier", (-F.length("pattern")).alias("shorter"), (F.col("verdict") != "block").alias("mild"), "pattern", "rule", "verdict")
    best = matching.groupBy("url").agg(F.min(order).alias("won"))
    return rows.join(best, "url", "left").select(
        "page_id", pieces["host"].alias("host"), pieces["path"].alias("path"), "won.rule", F.coalesce("won.verdict", F.lit(default)).alias("verdict"), "won.pattern")


def _oracle() -> str:
    """All rules against all urls, with other means than the operator: prefix tests for host rules, patterns written out."""
    hosts = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in HOST_RULES)
    table = {"^": r"(?:[^0-9A-Za-z_.%-]|\z)", "*": ".*"} | {c: "\\" + c for c in r".+?()[]{}$|-/"}
    written = []
    for pattern, verdict in PATTERNS:
        body = pattern.removeprefix("||").removesuffix("|")
        text = "(?si)" + (r"\A(?:[^/?#]*\.)?" if pattern.startswith("||") else "") + "".join(table.get(c, c) for c in body) + (r"\z" if pattern.endswith("|") else "")
        written.append(f"('{pattern}', '{verdict}', '{text}')")
    return f"""
WITH hosts(h, p, v) AS (VALUES {hosts}), patterns(p, v, r) AS (VALUES {", ".join(written)}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS s FROM pages),
w AS (
  SELECT row_number() OVER () AS n, page_id, s, coalesce(translate(regexp_extract(s, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(s, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u),
a AS (
  SELECT n, h || p AS rule, v, '||' || h || p AS pattern, 0 AS tier FROM w, hosts WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  UNION ALL
  SELECT n, NULL, v, p, 1 FROM w, patterns WHERE s IS NOT NULL AND regexp_matches(host || substr(s, length(host) + 1), r)),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY n ORDER BY tier, length(pattern) DESC, v DESC, pattern) = 1)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict, pattern FROM w LEFT JOIN b USING (n)
"""


ORACLE_SQL = _oracle()
