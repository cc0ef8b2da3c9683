"""URL filters: pattern rules indexed by their rarest literal token.

Every rule carries a regular expression over ``host + path`` and the literal
tokens (runs of ``[A-Za-z0-9]``) that any match must contain as whole tokens.
A rule is indexed under the one of its tokens that is rarest in the URLs
(counted over all distinct URLs, for the rule tokens only). The tokens of a
URL fetch candidate rules from that index; only those run their expression.
Rules without a literal token are candidates for every URL.

Only DataFrame functions are used. Up to ``INLINE_RULES`` rules the index is
part of the plan (its size is checked, and nothing is shuffled); beyond, the
tokens of the distinct URLs are joined with the index as a table.

Defined results: a null URL or one without ``://`` has empty host and path and
fits no rule (verdict ``allow``); repeated rows are judged each; input columns
named like an output column give way to it; other columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

INLINE_RULES = 500


@dataclass(frozen=True)
class Rule:
    name: str            # shown in the result
    verdict: str         # allow or block
    regex: str           # over host + path
    tokens: tuple[str, ...]
    base: bool = False   # host/path rules go before pattern rules


def _escape(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/-_" else "\\" + c for c in text)


def _tokens(text: str, closed: bool = True) -> tuple[str, ...]:
    """Whole tokens of a literal; the last one is dropped when open."""
    out, cur = [], ""
    for c in text:
        if c.isascii() and c.isalnum():
            cur += c
        else:
            out.append(cur)
            cur = ""
    if closed:
        out.append(cur)
    return tuple(dict.fromkeys(t for t in out if t))


def host_rule(name: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains, path by prefix."""
    return Rule(name, verdict, f"^([^/]*\\.)?{_escape(name)}", _tokens(name, closed=False), True)


BASE_RULES = (host_rule("org/", "allow"), host_rule("example.org/es/", "block"),
              host_rule("example.org/en/1", "block"), host_rule("com/fr/", "allow"),
              host_rule("com/de/", "block"))
#: pattern rules of the method, used where no base rule fits
PATTERN_RULES = (
    Rule("spam-farm.", "block", "^([^/]*\\.)?spam-farm\\.", ("spam", "farm")),
    Rule("cheap-pills.", "block", "^([^/]*\\.)?cheap-pills\\.", ("cheap", "pills")),
    Rule("casino.", "block", "^([^/]*[.-])?casino[.-]", ("casino",)),
    Rule("/ads/", "block", "/ads/", ("ads",)),
    Rule("/banner-N.", "block", "/banner-[0-9]+\\.(gif|jpg|png)$", ("banner",)),
    Rule("/tag/", "block", "^[^/]*/([^/]*/)*tag/[^/]+/page/[0-9]+/?$", ("tag", "page")),
)


def split_url(url):
    """(host, path) columns of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(`__u`, instr(`__u`, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _rarest(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Index: each rule under its rarest token. The counts come back for rule
    tokens only, so the rule list bounds what the driver gets."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if len(wanted) and any(len(r.tokens) > 1 for r in rules):
        toks = urls.select(F.explode(F.array_intersect("__tokens", F.array(*map(F.lit, wanted)))).alias("t"))
        counts = {r["t"]: r["n"] for r in toks.groupBy("t").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        key = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if r.tokens else ""
        index.setdefault(key, []).append(r)
    return index


def _struct(r: Rule):
    return F.struct(F.lit(len(r.name) + (1 << 20 if r.base else 0)).alias("rank"), F.lit(r.name).alias("name"),
                    F.lit(r.verdict).alias("verdict"), F.lit(r.base).alias("base"), F.lit(r.regex).alias("regex"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + PATTERN_RULES,
               default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` per row of ``pages``."""
    host, path = split_url(F.col("__u"))
    rows = (pages.select("page_id", F.col("url").alias("__u"))
            .withColumns({"host": host, "path": path})
            .withColumn("__at", F.concat("host", "path"))
            .withColumn("__tokens", F.array_distinct(F.split("__at", "[^A-Za-z0-9]+"))))
    if not rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("pattern"))
    index = _rarest(rows.select("__tokens"), rules)
    if len(rules) <= inline:
        table = F.create_map(*[x for k, rs in sorted(index.items())
                               for x in (F.lit(k), F.array(*map(_struct, rs)))])
        keys = F.array(*[F.lit(k) for k in sorted(index) if k]) if set(index) - {""} else F.array().cast("array<string>")
        found = F.array_intersect("__tokens", keys)
        if "" in index:
            found = F.concat(found, F.array(F.lit("")))
        rows = rows.withColumn("__candidates", F.flatten(F.transform(found, lambda t: F.element_at(table, t))))
        rows = rows.withColumn("__hit", F.array_max(F.filter(
            "__candidates", lambda r: F.call_function("regexp_like", F.col("__at"), r["regex"]))))
    else:
        spark = pages.sparkSession
        listed = spark.createDataFrame(
            [(k, len(r.name) + (1 << 20 if r.base else 0), r.name, r.verdict, r.base, r.regex)
             for k, rs in index.items() for r in rs],
            "token string, rank int, name string, verdict string, base boolean, regex string")
        urls = rows.select("__at", "__tokens").distinct()
        hits = (urls.select("__at", F.explode(F.array_union("__tokens", F.array(F.lit("")))).alias("token"))
                .join(listed, "token")
                .where(F.call_function("regexp_like", F.col("__at"), F.col("regex")))
                .groupBy("__at").agg(F.max(F.struct("rank", "name", "verdict", "base", "regex")).alias("__hit")))
        rows = rows.join(hits, "__at", "left")
    hit = F.col("__hit")
    return rows.select("page_id", "host", "path",
                       F.when(hit["base"], hit["name"]).alias("rule"),
                       F.coalesce(hit["verdict"], F.lit(default)).alias("verdict"),
                       F.when(~hit["base"], hit["name"]).alias("pattern"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    rules = BASE_RULES + PATTERN_RULES
    values = ", ".join("('%s', '%s', '%s', %s, %d)" % (r.name, r.verdict, r.regex, "true" if r.base else "false",
                       len(r.name) + (1 << 20 if r.base else 0)) for r in rules)
    letters = f"'{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}'"
    return f"""
WITH rules(name, verdict, regex, base, rank) AS (VALUES {values}),
u AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
             THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest,
             row_number() OVER () AS n FROM pages),
p AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), {letters}) AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT n, name, verdict, base, row_number() OVER (PARTITION BY n ORDER BY rank DESC, name DESC) AS k
      FROM p JOIN rules ON regexp_matches(host || path, regex))
SELECT page_id, host, path, CASE WHEN base THEN name END AS rule, coalesce(verdict, 'allow') AS verdict,
       CASE WHEN NOT base THEN name END AS pattern
FROM p LEFT JOIN h ON p.n = h.n AND k = 1"""


SQL = _sql()
