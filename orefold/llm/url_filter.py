"""URL rules found by their rarest literal token.

A rule is (verdict, host, path): it fits the host and all its subdomains where the url's path starts
with the rule's path. Each rule is a regular expression over ``host + path`` with literal tokens: the
labels of its host and the whole segments of its path. The index files each rule under the token that
the fewest urls have (counted over all urls, ties by the token); a url's tokens fetch candidate rules
and only those run their expressions. The longest rule wins (host and path together), then ``allow``. The method's own
rules, labels that block wherever they stand in a host, are filed and fetched in the same way; they have no name and
lose to every given rule. What nothing fits is allowed.

Up to ``inline_rules`` rules (documented bound) the index is a constant map inside the expression, so
nothing is shuffled. Beyond it the index is a table joined on the tokens, with hot tokens salted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The method's own rules: host labels that are blocked wherever no given rule fits.
SPAM_LABELS = ("spam-farm", "cheap-pills", "casino", "casino-win", "free-money", "xxx")
INLINE_RULES = 10_000

Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct literal tokens of a url: its host's labels and its path's segments."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("h:"), t))
    parts = F.transform(F.split(path, "/"), lambda t: F.concat(F.lit("p:"), t))
    return F.array_distinct(F.concat(labels, parts))


def rule_tokens(host: str, path: str) -> list[str]:
    """Tokens that every url has that the rule fits; a path's last, open segment is not one."""
    return ["h:" + t for t in host.split(".")] + ["p:" + t for t in path.split("/")[:-1] if t]


def rule_pattern(host: str, path: str) -> str:
    quote = lambda s: re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)
    return rf"(?s)^(?:[^/]*\.)?{quote(host)}{quote(path)}"


def label_pattern(label: str) -> str:
    """A host with this label anywhere."""
    quoted = re.sub(r"([^A-Za-z0-9])", r"\\\1", label)
    return rf"(?s)^(?:[^/]*\.)?{quoted}(?:[./].*)?$"


def rarest_tokens(urls: DataFrame, tokens: Sequence[Sequence[str]], inline: int = INLINE_RULES) -> list[str]:
    """For each rule's tokens the one in the fewest urls. One aggregate; its result is bounded by the rules."""
    wanted = sorted({t for of_rule in tokens for t in of_rule})
    if not wanted:
        return []
    if len(wanted) <= inline:
        found = urls.select(F.explode(F.array_intersect("tokens", F.array(*[F.lit(t) for t in wanted]))).alias("token"))
    else:
        table = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
        found = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).join(table, "token")
        found = found.withColumnRenamed("n", "times")
    count = F.count("*") if len(wanted) <= inline else F.sum("times")
    seen = {r["token"]: r["n"] for r in found.groupBy("token").agg(count.alias("n")).collect()}
    return [min(of_rule, key=lambda t: (seen.get(t, 0), t)) for of_rule in tokens]


_CANDIDATE = "struct<width:int,verdict:string,rule:string,pattern:string>"


def _compiled(rules: Sequence[Rule], labels: Sequence[str]) -> list[tuple[dict, list[str]]]:
    """Index entries of the given and the method's own rules, each with its tokens."""
    given = [({"width": len(h + p), "verdict": v, "rule": h + p, "pattern": rule_pattern(h, p)}, rule_tokens(h, p)) for v, h, p in rules]
    own = [({"width": 0, "verdict": "block", "rule": None, "pattern": label_pattern(x)}, ["h:" + x]) for x in labels]
    return given + own


def _best(found: Column) -> Column:
    """Longest, then ``allow`` before ``block``, then by the rule's text."""
    ranked = F.transform(
        found, lambda c: F.struct((-c["width"]).alias("o"), c["verdict"].alias("verdict"), c["rule"].alias("rule"))
    )
    return F.array_min(ranked)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    url: str = "url",
    spam_labels: Sequence[str] = SPAM_LABELS,
    inline_rules: int = INLINE_RULES,
) -> DataFrame:
    """All columns but replaced ones, with host, path, rule (null: none) and verdict for every row.

    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed. Urls may be of any length;
    rows that repeat a url or an id each have their verdict. An empty table gives an empty result.
    """
    for verdict, host, _ in rules:
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {verdict} {host}")
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "tokens", "__best", "__row")]
    parsed = pages.select(*keep, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    parsed = parsed.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    tokened = parsed.withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    compiled = _compiled(rules, spam_labels)
    keys = rarest_tokens(tokened.select("tokens"), [tokens for _, tokens in compiled], inline_rules)
    if len(rules) <= inline_rules:
        filed: dict[str, list[dict]] = {}
        for (entry, _), token in zip(compiled, keys, strict=True):
            filed.setdefault(token, []).append(entry)
        index = F.from_json(F.lit(json.dumps(filed)), f"map<string,array<{_CANDIDATE}>>")
        subject = F.concat("host", "path")
        fetched = F.flatten(
            F.transform(F.col("tokens"), lambda t: F.coalesce(F.try_element_at(index, t), F.array().cast(f"array<{_CANDIDATE}>")))
        )
        best = _best(F.filter(fetched, lambda c: F.regexp_like(subject, c["pattern"])))
        judged = tokened.withColumn("__best", best)
    else:
        judged = _joined(tokened, [(token, entry) for (entry, _), token in zip(compiled, keys, strict=True)])
    default = F.lit("allow")
    return judged.select(
        *keep, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", default).alias("verdict")
    )


def _joined(tokened: DataFrame, filed: Sequence[tuple[str, dict]], salts: int = 16) -> DataFrame:
    """The index as a table, each entry once for each salt; distinct (host, path) pairs are matched once."""
    spark = tokened.sparkSession
    rows = [(token, c["width"], c["verdict"], c["rule"], c["pattern"]) for token, c in filed]
    table = spark.createDataFrame(rows, "token string, width int, verdict string, rule string, pattern string")
    table = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    places = tokened.select("host", "path", "tokens").dropDuplicates(["host", "path"])
    fetched = places.select("host", "path", F.explode("tokens").alias("token")).withColumn(
        "salt", F.pmod(F.hash("host", "path"), F.lit(salts))
    )
    fits = fetched.join(table, ["token", "salt"]).filter(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy("host", "path").agg(
        F.min(F.struct((-F.col("width")).alias("o"), F.col("verdict"), F.col("rule"))).alias("__best")
    )
    return tokened.join(best, ["host", "path"], "left")
