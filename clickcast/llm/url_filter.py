"""URL filter: a trie over reversed host labels and path segments.

A rule is ``(action, host, path)``.  It fits a url whose host is the rule's
host or a subdomain of it and whose path starts with the rule's path.  The
longest rule wins: most host labels first, then the longest path; of an allow
and a block entry for the same host and path, block wins.  A url that no rule
fits gets ``DEFAULT_VERDICT``.

The rules live in a small table.  Up to ``max_broadcast_rules`` entries and
``max_broadcast_bytes`` of rule text (both measured) they are built into a trie
that is broadcast; beyond either bound the same answer comes from a join of
each distinct url's host suffixes and path folders with the rules.

Defined results: null url or no ``://``: empty host and path, no rule, default
verdict.  Empty table: no rows.  Repeated rows: judged one by one.  Very long
urls: whole.  Extra columns are kept; input columns called like an output
column are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from clickcast.llm.catalog import register
from clickcast.llm.common import table

DEFAULT_VERDICT = "allow"
MAX_BROADCAST_RULES = 200_000
MAX_BROADCAST_BYTES = 16 << 20
RULES_SCHEMA = "action string, host string, path string"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/ ? #``, A-Z lower-cased."""
    return F.translate(_part(url, 1), UPPER, UPPER.lower())


def url_path(url: Column) -> Column:
    """Text from the end of the host up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group)).otherwise("")


class UrlTrie:
    """Nested dicts: host labels from the top-level domain down, then path segments.

    A host node is ``{"sub": {label: node}, "path": path node or None}``; a path
    node is ``{"sub": {segment: node}, "ends": {prefix: (rule, verdict)}}``, where
    ``prefix`` is what follows the rule's last slash.
    """

    def __init__(self, rules):
        self.root = {"sub": {}, "path": None}
        for action, host, path in rules:
            self.add(action, host or "", path or "")

    def add(self, action: str, host: str, path: str) -> None:
        node = self.root
        for label in reversed(host.split(".")):
            node = node["sub"].setdefault(label, {"sub": {}, "path": None})
        if node["path"] is None:
            node["path"] = {"sub": {}, "ends": {}}
        at = node["path"]
        *folders, last = path.split("/")
        for segment in folders:
            at = at["sub"].setdefault(segment, {"sub": {}, "ends": {}})
        old = at["ends"].get(last)
        if old is None or action == "block":
            at["ends"][last] = (host + path, action)

    @staticmethod
    def _longest(at: dict, path: str):
        best, rest = None, path
        while at is not None:
            fits = [p for p in at["ends"] if rest.startswith(p)]
            if fits:
                best = at["ends"][max(fits, key=len)]
            segment, slash, rest = rest.partition("/")
            at = at["sub"].get(segment) if slash else None
        return best

    def match(self, host: str, path: str):
        """(rule, verdict) of the longest fitting rule, or (None, None)."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node["sub"].get(label)
            if node is None:
                break
            if node["path"] is not None:
                best = self._longest(node["path"], path) or best
        return best or (None, None)


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url",
                max_broadcast_rules: int = MAX_BROADCAST_RULES,
                max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` plus ``host``, ``path``, ``rule`` and ``verdict``."""
    size = rules.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.concat_ws("", "host", "path")))).first()
    if size[0] <= max_broadcast_rules and (size[1] or 0) <= max_broadcast_bytes:
        return _by_trie(df, [tuple(r) for r in rules.select("action", "host", "path").collect()], url)
    return _by_join(df, rules, url)


def _by_trie(df: DataFrame, rules: list, url: str) -> DataFrame:
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    kind = StructType([StructField("rule", StringType()), StructField("verdict", StringType())])

    @F.pandas_udf(kind)
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        return pd.DataFrame([match(h, p) for h, p in zip(host, path)], columns=["rule", "verdict"], dtype=object)

    parsed = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    judged = parsed.withColumn("_judged", judge("host", "path"))
    return judged.withColumns({
        "rule": F.col("_judged.rule"),
        "verdict": F.coalesce(F.col("_judged.verdict"), F.lit(DEFAULT_VERDICT)),
    }).drop("_judged")


def _by_join(df: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """The same answer for a rule table that is too large to broadcast.

    Each distinct (host, path) looks up its host suffixes and path folders;
    a rule's part after its last slash is compared after the join.
    """
    parsed = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    ruled = rules.select(
        F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "action",
    ).withColumn("r_folder", F.regexp_extract("r_path", r"(?s)^(.*/)?", 0))
    keys = parsed.select("host", "path").distinct()
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    keys = keys.select(
        "host", "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)),
                              lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("r_host"),
    ).select(
        "host", "path", "r_host",
        F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(
            i > 0, F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))).otherwise(""))).alias("r_folder"),
    )
    fits = keys.join(ruled, ["r_host", "r_folder"]).where(F.col("path").startswith(F.col("r_path")))
    rank = F.struct(F.size(F.split("r_host", r"\.")), F.length("r_path"), F.col("action") == "block")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(
        F.concat("r_host", "r_path").alias("rule"), F.col("action").alias("verdict")), rank).alias("_best"))
    found = parsed.drop("rule", "verdict").join(best, ["host", "path"], "left")
    out = found.withColumns({
        "rule": F.col("_best.rule"),
        "verdict": F.coalesce(F.col("_best.verdict"), F.lit(DEFAULT_VERDICT)),
    }).drop("_best")
    return out.select(*[c for c in parsed.columns if c not in ("rule", "verdict")], "rule", "verdict")


#: The rules that the query judges by.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

SQL = """
WITH parsed AS (
  SELECT page_id,
         CASE WHEN instr(url, '://') > 0
              THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END AS raw_host,
         CASE WHEN instr(url, '://') > 0
              THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
urls AS (
  SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM parsed),
rules(action, r_host, r_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT page_id, r_host || r_path AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) DESC, length(r_path) DESC) AS k
  FROM urls JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.action, 'allow') AS verdict
FROM urls u LEFT JOIN (SELECT * FROM fits WHERE k = 1) f USING (page_id)
"""


@register("op1_url_filter", SQL)
def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, RULES_SCHEMA)
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
