"""URL verdicts from a trie over reversed host labels and path segments, the longest match deciding.

A rule is (verdict, host, path). It fits its host and all subdomains when the URL's path starts with the
rule's path. The longest fitting rule (characters of host and path) decides; of equally long ones ``block``
does. A URL that no rule fits, among them null and those without ``://``, gets ``default``.

Up to ``MOST_RULES`` rules travel as one pickled trie to Arrow workers; beyond that the rules stay a
DataFrame and are joined by host suffix, which holds for any number.

Defined results: null and malformed URLs have an empty host and path; host and path keep whatever bytes they
hold (A-Z of the host lower-cased); repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_RULES = 100_000
Rule = tuple[str, str, str]
_SEGMENT = re.compile(r"/[^/]*|[^/]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Catalyst expressions for host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


class Trie:
    """Host labels from the top-level domain down, then path segments; the last segment of a rule may end inside one of the URL's."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            segments = _SEGMENT.findall(path)
            for s in segments[:-1]:
                node = node.setdefault("paths", {}).setdefault(s, {})
            ends = node.setdefault("ends", {})
            last = segments[-1] if segments else ""
            if ends.get(last) != "block":
                ends[last] = verdict

    def best(self, host: str, path: str) -> tuple[str, str] | None:
        segments = _SEGMENT.findall(path)
        found: tuple[int, bool, str, str] | None = None
        node, labels = self.root, []
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = node.get("hosts", {}).get(label)
                if node is None:
                    break
                labels.insert(0, label)
            name, inner, done = ".".join(labels), node, ""
            for k in range(len(segments) + 1):
                here = segments[k] if k < len(segments) else ""
                for end, verdict in inner.get("ends", {}).items():
                    if here.startswith(end):
                        rule = name + done + end
                        one = (len(rule), verdict == "block", rule, verdict)
                        found = one if found is None or one[:2] > found[:2] else found
                inner = inner.get("paths", {}).get(here)
                if inner is None:
                    break
                done += here
        return found and (found[2], found[3])


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: the id, host, path, rule, verdict."""
    if len(rules) > MOST_RULES:
        spark = pages.sparkSession
        return judge_by_join(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), id_col, url_col, default)
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.best
        for b in batches:
            hits = [find(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x and x[0] for x in hits], pa.string()), pa.array([x[1] if x else default for x in hits], pa.string())],
                names=[*b.schema.names, "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(verdicts, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def judge_by_join(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same for any number of rules: host suffixes meet the rules in an equi-join that is split by the first path segment where rules have one."""
    host, path = host_and_path(F.col(url_col))
    parts = pages.select(F.monotonically_increasing_id().alias("_u"), F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    from .work import written

    parts = written(parts, "url-parts")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))
    asked = parts.select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
    r = rules.select(F.col("verdict").alias("_v"), F.col("host").alias("suffix"), F.col("path").alias("_p")).distinct()
    near = asked.join(r, "suffix")
    hit = parts.join(near, "host").where(F.expr("startswith(path, _p)"))
    rule = F.concat("suffix", "_p")
    best = hit.groupBy("_u").agg(F.max(F.struct(F.char_length(rule).alias("n"), (F.col("_v") == "block").alias("b"), rule.alias("rule"), F.col("_v").alias("verdict"))).alias("m"))
    return parts.join(best, "_u", "left").select(id_col, "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query op7.
RULES: list[Rule] = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
