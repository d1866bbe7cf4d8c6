"""URL filters: a trie over reversed host labels and path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.cluster import ready, table

#: The production rules: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: More rules than this aren't broadcast as a trie; they are joined instead.
MAX_TRIE_RULES = 200_000
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class Node:
    """A node of the host trie, of the path trie below it, or of the trie of characters that begin a segment."""

    down: dict[str, Node] = field(default_factory=dict)  # next label, whole segment or character
    paths: Node | None = None  # of a host node: its path trie
    starts: Node | None = None  # of a path node: the characters that the next segment may begin with
    end: tuple[str, str] | None = None  # of a character node: (rule, verdict) that ends here


def build_trie(rules: Iterable[tuple[str, str, str]]) -> Node:
    """Each host goes in from its last label, each path segment by segment; what follows the last ``/`` goes in by characters, as a prefix."""
    root = Node()
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r} is neither allow nor block")
        at = root
        for label in reversed(host.translate(_UPPER).split(".")):
            at = at.down.setdefault(label, Node())
        at.paths = at = at.paths or Node()
        *whole, rest = path.split("/")
        for segment in whole:
            at = at.down.setdefault(segment, Node())
        at.starts = at = at.starts or Node()
        for letter in rest:
            at = at.down.setdefault(letter, Node())
        if at.end is None or _rank(host + path, verdict) < _rank(*at.end):
            at.end = (host + path, verdict)
    return root


def _rank(rule: str, verdict: str) -> tuple[int, bool, str]:
    return -len(rule), verdict == "allow", rule


def match(trie: Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of equally long ones a block, then the smaller rule."""
    best = None
    segments = path.split("/")
    at: Node | None = trie
    for label in reversed(host.split(".")):
        at = at.down.get(label)
        if at is None:
            break
        below, k = at.paths, 0
        while below is not None:
            letters, node = iter(segments[k] if k < len(segments) else ""), below.starts
            while node is not None:  # what a rule has after its last "/" can only start the next segment
                if node.end is not None and (best is None or _rank(*node.end) < _rank(*best)):
                    best = node.end
                node = node.down.get(next(letters, ""))
            # a whole segment is one that a "/" follows
            below = below.down.get(segments[k]) if k < len(segments) - 1 else None
            k += 1
    return best


def split_url(column: str | F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    url = F.col(column) if isinstance(column, str) else column
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + F.lit(3)), "#", 1))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    host = F.substring_index(rest, "/", 1)
    path = F.substr(rest, F.length(host) + F.lit(1))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, *, url: str = "url", default: str = "allow", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` for every row.

    A rule fits its host and all subdomains, if the path starts with the rule's path; the longest
    host + path wins, of equally long rules a block. A URL that no rule fits, a null one and one
    without ``://`` (host and path empty) get ``default`` and a null rule. Repeated rows are judged
    alike; an empty table gives none; a column of ``pages`` with a name of the result is replaced.
    A trie of at most ``max_trie_rules`` rules is broadcast; more rules are joined by host and path prefix.
    """
    spark = pages.sparkSession
    rules = [(v, h.translate(_UPPER), p) for v, h, p in rules]
    host, path = split_url(url)
    new = ("host", "path", "rule", "verdict")
    pages = pages.select("*", F.struct(host.alias("host"), path.alias("path")).alias("_url_parts"))
    names = [c for c in pages.columns if c not in (*new, "_url_parts")]
    pages = pages.select(*(F.col(f"`{c}`") for c in names), "_url_parts.host", "_url_parts.path")
    if len(rules) > max_trie_rules:
        return _joined(pages, rules, default)
    ready(spark)
    trie = spark.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [match(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"]).astype(object)

    return pages.withColumn("_judged", judged("host", "path")).select(*(F.col(f"`{c}`") for c in pages.columns), "_judged.rule", "_judged.verdict")


def _joined(pages: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same verdicts by an equi-join of (host suffix, path prefix) candidates of the distinct URLs."""
    spark = pages.sparkSession
    known = spark.createDataFrame(pa.table({"verdict": [r[0] for r in rules], "_h": [r[1] for r in rules], "_p": [r[2] for r in rules]}))
    lengths = F.array(*(F.lit(n) for n in sorted({len(p) for _, _, p in rules})))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.filter(F.transform(lengths, lambda n: F.when(n <= F.length("path"), F.substr(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())
    urls = pages.select("host", "path").distinct()
    fits = urls.select("host", "path", F.explode(suffixes).alias("_h"), prefixes.alias("_ps")).select("host", "path", "_h", F.explode("_ps").alias("_p")).join(known, ["_h", "_p"])
    rank = F.struct(-F.length(F.concat("_h", "_p")), F.col("verdict") == "allow", F.concat("_h", "_p").alias("rule"), "verdict")
    best = fits.groupBy("host", "path").agg(F.min(rank).alias("_best")).select("host", "path", "_best.rule", "_best.verdict")
    return pages.join(best, ["host", "path"], "left").select(*pages.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/]*')) + 1) AS path FROM cut
), rules AS (
  SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS t(verdict, h, p)
), fits AS (
  SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, verdict DESC) AS k
  FROM parts JOIN rules ON (host = h OR right(host, length(h) + 1) = '.' || h) AND left(path, length(p)) = p
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
"""
