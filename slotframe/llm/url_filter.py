"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join of its possible hits."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotframe.llm.blocked_bloom import possible_hits


@dataclass(frozen=True)
class Entry:
    """A host with all its subdomains, and the paths that begin with ``path``. A rule has its own verdict."""

    host: str
    path: str = ""
    verdict: str = "block"
    rule: bool = False


#: Rules of the registered query. Fixed values.
RULES = (
    Entry("org", "/", "allow", True),
    Entry("example.org", "/es/", "block", True),
    Entry("example.org", "/en/1", "block", True),
    Entry("com", "/fr/", "allow", True),
    Entry("com", "/de/", "block", True),
)
#: Unwanted sites of the registered query, for the urls that no rule fits: written by hand for the invented hosts of the
#: test pages, as no public list names those. A deployment passes its own table. Fixed values.
LISTED = tuple(
    Entry(f"{site}.example.{top}")
    for site in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm", "malware-drop", "phish-login")
    for top in ("com", "net", "org")
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: on to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Host without user, default port and closing dots; path never empty."""
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.*(:(80|443)?)?$", "")
    return host, F.when(path == "", "/").otherwise(path)


def entry_table(spark: SparkSession, entries: Iterable[Entry]) -> DataFrame:
    """The list as a table, which may as well be read from files: key (``r:`` or ``l:``, host, path), labels, path_len, length, verdict, rule."""
    rows = [(f"{'r' if e.rule else 'l'}:{e.host}{e.path}", e.host.count(".") + 1, len(e.path), len(e.host) + len(e.path), e.verdict, e.rule) for e in entries]
    return spark.createDataFrame(rows, "key string, labels int, path_len int, length int, verdict string, rule boolean")


def _keys(kind: str, host: Column, path: Column, labels: list[int], lengths: list[int], whole_steps: bool) -> Column:
    """Host suffixes by path prefixes, of the numbers of labels and the lengths that the list has."""
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>")  # noqa: E731  one literal, however long
    if not labels:
        return F.array().cast("array<string>")
    hosts = F.transform(F.filter(numbers(labels), lambda n: n <= F.size(F.split(host, r"\."))), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    fits = lambda n: n <= F.length(path)
    at_step = lambda n: fits(n) & ((n == 0) | (n == F.length(path)) | (F.substr(path, n, F.lit(1)) == "/"))
    paths = F.transform(F.filter(numbers(lengths), at_step if whole_steps else fits), lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(F.lit(kind), h, p))))


def judge_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """One row for each row of ``urls`` (page_id, url): page_id, host, path, rule, verdict.

    ``listed`` is an ``entry_table``, of any size. Each url gives its keys: host suffix and path prefix, for rules of
    the url as it is and any prefix, for the list of the canonical url and prefixes that end at a slash or with the
    path. The Bloom filter drops nearly all that aren't listed, the join on the key drops the rest. The longest rule
    that fits decides; where none fits, a listed site or page is blocked and all else allowed. The plan doesn't grow
    with the list: its numbers of labels and path lengths are one literal.

    Nulls and ties: a null url, or one without ``://``, has an empty host and path, and nothing fits it. Two listed
    rules of one length that fit the same url can only be of one host; the smaller key wins. Repeated rows are each
    judged. An empty table gives an empty result; an empty list allows all.
    """
    host, path = host_and_path(F.col("url"))
    parsed = urls.select("page_id", host.alias("host"), path.alias("path"))
    shapes = {r["rule"]: (sorted(r["labels"]), sorted(r["lengths"])) for r in listed.groupBy("rule").agg(F.collect_set("labels").alias("labels"), F.collect_set("path_len").alias("lengths")).collect()}
    sites = parsed.filter("host <> ''").select("host", "path").distinct()
    bare, full = canonical(F.col("host"), F.col("path"))
    sites = sites.select("host", "path", bare.alias("bare"), full.alias("full"))
    every = F.concat(_keys("r:", F.col("host"), F.col("path"), *shapes.get(True, ([], [])), False), _keys("l:", F.col("bare"), F.col("full"), *shapes.get(False, ([], [])), True))
    keys = sites.select("host", "path", F.explode(F.array_distinct(every)).alias("key"))
    hits = possible_hits(keys, listed).join(listed.select("key", "length", "verdict", "rule"), "key")
    best = hits.groupBy("host", "path").agg(
        F.max(F.when(F.col("rule"), F.struct("length", F.substring("key", 3, 1 << 30).alias("key"), "verdict"))).alias("best"),
        F.bool_or(~F.col("rule") & (F.col("verdict") == "block")).alias("listed"),
    )
    judged = parsed.join(best, ["host", "path"], "left")
    method = F.when(F.coalesce("listed", F.lit(False)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"))


def oracle_sql(entries: Iterable[Entry]) -> str:
    values = ", ".join(f"('{e.host}', '{e.path}', '{e.verdict}', {e.rule})" for e in entries)
    return f"""
WITH e(h, p, v, r) AS (VALUES {values}),
u AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.*(:(80|443)?)?$', '') AS bare, CASE path WHEN '' THEN '/' ELSE path END AS full_path FROM s),
m AS (SELECT n, max_by(h || p, length(h || p)) FILTER (r) AS rule, max_by(v, length(h || p)) FILTER (r) AS v, bool_or(NOT r AND v = 'block') AS listed
      FROM c JOIN e ON CASE WHEN r THEN (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ELSE (bare = h OR ends_with(bare, '.' || h)) AND (p = '' OR full_path = p OR ends_with(p, '/') AND starts_with(full_path, p)) END GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN m USING (n)
"""
