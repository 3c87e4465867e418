"""URL rules by a sort-merge range join over canonical keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from claimloom.llm.storage import Workspace

# Ends the host in a key. Code points sort as UTF-8 bytes do, and no other character sorts before it.
END = "\x00"


def host_of(url: str) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty if there is none."""
    rest = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(END))


def _points(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """One row per page and suffix of its host: the key under which a rule for that suffix would lie."""
    labels = F.split(F.col("host"), r"\.", -1)
    suffixes = F.when(F.col("host") == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(F.reverse(labels), 1, n), "."))
    )
    parts = pages.select(F.col(id_col).alias("page"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    parts = parts.withColumn("suffixes", suffixes)
    return parts.select("page", "host", "path", F.explode("suffixes").alias("suffix")).select(
        F.concat("suffix", F.lit(END), "path").alias("key"), F.lit(1).alias("kind"), "page", "host", "path",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )


def _intervals(rules: DataFrame) -> DataFrame:
    """Where each rule's interval of keys begins: it holds all keys that start with this one. Of rules for one host and
    path, ``block`` wins."""
    key = F.concat(host_key(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), F.col("path"))
    return rules.where("host IS NOT NULL AND path IS NOT NULL AND host <> ''").groupBy(key.alias("key")).agg(
        F.min(F.concat("host", "path")).alias("rule"), F.max("verdict").alias("verdict"),
    ).select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("page"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "rule", "verdict")


OUT = "page string, host string, path string, rule string, verdict string, width int"


def _sweep(carried: dict[int, list[tuple[str, str, str]]]):
    """One pass over a sorted partition with the stack of rules whose intervals are open; ``carried`` has those that
    opened in earlier partitions."""
    names = ["page", "host", "path", "rule", "verdict"]

    def task(batches: Iterator[pa.RecordBatch]):
        stack: list[tuple[str, str, str]] = []
        started = False
        for batch in batches:
            rows = batch.to_pydict()
            out = {n: [] for n in [*names, "width"]}
            for i, key in enumerate(rows["key"]):
                if not started:
                    stack, started = list(carried.get(rows["part"][i], [])), True
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if rows["kind"][i] == 0:
                    stack.append((key, rows["rule"][i], rows["verdict"][i]))
                    continue
                best = stack[-1] if stack else ("", None, None)
                for n, v in zip([*names, "width"], (rows["page"][i], rows["host"][i], rows["path"][i], best[1], best[2], len(best[0]))):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(n, pa.string()) for n in names] + [("width", pa.int32())]))

    return task


def judge_urls(
    pages: DataFrame, rules: DataFrame, ws: Workspace, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """(id, host, path, rule, verdict): the longest rule of ``rules(host, path, verdict)`` that fits each page's url.

    A rule fits its host and all subdomains if the url's path starts with the rule's. Each suffix of a page's host gives
    a key (labels reversed, then the path), under which a rule is a prefix, that is an interval; intervals nest or are
    apart. Keys and rules are dealt out by ranges and swept in order; a range starts with the rules still open from
    earlier ones, which are the prefixes of its first key. Key, kind and page together are the range key, so a url or
    host that is most of the table is spread over many ranges.

    The longest rule is that with most characters; it has the most of the url. Null urls and such without ``://`` have
    an empty host and path and ``default``; so has a page that no rule fits (rule null). Rows with equal ids, null ones
    included, are rows of their own if their urls differ, and come back as often as they are there. Rules with a null or empty host, or a null path, fit nothing. An empty table gives an
    empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    numbered = pages.select(F.col(id_col).cast("string").alias(id_col), url_col)
    events = _points(numbered, id_col, url_col).unionByName(_intervals(rules))
    order = ["key", "kind", "page"]
    dealt = events.repartitionByRange(*order, F.xxhash64("page", "host", "path")).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    # One row per range; its first key has no more prefixes than characters. A rule may also begin its own range: then it
    # is on the stack twice, which changes nothing.
    firsts = dealt.groupBy("part").agg(F.min("key").alias("first"))
    prefixes = firsts.select("part", "first", F.explode(F.sequence(F.lit(1), F.length("first"))).alias("n")).select("part", F.expr("substring(first, 1, n)").alias("key"))
    opened = _intervals(rules).select("key", "rule", "verdict").join(prefixes, "key")
    carried: dict[int, list] = {}
    for r in opened.orderBy("part", F.length("key")).collect():
        carried.setdefault(r["part"], []).append((r["key"], r["rule"], r["verdict"]))
    found = dealt.mapInArrow(_sweep(carried), OUT)
    # the page's own host is one of its suffixes, so every row of a page comes here as often as it has suffixes
    suffixes = F.greatest(F.size(F.split("host", r"\.", -1)), F.lit(1))
    best = found.groupBy("page", "host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "width", "rule", "verdict"))).alias("best"), F.count("*").alias("rows"),
    )
    copies = (F.col("rows") / suffixes).cast("int")
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(
        F.col("page").cast(kind).alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op2(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), Workspace(spark))


OP2_SQL = r"""
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path, row_number() over () as r
  from pages
), rules(rhost, rpath, rverdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best as (
  select r, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(rverdict, length(rhost || rpath)) as verdict
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by r
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (r)
"""
