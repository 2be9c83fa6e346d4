"""URL filters: a sort-merge range join of pages and nested prefix rules.

A URL's key is its host's labels in reverse order, each followed by a comma, a blank, and
its path: ``https://www.Example.com/a?b`` has ``com,example,www, /a?b``. A rule for a host
and its subdomains is a prefix of keys, as is a rule for paths of one host; so a rule is
an interval of the sorted keys, and intervals either nest or lie apart.

Pages and rules are range-partitioned by key and sorted together. Each partition is swept
once with a stack of the rules that are open: a rule is pushed at its key and popped at the
first key that it isn't a prefix of. Python only stops where the stack changes; the pages
between two such places are found by binary search and filled in at once. Rules that are
open when a partition begins are prefixes of its first key: that key is cut to each length
that rules have, no longer than itself, and joined with the rules.

Hosts are lower-cased; user names, ports, empty labels and fragments are dropped. Percent
escapes and international names stay as they are written.

Null, empty or hostless URLs are matched by no rule. Pages without a rule are kept. Very
long URLs have keys like others; only their range of the sort order is moved. Repeated
rows of pages, and pages with equal URLs, each have a row in the result, as page_id is never
compared. Of rules with equal prefixes the least action counts ("drop" before "keep" in no
other way than by name). Null prefixes are ignored. Without rules every page is kept;
without pages the result is empty. Extra columns of pages are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import cut, partitions, ship

#: Names of junk hosts, and the domains under each of which they are dropped with their subdomains.
JUNK = ["casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x"]
DOMAINS = ["example.com", "example.net", "example.org"]

LANGUAGES = ["de", "en", "es", "fr"]

#: Production rules: (host, path prefix or None, action). Host rules hold for subdomains too. No rule drops a domain.
#: Each junk host also has rules for its language sections and their numbered pages by their first one and two digits,
#: so a result names the narrowest section that a page was dropped for.
RULES = [
    *((f"{name}.{domain}", None, "drop") for name in JUNK for domain in DOMAINS),
    *((f"{name}.{domain}", f"/{lang}/{page}", "drop") for name in JUNK for domain in DOMAINS for lang in LANGUAGES for page in ["", *range(10), *(f"{x:02d}" for x in range(100))]),
    ("blog.ththan.example.net", None, "keep"),
    ("ththan.example.net", "/en/", "keep"),
    ("ththan.example.net", "/en/7", "drop"),
    ("m.therou.example.com", "/en/", "drop"),
    ("org", None, "keep"),
    ("example.org", None, "keep"),
    ("thther.example.org", "/fr/", "drop"),
]


def key(url: Column) -> Column:
    """The reversed-host key of a URL, or null."""
    u = F.trim(url)
    host = F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^#]*)", 1), "^$|^(?=[?])", "/")
    labels = F.filter(F.split(host, "[.]"), lambda x: x != "")
    return F.when(F.size(labels) > 0, F.concat(F.array_join(F.reverse(labels), ","), F.lit(", "), path))


def rule_prefix(host: str, path: str | None) -> str:
    return ",".join(reversed(host.lower().strip(".").split("."))) + "," + ("" if path is None else " " + path)


def rules(spark, given=RULES) -> DataFrame:
    """(prefix, action) from (host, path, action) rows."""
    return spark.createDataFrame([(rule_prefix(h, p), a) for h, p, a in given], "prefix string, action string")


def filter_urls(pages: DataFrame, rule_table: DataFrame, n: int | None = None) -> DataFrame:
    """(page_id, action, rule, n_open) of every row of ``pages``: the innermost rule, and how many are open."""
    ship(pages.sparkSession)
    r = rule_table.where("prefix is not null").groupBy("prefix").agg(F.min("action").alias("action"))
    p = pages.select(F.col("page_id").cast("long"), key(F.col("url")).alias("key"))
    lost = p.where("key is null").select("page_id", F.lit("keep").alias("action"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("n_open"))
    both = p.where("key is not null").select("key", F.lit(1).alias("kind"), "page_id", F.lit(None).cast("string").alias("action"))
    both = both.union(r.select(F.col("prefix").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "action"))
    width = n or partitions(pages.sparkSession)
    ranged = both.repartitionByRange(width, "key", "kind").sortWithinPartitions("key", "kind")
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()))
    first = ranged.groupBy("part").agg(F.min(F.struct("key", "kind")).alias("f")).select("part", F.col("f.key").alias("first"), F.col("f.kind").alias("kind"))
    lens = [x[0] for x in r.select(F.length("prefix")).distinct().collect()]  # a number for each length of a rule
    tried = first.select("part", "first", "kind", F.explode(F.filter(F.lit(lens).cast("array<int>"), lambda k: k <= F.length("first"))).alias("k"))
    tried = tried.select("part", "kind", F.expr("left(first, k)").alias("prefix"), (F.col("k") < F.length("first")).alias("shorter"))
    carried = tried.join(r, "prefix").where("shorter or kind = 1").groupBy("part").agg(F.sort_array(F.collect_list(F.struct("prefix", "action"))).alias("held"))
    begin = {x["part"]: [tuple(y) for y in x["held"]] for x in carried.collect()}  # nested prefixes of one key for each partition

    def sweep(batches):
        at, stack = None, []
        for b in batches:
            keys, kind, actions = b.column("key").to_pylist(), b.column("kind").to_numpy(), b.column("action").to_pylist()
            parts = b.column("part").to_numpy()
            n, state, states = len(keys), np.zeros(len(keys), np.int64), []
            for s in [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist()] if n else []:
                if parts[s] != at:
                    at, stack = int(parts[s]), list(begin.get(int(parts[s]), ()))
                end = int(np.searchsorted(parts[s:] != at, True)) + s
                for e in [*(np.flatnonzero(kind[s:end] == 0) + s).tolist(), end]:
                    while s < e:  # pages up to the next rule
                        to = bisect_left(keys, True, s, e, key=lambda k: not k.startswith(stack[-1][0])) if stack else e
                        if to == s:
                            stack.pop()
                            continue
                        state[s:to] = len(states)
                        states.append((stack[-1][1], stack[-1][0], len(stack)) if stack else ("keep", None, 0))
                        s = to
                    if e < end:
                        while stack and not keys[e].startswith(stack[-1][0]):
                            stack.pop()
                        stack.append((keys[e], actions[e]))
                        s = e + 1
            pages_ = pa.array(np.flatnonzero(kind == 1))
            state = pa.array(state).take(pages_)
            said, names, opened = zip(*states) if states else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("page_id").take(pages_), pa.array(said, pa.string()).take(state), pa.array(names, pa.string()).take(state), pa.array(opened, pa.int32()).take(state)], ["page_id", "action", "rule", "n_open"])

    return ranged.mapInArrow(sweep, "page_id long, action string, rule string, n_open int").union(lost)
