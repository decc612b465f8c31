"""URL filter: allow and block rules, then empirical-Bayes host reputation.

Labelled pages give each host outcomes (bad or not). Their rate is shrunk level by level: the suffix's
towards all pages', the registered domain's towards its suffix's, the host's towards its domain's. Each
level's prior is a beta distribution whose mean is the parent's posterior mean and whose strength, in
pages, is estimated from how much the children's rates differ beyond binomial noise (method of moments
over all hosts, within bounds). A host is blocked when the posterior's lower bound, mean - z * standard
deviation, is above the accepted rate. Hosts without labelled pages inherit their domain's posterior.

A host's reputation is that of its name, without a user and a port. Suffixes are a parameter: names of several labels
under which domains are registered, such as a public list has; the longest that fits counts, and else the last label. A
numeric address is a domain of its own, under the suffix "". Rules fit hosts as they stand in the url.

Null urls and urls without ``://`` have an empty host and path, no rule, and the verdict of the empty name.
Repeated pages are judged alike; a page_id's labels count once each. Only page_id and url are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Suffixes of several labels, if none are given.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "com.cn", "co.in", "co.za")

#: (verdict, host and start of path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


@dataclass(frozen=True)
class Bounds:
    """Blocked above max_bad at z standard deviations; strengths of priors stay in [least, most] pages, and never
    exceed what the parent's own posterior rests on. The root's prior: ``base_pages`` pages at ``base_rate``."""

    max_bad: float = 0.35
    z: float = 1.645
    least: float = 2.0
    most: float = 1000.0
    base_rate: float = 0.1
    base_pages: float = 2.0


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host and path."""
    at = F.instr("url", "://")
    after = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return pages.select("page_id", F.coalesce(after, F.lit("")).alias("_u")).select(
        "page_id", _lower(F.regexp_extract("_u", r"(?s)^[^/?#]*", 0)).alias("host"), F.regexp_extract("_u", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path")
    )


def registered(name: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """The registered domain and the suffix of a host's name; a suffix is its own domain."""
    last = lambda n: F.substring_index(name, ".", -n)
    sizes = sorted({s.count(".") + 1 for s in suffixes}, reverse=True)
    labels = reduce(lambda found, n: found.when(last(n).isin([s for s in suffixes if s.count(".") + 1 == n]), n), sizes, F.when(F.lit(False), 0)).otherwise(1)
    address = name.rlike(r"^[0-9.]+$|[\[\]:]")
    pick = lambda extra: reduce(lambda found, n: found.when(labels == n, last(n + extra)), sizes, F.when(address, name if extra else F.lit(""))).otherwise(last(1 + extra))
    return pick(1), pick(0)


def name_of(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$", "")


def _rules(spark: SparkSession, rules) -> DataFrame:
    rows = [(verdict, rule, rule.partition("/")[0], "/" + rule.partition("/")[2]) for verdict, rule in rules]
    return spark.createDataFrame(rows, "rule_verdict string, rule string, rule_host string, rule_path string")


def matched(urls: DataFrame, rules=RULES) -> DataFrame:
    """host, path, rule and rule_verdict of each distinct (host, path) under a rule; the longest rule wins.

    A host's suffixes at its dots are looked up, so the work is (labels of a host) whatever the number of rules."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = urls.select("host", "path", F.explode(suffixes).alias("rule_host")).join(_rules(urls.sparkSession, rules), "rule_host").where(F.expr("startswith(path, rule_path)"))
    best = F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.length("rule_host"), "rule"))
    return found.groupBy("host", "path").agg(best.alias("_r")).select("host", "path", "_r.*")


def _strength(level: DataFrame, parent: str, b: Bounds) -> float:
    """The concentration m of Beta(m * mean, m * (1 - mean)) over children of this level."""
    p, n = F.col(parent), F.col("n")
    rate = F.col("bad") / n
    noise, spread = p * (1 - p) / n, (rate - p) * (rate - p)
    extra = F.sum(n * (spread - noise)) / F.sum(n)
    usual = F.sum(n * p * (1 - p)) / F.sum(n)
    m = F.when(F.coalesce(extra, F.lit(0.0)) <= 0, F.lit(b.most)).otherwise(usual / extra - 1)
    return level.where("n > 0").agg(F.least(F.lit(b.most), F.greatest(F.lit(b.least), F.coalesce(m, F.lit(b.most))))).first()[0]


def reputation(pages: DataFrame, labels: DataFrame, b: Bounds = Bounds(), suffixes=SUFFIXES) -> DataFrame:
    """name, n, bad, mean, bound and blocked of every host's name among the pages (``parsed``).

    labels: (page_id, bad 0/1). Pages are summed to a table of names first, which all levels start from; each level's one
    number comes to the driver."""
    named = pages.select("page_id", name_of(F.col("host")).alias("name")).join(labels, "page_id", "left")
    domain, suffix = registered(F.col("name"), suffixes)
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = named.groupBy("name").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    hosts = written(hosts.withColumns({"domain": domain, "suffix": suffix}), "reputation-hosts")
    domains = written(sums(hosts, "domain", "suffix"), "reputation-domains")
    suffixes = sums(domains, "suffix")
    n, bad = domains.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()

    def shrunk(level: DataFrame, keys: list[str]) -> DataFrame:
        """keys, p and t: posterior mean and pages behind it, from this level's n and bad and the parent's p and t."""
        strength = F.least(F.lit(_strength(level, "p", b)), F.col("t"))
        return level.select(*keys, ((F.col("bad") + strength * F.col("p")) / (F.col("n") + strength)).alias("p"), (F.col("n") + strength).alias("t"))

    root = {"p": F.lit((bad + b.base_rate * b.base_pages) / (n + b.base_pages)), "t": F.lit(n + b.base_pages)}
    suffixes = shrunk(suffixes.withColumns(root), ["suffix"])
    domains = shrunk(domains.join(suffixes, "suffix"), ["domain", "suffix"])
    hosts = shrunk(hosts.join(domains, ["domain", "suffix"]), ["name", "n", "bad"])
    hosts = hosts.select("name", "n", "bad", F.col("p").alias("mean"), "t")
    bound = F.col("mean") - b.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("t") + 1))
    return hosts.select("name", "n", "bad", "mean", bound.alias("bound"), (bound > b.max_bad).alias("blocked"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, b: Bounds = Bounds(), suffixes=SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Pages' rules and reputations come by (host, path) and by name: a hot host's pages are spread by their
    paths, and the table of names is joined by a plain equi-join that adaptive execution may broadcast or split."""
    own = parsed(pages)
    known = matched(own.select("host", "path").distinct(), rules)
    bad = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    found = reputation(own, bad, b, suffixes).select("name", "blocked")
    out = own.withColumn("name", name_of(F.col("host"))).join(known, ["host", "path"], "left").join(found, "name", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
