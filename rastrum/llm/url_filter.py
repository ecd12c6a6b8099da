"""URL filters by empirical-Bayes host reputation (operator 9), in SQL functions only.

Explicit rules come first: a rule (host, path) fits its host and all subdomains if the
url's path starts with the rule's; the longest that fits wins.

Other urls get the method's verdict. Labelled page outcomes are counted by host; rates are
shrunk through beta-binomial priors from the whole to suffix, from suffix to registered
domain, from there to host. At each level the prior's strength comes from the
spread of rates between groups (method of moments). A url is blocked if the posterior
mean of its host's rate of bad pages, less `z` posterior standard deviations, is `bound`
or more; hosts without labels have their domain's or suffix's posterior as their own.

Suffixes. Without a table of its own, a host's suffix is its last label, or its last two if they are
a country's (two letters) and one of the names under which countries register (SECOND). A
list of public suffixes (of up to four labels; wildcards aren't known) may be given in its place: it is compared by a hash set
in each task, so it may hold MOST_SUFFIXES.

Null urls and urls without "://" have an empty host and path, fit no rule and are
allowed. Repeated pages and hosts are judged each; a page with several labels counts
once, as bad if any of them says so; null labels say nothing, nor do labels of a null id or pages without an id, which are judged all the
same. Extra columns, whatever their names, are not read. No pages give no rows, no labels leave all to the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, small

#: Action, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Second labels under which countries let domains be registered.
SECOND = ("ac", "co", "com", "edu", "gob", "go", "gov", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "sch")
MOST_SUFFIXES = 50_000
Z, BOUND = 1.64, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path of each url."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract("__rest", "^([^/?#]*)", 1)
    return (
        pages.select("page_id", rest.alias("__rest"))
        .select("page_id", F.translate(host, UPPER, LOWER).alias("host"), F.regexp_extract("__rest", "^[^/?#]*([^?#]*)", 1).alias("path"))
    )


def domain_columns(df: DataFrame, suffixes=None) -> DataFrame:
    """Adds site (the host without user and port), domain and suffix to a table with host."""
    site = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    last = lambda n: F.regexp_extract("site", r"([^.]+(?:\.[^.]+){%d})$" % (n - 1), 1)
    suffix = F.regexp_extract("site", "([^.]*)$", 1)
    if suffixes is None:
        suffix = F.when(last(2).rlike(f"^(?:{'|'.join(SECOND)})\\.[a-z]{{2}}$"), last(2)).otherwise(suffix)
    else:
        known = list(suffixes)
        if len(known) > MOST_SUFFIXES:
            raise ValueError(f"over {MOST_SUFFIXES} suffixes")
        for n in (2, 3, 4):
            some = [x for x in known if x.count(".") == n - 1]
            suffix = F.when(last(n).isin(*some), last(n)).otherwise(suffix) if some else suffix
    # A label more than the suffix has.
    labels = F.size(F.split("suffix", r"\."))
    domain = F.when(labels == 1, last(2)).when(labels == 2, last(3)).when(labels == 3, last(4)).otherwise(last(5))
    return df.withColumn("site", site).withColumn("suffix", suffix).withColumn("domain", domain).withColumn("domain", F.when(F.col("domain") == "", F.col("site")).otherwise(F.col("domain")))


def rule_column(rules=RULES) -> tuple:
    """The rule that fits best and its action; null where none does."""
    rule = action = F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, action = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def strength(df: DataFrame) -> float:
    """Pseudo-counts of the level's prior, from the spread of rates about their priors (method of moments), 1 to 1000."""
    p, rate = F.col("prior"), F.col("bad") / F.col("n")
    within, between = F.sum(F.col("n") * p * (1 - p)), F.sum(F.col("n") * (rate - p) * (rate - p))
    return df.agg(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), within / F.greatest(F.lit(1e-6), between) - 1))).first()[0] or 1.0


def shrunk(df: DataFrame, s: float) -> DataFrame:
    """Adds the posterior mean and standard deviation to n, bad, prior."""
    mean = (F.col("prior") * s + F.col("bad")) / (F.lit(s) + F.col("n"))
    return df.withColumn("mean", mean).withColumn("sd", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(s) + F.col("n") + 1)))


def reputation(outcomes: DataFrame) -> list[DataFrame]:
    """Posteriors of hosts (site), domains and suffixes: key columns, n, bad, prior, mean, sd; one row for each.

    outcomes: site, domain, suffix, bad (0 or 1), one row for each labelled page. The counts by host are
    checkpointed: four figures of the whole are read from them before the next level can be.
    """
    checkpoint_dir(outcomes.sparkSession)
    total = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = outcomes.groupBy("site", "domain", "suffix").agg(F.count("bad").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")).checkpoint()
    domains = total(hosts, "domain", "suffix")
    suffixes = total(domains, "suffix")
    overall = suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).first()[0]
    suffixes = suffixes.withColumn("prior", F.lit(overall))
    suffixes = shrunk(suffixes, strength(suffixes))
    domains = domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix")
    domains = shrunk(domains, strength(domains))
    hosts = hosts.join(domains.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"])
    return [shrunk(hosts, strength(hosts)), domains, suffixes]


def judge(pages: DataFrame, labels: DataFrame, *, rules=RULES, suffixes=None, z: float = Z, bound: float = BOUND) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    labels: doc_id (the page's id), quality, toxic; a page is bad if its quality is 0 or it is toxic.
    """
    urls = domain_columns(parsed(pages), suffixes)
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) | (F.col("toxic") == 0), 0)
    marks = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad")).where("bad IS NOT NULL")
    # Labelled pages alone are told apart: one outcome for a page and site, however often it is listed.
    outcomes = urls.where("site <> ''").select("page_id", "site", "domain", "suffix").join(marks, "page_id").dropDuplicates(["page_id", "site"]).select("site", "domain", "suffix", "bad")
    # A verdict for each distinct host, so that a host with a third of all pages is one row here.
    hosts = urls.where("site <> ''").select("host", "site", "domain", "suffix").distinct()
    for key, level in zip(("site", "domain", "suffix"), reputation(outcomes), strict=True):
        hosts = hosts.join(level.select(key, (F.col("mean") - z * F.col("sd") >= bound).alias(f"bad_{key}")), key, "left")
    blocked = hosts.where(F.coalesce("bad_site", "bad_domain", "bad_suffix")).select(F.col("host").alias("__host")).distinct()
    rule, action = rule_column(rules)
    # Few hosts go to every task; otherwise the join may split a host with very many pages.
    out = urls.join(small(blocked.checkpoint()), urls["host"] == F.col("__host"), "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("__host").isNotNull(), "block").otherwise("allow")).alias("verdict"))
