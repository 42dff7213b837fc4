"""URL filter: rules on host and path, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host, registered domain (one label more than the suffix) and suffix (the last
label, or two labels that SUFFIXES names). A port does not count. A numeric address is its own domain, below a suffix that all of
them share; a host that is itself a suffix is its own domain. Every level is shrunk towards the level above it by a beta-binomial
prior whose strength is fitted by moments: suffixes towards the whole, domains towards their suffix, hosts towards their domain;
no prior is stronger than the pages it rests on. A host is blocked if the lower bound of its posterior bad rate exceeds a limit,
so hosts with few labels follow their domain and are not blocked on thin evidence.

Defined results: a null url or one without ``://`` has empty host and path and fits no rule; a host without labelled pages has
its prior; without any label nothing is blocked; repeated pages count as often as they occur; outcomes of a page that occurs
twice in the outcomes table are averaged first. Extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, load

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
# Suffixes of two labels under which strangers register names; an argument where others are wanted.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my", "com.ng", "com.ph", "com.pk",
    "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "gob.mx", "gov.au", "gov.br", "gov.cn",
    "gov.in", "gov.uk", "ltd.uk", "me.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr",
    "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za", "blogspot.com", "github.io", "gitlab.io", "wordpress.com",
)
#: The suffix of numeric addresses; no host holds this character.
NUMERIC = "#"
#: Block hosts whose bad rate is above LIMIT with the confidence that Z standard deviations give.
LIMIT, Z = 0.5, 1.645
#: Range of the fitted prior strengths, in labelled pages.
WEAKEST, STRONGEST = 2.0, 1000.0


def host_column(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_column(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def rule_column(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits; of equally long ones the first by code point."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        below = (host == name) | host.endswith("." + name)
        fits.append(F.when(below & path.startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def domain_columns(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n))
    numeric = name.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$")
    long = last(2).isin(*suffixes) if suffixes else F.lit(False)
    return F.when(numeric, name).when(long, last(3)).otherwise(last(2)), F.when(numeric, F.lit(NUMERIC)).when(long, last(2)).otherwise(last(1))


def _strength(children: DataFrame) -> Column:
    """Prior strength by moments from n, bad and mean (the parent's rate) of the children: one row of sums."""
    spread = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2) / F.greatest(F.col("mean") * (1 - F.col("mean")), F.lit(1e-9))))
    kept = F.count(F.when(F.col("n") > 0, 1))
    total, squares = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    rho = F.try_divide(spread - (kept - 1), total - F.try_divide(squares, total) - (kept - 1))
    rho = F.coalesce(rho, F.lit(1 / (1 + STRONGEST)))
    return F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.try_divide(F.lit(1.0), F.greatest(rho, F.lit(1e-9))) - 1))


def _fitted(level: DataFrame) -> DataFrame:
    """level with k, the prior's strength: the fitted one, but no more than the weight of the level above, so that a prior from few
    pages is not taken for sure. One figure comes to the driver."""
    return level.withColumn("k", F.least(F.lit(level.agg(_strength(level).alias("k")).first()["k"]), F.col("weight")))


def _shrunk() -> list[Column]:
    """Posterior mean and weight, which are the prior of the level below."""
    return [((F.col("bad") + F.col("k") * F.col("mean")) / (F.col("n") + F.col("k"))).alias("mean"), (F.col("n") + F.col("k")).alias("weight")]


def reputations(hosts: DataFrame, limit: float = LIMIT, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, rate, lower, strength (of its prior, in pages) and blocked from host, n labelled and bad pages (one row a host).

    The whole's sums and the three strengths are the only figures that come to the driver.
    """
    domain, suffix = domain_columns(F.col("host"), suffixes)
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = ends.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (whole["bad"] or 0) / whole["n"] if whole["n"] else 0.0
    ends = _fitted(ends.withColumn("mean", F.lit(mean)).withColumn("weight", F.lit(max(WEAKEST, float(whole["n"] or 0)))))
    domains = _fitted(domains.join(ends.select("suffix", *_shrunk()), "suffix"))
    hosts = _fitted(hosts.join(domains.select("domain", *_shrunk()), "domain"))
    a, b = F.col("bad") + F.col("k") * F.col("mean"), F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("mean"))
    rate = a / (a + b)
    lower = rate - z * F.sqrt(rate * (1 - rate) / (a + b + 1))
    return hosts.select("host", "n", "bad", rate.alias("rate"), lower.alias("lower"), F.col("k").alias("strength"), (F.lit(bool(whole["n"])) & (lower > limit)).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str] = RULES, limit: float = LIMIT, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, and of its host the posterior bad rate, its lower bound and the strength of
    its prior (6 digits). outcomes: page_id and bad (0 to 1).

    A host with a third of all pages meets one verdict row in the last join, which Spark splits when it is skewed; before that,
    pages are summed by host in the map tasks.
    """
    parsed = pages.select("page_id", host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"))
    once = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.avg("bad").alias("bad"))
    hosts = parsed.select("page_id", "host").join(once, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    verdicts = reputations(hosts, limit, z, suffixes).select("host", F.when(F.col("blocked"), "block").otherwise("allow").alias("by_host"), *[F.round(c, 6).alias(f"host_{c}") for c in ("rate", "lower", "strength")])
    rule = rule_column(F.col("host"), F.col("path"), rules)
    by_rule = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]) if rules else F.create_map().cast("map<string,string>")
    out = parsed.join(verdicts, "host", "left").withColumn("rule", rule)
    verdict = F.coalesce(F.when(F.col("rule").isNotNull(), F.try_element_at(by_rule, F.col("rule"))), F.col("by_host"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "host_rate", "host_lower", "host_strength")


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Outcomes of pages by the labels of the text with the same id: bad if it is toxic or of low quality."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1.0).otherwise(0.0)
    return labels.where(F.col("toxic").isNotNull() | F.col("quality").isNotNull()).select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(load(spark, sf_dir, "pages"), outcomes_of(load(spark, sf_dir, "labels")))


def _strength_sql(table: str) -> str:
    rho = """coalesce((sum(CASE WHEN n > 0 THEN n * pow(bad / n - mean, 2) / greatest(mean * (1 - mean), 1e-9) END) - (count(CASE WHEN n > 0 THEN 1 END) - 1))
      / nullif(sum(n) - sum(n * n) / nullif(sum(n), 0) - (count(CASE WHEN n > 0 THEN 1 END) - 1), 0), 1 / 1001.0)"""
    return f"(SELECT least(1000.0, greatest(2.0, 1 / greatest({rho}, 1e-9) - 1)) FROM {table})"


SQL = {
    "op1_url_reputation": rf"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
once AS (SELECT doc_id AS page_id, avg(CASE WHEN toxic = 1 OR quality = 0 THEN 1.0 ELSE 0.0 END) AS bad FROM labels
         WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, CAST(count(o.bad) AS DOUBLE) AS n, coalesce(sum(o.bad), 0) AS bad, regexp_replace(host, ':[0-9]*$', '') AS name,
              string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS ls, regexp_full_match(regexp_replace(host, ':[0-9]*$', ''), '[0-9]+(\.[0-9]+){{3}}|\[.*\]') AS numeric
       FROM parsed p LEFT JOIN once o ON p.page_id = o.page_id GROUP BY host),
h1 AS (SELECT *, CASE WHEN numeric THEN 0 WHEN array_to_string(ls[-2:], '.') IN ({", ".join(f"'{s}'" for s in SUFFIXES)}) THEN 2 ELSE 1 END AS deep FROM h0),
h AS (SELECT host, n, bad, CASE deep WHEN 0 THEN '#' WHEN 1 THEN ls[-1] ELSE array_to_string(ls[-2:], '.') END AS suffix,
             CASE deep WHEN 0 THEN name WHEN 1 THEN array_to_string(ls[-2:], '.') ELSE array_to_string(ls[-3:], '.') END AS domain FROM h1),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, coalesce((SELECT sum(bad) / nullif(sum(n), 0) FROM d0), 0) AS mean,
             greatest(2.0, (SELECT sum(n) FROM d0)) AS weight FROM d0 GROUP BY suffix),
s2 AS (SELECT *, least({_strength_sql("s")}, weight) AS k FROM s),
d AS (SELECT d0.*, (s2.bad + s2.k * s2.mean) / (s2.n + s2.k) AS mean, s2.n + s2.k AS weight FROM d0 JOIN s2 ON d0.suffix = s2.suffix),
d2 AS (SELECT *, least({_strength_sql("d")}, weight) AS k FROM d),
hh AS (SELECT h.*, (d2.bad + d2.k * d2.mean) / (d2.n + d2.k) AS mean, d2.n + d2.k AS weight FROM h JOIN d2 ON h.domain = d2.domain),
hk AS (SELECT *, least({_strength_sql("hh")}, weight) AS k FROM hh),
ab AS (SELECT host, k, bad + k * mean AS a, n - bad + k * (1 - mean) AS b FROM hk),
v AS (SELECT host, round(a / (a + b), 6) AS host_rate, round(a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 6) AS host_lower, round(k, 6) AS host_strength, CASE WHEN (SELECT sum(n) FROM h) > 0 AND a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS by_host FROM ab),
ruled AS (SELECT page_id, host, path, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parsed)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE r.rule WHEN 'www.example.com/en/' THEN 'allow' WHEN 'com/' THEN 'allow' WHEN 'example.com/en/' THEN 'block' WHEN 'net/es/' THEN 'block' WHEN 'net/fr/' THEN 'block' ELSE v.by_host END AS verdict, v.host_rate, v.host_lower, v.host_strength
FROM ruled r LEFT JOIN v ON r.host = v.host""",
}
QUERIES = {"op1_url_reputation": op1_url_reputation}
