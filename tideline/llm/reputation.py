"""URL filters: longest-match rules, and for what they leave, empirical-Bayes reputation of hosts.

Outcomes of labelled pages are binomial draws with a host's rate of bad pages. Hosts share a beta prior centred on their
registered domain's rate, domains one centred on their suffix's, suffixes one centred on the overall rate. Each level's prior strength comes from
its overdispersion (moments of the beta-binomial). A host is blocked if the lower bound of its posterior rate exceeds a threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.shared import cut, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second labels that form a suffix with a country's two letters.
SECOND = "ac co com edu go gov ne net or org".split()
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Posterior bound: standard deviations below the mean; the rate from which a host is blocked; bounds of a prior's strength in pages.
Z, THRESHOLD, WEAKEST, STRONGEST = 1.645, 0.5, 1.0, 10_000.0


def url_parts(url):
    """(host, path) of a URL column, empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_of(host):
    """The last label, or the last two where they are like co.uk."""
    return F.regexp_extract(host, rf"(?:^|\.)((?:{'|'.join(SECOND)})\.[a-z][a-z]|[^.]*)$", 1)


def domain_of(host, suffix):
    """The suffix and one label before it."""
    return F.when(suffix.contains("."), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def matching_rule(host, path, rules: list[tuple[str, str]]):
    """(rule, verdict) of the longest of up to some hundreds of rules `host/path` that fits, else nulls."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, p = r[: r.index("/")], r[r.index("/") :]
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(r)) if rule is None else rule.when(fits, F.lit(r))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _level(groups: DataFrame, parent) -> DataFrame:
    """Adds the posterior mean `rate` and prior `strength` to groups with counts n, k, given the mean of each one's parent."""
    v = parent * (1 - parent)
    some = groups.where("n > 0").withColumn("m", parent).withColumn("v", v)
    fit = some.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), F.lit(2.0)) - F.col("v")).alias("over"), F.sum(F.col("v") * (F.col("n") - 1)).alias("room"))
    rho = F.when(F.col("room") > 0, F.col("over") / F.col("room")).otherwise(0.0)
    fit = fit.select(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), 1 / F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1e-6)) - 1)).alias("strength"))
    return groups.crossJoin(F.broadcast(fit)).withColumn("rate", (F.col("k") + F.col("strength") * parent) / (F.col("n") + F.col("strength")))  # fit has one row


def host_reputation(hosts: DataFrame) -> DataFrame:
    """(host, bound) from (host, n labelled pages, k bad ones), a row a host: the lower posterior bound of its rate of bad pages.

    Hosts without labels have their domain's rate, domains their suffix's, suffixes the overall one; without any label this is 0.
    """
    suffix = suffix_of(F.col("host"))
    hosts = hosts.select("host", F.col("n").cast("double").alias("n"), F.col("k").cast("double").alias("k"), domain_of(F.col("host"), suffix).alias("domain"), suffix.alias("suffix"))
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "suffixes")
    overall = suffixes.agg(F.coalesce(F.sum("k") / F.nullif(F.sum("n"), F.lit(0.0)), F.lit(0.0)).alias("base"))
    suffixes = _level(suffixes.crossJoin(F.broadcast(overall)), F.col("base")).select("suffix", F.col("rate").alias("suffix_rate"))
    domains = cut(_level(domains.join(suffixes, "suffix"), F.col("suffix_rate")).select("domain", "suffix", F.col("rate").alias("domain_rate")), "rates")
    rated = _level(hosts.join(domains, ["domain", "suffix"]), F.col("domain_rate"))
    a = F.col("k") + F.col("strength") * F.col("domain_rate")
    b = F.col("n") - F.col("k") + F.col("strength") * (1 - F.col("domain_rate"))
    return rated.select("host", (a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bound"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for every row of `pages`; outcomes are (page_id, bad boolean), several a page or none.

    A URL that is null or has no `://` has an empty host, which counts as one host. Outcomes that are null or of no page count nothing.
    Repeated rows stay. Empty tables give an empty result. Other columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    of = outcomes.where("bad is not null and page_id is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    hosts = rows.select("page_id", "host").join(of, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    bound = host_reputation(cut(hosts, "hosts"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(bound, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_host).alias("verdict"), F.round("bound", 6).alias("bound"))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page URLs; a page is bad if its label says low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    outcomes = labels.where("toxic is not null or quality is not null").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judged(table(spark, sf_dir, "pages"), outcomes)


def _sql_level(name: str, of: str, parent: str, keys: str) -> str:
    return f"""
{name}_fit as (
  select least({STRONGEST}::double, greatest({WEAKEST}::double, 1 / greatest(case when sum({parent} * (1 - {parent}) * (n - 1)) > 0
    then sum(n * power(k / n - {parent}, 2) - {parent} * (1 - {parent})) / sum({parent} * (1 - {parent}) * (n - 1)) else 0 end, 1e-6::double) - 1)) as strength
  from {of} where n > 0),
{name} as (
  select {keys}, n, k, {parent}, coalesce(strength, {STRONGEST}::double) as strength, (k + coalesce(strength, {STRONGEST}::double) * {parent}) / (n + coalesce(strength, {STRONGEST}::double)) as {name}_rate
  from {of} cross join {name}_fit)"""


_RULE = "case " + " ".join(f"when (host = '{r[: r.index('/')]}' or host like '%.{r[: r.index('/')]}') and starts_with(path, '{r[r.index('/') :]}') then '{{{k}}}'" for k, (_, r) in enumerate(sorted(RULES, key=lambda x: (-len(x[1]), x[1])))) + " end"
_SORTED = sorted(RULES, key=lambda x: (-len(x[1]), x[1]))
ORACLE_OP7 = f"""
with parsed as (
  select page_id, coalesce(case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end, '') as rest from pages),
pages2 as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parsed),
outcomes as (
  select doc_id as page_id, count(*) as n, sum(case when coalesce(toxic, 0) = 1 or coalesce(quality, 1) = 0 then 1 else 0 end) as k
  from labels where (toxic is not null or quality is not null) and doc_id is not null group by 1),
hosts0 as (
  select host, coalesce(sum(n), 0)::double as n, coalesce(sum(k), 0)::double as k from pages2 left join outcomes using (page_id) group by 1),
hosts1 as (
  select *, regexp_extract(host, '(?:^|\\.)((?:{'|'.join(SECOND)})\\.[a-z][a-z]|[^.]*)$', 1) as suffix from hosts0),
hosts2 as (
  select *, array_to_string(list_slice(string_split(host, '.'), case when contains(suffix, '.') then -3 else -2 end, -1), '.') as domain from hosts1),
domains0 as (select domain, suffix, sum(n) as n, sum(k) as k from hosts2 group by 1, 2),
suffixes0 as (select suffix, sum(n) as n, sum(k) as k from domains0 group by 1),
suffixes1 as (select *, coalesce((select sum(k) / nullif(sum(n), 0) from suffixes0), 0) as base from suffixes0),
{_sql_level("suffix2", "suffixes1", "base", "suffix")},
domains1 as (select d.*, suffix2_rate from domains0 d join suffix2 using (suffix)),
{_sql_level("domain2", "domains1", "suffix2_rate", "domain, suffix")},
hosts3 as (select h.*, domain2_rate from hosts2 h join domain2 using (domain, suffix)),
{_sql_level("host2", "hosts3", "domain2_rate", "host")},
beta as (select host, k + strength * domain2_rate as a, n - k + strength * (1 - domain2_rate) as b from host2),
bounds as (select host, a / (a + b) - {Z}::double * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from beta),
ruled as (select page_id, host, path, bound, {_RULE.format(*[r for _, r in _SORTED])} as rule from pages2 join bounds using (host))
select page_id, host, path, rule, case {' '.join(f"when rule = '{r}' then '{v}'" for v, r in _SORTED)} when bound > {THRESHOLD}::double then 'block' else 'allow' end as verdict, round(bound, 6) as bound
from ruled
"""
