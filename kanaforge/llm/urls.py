"""URL filters: path rules, then empirical-Bayes host reputation. DataFrame and SQL functions only.

Labelled page outcomes are summed by host, registered domain and suffix. Each level's counts are shrunk by a
beta-binomial prior whose mean is the level above's posterior mean and whose strength comes from the spread
between that level's members (the analysis-of-variance estimate of their correlation). A page is blocked when
the lower posterior bound of its host's rate of bad pages lies above a limit.

Defined cases: a null url, or one without `://`, has an empty host and path, and that host's reputation like any
other; hosts without outcomes take their domain's, suffix's or the overall rate; labels that are neither 0 nor 1
are no outcomes; repeated pages count each time; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kanaforge.llm.common import table

#: (verdict, host, path) of the production rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Block above this rate of bad pages, at this many posterior standard deviations below the mean.
LIMIT, DEVIATIONS = 0.5, 1.645
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 2.0, 1000.0
#: Second-level names that are part of a suffix below two-letter top domains, where no suffix list is given.
SECOND_LEVELS = ["ac", "co", "com", "edu", "gov", "net", "org"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null where none does. Rules are few."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def with_levels(df: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """df with domain and suffix of its host, user and port left out; an address is its own domain and suffix.

    suffixes: (suffix) of a public suffix list without wildcards, of which the longest that fits counts; where none
    fits, and for hosts without one, the last label. Without a list, SECOND_LEVELS below two-letter domains count too."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")
    address = bare.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | bare.startswith("[")
    parts = df.withColumn("_p", F.when(address, F.array(bare)).otherwise(F.split(bare, r"\.")))
    if suffixes is None:
        seconds = ", ".join(f"'{s}'" for s in SECOND_LEVELS)
        parts = parts.withColumn("_k", F.expr(f"if(size(_p) > 2 AND length(_p[size(_p) - 1]) = 2 AND _p[size(_p) - 2] IN ({seconds}), 2, 1)"))
    else:
        tails = parts.select("host", "_p").distinct().select("host", F.posexplode(F.expr("transform(sequence(1, size(_p)), k -> array_join(slice(_p, size(_p) - k + 1, k), '.'))")).alias("_at", "_tail"))
        known = tails.join(suffixes.select(F.lower("suffix").alias("_tail")).distinct(), "_tail").groupBy("host").agg((F.max("_at") + 1).alias("_k"))
        parts = parts.join(known, "host", "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    tail = "array_join(slice(_p, greatest(size(_p) - _k + 1 - {0}, 1), least(_k + {0}, size(_p))), '.')"
    return parts.withColumn("suffix", F.expr(tail.format(0))).withColumn("domain", F.expr(tail.format(1))).drop("_p", "_k")


def strength(counts: DataFrame) -> float:
    """Prior strength between the members (n, bad) of a level, in pages: one number."""
    s = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("m"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("within")).first()
    if not s["m"] or s["m"] < 2 or s["n"] <= s["m"]:
        return STRONGEST
    n, bad, m = float(s["n"]), float(s["bad"]), s["m"]
    within = (bad - s["within"]) / (n - m)
    between = max(0.0, s["within"] - bad * bad / n) / (m - 1)
    size = (n - float(s["nn"]) / n) / (m - 1)
    total = between + (size - 1) * within
    rho = (between - within) / total if total > 0 else 0.0
    return min(max(1 / rho - 1, WEAKEST), STRONGEST) if rho > 0 else STRONGEST


def reputations(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, prior, strength) from the outcomes (host, bad): a row for every host that occurs.

    bad is 0, 1 or null (no outcome). The posterior of a host is Beta(prior * strength + bad, ...)."""
    hosts = table(with_levels(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")), suffixes))
    domains = table(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = table(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    seen = "n > 0"
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (total[1] + 0.5) / (total[0] + 1)
    m_suffix, m_domain, m_host = (strength(x.where(seen)) for x in (suffixes, domains, hosts))
    by_suffix = suffixes.select("suffix", ((F.col("bad") + m_suffix * overall) / (F.col("n") + m_suffix)).alias("_up"))
    by_domain = table(domains.join(by_suffix, "suffix").select("domain", ((F.col("bad") + m_domain * F.col("_up")) / (F.col("n") + m_domain)).alias("prior")))
    return table(hosts.join(by_domain, "domain").select("host", "n", "bad", "prior", F.lit(m_host).alias("strength")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, limit: float = LIMIT, deviations: float = DEVIATIONS, suffixes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate, bad_rate_bound) of pages (page_id, url).

    outcomes: (page_id, bad) of labelled pages; of several rows of a page the worst counts. suffixes: as in with_levels()."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    labelled = outcomes.where(F.col("bad").isin(0, 1)).groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = reputations(parsed.select("page_id", "host").join(labelled, "page_id", "left"), suffixes)
    a = F.col("prior") * F.col("strength") + F.col("bad")
    b = (1 - F.col("prior")) * F.col("strength") + F.col("n") - F.col("bad")
    bound = known.select(F.col("host"), (a / (a + b)).alias("bad_rate"), (a / (a + b) - deviations * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bad_rate_bound"))
    rule, verdict = rule_columns(rules)
    method = F.when(F.col("bad_rate_bound") > limit, "block").otherwise("allow")
    return parsed.join(bound, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_rate", "bad_rate_bound")
