"""Operator 10, URL filters: rules first, else empirical-Bayes reputation of the host, in DataFrame functions only.

Labelled page outcomes are counted by host, registered domain and suffix. At each level a beta-binomial prior is
centred on the posterior mean of the level above (suffix on the whole corpus, domain on its suffix, host on its
domain); its strength comes from the one-way analysis-of-variance estimate of the correlation within the groups of
that level. A host is blocked when the lower ``BOUND`` quantile of its posterior rate of bad pages exceeds ``MAX_BAD``,
that is, when the posterior beta distribution has less than ``BOUND`` of its mass up to there (``chance_above``).

A host with few labels so inherits what is known of its domain, and a host without labels can still be judged.

Suffixes of two labels are known from a fixed table (``SUFFIXES``), ports are not part of a domain, and an address is
its own domain and suffix.

Edge cases: a null url, or one without ``://``, has an empty host and path and is allowed; labels without a page or
with null outcomes count as not bad; several labels of a page count once, as bad if any is; repeated pages each
count and each get a row; with no labels at all every page that no rule names is allowed; an empty table gives an
empty result. Other columns of the pages are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored

#: Fixed values, the rules of the contract: (verdict, host with its subdomains, start of the path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Block above this rate, at this one-sided posterior bound; steps of each of the two integrals behind it.
MAX_BAD, BOUND, STEPS = 0.5, 0.05, 64
#: Least and greatest prior strength, in pages.
LEAST_STRENGTH, GREATEST_STRENGTH = 2.0, 1000.0

#: Public suffixes of two labels, as second labels by country; any other suffix is the last label.
SUFFIXES = {
    "uk": "co org me ltd plc net sch ac gov nhs police", "au": "com net org edu gov asn id", "nz": "co net org govt ac school geek gen maori iwi cri health mil",
    "br": "com net org gov edu art blog eco ind inf adv eng med mil tv wiki", "jp": "co ne or ac ad ed go gr lg", "kr": "co ne or re pe go ac hs ms es sc",
    "in": "co net org gen firm ind ac edu res gov nic mil", "id": "co or net web ac sch go mil my desa", "il": "co org net ac gov k12 muni idf", "za": "co org net web ac gov law edu nom school",
    "cn": "com net org gov edu ac mil", "tw": "com net org gov edu idv game club ebiz mil", "hk": "com net org gov edu idv", "sg": "com net org gov edu per", "my": "com net org gov edu mil name",
    "th": "co or net ac go in mi", "ph": "com net org gov edu mil ngo", "vn": "com net org gov edu ac info name pro health biz int", "pk": "com net org gov edu fam biz web", "bd": "com net org gov edu ac mil",
    "tr": "com net org gov edu bel biz info name web gen tv av dr k12 tel bbs pol mil", "mx": "com net org gob edu", "ar": "com net org gob edu int mil tur", "co": "com net org gov edu nom mil", "pe": "com net org gob edu nom mil",
    "ve": "com net org gob edu co info web", "ec": "com net org gob edu fin info med pro", "uy": "com net org gub edu mil", "ua": "com net org gov edu in kiev kyiv lviv odessa", "pl": "com net org gov edu info biz waw",
    "gr": "com net org gov edu", "cy": "com net org gov ac biz ltd", "es": "com nom org gob edu", "pt": "com net org gov edu int nome publ", "fr": "com asso nom prd tm gouv", "hu": "co org info", "at": "co or ac gv",
    "ru": "com net org msk spb", "ke": "co or ne go ac sc me mobi info", "ng": "com net org gov edu name sch mobi mil i", "gh": "com org gov edu mil", "eg": "com net org gov edu eun mil name sci", "ma": "co net org gov ac press",
    "sa": "com net org gov edu med pub sch", "ae": "co net org gov ac sch mil", "cr": "co or fi go ac ed sa", "tz": "co or ne go ac sc me info", "ug": "co or ne go ac sc com org", "zw": "co org ac gov mil", "lk": "com net org gov edu ac", "np": "com net org gov edu mil",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


_SECOND = "|".join(f"(?:{'|'.join(second.split())})[.]{country}" for country, second in SUFFIXES.items())
_ADDRESS = r"^(?:[0-9]{1,3}(?:[.][0-9]{1,3}){3}|\[.*\])$"


def _name(host: Column) -> Column:
    """The host without user, port and the dot of the root."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*$", ""), "[.]$", "")


def domain_of(host: Column) -> Column:
    """Registered domain: the public suffix and one label more; an address is its own domain."""
    name = _name(host)
    labels = F.when(name.rlike(rf"[.](?:{_SECOND})$"), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return F.when(name.rlike(_ADDRESS), name).otherwise(labels)


def suffix_of(host: Column) -> Column:
    """Public suffix, the longest that is known (``SUFFIXES``); that of an address is itself."""
    name = _name(host)
    labels = F.when(name.rlike(rf"(?:^|[.])(?:{_SECOND})$"), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return F.when(name.rlike(_ADDRESS), name).otherwise(labels)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, both null if none does."""
    rule = verdict = None
    for what, rule_host, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(start)
        rule = (F if rule is None else rule).when(fits, F.lit(rule_host + start))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(what))
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def host_counts(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, k): labelled pages and bad ones of each host that has pages. ``outcomes``: page_id, bad."""
    once = outcomes.groupBy("page_id").agg(F.max(F.coalesce("bad", F.lit(0))).alias("bad"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(once, "page_id", "left")
    return seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("k"))


def strengths(hosts: DataFrame) -> tuple[float, dict[str, float]]:
    """The corpus' rate of bad pages and the prior strength of each level; fifteen sums reach the driver."""
    levels = {"host": F.col("host"), "domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}
    rate, found = 0.0, {}
    for level, key in levels.items():
        groups = hosts.filter("n > 0").groupBy(key.alias("key")).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        x = groups.agg(
            F.count("*").alias("m"),
            F.sum("n").alias("n"),
            F.sum("k").alias("k"),
            F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
            F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk"),
        ).first()
        if x["m"]:
            rate = x["k"] / x["n"]
        found[level] = strength(x["m"], x["n"], x["k"], x["nn"], x["kk"])
    return rate, found


def strength(m: int, n: int | None, k: int | None, nn: float | None, kk: float | None) -> float:
    """Beta-binomial a + b from m groups with sums n, k, n², k²/n; the greatest if the groups don't differ."""
    if m < 2 or n <= m:
        return GREATEST_STRENGTH
    between, within, size = (kk - k * k / n) / (m - 1), (k - kk) / (n - m), (n - nn / n) / (m - 1)
    below = between + (size - 1) * within
    alike = (between - within) / below if below > 0 else 0.0
    return min(max(1 / alike - 1, LEAST_STRENGTH), GREATEST_STRENGTH) if alike > 0 else GREATEST_STRENGTH


def chance_above(a: Column, b: Column, x: float = MAX_BAD, steps: int = STEPS) -> Column:
    """The mass of the beta distribution (a, b) above ``x``, by Simpson's rule to some 1e-4.

    In the logit u of the rate the density is that of rate^a (1 - rate)^b, which is smooth for all a, b > 0, has its
    peak at log(a / b) and there the width sqrt(1/a + 1/b), and falls off like exp(a u) and exp(-b u).
    """
    peak, width = F.log(a) - F.log(b), F.sqrt(1 / a + 1 / b)
    soft = lambda u: F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))  # noqa: E731  log(1 + exp(u))
    log_density = lambda u: -a * soft(-u) - b * soft(u)
    weights = F.array(*(F.lit(1.0 if k in (0, steps) else 4.0 if k % 2 else 2.0) for k in range(steps + 1)))

    def integral(low: Column, high: Column) -> Column:
        point = lambda k: low + (high - low) * k / F.lit(steps)
        terms = F.transform(weights, lambda w, k: w * F.exp(log_density(point(k)) - log_density(peak)))
        return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term) * (high - low)

    ends = F.struct((peak - 8 * width - 20 / a).alias("low"), (peak + 8 * width + 20 / b).alias("high"))

    def mass(e: Column) -> Column:
        cut = F.least(F.greatest(F.lit(math.log(x / (1 - x))), e["low"]), e["high"])
        both = F.struct(integral(e["low"], cut).alias("below"), integral(cut, e["high"]).alias("above"))
        return let(both, lambda m: m["above"] / (m["below"] + m["above"]))

    return let(ends, mass)


def reputations(hosts: DataFrame, max_bad: float = MAX_BAD) -> DataFrame:
    """(host, bad_rate, bad_chance): each host's posterior mean, and how likely its rate is above ``max_bad``."""
    rate, by = strengths(hosts)
    posterior = lambda k, n, mean, s: (F.col(k) + F.lit(s) * mean) / (F.col(n) + F.lit(s))
    domains = hosts.groupBy(domain_of(F.col("host")).alias("domain")).agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy(suffix_of(F.col("domain")).alias("suffix")).agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    suffixes = suffixes.select("suffix", posterior("sk", "sn", F.lit(rate), by["suffix"]).alias("sp"))
    domains = domains.withColumn("suffix", suffix_of(F.col("domain"))).join(suffixes, "suffix")
    domains = domains.select("domain", posterior("dk", "dn", F.col("sp"), by["domain"]).alias("dp"))
    out = hosts.withColumn("domain", domain_of(F.col("host"))).join(domains, "domain")
    least = 1e-3  # pages: keeps a and b above 0 where nothing or all is bad
    a, b = (F.greatest(x + F.lit(by["host"]) * mean, F.lit(least)) for x, mean in ((F.col("k"), F.col("dp")), (F.col("n") - F.col("k"), 1 - F.col("dp"))))
    out = out.select("host", posterior("k", "n", F.col("dp"), by["host"]).alias("bad_rate"), a.alias("a"), b.alias("b"))
    return out.select("host", "bad_rate", chance_above(F.col("a"), F.col("b"), max_bad).alias("bad_chance"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, bad_rate, bad_chance.

    ``outcomes``: page_id, bad (0 or 1). Pages are counted by host once, before a shuffle of the counts. Pages meet their
    host's row in a left join, in which Spark splits a hot host's pages over tasks (adaptive execution).
    """
    known = reputations(stored(host_counts(pages, outcomes), "host-counts"), max_bad)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path")).join(known, "host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("host") != "") & (F.col("bad_chance") > 1 - BOUND), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bad_rate", "bad_chance")
