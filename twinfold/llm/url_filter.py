"""URL filters: path rules first, then the reputation of hosts by empirical Bayes.

Labelled outcomes of pages are counted by host, registered domain and suffix. Each level's good share is shrunk towards
that of the level above, as a beta-binomial posterior whose prior weight is estimated from how much the shares of that
level spread. A host is blocked where even the upper bound of its posterior is below ``least``. A host nobody labelled has
its domain's prior, or that of its suffix or of all where these have no labels either, as wide as the spreads of the levels
between them and the host make it.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed. Without any label all
are allowed that no rule blocks. Labels other than 0 and 1, null ones included, are not counted. Repeated rows are judged one by one. Input columns named
host, path, rule or verdict are replaced, other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinfold.llm.frames import Scratch, col, free_name

#: (allow or block, rule): the rule's host, then the beginning of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Suffixes of several labels below which names are registered, the common ones of country and hosting
#: domains, and the names that are reserved for examples. Elsewhere the last label is the suffix.
SUFFIXES = (
    "example.com", "example.net", "example.org",
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk",
    "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp",
    "ac.kr", "co.kr", "go.kr", "ne.kr", "or.kr", "re.kr",
    "ac.cn", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.tw", "edu.tw", "gov.tw", "net.tw", "org.tw",
    "com.hk", "edu.hk", "gov.hk", "net.hk", "org.hk",
    "com.sg", "edu.sg", "gov.sg", "net.sg", "org.sg",
    "com.my", "edu.my", "gov.my", "net.my", "org.my",
    "ac.id", "co.id", "go.id", "or.id", "sch.id", "web.id",
    "ac.th", "co.th", "go.th", "in.th", "or.th",
    "com.vn", "edu.vn", "gov.vn", "net.vn", "org.vn",
    "com.ph", "edu.ph", "gov.ph", "net.ph", "org.ph",
    "ac.in", "co.in", "edu.in", "gov.in", "net.in", "nic.in", "org.in",
    "com.pk", "edu.pk", "gov.pk", "net.pk", "org.pk",
    "com.bd", "edu.bd", "gov.bd", "net.bd", "org.bd",
    "ac.za", "co.za", "gov.za", "net.za", "org.za",
    "ac.ke", "co.ke", "go.ke", "or.ke",
    "com.ng", "edu.ng", "gov.ng", "org.ng",
    "com.eg", "edu.eg", "gov.eg", "org.eg",
    "ac.il", "co.il", "gov.il", "net.il", "org.il",
    "com.tr", "edu.tr", "gov.tr", "net.tr", "org.tr",
    "com.sa", "edu.sa", "gov.sa", "net.sa", "org.sa",
    "com.ua", "edu.ua", "gov.ua", "net.ua", "org.ua",
    "com.pl", "edu.pl", "gov.pl", "net.pl", "org.pl",
    "com.gr", "edu.gr", "gov.gr", "org.gr",
    "com.br", "edu.br", "gov.br", "net.br", "org.br",
    "com.ar", "edu.ar", "gob.ar", "net.ar", "org.ar",
    "com.mx", "edu.mx", "gob.mx", "net.mx", "org.mx",
    "com.co", "edu.co", "gov.co", "net.co", "org.co",
    "com.pe", "edu.pe", "gob.pe", "org.pe",
    "com.ve", "edu.ve", "gob.ve", "org.ve",
    "appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com",
)
LEAST, DEVIATIONS = 0.5, 2.0
PRIOR_WEIGHT = (2.0, 1000.0)
#: Hosts up to which their reputations are broadcast (some 100 bytes each).
BROADCAST_HOSTS = 50_000
SALTS = 32

_AFTER = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _AFTER, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _AFTER, 2), F.lit(""))


#: Addresses by number: four parts, or one in brackets.
_ADDRESS = r"^(?:[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"


def reputation_host(host: Column) -> Column:
    """What a reputation belongs to: the host without user and port, and without a dot at its end."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), r"(?<=.)\.$", "")


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The longest known suffix, else the last label; an address is its own."""
    labels = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    known = F.get(F.filter(tails, lambda t: t.isin(sorted(suffixes))), F.lit(0))
    return F.when(host.rlike(_ADDRESS), host).otherwise(F.coalesce(known, F.substring_index(host, ".", -1)))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and one label more."""
    under = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(host) <= F.length(suffix), host).otherwise(F.concat(F.substring_index(under, ".", -1), F.lit("."), suffix))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<verdict:string, rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def prior_weight(counts: DataFrame, mean: str) -> float:
    """By moments: how many outcomes the prior is worth, from the spread of shares around their priors' means.

    A share of n outcomes around m varies by m (1 - m) / n if all rates are equal, and by m (1 - m) (1 + (n - 1) r) / n
    with a spread r = 1 / (weight + 1).
    """
    m, n = F.col(mean), F.col("n")
    unit = n / (m * (1 - m))
    some = counts.filter((n > 0) & (m > 0) & (m < 1)).agg(F.sum(unit * F.pow(F.col("good") / n - m, F.lit(2)) - 1).alias("beyond"), F.sum(n - 1).alias("scale")).first()
    if not some["scale"]:
        return PRIOR_WEIGHT[1]
    r = some["beyond"] / some["scale"]
    return min(max(1 / r - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1]) if r > 0 else PRIOR_WEIGHT[1]


def levels(outcomes: DataFrame, suffixes, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Posteriors of hosts, domains and suffixes with outcomes (host, good 0 or 1), and of all: share and weights by level."""
    hosts = outcomes.filter(F.col("good").isin(0, 1) & (F.col("host") != "")).groupBy("host").agg(F.count("*").alias("n"), F.sum("good").cast("long").alias("good"))
    hosts = scratch.save(named(hosts, suffixes))
    sums = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    top = {"n": sums["n"] or 0, "share": ((sums["good"] or 0) + 1) / ((sums["n"] or 0) + 2)}

    def level(name: str, counts: DataFrame, prior: str) -> DataFrame:
        """mean: the posterior mean under the prior mean in that column."""
        top[name] = prior_weight(counts, prior)
        return counts.withColumn("weight", F.lit(top[name])).withColumn("mean", (F.col("good") + F.col("weight") * F.col(prior)) / (F.col("n") + F.col("weight")))

    count = lambda by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffix = level("suffix", count(["suffix"]).withColumn("prior", F.lit(top["share"])), "prior").select("suffix", F.col("mean").alias("prior"))
    domain = level("domain", count(["suffix", "domain"]).join(suffix, "suffix"), "prior").select("domain", F.col("mean").alias("prior"))
    host = level("host", hosts.join(domain, "domain"), "prior")
    a, total = F.col("mean") * (F.col("n") + F.col("weight")), F.col("n") + F.col("weight")
    spread = F.sqrt(a * (total - a) / (total * total * (total + 1)))
    host = scratch.save(host.select("host", "n", "good", "mean", (F.col("mean") + DEVIATIONS * spread).alias("upper")))
    return host, domain, suffix, top


def named(hosts: DataFrame, suffixes) -> DataFrame:
    return hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn("domain", domain_of(F.col("host"), F.col("suffix")))


def reputations(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """host, n, good, mean, upper for each host with outcomes (host, good 0 or 1)."""
    return levels(outcomes, suffixes, Scratch(outcomes.sparkSession, "url-filter"))[0]


def bounds(hosts: DataFrame, outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """host, upper for each of the distinct hosts, with outcomes or without."""
    scratch = Scratch(outcomes.sparkSession, "url-filter")
    known, domain, suffix, top = levels(outcomes, suffixes, scratch)
    if not top["n"]:
        return known.select("host", "upper")
    rest = named(hosts.filter(F.col("host") != "").join(known, "host", "left_anti"), suffixes)
    rest = rest.join(domain.withColumnRenamed("prior", "of_domain"), "domain", "left").join(suffix.withColumnRenamed("prior", "of_suffix"), "suffix", "left")
    mean = F.coalesce("of_domain", "of_suffix", F.lit(top["share"]))

    def spread(*names: str) -> float:
        """Of a rate that is drawn around the mean level by level, the variance as a share of mean (1 - mean)."""
        left = 1.0
        for x in names:
            left *= 1 - 1 / (top[x] + 1)
        return 1 - left

    part = F.when(F.col("of_domain").isNotNull(), spread("host")).when(F.col("of_suffix").isNotNull(), spread("domain", "host")).otherwise(spread("suffix", "domain", "host"))
    rest = rest.select("host", (mean + DEVIATIONS * F.sqrt(mean * (1 - mean) * part)).alias("upper"))
    return known.select("host", "upper").unionByName(rest)


def judge(pages: DataFrame, outcomes: DataFrame, *, url_col: str = "url", rules=RULES, suffixes=SUFFIXES, least: float = LEAST) -> DataFrame:
    """The pages with columns host, path, rule and verdict. ``outcomes``: url, good (0 or 1)."""
    pages = pages.drop("host", "path", "rule", "verdict")
    rule, host, upper, salt, other, whose = (free_name(pages, x) for x in ("rule", "host", "upper", "salt", "salt_of", "whose"))
    url = col(url_col).cast("string")
    seen = pages.select(reputation_host(host_of(url)).alias("host")).distinct()
    known = bounds(seen, outcomes.select(reputation_host(host_of(F.col("url"))).alias("host"), F.col("good").cast("int").alias("good")), suffixes).filter(F.col("upper") < least).select(F.col("host").alias(host), F.col("upper").alias(upper))
    known = Scratch(pages.sparkSession, "url-filter").save(known)
    pages = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url)).withColumn(whose, reputation_host(F.col("host")))
    if known.count() <= BROADCAST_HOSTS:
        pages = pages.join(F.broadcast(known), col(whose) == col(host), "left")
    else:
        dealt = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        pages = pages.withColumn(other, F.pmod(F.xxhash64(url), F.lit(SALTS))).join(dealt, (col(whose) == col(host)) & (col(salt) == col(other)), "left").drop(salt, other)
    pages = pages.withColumn(rule, rule_for(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(col(rule)["verdict"], F.when(col(upper).isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return pages.withColumn("rule", col(rule)["rule"]).withColumn("verdict", verdict).drop(rule, host, upper, whose)
