"""URL filter: hand-written rules first, empirical-Bayes host reputation for the rest.

Labelled page outcomes (bad or not) are counted per host.  The bad rate of a host is shrunk towards
its registered domain's, that towards its public suffix's, that towards the whole table's: at each
level the children's rates get a beta prior whose mean is the parent's shrunk rate and whose strength
comes from the spread between children that binomial noise does not explain (method of moments).
A host is blocked when the lower bound of its posterior bad rate (the normal approximation of the beta posterior's
quantile, from its mean and variance) lies above ``threshold``.

All of it is DataFrame work: one partial aggregation by host, three small ones above it, and one join
of pages with their host's row (the host table is written first, so that a host with a third of all
pages is split by the adaptive skew join or meets a broadcast of checked size).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import ascii_lower, written


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Suffixes of two labels under which names are registered (a default; callers may give their own list).
SECOND_LEVEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "plc.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.jp", "or.jp", "ne.jp",
    "ac.jp", "go.jp", "co.nz", "org.nz", "net.nz", "com.br", "org.br", "net.br", "gov.br", "co.in", "org.in", "net.in", "co.za", "org.za", "co.kr",
    "or.kr", "com.mx", "org.mx", "com.cn", "net.cn", "org.cn", "com.tw", "org.tw", "com.tr", "org.tr", "com.ar", "com.sg", "com.hk", "com.my", "com.ph",
    "com.vn", "com.ua", "co.il", "org.il", "co.id", "or.id", "co.th", "or.th", "com.pl", "org.pl", "com.es", "com.pt", "com.co", "com.pe", "com.ve",
    "com.ec", "com.eg", "com.sa", "com.pk", "com.bd", "com.ng", "co.ke", "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "tumblr.com",
    "herokuapp.com", "netlify.app", "vercel.app", "web.app", "pages.dev")
THRESHOLD = 0.5
Z = 1.645
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
MAX_RULES = 1000


def split_url(url):
    """(host, path) columns of a URL column; both empty for null or a text without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.when(has, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def longest_rule(host, path, rules=RULES):
    """The longest rule (as a struct of text and verdict) that fits host and path, else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def registered_domain(host, suffixes=SECOND_LEVEL_SUFFIXES):
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def public_suffix(host, suffixes=SECOND_LEVEL_SUFFIXES):
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def _strength(children: DataFrame) -> float:
    """Prior strength for ``children`` (n, bad, parent's raw rate ``up``) by the method of moments."""
    c = children.where("n > 0").withColumn("d", F.col("bad") / F.col("n") - F.col("up"))
    row = c.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
                F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
                F.sum(F.col("n") * F.col("d") * F.col("d")).alias("s")).first()
    if not row.k or row.k < 2:
        return MAX_STRENGTH
    n, p = float(row.n), float(row.bad) / float(row.n)
    noise = p * (1 - p)
    denominator = n - float(row.n2) / n
    between = (float(row.s) - (row.k - 1) * noise) / denominator if denominator > 0 else 0.0
    if between <= 0 or noise <= 0:
        return MAX_STRENGTH
    return min(MAX_STRENGTH, max(MIN_STRENGTH, noise / between - 1))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z, second_level=SECOND_LEVEL_SUFFIXES) -> DataFrame:
    """``host, n, bad, bad_rate, bad_lower``: one row a host of ``pages`` (``page_id, host``), from
    ``outcomes`` (``page_id, bad`` 0/1; null outcomes are not counted).  Hosts without labelled pages
    take their domain's posterior, and so on up; without any labels the rate is a half."""
    marked = pages.join(outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL")
                        .groupBy("page_id").agg(F.max("bad").cast("int").alias("bad")), "page_id", "left")
    hosts = written(marked.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
                    .withColumn("domain", registered_domain(F.col("host"), second_level)).withColumn("suffix", public_suffix(F.col("host"), second_level)),
                    "hosts")
    level = lambda frame, *keys: frame.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = level(hosts, "domain", "suffix")
    suffixes = level(domains, "suffix")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = float(total.bad) / float(total.n) if total.n else 0.5
    raw = lambda c: F.coalesce(F.col(f"{c}.bad") / F.nullif(F.col(f"{c}.n"), F.lit(0)), F.lit(overall))

    def above(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
        return child.alias("c").join(parent.alias("p"), F.col(f"c.{key}") == F.col(f"p.{key}"), "left") \
            .select("c.*", raw("p").alias("up"))

    s_suffix = _strength(suffixes.withColumn("up", F.lit(overall)))
    s_domain = _strength(above(domains, suffixes, "suffix"))
    s_host = _strength(above(hosts, domains, "domain"))
    shrunk = lambda prior, s: (F.col("bad") + s * prior) / (F.col("n") + s)
    suffixes = suffixes.select("suffix", shrunk(F.lit(overall), s_suffix).alias("m_suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", shrunk(F.col("m_suffix"), s_domain).alias("m_domain"))
    rate = shrunk(F.col("m_domain"), s_host)
    return hosts.join(domains, "domain").select(
        "host", "n", "bad", rate.alias("bad_rate"),
        F.greatest(F.lit(0.0), rate - z * F.sqrt(rate * (1 - rate) / (F.col("n") + s_host + 1))).alias("bad_lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = THRESHOLD, z: float = Z,
               id_col: str = "page_id", url_col: str = "url", second_level=SECOND_LEVEL_SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bad_lower`` for every page.

    Null urls and texts without ``://`` have empty host and path and are judged by the reputation of
    the empty host; null ids carry no label; repeated rows give a row each; an empty table gives
    none; other columns are not looked at."""
    host, path = split_url(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"))
    hosts = written(host_reputation(parsed, outcomes, z, second_level).select("host", "bad_rate", "bad_lower"), "host-reputation")
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bad_lower") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.withColumn("_rule", rule).join(hosts, "host").select(
        "page_id", "host", "path", F.col("_rule.text").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_method).alias("verdict"),
        "bad_rate", "bad_lower")
