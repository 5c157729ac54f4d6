"""URL filters by Empirical-Bayes host reputation (DataFrame operations only).

Labelled page outcomes are counted by host. Three beta-binomial priors shrink
them: a suffix's rate towards that of all pages, a registered domain's towards
its suffix's, a host's towards its domain's; the strength of each prior is
estimated from the rates of its own level. A page passes if the lower quantile
of its host's beta posterior reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot

#: Second labels under which countries register names (with a country's two-letter label: a suffix of two labels).
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "id", "ltd", "me", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "police", "sch")
#: Bounds on the estimated strengths of the priors, cells of the grid on which posteriors are summed, the quantile.
LEAST, MOST, CELLS, QUANTILE = 1.0, 50.0, 400, 0.05
#: (host, path prefix, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^([^?#]*)", 1)
    return _ascii_lower(host), path


def domain_of(host: Column, second: Sequence[str] = SECOND_LABELS) -> tuple[Column, Column]:
    """Registered domain and suffix of a host: a suffix has two labels under a country's second label, else one."""
    last2, last3 = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    two = last2.rlike(rf"^(?:{'|'.join(second)})\.[a-z]{{2}}$")
    return F.when(two, last3).otherwise(last2), F.when(two, last2).otherwise(F.substring_index(host, ".", -1))


def _last(host: Column, labels: Column) -> Column:
    """The last so many labels of a host."""
    return F.call_function("substring_index", host, F.lit("."), -labels)


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds ``domain`` and ``suffix`` to rows of distinct ``host``.

    ``suffixes``: a table of public suffixes (``suffix``, of up to four labels,
    lower case); the longest that ends a host counts, and a host that none ends
    goes by the rule of ``domain_of``. Without a table all go by the rule.
    """
    domain, suffix = domain_of(F.col("host"))
    if suffixes is None:
        return hosts.withColumns({"domain": domain, "suffix": suffix})
    ends = hosts.select("host", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("labels")).select("host", "labels", _last(F.col("host"), F.col("labels")).alias("suffix"))
    listed = ends.join(suffixes.select("suffix").distinct(), "suffix").groupBy("host").agg(F.max("labels").alias("labels"))
    held = hosts.join(listed, "host", "left")
    found = [_last(F.col("host"), F.col("labels") + k) for k in (1, 0)]
    return held.select(*hosts.columns, F.coalesce(found[0], domain).alias("domain"), F.coalesce(found[1], suffix).alias("suffix"))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and its subdomains, path prefix) and its verdict.

    The rule's name is host + path; its length decides, then the host's length.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_counts(labelled: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``host, n, good, domain, suffix`` from rows of ``host, good_page`` (boolean).

    Rows with a null outcome take no part; a null host counts as the empty one.
    """
    by_host = labelled.where(F.col("good_page").isNotNull()).groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count("*").alias("n"), F.count_if("good_page").alias("good"))
    return with_domains(by_host, suffixes)


def strength_of(counts: DataFrame, above: str) -> float:
    """Pseudo-counts of the beta-binomial prior of one level's rates around the rate ``above`` each, by moments.

    ``counts``: ``n, good`` and the rate above. The share of the variance beyond
    the binomial law is the weighted sum of squares less what that law gives,
    over what full correlation inside a group would add; the strength is kept
    between LEAST and MOST. One aggregate of one row.
    """
    noise = F.col(above) * (1 - F.col(above))
    spread, room = counts.agg(F.sum(F.pow(F.col("good") - F.col("n") * F.col(above), 2) / F.col("n") - noise), F.sum(noise * (F.col("n") - 1))).first()
    return min(MOST, max(LEAST, room / spread - 1)) if spread and spread > 0 and room > 0 else MOST


def shrunk(good: Column, n: Column, above: Column, strength: float) -> Column:
    """Mean of the beta posterior."""
    return (good + strength * above) / (n + strength)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, and not wherever a loop inside the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_quantile(a: Column, b: Column, quantile: float = QUANTILE) -> Column:
    """The lower quantile of the beta law with parameters a and b, to a cell of a grid.

    The density is summed at the middles of CELLS cells; the result is the lower
    end of the first cell up to whose end at least ``quantile`` of the sum lies.
    """
    middles = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: (i + 0.5) / CELLS)
    log = F.transform(middles, lambda x: (a - 1) * F.log(x) + (b - 1) * F.log(1 - x))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("below"))

    def below(w: Column, limit: Column) -> Column:
        return F.aggregate(w, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["below"] + F.when(s["sum"] + x < limit, 1).otherwise(0)).alias("below")), lambda s: s["below"] / CELLS)

    def weighed(w: Column) -> Column:
        return _let(quantile * F.aggregate(w, F.lit(0.0), lambda s, x: s + x), lambda limit: below(w, limit))

    return _let(log, lambda held: _let(F.array_max(held), lambda top: _let(F.transform(held, lambda x: F.exp(x - top)), weighed)))


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, quantile: float = QUANTILE, threshold: float = 0.5, suffixes: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, posterior_mean, bound`` for every row of pages.

    ``labelled``: rows of ``host`` and ``good_page``. A host without labelled
    pages has its domain's posterior mean as its prior, else its suffix's, else
    that of all. Null urls have an empty host and path and are judged like other
    hosts. Repeated rows are kept, other columns ignored, an empty table stays
    empty. Counts by host are written once; they join back by host, domain and
    suffix, one row for each host. Hosts of very many pages are broadcast to
    their pages (``join_hot``).
    """
    scratch = Scratch(pages.sparkSession, "hosts")
    host, path = split_url(F.col("url"))
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    counts = scratch.save(host_counts(labelled, suffixes))
    n, good = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    everyone = (good + 1) / (n + 2)
    total = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    by_suffix = counts.groupBy("suffix").agg(*total).withColumn("above", F.lit(everyone))
    s_strength = strength_of(by_suffix, "above")
    by_suffix = by_suffix.select("suffix", shrunk(F.col("good"), F.col("n"), F.col("above"), s_strength).alias("s_mean"))
    by_domain = counts.groupBy("domain", "suffix").agg(*total).join(by_suffix, "suffix")
    d_strength = strength_of(by_domain, "s_mean")
    by_domain = by_domain.select("domain", "suffix", shrunk(F.col("good"), F.col("n"), F.col("s_mean"), d_strength).alias("d_mean"))
    h_strength = strength_of(counts.join(by_domain.drop("suffix"), "domain"), "d_mean")
    # one row for each distinct host, so that the pages are joined once
    hosts = with_domains(parsed.groupBy("host").agg(F.count("*").alias("pages")), suffixes)
    hosts = hosts.join(by_suffix, "suffix", "left").join(by_domain.drop("suffix"), "domain", "left").join(counts.select("host", "n", "good"), "host", "left")
    above = F.coalesce("d_mean", "s_mean", F.lit(everyone))
    n, good = F.coalesce("n", F.lit(0)), F.coalesce("good", F.lit(0))
    hosts = hosts.select("host", "pages", shrunk(good, n, above, h_strength).alias("posterior_mean"), (good + h_strength * above).alias("a"), (n - good + h_strength * (1 - above)).alias("b"))
    hosts = scratch.save(hosts.select("host", "pages", "posterior_mean", lower_quantile(F.col("a"), F.col("b"), quantile).alias("bound")))
    total = hosts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    judged = join_hot(parsed, hosts, "host", "pages", total)
    verdict = F.coalesce(said, F.when(F.col("bound") >= threshold, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "posterior_mean", "bound")
