"""URL filtering by rules and empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (1 bad, 0 good) are counted per host. Beta-binomial priors are
chained from the whole corpus to the suffix, the registered domain and the host: each
level's rate is shrunk towards its parent's posterior mean, with a strength estimated by
the method of moments over all groups of that level. A page is blocked when the lower
bound of its host's posterior rate exceeds ``BLOCK_ABOVE``.

An explicit rule (host and path prefix; the longest fit wins) decides before the
reputation. Hosts are matched with all their subdomains. Outcomes come from the pages
themselves, not from rules: a page is bad if its visible text is thin, or mostly signs and
numbers instead of words (``page_outcome``). No page is judged by its own outcome, which is taken
out of the counts of its host, domain, suffix and corpus first; only the strengths, one
number per level, are estimated with it.

The suffix of a host is its last label, or its last two where a country's label follows a
generic one (``GENERIC``); further suffixes can be given. User, port and a closing dot are
left out for that; an IP address is a suffix and domain of its own.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and
counts as the host ``''``. A null html is an empty page, hence bad. A null outcome is no label. Repeated pages are rows of their
own. Very long urls are split whole. Rules of equal length apply in the order given. Without any label every
posterior is the uniform prior's and nothing is blocked. A group of one page tells nothing
of its level's spread. An empty table gives an empty result. Columns besides the id and the url are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup_join, lower_az, materialize

#: Labels under which countries register domains.
GENERIC = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "gv", "ltd", "mil", "ne", "net", "nhs", "or", "org", "plc", "police", "sch")
BLOCK_ABOVE = 0.5
#: One-sided normal quantile of the posterior bound.
BOUND_Z = 1.645
#: A page of fewer visible words, or of a lesser share of words with a letter, is bad.
MIN_WORDS, LETTER_SHARE = 50, 0.8
#: Bounds on an estimated prior strength, in pages.
STRENGTH = (1.0, 1000.0)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = lower_az(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column, more: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """The public suffix and the registered domain (suffix plus one label) of a host;
    ``more`` are further suffixes of two labels."""
    name = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    name = F.rtrim(name, F.lit("."))
    is_ip = name.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$")
    labels = F.split(name, r"\.")
    last, second, two = F.element_at(labels, -1), F.get(labels, F.size(labels) - 2), F.array_join(F.slice(labels, -2, 2), ".")
    is_long = (F.size(labels) > 2) & (last.rlike("^[a-z]{2}$") & second.isin(*GENERIC) | two.isin(*more))
    n = F.least(F.when(is_long, 3).otherwise(2), F.size(labels))
    suffix = F.when(is_ip, name).when(is_long, two).otherwise(last)
    return suffix, F.when(is_ip, name).otherwise(F.array_join(F.slice(labels, -n, n), "."))


def page_outcome(html: Column) -> Column:
    """1 for a bad page, 0 for a good one. Scripts, styles, comments and tags are not visible."""
    text = F.coalesce(html, F.lit(""))
    for hidden in (r"(?s)<script.*?</script>", r"(?s)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        text = F.regexp_replace(text, hidden, " ")
    words = F.filter(F.split(text, r"[ \t\r\n\f\x0B]+"), lambda w: w != "")
    with_letters = lambda w: F.size(F.filter(w, lambda x: x.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")))
    bad = lambda w: (F.size(w) < MIN_WORDS) | (with_letters(w) < LETTER_SHARE * F.size(w))
    return F.get(F.transform(F.array(words), lambda w: bad(w).cast("int")), F.lit(0))


def _on(host: Column, of_host: str) -> Column:
    return (host == of_host) | host.endswith("." + of_host)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does. A rule is
    (verdict, host, path prefix); the order of equal lengths is that of the list."""
    rule = verdict = F.lit(None).cast("string")
    for what, of_host, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = _on(host, of_host) & path.startswith(prefix)
        rule = F.when(fits, F.lit(of_host + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _strength(level: DataFrame, parent_rate: Column, k: Column, n: Column) -> DataFrame:
    """One row: the moment estimate of the prior strength a + b of a level.

    For beta-binomial counts Var(k/n) = m(1-m)/n * (1 + (n-1)/(s+1)), so the excess of the
    squared deviations over the binomial variance gives s.
    """
    binomial = parent_rate * (1 - parent_rate)
    use = F.when(n > 1, n)
    excess = F.sum(F.when(n > 1, n * F.pow(k / n - parent_rate, 2) - binomial)) / F.sum(F.when(n > 1, (n - 1) * binomial))
    rho = F.least(F.greatest(F.coalesce(excess, F.lit(0.0)), F.lit(1e-6)), F.lit(0.999999))
    s = F.least(F.greatest(1 / rho - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))
    return level.agg(F.when(F.sum(use) > 0, s).otherwise(F.lit(STRENGTH[0])).alias("s"))


def _posterior(top: Column, levels: Column, without: Column) -> Column:
    """(a, b) of a host from the counts (n, k) of the corpus and (n, k, s) of its levels, top
    first, where a page of outcome ``without`` (null: none) is left out of all counts."""
    one, y = without.isNotNull().cast("int"), F.coalesce(without, F.lit(0)).cast("double")
    state = lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))

    def below(above: Column, x: Column) -> Column:
        mean = above["a"] / (above["a"] + above["b"])
        return state(x["s"] * mean + (x["k"] - y), x["s"] * (1 - mean) + ((x["n"] - one) - (x["k"] - y)))

    return F.aggregate(levels, state(top["k"] - y + 1, (top["n"] - one) - (top["k"] - y) + 1), below)


def reputation(pages: DataFrame, host: str = "host", outcome: str = "outcome") -> DataFrame:
    """(host, pages, labelled, bad, rate, lower, upper, others) per host of ``pages``.

    ``others`` are the lower bounds for a good and for a bad page of the host, by the
    outcomes of all other pages.
    """
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = (
        pages.select(F.col(host).alias("host"), F.col(outcome).cast("double").alias("y"))
        .groupBy("host")
        .agg(F.count("*").alias("pages"), F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("k"))
        .withColumns({"suffix": suffix, "domain": domain})
    )
    hosts = materialize(hosts, "hosts")
    top = hosts.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0.0)).alias("k")).alias("top"))
    rate_above = hosts.crossJoin(F.broadcast(top)).withColumns({"above": (F.col("top.k") + 1) / (F.col("top.n") + 2), "levels": F.array().cast("array<struct<n:bigint,k:double,s:double>>")})
    # From the suffixes down; each level carries its parents' counts and posterior mean as "above".
    keys: list[str] = []
    for level in ("suffix", "domain", "host"):
        keys = [*keys, level]
        carried = [F.first(c).alias(c) for c in ("above", "top", "levels")]
        groups = rate_above.groupBy(*keys).agg(F.sum("n").alias("ln"), F.sum("k").alias("lk"), *carried)
        groups = materialize(groups, level)
        strength = _strength(groups, F.col("above"), F.col("lk"), F.col("ln"))
        own = F.array(F.struct(F.col("ln").alias("n"), F.col("lk").alias("k"), F.col("s")))
        a, b = F.col("s") * F.col("above") + F.col("lk"), F.col("s") * (1 - F.col("above")) + F.col("ln") - F.col("lk")
        groups = groups.crossJoin(F.broadcast(strength)).select(*keys, "top", F.concat("levels", own).alias("levels"), (a / (a + b)).alias("above"))
        groups = materialize(groups, level)
        if level != "host":
            rate_above = lookup_join(hosts, groups, keys)

    def bounds(of: Column) -> Column:
        a, b = of["a"], of["b"]
        mean = a / (a + b)
        spread = BOUND_Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
        return F.struct(mean.alias("rate"), F.greatest(mean - spread, F.lit(0.0)).alias("lower"), F.least(mean + spread, F.lit(1.0)).alias("upper"))

    # All three through one array, so that no fold is repeated.
    own = F.element_at("levels", -1)
    # A page can be left out only where there is one.
    left_out = (F.lit(None).cast("int"), F.when(own["k"] < own["n"], 0), F.when(own["k"] > 0, 1))
    folds = F.array(*(_posterior(F.col("top"), F.col("levels"), y) for y in left_out))
    found = groups.select("host", own.alias("own"), F.explode(F.array(F.transform(folds, bounds))).alias("of"))
    whole, good, bad = (F.get("of", F.lit(i)) for i in range(3))
    good, bad = F.when(F.col("own.k") < F.col("own.n"), good["lower"]), F.when(F.col("own.k") > 0, bad["lower"])
    posterior = found.select("host", *(whole[c].alias(c) for c in ("rate", "lower", "upper")), F.struct(good.alias("good"), bad.alias("bad")).alias("others"))
    counts = hosts.select("host", "pages", F.col("n").alias("labelled"), F.col("k").alias("bad"))
    return lookup_join(counts, posterior, ["host"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_page, bad_rate_lower) per row of ``pages``."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"), page_outcome(F.col(html)).alias("outcome"))
    rule, decided = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = materialize(rows.select("page_id", "host", "path", rule.alias("rule"), decided.alias("decided"), "outcome"), "judged")
    known = materialize(reputation(rows).select("host", "others"), "reputation")
    joined = lookup_join(rows, known, ["host"])
    lower = F.when(F.col("outcome") == 1, F.col("others.bad")).otherwise(F.col("others.good"))
    method = F.when(lower > BLOCK_ABOVE, "block").otherwise("allow")
    verdict = F.coalesce("decided", method).alias("verdict")
    return joined.select("page_id", "host", "path", "rule", verdict, F.col("outcome").alias("bad_page"), lower.alias("bad_rate_lower"))
