"""Filter URLs by a path-template tree.

Per host the tree's nodes are path prefixes. Level by level, segments become wildcards: those that look variable (digits,
hexadecimal runs, dates, identifiers), the children of a node with so many different segments for its rows that they must
be values, and siblings whose labelled share of rejected pages does not differ from that of their siblings together
(two-proportion z test). Each template gets its smoothed share of rejected labelled pages, which leans on the share of
its host and that on the share of all: (bad + w * host) / (labelled + w) with host = (host bad + w * prior) / (host labelled + w).
A fifth of the labelled pages, dealt by a hash of the url, is held out of all this. Templates whose share reaches a cut are rejected; the cut
is the one at which the held-out pages gain most, a rejected bad page counting 1 - ``precision`` and a good one -``precision``, and holds only if the lower
confidence bound of the held-out rejected share reaches ``precision`` - where labels have nothing to do with urls, nothing is rejected.
Explicit rules (host and path prefix, the longest wins) go before templates.

Pages are first summed to distinct (host, shape) rows with partial aggregation; the levels work on those sums
only, and pages meet their template in one join that adaptive execution can split for a hot host. Built-in expressions only.

Defined cases: a null url, or one without ``://``, has an empty host and path and belongs to the empty template; labels
that are null or missing do not count; segments deeper than ``depth`` stay together as one; repeated rows count as often as
they occur; an empty table gives an empty one; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.functions.storage import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD = "*"
#: Segments that hold a value by their form alone: the variable part goes, a file ending stays.
VARIABLE = r"(?i)^(?:\d+|\d{4}-\d{2}(?:-\d{2})?|[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{27}|[a-z_-]*\d{3,}[a-z0-9_-]*)(\.[a-z]{1,5})?$"


def with_url_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Add host (lower-cased ASCII) and path."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", host).withColumn("path", path)


def rule_column(rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path, else null. A rule is (host, path, verdict)."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    cases = None
    for host, path, verdict in longest:
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases if cases is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def path_shape(path: Column, depth: int) -> Column:
    """Segments of the path with those that vary by form replaced; what is deeper than ``depth`` is one last segment."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    shape = F.transform(F.slice(parts, 1, depth), lambda s: F.regexp_replace(s, VARIABLE, "*$1"))
    return F.when(F.size(parts) > depth, F.concat(shape, F.array(F.lit("**")))).otherwise(shape)


SUMS = ("pages", "labelled", "bad", "held", "held_bad")
#: Shares fall into so many bins when the cut is chosen.
SHARE_BINS = 1000


def _merged_level(nodes: DataFrame, level: int, *, min_values: int, value_share: float, z: float) -> DataFrame:
    """Replace segment ``level`` of ``template`` by a wildcard where its siblings call for it."""
    seg = F.get("shape", F.lit(level))
    here = nodes.withColumn("_seg", seg)
    group = ["host", "template"]
    kids = here.filter("_seg IS NOT NULL").groupBy(*group, "_seg").agg(F.sum("pages").alias("k_pages"), F.sum("labelled").alias("k_lab"), F.sum("bad").alias("k_bad"))
    whole = kids.groupBy(*group).agg(F.sum("k_pages").alias("pages"), F.sum("k_lab").alias("lab"), F.sum("k_bad").alias("bad"), F.count("*").alias("values"))
    both = kids.join(whole, group)
    rest_lab, rest_bad = F.col("lab") - F.col("k_lab"), F.col("bad") - F.col("k_bad")
    share = F.try_divide("bad", "lab")
    error = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), "k_lab") + F.try_divide(F.lit(1.0), rest_lab)))
    gap = F.abs(F.try_divide("k_bad", "k_lab") - F.try_divide(rest_bad, rest_lab))
    differs = F.coalesce(gap > z * error, F.lit(False))
    many = (F.col("values") >= min_values) & (F.col("values") >= value_share * F.col("pages"))
    merged = both.select(*group, "_seg", F.when(many | ((F.col("values") > 1) & ~differs), F.lit(WILD)).otherwise(F.col("_seg")).alias("_new"))
    grown = here.join(merged, [*group, "_seg"], "left")
    template = F.when(F.col("_new").isNull(), F.col("template")).otherwise(F.concat(F.col("template"), F.lit("/"), F.col("_new")))
    return grown.select("host", "shape", template.alias("template"), *SUMS)


def best_cut(bins: Sequence[tuple[int, int, int]], precision: float, z: float) -> float:
    """The share from which templates are rejected. ``bins`` holds (bin of the share, held-out labelled pages, bad ones)."""
    best, cut, held, bad = 0.0, float("inf"), 0, 0
    for at, n, b in sorted(bins, reverse=True):
        held, bad = held + n, bad + b
        gain = bad * (1 - precision) - (held - bad) * precision
        if held and gain > best:
            p, q = bad / held, z * z / held
            lower = (p + q / 2 - z * ((p * (1 - p) + q / 4) / held) ** 0.5) / (1 + q)
            if lower >= precision:
                best, cut = gain, at / SHARE_BINS
    return cut


def url_templates(pages: DataFrame, *, url_col: str = "url", label_col: str = "bad", depth: int = 6, min_values: int = 20, value_share: float = 0.5, z: float = 1.96, prior_weight: float = 10.0, precision: float = 0.5) -> DataFrame:
    """(host, shape) -> template with its counts, purity (smoothed share of rejected labels) and rejected."""
    held = F.pmod(F.xxhash64(url_col), F.lit(5)) == 0
    rows = with_url_parts(pages.select(F.col(url_col).alias("_url"), F.col(label_col).cast("int").alias("_bad"), held.alias("_held")), "_url")
    rows = rows.select("host", path_shape(F.col("path"), depth).alias("shape"), "_held", "_bad")
    fits, checks = F.when(~F.col("_held"), F.col("_bad")), F.when(F.col("_held"), F.col("_bad"))
    sums = [F.count("*").alias("pages"), F.count(fits).alias("labelled"), F.coalesce(F.sum(fits), F.lit(0)).alias("bad"), F.count(checks).alias("held"), F.coalesce(F.sum(checks), F.lit(0)).alias("held_bad")]
    nodes = saved(rows.groupBy("host", "shape").agg(*sums), "url-shapes")
    overall = nodes.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("n"), F.max(F.size("shape")).alias("d")).first()
    prior = (overall["b"] or 0) / overall["n"] if overall["n"] else 0.0
    grown = nodes.withColumn("template", F.lit(""))
    for level in range(overall["d"] or 0):
        grown = saved(_merged_level(grown, level, min_values=min_values, value_share=value_share, z=z), "url-level")
    added = [F.sum(c).alias(c) for c in SUMS]
    hosts = grown.groupBy("host").agg(((F.sum("bad") + prior_weight * prior) / (F.sum("labelled") + prior_weight)).alias("host_share"))
    purity = (F.col("bad") + prior_weight * F.col("host_share")) / (F.col("labelled") + prior_weight)
    templates = saved(grown.groupBy("host", "template").agg(*added).join(hosts, "host").withColumn("purity", purity), "url-templates")
    share_bin = F.floor(F.col("purity") * SHARE_BINS).cast("int")
    bins = templates.groupBy(share_bin.alias("bin")).agg(F.sum("held"), F.sum("held_bad")).collect()  # SHARE_BINS + 1 rows at most
    cut = best_cut([tuple(r) for r in bins], precision, z)
    return grown.select("host", "shape", "template").join(templates.withColumn("rejected", F.col("purity") >= cut), ["host", "template"])


def url_verdicts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_col: str = "bad", rules: Sequence[tuple[str, str, str]] = (), depth: int = 6, **options) -> DataFrame:
    """One row per page: id, host, path, template, purity, rule, verdict (allow or block)."""
    templates = url_templates(pages, url_col=url_col, label_col=label_col, depth=depth, **options).select("host", "shape", "template", "purity", "rejected")
    rows = with_url_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url")), "_url").drop("_url")
    rows = rows.withColumn("shape", path_shape(F.col("path"), depth)).withColumn("_rule", rule_column(rules))
    judged = rows.join(templates, ["host", "shape"])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("rejected"), "block").otherwise("allow"))
    return judged.select("id", "host", "path", "template", "purity", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))
