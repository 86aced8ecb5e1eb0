"""URL filters: allow and block rules, and link-graph propagation for the urls that no rule fits.

Hosts are nodes. An edge leads from a page's host to every host its markup names in an absolute link, and from a host
to its parent domain and back. Trust starts at hosts with pages that an allow rule fits and follows the edges
(personalised PageRank); distrust starts at hosts with blocked pages and goes against them. Each is divided by the
PageRank that starts at all pages alike, which gives the share of good and of bad pages around a host. A host is
blocked if its distrust is ``THRESHOLD`` or more and above its trust. As half of a host's own mass stays with it, the
distrust of a host without a blocked page of its own is below a half, however bad what it links to is. With a damping
of 0.5, ten rounds leave a thousandth of the mass still to move.

All of it is joins and sums over edges: one join and one pre-aggregated sum by host each round, with the lineage cut
in the shared checkpoint folder. Of the result only rules are bounded (``MAX_RULES``), as they become one expression.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule, and is allowed; null markup
has no links; repeated rows count as pages of their own and are all returned; an empty table gives no rows. Columns of
the input stay, but ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import cut, table

#: (rule, verdict): a host, which stands for its subdomains too, and the beginning of a path.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
MAX_RULES = 1_000
DAMPING, ROUNDS, ROUNDS_A_CUT, THRESHOLD = 0.5, 10, 5, 0.3
#: Domains under which strangers register hosts, so that nothing flows through them.
SUFFIXES = "ac.jp ac.uk appspot.com azurewebsites.net blogspot.com cloudfront.net co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn com.mx com.tr com.tw github.io gitlab.io gov.uk herokuapp.com ne.jp net.au netlify.app or.jp org.au org.uk pages.dev vercel.app web.app wordpress.com".split()
_LINK = r"(?i)\b(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    rest = F.expr(f"substring(`{url}`, nullif(instr(`{url}`, '://'), 0) + 3)")
    part = lambda k: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", k), F.lit(""))
    return df.withColumns({"host": lower_ascii(part(1)), "path": part(2)})


def rule_of(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name = verdict = None
    for rule, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, begin = rule.partition("/")
        fits = (F.concat(F.lit("."), host).endswith(f".{domain}")) & path.startswith(f"/{begin}")
        name = F.when(fits, F.lit(rule)) if name is None else name.when(fits, F.lit(rule))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def host_edges(pages: DataFrame, markup: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, summed."""
    linked = pages.where(F.col("host") != "").select("host", F.explode(F.regexp_extract_all(F.coalesce(F.col(markup), F.lit("")), F.lit(_LINK), 1)).alias("to"))
    links = linked.select(F.col("host").alias("src"), lower_ascii(F.col("to")).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def parent_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, n): every host and its parent domains, down to two labels and but for ``SUFFIXES``, both ways."""
    labels = F.split("host", r"\.")
    chains = hosts.select(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(labels) - 2)), lambda k: F.array_join(F.slice(labels, k + 1, F.size(labels)), ".")).alias("c"))
    steps = chains.where(F.size("c") > 1).select(F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c")).alias("b"))).alias("s"))
    steps = steps.select(F.col("s.a").alias("a"), F.col("s.b").alias("b")).where(~F.col("b").isin(SUFFIXES)).distinct()
    both = steps.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"))
    return both.select("e.src", "e.dst", F.lit(1.0).alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust): shares of good and bad pages around each host.

    ``seeds`` (host, pages, good, bad): numbers of pages. ``edges`` (src, dst, n), each pair once.
    """
    nodes = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    every = edges.union(nodes.select("host", "host", F.lit(1.0)))
    both = every.select(
        F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("n").alias("f"), F.lit(0.0).alias("r")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("f"), F.col("n").alias("r")))).alias("e")
    ).select("e.*")
    steps = both.groupBy("a", "b").agg(F.sum("f").alias("f"), F.sum("r").alias("r"))
    out = steps.groupBy("a").agg(F.sum("f").alias("of"), F.sum("r").alias("or"))
    steps = cut(steps.join(out, "a").select("a", "b", (F.col("f") / F.col("of")).alias("f"), (F.col("r") / F.col("or")).alias("r")))
    start = seeds.select("host", F.col("good").cast("double").alias("t"), F.col("bad").cast("double").alias("d"), F.col("pages").cast("double").alias("bf"), F.col("pages").cast("double").alias("br"))
    start = cut(start)
    marks = start
    for k in range(1, rounds + 1):
        sent = steps.join(marks, steps.a == marks.host).select(
            F.col("b").alias("host"), *((damping * F.col(w) * F.col(x)).alias(x) for x, w in (("t", "f"), ("d", "r"), ("bf", "f"), ("br", "r")))
        )
        again = start.select("host", *(((1 - damping) * F.col(x)).alias(x) for x in ("t", "d", "bf", "br")))
        marks = sent.unionByName(again).groupBy("host").agg(*(F.sum(x).alias(x) for x in ("t", "d", "bf", "br")))
        if k % ROUNDS_A_CUT == 0 or k == rounds:
            marks = cut(marks)
    share = lambda x, b: F.coalesce(F.try_divide(F.col(x), F.col(b)), F.lit(0.0))
    return marks.select("host", share("t", "bf").alias("trust"), share("d", "br").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", markup: str = "html") -> DataFrame:
    """``pages`` without its markup, with host, path, rule, verdict and the host's trust and distrust."""
    kept = [x for x in pages.columns if x not in ("host", "path", "rule", "verdict", "trust", "distrust", markup)]
    located = with_host_and_path(pages.select(*kept, F.col(markup).alias("_markup")), url)
    rule, said = rule_of(rules, F.col("host"), F.col("path"))
    marked = located.withColumns({"rule": rule, "_said": said})
    with_host = marked.where("host <> ''")
    seeds = with_host.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("_said") == "allow").alias("good"), F.count_if(F.col("_said") == "block").alias("bad"))
    edges = host_edges(with_host, "_markup").union(parent_edges(with_host.select("host").distinct())).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    marks = propagate(seeds, edges)
    verdict = F.coalesce("_said", F.when((F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow"))
    return marked.drop("_markup").join(marks, "host", "left").select(*kept, "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
