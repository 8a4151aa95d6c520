"""URL verdicts from prefix rules, and from trust and distrust that spread over links between hosts.

A rule (host, path) fits its host, that host's subdomains, and paths that start with the
rule's; the longest fitting rule decides a page (then the longer host, then the string). Pages without a rule take the verdict of their
host: shares of its pages that rules allow and block are seeds of two personalised
PageRanks, trust along the links and distrust against them. A host is blocked when its
distrust reaches BLOCK_AT and is above its trust; in these units a host whose pages are all
blocked, and that has no links, has distrust 1.

Links are absolute ones in href and src attributes of the html, their character references for `.`, `/`, `:` and `&`
decoded; links inside a host and dangling ones carry nothing. In the graph a host is without user and port, so links meet
the pages of any port. A propagation that does not settle raises. A null url, or one without `://`, has an empty host and path; null html has no
links. Repeated pages count each. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle, small

DAMPING = 0.85
BLOCK_AT = 0.5
#: Change of all scores, as a share of the seeds, at which the propagation has settled.
STILL = 1e-6
ROUNDS = 200
_VALUE = r"""(?i)\b(?:href|src)\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
_HOST = r"""(?i)^["']?\s*(?:https?:)?//([^/?#"'\s<>\\]+)"""
#: Character references that a host may be written with.
_REFERENCES = ((r"(?i)&(?:#0*46|#x0*2e|period);", "."), (r"(?i)&(?:#0*47|#x0*2f|sol);", "/"), (r"(?i)&(?:#0*58|#x0*3a|colon);", ":"),
               (r"(?i)&(?:#0*38|#x0*26|amp);", "&"))


def _low(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return _low(F.regexp_extract(text, parts, 1)), F.regexp_extract(text, parts, 2)


def node(host: Column) -> Column:
    """A host without user and port: what stands in the graph."""
    return F.regexp_replace(host, r"^[^@]*@|:\d*$", "")


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, weight): pages' links from host to host, counted."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_VALUE), F.lit(1))
    links = pages.select(node(host_and_path(F.col(url_col))[0]).alias("src"), F.explode(found).alias("link"))
    link = F.col("link")
    for pattern, sign in _REFERENCES:
        link = F.regexp_replace(link, pattern, sign)
    links = links.select("src", node(_low(F.regexp_extract(link, _HOST, 1))).alias("dst"))
    return links.where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def _steps(links: DataFrame) -> DataFrame:
    """(kind, src, dst, share): where a host's score goes; distrust runs against the links."""
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").union(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    return both.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, host, score) of all hosts that seeds (kind, host, seed) reach."""
    steps = settle(_steps(links), "host-steps")
    seeds = settle(seeds, "seeds")
    mass = seeds.agg(F.sum("seed")).first()[0] or 0.0
    state = seeds.select("kind", "host", F.col("seed").alias("score"))
    if mass == 0 or steps.isEmpty():
        return state
    for _ in range(ROUNDS):
        moved = (state.withColumnRenamed("host", "src").join(steps, ["kind", "src"])
                 .select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * DAMPING).alias("score")))
        now = settle(moved.union(seeds.select("kind", "host", F.col("seed").alias("score")))
                     .groupBy("kind", "host").agg(F.sum("score").alias("score")), "scores")
        old = state.select("kind", "host", (-F.col("score")).alias("score"))
        change = now.union(old).groupBy("kind", "host").agg(F.sum("score").alias("c")).agg(F.sum(F.abs("c"))).first()[0]
        state = now
        if change <= STILL * mass:
            return state
    raise RuntimeError(f"scores still move by {change / mass:.2g} of the seeds after {ROUNDS} rounds")


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each host or of a domain that it is in, as an array."""
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    rule = F.struct(F.length("rule").alias("size"), F.length("rule_host").alias("host_size"), "rule", "rule_path", "rule_verdict")
    found = hosts.select("host", suffix.alias("rule_host")).join(rules, "rule_host")
    return found.groupBy("host").agg(F.collect_set(rule).alias("rules"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust. rules: (rule like `net/es/`, verdict)."""
    host, path = host_and_path(F.col(url_col))
    rows = settle(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")), "urls")
    rules = rules.select("rule", F.substring_index("rule", "/", 1).alias("rule_host"), F.col("verdict").alias("rule_verdict"),
                         F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("pages"))
    found = settle(_host_rules(hosts, rules), "host-rules").withColumnRenamed("host", "host2")
    rows = rows.join(small(found), F.col("host") == F.col("host2"), "left").drop("host2")
    fits = F.filter(F.coalesce("rules", F.array()), lambda r: F.col("path").startswith(r["rule_path"]))
    rows = settle(rows.withColumn("best", F.array_max(fits)).select(
        "id", "host", node(F.col("host")).alias("node"), "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("ruled")), "ruled")

    shares = rows.groupBy(F.col("node").alias("host")).agg(*[(F.count_if(F.col("ruled") == v) / F.count("*")).alias(k)
                                        for v, k in (("allow", "trust"), ("block", "distrust"))])
    seeds = shares.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed"))
    scores = propagate(seeds.where("seed > 0"), host_links(pages, url_col, html_col))
    by_host = scores.groupBy(F.col("host").alias("host2")).agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k)
                                                                 for k in ("trust", "distrust")])
    out = rows.join(small(settle(by_host, "host-scores")), F.col("node") == F.col("host2"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (distrust >= BLOCK_AT) & (distrust > trust)
    verdict = F.coalesce("ruled", F.when(bad, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"),
                      trust.alias("trust"), distrust.alias("distrust"))
