"""URL filters: host rules, and trust propagated over the graph of links between hosts.

Rules name a host, its subdomains with it, and the beginning of a path; the longest that fits a URL
decides. Where none fits, the graph does: hosts whose pages the rules mostly allow are trusted
seeds, those that they mostly block are blocked seeds. Personalised PageRank carries trust from the
former along links; from the latter distrust goes against the links, to hosts that link to them.
A host with more distrust than trust is blocked, any other allowed.

Links are summed by pair of hosts before any round, each round is one aggregation over hosts and is
written to the shared folder, and rounds end when no host's score moves by more than TOLERANCE of
itself: all that links reach gets its part, however many seeds share the mass and however far.

Cases: a null URL, or one without ://, has an empty host and path, fits no rule and is allowed;
null html has no links; links of a host to itself, relative ones too, move nothing; repeated rows
are repeated pages; an empty table gives an empty result; other columns are passed through, and a
result whose name one of them has gets underscores before it; very long pages are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.llm.common import drop_all, drop_dir, free_name, let, work_dir, written

DAMPING, TOLERANCE = 0.85, 1e-6
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ANCHOR = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.lit(r.text)).otherwise(found)
    return found


def propagate(seeds: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """host, trust and distrust. seeds: host, trusted, blocked (0 or more each); edges: source,
    target, n. Both flows start afresh at their seeds with 1 - DAMPING in each round; what reaches
    a host without a way on ends there."""
    totals = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b"))
    start = seeds.crossJoin(F.broadcast(totals))  # one row
    start = start.select("host", F.coalesce(F.try_divide("trusted", "t"), F.lit(0.0)).alias("trust0"), F.coalesce(F.try_divide("blocked", "b"), F.lit(0.0)).alias("distrust0"))
    start = written(start, folder, "seeds")
    out = edges.groupBy("source").agg(F.sum("n").alias("total"))
    into = edges.groupBy("target").agg(F.sum("n").alias("total"))
    forward = edges.join(out, "source").select("source", F.col("target").alias("host"), (F.col("n") / F.col("total")).alias("part"), F.lit(True).alias("forward"))
    backward = edges.join(into, "target").select(F.col("target").alias("source"), F.col("source").alias("host"), (F.col("n") / F.col("total")).alias("part"), F.lit(False).alias("forward"))
    moves = written(forward.union(backward), folder, "moves")
    rank = start.select("host", F.col("trust0").alias("trust"), F.col("distrust0").alias("distrust"))
    if moves.isEmpty():
        return rank
    for k in count():
        sent = moves.join(rank.withColumnRenamed("host", "source"), "source")
        got = sent.groupBy("host").agg(F.sum(F.when(F.col("forward"), F.col("part") * F.col("trust"))).alias("t"), F.sum(F.when(~F.col("forward"), F.col("part") * F.col("distrust"))).alias("d"))
        flow = lambda seed, x: (1 - DAMPING) * F.coalesce(seed, F.lit(0.0)) + DAMPING * F.coalesce(x, F.lit(0.0))
        both = start.join(got, "host", "full").join(rank.select("host", F.col("trust").alias("was_t"), F.col("distrust").alias("was_d")), "host", "left")
        new = both.select("host", flow(F.col("trust0"), F.col("t")).alias("trust"), flow(F.col("distrust0"), F.col("d")).alias("distrust"), "was_t", "was_d")
        new = written(new, folder, f"round{k}")
        moves_on = lambda now, was: F.abs(F.col(now) - F.coalesce(was, F.lit(0.0))) > TOLERANCE * F.col(now)
        if k:
            drop_dir(new.sparkSession, f"{folder}/round{k - 1}")
        rank = new.select("host", "trust", "distrust")
        if new.where(moves_on("trust", "was_t") | moves_on("distrust", "was_d")).isEmpty():
            drop_all(new.sparkSession, folder, "seeds", "moves")
            return rank


def judge(pages: DataFrame, rules: list[Rule], *, url: str = "url", html: str = "html", into: str = "filter") -> DataFrame:
    """pages with a struct column into: host, path, rule, verdict."""
    folder = work_dir(pages.sparkSession)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    verdict_of = F.lit(None).cast("string")
    for r in rules:
        verdict_of = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(verdict_of)
    judged = lambda h, p: let(F.struct(h.alias("host"), p.alias("path")), lambda x: F.struct(x["host"].alias("host"), x["path"].alias("path"), rule_of(x["host"], x["path"], rules).alias("rule")))
    seen = pages.select(judged(host, path).alias("p")).select("p.host", "p.rule").withColumn("verdict", verdict_of)
    share = lambda v: F.coalesce(F.avg((F.col("verdict") == v).cast("double")) * F.count("verdict") / F.count("*"), F.lit(0.0))
    seeds = seen.where("host <> ''").groupBy("host").agg(share("allow").alias("a"), share("block").alias("b"))
    seeds = seeds.select("host", F.when(F.col("a") > 0.5, F.col("a")).otherwise(0.0).alias("trusted"), F.when(F.col("b") > 0.5, F.col("b")).otherwise(0.0).alias("blocked"))
    links = pages.select(host.alias("source"), F.explode(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(1))).alias("link"))
    links = links.where(F.contains(F.col("link"), F.lit("://"))).select("source", host_of(F.col("link")).alias("target"))
    edges = links.where("source <> target and source <> '' and target <> ''").groupBy("source", "target").agg(F.count("*").alias("n"))
    ranks = propagate(seeds, written(edges, folder, "edges"), folder)
    drop_all(pages.sparkSession, folder, "edges")
    name, key, bad = free_name(pages, into), free_name(pages, "host_key"), free_name(pages, "bad_host")
    blocked = ranks.where("distrust > trust").select(F.col("host").alias(bad)).distinct()
    out = pages.withColumn(name, judged(host, path)).withColumn(key, F.col(name)["host"]).join(blocked, F.col(key) == F.col(bad), "left")
    rule_verdict = F.lit(None).cast("string")
    for r in rules:
        rule_verdict = F.when(F.col(name)["rule"] == r.text, F.lit(r.verdict)).otherwise(rule_verdict)
    verdict = F.coalesce(rule_verdict, F.when(F.col(bad).isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    whole = F.struct(*(F.col(name)[c].alias(c) for c in ("host", "path", "rule")), verdict.alias("verdict"))
    return out.select(*(F.col(f"`{c}`") for c in pages.columns), whole.alias(name))
