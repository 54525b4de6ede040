"""URL rules completed by link-graph propagation between hosts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, LOWER, NARROW, UPPER, is_small, spread_join, stored


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that the query applies.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
#: Share of a score that follows links; the block threshold is distrust > RATIO * trust, beyond rounding.
DAMPING, RATIO = 0.85, 2.0
#: The scores have settled when no host's changes by more than this share of itself: far under MARGIN, so that ties stay ties.
TOLERANCE = 1e-12
#: Rounds in one job. A host that is reached at all counts as having at least LEAST_SCORE, however far it is.
AT_ONCE, LEAST_SCORE = 16, 1e-290
#: Rounding, relative to the scores: these shrink as the table grows, so no absolute margin would do.
MARGIN = 1e-9
#: An absolute link's host.
LINK = r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s\"'>]+)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    rest = F.substring_index(F.regexp_replace(F.substr(url, F.locate("://", url) + 3), r"[/?#][\s\S]*$", ""), "/", 1)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.translate(rest, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    rest = F.regexp_replace(F.substr(url, F.locate("://", url) + 3), r"^[^/?#]*", "")
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.regexp_replace(rest, r"[?#][\s\S]*$", "")).otherwise("")


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """The longest rule that fits: struct(text, verdict) or null. Ties: the first given."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between hosts: absolute links of the pages, counted, and for each host with more than three labels
    a link to and from the host without its first label (www., m. or blog. of a site stand by it)."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
    links = links.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src <> '' AND src <> dst")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").where("host <> ''").distinct()
    up = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).where(F.size(F.split("src", r"\.")) > 3)
    up = up.withColumn("weight", F.lit(1.0))
    every = links.union(up).union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return every.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _settle(links: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """propagate's rounds over the links of one kind, the hosts' own rows among them."""
    hosts, at = np.unique(np.concatenate([links["src"], links["dst"]]).astype(str), return_inverse=True)
    src, dst = np.split(at, 2)
    share = links["share"].to_numpy(float)
    score = np.bincount(dst, links["back"].to_numpy(float), len(hosts))
    step, reached = score.copy(), score > 0
    while True:
        step = np.bincount(dst, step[src] * share, len(hosts))
        now = reached | (np.bincount(dst, reached[src], len(hosts)) > 0)
        new = now & ~reached
        step[new] = np.maximum(step[new], LEAST_SCORE)
        score, reached = score + step, now
        if not new.any() and (step[reached] <= tolerance * score[reached]).all():
            return pd.DataFrame({"kind": links["kind"].iloc[0], "host": hosts[reached], "score": score[reached]})


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank of two kinds at once. edges: (kind, src, dst, share), shares of a source adding up to 1;
    seeds: (kind, host, seed), all adding up to 1, so that the kinds compare. Returns (kind, host, score). A host without links
    passes nothing on.

    The scores are the sum of the walks of each length, (1 - damping) * damping^n for those of n links; a round adds the next
    length. The end is when a round has reached no new host and no host's last step is over `tolerance` of its own
    score; as scores are sums of their neighbours', later steps stay within that share. Steps shrink by damping each
    round once all hosts are reached, so it comes. A host first reached by less than LEAST_SCORE counts as reached by that much, so scores
    don't underflow on deep graphs: there, both kinds being that weak are a tie, and one alone still tells.

    A round is one join and one sum; a host's own row among the links holds its seed and says that it isn't new. AT_ONCE rounds are
    a job, whose result is written; the links of a hub are dealt over tasks, to which its state is copied. A graph that is
    small enough to broadcast (is_small) is one task's work for each kind, by the same law, as hundreds of rounds over so few
    rows would be mostly planning."""
    start = (F.col("seed") * (1 - damping)).alias("score")
    seeds = seeds.select("kind", "host", start)
    every = seeds.select("kind", "host").union(edges.select("kind", "src")).union(edges.select("kind", "dst")).distinct()
    own = every.join(seeds, ["kind", "host"], "left").select("kind", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(0.0).alias("share"), F.coalesce("score", F.lit(0.0)).alias("back"), F.lit(1).alias("old"))
    steps = edges.select("kind", "src", "dst", (F.col("share") * damping).alias("share"), F.lit(0.0).alias("back"), F.lit(0).alias("old")).union(own)
    steps, key = stored(steps, "steps"), ["kind", "src"]
    if is_small(steps, NARROW):
        settle = lambda links: _settle(links, tolerance)
        return stored(steps.groupBy("kind").applyInPandas(settle, "kind string, host string, score double"), "scores")
    hubs = edges.groupBy("kind", "src").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("parts")).where("parts > 1")
    hubs = F.broadcast(stored(hubs, "hubs"))  # a row for HEAVY links at least
    steps = steps.join(hubs, key, "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    key += ["part"]
    steps = stored(steps, "dealt")
    state = seeds.select("kind", "host", "score", F.col("score").alias("step"))
    least = F.lit(LEAST_SCORE)
    while True:
        for _ in range(AT_ONCE):
            at = state.select("kind", F.col("host").alias("src"), "score", "step")
            at = at.join(hubs, ["kind", "src"], "left")
            at = at.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
            moved = steps.join(at, key)
            sums = F.sum(F.col("score") * F.col("share") + F.col("back")).alias("score"), F.sum(F.col("step") * F.col("share")).alias("step")
            state = moved.groupBy("kind", F.col("dst").alias("host")).agg(*sums, F.max("old").alias("old"))
            step = F.when(F.col("old") == 0, F.greatest("step", least)).otherwise(F.col("step")).alias("step")
            state = state.select("kind", "host", F.greatest("score", least).alias("score"), step, "old")
        state = stored(state, "scores")
        row = state.agg(F.count_if(F.col("old") == 0).alias("new"), F.max(F.col("step") / F.col("score")).alias("change")).first()  # one row
        if not row["new"] and (row["change"] or 0.0) <= tolerance:
            return state.select("kind", "host", "score")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO) -> DataFrame:
    """A verdict for every page: that of the longest fitting rule; else its host's.

    Hosts are judged by propagation: pages that a rule allows seed trust in their hosts, which flows along links;
    blocked pages seed distrust, which flows against links, to those that link there. A host whose distrust exceeds
    `ratio` times its trust is blocked, others, also those that neither reaches, are allowed. Scores within a share of MARGIN
    of that are a tie; any distrust without trust blocks. So verdicts don't depend on how many other pages have rules.

    A host too far to be told from 0 (LEAST_SCORE) still counts as reached. Pages of a hot host are dealt over tasks.

    Null url or one without ://: host and path are empty, no rule fits and the verdict is allow. Null html has no
    links. Repeated rows are judged alike; each counts as a page. Returns id_col, host, path, rule, verdict, trust, distrust.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    src = src.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    fit = fitting(rules, F.col("host"), F.col("path"))
    told = stored(src.select("id", "host", "path", fit.alias("rule")), "judged")
    edges = stored(host_edges(src), "edges")
    seeds = told.where("rule IS NOT NULL").groupBy(F.col("rule.verdict").alias("kind"), "host").agg(F.count("*").cast("double").alias("n"))
    total = seeds.agg(F.sum("n").alias("total"))  # one row
    seeds = stored(seeds.join(F.broadcast(total)).select("kind", "host", (F.col("n") / F.col("total")).alias("seed")), "seeds")
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "weight").union(edges.select(F.lit("block"), F.col("dst"), F.col("src"), "weight"))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("out"), F.count("*").alias("n"))
    shares = spread_join(both, stored(out, "out"), "kind", "src").select("kind", "src", "dst", (F.col("weight") / F.col("out")).alias("share"))
    scores = propagate(stored(shares, "shares"), seeds)
    one = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    hosts = stored(scores.groupBy("host").agg(one("allow").alias("trust"), one("block").alias("distrust")), "hosts")
    if is_small(hosts):
        joined = told.join(F.broadcast(hosts), "host", "left")
    else:
        every = told.groupBy("host").agg(F.count("*").alias("n")).join(hosts, "host", "left")
        joined = spread_join(told, stored(every, "every"), "host")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col), "host", "path", F.col("rule.text").alias("rule"),
        F.coalesce(F.col("rule.verdict"), F.when(distrust > trust * ratio * (1 + MARGIN), "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
