"""URL filter: listed rules first, then association rules mined from labels.

A url is cut into tokens (host labels, path and query words, digits as 0). FP-growth
over the labelled urls gives token combinations that go with a verdict; those with enough
confidence, support and lift are kept. Growth goes through the conditional bases of a combination (what stands
behind it in its urls, the rarest tokens first) and ends at the longest rule, so that long urls are mined whole. A rule is posted under the rarest of its tokens,
a url looks up the postings of its own tokens, and a match is verified on the whole
combination. The rule of highest confidence, then support, then length, decides; a url that no rule fits is allowed.

Defined results: a null url, or one without ``://``, has an empty host and path and only
the tokens of its text. Urls may be of any length. Columns of ``pages`` named host, path, rule, verdict or mined are replaced by
the results, all others stay; an empty table gives an empty table. Repeated urls get one verdict, repeated rows stay. A label with
neither value set is left out. Without labels, or rules that pass, everything else is
allowed. Among listed rules that fit, the longest wins, and of equally long ones the one with the longer host, then the first by code point.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.plans.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@dataclass(frozen=True)
class Mining:
    """Pruning of mined rules: their share of all labelled urls, confidence, lift and number of tokens."""

    support: float = 0.002
    confidence: float = 0.7
    lift: float = 1.2
    tokens: int = 3
    least: int = 5


def until(x: Column, marks: str) -> Column:
    """``x`` up to the first of the marks."""
    for m in marks:
        x = F.substring_index(x, m, 1)
    return x


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = until(rest, "/?#")
    path = until(F.substring(rest, F.length(raw) + 1, F.length(rest)), "?#")
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def listed(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest listed rule that fits, else null. The list is written into the plan, so it must be short."""
    order = sorted(rules, key=lambda r: (-len(r[0]), -r[0].index("/"), r[0]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(order):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """The distinct tokens of a url, each with its part: ``h:`` host label, ``p:`` rest."""
    host, _ = split_url(url)
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url)
    rest = F.translate(rest, UPPER, LOWER)
    tail = F.regexp_replace(F.substring(rest, F.length(host) + 1, F.length(rest)), "[0-9]+", "0")
    cut = lambda x, by, mark: F.transform(F.filter(F.split(x, by), lambda t: t != ""), lambda t: F.concat(F.lit(mark), t))
    return F.coalesce(F.array_distinct(F.concat(cut(host, r"\.", "h:"), cut(tail, r"[^\p{L}0-9]+", "p:"))), F.array().cast("array<string>"))


def tally(flat: DataFrame, least: float) -> DataFrame:
    """prefix, token, all and by (verdict, hits) of the combinations of a prefix and a token that ``least`` urls of some verdict hold; ``flat`` has prefix, token, verdict and w, a number of urls."""
    hits = flat.groupBy("prefix", "token", "verdict").agg(F.sum("w").alias("hits"))
    whole = hits.groupBy("prefix", "token").agg(F.sum("hits").alias("all"), F.max("hits").alias("most"), F.collect_list(F.struct("verdict", "hits")).alias("by"))
    return whole.filter(F.col("most") >= least).drop("most")


def mine(labelled: DataFrame, scratch: Scratch, mining: Mining = Mining()) -> DataFrame:
    """Rules (items, anchor, verdict, confidence, support) from rows of url and verdict."""
    none = labelled.sparkSession.createDataFrame([], "items array<string>, anchor string, verdict string, confidence double, support double")
    own = scratch.write(labelled.select(F.monotonically_increasing_id().alias("row"), "verdict", tokens(F.col("url")).alias("held")))
    n = own.count()
    if not n:
        return none
    # tokens that no rule can hold are left out; of urls of k tokens at most k / support are frequent
    least = max(mining.support * n, mining.least)
    flat = own.select("row", "verdict", F.explode("held").alias("token"))
    start = F.array().cast("array<string>").alias("prefix")
    found = [scratch.write(tally(flat.select(start, "token", "verdict", F.lit(1).alias("w")), least))]
    known = F.when(F.col("all").isNotNull(), F.struct("all", "token"))
    kept = flat.join(found[0].select("token", "all"), "token", "left").groupBy("row", "verdict").agg(F.sort_array(F.collect_list(known)).alias("kept"))
    base = scratch.write(kept.select("verdict", F.col("kept.token").alias("held")).groupBy("held", "verdict").agg(F.count("*").alias("w")).select(start, "held", "verdict", "w"))
    for _ in range(1, mining.tokens):
        # each token with those behind it; after that, only those behind it that are frequent together with it.
        # The outer join never broadcasts the bases, which are far larger than the files that they are read from
        picked = base.select("prefix", "held", "verdict", "w", F.posexplode("held").alias("at", "token"))
        base = picked.select(F.concat("prefix", F.array("token")).alias("prefix"), F.slice("held", F.col("at") + 2, F.size("held")).alias("held"), "verdict", "w").filter(F.size("held") > 0)
        found.append(scratch.write(tally(base.select("prefix", "verdict", "w", F.explode("held").alias("token")), least)))
        behind = found[-1].groupBy("prefix").agg(F.collect_set("token").alias("behind"))
        base = base.join(behind, "prefix", "left").select("prefix", F.array_intersect("held", "behind").alias("held"), "verdict", "w").filter(F.size("held") > 1)
    items = F.concat("prefix", F.array("token"))
    hits = reduce(DataFrame.unionByName, found).select(F.array_sort(items).alias("items"), items[0].alias("anchor"), "all", F.inline("by"))
    urls = own.groupBy("verdict").agg(F.count("*").alias("base"))
    confidence = F.col("hits") / F.col("all")
    rules = hits.join(F.broadcast(urls), "verdict").filter((F.col("hits") >= F.ceil(F.lit(float(least)))) & (confidence >= mining.confidence) & (confidence / (F.col("base") / F.lit(n)) >= mining.lift))
    return scratch.write(rules.select("items", "anchor", "verdict", confidence.alias("confidence"), (F.col("hits") / F.lit(n)).alias("support")))


def judge(pages: DataFrame, labelled: DataFrame, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES, mining: Mining = Mining()) -> DataFrame:
    """The rows of ``pages`` with host, path, rule, verdict and mined (the tokens of the mined rule that decided, if any).

    labelled: rows of url and verdict (``allow`` or ``block``).
    """
    scratch = Scratch(pages.sparkSession, "urls")
    mined = mine(labelled, scratch, mining)
    made = ("host", "path", "rule", "verdict", "mined")
    kept = [c for c in pages.columns if c.lower() not in made]
    host, path = split_url(F.col("url"))
    # the rows travel as one column, so no name of theirs meets the names used here
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("none"))
    named = pages.select(row.alias("row"), F.col(f"`{url}`").alias("url")).select("row", "url", host.alias("host"), path.alias("path"))
    named = named.withColumn("found", listed(F.col("host"), F.col("path"), rules))
    open_ = named.filter(F.col("found").isNull() & F.col("url").isNotNull())
    urls = open_.select(F.col("url").alias("open_url")).distinct().withColumn("held", tokens(F.col("open_url")))
    fits = urls.withColumn("anchor", F.explode("held")).join(mined, "anchor").filter(F.size(F.array_except("items", "held")) == 0)
    best = fits.groupBy("open_url").agg(F.max(F.struct("confidence", "support", F.size("items").alias("n"), "items", F.col("verdict").alias("mined_verdict"))).alias("best"))
    decided = open_.join(best, F.col("url") == F.col("open_url"), "left")
    rest = named.filter(F.col("found").isNotNull() | F.col("url").isNull()).withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    both = decided.drop("open_url").unionByName(rest)
    verdict = F.coalesce(F.col("found.verdict"), F.col("best.mined_verdict"), F.lit("allow"))
    return both.select(*[F.col("row")[c].alias(c) for c in kept], "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), F.col("best.items").alias("mined"))
