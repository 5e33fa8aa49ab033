"""URL filtering by association rules.

A URL becomes a set of tokens: host suffixes and labels, path segments (digits masked), extension, query keys. Spark's
FP-growth mines token sets with the label from labelled URLs, for either verdict. A rule stays if its support is a share
SUPPORT of the labelled URLs, its confidence LIFT times the share of its verdict among all of them, this is no chance, and no rule on a
subset of its tokens is as confident. Rules are of any length. No chance: the log-likelihood ratio of a rule is beyond what
the best of as many rules as were tested reaches with a probability of CHANCE (Bonferroni), so labels that have nothing to
do with URLs give no rule at all but once in so many tables.

Tokens that stand in the same labelled URLs say the same about them; the first in order speaks for all, which also keeps
long URLs that are repeated from having subsets without number. A token or a rule with fewer URLs than the gain needs
can't pass, so the mining starts from there.

Rules are matched by an inverted index: a rule is filed under its rarest token, so that a URL meets only the rules filed
under one of its tokens, and is then compared in full. Of the rules that fit, the one whose odds rise most over those of
its verdict decides (ties: the larger support, then block, then the tokens in order); without any the URL is allowed. A
list of (host, path) rules goes before the mined ones, the longest first; these are all different.

Nulls: a null URL, or one without "://", has empty host and path and no tokens; no rule fits it, so it is allowed.
Labelled rows without a label are left out. A very long URL is read whole. Repeated rows get a result each. Columns
other than URL and identifier are not looked at. Empty tables give empty results; without labels of both kinds there are
no mined rules.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshframe.llm.common import Scratch, is_held_out, meet, stash, table

#: (verdict, host, path), as the query's contract states them.
LISTED = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Support as a share of the labelled URLs; confidence as a multiple of the verdict's share; the probability with which
#: labels at random give any rule; and the log-likelihood ratio (twice, against the verdict's share) that a rule needs at
#: least, however few are tested.
SUPPORT, LIFT, CHANCE, LEAST_GAIN = 0.005, 1.15, 0.05, 6.63
#: Rules that every task may hold.
MOST_HELD = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"


def _rest(url: str) -> Column:
    """What follows the first "://", else nothing."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    return F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))


def host(url: str) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: str) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def tokens(url: str) -> Column:
    """The distinct tokens of a URL whose columns host and path are there."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    names = F.transform(labels, lambda x: F.concat(F.lit("h:"), x))
    site = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>"))
    steps = F.filter(F.split("path", "/"), lambda x: x != "")
    steps = F.transform(steps, lambda x, i: F.concat(F.lit("p"), (i + 1).cast("string"), F.lit(":"), F.regexp_replace(x, r"\d+", "#")))
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, r"^[^=]*", 0)))
    extension = F.lower(F.regexp_extract("path", r"/[^/]*\.([A-Za-z][A-Za-z0-9]*)$", 1))
    kind = F.when(extension != "", F.array(F.concat(F.lit("e:"), extension))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(names, site, steps, kind, keys)))


def parsed(urls: DataFrame, url: str) -> DataFrame:
    return urls.withColumn("host", host(url)).withColumn("path", path(url)).withColumn("tokens", tokens(url))


_RULES = "tokens array<string>, verdict string, confidence double, support double, strength double, filed_under string"


def _gain(hits: Column, n: Column, share: Column) -> Column:
    """Twice the log-likelihood ratio of hits among n against a share; 0 for fewer than the share."""
    miss = n - hits
    part = lambda k, of: F.when(k > 0, k * F.log(k / (n * of))).otherwise(F.lit(0.0))
    return F.when(hits > n * share, 2 * (part(hits, share) + part(miss, 1 - share))).otherwise(F.lit(0.0))


def beyond_chance(tested: int, chance: float = CHANCE, least: float = LEAST_GAIN) -> float:
    """The gain that the best of so many rules reaches by chance, one way, with a probability below chance."""
    return max(least, NormalDist().inv_cdf(1 - chance / max(1, tested)) ** 2)


def mine(labelled: DataFrame, url: str = "url", bad: str = "bad", support: float = SUPPORT, lift: float = LIFT, chance: float = CHANCE) -> DataFrame:
    """(tokens, verdict, confidence, support, strength, filed_under) of the rules, from (url, bad boolean)."""
    spark = labelled.sparkSession
    scratch = Scratch(spark)
    known = parsed(labelled.where(F.col(bad).isNotNull()).select(F.col(url).alias("__url"), F.col(bad).alias("__bad")), "__url").where(F.size("tokens") > 0)
    known = scratch.stash(known.select(F.xxhash64("__url").alias("own"), F.xxhash64(F.lit(1), "__url").alias("other"), "__bad", "tokens"), "labelled")
    n, blocked = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("__bad").cast("long")), F.lit(0))).first()
    if blocked in (0, n):
        scratch.remove()
        return spark.createDataFrame([], _RULES)
    share = {BLOCK: blocked / n, ALLOW: 1 - blocked / n}
    least = max(support * n, LEAST_GAIN / (2 * math.log(1 / min(share.values()))))
    wide = "decimal(38,0)"
    stood = known.select("own", "other", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.sum(F.col("own").cast(wide)).alias("own"), F.sum(F.col("other").cast(wide)).alias("other"))
    speakers = stood.where(F.col("freq") >= least).groupBy("freq", "own", "other").agg(F.min("token").alias("token"))
    # At most as many as a URL's tokens on average, divided by the support.
    freq = {r["token"]: r["freq"] for r in speakers.select("token", "freq").collect()}
    verdict = F.when(F.col("__bad"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    baskets = known.select(F.concat(F.array(verdict), F.array_intersect("tokens", F.lit(sorted(freq)))).alias("items")) if freq else known.select(F.array(verdict).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n * (1 - 1e-12)), minConfidence=0.0).fit(baskets)
    rules = model.associationRules.select(F.array_sort("antecedent").alias("tokens"), F.col("consequent")[0].alias("verdict"), "confidence", "support").where(F.col("verdict").isin(BLOCK, ALLOW))
    of = F.when(F.col("verdict") == BLOCK, F.lit(share[BLOCK])).otherwise(F.lit(share[ALLOW]))
    hits = F.round(F.col("support") * n)
    rows = F.round(hits / F.col("confidence"))
    odds = (hits + 0.5) / (rows - hits + 0.5)
    rules = rules.withColumn("gain", _gain(hits, rows, of)).withColumn("high", F.col("confidence") >= lift * of).withColumn("strength", F.log(odds * (1 - of) / of))
    rules = scratch.stash(rules.select("tokens", "verdict", "confidence", "support", "strength", "gain", "high"), "rules")
    # Of a token set, one verdict has a gain at most: sets that were counted are the rules that were tested.
    enough = beyond_chance(rules.count(), chance)
    rules = rules.withColumn("good", F.col("high") & (F.col("gain") >= enough)).drop("gain", "high")
    rules = _unbeaten(rules, scratch).where("good").drop("good")
    rare = F.array_min(F.transform("tokens", lambda t: F.struct(F.element_at(F.map_from_arrays(F.lit(list(freq)), F.lit(list(freq.values()))), t).alias("freq"), t.alias("token"))))["token"] if freq else F.lit(None)
    out = scratch.stash(rules.withColumn("filed_under", rare), "rules")
    scratch.remove(keep=1)
    return out


def _unbeaten(rules: DataFrame, scratch: Scratch) -> DataFrame:
    """The rules that are more confident than every rule for the same verdict on a proper subset of their tokens.

    Rules of one length meet those with one token less, which bring the highest confidence among their own subsets.
    """
    longest = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    own = rules.where(F.size("tokens") == 1)
    stay, carried = own, own.select("tokens", "verdict", F.col("confidence").alias("best"))
    for length in range(2, longest + 1):
        own = rules.where(F.size("tokens") == length)
        less = own.select("tokens", "verdict", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("less"))
        below = less.join(carried.withColumnRenamed("tokens", "less"), ["less", "verdict"]).groupBy("tokens", "verdict").agg(F.max("best").alias("below"))
        met = scratch.stash(own.join(below, ["tokens", "verdict"], "left"), "rules")
        stay = stay.union(met.where("below is null or confidence > below").select(stay.columns))
        carried = met.select("tokens", "verdict", F.greatest("confidence", "below").alias("best"))
    return stay


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", ident: str = "page_id", listed=LISTED) -> DataFrame:
    """ident, host, path, rule, verdict and the mined rule that decided, for every row of urls."""
    pages = parsed(urls.select(F.col(ident).alias("ident"), F.col(url).alias("__url")), "__url")
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(listed, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        hit = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        fits = F.when(hit, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    # Rows get numbers that stay as they are if tasks run again.
    pages = stash(pages.select(F.monotonically_increasing_id().alias("row"), "ident", "host", "path", "tokens", fits.alias("fit")), "urls")
    tokens_of = pages.where("fit is null").select("row", "tokens", F.explode("tokens").alias("filed_under"))
    index = rules.select(F.col("tokens").alias("rule_tokens"), "filed_under", F.struct("strength", "support", (F.col("verdict") == BLOCK).alias("blocks"), F.col("tokens").alias("tokens")).alias("mined"))
    met = meet(tokens_of, index, ["filed_under"], "row", MOST_HELD)  # a token may be in most URLs
    met = met.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = met.groupBy("row").agg(F.max("mined").alias("mined"))
    out = pages.join(best, "row", "left")
    mined = F.when(F.col("mined.blocks"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return out.select(F.col("ident").alias(ident), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", mined).alias("verdict"), F.array_join("mined.tokens", " ").alias("mined_rule"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Mines from the urls whose page_id has a label (bad: low quality or toxic), then judges every url of pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.join(labels.where(~is_held_out("page_id")), "page_id")
    return judge(pages, mine(labelled))
