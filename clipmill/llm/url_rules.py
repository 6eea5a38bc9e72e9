"""URL filtering: given rules first, mined association rules for the rest.

A given rule fits its host and all subdomains of it if the path starts with the rule's path; the
longest one that fits decides. URLs no given rule fits are judged by rules mined from labelled URLs:
Spark's FP-growth finds combinations of URL tokens (scheme, host parts, path words, query names) that
are frequent among the URLs with the label ``block``; the same combinations are then counted over all
labelled URLs, which gives their confidence. Those with enough support and confidence are kept, and of two
rules of which one holds the other's tokens and no more confidence, the shorter stays.

The support asked for is a share of the blocked URLs, so the number of combinations follows from the kinds
of URLs and not from how many there are. A host part of letters alone is a word already and makes no second token.
Equal token sets are counted before they are looked up.

Mined rules match by an inverted index: a rule stands under each of its tokens, a URL looks its tokens
up, and a rule fits if all its tokens were found. Only distinct token sets are looked up, so a host
with a third of all URLs costs no more than its distinct shapes; numbers are one token whatever they are.

Defined results: a null URL, or one without ``://``, has an empty host and path, no given rule fits,
and it is judged as a URL without tokens: allowed. Without labels nothing is mined and the rest is
allowed. Repeated rows get equal verdicts. Clashing input columns are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipmill.llm.common import cut, others, packed, partitions_for, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDED = ("host", "path", "rule", "verdict", "mined")
BLOCK = "label=block"
#: Rows of a table that may be sent to every task.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract: host, path, action.
RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)


@dataclass(frozen=True)
class Mining:
    """A mined rule needs ``least`` blocked URLs and the ``share`` of all blocked ones with its tokens;
    of the labelled URLs with its tokens ``confidence`` must be blocked."""

    least: int = 20
    share: float = 0.001
    confidence: float = 0.8


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = _rest(url)
    after = F.substring(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + 1, F.length(rest))
    return F.regexp_extract(after, r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def given(host: Column, path: Column, rules: tuple[UrlRule, ...], pick) -> Column:
    """``pick`` of the longest rule that fits, else null."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        dotted = F.concat(F.lit("."), host)
        fits = dotted.endswith("." + rule.host) & path.startswith(rule.path)
        found = F.when(fits, F.lit(pick(rule))) if found is None else found.when(fits, F.lit(pick(rule)))
    return F.lit(None).cast("string") if found is None else found


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, sorted; numbers are all alike."""
    host, path = host_of(url), path_of(url)
    plain = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    parts = [
        F.array(F.concat(F.lit("scheme="), F.regexp_extract(url, r"^([^:/?#]*)://", 1))),
        F.transform(F.split(host, r"\."), lambda x: F.when(x.rlike("[0-9-]"), F.concat(F.lit("host="), x))),
        F.transform(F.split(host, r"[.-]"), lambda x: F.when(x != "", F.concat(F.lit("word="), plain(x)))),
        F.transform(F.split(path, "[/._-]+"), lambda x: F.when(x != "", F.concat(F.lit("path="), plain(x)))),
        F.transform(names, lambda x: F.when(x != "", F.concat(F.lit("query="), plain(x)))),
        F.array(F.when(F.contains(url, F.lit("#")), F.lit("fragment"))),
    ]
    tokens = F.array_sort(F.array_distinct(F.array_compact(F.concat(*parts))))
    return F.when(F.instr(url, "://") > 0, tokens).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, mining: Mining = Mining(), url: str = "url", block: str = "block") -> DataFrame:
    """(tokens, support, confidence) of the rules that labelled URLs show; ``block`` is boolean."""
    spark = labelled.sparkSession
    known = labelled.where(F.col(quoted(url)).isNotNull() & F.col(quoted(block)).isNotNull())
    known = cut(known.select(tokens_of(F.col(quoted(url))).alias("tokens"), F.col(quoted(block)).alias("b")))
    blocked = known.where("b").count()
    least = max(mining.least, math.ceil(mining.share * blocked))
    if blocked < least:
        return spark.createDataFrame([], "tokens array<string>, support long, confidence double")
    growth = FPGrowth(minSupport=(least - 0.5) / blocked, numPartitions=partitions_for(spark))
    sets = growth.fit(known.where("b").select(F.col("tokens").alias("items"))).freqItemsets
    sets = cut(sets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("support")))
    rules = cut(_confident(sets, known.groupBy("tokens").agg(F.count("*").alias("n")), mining.confidence))
    part = F.explode("tokens").alias("token")
    longer = rules.select(F.col("tokens").alias("long"), F.col("confidence").alias("c"), part)
    held = longer.join(rules.select("tokens", "confidence", part), "token").groupBy("long", "c", "tokens", "confidence")
    held = held.agg(F.count("*").alias("same")).where(
        (F.col("same") == F.size("tokens")) & (F.size("tokens") < F.size("long")) & (F.col("confidence") >= F.col("c"))
    )
    return rules.join(held.select(F.col("long").alias("tokens")).distinct(), "tokens", "left_anti")


def _confident(sets: DataFrame, shapes: DataFrame, confidence: float) -> DataFrame:
    """(tokens, support, confidence) of the frequent ``sets`` that are sure enough.

    ``shapes`` (tokens, n) are the token sets of all labelled URLs. A set stands in the index under its
    rarest token alone, so common tokens bring few sets to a shape, and each pair is tested where it meets.
    """
    single = sets.where("size(tokens) = 1").select(F.col("tokens")[0].alias("token"), F.col("support").alias("of"))
    parts = sets.select("tokens", "support", F.explode("tokens").alias("token")).join(single, "token")
    index = parts.groupBy("tokens", "support").agg(F.min(F.struct("of", "token"))["token"].alias("token"))
    index = F.broadcast(index) if sets.count() <= BROADCAST_ROWS else index
    seen = shapes.select(F.col("tokens").alias("shape"), "n", F.explode("tokens").alias("token")).join(index, "token")
    hits = seen.where(F.size(F.array_except("tokens", "shape")) == 0).groupBy("tokens", "support")
    sure = hits.agg((F.col("support") / F.sum("n")).alias("confidence"))
    return sure.where(F.col("confidence") >= confidence)


def match(shapes: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined) of the token sets some rule fits; ``mined`` is the surest such rule."""
    index = rules.select(F.col("tokens").alias("rule"), "confidence", "support", F.explode("tokens").alias("token"))
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index
    seen = shapes.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    hits = seen.groupBy("tokens", "rule", "confidence", "support").agg(F.count("*").alias("n")).where("n = size(rule)")
    best = F.max(F.struct("confidence", "support", "rule"))
    return hits.groupBy("tokens").agg(F.concat_ws(" ", best["rule"]).alias("mined"))


def judge(urls: DataFrame, mined: DataFrame, rules: tuple[UrlRule, ...] = RULES, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule (the given rule that decides, else null), verdict, mined."""
    address = F.col(quoted(url)).cast("string")
    rows = urls.select(
        packed(urls, *ADDED).alias("row"), host_of(address).alias("host"), path_of(address).alias("path"), address.alias("u")
    )
    rows = rows.select(
        "*",
        given(F.col("host"), F.col("path"), rules, lambda r: r.name).alias("rule"),
        given(F.col("host"), F.col("path"), rules, lambda r: r.action).alias("action"),
    )
    open_shape = F.when(F.col("rule").isNull(), F.coalesce(tokens_of(F.col("u")), F.array().cast("array<string>")))
    rows = rows.select("*", open_shape.alias("tokens"))
    mined = cut(mined)
    shapes = rows.where("tokens is not null").select("tokens").distinct()
    found = cut(match(shapes, mined))
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    joined = rows.join(found, "tokens", "left")
    verdict = F.coalesce("action", F.when(F.col("mined").isNotNull(), F.lit("block")), F.lit("allow"))
    return joined.select(
        *[F.col("row")[c].alias(c) for c in others(urls, *ADDED)], "host", "path", "rule", verdict.alias("verdict"), "mined"
    )
