"""URL filters: character language-model ratio (native).

Host rules decide what they fit. The urls they decide are also the accepted and the rejected urls
from which two variable-order Markov models over characters are counted; a url that no rule fits
is judged by the difference of its log-likelihoods under both, divided by its length, against a
threshold calibrated on rule-decided urls that the models haven't seen.

The models read whole urls, scheme, query string and fragment included, in their own characters. What
they gather is a table of the distinct character n-grams of all urls, which grows with the input and
stays distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeloom.llm.common import ascii_lower, join_counted, written

#: Characters of a context.
ORDER = 5
#: A context seen less often than this is left for the next shorter one.
LEAST_SEEN = 2
#: Probability of a character that nothing is known of.
FLOOR = 1 / 256
#: Stands before the first character of a url.
START = "\x02"
#: One url in so many is kept from the models for the calibration.
FOLDS = 5
#: Steps of the threshold in one unit of log-likelihood a character, and its range.
STEPS, RANGE = 64, 8


@dataclass(frozen=True)
class Rule:
    """verdict (allow, block) for a host with its subdomains and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: host A-Z lower-cased, both empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as struct (name, verdict); ties: the longer host, then block."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block"))
    named = [F.when(fits(r), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*named) if named else F.lit(None).cast("struct<name:string,verdict:string>")


def grams(url: Column, order: int = ORDER) -> Column:
    """The n-gram of each character of a url: its context of `order` characters (START before the first) and itself."""
    padded = F.concat(F.lit(START * order), url)
    return F.transform(F.sequence(F.lit(1), F.char_length(url)), lambda i: F.substring(padded, i, F.lit(order + 1)))


def gram_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n, ratio) of counts (gram, n, good, bad): log P(last | context, accepted) - log P(last | context, rejected).

    good and bad count the gram in the accepted and the rejected urls that the models learn from. P is smoothed by
    Witten-Bell over the orders 0 to `order`, down to FLOOR; a context seen less than LEAST_SEEN times gives
    way to the next shorter one (the variable order). Every table has at most one row for each distinct gram;
    the joins are by a gram's suffix or context, which at most as many rows share as there are characters.
    """
    sides = ("good", "bad")
    levels = [counts]
    for k in range(order, 0, -1):
        shorter = levels[0].groupBy(F.right("gram", F.lit(k)).alias("gram")).agg(*[F.sum(s).alias(s) for s in sides])
        levels.insert(0, written(shorter, "grams"))

    def level(df: DataFrame, k: int, lower: DataFrame | None) -> DataFrame:
        df = df.withColumn("context", F.left("gram", F.lit(k)))
        facts = [f(s).alias(f"{s}_{name}") for s in sides for f, name in ((F.sum, "seen"), (lambda s: F.count_if(F.col(s) > 0), "kinds"))]
        df = df.join(df.groupBy("context").agg(*facts), "context")
        if lower is None:
            df = df.withColumns({f"{s}_lower": F.lit(FLOOR) for s in sides})
        else:
            lower = lower.select(F.col("gram").alias("suffix"), *[F.col(f"{s}_p").alias(f"{s}_lower") for s in sides])
            df = df.withColumn("suffix", F.right("gram", F.lit(k))).join(lower, "suffix")
        smooth = lambda s: (F.col(s) + F.col(f"{s}_kinds") * F.col(f"{s}_lower")) / (F.col(f"{s}_seen") + F.col(f"{s}_kinds"))
        df = df.withColumns({f"{s}_p": F.when(F.col(f"{s}_seen") >= LEAST_SEEN, smooth(s)).otherwise(F.col(f"{s}_lower")) for s in sides})
        return df.select(*levels[k].columns, *[f"{s}_p" for s in sides])

    lower = None
    for k, df in enumerate(levels):
        lower = level(df, k, lower)
    return lower.select("gram", "n", (F.ln("good_p") - F.ln("bad_p")).alias("ratio"))


def url_scores(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(url_id, score): length-normalised log-likelihood difference of urls (url_id, url, n, accepted).

    url_id is unique; n urls are that one; accepted is null for those that the models don't learn from. The
    positions of all urls meet the table of grams; grams that very many positions have are broadcast
    (`join_counted`). An empty url has no row.
    """
    positions = written(urls.select("url_id", "n", "accepted", F.explode(grams(F.col("url"), order)).alias("gram")), "positions")
    of = lambda side: F.sum(F.when(side, F.col("n")).otherwise(0))
    counts = positions.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), of(F.col("accepted")).alias("good"), of(~F.col("accepted")).alias("bad"))
    ratios = written(gram_ratios(written(counts, "counts"), order), "ratios")
    scored = join_counted(positions.select("url_id", "gram"), ratios, ["gram"], "n")
    # the sum of whole steps doesn't depend on the order of the rows
    exact = F.sum(F.round(F.col("ratio") * 2.0**32).cast("long")) / 2.0**32
    return scored.groupBy("url_id").agg((exact / F.count(F.lit(1))).alias("score"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the threshold with the least sum of both error rates on (score, accepted, n urls).

    Scores fall into 2 x RANGE x STEPS bins, so the window has a bounded number of rows. Ties go to the
    threshold nearest 0. Without both kinds it is 0.
    """
    bins = F.greatest(F.lit(-RANGE * STEPS), F.least(F.lit(RANGE * STEPS), F.floor(F.col("score") * STEPS)))
    counts = scored.groupBy(bins.alias("bin")).agg(F.sum(F.when(F.col("accepted"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("n"))).alias("bad"))
    ordered = Window.orderBy("bin")
    below, above, every = (ordered.rowsBetween(*x) for x in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    lost = F.try_divide(F.coalesce(F.sum("good").over(below), F.lit(0)), F.sum("good").over(every))
    passed = F.try_divide(F.sum("bad").over(above), F.sum("bad").over(every))
    counts = counts.withColumn("errors", lost + passed)
    best = counts.agg(F.min_by("bin", F.struct("errors", F.abs("bin"), "bin")).alias("bin"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    return best.select(F.when((F.col("good") > 0) & (F.col("bad") > 0), F.col("bin") / STEPS).otherwise(0.0).alias("threshold"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Host, path, rule and verdict of every page, and the score that decides where no rule does.

    Returns page_id, host, path, rule, verdict, score, threshold. A null url, or one without ://, has an
    empty host and path and fits no rule; a null or empty one scores 0. Urls of any length are read whole.
    Repeated rows are judged (and counted) each, whatever their page_id, which may be null. If no rule has
    accepted or none has rejected a url, every score is compared with 0 and an even score allows. An empty
    table gives an empty result. Other columns are ignored.
    """
    rows = written(pages.select("page_id", "url"), "urls")
    host, path = url_parts(F.col("url"))
    distinct = rows.where("url <> ''").groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    # each url becomes as many rows as it has characters: not in one task
    distinct = distinct.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    distinct = distinct.withColumn("url_id", F.monotonically_increasing_id()).withColumn("fit", rule_of(host, path, rules))
    distinct = written(distinct.withColumn("held_out", F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(FOLDS)) == 0), "distinct")
    accepted = F.col("fit.verdict") == "allow"
    scores = written(url_scores(distinct.select("url_id", "url", "n", F.when(~F.col("held_out"), accepted).alias("accepted"))), "scores")
    scored = written(distinct.join(scores, "url_id").select("url", "n", "fit", "held_out", "score"), "scored")
    limit = threshold(scored.where("held_out and fit is not null").select("score", "n", accepted.alias("accepted")))
    limit = F.coalesce(written(limit, "threshold").select("threshold").scalar(), F.lit(0.0))
    scored = scored.select("url", F.col("fit").alias("found"), F.col("score").alias("found_score"), "n")
    # a url that a large share of the pages have is no hot key
    judged = join_counted(rows.where("url <> ''"), scored, ["url"], "n").drop("n")
    judged = judged.unionByName(rows.where("url is null or url = ''").select("page_id", "url", *[F.lit(None).cast(scored.schema[c].dataType).alias(c) for c in ("found", "found_score")]))
    judged = judged.select("page_id", host.alias("host"), path.alias("path"), F.col("found").alias("fit"), F.coalesce("found_score", F.lit(0.0)).alias("score"), limit.alias("threshold"))
    by_score = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", F.col("fit.name").alias("rule"), F.coalesce("fit.verdict", by_score).alias("verdict"), "score", "threshold")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
