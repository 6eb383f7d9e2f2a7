"""URL filters with DataFrame functions only: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, one of the URLs that rules allow and one of those that they block: the probability
of a character after up to three others, each order interpolated with the next lower one by Witten and Bell's rule,
P(c|h) = (n(hc) + t(h) P(c|h')) / (n(h) + t(h)), t(h) being the number of different characters seen after h. The score of a URL is
its log-likelihood ratio divided by its length. Of the URLs that rules decide, one in HELD_OUT by hash is not counted in the models: the
threshold is the one with the best mean of both classes' shares of right decisions on these.

Scale: URLs are counted once each. The models hold at most ALPHABET ** ORDER grams (a proven bound, 39 ** 4), so the table of ratios is
broadcast; characters of a URL are summed where they are made, before the shuffle. Ratios and scores are written once. The driver gets one
number, the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written

ORDER = 4
#: 26 letters, one for digits, ten marks, one for all else, one before the start.
ALPHABET = 39
#: Width of the bins that the threshold is chosen from.
STEP = 0.01
#: One in so many of the URLs that rules decide is kept from the models, to choose the threshold on.
HELD_OUT = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, _UPPER, _LOWER)


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds host (after the first ://, up to / ? # or end, A-Z in lower case) and path (then up to ? # or end)."""
    rest = F.when(F.col(url).contains("://"), F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    both = df.withColumn("_rest", rest)
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    path = F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)
    return both.withColumn("host", lower(host)).withColumn("path", path).drop("_rest")


def with_rule(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and known (its verdict), null where no rule (verdict, host, path) fits; the longest of those that fit wins."""
    rule, known = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, known = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(known)
    return df.withColumn("rule", rule).withColumn("known", known)


def _grams(urls: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.translate(lower(F.col("url")), "0123456789", "0000000000"), "[^a-z0/.:?&=#_%-]", "~")
    padded = urls.withColumn("s", F.concat(F.lit("^" * (ORDER - 1)), text))
    at = F.sequence(F.lit(1), F.length("s") - (ORDER - 1))
    return padded.filter(F.length("s") >= ORDER).withColumn("i", F.explode(at)).withColumn("gram", F.expr(f"substring(s, i, {ORDER})")).drop("s", "i")


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio) for each gram of the columns gram, a, b (its counts in accepted and in rejected URLs)."""
    total, lowest = Window.partitionBy(F.lit(0)), F.substring("gram", ORDER, 1)
    p = grams.groupBy(lowest.alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    p = p.select("g", *(((F.col(c) + 1.0) / (F.sum(c).over(total) + ALPHABET)).alias(f"p{c}") for c in "ab"))
    for k in range(2, ORDER + 1):
        own = grams.groupBy(F.substring("gram", ORDER - k + 1, k).alias("h")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        context = Window.partitionBy(F.substring("h", 1, k - 1))
        own = own.select("h", "a", "b", *(F.sum(c).over(context).alias(f"n{c}") for c in "ab"), *(F.sum((F.col(c) > 0).cast("int")).over(context).alias(f"t{c}") for c in "ab"))
        both = own.join(p, F.substring("h", 2, k - 1) == F.col("g"))
        p = both.select(F.col("h").alias("g"), *(F.when(F.col(f"n{c}") + F.col(f"t{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"p{c}")).alias(f"p{c}") for c in "ab"))
    return p.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pb")).alias("ratio"))


def scored(pages: DataFrame, held_out: int = 0) -> DataFrame:
    """(url, n, known, held, score) for each distinct URL of pages (url, known) that is not null. One known URL in `held_out` is held, that is
    not counted in the models; 0 is none."""
    urls = pages.filter("url is not null").groupBy("url").agg(F.count("*").alias("n"), F.max("known").alias("known"))
    held = F.col("known").isNotNull() & (F.pmod(F.xxhash64("url", F.lit("held out")), F.lit(held_out)) == 0) if held_out else F.lit(False)
    urls = urls.withColumn("held", held)
    count = lambda v: F.sum(F.when((F.col("known") == v) & ~F.col("held"), F.col("n")).otherwise(0))
    grams = _grams(urls)
    ratios = written(log_ratios(grams.groupBy("gram").agg(count("allow").alias("a"), count("block").alias("b"))))
    ratio = grams.join(F.broadcast(ratios), "gram").groupBy("url").agg(F.avg("ratio").alias("score"))
    return urls.join(ratio, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def threshold(scores: DataFrame, step: float = STEP) -> int | None:
    """The number of steps of score from which a URL is allowed; None if one of the two classes has no example."""
    known = scores.filter("known is not null").select(F.floor(F.col("score") / step).alias("bin"), "known", "n")
    bins = known.groupBy("bin").agg(*(F.sum(F.when(F.col("known") == v, F.col("n")).otherwise(0)).alias(c) for c, v in (("a", "allow"), ("b", "block"))))
    below = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    less = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0))
    right = (1 - less("a") / F.sum("a").over(everything)) + less("b") / F.sum("b").over(everything)
    row = bins.withColumn("all_a", F.sum("a").over(everything)).withColumn("all_b", F.sum("b").over(everything)).filter("all_a > 0 and all_b > 0").select("bin", right.alias("right")).orderBy(F.desc("right"), "bin").first()
    return None if row is None else row["bin"]


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: page_id, url, host, path, rule, score, verdict.

    A null url, or one without ://, has empty host and path; a null or empty url scores 0. Where no rule fits, a URL is allowed if its
    score reaches the threshold; if rules allow none or block none, every such URL is allowed, and if none of either is held out, the
    threshold is chosen on all URLs that rules decide. Repeated rows each get a row and count as
    often in the models. Other columns are ignored.
    """
    own = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    found = with_rule(with_parts(own, "url"), rules)
    scores = written(scored(found, HELD_OUT))
    least = threshold(scores.filter("held"))
    least = threshold(scores) if least is None else least
    both = found.join(scores.select(F.col("url").alias("of"), "score"), F.col("url") == F.col("of"), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_score = F.lit("allow") if least is None else F.when(F.floor(F.col("score") / STEP) >= F.lit(least), "allow").otherwise("block")
    return both.select("page_id", "url", "host", "path", "rule", "score", F.coalesce("known", by_score).alias("verdict"))
