"""URL filters (3), with DataFrame functions only: a ratio of two character language models.

Rules (host and path prefix) judge the urls they fit. The rest are judged by two variable-order Markov models of
characters, one of the urls that rules allow and one of those they block. A character's context is the longest run of up to
ORDER characters before it that makes up at least SHARE of all places of both classes (runs of up to BASE always
count); its probability is smoothed by the one after the next shorter context, down to none and a uniform share. A url's score is
the difference of its log-likelihoods over its length. The cut is calibrated on urls that the models haven't seen: of the
rule-judged urls, a share of 1 in HELD_OUT (by hash) is kept out of the counts, and the cut is the one that makes the
least sum of error shares of their two classes, the middle one of equals. Urls that score the cut or more are allowed.

Urls enter the models without their scheme, A-Z lowered, digits alike and in an alphabet of SYMBOLS codes. Counts are
gathered over all urls that rules judge, combined before their shuffle; runs of ORDER + 1 codes are counted once, shorter
ones are sums of these. A context of a kept one is kept, too, and at most 1 / SHARE contexts of a length are, so the models'
weights have a bound whatever the input: SYMBOLS ** (BASE + 1) rows and SYMBOLS / SHARE for each longer length, which
allows their broadcast. Different urls are scored once: their characters meet the weights in broadcast joins and are
summed before the shuffle, which moves urls, never pages' other columns; the scores go back to the pages by url.

Defined results: null urls or urls without "://" have empty host and path and no rule, the models judge what
text they have; an empty text scores 0; if no url of either class is known, scores are 0, and if none is held out of either
class, the cut is 0; then 0 is allowed. Equal urls get equal verdicts; repeated rows each give a row; empty tables give empty
results; null ids stay null. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.functions.binding import let
from caselight.llm.shared import Scratch

#: Action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = _LOWER + "0./-_?=&%#:"
#: One code for each character of the alphabet, one for all others (0), one for what stands before the url.
SYMBOLS = len(ALPHABET) + 2
START = SYMBOLS - 1
SMOOTHING = 2.0
#: Characters of the longest contexts, of those that are always used, and the least share of all places of the others.
ORDER, BASE, SHARE = 5, 2, 2e-4
HELD_OUT = 5
#: Steps of the cut, and the scores between which it lies.
STEP, MOST = 0.005, 8.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, lowered, and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its action; null where none does."""
    rule = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def runs(url: Column) -> Column:
    """For each character of a url the number of the run of codes that ends with it: up to ORDER before it and its own."""
    at = F.locate("://", url)
    text = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.coalesce(url, F.lit("")))
    flat = F.translate(text, _UPPER + "123456789", _LOWER + "000000000")
    padded = F.sequence(F.lit(1), F.lit(ORDER))
    code = lambda c: F.when(c == "", F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), c)).cast("long")
    every = lambda f: F.concat(F.transform(padded, lambda _: F.lit(START).cast("long")), F.transform(F.split(f, ""), code))
    run = lambda c, i: sum((F.get(c, i + ORDER - k) * SYMBOLS**k for k in range(1, ORDER + 1)), F.get(c, i + ORDER))
    numbered = lambda f: let(every(f), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: run(c, i)))
    return let(flat, lambda f: F.when(F.length(f) > 0, numbered(f)).otherwise(F.array().cast("array<long>")))


def _smoothed(k: int, shorter: str) -> list[Column]:
    """Class k's probability of a run's last code, from the counts of the run, of its context, and the probability after the shorter context."""
    return (F.col(f"n{k}") + SMOOTHING * F.col(f"{shorter}{k}")) / (F.col(f"c{k}") + SMOOTHING)


def _models(scratch: Scratch, counts: DataFrame) -> dict[int, DataFrame]:
    """Weights by length from BASE + 1 on, from counts (run, n0, n1): code, w = log p(allow) - log p(block) of the run's last code after those before it."""
    s, spark = SYMBOLS, counts.sparkSession
    sums = lambda df, key: df.groupBy(key.alias("code")).agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in (0, 1)))
    total = counts.agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("t0"), F.coalesce(F.sum("n1"), F.lit(0)).alias("t1"))
    total = scratch.write(total).select(F.struct("t0", "t1").alias("t")).scalar()
    p: DataFrame | None = None
    found = {}
    for length in range(1, ORDER + 2):
        seen = scratch.write(sums(counts, F.pmod("run", F.lit(s**length))))
        context = seen.groupBy(F.floor(F.col("code") / s).cast("long").alias("context")).agg(*(F.sum(f"n{k}").alias(f"c{k}") for k in (0, 1)))
        if length <= BASE + 1:
            every = spark.range(s**length).select(F.col("id").alias("code"))
        else:
            kept = context.where(F.col("c0") + F.col("c1") >= SHARE * (total["t0"] + total["t1"]))
            every = kept.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(s - 1)), lambda c: F.col("context") * s + c)).alias("code"))
        rows = every.join(seen, "code", "left").withColumn("context", F.floor(F.col("code") / s).cast("long")).join(context, "context", "left").na.fill(0, ["n0", "n1", "c0", "c1"])
        if p is None:
            rows = rows.withColumn("q0", F.lit(1 / s)).withColumn("q1", F.lit(1 / s))
        else:
            rows = rows.withColumn("shorter", F.pmod("code", F.lit(s ** (length - 1)))).join(p.select(F.col("code").alias("shorter"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "shorter")
        p = scratch.write(rows.select("code", *(_smoothed(k, "q").alias(f"p{k}") for k in (0, 1))))
        if length > BASE:
            known = (total["t0"] > 0) & (total["t1"] > 0)
            found[length] = p.select("code", F.when(known, F.log("p1") - F.log("p0")).otherwise(F.lit(0.0)).alias("w"))
    return found


def fit(scratch: Scratch, known: DataFrame) -> dict[int, DataFrame]:
    """The weights (code, w) of runs by their length, from urls with their action."""
    one = known.select(F.explode(runs(F.col("url"))).alias("run"), (F.col("action") == "allow").cast("long").alias("y"))
    counts = scratch.write(one.groupBy("run").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")))
    return _models(scratch, counts)


def scores(urls: DataFrame, models: dict[int, DataFrame]) -> DataFrame:
    """url, score of different urls: the weights of its characters' longest runs that have one, over its length.

    Weights are summed in whole billionths, so a score doesn't depend on the order of its terms.
    """
    rows = urls.where("url IS NOT NULL").select("url").distinct().select("url", F.explode(runs(F.col("url"))).alias("run"))
    for length, weights in models.items():
        held = F.broadcast(weights.select(F.col("code").alias(f"code{length}"), F.round(F.col("w") * 1e9).cast("long").alias(f"w{length}")))
        rows = rows.join(held, F.pmod("run", F.lit(SYMBOLS**length)) == F.col(f"code{length}"), "left")
    best = F.coalesce(*(f"w{length}" for length in sorted(models, reverse=True)))
    return rows.groupBy("url").agg((F.sum(best) / F.count(F.lit(1)) / 1e9).alias("score"))


def cut(scored: DataFrame) -> DataFrame:
    """One row, t: the cut of the least sum of error shares over scored (action, score); 0 without both classes."""
    place = F.ceil(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col("score"))) / STEP).cast("int")
    steps = scored.groupBy(place.alias("i")).agg(F.count_if(F.col("action") == "allow").alias("a"), F.count_if(F.col("action") == "block").alias("b"))
    up, all_ = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # At most 2 * MOST / STEP + 1 rows. A cut above step i loses the allowed up to it and lets pass the blocked beyond it.
    sums = steps.select("i", F.sum("a").over(up).alias("lost"), F.sum("b").over(up).alias("caught"), F.sum("a").over(all_).alias("a"), F.sum("b").over(all_).alias("b"), F.lead("i").over(Window.orderBy("i")).alias("next"))
    error = F.col("lost") / F.col("a") + 1 - F.col("caught") / F.col("b")
    rows = sums.where("a > 0 AND b > 0").select(error.alias("error"), ((F.col("i") + F.coalesce("next", F.col("i") + 1) - 1) / 2 * STEP + STEP / 2).alias("t"))
    least = rows.agg(F.min_by(F.col("t"), F.struct("error", F.abs("t"))).alias("t"))
    return least.select(F.coalesce("t", F.lit(0.0)).alias("t"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, score of every row."""
    df = pages.select(F.col(id_col), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    df = df.withColumn("rule", rule).withColumn("action", action)
    with Scratch(pages.sparkSession) as scratch:
        known = df.where("action IS NOT NULL").select("url", "action")
        out = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
        models = fit(scratch, known.where(~out))
        found = scratch.write(scores(df, models))
        t = scratch.write(cut(known.where(out).join(found, "url")))
        scratch.keep_only(found, t)
        scored = df.join(found, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        verdict = F.coalesce("action", F.when(F.col("score") >= t.scalar(), "allow").otherwise("block"))
        return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score")
