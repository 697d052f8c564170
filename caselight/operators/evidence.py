"""Literal evidence for a match."""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.functions.binding import let
from caselight.functions.text import normal_form

#: Words that are no evidence in shared fields.
STOP_WORDS = (
    "bệnh", "nhân", "điều", "trị", "chẩn", "đoán", "không", "có", "của", "cho", "và", "với", "trong", "ngoài", "được", "theo", "sau", "trước",
    "tại", "này", "đến", "vào", "ra", "viện", "khoa", "ngày", "tháng", "năm", "một", "các", "những", "hiện", "tiền", "sử", "tình", "trạng",
    "the", "patient", "normal", "âm", "tính", "dương", "ghi", "nhận", "bình", "thường", "cấp", "cứu", "khám", "kết", "quả", "lần",
)
#: Words without content in phrases, and words that negate what follows.
GENERIC = (
    "bệnh", "nhân", "vào", "ra", "viện", "được", "theo", "dõi", "điều", "trị", "khám", "lần", "tình", "trạng", "với", "và", "các", "của", "trong", "sau",
    "trước", "này", "đã", "có", "bị", "không", "chưa", "ngày", "tháng", "năm", "khi", "tại", "từ", "đến", "là", "do", "cho", "thấy", "ghi", "nhận",
)
NEGATORS = ("không", "chưa", "chẳng", "chả", "phủ", "âm")


def tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Letters and digits in runs of two or more, lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*stop) if stop else F.length(t) >= 2)


def ngrams(words: Column, n: int) -> Column:
    """Different runs of n words joined by spaces."""
    last = F.size(words) - n
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))


def terms_of(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """struct(words, phrases) of a text: its different terms, and its different runs of three and of two of them."""
    return let(tokens(c, stop), lambda t: F.struct(F.array_distinct(t).alias("words"), F.concat(ngrams(t, 3), ngrams(t, 2)).alias("phrases")))


def shared_terms(pairs: DataFrame, left: str, right: str, title_left: str, title_right: str, terms: int = 8, phrases: int = 4) -> DataFrame:
    """The pairs of one title with shared terms and phrases: those with a shared phrase or two shared terms at least.

    left and right are columns made by terms_of, once a text and before texts are paired. Adds n_terms, n_phrases, the
    first terms (8) and phrases (4), longest first and then by text, and score: 3, one a term, three a word of a phrase. Titles
    agree in NFC, case and outer spaces aside.
    """
    longest = lambda a, most: F.slice(F.transform(F.array_sort(F.transform(a, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"]), 1, most)
    both = F.struct(F.array_intersect(F.col(left)["words"], F.col(right)["words"]).alias("t"), F.array_intersect(F.col(left)["phrases"], F.col(right)["phrases"]).alias("p"))
    score = lambda m: (3 + F.size(m["t"]) + 3 * F.aggregate(m["p"], F.lit(0), lambda s, x: s + F.regexp_count(x, F.lit(" ")) + 1)).cast("int")
    shown = lambda m: F.struct(F.size(m["t"]).alias("n_terms"), F.size(m["p"]).alias("n_phrases"), longest(m["t"], terms).alias("terms"), longest(m["p"], phrases).alias("phrases"), score(m).alias("score"))
    same = pairs.where(F.lower(F.trim(normal_form(F.col(title_left), "NFC"))) == F.lower(F.trim(normal_form(F.col(title_right), "NFC"))))
    # A generator of no or one row: a filter on the result would work the intersections out a second time.
    enough = F.filter(F.array(both), lambda m: (F.size(m["p"]) > 0) | (F.size(m["t"]) >= 2))
    return same.select(*(c for c in pairs.columns if c not in (left, right)), F.inline(F.transform(enough, shown)))


def proposed_pairs(pairs: DataFrame, left: str, right: str, fields: DataFrame, key: str, field: str, title: str, terms: str) -> DataFrame:
    """left, right, left_field, right_field of the fields of one title that share a phrase or two terms, of each pair of owners.

    fields has a row a field of an owner (key), with its number, title and terms_of its text. An inverted index proposes: a pair's fields meet by
    title and term or phrase, each once, and pairs that share too little never become rows of texts. Owners' fields go out once a
    pair, so the work is in proportion to what pairs share and not to the products of their fields.
    """
    norm_title = F.lower(F.trim(normal_form(F.col(title), "NFC")))
    entry = lambda kind: F.transform(F.array_distinct(F.col(terms)[kind]), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    index = fields.select(F.col(key).alias("_k"), F.col(field).alias("_f"), norm_title.alias("_t"), F.explode(F.concat(entry("words"), entry("phrases"))).alias("_e")).select("_k", "_f", "_t", "_e.kind", "_e.x")
    side = lambda c, f: pairs.select(left, right).distinct().join(index.withColumnRenamed("_k", c).withColumnRenamed("_f", f).hint("merge"), c)
    # Spark takes an exploded index for as small as its texts and would broadcast it.
    met = side(left, f"{left}_field").hint("merge").join(side(right, f"{right}_field"), [left, right, "_t", "kind", "x"])
    found = met.groupBy(left, right, f"{left}_field", f"{right}_field").agg(F.count_if(F.col("kind") == "words").alias("_w"), F.count_if(F.col("kind") == "phrases").alias("_p"))
    return found.where("_p > 0 OR _w >= 2").drop("_w", "_p")


def best_pairs(matches: DataFrame, keys: list[str], title_left: str, title_right: str, top: int = 12, ties: list[str] = ()) -> DataFrame:
    """The best match of each pair of titles, the top ones of each key; equal scores go by titles, then by the columns of ties."""
    one = Window.partitionBy(*keys, F.lower(title_left), F.lower(title_right)).orderBy(F.desc("score"), title_left, title_right, *ties)
    all_ = Window.partitionBy(*keys).orderBy(F.desc("score"), title_left, title_right)
    best = matches.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    return best.withColumn("place", F.row_number().over(all_)).where(F.col("place") <= top)


def shared_labs(pairs: DataFrame, rows: DataFrame, key: str, name: str, time: str, value: str, flagged: str, last: int = 3) -> DataFrame:
    """left, right, name, left_values, right_values (the last few of each side, newest first), both_flagged, of tests that both sides of a pair (left, right) of keys have."""
    w = Window.partitionBy(key, F.lower(F.trim(name))).orderBy(F.desc(time), value)
    recent = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("_v")))), lambda x: x["_v"])
    tests = recent.groupBy(F.col(key).alias("key"), F.lower(F.trim(name)).alias("name")).agg(ordered.alias("values"), F.bool_or(flagged).alias("flagged"))

    def side(s: str) -> DataFrame:
        return tests.select(F.col("key").alias(s), "name", F.col("values").alias(f"{s}_values"), F.col("flagged").alias(f"{s}_flagged"))

    out = pairs.select("left", "right").join(side("left"), "left").join(side("right"), ["right", "name"])
    return out.select("left", "right", "name", "left_values", "right_values", (F.col("left_flagged") & F.col("right_flagged")).alias("both_flagged"))


def shared_modalities(pairs: DataFrame, rows: DataFrame, key: str, modality: str) -> DataFrame:
    """left, right, modalities: the pairs (left, right) of keys whose rows have modalities in common, and these in order."""
    held = rows.where(F.col(modality).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.collect_set(modality).alias("_m"))
    side = lambda s: held.select(F.col("_k").alias(s), F.col("_m").alias(f"_{s}"))
    both = pairs.select("left", "right").join(side("left"), "left").join(side("right"), "right")
    return both.select("left", "right", F.array_sort(F.array_intersect("_left", "_right")).alias("modalities")).where(F.size("modalities") > 0)


_SPANS = "array<struct<key:string,start:int,end:int>>"


def icd_spans(text: Column) -> Column:
    """Codes of a text, upper case, with their places: array of struct(key, start, end)."""

    def codes(t: str | None) -> list[tuple[str, int, int]]:
        return [(m.group().upper(), m.start(), m.end()) for m in re.finditer(r"(?i)(?<!\w)[A-Z][0-9]{2}(?:\.[A-Z0-9]{1,4})?(?!\w)", t or "")]

    return F.udf(codes, _SPANS, useArrow=False)(text)


def phrase_spans(text: Column, least: int = 2, most: int = 6, chars: int = 6, content: int = 1, generic: tuple[str, ...] = GENERIC, negators: tuple[str, ...] = ()) -> Column:
    """Phrases of least to most words with their places: array of struct(key, start, end), key the words in NFC and one case.

    The words of a phrase are parted by white space only. It has at least content words that are neither generic nor numbers and
    spans at least chars characters. With negators, a phrase that ends after one of them in its run of words is left out: give
    them for fields that tell what was not found.
    """
    plain, no = frozenset(generic), frozenset(negators)

    def phrases(t: str | None) -> list[tuple[str, int, int]]:
        out = []
        for run in re.finditer(r"\w+(?:\s+\w+)*", t or ""):
            words = [(unicodedata.normalize("NFC", m.group()).casefold(), m.start(), m.end()) for m in re.finditer(r"\w+", run.group())]
            counted = [0, *accumulate(w not in plain and not w.isdigit() for w, _, _ in words)]
            end_of = next((i for i, (w, _, _) in enumerate(words) if w in no), len(words))
            for i, (_, start, _) in enumerate(words[:end_of]):
                for j in range(i + least, min(i + most, end_of) + 1):
                    if counted[j] - counted[i] >= content and words[j - 1][2] - start >= chars:
                        out.append((" ".join(w for w, _, _ in words[i:j]), run.start() + start, run.start() + words[j - 1][2]))
        return out

    # Spans are many times their text: plain UDFs hold those of a hundred texts, an Arrow batch those of 10,000.
    return F.udf(phrases, _SPANS, useArrow=False)(text)


def shared_spans(own: Column, other: Column, priority: int) -> Column:
    """struct(priority, start, end) of one text's spans whose key the other text's spans have."""
    keys = F.transform(other, lambda s: s["key"])
    held = F.filter(own, lambda s: F.array_contains(keys, s["key"]))
    return F.transform(held, lambda s: F.struct(F.lit(priority).alias("priority"), s["start"].alias("start"), s["end"].alias("end")))


def marked(text: Column, spans: Column, kinds: tuple[str, ...] = ("icd", "diagnosis", "summary")) -> Column:
    """The text as HTML with spans struct(start, end, priority), apart and in order, in marks of their kind."""
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    part = lambda start, end: safe(F.substring(text, start + 1, end - start))
    before = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
    names = F.array(*map(F.lit, kinds))
    pieces = F.transform(spans, lambda s, i: F.concat(part(before(i), s["start"]), F.lit('<mark class="match-'), F.get(names, s["priority"]), F.lit('">'), part(s["start"], s["end"]), F.lit("</mark>")))
    tail = part(F.coalesce(F.get(spans, F.size(spans) - 1)["end"], F.lit(0)), F.length(text))
    return F.concat(F.array_join(pieces, ""), tail)


def apart(spans: Column) -> Column:
    """Spans struct(priority, start, end) that don't overlap: best priority first, then the longer, then the earlier; in order of place."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["priority"].alias("priority"), (s["start"] - s["end"]).alias("size"), s["start"].alias("start"), s["end"].alias("end"))))
    none = F.array().cast("array<struct<start:int,end:int,priority:int>>")
    pick = lambda acc, s: F.when(F.exists(acc, lambda c: (s["start"] < c["end"]) & (c["start"] < s["end"])), acc).otherwise(
        F.concat(acc, F.array(F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["priority"].cast("int").alias("priority"))))
    )
    return F.array_sort(F.aggregate(order, none, pick))


def budget_profile(rows: DataFrame, keys: list[str], order: list[str], text: str, field_cap: int, visit_cap: int) -> DataFrame:
    """Each row's kept text under a cap a field and a cap a group, with taken, truncated and omitted; repeated rows count once."""
    w = Window.partitionBy(*keys, text).orderBy(*order)
    one = rows.withColumn("duplicate", F.row_number().over(w) > 1)
    want = F.when(F.col("duplicate"), F.lit(0)).otherwise(F.least(F.length(text), F.lit(field_cap)))
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = one.withColumn("_want", want).withColumn("_before", F.coalesce(F.sum("_want").over(before), F.lit(0)))
    take = F.greatest(F.lit(0), F.least(F.col("_want"), F.lit(visit_cap) - F.col("_before"))).cast("int")
    out = out.withColumn("taken", take).withColumn("kept_text", F.substring(F.col(text), F.lit(1), F.col("taken")))
    out = out.withColumn("omitted", ~F.col("duplicate") & (F.col("taken") == 0)).withColumn("truncated", ~F.col("duplicate") & (F.col("taken") > 0) & (F.col("taken") < F.length(text)))
    return out.drop("_want", "_before")
