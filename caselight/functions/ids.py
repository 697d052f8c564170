"""Identifiers and hash orders (§1.4, F1, T4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_id(prefix: str, *cols: Column) -> Column:
    """prefix_ and 24 hex digits of the SHA-256 of the values as a JSON array."""
    quoted = [F.to_json(F.array(F.coalesce(c.cast("string"), F.lit("")))) for c in cols]
    payload = F.concat(F.lit("["), F.concat_ws(", ", *(F.regexp_replace(q, r"^\[|\]$", "") for q in quoted)), F.lit("]"))
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(payload.cast("binary"), 256), 1, 24))


def event_id(*cols: Column, prefix: str = "") -> Column:
    """24 hex digits of the SHA-256 of the values joined by the unit separator."""
    digest = F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)).cast("binary"), 256), 1, 24)
    return F.concat(F.lit(prefix), digest) if prefix else digest


def concept_token(prefix: str, label: Column) -> Column:
    """PREFIX: and 20 hex digits of a normalised label."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(label.cast("binary"), 256), 1, 20))


def split_score(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of SHA-256 of 'seed:key'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def hash_split(seed: int, key: Column, train: float = 0.7, validation: float = 0.15) -> Column:
    """train, validation or test by split_score."""
    s = split_score(seed, key)
    return F.when(s < train, "train").when(s < train + validation, "validation").otherwise("test")


def hash_order(seed: int, key: Column) -> Column:
    """Digest that orders keys at random but always alike."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def category_id(c: Column) -> Column:
    """Fixed numbers of five categories, else 100 and the text's bytes, the first the least digit of a number to base 256, modulo 900000."""
    fixed = {"negative": 0, "positive": 1, "indeterminate": -1, "normal": 10, "abnormal": 11}
    digits = F.hex(c.cast("binary"))
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    places = F.when(F.length(digits) > 0, F.reverse(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1))).otherwise(F.array().cast("array<int>"))
    out = F.lit(100) + F.aggregate(places, F.lit(0), lambda n, i: (n * 256 + byte(i)) % 900_000)
    for word, n in fixed.items():
        out = F.when(c == word, F.lit(n)).otherwise(out)
    return out
