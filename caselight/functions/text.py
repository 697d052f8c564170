"""Scalar normalisation of text, codes and identifiers as column expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.functions.binding import let

#: Texts that mean "missing"; the strict set also takes the short forms.
MISSING = ("", "null", "none", "nan", "nat", "not available")
MISSING_STRICT = (*MISSING, "n/a", "na")


def normal_form(c: Column, form: str) -> Column:
    """A Unicode normal form, by a pandas UDF only where the text isn't ASCII."""

    @F.pandas_udf("string")
    def normalised(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return F.when(c.rlike(r"[^\x00-\x7F]"), normalised(c)).otherwise(c)


def nfkc(c: Column) -> Column:
    """Unicode NFKC."""
    return normal_form(c, "NFKC")


def collapse(c: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def casefold(c: Column) -> Column:
    """Lower case, with the sharp s spelt out."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def clean(c: Column, missing: tuple[str, ...] = MISSING, compatibility: bool = False) -> Column:
    """Trimmed text; null and missing words become ''. compatibility adds NFKC."""
    text = collapse(F.coalesce(nfkc(c) if compatibility else c, F.lit("")))
    if compatibility:  # a pandas UDF can't enter a lambda
        return F.when(casefold(text).isin(*missing), F.lit("")).otherwise(text)
    return let(text, lambda t: F.when(casefold(t).isin(*missing), F.lit("")).otherwise(t))


def clean_or_null(c: Column) -> Column:
    """clean with the strict set and nulls for missing text."""
    return F.nullif(clean(c, MISSING_STRICT), F.lit(""))


def clean_key(c: Column) -> Column:
    """clean, and digits without a trailing .0"""
    return F.regexp_replace(clean(c), r"^(\d+)\.0+$", "$1")


def normalized(c: Column) -> Column:
    """clean in one case."""
    return casefold(clean(c))


def entity_key(c: Column) -> Column:
    """Letters and digits in one case, anything else between them one space."""
    return F.trim(F.regexp_replace(normalized(c), r"(?U)[\W_]+", " "))


def canonical_icd(c: Column) -> Column:
    """Upper case without dots and spaces."""
    return F.regexp_replace(F.upper(clean(c)), r"[.\s]+", "")


def icd_list(c: Column) -> Column:
    """The non-empty codes of a text that separates them by ; , or |"""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,|]+"), canonical_icd), lambda x: x != "")


def is_icd10(c: Column) -> Column:
    """Shaped like an ICD-10 code."""
    return c.rlike(r"^(?i)[A-TV-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?$")


def diagnosis_concept(code: Column, name: Column) -> Column:
    """struct(code, strategy): the namespaced ICD-10 code, another code, or the name."""
    key = clean(code)
    kind = F.when(is_icd10(key), "icd10").when(key != "", "local_code").otherwise("name")
    value = F.when(is_icd10(key), F.concat(F.lit("ICD10CM/"), F.upper(key))).when(key != "", F.concat(F.lit("LOCAL/"), key)).otherwise(F.concat(F.lit("NAME/"), entity_key(name)))
    return F.struct(value.alias("code"), kind.alias("strategy"))


def source_key(code: Column, name: Column, both: bool = False) -> Column:
    """code:c, else name:n; with both code_name:c|n where the code and the name are known."""
    c, n = F.coalesce(code, F.lit("")), F.coalesce(name, F.lit(""))
    one = F.when(c != "", F.concat(F.lit("code:"), c)).otherwise(F.concat(F.lit("name:"), n))
    return F.when((c != "") & (n != ""), F.concat(F.lit("code_name:"), c, F.lit("|"), n)).otherwise(one) if both else one


def first_nonempty(*cols: Column) -> Column:
    """The first column that is neither null nor ''; else ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def gender_token(c: Column, words: dict[str, str] | None = None) -> Column:
    """The code of a gender word; 'unknown' for the rest."""
    held = words or {"male": "M", "m": "M", "nam": "M", "female": "F", "f": "F", "nữ": "F", "nu": "F"}
    out = F.lit("unknown")
    for word, code in held.items():
        out = F.when(normalized(c) == word, F.lit(code)).otherwise(out)
    return out


def join_unique(*cols: Column, sep: str = "; ") -> Column:
    """The non-empty texts in order, each once without regard to case."""
    texts = F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))
    keep = F.aggregate(texts, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: casefold(y) == casefold(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(keep, sep)


def is_flagged(value: Column, bounds: Column) -> Column:
    """A number outside the first two numbers of the reference-range text."""
    first = lambda c, i: F.get(F.regexp_extract_all(F.replace(c, F.lit(","), F.lit(".")), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), F.lit(i)).try_cast("double")
    v = first(value, 0)
    return F.coalesce((v < first(bounds, 0)) | (v > first(bounds, 1)), F.lit(False))


def unique_headers(names: list[str | None]) -> list[str]:
    """Names for a header row: cleaned, numbered where empty, marked __2, __3 where repeated."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names, 1):
        text = " ".join((name or "").split())
        text = f"unnamed_column_{i}" if text.lower() in MISSING_STRICT else text
        seen[text] = n = seen.get(text, 0) + 1
        out.append(text if n == 1 else f"{text}__{n}")
    return out


def unique_header_row(names: Column) -> Column:
    """unique_headers of a row of headers, an array of texts."""
    cleaned = F.transform(names, lambda n, i: let(collapse(F.coalesce(n, F.lit(""))), lambda t: F.when(F.lower(t).isin(*MISSING_STRICT), F.concat(F.lit("unnamed_column_"), (i + 1).cast("string"))).otherwise(t)))
    numbered = lambda all_: F.transform(all_, lambda t, i: let(F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda x: x == t)), lambda k: F.when(k == 1, t).otherwise(F.concat(t, F.lit("__"), k.cast("string")))))
    return let(cleaned, numbered)


def split_text(c: Column, size: int = 30_000) -> Column:
    """Pieces of at most size UTF-16 units, as long as can be; a character of two units is not parted."""
    wide = r"[^\x{0}-\x{FFFF}]"
    starts = lambda t: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length(t) / size).cast("int")) - 1), lambda i: i * size)
    state = lambda cuts, units, at: F.struct(cuts.alias("cuts"), units.alias("units"), at.alias("at"))

    def add(acc: Column, x: Column) -> Column:
        cost = F.when(x.rlike(wide), F.lit(2)).otherwise(F.lit(1))
        full = acc["units"] + cost > size
        return state(F.when(full, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]), F.when(full, cost).otherwise(acc["units"] + cost), acc["at"] + 1)

    # Only texts with characters of two units are gone through one by one.
    walked = lambda t: F.aggregate(F.filter(F.split(t, ""), lambda x: x != ""), state(F.array(F.lit(0)), F.lit(0), F.lit(0)), add, lambda acc: acc["cuts"])
    cut = lambda t, at: F.transform(at, lambda s, i: F.substring(t, s + 1, F.coalesce(F.get(at, i + 1), F.length(t)) - s))
    return let(c, lambda t: let(F.when(t.rlike(wide), walked(t)).otherwise(starts(t)), lambda at: cut(t, at)))


def matches_all(label: Column, search: Column) -> Column:
    """Every word of the search occurs in the label, both in Unicode NFC and lower case."""
    # The label stands beside each word, as a pandas UDF can't enter a lambda.
    words = F.filter(F.split(F.lower(normal_form(search, "NFC")), r"\s+"), lambda t: t != "")
    beside = F.arrays_zip(words.alias("w"), F.array_repeat(F.lower(normal_form(label, "NFC")), F.size(words)).alias("l"))
    return F.forall(beside, lambda p: F.contains(p["l"], p["w"]))


def strip_json_fence(c: Column) -> Column:
    """The text inside a fenced block, if it is one."""
    return F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))


def json_object(c: Column) -> Column:
    """What stands from the first brace to the last of a text without its fence; the text itself where there are none."""
    bare = strip_json_fence(c)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(bare)


def model_output(payload: Column, required: list[str]) -> Column:
    """struct(output variant, error) of a stored model call: the first text part of its answer that holds a JSON object with the required fields.

    The call is JSON text; a part's text is JSON again, in a fence or among words, or once more a JSON string of such text. Errors: "payload", "no text", "not json" and "missing " with the fields that the first object lacks.
    """
    read = lambda t: F.try_parse_json(t)
    # A JSON string around the object is taken off first.
    inner = lambda t: let(F.trim(t), lambda x: json_object(F.coalesce(F.when(F.startswith(x, F.lit('"')), F.try_variant_get(read(x), "$", "string")), x)))
    parts = F.try_variant_get(read(payload), "$.response.candidates", "array<struct<content:struct<parts:array<struct<text:string>>>>>")
    texts = F.filter(F.flatten(F.transform(F.coalesce(parts, F.array().cast("array<struct<content:struct<parts:array<struct<text:string>>>>>")), lambda p: F.coalesce(p["content"]["parts"], F.array().cast("array<struct<text:string>>")))), lambda t: F.coalesce(t["text"] != "", F.lit(False)))

    def judged(objects: Column) -> Column:
        first = F.get(objects, F.lit(0))
        missing = F.array_compact(F.array(*(F.when(F.try_variant_get(first, f"$.{f}", "variant").isNull(), F.lit(f)) for f in required)))
        return let(missing, lambda m: F.struct(F.when((F.size(objects) > 0) & (F.size(m) == 0), first).alias("output"), F.when(F.size(objects) == 0, F.lit("not json")).when(F.size(m) > 0, F.concat(F.lit("missing "), F.array_join(m, ","))).alias("error")))

    def found(t: Column) -> Column:
        objects = F.filter(F.transform(t, lambda p: read(inner(p["text"]))), lambda v: v.isNotNull() & F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))
        none = lambda e: F.struct(F.lit(None).cast("variant").alias("output"), F.lit(e).alias("error"))
        return F.when(read(payload).isNull(), none("payload")).when(F.size(t) == 0, none("no text")).otherwise(let(objects, judged))

    return let(texts, found)


def patient_blocks(c: Column, title: str = "BỆNH NHÂN") -> Column:
    """Map from patient id to the text under its heading line, of what follows the last DATA line, if there is one.

    A heading is the title, an id of a capital letter and digits, and the end of the line. Of an id that comes twice the later block counts.
    """
    data = F.regexp_replace(c, r"(?s)^.*\nDATA\n", "")
    heading = rf"(?m)^{title}\s+([A-Z][0-9]+)\s*$"

    def blocks(t: Column) -> Column:
        ids, bodies = F.regexp_extract_all(t, F.lit(heading), F.lit(1)), F.slice(F.split(t, heading, -1), 2, F.size(F.regexp_extract_all(t, F.lit(heading), F.lit(1))) + 1)
        pairs = F.zip_with(ids, bodies, lambda i, b: F.struct(i.alias("key"), F.regexp_replace(b, r"(?U)^\s+|\s+$", "").alias("value")))
        last = F.filter(pairs, lambda p, n: ~F.array_contains(F.slice(ids, n + 2, F.size(ids)), p["key"]))
        return F.map_from_entries(last)

    return let(data, blocks)


def labelled_sections(*parts: tuple[str, Column]) -> Column:
    """'name: text' lines of the parts that have text."""
    lines = F.array(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in parts))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def instruct(task: str, c: Column) -> Column:
    """A query text with its instruction in front."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), c)


def text_sha256(c: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, lowercase hex."""
    return F.sha2(c.cast("binary"), 256)


def file_sha256(content: Column) -> Column:
    """SHA-256 of a file's bytes, lowercase hex."""
    return F.sha2(content, 256)


def vector_sha256(v: Column) -> Column:
    """SHA-256 of a vector's components as little-endian 32-bit floats, lowercase hex; null for null."""

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x, "<f4").tobytes()).hexdigest())

    return digest(v)


def canonical(c: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs in the order of their names; a float that isn't finite fails the job when it is met."""
    if isinstance(kind, T.StructType):
        fields = [canonical(c[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        wrong = F.isnan(c) | (F.abs(c) == float("inf"))
        return F.when(wrong, F.raise_error(F.lit("a number that JSON can't hold")).cast(kind)).otherwise(c)
    return c


def canonical_json(columns: dict[str, T.DataType]) -> Column:
    """One JSON object of the columns, keys in order at every level, without nulls' keys."""
    return F.to_json(F.struct(*(canonical(F.col(f"`{n}`"), columns[n]).alias(n) for n in sorted(columns))))
