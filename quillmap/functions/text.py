"""Text and scalar rules as Column expressions (no Python in the row path)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from quillmap import constants as K

_BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Trim every ASCII blank, not only spaces."""
    return F.trim(c, F.lit(_BLANKS))


def outside(keep: str) -> str:
    """Regex class of all characters that a class such as ``a-z0-9é`` leaves out, as plain ranges.

    Java matches a list of ranges about ten times faster than a negated class with accents.
    """
    kept = set()
    for m in re.finditer(r"(.)-(.)|(.)", keep):
        first, last = (m[1], m[2]) if m[1] else (m[3], m[3])
        kept.update(range(ord(first), ord(last) + 1))
    edges = [-1, *sorted(kept), 0x110000]
    gaps = [(lo + 1, hi - 1) for lo, hi in zip(edges, edges[1:]) if hi - lo > 1]
    return "[" + "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in gaps) + "]"


def clean_text(c: Column, keep: str = K.CLEAN_KEEP) -> Column:
    """Lower case; every run of characters outside ``keep`` becomes one space; trimmed.

    Dropped characters and blanks both end as a single space, so one pass is enough.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), outside(keep) + "+", " "))


def clean_words(c: Column) -> Column:
    """Words of a cleaned text, in order, with repeats."""
    return F.filter(F.split(clean_text(c), " "), lambda w: w != "")


def text_match_ratio(query: Column, target: Column) -> Column:
    """Share of the distinct query words that occur as substrings of the target.

    The cleaned target is carried in the accumulator: inside a lambda it would be cleaned again
    for every word.
    """
    start = F.struct(clean_text(target).alias("t"), F.lit(0).alias("hit"), F.lit(0).alias("n"))
    return F.aggregate(
        F.array_distinct(clean_words(query)),
        start,
        lambda a, w: F.struct(
            a["t"].alias("t"),
            (a["hit"] + F.when(F.contains(a["t"], w), 1).otherwise(0)).alias("hit"),
            (a["n"] + 1).alias("n"),
        ),
        lambda a: F.when(a["n"] > 0, F.least(F.lit(1.0), a["hit"] / a["n"])).otherwise(F.lit(0.0)),
    )


def snippet(c: Column, n: int = K.SNIPPET_CHARS) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


# --- paths ------------------------------------------------------------------

def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    name = basename(path)
    cut = F.length(path) - F.length(name) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).otherwise(F.lit(""))


def parent_folder(path: Column) -> Column:
    """Lower-case name of the folder that holds the file."""
    return F.lower(basename(dirname(path)))


def extension(path: Column) -> Column:
    """Lower-case last extension with its dot; '' for none and for dot files."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    """Lower-case file name without any of its extensions."""
    return F.substring_index(F.lower(basename(path)), ".", 1)


def path_text(path: Column) -> Column:
    """File name as words: '_' and '-' become spaces."""
    return F.translate(basename(path), "_-", "  ")


def archive_of(path: Column, root: str) -> Column:
    """First folder below ``root``; ``_root`` for files directly in it; else the folder."""
    prefix = root.rstrip("/") + "/"
    rel = F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    return (
        F.when(~path.startswith(prefix), dirname(path))
        .when(F.contains(rel, F.lit("/")), F.concat(F.lit(prefix), F.substring_index(rel, "/", 1)))
        .otherwise(F.lit("_root"))
    )


def is_hidden(path: Column) -> Column:
    return basename(path).startswith(".")


# --- routing ----------------------------------------------------------------

def route(path: Column, types: dict[str, str] | None = None) -> Column:
    """Loader type of a path by its extension; NULL when nothing reads it."""
    types = K.EXTENSION_TYPES if types is None else types
    pairs = [F.lit(x) for pair in types.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), extension(path))


def is_visual(path: Column) -> Column:
    return F.coalesce(route(path) == "image", F.lit(False))


# --- labels -----------------------------------------------------------------

def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once and named once in the plan.

    Rules that mention their input many times would otherwise multiply its expression whenever the
    optimizer substitutes it (a filter pushed through a projection does).
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def is_label_noisy(label: Column) -> Column:
    """True for identifiers, codes, numbers, stop words and too short or missing names."""
    def noisy(v: Column) -> Column:
        digits = F.regexp_count(v, F.lit(r"\d"))
        # CASE, not OR: its order is guaranteed, so the division never sees an empty text
        return (
            F.when(F.length(v) < K.LABEL_MIN_LENGTH, True)
            .when(v.rlike(r"^(\d+\.?\d*|\.\d+)$"), True)
            .when(~F.contains(v, F.lit(" ")) & (digits > 0), True)
            .when(digits / F.length(v) > K.LABEL_MAX_DIGIT_SHARE, True)
            .otherwise(F.lower(v).isin(K.LABEL_STOP_WORDS))
        )

    return once(strip(F.coalesce(label.cast("string"), F.lit(""))), noisy)


def has_any_word(c: Column, words: Iterable[str]) -> Column:
    lowered = F.lower(c)
    found = F.lit(False)
    for word in words:
        found = found | F.contains(lowered, F.lit(word))
    return found


def mapping_key(line: Column) -> Column:
    """Left side of the first '=' or ':' of a line; NULL for lines without one."""
    return F.when(
        line.rlike("[=:]"), F.lower(strip(F.regexp_extract(line, r"(?s)^([^=:]*)[=:](.*)$", 1)))
    )


def mapping_value(line: Column) -> Column:
    return F.when(
        line.rlike("[=:]"), F.lower(strip(F.regexp_extract(line, r"(?s)^([^=:]*)[=:](.*)$", 2)))
    )


def most_frequent_word(text: Column, min_length: int = K.LABEL_MIN_LENGTH) -> Column:
    """``auto_<word>`` for the commonest word; the first seen wins a tie; NULL without words.

    Words are sorted with their positions inside the row and counted as runs, so a document of any
    length costs one sort and no shuffle.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"(?U)\w{{{min_length},}}"), F.lit(0))
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    start = F.struct(
        F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("i"),
        F.lit(None).cast("string").alias("best"), F.lit(0).alias("best_n"),
        F.lit(0).alias("best_i"))

    def count(acc, x):
        same = acc["w"] == x["w"]
        return F.struct(
            x["w"].alias("w"), F.when(same, acc["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.when(same, acc["i"]).otherwise(x["i"]).alias("i"),
            acc["best"].alias("best"), acc["best_n"].alias("best_n"),
            acc["best_i"].alias("best_i"))

    def keep_best(acc):
        better = (acc["n"] > acc["best_n"]) | (
            (acc["n"] == acc["best_n"]) & (acc["i"] < acc["best_i"]))
        promoted = F.struct(
            acc["w"].alias("w"), acc["n"].alias("n"), acc["i"].alias("i"),
            acc["w"].alias("best"), acc["n"].alias("best_n"), acc["i"].alias("best_i"))
        return F.when(better, promoted).otherwise(acc)

    best = F.aggregate(
        placed, start,
        lambda acc, x: once(count(acc, x), keep_best),
        lambda acc: acc["best"])
    return F.concat(F.lit("auto_"), best)


def grams(text: Column, n: int) -> Column:
    """Every substring of length ``n``, in order; empty for shorter texts."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(
        F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))
    ).otherwise(F.array().cast("array<string>"))


# --- JSON -------------------------------------------------------------------

def schema_text(record_json: Column) -> Column:
    """Keys of a JSON object as words."""
    return F.translate(F.array_join(F.json_object_keys(record_json), " "), "_", " ")


def one_json_value(text: Column) -> Column:
    """The text if it is exactly one JSON value, else NULL.

    Spark's JSON functions stop after the first value; inside brackets anything that follows makes
    the array invalid or longer than one.
    """
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    return F.when(F.json_array_length(wrapped) == 1, text)


def json_salvage(raw: Column, schema: DataType | str) -> Column:
    """Struct parsed from the first '{' to the last '}' of a free text; NULL on failure."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.from_json(one_json_value(body), schema)


def decode_extra(extra: Column) -> Column:
    """JSON text as a string map; an empty map when it cannot be read."""
    # FAILFAST is not wanted: one bad row must not stop the scan
    parsed = F.from_json(extra, "map<string,string>")
    return F.coalesce(parsed, F.from_json(F.lit("{}"), "map<string,string>"))


# --- display ----------------------------------------------------------------

def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def pastel_color(name: Column) -> Column:
    """Stable ``rgb(r, g, b)`` from the first three md5 bytes, each moved to 150..254."""
    digest = F.md5(name.cast("binary"))

    def channel(start: int) -> Column:
        byte = F.conv(F.substring(digest, start, 2), 16, 10).cast("int")
        return (byte % 105 + 150).cast("string")

    return F.concat(
        F.lit("rgb("), channel(1), F.lit(", "), channel(3), F.lit(", "), channel(5), F.lit(")")
    )
