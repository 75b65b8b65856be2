"""Column helpers on file names, logs and loose values. Null in, null out unless a fallback is named.

White space is all that Unicode counts as such; lengths are in code points. `$` would also match before a last line
feed, so patterns end with `\\z`.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cadenza.functions.scalar import clamp, half_up, let

# White space inside a class, signs that file names may not hold, names that a system reserves, and
# the words that mark a log line as important or a failure as worth a second try.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
UNSAFE = r'[\x00-\x1f<>:"/\\|?*]'
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])\z"
IMPORTANT = r"(?i)error|failed|invalid|aborted|out of bounds"
RECOVERABLE = r"(?i)memory access out of bounds|RuntimeError|Watchdog timeout|Failed to inject frame|Error initializing filter|terminated|aborted"
VERDICTS = ["ready", "adjust", "risky"]


def trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def _replaced(x: Column, *steps: tuple[str, str]) -> Column:
    for pattern, by in steps:
        x = F.regexp_replace(x, pattern, by)
    return x


def _last(found: Column) -> Column:
    return F.get(found, F.size(found) - 1)


@F.pandas_udf(StringType())
def _without_accents(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining accents; no built-in function decomposes."""
    bare = (None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not "\u0300" <= c <= "\u036f") for s in x)
    return pd.Series(bare, index=x.index, dtype=object)


def corpus_key(name: Column) -> Column:
    """The key that pairs a source file with its result: letters and digits of the bare stem."""
    base = F.regexp_extract(name, r"([^/]*)/*\z", 1)
    stem = F.when(base == "..", base).otherwise(F.regexp_replace(base, r"(?<=.)\.[^.]*\z", ""))
    lead, tail = rf"^(?:result|ori(?:ginal)?|source)[{SPACE}_-]+", rf"[{SPACE}_-]+mixready(?:[{SPACE}_-][^\n\r\u2028\u2029]*)?\z"
    return _replaced(F.lower(_without_accents(stem)), (lead, ""), (tail, ""), ("[^a-z0-9]+", ""))


def comparison_key(name: Column) -> Column:
    """The key that pairs a file before with the one after a render; the steps depend on their order."""
    stem = F.lower(F.regexp_replace(name, r"\.[^/.]+\z", ""))
    joined = _replaced(stem, (rf"[{SPACE}]+", "_"), (r"[^\w-]+", "_"), ("_+", "_"), (r"^_+|_+\z", ""))
    return _replaced(joined, (r"_blend_mixready\z", ""), (r"_mixready\z", ""), (r"_(?:blend_)?(?:a85|r128)\z", ""), ("^before_", ""), ("^after_", ""))


def guess_role(name: Column) -> Column:
    """after, before or unknown, by words in a file name."""
    x = F.lower(name)
    part = lambda words: x.rlike(rf"(^|[_{SPACE}-])({words})([_{SPACE}-]|\z)")
    role = F.when(part("after|optimized|processed"), "after").when(part("before|original|raw"), "before")
    return role.when(x.rlike(r"(a85|r128|_mixready)\.wav\z"), "after").when(x.isNotNull(), "unknown")


def is_result_path(path: Column) -> Column:
    """Whether a folder on the path is one of results, or the file's name starts as a result's."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), F.lower)
    base = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    return F.arrays_overlap(folders, F.array(F.lit("result"), F.lit("the result"))) | base.rlike(rf"(?i)^result[{SPACE}_-]+")


def short_base(name: Column) -> Column:
    """The stem with all but letters, digits, - and _ as one _ each."""
    return _replaced(name, (r"\.[^/.]+\z", ""), ("[^a-zA-Z0-9_-]+", "_"))


def _cleaned(x: Column) -> Column:
    return _replaced(x, (UNSAFE, "_"), (r"[ .]+\z", ""))


def _not_reserved(x: Column) -> Column:
    return F.when(x.rlike(RESERVED), F.concat(x, F.lit("_file"))).otherwise(x)


def _numbered(x: Column, index: Column) -> Column:
    return F.when(x == "", F.concat(F.lit("input_"), (index + 1).cast("string"))).otherwise(x)


def safe_base(name: Column, index: Column) -> Column:
    """The last part of a path without its suffix, safe as a file's name; input_<index + 1> if nothing is left."""
    last = F.regexp_extract(name, r"([^/\\]*)\z", 1)
    return _numbered(_not_reserved(_cleaned(F.regexp_replace(last, r"\.[^.]*\z", ""))), index)


def safe_download_name(name: Column, fallback: Column) -> Column:
    safe = _cleaned(trim(F.regexp_extract(name, r"([^/\\]*)\z", 1)))
    return F.when(safe == "", fallback).otherwise(safe)


def safe_upload_name(name: Column, index: Column) -> Column:
    """A safe name with its suffix in lower case; null for one with folders, `..` or outer white space.

    A name without suffix gets .wav in place of its last four characters.
    """
    bad = name.rlike(r"[/\\]|\.\.") | (trim(name) != name)
    suffix = F.regexp_extract(name, r"(\.[^.]+)\z", 1)
    suffix = F.when(suffix == "", ".wav").otherwise(suffix)
    end = F.length(name) - F.length(suffix)
    end = F.when(end < 0, F.greatest(F.length(name) + end, F.lit(0))).otherwise(end)
    base = _not_reserved(_numbered(_cleaned(F.substring(name, F.lit(1), end)), index))
    return F.when(~bad, F.concat(base, F.lower(suffix)))


def last_object(log: Column) -> Column:
    """The last {...} of a log as a map of strings; null if there is none or it is no JSON."""
    return F.from_json(_last(F.regexp_extract_all(log, F.lit(r"(\{[^}]*\})"), 1)), "map<string,string>")


def last_rms_db(log: Column) -> Column:
    """The last RMS level of a log; -120 where it is infinite."""
    raw = F.lower(_last(F.regexp_extract_all(log, F.lit(rf"(?i)RMS level dB:[{SPACE}]*(-?(?:[0-9]+(?:\.[0-9]+)?|inf))"), 1)))
    return F.when(raw.isin("inf", "-inf"), -120.0).otherwise(raw.try_cast("double"))


def duration_seconds(log: Column) -> Column:
    """Seconds of the first `Duration: HH:MM:SS.ss` of a log."""
    at = lambda k: F.regexp_extract(log, rf"(?i)Duration:[{SPACE}]*([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}}(?:\.[0-9]+)?)", k).try_cast("double")
    return at(1) * 3600 + at(2) * 60 + at(3)


def failure_summary(log: Column) -> Column:
    """The last three lines that name a failure (of all lines, if none does), joined."""
    lines = F.filter(F.transform(F.split(log, "\r?\n"), trim), lambda x: x != "")
    named = F.filter(lines, lambda x: x.rlike(IMPORTANT))
    chosen = F.when(F.size(named) > 0, named).otherwise(lines)
    return F.array_join(F.slice(chosen, F.greatest(F.size(chosen) - 2, F.lit(1)), F.lit(3)), " | ")


def is_recoverable(message: Column) -> Column:
    return F.coalesce(message.rlike(RECOVERABLE), F.lit(False))


def clean_text(value: Column, fallback: str = "", most: int = 280) -> Column:
    """One line without control characters, cut to `most` characters; the fallback for null and for nothing left."""
    line = F.substring(trim(_replaced(value, (r"[\x00-\x1f\x7f]", " "), (rf"[{SPACE}]+", " "))), 1, most)
    return let(line, lambda x: F.when(x != "", x).otherwise(F.lit(fallback)))


def loose_number(value: Column) -> Column:
    """The number that a text writes, to three decimals with halves up; an empty text is 0, what is no number null."""
    def number(x: Column) -> Column:
        in_base = lambda base: F.conv(F.substr(x, F.lit(3)), base, 10).cast("double")
        out = F.when(x == "", 0.0).when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), x.try_cast("double"))
        for sign, digits, base in (("x", "0-9a-f", 16), ("o", "0-7", 8), ("b", "01", 2)):
            out = out.when(x.rlike(rf"(?i)^0{sign}[{digits}]+\z"), in_base(base))
        return out

    return let(let(trim(value), number), lambda n: F.when(F.abs(n) < float("inf"), F.floor(n * 1000 + 0.5) / 1000))


def pair_spec(spec: Column) -> Column:
    """source|result|id as a struct; null unless there are three fields and the id is well formed."""
    fields = F.transform(F.split(spec, r"\|"), trim)
    good = (F.length(spec) <= 4096) & (F.size(fields) == 3) & ~F.exists(fields, lambda x: x == "")
    good = good & F.get(fields, F.lit(2)).rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}\z")
    names = ("source_path", "result_path", "id")
    return F.when(good, F.struct(*(F.get(fields, F.lit(k)).alias(n) for k, n in enumerate(names))))


def worst_verdict(verdict: Column) -> Column:
    """Aggregate: the worst of the verdicts; ready if there are none."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)
    return F.coalesce(F.max_by(verdict, F.when(rank > 0, rank)), F.lit(VERDICTS[0]))


def odd_integer(x: Column, low: int, high: int) -> Column:
    """x within [low, high], rounded with halves up and moved to an odd number: up, or down at the upper bound."""
    n = half_up(clamp(x, low, high))
    return F.when(n % 2 != 0, n).when(n >= high, n - 1).otherwise(n + 1)
