"""Scalar functions over strings as Column expressions; nulls stay null unless said otherwise."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.schema import COMPLETE, FIELD, PROBLEM_TYPE, RELATION_TYPES, SEP

_CJK = r"\x{4e00}-\x{9fa5}"
_LATIN = r"a-zA-Z0-9\(\)\[\]@#$%!&\*\-=+_"


def hashed_id(prefix: str, content: Column) -> Column:
    """Content-addressed id: prefix and md5, as in doc-, chunk-, ent- and rel- ids."""
    return F.concat(F.lit(prefix), F.md5(content))


def suffixed_id(name: Column, file_path: Column) -> Column:
    """name<6 hex digits>, stable for a name within a file."""
    return F.concat(name, F.lit("<"), F.substring(F.md5(F.concat(file_path, F.lit("\x1f"), name)), 1, 6), F.lit(">"))


def base_name(entity_id: Column) -> Column:
    """The id without its <suffix>."""
    return F.regexp_replace(entity_id, "<[^<]*>$", "")


def problem_id(entity_id: Column) -> Column:
    """The part before the first space, if it holds a Latin letter and a digit; else null. An id without a space has none."""
    head = F.substring_index(entity_id, " ", 1)
    return F.when(entity_id.contains(" ") & head.rlike("[A-Za-z]") & head.rlike("[0-9]"), head)


def platform(identifier: Column) -> Column:
    return F.when(identifier.rlike(r"(?i)^P\d+$"), "Luogu").when(identifier.rlike(r"(?i)^CF\d+[A-Z]?$"), "Codeforces").otherwise("未知题库")


def split_markers(text: Column, *markers: str) -> Column:
    """Parts between any of the markers, trimmed, without empty ones."""
    pattern = "|".join("\\Q" + m + "\\E" for m in markers)
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def comma_list(text: Column) -> Column:
    """Parts of a list whose commas may be full-width."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit("，"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")


def is_float(text: Column) -> Column:
    return text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$")


def summary(text: Column, limit: int = 250) -> Column:
    """Trimmed; beyond the limit its first characters and '...'."""
    t = F.trim(text)
    return F.when(F.char_length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t)


def pair_key(a: Column, b: Column) -> Column:
    """One key for both directions of a pair."""
    return F.concat_ws(SEP, F.least(a, b), F.greatest(a, b))


def parse_pair_key(key: Column) -> Column:
    """(src_id, tgt_id) of a pair's key; null unless it has two parts."""
    parts = F.split(key, "\\Q" + SEP + "\\E")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("src_id"), parts[1].alias("tgt_id")))


def cache_key(mode: Column, kind: Column, digest: Column) -> Column:
    return F.concat_ws(":", mode, kind, digest)


def parse_cache_key(key: Column) -> Column:
    """(mode, kind, digest); null unless there are three parts."""
    parts = F.split(key, ":", 3)
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("mode"), parts[1].alias("kind"), parts[2].alias("digest")))


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)^(<think>.*?</think>|.*</think>)", ""))


def fenced_json(text: Column) -> Column:
    """The JSON of a fenced block, or the whole text; null if neither parses."""
    block = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.coalesce(F.when(block != "", F.when(F.try_parse_json(block).isNotNull(), block)), F.when(F.try_parse_json(text).isNotNull(), text))


def clean_control(text: Column) -> Column:
    """Without control characters but tab and line ends, without lone surrogates, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{d800}-\x{dfff}\x{fffe}\x{ffff}]", ""))


def sanitized_fields(fields: Column) -> Column:
    """Each text of an array as clean_control() leaves it, HTML character references decoded, and control characters (those of
    Latin-1 too) that come out of them dropped."""

    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda a: None if a is None else [None if x is None else html.unescape(x) for x in a])

    decoded = F.pandas_udf(unescape, "array<string>")(F.transform(fields, clean_control))
    return F.transform(decoded, lambda x: F.regexp_replace(F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", ""), r"(?U)^\s+|\s+$", ""))


def sanitized(text: Column) -> Column:
    """One text as sanitized_fields() makes it."""
    return sanitized_fields(F.array(text))[0]


def decode_escapes(text: Column) -> Column:
    """\\uXXXX sequences as the characters that they stand for; halves of a pair that stand alone become U+FFFD."""
    run = r"(?:\\u[0-9a-fA-F]{4})+"
    between = F.split(text, run, -1)
    # a null beyond the last run closes the list, so that each part between has something that follows it
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(0)), lambda r: F.decode(F.unhex(F.replace(r, F.lit("\\u"), F.lit(""))), "UTF-16BE")), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, b)), "")


def local_time(epoch: Column) -> Column:
    """Seconds since 1970 in the session's time zone."""
    return F.from_unixtime(epoch, "yyyy-MM-dd HH:mm:ss")


def track_id(prefix: str = "upload") -> Column:
    """prefix, time and eight random digits; another for each row."""
    return F.concat_ws("_", F.lit(prefix), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"), F.substring(F.uuid(), 1, 8))


def name_order(name: Column) -> Column:
    """What names are sorted by: Chinese ones by their reading, case aside."""
    return F.collate(F.lower(name), "zh_CI")


def _unquote(text: Column, left: str, right: str) -> Column:
    """Without outer quotes, if there are none within."""
    return F.regexp_replace(text, f"(?s)^{left}([^{left}{right}]*){right}$", "$1")


def normalized_name(name: Column, inner_quotes: bool = False) -> Column:
    """Names as extraction stores them: markup breaks dropped, full-width letters halved, spaces next to CJK closed,
    outer quotes dropped, and short numbers emptied. inner_quotes also drops quotes within."""
    wide = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26)) + "".join(chr(0xFF10 + i) for i in range(10))
    half = "".join(chr(0x41 + i) for i in range(26)) + "".join(chr(0x61 + i) for i in range(26)) + "0123456789"
    s = F.regexp_replace(name, r"(?i)</?(?:p|br)\s*>|<(?:p|br)/>", "")
    s = F.translate(s, wide + "－＋／＊（）—　", half + "-+/*()- ")
    for before, after in ((_CJK, _CJK), (_CJK, _LATIN), (_LATIN, _CJK)):
        s = F.regexp_replace(s, rf"(?<=[{before}])\s+(?=[{after}])", "")
    for left, right in (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("《", "》")):
        s = _unquote(s, left, right)
    if inner_quotes:
        s = F.translate(s, "“”‘’", "")
        s = F.regexp_replace(s, rf"['\"]+(?=[{_CJK}])|(?<=[{_CJK}])['\"]+", "")
        s = F.regexp_replace(F.translate(s, " ", " "), r"(?<=[^\d])\x{202F}", " ")
    # as the element of an array the cleaned name is made once, not for each of its uses
    return F.transform(F.array(F.trim(s)), lambda t: F.when(t.rlike(r"^[0-9]{1,2}$") | (t.rlike(r"^[0-9.]{1,5}$") & t.contains(".")), "").otherwise(t))[0]


def _damaged_markers() -> str:
    """One pattern for a field marker whose sides or core are damaged. A marker is a left side (bracket, bar), a core and a
    right side (bar, bracket)."""
    bar, core = re.escape(FIELD[1]), re.escape(FIELD[2:-2])
    sides = {
        "right": (f"<{bar}", f"{bar}>"),
        "with a stray character": (f"<.?{bar}", f"{bar}.?>"),
        "with or without its bar": (f"<{bar}?", f"{bar}?>"),
        "with another character for its bar": (f"<[^{bar}]", f"[^{bar}]>"),
        "with too many bars": (f"<{bar}+", f"{bar}+>"),
        "of two bars": (bar * 2, bar * 2),
        "of a bar alone": (f"(?<!<){bar}", f"{bar}+(?!>)"),
        "of a colon": (":", ":(?!>)"),
        "of a bracket alone": ("<", ">"),
    }
    cores = {"right": core, "doubled": f"{core}{bar}*{core}", "escaped": rf"\\{core}"}
    found = (
        ("right", "doubled", "right"), ("right", "escaped", "right"), ("with a stray character", "right", "with a stray character"),
        ("with or without its bar", "right", "with or without its bar"), ("with another character for its bar", "right", "right"), ("right", "right", "with another character for its bar"),
        ("with too many bars", "right", "of a bracket alone"), ("right", "right", "of a bar alone"), ("right", "right", "of a colon"), ("of a bar alone", "right", "right"), ("of two bars", "right", "of two bars"),
    )
    whole = [sides[left][0] + cores[middle] + sides[right][1] for left, middle, right in found]
    without_core = [f"<{bar}+>", f"<{bar}{{2}}(?!{bar}*(?:>|{core}))"]
    # all begin with a bracket or a bar: one look tells most characters apart; a bar that follows a closed marker belongs to it
    return f"(?=[<{bar}])(?:{'|'.join(whole + without_core)})(?:(?<=>){bar})?"


DAMAGED = _damaged_markers()


def mend_delimiters(record: Column) -> Column:
    """record with every damaged field marker made whole, in one pass."""
    return F.regexp_replace(record, DAMAGED, FIELD)


def known_keywords(keywords: Column) -> Column:
    """The relation types of a keyword list, in order."""
    return F.filter(comma_list(keywords), lambda k: k.isin(*RELATION_TYPES))


def with_unknown_keywords(keywords: Column, description: Column) -> Column:
    """The description with a note for each keyword that isn't a relation type."""
    rest = F.filter(comma_list(keywords), lambda k: ~k.isin(*RELATION_TYPES))
    note = lambda k: F.concat(F.lit("[未识别关键词: "), k, F.lit("]"))
    return F.aggregate(rest, F.coalesce(description, F.lit("")), lambda s, k: F.when(s == "", note(k)).otherwise(F.concat(s, F.lit(" "), note(k))))


def needs_retyping(dim1: Column, dim2: Column, dim1_types: tuple[str, ...], dim2_types: tuple[str, ...]) -> Column:
    """Types that are missing, unknown or outside the vocabularies; dim1 counts as one string, dim2 as a list."""
    bad1 = F.coalesce(dim1, F.lit("")).isin("", "UNKNOWN") | ~dim1.isin(*dim1_types)
    bad2 = F.coalesce(dim2, F.lit("")).isin("", "UNKNOWN") | ~F.forall(F.split(dim2, ","), lambda x: F.trim(x).isin(*dim2_types))
    return bad1 | bad2


def is_problem_type(dim2: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(F.split(dim2, ","), lambda x: F.trim(x)), PROBLEM_TYPE), F.lit(False))


def without_complete(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit(COMPLETE), F.lit("")))
