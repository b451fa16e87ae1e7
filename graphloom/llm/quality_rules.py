"""Quality rules as a bitmask ledger.

ledger() measures every text once and evaluates every rule once: a row has the measurements and one bigint in
which bit k is set if rule k failed. Policies are versioned sets of rules; apply_policy() and ablations() need the
bits only, so that a new policy or an ablation never reads a text again.

Words are `[^\\x20\\x09-\\x0D]+`, in whole texts. A null, empty or wordless text measures 0 everywhere and fails
min_words. Ties and repeated rows are measured each by themselves; extra columns are kept by ledger(), but for those
with the name of one of its columns, which are replaced. An empty table gives an empty ledger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.scan import scan_text
from graphloom.llm.textkit import byte_blocks, covered, find_words, is_nonspace, per_row, repeats, row_grams, span_hashes

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")

#: Rules by bit: a rule fails where its SQL condition over the measurements holds.
RULES: dict[str, str] = {
    "min_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "capitals": "100 * n_upper > 40 * word_chars",
    "marks": "2 * n_marks > n_words",
    "long_words": "word_chars > 14 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BASE = ("min_words", "repeated_words")
#: Policies by version; all hold the base rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": (*BASE, "symbols", "duplicate_lines", "capitals", "marks", "long_words", "short_words"),
    "base": BASE,
}


def measure(texts: pa.Array) -> list:
    """The MEASURES of each text."""
    made: list[list[np.ndarray]] = [[] for _ in MEASURES]
    for _, raw, off in byte_blocks(texts):
        words = find_words(is_nonspace(raw), off)
        rows = words.rows
        hashes = span_hashes(raw, words.starts, words.ends)
        starts, grams = row_grams(hashes, words.first, 3)
        _, twice = repeats(rows[starts], grams)
        in_repeat = covered(len(hashes), starts[twice], 3)
        breaks = find_words(raw != 10, off)  # lines without a character have no word
        holds = np.searchsorted(words.starts, breaks.ends) > np.searchsorted(words.starts, breaks.starts)
        again, _ = repeats(breaks.rows[holds], span_hashes(raw, breaks.starts[holds], breaks.ends[holds]))
        is_again = np.zeros(len(holds), bool)
        is_again[np.flatnonzero(holds)[again]] = True
        points = is_nonspace(raw) & ((raw & 0xC0) != 0x80)
        upper, marks = (raw >= 65) & (raw <= 90), raw == 33
        for out, v in zip(made, (np.diff(words.first), per_row(off, points), per_row(off, _SYMBOLS[raw]), per_row(breaks.first, is_again), per_row(words.first, in_repeat), per_row(breaks.first, holds), per_row(off, upper), per_row(off, marks)), strict=True):
            out.append(v)
    return [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in made]


def mask_of(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in set(rules))


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs, the measurements, and failed: bit k is set if rule k of RULES failed."""
    seen = scan_text(docs, text, ", ".join(f"{m} bigint" for m in MEASURES), measure, [c for c in (keep or docs.columns) if c.lower() != "failed"])
    bits = F.lit(0).cast("bigint")
    for k, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return seen.withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """rows of a ledger with base_failed and kept: no rule of the policy failed."""
    bits = lambda rules: F.col("failed").bitwiseAND(F.lit(mask_of(rules)).cast("bigint")) != 0
    return rows.withColumns({"base_failed": bits(BASE), "kept": ~bits((*BASE, *POLICIES[policy]))})


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else (what the policy would regain without
    it), all documents, and those that any rule rejects. One aggregation over distinct bit patterns."""
    mask = mask_of((*BASE, *POLICIES[policy]))
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(k, name) for k, name in enumerate(RULES) if mask >> k & 1]
    table = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("bigint").alias("bit")) for k, name in rules])
    each = patterns.select("bits", "n", F.explode(table).alias("r")).select("bits", "n", "r.rule", "r.bit")
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_only_this"),
        count(F.col("bits") != 0).alias("n_rejected"),
        F.sum("n").alias("n_all"),
    )
