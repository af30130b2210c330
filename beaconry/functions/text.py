"""Text expressions: white space, word boundaries, keys and ids."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out because Java's \s covers ASCII only
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike("[^" + SPACE[1:])


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def dedup_key(text: Column) -> Column:
    """First 16 hex digits of the hash of the lower-cased text with white space collapsed."""
    return F.substring(F.sha2(F.regexp_replace(strip(F.lower(text)), f"{SPACE}+", " "), 256), 1, 16)


def whole_word(term: str) -> str:
    """Java pattern for a term with word boundaries; beside a sign, the boundary asks for a word character outside."""
    sides = [("(?<!{0})", "(?<={0})"), ("(?!{0})", "(?={0})")]
    left, right = (pair[not (c.isalnum() or c == "_")].format(WORD) for pair, c in zip(sides, (term[0], term[-1])))
    return left + "".join(re.escape(c) if c.isascii() and not c.isalnum() and c != "_" else c for c in term) + right


def sql_string(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def has_term(lowered: str, term: str) -> str:
    """SQL of a whole-word test; the cheap substring test stands in front of the pattern."""
    return f"({lowered} IS NOT NULL AND contains({lowered}, {sql_string(term)}) AND {lowered} RLIKE {sql_string(whole_word(term))})" if term else "false"


def severity(score: Column, thresholds) -> Column:
    t = thresholds
    return F.when(score >= t.p0_threshold, "P0").when(score >= t.p1_threshold, "P1").when(score >= t.p2_threshold, "P2").when(score >= t.p3_threshold, "P3").otherwise("P4")


def moment(timestamp: Column, now: Column | None = None) -> Column:
    """A UTC time; unset times (zero or less, NaN, null) give `now`."""
    return F.when((timestamp > 0) & ~F.isnan(timestamp), F.timestamp_seconds(timestamp)).otherwise(F.current_timestamp() if now is None else now)


def signal_id(key: Column, at: Column) -> Column:
    return F.concat(F.lit("SIG-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), F.upper(F.substring(key, 1, 6)))


def iso_time(at: Column) -> Column:
    """Seconds, and microseconds where there are any, with the offset of UTC."""
    micros = F.unix_micros(at) % 1_000_000
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))
