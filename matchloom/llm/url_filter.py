"""URL filters by a bit-parallel wildcard automaton.

All glob rules are laid end to end in one multiword bit vector. Reading one
byte of a URL moves every rule at once (Shift-And): shift, mask with the bytes
each position accepts, and keep the positions that a wildcard lets wait.
URLs are stepped together, one column of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``label`` is ``host/path``; it fits the host and its subdomains where the
    URL's path starts with the rule's path."""

    verdict: str
    label: str

    @property
    def glob(self) -> str:
        host, slash, path = self.label.partition("/")
        quoted = "".join("\\" + c if c in "*?\\" else c for c in f".{host}{slash}{path}")
        return f"*{quoted}**"


class GlobAutomaton:
    """Shift-And masks for glob patterns over bytes.

    ``*`` is any run without ``/``, ``**`` any run, ``?`` one byte, ``\\`` takes
    the next character literally. Patterns match whole strings.
    """

    def __init__(self, patterns: Sequence[str]):
        accepts: list[np.ndarray] = []
        hold_any: list[bool] = []
        hold_part: list[bool] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        for pattern in patterns:
            self.starts.append(len(accepts))
            accepts.append(np.zeros(256, bool))  # the state before any byte
            hold_any.append(False)
            hold_part.append(False)
            data, i = pattern.encode(), 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    hold_any[-1], i = True, i + 2
                elif data[i : i + 1] == b"*":
                    hold_part[-1], i = True, i + 1
                else:
                    ok = np.zeros(256, bool)
                    if data[i : i + 1] == b"?":
                        ok[:] = True
                    else:
                        i += data[i : i + 1] == b"\\" and i + 1 < len(data)
                        ok[data[i]] = True
                    accepts.append(ok)
                    hold_any.append(False)
                    hold_part.append(False)
                    i += 1
            self.ends.append(len(accepts) - 1)
        self.words = max(1, -(-len(accepts) // 64))
        self.by_byte = np.stack([self._pack(np.array([a[b] for a in accepts], bool)) for b in range(256)])
        any_, part = self._pack(np.array(hold_any, bool)), self._pack(np.array(hold_part, bool))
        self.hold = np.tile(any_ | part, (256, 1))
        self.hold[ord("/")] = any_
        first = np.zeros(len(accepts), bool)
        first[self.starts] = True
        self.first = self._pack(first)

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in np.flatnonzero(bits):
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Booleans, texts x patterns."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        at = (np.cumsum(sizes) - sizes)[order]
        lengths = sizes[order]
        state = np.tile(self.first, (len(texts), 1))
        longest = int(lengths[0]) if len(texts) else 0
        reach = np.searchsorted(-lengths, -np.arange(longest), side="left")  # URLs longer than each column
        for column in range(longest):
            live = int(reach[column])
            byte = flat[at[:live] + column]
            now = state[:live]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.by_byte[byte]) | (now & self.hold[byte])
        found = np.empty((len(texts), len(self.ends)), bool)
        for p, end in enumerate(self.ends):
            found[order, p] = (state[:, end // 64] >> np.uint64(end % 64)) & np.uint64(1) != 0
        return found


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(df: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: the id, ``host``, ``path``, ``rule``, ``verdict``.

    The longest matching rule wins, the first of equally long ones; without a
    match ``rule`` is null and ``verdict`` is ``default``. Null URLs have empty
    parts and match nothing. Other columns are not carried, so their names do
    not matter; repeated rows and null ids are kept; an empty table gives none.
    """
    ranked = sorted(rules, key=lambda r: -len(r.label))  # stable: the first of equals stays first

    automaton = GlobAutomaton([r.glob for r in ranked])

    @F.pandas_udf("int")
    def winner(canonical: pd.Series) -> pd.Series:
        found = automaton.matches([x.encode("utf-8", "surrogatepass") for x in canonical])
        hit = found.any(axis=1)
        return pd.Series(np.where(hit, found.argmax(axis=1) + 1, 0).astype("int32"))

    host, path = url_parts(F.col(url_col))
    parts = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not ranked:
        return parts.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    won = parts.withColumn("_won", winner(F.concat(F.lit("."), "host", "path")))
    pick = lambda values, otherwise: F.when(F.col("_won") > 0, F.element_at(F.array(*map(F.lit, values)), F.greatest("_won", F.lit(1)))).otherwise(otherwise)
    return won.select(id_col, "host", "path", pick([r.label for r in ranked], F.lit(None)).alias("rule"), pick([r.verdict for r in ranked], F.lit(default)).alias("verdict"))


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE_SQL = """
WITH r(verdict, rule, rhost, rpath) AS (VALUES
  ('allow','org/','org','/'), ('block','example.org/es/','example.org','/es/'),
  ('block','example.org/en/1','example.org','/en/1'), ('allow','com/fr/','com','/fr/'), ('block','com/de/','com','/de/')),
p AS (SELECT page_id, CASE WHEN strpos(url,'://')>0 THEN substr(url, strpos(url,'://')+3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest,'^([^/?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest,'^[^/?#]*([^?#]*)',1) AS path FROM p)
SELECT page_id, host, path,
  (SELECT rule FROM r WHERE (q.host = rhost OR ends_with(q.host, '.' || rhost)) AND starts_with(q.path, rpath) ORDER BY length(rule) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (q.host = rhost OR ends_with(q.host, '.' || rhost)) AND starts_with(q.path, rpath) ORDER BY length(rule) DESC LIMIT 1), 'allow') AS verdict
FROM q
"""
