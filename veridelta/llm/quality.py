r"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark the words inside n-grams found twice or more in the
same text; lines equal to an earlier line are marked likewise. What counts is the share of the
text's word characters that are marked. A document is kept if every share stays within its limit.

Words are ``[^\x20\x09-\x0D]+`` of the whole text, case kept. Null and empty texts have no words;
they fail the base rule (under ``min_words``). Nulls in doc_id stay null, repeated rows give
repeated results, other columns are not read, an empty table gives an empty table. N-grams are
compared by 64-bit hashes; two different ones of a text collide with a chance below 1e-9.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from veridelta.llm.common import WordHashes, kept, map_arrow, rolling

#: n-gram length in words -> greatest share of word characters inside repeated n-grams, and of
#: characters in repeated lines: the published limits of Rae et al. 2021 (arXiv 2112.11446, A1.1).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
_BLANK, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_share double, dup_ngram_share double"


def covered(h: np.ndarray, width: int) -> np.ndarray:
    """Mask of the entries of h that lie in a window found at two positions or more."""
    grams, mask = rolling(h, width), np.zeros(len(h) + 1, np.int32)
    if len(grams) < 2:
        return mask[:-1] > 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return mask[:-1] > 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    np.add.at(mask, at, 1)
    np.add.at(mask, at + width, -1)
    return np.cumsum(mask[:-1]) > 0


def measure(text: str | None, hashes: WordHashes, min_words: int, ngram_limits: dict[int, float], line_limit: float) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n, chars = len(words), len(text) - sum(map(text.count, _BLANK))
    seen, n_dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            if line in seen:
                n_dup += 1
                dup_chars += len(line) - sum(map(line.count, _BLANK))
            else:
                seen.add(line)
    h = hashes.of(words)
    base = covered(h, 5)
    repeated = int(base.sum())
    failed = n < min_words or 100 * repeated > 20 * n
    line_share, worst, kept = dup_chars / max(chars, 1), 0.0, not failed
    if repeated or min(ngram_limits, default=5) < 5:
        sizes = np.fromiter(map(len, words), np.int64, n)
        total = max(int(sizes.sum()), 1)
        for width, limit in ngram_limits.items():
            share = float(sizes[base if width == 5 else covered(h, width)].sum()) / total
            worst = max(worst, share)
            kept = kept and share <= limit
    return n, chars, sum(map(text.count, _SYMBOLS)), n_dup, repeated, failed, kept and line_share <= line_limit, line_share, worst


def assess(docs: DataFrame, min_words: int = 10, ngram_limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The counts, shares and verdict of each document (see SCHEMA)."""
    limits = dict(NGRAM_LIMITS if ngram_limits is None else ngram_limits)

    def run(batch):
        hashes = kept(__name__).setdefault("hashes", WordHashes())
        rows = [measure(x.as_py(), hashes, min_words, limits, line_limit) for x in batch.column("text")]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share", "dup_ngram_share")
        return {"doc_id": batch.column("doc_id"), **dict(zip(names, zip(*rows, strict=True), strict=True))}

    return map_arrow(docs.select("doc_id", "text"), SCHEMA, run)


def keep(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """The given columns of the documents that are kept; the verdict is taken in the same pass as
    the rows are read, without a shuffle."""
    schema = docs.select(*columns).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    limits = options.get("ngram_limits")
    limits = dict(NGRAM_LIMITS if limits is None else limits)
    least, lines = options.get("min_words", 10), options.get("line_limit", LINE_LIMIT)

    def run(batch):
        hashes = kept(__name__).setdefault("hashes", WordHashes())
        mask = [measure(x.as_py(), hashes, least, limits, lines)[6] for x in batch.column("text")]
        import pyarrow as pa

        left = batch.filter(pa.array(mask, pa.bool_()))
        return {name: left.column(name) for name in columns} if left.num_rows else None

    return map_arrow(docs.select(*columns), ddl, run)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
flat AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
sizes AS (SELECT r, sum(length(word))::BIGINT AS chars, sum(strlen(word))::BIGINT AS bytes FROM flat GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM w),
worded AS (SELECT r, line, pos, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS n FROM lines),
dup AS (SELECT r, count(*) AS n_dup, sum(n)::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY pos) AS k FROM worded WHERE n > 0) WHERE k > 1 GROUP BY r),
limits(n, most) AS (VALUES (5, 0.15::DOUBLE), (6, 0.14::DOUBLE), (7, 0.13::DOUBLE), (8, 0.12::DOUBLE), (9, 0.11::DOUBLE), (10, 0.10::DOUBLE)),
places AS (SELECT r, n, ws, unnest(range(len(ws) - n + 1)) AS p FROM w, limits),
windows AS (SELECT r, n, p, array_to_string(list_slice(ws, p + 1, p + n), ' ') AS g FROM places),
twice AS (SELECT r, n, p FROM (SELECT r, n, p, count(*) OVER (PARTITION BY r, n, g) AS c FROM windows) WHERE c > 1),
inside AS (SELECT DISTINCT r, n, i FROM (SELECT r, n, p + unnest(range(n)) AS i FROM twice)),
shares AS (SELECT r, n, count(*) AS words, sum(strlen(word))::BIGINT AS bytes FROM inside JOIN flat USING (r, i) GROUP BY r, n),
worst AS (SELECT s.r, max(CASE WHEN s.n = 5 THEN words ELSE 0 END)::BIGINT AS n_repeat, max(s.bytes::DOUBLE / sizes.bytes) AS share, bool_or(s.bytes::DOUBLE / sizes.bytes > most) AS beyond
          FROM shares s JOIN limits USING (n) JOIN sizes ON sizes.r = s.r GROUP BY s.r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(sizes.chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(dup.chars, 0)::DOUBLE / greatest(coalesce(sizes.chars, 0), 1) AS dup_line_share, coalesce(share, 0.0::DOUBLE) AS dup_ngram_share, coalesce(beyond, false) AS beyond
      FROM w LEFT JOIN sizes USING (r) LEFT JOIN dup USING (r) LEFT JOIN worst USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT beyond AND dup_line_share <= 0.20::DOUBLE AS kept, dup_line_share, dup_ngram_share
FROM m
"""
