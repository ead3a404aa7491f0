"""Text expressions: normalisation, tokens, numbers and similarities as Spark columns.

All of them stay inside whole-stage code, except ``sequence_ratio``, which Spark can't express.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Every code point that counts as white space for Unicode-aware patterns.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"

# Characters removed from numbers, dashes read as minus, words that mark numeric columns.
NUMBER_NOISE = ",，￥¥元"
NUMBER_DASHES = "−—－"
NUMERIC_KEYWORDS = ("金额", "单价", "数量", "合价", "总价", "小计", "合计", "价款", "amount", "price", "qty", "quantity", "total", "subtotal")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_space(text: Column | str) -> Column:
    """White-space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(_col(text), SPACE, " "))


def strip(text: Column | str) -> Column:
    """White space of any kind goes from both ends."""
    return F.regexp_replace(_col(text), f"^{SPACE}|{SPACE}$", "")


def normalize_cell(value: Column | str) -> Column:
    """Text of a table cell: null is '', white space is collapsed."""
    return collapse_space(F.coalesce(_col(value).cast("string"), F.lit("")))


def compact(value: Column | str) -> Column:
    """Cell text without any white space."""
    return F.regexp_replace(F.coalesce(_col(value).cast("string"), F.lit("")), SPACE, "")


def normalize_number(value: Column | str) -> Column:
    """DECIMAL(38,10) of a cell, or null: thousands separators, currency signs and the unit go,
    dashes are minus, (x) is -x. NaN and infinities count as unreadable."""
    text = F.translate(normalize_cell(value), NUMBER_DASHES + NUMBER_NOISE, "-" * len(NUMBER_DASHES))
    text = F.regexp_replace(F.trim(text), r"^\((.*)\)$", "-$1")
    return text.try_cast("decimal(38,10)")


def normalize_number_or_text(value: Column | str) -> Column:
    """The number as plain text, or the normalised text where it is none."""
    number = normalize_number(value)
    return F.coalesce(F.regexp_replace(number.cast("string"), r"\.?0+$", ""), normalize_cell(value))


def is_numeric_column(name: str, numeric_columns=None) -> bool:
    """By the caller's list if there is one, else by marker words. Decided when a plan is built."""
    name = name.strip().lower()
    if numeric_columns is not None:
        return name in {str(c).strip().lower() for c in numeric_columns}
    return any(word in name for word in NUMERIC_KEYWORDS)


def tokens(text: Column | str) -> Column:
    """Distinct lower-cased words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))


def signature(text: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def jaccard(left: Column | str, right: Column | str) -> Column:
    """Of two arrays of distinct values; two empty ones are equal."""
    left, right = _col(left), _col(right)
    both = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def edit_similarity(left: Column | str, right: Column | str) -> Column:
    """1 - Levenshtein distance / longer length; both empty 1, one empty 0."""
    left, right = _col(left), _col(right)
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest == 0, 1.0).when((left == "") | (right == ""), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(left, right) / longest))


def count_similarity(a: Column | str, b: Column | str) -> Column:
    """1 - |a - b| / max(a, b); two zeros are equal."""
    a, b = _col(a), _col(b)
    return F.when((a == 0) & (b == 0), 1.0).when(F.greatest(a, b) == 0, 0.0).otherwise(1 - F.abs(a - b) / F.greatest(a, b))


def ratio_similarity(a: Column | str, b: Column | str) -> Column:
    """min / max(…, 1); two zeros are equal."""
    a, b = _col(a), _col(b)
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.least(a, b) / F.greatest(a, b, F.lit(1)))


def preview(text: Column | str, size: int = 120) -> Column:
    return F.substring(_col(text), 1, size)


def ratio(left: str, right: str) -> float:
    """Gestalt pattern matching of two strings, argument order as given (it isn't symmetric)."""
    if not left and not right:
        return 1.0
    if not left or not right:
        return 0.0
    return 1.0 if left == right else 2.0 * _matched(left, right) / (len(left) + len(right))


def _agreeing(a: str, i: int, b: str, j: int, most: int) -> int:
    """How far a from i and b from j agree, at most so far: slices that double, then halve."""
    n, m = 0, 16
    while n < most:
        m = min(m, most - n)
        if a[i + n : i + n + m] != b[j + n : j + n + m]:
            break
        n, m = n + m, 2 * m
    else:
        return n
    while m > 1:  # they differ within the next m
        half = m // 2
        if a[i + n : i + n + half] == b[j + n : j + n + half]:
            n, m = n + half, m - half
        else:
            m = half
    return n


def _longest(places: list[int], lists: list[list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest run of characters that start blocks: its places in a and b, and its size. Of equal
    ones the first in a, then in b."""
    at_a, at_b, size, before, last = alo, blo, 0, {}, -2
    for p in range(bisect_left(places, alo), bisect_left(places, ahi)):
        i, js = places[p], lists[p]
        if i != last + 1:
            before = {}
        last, here = i, {}
        for j in js if js[0] >= blo else js[bisect_left(js, blo) :]:
            if j >= bhi:
                break
            k = here[j] = before.get(j - 1, 0) + 1
            if k > size:
                at_a, at_b, size = i - k + 1, j - k + 1, k
        before = here
    return at_a, at_b, size


#: Runs from this size up are kept as arrays; parts that hold none are small.
_RUN = 2


def _runs(a_places: dict[str, list[int]], starts: dict[str, list[int]], n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every longest run along a diagonal of _RUN or more equal characters that start blocks: places
    and sizes."""
    keys = []
    for c, at in a_places.items():
        i, j = np.array(at, np.int64)[:, None], np.array(starts[c], np.int64)[None, :]
        keys.append(((i - j + n_b) * (n_a + 1) + i).ravel())
    key = np.concatenate(keys)
    keys.clear()
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1] + 1]))
    size = np.diff(np.append(first, len(key)))
    key, size = key[first[size >= _RUN]], size[size >= _RUN]
    i = key % (n_a + 1)
    return i, i - (key // (n_a + 1) - n_b), size


def _matched(a: str, b: str, few: int = 3000, many: int = 2_000_000) -> int:
    """Characters in the matching blocks that difflib.SequenceMatcher(None, a, b) finds, popular
    characters of long strings ignored as there. Runs of characters that start blocks are searched
    for anew in each part where they are few, and kept as arrays where they are many; blocks grow by
    slices."""
    popular = len(b) // 100 + 1 if len(b) >= 200 else len(b)
    starts: dict[str, list[int]] = {c: [] for c, n in Counter(b).items() if n <= popular}
    for j, c in enumerate(b):
        if c in starts:
            starts[c].append(j)
    places = [i for i, c in enumerate(a) if c in starts]
    cells = sum(len(starts[a[i]]) for i in places)
    lists, runs = [starts[a[i]] for i in places], None
    if few < cells <= many:
        a_places: dict[str, list[int]] = {}
        for i in places:
            a_places.setdefault(a[i], []).append(i)
        runs = _runs(a_places, starts, len(a), len(b))
    back_a, back_b, total = a[::-1], b[::-1], 0
    todo = [(0, len(a), 0, len(b), runs)]
    while todo:
        alo, ahi, blo, bhi, runs = todo.pop()
        size = 0
        if runs is not None:
            i, j, n = runs
            cut = np.maximum(np.maximum(alo - i, blo - j), 0)
            i, j, n = i + cut, j + cut, np.minimum(np.minimum(ahi - i, bhi - j), n) - cut
            inside = n >= _RUN
            runs = i, j, n = i[inside], j[inside], n[inside]
            if len(n):
                size = int(n.max())
                best = np.flatnonzero(n == size)
                at = best[np.lexsort((j[best], i[best]))[0]]
                at_a, at_b = int(i[at]), int(j[at])
            else:
                runs = None
        if not size:
            at_a, at_b, size = _longest(places, lists, alo, ahi, blo, bhi)
        more = _agreeing(back_a, len(a) - at_a, back_b, len(b) - at_b, min(at_a - alo, at_b - blo))
        at_a, at_b, size = at_a - more, at_b - more, size + more
        size += _agreeing(a, at_a + size, b, at_b + size, min(ahi - at_a, bhi - at_b) - size)
        if size:
            total += size
            if alo < at_a and blo < at_b:
                todo.append((alo, at_a, blo, at_b, runs))
            if at_a + size < ahi and at_b + size < bhi:
                todo.append((at_a + size, ahi, at_b + size, bhi, runs))
    return total


def _ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([ratio(a or "", b or "") for a, b in zip(left, right, strict=True)], dtype="float64")


def sequence_ratio(left: Column | str, right: Column | str) -> Column:
    """ratio() as a column, worked out once for each row even where a filter follows; put cheap
    filters before it."""
    return F.pandas_udf(_ratios, DoubleType()).asNondeterministic()(_col(left), _col(right))
