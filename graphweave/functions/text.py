"""Text, token and identity functions as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


# Words that carry no content in names.
STOPWORDS = """
a an and are as at be but by for from had has have he her his how i if in into is it its may my no nor not of on or our
out own per she so than that the their them then there these they this to too up us was we were what when which who why
will with would you your
""".split()
# Text that no rationale may hold, graph mutations and executable snippets.
MUTATION = r"(?i)\b(?:MATCH\s*\(|CREATE\s*\(|MERGE\s*\(|DETACH\s+DELETE\b|SET\s+\w+\.\w+|REMOVE\s+\w+\.\w+|FOREACH\s*\()"
EXECUTABLE = r"(?i)(?:```|\bexec\s*\(|\beval\s*\(|\b__import__\s*\(|\bsubprocess\.\w+|\bos\.system\s*\()"
# The names that types and properties may have.
IDENTIFIER, PROPERTY_NAME = r"^[A-Za-z][A-Za-z0-9_]*$", r"^[A-Za-z_][A-Za-z0-9_]*$"


#: White space of any kind: that of ASCII with the four separators, and that beyond.
BLANKS = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(s: Column) -> Column:
    """Without white space of any kind at both ends; only the ends are looked at."""
    return F.btrim(s, F.lit(BLANKS))


def primary_value(s: Column) -> Column:
    """Lower-cased and stripped; an absent value is empty."""
    return strip(F.lower(F.coalesce(s, F.lit(""))))


def sanitize(s: Column) -> Column:
    """Separators of any script become spaces; runs of white space become one, and none stays at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(s, r"\p{Z}", " "), r"(?U)\s+", " "))


def guard(*texts: Column) -> Column:
    """The first kind of forbidden content in the texts, or null."""
    kinds = [F.when(F.rlike(t, F.lit(MUTATION)), "mutation").when(F.rlike(t, F.lit(EXECUTABLE)), "executable") for t in texts]
    return F.coalesce(*kinds)


def tokens(s: Column) -> Column:
    """Distinct lower-case runs of a-z and 0-9."""
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0)))


def token_overlap(a: Column, b: Column) -> Column:
    """Dice coefficient of two token sets; 0 when both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def jaccard(a: Column, b: Column) -> Column:
    """0 when both are empty."""
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / total)


def content_tokens(s: Column) -> Column:
    """Tokens of two characters at least that are no stopwords."""
    return F.filter(F.array_except(tokens(s), F.array(*map(F.lit, STOPWORDS))), lambda t: F.length(t) > 1)


def contained(a: Column, b: Column, x: Column, y: Column, least: int = 2, length: int = 3) -> Column:
    """Whether the smaller of the content token sets x and y, of the values a and b, lies in the larger: it has at
    least `least` tokens, its value at least `length` characters, and the sizes differ."""
    small = F.least(F.size(x), F.size(y))
    shorter = F.when(F.size(x) < F.size(y), a).otherwise(b)
    return (F.size(x) != F.size(y)) & (small >= least) & (F.char_length(strip(shorter)) >= length) & (F.size(F.array_intersect(x, y)) == small)


def token_containment(a: Column, b: Column, least: int = 2, length: int = 3) -> Column:
    """contained() of two values."""
    return contained(a, b, content_tokens(a), content_tokens(b), least, length)


def candidate_id(kind: str, refs: Column, method: str) -> Column:
    """SHA-256 of the canonical JSON of a finding: keys in order, references sorted."""
    return F.sha2(F.to_json(F.struct(
        F.lit(kind).alias("candidate_type"), F.lit(method).alias("detection_method"),
        F.array_sort(refs).alias("involved_element_refs"), F.col("run_id"), F.col("schema_version"),
    )), 256)


def nul_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256)


def jaro_winkler_of(a: str, b: str) -> float:
    """Of one pair: Jaro similarity, raised by a tenth of what is missing per common leading character, up to four; half
    transpositions count and every similarity is raised."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(len(a), len(b), 4))
    return jaro + same * 0.1 * (1 - jaro)


#: Characters of all pairs that are walked at once.
SLICE = 1 << 17


def char_codes(texts: list[str], lengths: np.ndarray, blank: int) -> np.ndarray:
    """A row of code points per text, filled up with `blank`."""
    wide = int(lengths.max(initial=0))
    codes = np.array(texts, f"U{max(wide, 1)}").view(np.int32).reshape(len(texts), max(wide, 1))[:, :wide].copy()
    codes[np.arange(wide)[None] >= lengths[:, None]] = blank
    return codes


def matches(x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each row of x that find one in y, each the first free one in reach; and of these how many stand in another order."""
    wide, high = x.shape[1], y.shape[1]
    reach, at = reach[:, None], np.arange(high)[None]
    free, left = np.ones(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(wide):
        fits = free & (y == x[:, i : i + 1]) & (at >= i - reach) & (at <= i + reach)
        left[:, i] = hit = fits.any(1)
        free[hit, fits[hit].argmax(1)] = False
    m = left.sum(1)
    order = lambda chars, taken: np.take_along_axis(chars, np.argsort(~taken, axis=1, kind="stable"), 1)
    k = min(wide, high)
    differ = (order(x, left)[:, :k] != order(y, ~free & (y >= 0))[:, :k]) & (np.arange(k)[None] < m[:, None])
    return m, differ.sum(1)


def jaro_winkler_batch(a: list[str], b: list[str], prefix: float = 0.1) -> np.ndarray:
    """jaro_winkler_of for many pairs at once. Common first characters find each other, so only what is behind them is walked, one step per
    character, over slices of pairs with about as much left. A prefix of 0 leaves Jaro's similarity as it is."""
    la, lb = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    x, y = char_codes(a, la, -1), char_codes(b, lb, -2)
    k = min(x.shape[1], y.shape[1])
    unlike = np.concatenate([x[:, :k] != y[:, :k], np.ones((len(a), 1), bool)], axis=1)
    p = unlike.argmax(1)
    m, differ = p.copy(), np.zeros(len(a), np.int64)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    rest, begin = np.maximum(la, lb) - p, 0
    todo = np.flatnonzero((la > p) & (lb > p))
    todo = todo[np.argsort(rest[todo], kind="stable")]
    while begin < len(todo):
        end = begin + max(1, SLICE // int(rest[todo[begin]]))
        end = begin + max(1, min(end - begin, int(SLICE // rest[todo[min(end, len(todo)) - 1]])))
        rows = todo[begin:end]
        behind = lambda c, n, blank, rows=rows: np.where((at := p[rows, None] + np.arange((n - p)[rows].max())[None]) < n[rows, None], c[rows[:, None], np.minimum(at, c.shape[1] - 1)], blank)
        more, differ[rows] = matches(behind(x, la, -1), behind(y, lb, -2), reach[rows])
        m[rows] += more
        begin = end
    moved = differ / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3, 0.0)
    equal = (p == la) & (la == lb)
    return np.where(equal, 1.0, jaro + np.minimum(p, 4) * prefix * (1 - jaro))


def compared(a: pd.Series, b: pd.Series, prefix: float) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    rows = np.flatnonzero(known)
    x, y = a.to_numpy()[rows], b.to_numpy()[rows]
    # pairs of like length together, in slices of bounded size
    length = np.array([max(len(s), len(t)) for s, t in zip(x, y, strict=True)], np.int64)
    order, begin = np.argsort(length, kind="stable"), 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * length[order[end]] <= 1 << 20:
            end += 1
        take = order[begin:end]
        out[rows[take]] = jaro_winkler_batch(x[take].tolist(), y[take].tolist(), prefix)
        begin = end
    return pd.Series(out).where(known)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where either text is."""
    return compared(a, b, 0.1)


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null where either text is."""
    return compared(a, b, 0.0)

