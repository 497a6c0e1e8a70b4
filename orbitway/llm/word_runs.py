"""Runs of words that repeat with a period: LZ factors from a suffix automaton, Main's search at their borders, copies inside them."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitway.llm.common import SPACE, appended, table

#: Words and periods that a run has at least.
LEAST, TIMES = 6, 4
#: Words of a window whose occurrences are counted before the search, and the bits of its hash.
WINDOW, BITS = 3, 22
#: Multipliers of the hash: odd, from the golden ratio and two primes.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

Run = tuple[int, int, int]


def factors(x: Sequence[int]) -> list[tuple[int, int]]:
    """(length, where it occurs before) of each factor of x, -1 for a symbol that is new.

    A factor is the longest stretch from its start that also starts earlier; the two may overlap. The
    suffix automaton of x knows the first end of each state's stretches, which tells whether one
    starts earlier.
    """
    follow: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(x):
        new = len(size)
        follow.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(size)
                follow.append(follow[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    out, at, n = [], 0, len(x)
    while at < n:
        state, end = 0, at
        while end < n and first[further := follow[state][x[end]]] < end:
            state = further
            end += 1
        out.append((end - at, first[state] - (end - at) + 1) if end > at else (1, -1))
        at = max(end, at + 1)
    return out


def prefix_matches(x: Sequence[int]) -> list[int]:
    """How many symbols from each place equal those from the first place; all of them at the first."""
    n = len(x)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def runs(x: Sequence[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of every run of x, by start and period; time grows as the length of x.

    A run ends in one factor. If it starts before that factor, it reaches back over no more than the
    factor's and twice the last one's length; Main's search there finds it, and it finds runs that touch
    a border from either side. All others lie inside a factor, whose earlier occurrence has them too:
    they're copied from left to right. `times` is 2 or more.
    """
    n, found = len(x), {}

    def meet(start: int, end: int, period: int) -> None:
        """Take x[start:end] if it is long enough and no neighbour goes on with the period."""
        if end - start >= max(least, times * period) and (start == 0 or x[start - 1] != x[start - 1 + period]) and (end == n or x[end] != x[end - period]):
            here = found.setdefault(start, {})
            here[end] = min(period, here.get(end, period))

    parts = factors(x)
    border, before = 0, 0
    for size, _ in [*parts, (0, -1)]:  # the last border is the end
        low, high = max(0, border - 2 * before - size), border + size
        left, right = x[low:border], x[border:high]
        back = left[::-1]
        a, b = len(left), len(right)
        ahead, behind = prefix_matches(right), prefix_matches(back)
        # -1 is no symbol: matches of one side's edge inside the other side.
        over, under = prefix_matches([*back, -1, *right[::-1]]), prefix_matches([*right, -1, *left])
        most = (a + b) // times
        for p in range(1, min(b, most) + 1):  # a period that lies right of the border
            on = ahead[p] if p < b else 0
            off = over[a + 1 + b - p]
            if off == p < a:
                off += behind[p]
            if on + off >= (times - 1) * p:
                meet(border - off, border + p + on, p)
        for p in range(1, min(a, most) + 1):  # and left of it
            off = behind[p] if p < a else 0
            on = under[b + 1 + a - p]
            if on == p < b:
                on += ahead[p]
            if on + off >= (times - 1) * p:
                meet(border - p - off, border + on, p)
        border, before = high, size
    at = 0
    for size, source in parts:
        if source >= 0:
            shift, limit = at - source, source + size - 1
            for start in range(source + 1, limit):
                for end, period in list(found.get(start, {}).items()):
                    if end <= limit:
                        here = found.setdefault(start + shift, {})
                        here[end + shift] = min(period, here.get(end + shift, period))
        at += size
    return sorted((start, end - start, period) for start, ends in found.items() for end, period in ends.items())


def _stretches(owner: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """First word and the one after the last of the stretches that runs of LEAST words and TIMES periods can lie in; none is left out.

    owner and ids: each word's text and number. In such a run each window of three words starts TIMES - 1
    times or more: L - 2 windows of period q, where L is 4 q and 6 at least. Windows that are rarer in
    their text end a stretch. Hashes that collide only make a window look more frequent.
    """
    n = len(ids) - WINDOW + 1
    if n < LEAST - WINDOW + 1:
        return
    hashed = owner[:n].astype(np.uint64)
    for k in range(WINDOW):
        hashed = (hashed ^ ids[k : n + k].astype(np.uint64)) * _MIX[k]
        hashed ^= hashed >> np.uint64(29)
    bucket = (hashed >> np.uint64(64 - BITS)).astype(np.int64)
    whole = owner[:n] == owner[WINDOW - 1 :]
    often = (np.bincount(bucket[whole], minlength=1 << BITS) >= TIMES - 1)[bucket] & whole
    edge = np.flatnonzero(np.diff(np.concatenate([[False], often, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= LEAST - WINDOW + 1:
            yield a, b + WINDOW - 1


def runs_of_all(texts: Sequence[list[bytes]]) -> list[list[Run]]:
    """The runs of each list of words; words are numbered once for all of them."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(w) for w in texts], np.int64)
    ids = np.fromiter((number[w] for words in texts for w in words), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[Run]] = [[] for _ in texts]
    for a, b in _stretches(owner, ids):
        doc = int(owner[a])
        out[doc] += [(a - int(starts[doc]) + s, size, p) for s, size, p in runs(ids[a:b].tolist())]
    return [sorted(r) for r in out]


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not found:
        return b" ".join(words)
    keep = bytearray(b"\1") * len(words)
    for start, size, period in found:
        keep[start + period : start + size] = bytes(size - period)
    return b" ".join(w for w, k in zip(words, keep, strict=True) if k)


RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


def with_runs(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """documents with the columns runs (start, length and period of each run, by start and period) and collapsed, in place of text_col.

    A run is a stretch of LEAST words and TIMES periods or more, in words, that no neighbouring word
    extends. Words are runs of bytes other than 9 to 13 and 32. One pass without a shuffle; a text is
    searched whole, however long, in time that grows as its length. A null text, and one without
    words, has no runs and collapses to an empty text; repeated rows and null ids come back as they are.
    Columns named runs or collapsed must not be there before. An empty table gives no rows.
    """

    def run(texts: list[bytes | None]) -> tuple:
        words = [(t or b"").split() for t in texts]
        found = runs_of_all(words)
        dicts = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
        return dicts, [collapsed(w, r).decode("utf-8", "replace") for w, r in zip(words, found, strict=True)]

    rows = documents.withColumn(text_col, F.col(text_col).cast("binary"))
    return appended(rows, text_col, run, T.StructType().add("runs", T.ArrayType(RUN)).add("collapsed", "string"))


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    with_runs()'s values, without moving them out of the worker; its cases hold.
    """

    def run(texts: list[bytes | None]) -> list[list]:
        words = [(t or b"").split() for t in texts]
        found = runs_of_all(words)
        best: list[Run | tuple] = [most_periods(r) if r else (None,) * 3 for r in found]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        lines = ["".join(f"{s},{n},{p}\n" for s, n, p in r) for r in found]
        milli = [1000 * n // p if n else None for _, n, p in best]
        return [[len(r) for r in found], *([b[k] for b in best] for k in range(3)), milli, [sha(x.encode()) for x in lines], [sha(collapsed(w, r)) for w, r in zip(words, found, strict=True)]]

    kind = T.StructType()
    for name in ("n_runs", "start", "length", "period", "exponent_milli"):
        kind = kind.add(name, "long")
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return appended(rows, "text", run, kind.add("runs_sha256", "string").add("collapsed_sha256", "string"))


def most_periods(found: list[Run]) -> Run:
    """The run of the greatest exact length / period; of equals the first, then that of the smallest period."""
    best = found[0]
    for r in found[1:]:  # by start and period: an equal one never comes before
        if r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def periodic_text(text: Column, doc_id: Column) -> Column:
    """The text whose words repeat with a period, where h = crc32(doc_id) is divisible by 10; others, and null ids, keep theirs.

    With g = h / 10 and n words, from word a = g % n on words repeat with period 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), whole).otherwise(text)


def op13_word_runs(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return digests(documents.select("doc_id", periodic_text(F.col("text"), F.col("doc_id")).alias("text")))
