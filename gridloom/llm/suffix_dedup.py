"""Removal of repeated byte passages by suffix arrays and longest-previous-factor arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm.repeats import WINDOW, Bytes, Repeats


class SuffixArray:
    """Suffixes of several byte strings, sorted by group and then by their bytes to the string's end.

    Ranks double their reach from 7 to 56 bytes; suffixes that agree so far count as equal
    in order, and their common prefix is measured up to 111 bytes.
    """

    def __init__(self, segments: list[bytes], groups: list[int]):
        sizes = np.array(list(map(len, segments)), np.int64)
        self.owner = np.repeat(np.arange(len(segments)), sizes)
        self.ends = np.cumsum(sizes)[self.owner] if len(segments) else np.empty(0, np.int64)
        self.begins = self.ends - sizes[self.owner]
        n = len(self.owner)
        self.data = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
        self.at = np.arange(n)
        key = np.zeros(n, np.int64)
        for j in range(7):
            key = key << 9 | self._past(self.data, j)
        self.levels = [(7, np.unique(key, return_inverse=True)[1])]
        while self.levels[-1][0] < WINDOW:
            reach, rank = self.levels[-1]
            pair = rank * (n + 2) + self._past(rank + 1, reach)
            self.levels.append((2 * reach, np.unique(pair, return_inverse=True)[1]))
        self.order = np.lexsort((self.levels[-1][1], np.array(groups, np.int64)[self.owner]))
        self.group = np.array(groups, np.int64)[self.owner][self.order]

    def _past(self, values: np.ndarray, step: int) -> np.ndarray:
        """values `step` further on, 0 beyond the string's end."""
        to = self.at + step
        return np.where(to < self.ends, values[np.minimum(to, len(values) - 1)], 0) if len(values) else values

    def common(self) -> np.ndarray:
        """Longest common prefix of each suffix and the one before it in order; 0 for the first of a group."""
        a, b = self.order[1:], self.order[:-1]
        most = np.minimum(self.ends[a] - a, self.ends[b] - b)
        lcp = np.zeros(len(a), np.int64)
        last = max(0, len(self.data) - 1)
        for reach, rank in [*reversed(self.levels), *[(1, self.data)] * 6]:
            x, y = np.minimum(a + lcp, last), np.minimum(b + lcp, last)
            lcp = np.where((lcp + reach <= most) & (rank[x] == rank[y]), lcp + reach, lcp)
        lcp[self.group[1:] != self.group[:-1]] = 0
        return np.concatenate(([0], lcp))[: len(self.order)]


def _toward_smaller(values: list[int], links: list[int]) -> list[int]:
    """For each entry the least link on the way back to the nearest smaller value, 0 if there is none."""
    out, stack = [], []  # stack: (value, least link down to the entry below)
    for value, link in zip(values, links):
        while stack and stack[-1][0] >= value:
            link = min(link, stack.pop()[1])
        out.append(link if stack else 0)
        stack.append((value, link))
    return out


def longest_previous_factors(values: list[int], lcp: list[int]) -> list[int]:
    """For suffixes in order: longest prefix shared with a suffix of a smaller value.

    Of all suffixes with a smaller value the previous and the next one in order share most;
    what two suffixes share is the least lcp between them.
    """
    back = _toward_smaller(values, lcp)
    ahead = _toward_smaller(values[::-1], [0, *lcp[:0:-1]])[::-1]
    return list(map(max, back, ahead))


def earlier_factors(segments: list[bytes], groups: list[int], docs: list[int]) -> list[tuple[int, int, int]]:
    """(segment, first byte, bytes) of the factors of WINDOW bytes or more that an earlier document of the group holds."""
    if not segments:
        return []
    suffixes = SuffixArray(segments, groups)
    lcp = suffixes.common()
    # Only stretches of neighbours that share a window can hold factors; others are cut off.
    joined = lcp >= WINDOW
    inside = joined | np.append(joined[1:], False)
    at = np.flatnonzero(inside)
    order = suffixes.order[at]
    owners = suffixes.owner[order]
    ranked = np.unique(np.array(docs, np.int64), return_inverse=True)[1]
    factors = longest_previous_factors(ranked[owners].tolist(), np.where(joined[at], lcp[at], 0).tolist())
    starts = order - suffixes.begins[order]
    return [(int(o), int(s), f) for o, s, f in zip(owners, starts, factors) if f >= WINDOW]


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Repeats:
    """Every byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

    Texts are their UTF-8 bytes, null as none; nothing matches across documents or within
    one. Strings are judged on the input. Whole copies of an earlier text are settled by
    their hash; of the rest only segments whose key two documents have are routed, and each
    task sorts the suffixes of its segments and reads the factors off the
    longest-previous-factor array over document order. Rows of one doc_id remove nothing
    from each other; rows without doc_id stay whole and remove nothing. Other columns are
    ignored; an empty table gives no rows.
    """
    return Repeats(docs, Bytes, earlier_factors, id_col, text_col)
