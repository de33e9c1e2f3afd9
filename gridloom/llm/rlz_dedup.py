"""Removal of repeated word passages by relative Lempel-Ziv parsing."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame

from gridloom.llm.repeats import WINDOW, Repeats, Words

_SPAN = WINDOW * Words.width


class Reference:
    """A block of earlier documents' segments, indexed by every window of words at its first place."""

    def __init__(self):
        self.places: dict[bytes, tuple[bytes, int]] = {}

    def add(self, segment: bytes) -> None:
        for at in range(0, len(segment) - _SPAN + 1, Words.width):
            self.places.setdefault(segment[at : at + _SPAN], (segment, at))

    def factor(self, segment: bytes, at: int) -> int:
        """Bytes of the match from `at` with the first place of its window; 0 if the block has no such window."""
        found = self.places.get(segment[at : at + _SPAN])
        if found is None:
            return 0
        source, begin = found
        size, most = _SPAN, min(len(source) - begin, len(segment) - at)
        while size < most and source[begin + size : begin + size + Words.width] == segment[at + size : at + size + Words.width]:
            size += Words.width
        return size


def parse(segment: bytes, reference: Reference) -> list[tuple[int, int]]:
    """(first word, words) of the factors long enough to be spans.

    Greedy: a factor is taken as far as it goes where one of WINDOW words or more starts,
    else one word is passed. After a factor the parse goes on WINDOW - 1 words before its
    end, as a window across that boundary may stand elsewhere in the reference. So every
    window is either inside a factor or looked up itself, and one place for each is enough.
    """
    out, at = [], 0
    while at + _SPAN <= len(segment):
        size = reference.factor(segment, at)
        if size:
            out.append((at // Words.width, size // Words.width))
            at += size - _SPAN
        at += Words.width
    return out


def earlier_factors(segments: list[bytes], groups: list[int], docs: list[int]) -> list[tuple[int, int, int]]:
    """(segment, first word, words) of the factors that an earlier document of the group holds.

    Segments come by group and then by document; a document's own segments join the
    reference only after all of them are parsed.
    """
    out = []
    for _, own in groupby(range(len(segments)), key=groups.__getitem__):
        reference = Reference()
        for _, same in groupby(own, key=docs.__getitem__):
            same = list(same)
            for i in same:
                out += [(i, a, n) for a, n in parse(segments[i], reference)]
            for i in same:
                reference.add(segments[i])
    return out


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Repeats:
    """Every word covered by a window of 50 words whose sequence also starts in a document with a smaller doc_id.

    Words are what stands between ASCII white space, unchanged; windows stay inside one
    document and are judged on the input. Texts with the words of an earlier text are
    settled by their hash; of the rest only segments whose key two documents have are
    routed, and each is parsed against the earlier documents' segments of its key. Null
    texts have no words. Rows of one doc_id remove nothing from each other; rows without
    doc_id stay whole and remove nothing. Other columns are ignored; an empty table gives
    no rows.
    """
    return Repeats(docs, Words, earlier_factors, id_col, text_col)
