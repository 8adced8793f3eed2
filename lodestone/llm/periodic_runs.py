"""Periodic runs of words by an online sparse diagonal DP.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least max(LEAST, 2 * q) words, which no neighbouring word extends.
A diagonal is a lag p; its match length at word i counts the words up to i that equal the ones p before them. A diagonal that has ended after m matches is a stretch of m + p words
with period p, so it is long enough if m >= max(p, LEAST - p), which is at least GRAM = LEAST / 2. The words of a text are read once, in order:

- an active diagonal whose next words differ ends, and emits its run at once if it is long enough. Diagonals that end at one word with one start are the same stretch, of which the smallest lag
  is the period; the others are its multiples;
- the others' match lengths grow by one;
- each earlier occurrence of the word (with the same GRAM - 1 words before it) starts a diagonal, if its lag isn't active.

What a run within [s, i] of period q already implies starts nothing: an occurrence inside it, at lag 2 * q or more, either has a multiple of q as its lag, whose stretch is the run itself, or
matches fewer than q words before it breaks off inside the run. One that goes on beyond the run's end is found there, and its first match by looking back. So a text that
repeats one line a thousand times has one active diagonal, not a thousand.

Words are compared as bytes. The occurrences come from 64-bit hashes of the GRAM words, which miss none; looking back compares the words themselves.

Work: the number of words, and of pairs of equal GRAM words that no run implies. Two long runs of one short period within a text (a thousand x, a y, a thousand x) meet on all lags between
them, so that such texts cost up to the square of their runs' lengths; memory stays in proportion to the text.

Nulls and edge cases: null and empty texts have no words and no runs; texts of any length are read whole; rows with a null doc_id take no part; repeated rows are judged each; extra columns are
left out, whatever their names are. An empty table gives no rows."""

from __future__ import annotations

from bisect import bisect_left
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.shared import Slice, map_slices
from lodestone.llm.textops import Words, in_doc, shingles

#: Words of the shortest run, and matches of the shortest diagonal that can be one.
LEAST = 12
GRAM = LEAST // 2


def earlier(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the slice's grams in order of (document, gram, place), the group of each, and the documents that have a gram twice."""
    words = Words(part.buf, part.offsets)
    at = np.flatnonzero(in_doc(words, GRAM))
    key, doc = shingles(words.hashes, GRAM)[at], words.doc()[at]
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    group = np.cumsum(new) - 1
    again = np.bincount(group)[group] > 1 if len(group) else new
    return at[order][again] - words.offsets[doc[order][again]] + GRAM - 1, group[again], doc[order][again]


def diagonals(words: list[bytes], ends: np.ndarray, group: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of one text. ``ends``: the last words of grams that the text may have several times, in order of (group, place)."""
    n, active, runs = len(words), {}, []  # lag: its first match
    places = ends.tolist()
    first = np.zeros(len(group), np.int64)
    first[1:] = np.where(group[1:] != group[:-1], np.arange(1, len(group)), 0)
    first = np.maximum.accumulate(first).tolist()
    order = np.argsort(ends, kind="stable").tolist()

    def ended(lags: list[int], i: int) -> None:
        """Diagonals that match no more at word i."""
        found: dict[int, int] = {}
        for p in lags:
            begin = active.pop(p)
            if i - begin >= max(p, LEAST - p) and found.get(begin - p, n) > p:
                found[begin - p] = p
        runs.extend((start, i - start, p) for start, p in found.items())

    last, i = len(order), 0
    for k in range(last + 1):
        to = places[order[k]] if k < last else n
        while active and i < to:  # words without an earlier gram only carry on what is active
            w = words[i]
            if gone := [p for p in active if words[i - p] != w]:
                ended(gone, i)
            i += 1
        i = to
        if k == last:
            break
        w = words[i]
        if gone := [p for p in active if words[i - p] != w]:
            ended(gone, i)
        inside = [(begin - p + GRAM - 1, i - 2 * p) for p, begin in active.items() if i - begin + 1 >= p]  # last words of grams that a run implies
        r, low = order[k] - 1, first[order[k]]
        while r >= low:
            j = places[r]
            skip = min((a for a, b in inside if a <= j <= b), default=None)
            if skip is not None:
                r = bisect_left(places, skip, low, r) - 1
                continue
            if (p := i - j) not in active:
                begin = i
                while begin >= p and words[begin] == words[begin - p]:
                    begin -= 1
                if i - begin >= GRAM:
                    active[p] = begin + 1
            r -= 1
        i += 1
    ended(list(active), n)
    return sorted(runs)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in order of start and period) and collapsed, the text whose runs are cut to one period, for every row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def make():
        def each(part: Slice) -> pa.RecordBatch:
            ends, group, doc = earlier(part)
            edges = np.searchsorted(doc, np.arange(len(part) + 1))
            many, runs, kept = [], [], []
            for d in range(len(part)):
                words, a, b = part.text(d).split(), edges[d], edges[d + 1]
                found = diagonals(words, ends[a:b], group[a:b]) if b > a else []
                many.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(collapsed(words, found) if found else b" ".join(words))
            return pa.RecordBatch.from_arrays([pa.array(part.ids), pa.array(many, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        return each

    return map_slices(docs, make, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
