"""Periodic runs of words: stretches that repeat themselves, and texts without the repeats.

A run is a stretch of words with smallest period q (words q apart are identical) that holds at
least 12 words and two periods, and that no neighbouring word extends. The search splits a
text at words that are too rare to be part of a run, again and again:

1. A word that occurs once in a segment is in no run of it, since every word of a run comes
   back a period later. The segment is cut there; pieces of fewer than 12 words go.
2. The words left are counted anew per piece, until no piece changes. Only the smaller pieces of
   a cut are counted; the largest keeps its parent's counts less what went, so words are looked
   at a logarithmic number of times however deep the recursion is.
3. Surviving segments are scanned at every lag. A run of period q covers a multiple of q whose
   word comes back q later, so only these positions are looked at, and the stretch of
   matches around each is measured in powers of two.

So a text of n words costs about n log^2 n, and one of a million words is no special case. Each
text is read by the task that holds it; nothing is shuffled.

Null texts have no words; neither do empty and blank ones. Each row of the input gives one row,
whatever its id, so repeated rows give repeated results and null ids are kept. Of two equal
stretches neither is preferred: both are listed. Very long texts are read whole. An empty table
gives no rows. Only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Pairs of positions compared at once.
CHUNK = 1 << 20

#: Fixed value: what is between the blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def surviving(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the segments in which every word occurs at least twice, in order."""
    found, waiting = [], [(0, words)]
    while waiting:
        offset, part = waiting.pop()
        size = len(part)
        if size < least:
            continue
        names = np.unique(part, return_inverse=True)[1]
        counts = np.bincount(names)
        order = np.argsort(names, kind="stable")
        place = names[order] * size + order  # by name, then by position
        first, last = 0, size
        cuts = np.sort(order[np.cumsum(counts)[counts == 1] - 1])
        while len(cuts):
            edges = np.concatenate(([first - 1], cuts, [last]))
            lengths = np.diff(edges) - 1
            largest = int(np.argmax(lengths))
            waiting += [
                (offset + int(edges[k]) + 1, part[edges[k] + 1 : edges[k + 1]])
                for k in np.flatnonzero(lengths >= least)
                if k != largest
            ]
            start, end = int(edges[largest]) + 1, int(edges[largest + 1])
            gone, times = np.unique(np.concatenate((names[first:start], names[end:last])), return_counts=True)
            counts[gone] -= times
            first, last = start, end
            if last - first < least:
                break
            single = gone[counts[gone] == 1]
            cuts = np.sort(order[np.searchsorted(place, single * size + first)])
        else:
            found.append((offset + first, offset + last))
    return sorted(found)


def _powers(words: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words that start at each position."""
    names = [np.unique(words, return_inverse=True)[1]]
    while 2 ** len(names) <= len(words):
        half, width = names[-1], 2 ** (len(names) - 1)
        names.append(np.unique(half[:-width] * len(words) + half[width:], return_inverse=True)[1])
    return names


def _ahead(names: list[np.ndarray], i: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """How many words from ``i`` on are the same ``lag`` later."""
    size, at = len(names[0]), i.copy()
    for k in range(len(names) - 1, -1, -1):
        fits = np.flatnonzero(at + lag + 2**k <= size)
        same = fits[names[k][at[fits]] == names[k][at[fits] + lag[fits]]]
        at[same] += 2**k
    return at - i


def _behind(names: list[np.ndarray], i: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """How many words just before ``i`` are the same ``lag`` later."""
    at = i.copy()
    for k in range(len(names) - 1, -1, -1):
        fits = np.flatnonzero(at >= 2**k)
        same = fits[names[k][at[fits] - 2**k] == names[k][at[fits] - 2**k + lag[fits]]]
        at[same] -= 2**k
    return i - at


def scan_lags(words: np.ndarray, least: int = LEAST, chunk: int = CHUNK) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    size = len(words)
    lags = np.arange(1, size // 2 + 1)
    if size < least or not len(lags):
        return []
    names = _powers(words)
    steps = (size - lags - 1) // lags + 1  # multiples of each lag that have a word a lag later
    group = np.cumsum(steps) // chunk
    found = []
    for part in np.split(np.arange(len(lags)), np.flatnonzero(np.diff(group)) + 1):
        n = steps[part]
        lag = np.repeat(lags[part], n)
        i = (np.arange(len(lag)) - np.repeat(np.cumsum(n) - n, n)) * lag
        same = names[0][i] == names[0][i + lag]
        i, lag = i[same], lag[same]
        behind = _behind(names, i, lag)
        new = behind < lag  # else the multiple before lies in the same stretch
        i, lag, behind = i[new], lag[new], behind[new]
        start = i - behind
        length = behind + _ahead(names, i, lag) + lag
        runs = length >= np.maximum(least, 2 * lag)
        found.append(np.stack((start[runs], length[runs], lag[runs]), axis=1))
    all_found = np.concatenate(found)  # by lag
    # a stretch with a smaller period has it as a divisor, and was found with it before
    _, smallest = np.unique(all_found[:, 0] * (size + 1) + all_found[:, 1], return_index=True)
    runs = all_found[smallest]
    return [tuple(r) for r in runs[np.lexsort((runs[:, 2], runs[:, 0]))].tolist()]


def runs_of(words: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    if len(words) < least:
        return []
    known: dict[str, int] = {}
    names = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    if len(known) > len(words) - least // 2:
        return []  # fewer than half of a run's words can come back
    return [
        (start + a, length, period)
        for a, b in surviving(names, least)
        for start, length, period in scan_lags(names[a:b], least)
    ]


def without_repeats(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(depth)) if not d]


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """Words of a tenth of all documents with a periodic end, by the checksum of the id."""
    if doc_id is None or not words:
        return words
    h = crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_FOUND_SQL = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def periodic_runs(
    docs: DataFrame, least: int = LEAST, rewrite: Callable[[int | None, list[str]], list[str]] | None = None
) -> DataFrame:
    """Per document: doc_id, its runs by start, then period, and its text without the repeats.

    ``rewrite`` maps (doc_id, words) to the words that are searched.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed, collapsed = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall(text or "")
                if rewrite:
                    words = rewrite(doc_id, words)
                runs = runs_of(words, least)
                listed.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                collapsed.append(" ".join(without_repeats(words, runs)))
            columns = [batch.column(0), pa.array(listed, _FOUND.field("runs").type), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, _FOUND_SQL)


def listed(runs: str | Column) -> Column:
    """One line ``start,length,period`` per run."""
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    return F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")


def longest(runs: str | Column) -> Column:
    """The run of greatest length, then smallest start and period; null if there is none."""
    placed = F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run")))
    return F.array_max(placed)["run"]
