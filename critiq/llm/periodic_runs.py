"""Periodic runs of words, found through a run-length grammar built by recompression.

A run is a stretch of consecutive words with smallest period q and length of at least EXPONENT * q (and MIN_LENGTH)
that no neighbouring word extends with that period.

Harmonic grid: a stretch of 4 q words holds four consecutive multiples of q, and in a run of period q the words there
are equal. So for each q the words at the multiples of q are compared, n / q of them, and four equal ones in a row
make a candidate: n log n comparisons in all, over the texts of a batch laid end to end (a word of its own stands
between texts, so nothing crosses).

Recompression: the texts that have candidates are compressed, by turns, by blocks (a maximal repetition of a symbol
becomes one symbol) and by pairs (the symbols are dealt into left and right ones by a hash, and a left one before a
right one becomes one symbol), until one symbol is left. As equal neighbourhoods are compressed alike, the longest
common extension (LCE) of two positions climbs both derivations while they agree, a step or two a level, and comes
down where they part; all candidates climb at once. A candidate's LCE to the right and, in the mirrored grammar, to
the left, taken with the position one period on, are the exact ends of its run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPONENT = 4
MIN_LENGTH = 6
PORTION = 1 << 20  # bytes of text that are searched together; a longer text is searched alone
LANES = 1 << 18  # candidates that climb together
ODD, ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # multipliers of the hash that deals symbols left and right


class Level:
    """One sequence of symbols: text length of each, and the way to the sequence made from it.

    up: index of the symbol above; head: whether this symbol is the first below it; first: index below of each
    symbol's first child; blocks: whether the sequence above was made by blocks, else by pairs.
    """

    __slots__ = ("symbol", "width", "up", "head", "first", "blocks")

    def __init__(self, symbol: np.ndarray, width: np.ndarray, first: np.ndarray | None):
        self.symbol, self.width, self.first = symbol, width, first
        self.up = self.head = None
        self.blocks = False

    def join(self, head: np.ndarray, blocks: bool) -> None:
        self.head, self.blocks = head, blocks
        self.up = np.cumsum(head, dtype=np.int32) - np.int32(1)


def _is_right(symbol: np.ndarray, turn: int) -> np.ndarray:
    """The side of each symbol in this turn: true for right."""
    z = (symbol.astype(np.uint64) + np.uint64(turn << 32)) * ODD
    z ^= z >> np.uint64(29)
    return (z * ODD2) >> np.uint64(63) == 1


def grammar(text: np.ndarray) -> list[Level]:
    """Levels from the text (symbols from 0 on) up to a single symbol. All of them take about 100 bytes for a symbol of the text."""
    free = int(text.max()) + 1
    levels = [Level(text.astype(np.int32), np.ones(len(text), np.int32), None)]
    turn = 0
    while len(levels[-1].symbol) > 1:
        now = levels[-1]
        s, n = now.symbol, len(now.symbol)
        blocks = turn % 2 == 0
        head = np.ones(n, bool)
        if blocks:
            head[1:] = s[1:] != s[:-1]
        else:
            right = _is_right(s, turn)
            one, other = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
            head[1:] = ~(one if one.sum() >= other.sum() else other)
        turn += 1
        if head.all():
            continue  # nothing to compress this time
        now.join(head, blocks)
        first = np.flatnonzero(head).astype(np.int32)
        many = np.diff(first, append=np.int32(n))  # children of each symbol above
        symbol = s[first]
        made = np.flatnonzero(many > 1)
        second = many[made] if blocks else s[first[made] + 1]
        names, keys = np.unique(symbol[made].astype(np.int64) << 31 | second, return_inverse=True)
        symbol[made] = free + keys  # a symbol of its own for each (symbol, repetitions) or pair
        free += len(names)
        levels.append(Level(symbol, np.add.reduceat(now.width, first, dtype=np.int32), first))
    return levels


def mirrored(levels: list[Level]) -> list[Level]:
    """The grammar of the text read backwards."""
    out = []
    for level, above, below in zip(levels, [*levels[1:], None], [None, *levels[:-1]]):
        m = Level(level.symbol[::-1], level.width[::-1], None)
        if below is not None:  # last children become first ones
            last = np.append(level.first[1:], len(below.symbol)) - 1
            m.first = (len(below.symbol) - 1 - last)[::-1]
        if above is not None:
            tail = np.append(level.head[1:], True)
            m.join(tail[::-1], level.blocks)
        out.append(m)
    return out


def common_extension(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pair of positions x < y, how many symbols are equal from there on.

    The text must end in a symbol that occurs nowhere else. Up: lanes whose symbols are equal either stand at a first
    child on both sides and climb, or step past the rest of their blocks, or past the right one of a pair, and then
    climb; equal symbols keep the parse in step. Down: where the symbols differ, the same step is made among their
    children, once a level, as what follows it differs.
    """
    out = np.zeros(len(x), np.int64)
    lane = np.arange(len(x))
    stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k, level in enumerate(levels):
        if not len(lane):
            break
        equal = level.symbol[x] == level.symbol[y]
        if level.up is None:
            goes = np.zeros(len(x), bool)
        else:
            goes = equal.copy()
            slow = np.flatnonzero(equal & ~(level.head[x] & level.head[y]))
            if len(slow):
                a, b = x[slow], y[slow]
                step = _rest(level, levels[k + 1], a, b) if level.blocks else np.ones(len(slow), np.int64)
                out[lane[slow]] += step * level.width[a]
                a, b = a + step, b + step
                goes[slow] = level.head[a] & level.head[b] & (level.symbol[a] == level.symbol[b])
                x[slow], y[slow] = a, b
        stopped.append((lane[~goes], x[~goes], y[~goes]))
        lane, x, y = lane[goes], x[goes], y[goes]
        if len(lane):
            x, y = level.up[x], level.up[y]
    lane = x = y = np.empty(0, np.int64)
    for k in range(len(stopped) - 1, -1, -1):
        level = levels[k]
        if len(lane):  # symbols above differ: look at their children
            x, y = levels[k + 1].first[x], levels[k + 1].first[y]
            same = np.flatnonzero(level.symbol[x] == level.symbol[y])
            if len(same):
                a, b = x[same], y[same]
                step = _rest(level, levels[k + 1], a, b) if level.blocks else np.ones(len(same), np.int64)
                out[lane[same]] += step * level.width[a]
                x[same], y[same] = a + step, b + step
        lane, x, y = (np.concatenate(p) for p in zip((lane, x, y), stopped[k]))
    return out


def _rest(level: Level, above: Level, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols from a and b to the end of their blocks, the lesser number."""
    ends = np.append(above.first[1:], len(level.symbol))
    return np.minimum(ends[level.up[a]] - a, ends[level.up[b]] - b)


def candidates(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(positions, q): multiples of q, in the text of all, whose words and those 1, 2 and 3 periods on are equal.

    The texts lie end to end, longest first, at ``starts``; only those of 4 q words or more are looked at.
    """
    ends = starts + lengths
    for q in range(1, int(lengths[0]) // EXPONENT + 1 if len(lengths) else 1):
        upto = int(ends[np.searchsorted(-lengths, -EXPONENT * q, side="right") - 1])
        grid = text[:upto:q]
        if len(grid) < 4:
            continue
        same = grid[1:] == grid[:-1]
        four = same[:-2] & same[1:-1] & same[2:]
        if four.any():
            yield np.flatnonzero(four) * q, q


def _ends(levels: list[Level], back: list[Level], at: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the widest stretch of period q around each candidate."""
    n = len(levels[0].symbol)
    right = common_extension(levels, at.copy(), at + q)
    left = common_extension(back, n - at - q, n - at)  # from the position before each, read backwards
    return at - left, at + q + right


def batch_runs(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, periods) of every run of each text, by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    long = order[lengths[order] >= MIN_LENGTH]
    found = [np.empty((0, 3), np.int64)] * len(texts)
    if len(long):
        sizes = lengths[long]
        names = pd.factorize(np.array([w for k in long.tolist() for w in texts[k]], object))[0].astype(np.int64)
        text, starts = _laid(names, sizes)
        hit = np.zeros(len(long), bool)
        for at, _ in candidates(text, starts, sizes):
            hit[np.searchsorted(starts, at, side="right") - 1] = True
        if hit.any():  # only these texts are compressed; the grid is laid over them anew
            long, names, sizes = long[hit], names[np.repeat(hit, sizes)], sizes[hit]
            text, starts = _laid(names, sizes)
            rows = _runs(text, starts, sizes)
            owner = np.searchsorted(starts, rows[:, 0], side="right") - 1
            rows[:, :2] -= starts[owner][:, None]
            bounds = np.searchsorted(owner, np.arange(len(long) + 1))
            for k, i in enumerate(long.tolist()):
                mine = rows[bounds[k] : bounds[k + 1]]
                found[i] = mine[np.lexsort((mine[:, 2], mine[:, 0]))]
    for rows in found:
        yield rows[:, 0], rows[:, 1], rows[:, 2]


def _runs(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the runs in texts laid end to end, by start and end."""
    levels = grammar(text)
    back = mirrored(levels)
    rows, at, waiting = np.empty((0, 3), np.int64), [], 0
    for hits, q in chain(candidates(text, starts, sizes), [(np.empty(0, np.int64), 0)]):
        at.append((hits, np.full(len(hits), q)))
        waiting += len(hits)
        if waiting >= LANES or not q:  # many at once, or the last ones
            a, p = (np.concatenate(c) for c in zip(*at))
            start, end = _ends(levels, back, a, p)
            good = end - start >= np.maximum(MIN_LENGTH, EXPONENT * p)
            rows = _least_periods(np.concatenate((rows, np.stack((start[good], end[good], p[good]), 1))))
            at, waiting = [], 0
    return rows


def _laid(names: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end with a symbol of its own before each and after the last; and where each begins."""
    starts = np.cumsum(sizes + 1) - sizes
    own = int(names.max()) + 1
    text = np.empty(len(names) + len(sizes) + 1, np.int64)
    marks = np.append(starts - 1, len(text) - 1)
    plain = np.ones(len(text), bool)
    plain[marks] = False
    text[plain] = names
    text[marks] = own + np.arange(len(marks))
    return text, starts


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """One row a stretch, by start and end, with the least period: its other periods are multiples of that."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def repeated(n: int, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Whether each of n words lies in a run after the run's first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def _planted(words: list[bytes], at: int, period: int) -> list[bytes]:
    """words, of which each from ``at`` on repeats the ``period`` words there."""
    n = len(words) - at
    unit = words[at : at + period]
    return words[:at] + (unit * (n // period + 1))[:n]


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(from, to) of rows whose texts have PORTION bytes together, or one row."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    first, size = 0, 0
    for k, s in enumerate(sizes):
        if k > first and size + s > PORTION:
            yield first, k
            first, size = k, 0
        size += s
    if sizes:
        yield first, len(sizes)


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs binary, collapsed binary"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_from: Column | None = None, repeat_period: Column | None = None) -> DataFrame:
    """For every row of docs: id_col, n_runs; start, length, period and exponent_milli (1000 * length / period, rounded down)
    of the longest run (ties: least start, then least period; nulls without a run); ``runs``, a line
    ``start,length,period`` for each run by start, then period; ``collapsed``, the words that no run holds after its
    first period, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. repeat_from, repeat_period: for tests of the search, columns by which
    the words from repeat_from on repeat the first repeat_period of them; null leaves the text as it is. Null, empty
    and blank texts have no words and no runs, and empty runs and collapsed. Whole texts are searched; a text's
    memory grows with its length alone. Rows that repeat and null ids get a row each. An empty table gives an empty
    result. Other columns are ignored, whatever their names.

    Every row is searched on its own, so nothing is shuffled, and a task that runs again returns the same rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _portions(batch.column(1)):
                part = batch.slice(a, b - a)
                texts = [(t or b"").split() for t in part.column(1).to_pylist()]
                for k, (at, p) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    if at is not None and p is not None and at < len(texts[k]):
                        texts[k] = _planted(texts[k], at, p)
                out: list[tuple] = []
                for words, (starts, ends, periods) in zip(texts, batch_runs(texts)):
                    if not len(starts):
                        out.append((0, None, None, None, None, b"", b" ".join(words)))
                        continue
                    sizes = ends - starts
                    k = int(np.lexsort((periods, starts, -sizes))[0])
                    start, size, period = int(starts[k]), int(sizes[k]), int(periods[k])
                    lines = "".join(f"{s},{z},{q}\n" for s, z, q in zip(starts.tolist(), sizes.tolist(), periods.tolist()))
                    gone = repeated(len(words), starts, ends, periods)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                    out.append((len(starts), start, size, period, 1000 * size // period, lines.encode(), b" ".join(kept)))
                kinds = [pa.int64()] * 5 + [pa.binary()] * 2
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))], [id_col, *names])

    none = F.lit(None).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    first = none if repeat_from is None else repeat_from.cast("long")
    period = none if repeat_period is None else repeat_period.cast("long")
    given = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("text"), first.alias("from"), period.alias("period"))
    return given.mapInArrow(rows, f"`{id_col}` {kind}, {SCHEMA}")


