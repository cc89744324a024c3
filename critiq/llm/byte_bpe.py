"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The pattern of the rank files' tokenizers,

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is run without a regular expression. Code points become symbols by a class table (letter, number, white
space, other; one or two points of lookahead are folded into the symbols of apostrophes and white
space). A small automaton reads the symbols; its transitions are functions from state to state, and
composing functions is associative, so the text is cut in rows, the function of every row is composed
for all rows at once, a prefix scan over the rows gives the state before each, and a second pass marks
the boundaries of all rows at once. The slices between boundaries go through pair merging once per
distinct slice and task, in a bounded cache.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import lean_batches
from critiq.llm.memory import Cache, released

PIECE = 1 << 19  # code points scanned at once; the state carries over between the pieces of a long text
ROW = 128
CACHE = 64 << 20  # bytes of slices and their ids that a task remembers
CACHED_CHARS = 48
NONE = 1 << 40  # rank of no token

# states
START, IN_L, IN_N, IN_O, LED, IN_W, ONE, TWO = range(8)  # LED: after a space that leads the next slice; ONE, TWO: letters left of a contraction
STATES = 8
# symbols; NEXT: followed by a point that isn't white space
SYM_L, SYM_N, SYM_O, SYM_A1, SYM_A2, SYM_SPACE_NEXT, SYM_SPACE, SYM_WHITE_NEXT, SYM_WHITE, SYM_NONE = range(10)
FRESH = 10  # added to the symbol of the first point of a text

# The code points with the property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def point_classes() -> np.ndarray:
    """Symbol of each code point without its surroundings."""
    kinds = {"L": SYM_L, "N": SYM_N}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], SYM_O) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SYM_WHITE
    out[0x20] = SYM_SPACE
    return out


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a slice begins here) at index symbol * STATES + state."""
    step, begins = np.zeros((2 * FRESH, STATES), np.intp), np.zeros((2 * FRESH, STATES), bool)
    for symbol in range(10):
        for state in range(STATES):
            if symbol == SYM_NONE:
                to, new = state, False
            elif state == TWO:
                to, new = ONE, False
            elif state == ONE:
                to, new = START, False
            elif symbol in (SYM_L, SYM_N, SYM_O):
                to = (IN_L, IN_N, IN_O)[symbol]
                new = state not in (to, LED)
            elif symbol in (SYM_A1, SYM_A2):  # an apostrophe within a run of others, or led by a space, is one of them
                inside = state in (IN_O, LED)
                to, new = (IN_O, False) if inside else (ONE if symbol == SYM_A1 else TWO, True)
            elif symbol == SYM_SPACE_NEXT:
                to, new = LED, True
            elif symbol == SYM_WHITE_NEXT:
                to, new = START, True
            else:
                to, new = IN_W, state != IN_W
            step[symbol, state], begins[symbol, state] = to, new
    step[FRESH:], begins[FRESH:] = step[:FRESH, START : START + 1], begins[:FRESH, START : START + 1]
    return step.ravel(), begins.ravel()


def symbols(points: np.ndarray, fresh: np.ndarray, upto: int) -> np.ndarray:
    """Symbols of the first ``upto`` points; the rest is lookahead. fresh: where texts begin."""
    classes = point_classes()[points]
    n = len(points)
    white = classes >= SYM_SPACE_NEXT
    same = np.zeros(n, bool)  # whether the next point belongs to the same text
    same[:-1] = ~fresh[1:]
    follows = np.zeros(n, bool)
    follows[:-1] = ~white[1:] & same[:-1]
    classes[(classes == SYM_SPACE) & follows] = SYM_SPACE_NEXT
    classes[(classes == SYM_WHITE) & follows] = SYM_WHITE_NEXT
    at = np.flatnonzero(points[: n - 1] == 0x27)
    at = at[same[at]]
    one = points[at + 1]
    short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])  # s t m d
    classes[at[short]] = SYM_A1
    at, one = at[~short & (at + 2 < n)], one[~short & (at + 2 < n)]
    two = points[at + 2]
    long = same[at + 1] & (((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (two == 0x6C)))  # re ve ll
    classes[at[long]] = SYM_A2
    return classes[:upto] + np.where(fresh[:upto], FRESH, 0).astype(np.uint8)


def scan(sym: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Where slices begin, and the state after the last symbol, starting from ``state``."""
    step, begins = automaton()
    rows = -(-len(sym) // ROW)
    grid = np.full(rows * ROW, SYM_NONE, np.uint8)
    grid[: len(sym)] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, ROW).T).astype(np.intp) * STATES
    whole = np.tile(np.arange(STATES), (rows, 1))  # each row's function, as far as composed
    for column in grid:
        whole += column[:, None]
        whole = step.take(whole, mode="clip")
    reach = 1  # inclusive prefix scan: whole[r] becomes the composition of rows 0..r
    while reach < rows:
        later = np.take_along_axis(whole[reach:], whole[:-reach], 1)
        whole = np.concatenate((whole[:reach], later))
        reach *= 2
    now = np.concatenate(([state], whole[:-1, state]))
    marks = np.empty((ROW, rows), bool)
    for k, column in enumerate(grid):
        at = column + now
        marks[k], now = begins.take(at, mode="clip"), step.take(at, mode="clip")
    return marks.T.ravel()[: len(sym)], int(whole[-1, state])


def slice_starts(points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Indexes at which slices begin, in texts laid end to end."""
    out, state = [], START
    for at in range(0, len(points), PIECE):
        upto = min(PIECE, len(points) - at)
        sym = symbols(points[at : at + upto + 2], fresh[at : at + upto + 2], upto)
        marks, state = scan(sym, state)
        out.append(np.flatnonzero(marks) + at)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def slices(texts: list[str]) -> Iterator[list[str]]:
    """The slices of each text."""
    text = "".join(texts)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    fresh = np.zeros(len(points), bool)
    fresh[starts[starts < len(points)]] = True
    cuts = slice_starts(points, fresh)
    bounds = np.append(cuts, len(points)).tolist()
    for a, b in zip(np.searchsorted(cuts, starts).tolist(), np.searchsorted(cuts, ends).tolist()):
        yield [text[i:j] for i, j in zip(bounds[a:b], bounds[a + 1 : b + 1])]


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of least rank merges first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 80:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = len(ranks) + 1_000_000
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (least := min(pairs)) != none:
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and a linked list, for slices of any length."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, upto = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != upto:
            continue
        end[i], end[j] = upto, 0
        if upto < n:
            before[upto] = i
            if (r := ranks.get(piece[i : end[upto]])) is not None:
                heapq.heappush(heap, (r, i, end[upto]))
        p = before[i]
        if p >= 0 and (r := ranks.get(piece[p:upto])) is not None:
            heapq.heappush(heap, (r, p, upto))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Ranks of tokens, and for every two tokens that merge the rank of what they make; bounded by the rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], k) for t, k in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.keys, self.made = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        self.bytes = np.array([ranks.get(bytes([v]), 0) for v in range(256)], np.int64)
        tokens = sorted((k, t) for t, k in ranks.items())
        self.size = np.zeros(tokens[-1][0] + 1 if tokens else 1, np.int64)  # bytes of each token
        for k, t in tokens:
            self.size[k] = len(t)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins."""
        sizes = self.size[ids]
        return np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The tokens' bytes, each at its offset from the first; offsets that leave gaps or overlaps are an error."""
        if not len(ids):
            return b""
        sizes, offsets = self.size[ids], offsets.astype(np.int64)
        ends = offsets + sizes
        if not np.array_equal(offsets[1:], ends[:-1]):
            raise ValueError("the offsets do not fit the tokens")
        place = np.arange(offsets[0], ends[-1])
        return self.data[place + np.repeat(self.start[ids] - offsets, sizes)].tobytes()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair makes; NONE for pairs that don't merge or lack a side (below 0)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.made[at], NONE)


def merge_many(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids, as little-endian 32-bit bytes, of slices that aren't tokens: one merge in every slice a round."""
    if not pieces or not len(vocabulary.keys):
        return [np.array(merge(p, vocabulary.ranks), "<u4").tobytes() for p in pieces]
    width = max(map(len, pieces))
    sizes = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
    ids = np.where(np.arange(width) < sizes[:, None], vocabulary.bytes[raw], -1)
    ids = np.pad(ids, ((0, 0), (1, 1)), constant_values=-1)  # a column of nothing at either end
    ranks = vocabulary.rank(ids[:, :-1], ids[:, 1:])
    done: list[bytes] = [b""] * len(pieces)
    row = np.arange(len(pieces))
    while len(row):
        at = ranks.argmin(axis=1)
        least = ranks[np.arange(len(row)), at]
        rest = least != NONE
        if not rest.all():
            ready = ids[~rest]
            used = ready >= 0
            flat, ends = ready[used].astype("<u4").tobytes(), (np.cumsum(used.sum(1)) * 4).tolist()
            for k, a, b in zip(row[~rest].tolist(), [0, *ends], ends):
                done[k] = flat[a:b]
        row, ids, ranks, at, least = row[rest], ids[rest], ranks[rest], at[rest], least[rest]
        if not len(row):
            break
        here = np.arange(len(row))
        ids[here, at] = least
        gone = np.arange(ids.shape[1] - 1) + (np.arange(ids.shape[1] - 1) > at[:, None])
        ids = np.take_along_axis(ids, gone, 1)
        ranks = np.take_along_axis(ranks, gone[:, :-1], 1)
        ranks[here, at - 1] = vocabulary.rank(ids[here, at - 1], ids[here, at])
        ranks[here, at] = vocabulary.rank(ids[here, at], ids[here, at + 1])
    return done


class Merger(Cache):
    """Ids of a slice as little-endian 32-bit bytes; remembers short slices, CACHE bytes of them."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(CACHE)
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        """A slice that isn't remembered: too long for it."""
        return np.array(merge(piece.encode("utf-8", "surrogatepass"), self.vocabulary.ranks), "<u4").tobytes()

    def learn(self, texts: list[list[str]]) -> None:
        """Remember the short slices of some texts, merged together."""
        self.make_room()
        new = [p for p in set().union(*texts) if p not in self and len(p) <= CACHED_CHARS]
        easy: list[tuple[str, bytes]] = []
        hard: dict[bool, list[tuple[str, bytes]]] = {False: [], True: []}
        for p in new:
            data = p.encode("utf-8", "surrogatepass")
            if data in self.vocabulary.ranks:
                easy.append((p, self.vocabulary.ranks[data].to_bytes(4, "little")))
            else:
                hard[len(data) > 16].append((p, data))
        self.update(easy)
        for group in hard.values():  # short ones apart from long ones: rows are as wide as the longest
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                self.update(zip((p for p, _ in part), merge_many([d for _, d in part], self.vocabulary)))

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = list(slices(texts))
        self.learn(parts)
        return [b"".join(map(self.__getitem__, p)) for p in parts]


def _portions(column: pa.Array, chars: int) -> Iterator[tuple[int, list]]:
    """(offset, values) of consecutive portions with about ``chars`` characters or bytes each, at least one value."""
    at, values, size = 0, [], 0
    for k, v in enumerate(column):
        v = v.as_py()
        if values and size + len(v or "") > chars:
            yield at, values
            at, values, size = k, [], 0
        values.append(v)
        size += len(v or "")
    if values:
        yield at, values


def _encode(docs: DataFrame, rank_path: str, id_col: str, text_col: str, offsets: bool, decoded: bool) -> DataFrame:
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(rank_path)))

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(vocabulary.value)
        for batch in batches:
            for at, texts in _portions(batch.column(1), PIECE):
                ids = merger.encode([t or "" for t in texts])
                out = {id_col: batch.column(0).slice(at, len(ids)), "ids": pa.array(ids, pa.binary())}
                if offsets:
                    numbers = [np.frombuffer(x, "<u4") for x in ids]
                    starts = [merger.vocabulary.offsets(x) for x in numbers]
                    out["offsets"] = pa.array([x.astype("<u4").tobytes() for x in starts], pa.binary())
                    if decoded:
                        out["decoded"] = pa.array([merger.vocabulary.decode(x, o) for x, o in zip(numbers, starts)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids binary" + ", offsets binary" * offsets + ", decoded binary" * decoded
    return lean_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, schema)


def bpe_encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(id_col, ids, offsets) of every row of docs, repeated and null ids included.

    ids: the token ids as little-endian unsigned 32-bit integers. offsets: in the same form, the byte of
    the text at which each token begins, so that a range of tokens can be traced and decoded alone; left
    out with offsets=False. Special tokens' strings are ordinary text. Null texts count as empty: no
    ids. Whole texts are read. An empty table gives an empty result; other columns are ignored, whatever
    their names. The rank file (rank_path, read once by the driver) is bounded by its vocabulary.
    """
    return _encode(docs, rank_path, id_col, text_col, offsets, decoded=False)


def bpe_round_trip(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``bpe_encode``'s columns, and ``decoded``: the ids' bytes, each token's placed at its offset; in one pass."""
    return _encode(docs, rank_path, id_col, text_col, offsets=True, decoded=True)


def bpe_decode(encoded: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids", offsets_col: str | None = None) -> DataFrame:
    """encoded's id_col and ids_col, and ``decoded``: the bytes that the ids stand for (null ids: no bytes).

    ids may be any range of a text's tokens. offsets_col: their offsets, by which the bytes are then placed; a token
    that does not end where the next one begins is an error.
    """
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(rank_path)))

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for at, ids in _portions(batch.column(1), 1 << 21):
                numbers = [np.frombuffer(x or b"", "<u4") for x in ids]
                if offsets_col:
                    given = [np.frombuffer(x or b"", "<u4") for x in batch.column(2).slice(at, len(ids)).to_pylist()]
                else:
                    given = [known.offsets(x) for x in numbers]
                decoded = [known.decode(x, o) for x, o in zip(numbers, given)]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(ids)) for c in batch.columns[:2]), pa.array(decoded, pa.binary())], [id_col, ids_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col, *[offsets_col] * bool(offsets_col)).mapInArrow(rows, f"`{id_col}` {kind}, `{ids_col}` binary, decoded binary")
