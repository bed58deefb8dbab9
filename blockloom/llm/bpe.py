"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A batch of texts becomes one array of code points. A class array (letter, number, white
space, other, plus apostrophes that open a contraction and the last white space of a run,
which need a look at the following characters) turns each character into a transition
function on nine states. Function composition is associative, so the batch is cut into
rows, each row's function is composed for all rows side by side, the rows' functions are
combined by a doubling scan, and a last pass with known start states marks where
pre-tokens begin. No regular expression runs. The slices go through a cache of merged
pairs; what a batch has besides is merged side by side, the lowest pair of every
pre-token in each round. Ids are kept as little-endian unsigned 32-bit integers with the
code-point and id offset of every pre-token, which suffices to decode any part.

Defined results: a null text is an empty one and has no ids; ids exist for all 256 single
bytes, so every text encodes and decodes to exactly its UTF-8 bytes; very long pre-tokens
are merged with a heap in n log n; texts that spell special tokens are ordinary text;
repeated rows and empty tables need nothing special; columns of the input are kept and
an existing column of an output's name is replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import math
import sys
import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, table

#: Classes of characters, and the states after a character.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, BLANKS, LAST_SPACE, LAST_OTHER, BREAK = range(9)
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, CLOSED, NEED_1, NEED_2, NEED_1_OF_2 = range(9)
#: Characters that \s stands for (Unicode White_Space).
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers (ranges) that Unicode 16.0 has beyond 15.1, which Python 3.13 knows; tiktoken has them.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Bytes of the cache of numbers of tokens: where only numbers are wanted, a word takes little and new words are most of the work.
COUNTS_BYTES = 256 << 20
#: Bytes of the cache of ids.
IDS_BYTES = 64 << 20
#: Pre-tokens that are merged side by side, at least and at most; bytes of a pre-token beyond which it is merged with a heap; ids that are decoded at once.
SIDE_BY_SIDE, MOST_SIDE_BY_SIDE, LONG_PIECE, DECODED_IDS = 32, 1 << 13, 100, 1 << 16
#: Stands for no rank; ranks are below it.
NO_RANK = 1 << 30
#: Code points of a scan at once, most columns of its table.
SCAN_CHARS, SCAN_COLUMNS = 1 << 19, 256


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(1)
def _class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[list(WHITE)] = BLANKS
    return out


@functools.lru_cache(1)
def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether the character begins a pre-token, each by class * 9 + state."""
    step, begins = np.zeros((9, 9), np.uint8), np.ones((9, 9), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE1: NEED_1, QUOTE2: NEED_2}
    for c, fresh in run.items():
        step[c] = fresh
        joined = IN_OTHERS if c in (QUOTE1, QUOTE2) else fresh
        for s in (joined, AFTER_SPACE):
            step[c, s], begins[c, s] = joined, False
    for s, to in ((NEED_1, CLOSED), (NEED_2, NEED_1_OF_2), (NEED_1_OF_2, CLOSED)):
        step[LETTER, s], begins[LETTER, s] = to, False
    step[BLANKS], begins[BLANKS, IN_BLANKS] = IN_BLANKS, False
    step[LAST_SPACE] = AFTER_SPACE
    step[LAST_OTHER] = step[BREAK] = CLOSED
    return step.reshape(-1), begins.reshape(-1)


def _begins(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; breaks: positions of the separators between texts."""
    c = _class_table()[codes]
    c[breaks] = BREAK
    last = (c[:-1] == BLANKS) & (c[1:] != BLANKS) & (c[1:] != BREAK)
    c[:-1][last] = np.where(codes[:-1][last] == 32, LAST_SPACE, LAST_OTHER)
    at = np.flatnonzero(codes == 39)
    if len(at):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = padded[at + 1], padded[at + 2]
        short = np.isin(a, [ord(x) for x in "stmd"])
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        c[at[short]], c[at[long & ~short]] = QUOTE1, QUOTE2
    step, begins = _transitions()
    columns = min(SCAN_COLUMNS, max(8, math.isqrt(len(c))))  # about square, so short texts take few steps
    rows = -(-len(c) // columns)
    grid = np.full(rows * columns, BREAK, np.uint8)
    grid[: len(c)] = c
    grid = np.ascontiguousarray(grid.reshape(rows, columns).T).astype(np.intp) * 9
    # A row's function from its start to its end. White space leads every state to the same one, so
    # the function of a row that has some is constant and one start state shows it.
    ends = np.full(rows, CLOSED, np.uint8)
    for col in grid:
        ends = step.take(col + ends)
    f = np.repeat(ends[None], 9, axis=0)
    if len(open_rows := np.flatnonzero((grid < BLANKS * 9).all(axis=0))):
        part = np.repeat(np.arange(9, dtype=np.uint8)[:, None], len(open_rows), axis=1)
        for col in grid[:, open_rows]:
            part = step.take(col + part)
        f[:, open_rows] = part
    shift = 1
    while shift < rows:  # prefix composition over the rows
        f[:, shift:] = np.take_along_axis(f[:, shift:], f[:, :-shift].astype(np.intp), axis=0)
        shift *= 2
    state = np.concatenate([[CLOSED], f[CLOSED, :-1]]).astype(np.uint8)
    out = np.empty((columns, rows), bool)
    for k, col in enumerate(grid):
        at = col + state
        out[k] = begins.take(at)
        state = step.take(at)
    return out.T.reshape(-1)[: len(c)]


def pretokenise(texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
    """Of each text the pre-tokens and the code points up to the end of each."""
    out: list = []
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= SCAN_CHARS):
            n += len(texts[j]) + 1
            j += 1
        joined = "\0".join(texts[i:j]) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        breaks = np.cumsum([len(t) + 1 for t in texts[i:j]]) - 1
        starts = np.flatnonzero(_begins(codes, breaks))
        first = np.searchsorted(starts, breaks)  # each separator begins a slice of its own
        positions = starts.tolist()
        pieces = [joined[a:b] for a, b in zip(positions, positions[1:])]
        k, base = 0, 0
        for f, end in zip(first.tolist(), breaks.tolist()):
            out.append((pieces[k:f], starts[k + 1 : f + 1] - base))
            k, base = f + 1, end + 1
        i = j
    return out


class Counts(Cache):
    """Cache of pre-token to its number of tokens, by a function that gives its ids."""

    def __init__(self, merge):
        super().__init__(COUNTS_BYTES)
        self.merge = merge

    def __missing__(self, piece: str) -> int:
        n = self.old.get(piece)
        return self.keep(piece, len(self.merge(piece)) if n is None else n)

    def of(self, pieces: list[str]) -> list[int]:
        return list(map(self.__getitem__, pieces))


class Merger(Cache):
    """Cache of pre-token to ids; merges what it does not hold."""

    def __init__(self, path: str):
        super().__init__(IDS_BYTES)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.counts = Counts(self.merge)

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of ids (ascending, in 64 bits) whose bytes are a token, and its rank; the same of two bytes as a table; ids of bytes."""
        get = self.ranks.get
        found = [(a << 32 | b, r) for raw, r in self.ranks.items() for i in range(1, len(raw)) if (a := get(raw[:i])) is not None and (b := get(raw[i:])) is not None]
        keys, ranks = np.array(sorted(found), np.int64).reshape(-1, 2).T.copy()
        two = np.array([get(bytes((a, b)), NO_RANK) for a in range(256) for b in range(256)], np.int64)
        return keys, ranks, two, np.array([self.ranks[bytes((b,))] for b in range(256)], np.int64)

    @functools.cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens in a row; by id, where a token's begin and how many they are."""
        sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
        sizes[list(self.ranks.values())] = list(map(len, self.ranks))
        raw = b"".join(sorted(self.ranks, key=self.ranks.get))
        return np.frombuffer(raw, np.uint8), np.cumsum(sizes) - sizes, sizes

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.old.get(piece)) is not None:
            return self.keep(piece, ids)
        return self.keep(piece, np.array(self.merge(piece), "<u4").tobytes())

    def merge(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        rank = self.ranks.get(raw)
        return [rank] if rank is not None else self._merge(raw) if len(raw) <= LONG_PIECE else self._merge_long(raw)

    def learn(self, pieces: list[str]) -> None:
        """Merges side by side what the cache does not hold of the pre-tokens; tokens, long ones and few ones are left to a look-up."""
        old, ranks = self.old, self.ranks
        new = set(itertools.filterfalse(self.__contains__, pieces))
        several = [(p, r) for p in new if p not in old and (r := p.encode("utf-8")) not in ranks and len(r) <= LONG_PIECE]
        if len(several) >= SIDE_BY_SIDE:
            for i in range(0, len(several), MOST_SIDE_BY_SIDE):
                some, part = zip(*several[i : i + MOST_SIDE_BY_SIDE])
                ids = self._merge_many(part)
                self.update(zip(some, ids))
                self.added(0, sum(map(sys.getsizeof, some)) + sum(map(sys.getsizeof, ids)) + 100 * len(ids))

    def _merge_many(self, raws: Sequence[bytes]) -> list[bytes]:
        """Ids of each of the byte strings, none of them empty."""
        keys, ranks, two, single = self.pairs
        data = np.frombuffer(b"".join(raws), np.uint8)
        token, piece = single[data], np.repeat(np.arange(len(raws)), [len(r) for r in raws])

        def rank_at(i: np.ndarray) -> np.ndarray:
            """Of the pairs that begin there and end in the same piece."""
            j = np.minimum(i + 1, len(token) - 1)
            key = token[i] << 32 | token[j]
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where((keys[k] == key) & (piece[i] == piece[j]) & (i < j), ranks[k], NO_RANK)

        pair = np.full(len(token), NO_RANK, np.int64)
        pair[:-1] = np.where(piece[:-1] == piece[1:], two[data[:-1].astype(np.intp) << 8 | data[1:]], NO_RANK)
        ended = []
        while len(token):
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            low = np.minimum.reduceat(pair << 32 | np.arange(len(token)), starts)  # the lowest rank, and where it is first
            going = low >> 32 < NO_RANK
            kept = np.repeat(going, np.diff(starts, append=len(token)))
            ended.append((piece[~kept], token[~kept]))
            low = low[going]
            at = low & 0xFFFFFFFF
            token[at] = low >> 32
            kept[at + 1] = False
            at = np.cumsum(kept)[at] - 1
            token, piece, pair = token[kept], piece[kept], pair[kept]
            pair[at] = rank_at(at)
            left = at[at > 0] - 1
            pair[left] = rank_at(left)
        piece, token = map(np.concatenate, zip(*ended))
        token = token[np.argsort(piece, kind="stable")].astype("<u4").tobytes()
        ends = np.cumsum(4 * np.bincount(piece, minlength=len(raws))).tolist()
        return [token[a:b] for a, b in zip([0, *ends], ends)]

    def _merge(self, raw: bytes) -> list[int]:
        get, none = self.ranks.get, 1 << 60
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pair = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pair and (low := min(pair)) < none:
            i = pair.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pair[i - 1] = get(parts[i - 1] + parts[i], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        n, get = len(raw), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that starts here; 0: gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := get(raw[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: bytes) -> bytes:
        raw, starts, sizes = self.spelled
        every, out = np.frombuffer(ids, "<u4"), []
        for k in range(0, len(every), DECODED_IDS):
            part = every[k : k + DECODED_IDS]
            n = sizes[part]
            ends = np.cumsum(n)
            out.append(raw[np.repeat(starts[part] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


@functools.lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def with_fields(df: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *fields])


def slices(batch: pa.RecordBatch, rows: int = 256):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def append(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns.values()], names=[*kept, *columns])


def encode(docs: DataFrame, text: str = "text", path: str | None = None, decoded: bool = False, offsets: bool = True) -> DataFrame:
    """Adds ids, n_tokens and, unless told not to, offsets (for each pre-token the ends in code points and in ids, 32-bit pairs).

    decoded: also the bytes that the ids decode to, as decode() gives them, without a second pass of workers.
    """
    path = path or default_ranks()

    def run(batches):
        ids_of = merger(path).use()
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(text).to_pylist()]
                ids, places = [], []
                found = pretokenise(texts)
                ids_of.learn(list(itertools.chain.from_iterable(pieces for pieces, _ in found)))
                for pieces, ends in found:
                    each = [ids_of[p] for p in pieces]
                    ids.append(b"".join(each))
                    if offsets:
                        pairs = np.empty((len(each), 2), "<u4")
                        pairs[:, 0] = ends
                        pairs[:, 1] = np.cumsum([len(e) >> 2 for e in each]) if each else 0
                        places.append(pairs.tobytes())
                columns = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) >> 2 for x in ids], pa.int64())}
                columns |= {"offsets": pa.array(places, pa.binary())} if offsets else {}
                columns |= {"decoded": pa.array([ids_of.decode(x) for x in ids], pa.binary())} if decoded else {}
                yield append(part, columns)

    fields = [("ids", T.BinaryType()), ("n_tokens", T.LongType())] + [("offsets", T.BinaryType())] * offsets + [("decoded", T.BinaryType())] * decoded
    return docs.mapInArrow(run, with_fields(docs, *[T.StructField(*f) for f in fields]))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds decoded, the bytes that the column ids stands for; null ids give null."""
    path = path or default_ranks()

    def run(batches):
        tokens = merger(path).use()
        for batch in batches:
            for part in slices(batch):
                yield append(part, {"decoded": pa.array([None if x is None else tokens.decode(x) for x in part.column("ids").to_pylist()], pa.binary())})

    return encoded.mapInArrow(run, with_fields(encoded, T.StructField("decoded", T.BinaryType())))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True, offsets=False)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
