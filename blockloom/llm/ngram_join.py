"""N-gram Jaccard join with rare-first prefix, length, positional and suffix filters.

A document's set holds its distinct word n-grams (as 64-bit hashes). Documents of equal sets
are one class, represented by its smallest doc_id. N-grams are ordered from rare to frequent by
a count sketch over all documents (``SKETCH_ROWS`` rows of ``SKETCH_COLUMNS`` counters, a fixed
size, so it is broadcast; any order gives the same links, rare-first gives few candidates). Two
sets of similarity t or more share one of their first n - ceil(t n) + 1 n-grams in that order,
so documents are joined on those. Rows whose n-gram has no other set of a size within t go first;
the join itself applies the other filters: length (sizes within t), position (what can follow a common n-gram), suffix, and first common n-gram, so a pair
comes up about once and not once for each n-gram that it shares (each row carries up to
``BEFORE`` of the shared n-grams before its own; a repeated pair is only dropped later).

The suffix filter halves the hash space again and again; where a part of two sets holds numbers of n-grams
that differ in parity the sets differ there, which bounds their distance from below. Rows of the join
carry the parities of ``DIGEST`` parts; before whole sets of more than ``SMALL_SET`` n-grams are compared, the parities
of parts of about half an n-gram are. Facts of documents meet in blocks of pairs, so they travel once a block. Each pair is
verified once.

``jaccard_links`` returns every verified pair of class representatives, the members of the
classes and the number of links of each document; op1 takes its rows from it. The links of
near copies of one text, all different, are as many as the square of their number: so is that result.
``jaccard_components`` is for callers that want components only (the pipeline) and doesn't grow
so: pairs inside a component that is already known are skipped. In each of ``ROUNDS`` rounds a document meets its neighbour in the list of
each of its prefix n-grams (first by size, then in random orders), of other components only;
the components of verified pairs are merged. What is left then, all candidates between different components, is verified whole. Near copies of
one text thus cost a few verifications each, not one a pair. In that last step the largest
component of an n-gram is not joined with itself.

Defined results: words are runs of bytes other than ASCII white space, with A-Z lower-cased;
a text of fewer words than n has its whole sequence as its one n-gram; null texts and texts
without words have the empty set and no links; a null doc_id has no links and a null
component; rows of one doc_id are one document that has the links of all its rows; repeated
rows stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import SPACE_CHARS, bounded, give_back, materialise, table
from .components import components

WORDS, PERCENT = 5, 80
SKETCH_ROWS, SKETCH_COLUMNS, SKETCH_BLOCK, SKETCH_SLOTS = 2, 1 << 17, 1 << 12, 8
ROUNDS = 2
#: Parts of the hash space with a parity in each row of the join, four 64-bit numbers; shared n-grams that a row carries.
DIGEST, BEFORE = 256, 4
#: N-grams of sets that are compared without a look at their finer parities first.
SMALL_SET = 256
#: Documents of a block of verification; bytes that are hashed at once; bytes of a word beyond which xxhash hashes it.
BLOCK, PIECE, LONG_WORD = 64, 1 << 17, 64
SHORT = ["d0", "d1", "d2", "d3"]
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(1)
def _byte_codes() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number of each byte, A to Z as a to z, and which bytes are white space."""
    b = np.arange(256, dtype=np.uint64)
    lower = np.where((b >= 65) & (b <= 90), b + np.uint64(32), b)
    return _mix((lower + np.uint64(1)) * M2), np.isin(b, np.frombuffer(SPACE_CHARS.encode(), np.uint8))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(M1), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (M1, inverse))


def _sums(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For words from a to before b: the sums of their codes times powers that count from the word's start."""
    power, inverse = _powers(PIECE + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=total[1:])
    return (total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and starts of the words of bytes: differences of running sums of byte codes times powers; long words by xxhash."""
    import xxhash

    codes, spaces = _byte_codes()
    inside = np.diff(~spaces[data], prepend=False, append=False)
    starts, ends = np.flatnonzero(inside).reshape(-1, 2).T
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE)))
        a, b = starts[i:j] - base, ends[i:j] - base
        if b[-1] <= PIECE:  # else it is one long word
            out[i:j] = _sums(codes[data[base : base + b[-1]]], a, b)
        i = j
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().lower())
    return out, starts


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M2
    return (h ^ (h >> np.uint64(29))) * M1 ^ (h >> np.uint64(32))


def runs_of(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words, or of all words where they are fewer."""
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = _mix(h * M1 + words[i : len(words) - n + 1 + i])
    return h


def words_of(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text the hashes of its words, in order."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, starts = word_hashes(np.frombuffer(b"\n".join(raw), np.uint8))
    edges = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)])).tolist()
    return [words[a:b] for a, b in zip(edges, edges[1:])]


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Of each text the distinct n-grams as ascending 64-bit hashes."""
    words = words_of(texts)
    runs, at, out = runs_of(np.concatenate([*words, np.zeros(n, np.uint64)]), n), 0, []
    for w in words:
        if len(w):
            h = np.sort(runs[at : at + len(w) - n + 1] if len(w) >= n else runs_of(w, n))
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        else:
            out.append(np.zeros(0, np.uint64))
        at += len(w)
    return out


def shingles(text: str | None, n: int) -> np.ndarray:
    return shingle_sets([text], n)[0]


def _columns(h: np.ndarray, row: int) -> np.ndarray:
    return (h >> np.uint64(20 * row)).astype(np.int64) & (SKETCH_COLUMNS - 1)


def digest(grams: np.ndarray) -> np.ndarray:
    """Parities of the numbers of n-grams in the DIGEST parts of the hash space."""
    return np.packbits(np.bincount((grams >> np.uint64(13)).astype(np.int64) & (DIGEST - 1), minlength=DIGEST) & 1, bitorder="little").view("<i8")


def parity(grams: np.ndarray) -> bytes:
    """The same for halves of halves down to about half an n-gram a part."""
    parts = 1 << min(24, max(6, (2 * len(grams) - 1).bit_length()))
    return np.packbits(np.bincount((grams >> np.uint64(13)).astype(np.int64) & (parts - 1), minlength=parts) & 1, bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Of two parities: n-grams that just one of the sets has, at least. The finer one is folded."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


DESCRIBED = ["doc_id", "n", "k1", "k2", "parity", *SHORT, "counts"]


def describe(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (doc_id, n, k1, k2, parity, d0 to d3) and, with a null n, of sketch counters (k1: slot, k2: block, counts)."""

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        counts = np.zeros((SKETCH_ROWS, SKETCH_COLUMNS), np.int64)
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text").to_pylist(), n)
                if held := [s for s in sets if len(s)]:
                    every = np.concatenate(held)
                    for row in range(SKETCH_ROWS):
                        counts[row] += np.bincount(_columns(every, row), minlength=SKETCH_COLUMNS)
                keys = np.array([(d >> 64, d & (2**64 - 1)) for d in (xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets)], np.uint64).reshape(-1, 2).view(np.int64)
                short = np.array([digest(s) for s in sets], np.int64).reshape(-1, len(SHORT))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([parity(s) for s in sets], pa.binary()), *map(pa.array, np.ascontiguousarray(short.T)), pa.nulls(len(sets), pa.binary())],
                    names=DESCRIBED,
                )
        flat = np.minimum(counts, 2**32 - 1).astype("<u4").reshape(-1, SKETCH_BLOCK)
        slot = TaskContext.get().partitionId() % SKETCH_SLOTS
        full = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.int64()), pa.array([slot] * len(full), pa.int64()), pa.array(full), pa.nulls(len(full), pa.binary()), *[pa.nulls(len(full), pa.int64())] * len(SHORT), pa.array([flat[i].tobytes() for i in full], pa.binary())],
            names=DESCRIBED,
        )

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, parity binary, d0 long, d1 long, d2 long, d3 long, counts binary")


def sketch(rows: DataFrame) -> np.ndarray:
    """The whole sketch as levels (log2 of the counters): at most SKETCH_SLOTS rows a block reach the driver."""

    def add(key, group):
        total = sum((np.frombuffer(c.as_py(), "<u4").astype("<u8") for c in group.column("counts")), np.zeros(SKETCH_BLOCK, "<u8"))
        return pa.table({"block": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = rows.where(F.col("n").isNull()).select("k1", "k2", "counts").groupBy("k1", "k2").applyInArrow(add, "block long, counts binary")
    out = np.zeros((SKETCH_ROWS * SKETCH_COLUMNS // SKETCH_BLOCK, SKETCH_BLOCK), np.uint64)
    for r in parts.collect():
        out[r["block"]] += np.frombuffer(r["counts"], "<u8")
    return np.ceil(np.log2(np.maximum(out, 1).astype(float))).astype(np.uint8).reshape(SKETCH_ROWS, SKETCH_COLUMNS)


def prefixes(docs: DataFrame, levels, n: int, percent: int) -> DataFrame:
    """(gram, id, n, at): the first n-grams of each document from rare to frequent, with their positions."""

    def run(batches):
        level = levels.value
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text").to_pylist(), n)
                every = np.concatenate([*sets, np.zeros(0, np.uint64)])
                rank = functools.reduce(np.minimum, (level[row][_columns(every, row)] for row in range(SKETCH_ROWS)))
                order = rank.astype(np.uint64) << np.uint64(57) | every >> np.uint64(7)
                ends = np.cumsum([len(s) for s in sets]).tolist()
                gram, sizes = [], [prefix_length(len(s), percent) if len(s) else 0 for s in sets]
                for s, k, end in zip(sets, sizes, ends):
                    if k:
                        gram.append(s[np.argsort(order[end - len(s) : end], kind="stable")[:k]])
                if gram:
                    columns = [np.concatenate(gram).view(np.int64), np.repeat(part.column("id").to_numpy(), sizes), np.repeat(np.array([len(s) for s in sets], np.int32), sizes), np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["gram", "id", "n", "at"])

    return docs.mapInArrow(run, "gram long, id long, n int, at int")


def overlap_needed(na: Column, nb: Column, percent: int) -> Column:
    """Least common n-grams of sets of these sizes: ceil(t (na + nb) / (1 + t))."""
    return F.ceil((na + nb) * percent / F.lit(100.0 + percent) - 1e-9)


def possible(x: str, y: str, percent: int) -> Column:
    """Whether joined rows of a common n-gram may be a pair: length, positional and suffix filter."""
    return placed_well(x, y, percent) & alike(x, y, percent)


def placed_well(x: str, y: str, percent: int) -> Column:
    """The length and the positional filter, for rows without digests."""
    nx, ny = (F.col(f"{side}.n").cast("long") for side in (x, y))
    length = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
    return length & (F.least(nx - F.col(f"{x}.at"), ny - F.col(f"{y}.at")) >= overlap_needed(nx, ny, percent))


def alike(x: str, y: str, percent: int) -> Column:
    """The suffix filter. A row without digest passes it."""
    nx, ny = (F.col(f"{side}.n").cast("long") for side in (x, y))
    apart = sum((F.bit_count(F.col(f"{x}.{d}").bitwiseXOR(F.col(f"{y}.{d}"))) for d in SHORT), F.lit(0))
    return F.coalesce(apart <= nx + ny - 2 * overlap_needed(nx, ny, percent), F.lit(True))


def met_before(x: str, y: str) -> Column:
    """Whether joined rows have a common n-gram before this one, as far as they carry them."""
    return F.coalesce(F.arrays_overlap(F.col(f"{x}.before"), F.col(f"{y}.before")), F.lit(False))


def ordered(x: str, y: str) -> list[Column]:
    """Columns of a pair with the smaller id as a."""
    less = F.col(f"{x}.id") < F.col(f"{y}.id")
    pick = lambda name, first: F.when(less if first else ~less, F.col(f"{x}.{name}")).otherwise(F.col(f"{y}.{name}"))
    return [pick(name, first).alias(to + side) for side, first in (("a", True), ("b", False)) for name, to in (("id", ""), ("component", "c"))] + [larger(x, y)]


def larger(x: str, y: str) -> Column:
    return F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n")).cast("long").alias("n")


PAIR = ["a", "b", "ca", "cb", "n"]


def in_blocks(pairs: DataFrame) -> DataFrame:
    """Pairs with a block, in which pairs of few documents meet: documents of one least neighbour, dealt by hash."""
    ends = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    keys = ends.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("key"))
    dealt = keys.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.xxhash64("key", F.pmod(F.xxhash64("id"), F.col("blocks")))
    blocks = materialise(keys.join(dealt, "key").select("id", block.alias("block")))
    side = lambda k: blocks.select(F.col("id").alias(k), F.col("block").alias(f"b{k}"))
    return materialise(pairs.join(side("a"), "a").join(side("b"), "b").select(*PAIR, F.xxhash64("ba", "bb").alias("block")))


def passing(placed: DataFrame, facts: DataFrame, test) -> DataFrame:
    """Pairs in blocks of which two facts (home, id, fact binary) pass test(x, y). A fact travels once a block and not once a pair."""

    def run(pairs: pa.Table, facts: pa.Table) -> pa.Table:
        of = {}
        for i, x in zip(facts.column("id").to_pylist(), facts.column("fact")):
            of.setdefault(i, []).append(x.as_buffer())
        keep = [any(test(x, y) for x in of[a] for y in of[b]) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())]
        return pairs.select([*PAIR, "block"]).filter(pa.array(keep, pa.bool_()))

    return materialise(placed.groupBy("block").cogroup(facts.groupBy("home")).applyInArrow(run, "a long, b long, ca long, cb long, n long, block long"))


def homes_of(placed: DataFrame) -> DataFrame:
    """(id, homes): the blocks that need a document's fact. Few bytes, so they go to the facts, which are not shuffled for it."""
    ends = placed.select("a", "block").unionByName(placed.select(F.col("b").alias("a"), "block"))
    return bounded(materialise(ends.groupBy(F.col("a").alias("id")).agg(F.collect_set("block").alias("homes"))))


def verify(pairs: DataFrame, facts: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(u, v): components ca and cb of the pairs (a, b) whose sets are similar enough; facts (id, n, parity) and texts (id, text) of all documents."""

    def near(x, y) -> bool:
        (m, k), x, y = (int.from_bytes(z[:8], "big") for z in (x, y)), x[8:], y[8:]
        return least_difference(x, y) <= m + k - 2 * -(-percent * (m + k) // (100 + percent))

    def similar(x, y) -> bool:
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    def grams(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("homes"), pa.array([s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), n)], pa.binary())], names=["id", "homes", "fact"])

    sent = lambda facts: facts.select(F.explode("homes").alias("home"), "id", "fact")
    size = F.unhex(F.lpad(F.hex("n"), 16, "0"))
    placed = in_blocks(pairs)
    large = placed.where(F.col("n") > SMALL_SET)
    large = passing(large, sent(facts.join(homes_of(large), "id").select("id", "homes", F.concat(size, F.col("parity")).alias("fact"))), near)
    pairs = placed.where(F.col("n") <= SMALL_SET).unionByName(large)
    sets = texts.join(homes_of(pairs), "id").select("id", "homes", "text").mapInArrow(grams, "id long, homes array<long>, fact binary")
    return passing(pairs, sent(sets), similar).select(F.col("ca").alias("u"), F.col("cb").alias("v")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after links between components."""
    new = components(links).select(F.col("v").alias("component"), F.col("component").alias("into"))
    joined = labels.join(bounded(materialise(new)), "component", "left")
    return materialise(joined.select("id", F.coalesce("into", "component").alias("component")))


def lagged(order, *columns: str) -> Column:
    """Columns of the row before; of nulls where there is none. A struct that is lagged as a whole would be shuffled beside its columns."""
    return F.struct(*[F.lag(c).over(order).alias(c) for c in columns])


def prepared(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, ...]:
    """Described rows, their facts (id, n, parity), members (doc_id, id, n) of classes, texts of representatives, their shared prefix n-grams (gram, id, n, at, last: the set before it in the n-gram's list by size), digests of documents of one row, classes of one doc_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = materialise(describe(docs, n))
    levels = spark.sparkContext.broadcast(sketch(described))
    rows = described.where(F.col("n").isNotNull()).select("doc_id", "n", "k1", "k2", *SHORT)
    known = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    named = materialise(known.join(classes, ["k1", "k2"]).select("doc_id", "id", "n"))
    copies = materialise(named.groupBy("doc_id").agg(F.max(F.when(F.col("doc_id") == F.col("id"), 1).otherwise(0)).alias("own")).where("own = 0").select("doc_id"))
    texts = docs.where(F.col("doc_id").isNotNull()).join(bounded(copies), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "text")

    # The length filter for whole lists: a row stays if the next smaller or larger set of its n-gram is near enough in size.
    by_size = Window.partitionBy("gram").orderBy("n", "id")
    near = [of("n").over(by_size).cast("long").alias(name) for of, name in ((F.lag, "smaller"), (F.lead, "larger"))] + [lagged(by_size, "id", "n", "at").alias("last")]
    shared = prefixes(texts, levels, n, percent).select("*", *near)
    size = F.col("n").cast("long")
    shared = shared.where((F.col("smaller") * 100 >= size * percent) | (size * 100 >= F.col("larger") * percent)).select("gram", "id", "n", "at", "last")
    # A doc_id of several rows has no single digest, nor one order of its n-grams: its rows pass these filters.
    single = known.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n"), *[F.min(d).alias(d) for d in SHORT]).where("rows = 1").drop("rows")
    facts = described.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "n", "parity")
    same_id = named.groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).where("u <> v").select("u", "v")
    return rows, facts, named, texts, shared, single, same_id


def with_digests(posted: DataFrame, single: DataFrame) -> DataFrame:
    """Rows of n-grams with the digests of their documents and the n-grams of theirs that are just before."""
    placed = posted.join(single.drop("n"), "id", "left")
    before = F.collect_list("gram").over(Window.partitionBy("id").orderBy("at").rowsBetween(-BEFORE, -1))
    return materialise(placed.withColumn("before", F.when(F.col("d0").isNotNull(), before)))


ROW = ["id", "n", "at", *SHORT, "before"]


def with_components(rows: DataFrame, named: DataFrame, labels: DataFrame) -> DataFrame:
    ids = named.select("doc_id", "id", "n").join(labels, "id")
    placed = ids.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = rows.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone)


def jaccard_links(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All links of documents (doc_id, text).

    pairs (u, v): every two classes of different sets that are similar enough, by the ids of their
    representatives, u < v. members (doc_id, id, n): the class of each row. links (doc_id,
    n_links): rows that a document is linked to, those of its own set and of linked
    classes, counted for each of its classes. components (doc_id, n_shingles, component_id).
    """
    rows, facts, named, texts, shared, single, same_id = prepared(docs, n, percent)
    posted = with_digests(shared.drop("last"), single)
    side = lambda k: posted.select("gram", F.struct(*ROW).alias(k))
    met = side("x").join(side("y"), "gram").where((F.col("x.id") < F.col("y.id")) & possible("x", "y", percent) & ~met_before("x", "y"))
    found = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), larger("x", "y")).dropDuplicates(["a", "b"])
    found = materialise(found.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"), "n"))
    pairs = materialise(verify(found, facts, texts, n, percent))

    sizes = named.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    classes = both.groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("classes"))
    # Most classes have one row: only those of more are looked up.
    more = sizes.where("size > 1").select(F.col("id").alias("v"), (F.col("size") - 1).alias("more"))
    copies = both.join(more, "v").groupBy(F.col("u").alias("id")).agg(F.sum("more").alias("copies"))
    none = F.lit(0).cast("bigint")
    per_class = sizes.join(classes, "id", "left").join(copies, "id", "left").select("id", (F.col("size") - 1 + F.coalesce("classes", none) + F.coalesce("copies", none)).alias("n_links"))
    links = named.select("doc_id", "id").distinct().join(per_class, "id").groupBy("doc_id").agg(F.sum("n_links").alias("n_links"))
    labels = merged(named.select("id").distinct().withColumn("component", F.col("id")), pairs.unionByName(same_id))
    return pairs, named, links, with_components(rows, named, labels)


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text).

    Neighbours in the lists of n-grams, by size and then by chance, are linked first. After that only lists
    of several components are looked at, and only their rows get digests: few n-grams travel, and those without them.
    """
    rows, facts, named, texts, shared, single, same_id = prepared(docs, n, percent)
    posted = materialise(shared)
    give_back(docs.sparkSession)
    labels = materialise(named.select("id").distinct().withColumn("component", F.col("id")))
    known = materialise(same_id)

    def step(found: DataFrame) -> DataFrame:
        """Verifies the pairs found; merges labels by them and by what else is known; returns the pairs that it tried."""
        nonlocal labels, known
        found = materialise(found)
        links = verify(found, facts, texts, n, percent) if not found.isEmpty() else None
        links = links if known is None or known.isEmpty() else known if links is None else links.unionByName(known)
        known = None
        if links is not None:
            give_back(docs.sparkSession)
            labels = merged(labels, links)
        links = None
        give_back(docs.sparkSession)
        return found.select("a", "b")

    def neighbours(lists: DataFrame) -> DataFrame:
        """Pairs of rows x and y (id, n, at, component) that no filter drops; the digests meet the pairs."""
        near = lists.where((F.col("x.component") != F.col("y.component")) & placed_well("x", "y", percent)).select(*ordered("x", "y")).dropDuplicates(["a", "b"])
        digests = lambda k: single.select(F.col("id").alias(k), F.struct("n", *SHORT).alias(f"of_{k}"))
        return near.join(digests("a"), "a", "left").join(digests("b"), "b", "left").where(alike("of_a", "of_b", percent)).select(*PAIR)

    row = lambda of="": F.struct(*[F.col(of + c).alias(c) for c in ("id", "n", "at")], F.col(of + "id").alias("component"))
    tried = step(neighbours(posted.select(row().alias("y"), row("last.").alias("x"))))

    lists = Window.partitionBy("gram")
    for turn in range(1, ROUNDS):
        by_chance = lists.orderBy(F.xxhash64("gram", "id", F.lit(turn)), "id")
        mine = ["id", "n", "at", "component"]
        several = F.min("component").over(lists) != F.max("component").over(lists)
        placed = posted.select("gram", "id", "n", "at").join(labels, "id").withColumn("last", lagged(by_chance, *mine)).withColumn("several", several)
        posted = materialise(placed.where("several").drop("several"))
        new = step(neighbours(posted.select(F.struct(*mine).alias("y"), F.col("last").alias("x"))).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(new)

    placed = materialise(posted.select("gram", "id", "n", "at").join(labels, "id"))
    sizes = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = sizes.groupBy("gram").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("size", "component")).alias("main")).where("parts > 1").select("gram", "main")
    inside = with_digests(placed.join(mixed, "gram"), single)
    side = lambda k, df: df.select("gram", "main", F.struct(*ROW, "component").alias(k))
    crossed = side("x", inside.where("component <> main")).join(side("y", inside).drop("main"), "gram")
    apart = (F.col("x.component") != F.col("y.component")) & possible("x", "y", percent) & ~met_before("x", "y")
    pairs = crossed.where(apart & ((F.col("y.component") == F.col("main")) | (F.col("x.id") < F.col("y.id")))).select(*ordered("x", "y")).dropDuplicates(["a", "b"])
    step(pairs.join(tried, ["a", "b"], "left_anti"))

    return with_components(rows, named, labels)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, links, placed = jaccard_links(table(spark, sf_dir, "documents"), n=3, percent=90)
    return placed.join(links, "doc_id", "left").select(*placed.columns, F.coalesce("n_links", F.lit(0)).alias("n_links"))


OP1_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
g AS (
  SELECT DISTINCT doc_id, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS gram FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM w WHERE len(l) >= 3)
  UNION SELECT doc_id, array_to_string(l, ' ') FROM w WHERE len(l) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
lk AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, lk.b FROM reach r JOIN lk ON r.other = lk.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM lk GROUP BY a) l USING (doc_id)
"""
