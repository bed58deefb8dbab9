"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A leaf holds ``LEAF`` neighbouring pre-tokens; the tree keeps for every node the sums of
code points and of tokens below it. An edit replaces ``length`` code points at ``start`` of the
text as earlier edits left it. Descending the tree finds the leaves that it touches. What a
pre-token is depends on the text from its start to two code points behind it, so encoding
starts one leaf early if the edit is within three code points of a leaf's start, and goes on
leaf by leaf until an old leaf border is a border of pre-tokens again; only that region is
encoded again, and the sums on the paths from its leaves to the root are updated.

Defined results: a null text is an empty one; null edits are none, an edit's null start is 0,
a null length 0, a null replacement empty; starts and lengths are clamped to the text; edits
apply in the order of the array; repeated rows are counted each; very long pre-tokens make
long leaves; empty tables give no rows; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import append, default_ranks, merger, pretokenise, slices, with_fields
from .common import table, text_or_empty

LEAF = 64
#: Code points that can decide where the pre-token before them ends.
LOOKAHEAD = 3
ADDED = ("n_tokens", "n_tokens_edited", "n_chars_edited", "chars_encoded_again", "edited_text")


class CountTree:
    """Sums of code points and tokens over leaves, in two arrays of 2 * size nodes; the root is node 1."""

    def __init__(self, leaves: list[str], tokens: list[int]):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.leaves = leaves
        self.sums = [_tree([len(x) for x in leaves], self.size), _tree(tokens, self.size)]

    @property
    def n_chars(self) -> int:
        return self.sums[0][1]

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the code point at a position (or is last), and the position inside it."""
        chars, node = self.sums[0], 1
        while node < self.size:
            node *= 2
            if at >= chars[node] and chars[node + 1]:
                at -= chars[node]
                node += 1
        return node - self.size, at

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        for sums, new in zip(self.sums, (len(text), tokens)):
            node, change = leaf + self.size, new - sums[leaf + self.size]
            while node and change:
                sums[node] += change
                node //= 2


def _tree(values: list[int], size: int) -> list[int]:
    level = np.zeros(size, np.int64)
    level[: len(values)] = values
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
    return [0, *np.concatenate(levels[::-1]).tolist()]


def build(text: str, pieces: list[str], ids_of) -> CountTree:
    counts = ids_of.counts.of(pieces)
    groups = range(0, max(1, len(pieces)), LEAF)
    return CountTree(["".join(pieces[i : i + LEAF]) for i in groups], [sum(counts[i : i + LEAF]) for i in groups])


def _tail(tree: CountTree, last: int) -> str:
    """Enough text behind a leaf to tell whether a pre-token ends with it."""
    tail, k = "", last + 1
    while k < len(tree.leaves) and len(tail) < LOOKAHEAD:
        tail += tree.leaves[k]
        k += 1
    return tail


def _region(tree: CountTree, start: int, length: int, replacement: str) -> tuple[int, int, str]:
    """First and last leaf that an edit touches, and their text after it."""
    n = tree.n_chars
    start = min(max(start, 0), n)
    stop = min(start + max(length, 0), n)
    first, inside = tree.find(start)
    while first and inside < LOOKAHEAD:
        first -= 1
        inside += len(tree.leaves[first])
    last, region = first, tree.leaves[first]
    need = inside + stop - start
    while len(region) < need and last + 1 < len(tree.leaves):
        last += 1
        region += tree.leaves[last]
    return first, last, region[:inside] + replacement + region[need:]


def edit_all(trees: list[CountTree], edits: list[tuple[int, int, str]], ids_of) -> list[int]:
    """Applies one edit (start, length, replacement) to each tree; returns the code points that were encoded again."""
    regions = [_region(t, *e) for t, e in zip(trees, edits)]
    out, open_ = [0] * len(trees), list(range(len(trees)))
    while open_:  # until each region's end is the end of a pre-token
        tails = [_tail(trees[i], regions[i][1]) for i in open_]
        left = []
        for i, tail, (pieces, ends) in zip(open_, tails, pretokenise([regions[i][2] + t for i, t in zip(open_, tails)])):
            tree, (first, last, region) = trees[i], regions[i]
            at = int(np.searchsorted(ends, len(region)))
            if region and tail and not (at < len(ends) and ends[at] == len(region)):
                regions[i] = (first, last + 1, region + tree.leaves[last + 1])
                left.append(i)
                continue
            tree.put(first, region, sum(ids_of.counts.of(pieces[: at + 1])) if region else 0)
            for leaf in range(first + 1, last + 1):
                tree.put(leaf, "", 0)
            out[i] = len(region)
        open_ = left
    return out


def edit(tree: CountTree, start: int, length: int, replacement: str, ids_of) -> int:
    return edit_all([tree], [(start, length, replacement)], ids_of)[0]


def count_tokens(docs: DataFrame, edits: str = "edits", text: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_tokens of the text, and n_tokens_edited, n_chars_edited, chars_encoded_again and edited_text after its edits.

    edits names an array of structs (start, length, replacement).
    """
    path = path or default_ranks()

    def run(batches):
        ids_of = merger(path)
        ids_of.counts.use()
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(text).to_pylist()]
                trees = [build(t, pieces, ids_of) for t, (pieces, _) in zip(texts, pretokenise(texts))]
                before, again = [t.n_tokens for t in trees], [0] * len(trees)
                todo = [[(e["start"] or 0, e["length"] or 0, e["replacement"] or "") for e in es or [] if e is not None] for es in part.column(edits).to_pylist()]
                for k in range(max(map(len, todo), default=0)):  # the k-th edits of all documents together
                    some = [i for i, es in enumerate(todo) if k < len(es)]
                    for i, n in zip(some, edit_all([trees[i] for i in some], [todo[i][k] for i in some], ids_of)):
                        again[i] += n
                rows = [(n, t.n_tokens, t.n_chars, a, "".join(t.leaves)) for n, t, a in zip(before, trees, again)]
                longs = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                yield append(part, dict(zip(ADDED, [*longs, pa.array([r[4] for r in rows], pa.string())])))

    types = [*[T.LongType()] * 4, T.StringType()]
    return docs.mapInArrow(run, with_fields(docs, *map(T.StructField, ADDED, types)))


def sample_edits(n: Column) -> Column:
    """Three edits of a text of n code points: a deletion, an insertion and a replacement."""
    e = lambda start, length, text: F.struct(start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.lit(text).alias("replacement"))
    return F.array(e(F.floor(n / 4), 7, ""), e(F.floor(n / 2), 0, " (edited) "), e(F.floor(n * 3 / 4), 5, "it's\n"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its tokens before and after three edits; the counts after them come from the updated trees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    docs = docs.withColumn("edits", sample_edits(F.length("text")))
    counted = count_tokens(docs)
    return counted.select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "chars_encoded_again", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"))
