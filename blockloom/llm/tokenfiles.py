"""Token-ID files: one zstandard frame a document, compressed with one shared dictionary.

Writing: texts are encoded with a public tokenizer, the end id is appended, the ids are
serialized (16-bit little-endian while the vocabulary fits, else 32-bit). A dictionary is
trained with zstandard on the serialized ids of at most ``SAMPLE_DOCS`` documents (those with the
smallest hash of their id, if they have at most ``SAMPLE_CHARS`` characters; a documented bound) and has at most ``DICT_BYTES``. Documents are
compressed one by one where they are encoded, so only compressed bytes are shuffled; ranges
of doc_id become files, each written by one task in ascending doc_id order, frame by frame: a task
holds the index of its file, not its frames.

File: 8 bytes magic, then the frames, then the index (for each document doc_id as int64, a
flag for a null doc_id, byte offset and number of ids as int64, all little-endian), then a
footer of index offset, document count, id width (three int64), the SHA-256 of the
dictionary and the magic again. The dictionary is a file of its own beside them. A reader
needs the footer and the index to fetch a single document by one range read.

Reading: one task a file; the first document of a file starts after the ids of all files
before it, a running sum over one row per file.

Defined results: a null text is an empty one and has just the end id; rows with a null
doc_id come first; rows of one doc_id are ordered by their ids; repeated rows count each;
an empty table gives no files and no rows. Where no dictionary can be trained (too few
documents) frames are compressed without one and the dictionary file is empty.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import Cache, materialise, range_bounds, range_bucket, shared_dir, table

SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES, LEVEL = 1000, 100_000, 112_640, 3
MAGIC = b"BLOOMTK1"
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<i8"), ("n", "<i8")])
FOOTER = "<qqq32s8s"
#: Documents of a file, and files at most: beyond that files grow, not what a task holds but for the index.
ROWS_PER_FILE, FILES = 20_000, 32768
#: Bytes of the cache of pieces, and of the longest piece in it.
CACHE_BYTES, CACHED_BYTES = 288 << 20, 48
#: Punctuation that is cut off the ends of new pieces.
ENDS = ".,;:!?*#$&)\"-"
#: A new piece of white space, a word (with its space) of letters that every version of Unicode has, and punctuation.
PLAIN = re.compile(f"([ \\t\\n\\r]{{0,16}}?)( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([{re.escape(ENDS)}]{{0,3}})")
#: Separators of pieces whose ids are held.
SEPARATORS = 10_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _no_cut() -> np.ndarray:
    """By two bytes: whether they may end with white space; where they do so by chance a text is just not cut."""
    out = np.zeros((256, 256), bool)
    out[:, [*range(9, 14), 32]] = True
    out[0xC2, [0x85, 0xA0]] = out[0x9A, 0x80] = out[0xA0, 0x8E] = out[0x81, 0x9F] = True
    out[0x80, [*range(0x80, 0x90), 0xA8, 0xA9, 0xAF]] = True
    return out.reshape(-1)


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


NO_CUT, BYTE_LETTERS = _no_cut(), _byte_letters()


def pieces(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of all texts in a row, as bytes, and the number of pieces before each text and after the last.

    A text is cut where a space or line feed follows something else than white space: no pre-token has both,
    and none looks further back, so ids of the pieces are the ids of the whole.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    begins = (raw == 32) | (raw == 10)
    at = np.flatnonzero(begins)
    before = raw.take(at - 1, mode="wrap").astype(np.intp)
    before += raw.take(at - 2, mode="wrap").astype(np.intp) << 8
    begins[at[NO_CUT[before]]] = False
    begins[ends[:-1][ends[:-1] < len(raw)]] = True
    starts = np.append(np.flatnonzero(begins), len(raw))
    cut = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)])
    return cut.dictionary_encode(), np.searchsorted(starts, ends)


class Encoder:
    """Ids of texts by the tokenizers library; pieces already seen come from a cache, which is emptied when full.

    Arrow finds the distinct pieces of a batch and puts their ids in a row; Python looks at each of them once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id: a character of a byte-level token is a byte
        for token, i in vocabulary.items():
            self.length[i] = len(token)
        self.known = Cache(CACHE_BYTES)  # by piece
        self.separators: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words after a space, without white space at their ends: many are encoded as one text and told apart by their bytes."""
        out = []
        for i in range(0, len(words), 4000):
            text = " " + " ".join(words[i : i + 4000])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.append(np.flatnonzero(raw == 32)[1:], len(raw))) + 1
            raw, at = ids.tobytes(), [0, *(ends * self.width).tolist()]
            out += [raw[a:b] for a, b in zip(at, at[1:])]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of PLAIN, each a pre-token: they go to the library's model as they are."""
        tokenize, ids, at = self.tokenizer.model.tokenize, [], [0]
        for w in words:
            if w.isascii():
                w = "Ġ" + w[1:] if w[0] == " " else w
            else:
                w = w.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids += [t.id for t in tokenize(w)]
            at.append(len(ids) * self.width)
        raw = np.array(ids, f"<u{self.width}").tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _separator(self, text: str) -> bytes:
        """Ids of white space or punctuation that is a pre-token."""
        if (ids := self.separators.get(text)) is None:
            if len(self.separators) >= SEPARATORS:
                self.separators.clear()
            ids = self.separators[text] = self._ids([text])[0] if text else b""
        return ids

    def _fresh(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that the cache doesn't hold, and of their words."""
        known, old, fresh = self.known, self.known.old, {}
        plain, cut, other = [], [], []
        for piece in new:
            text = piece.decode()
            if found := PLAIN.fullmatch(text):
                space, word, end = found.groups()
                if space or end:
                    plain.append((piece, space, word.encode(), end))
                else:
                    fresh[piece] = word
            elif (stem := text.rstrip(ENDS)) and 0 < len(text) - len(stem) <= 3 and stem[-1].isalnum():
                cut.append((piece, stem, text[len(stem) :]))
            else:
                other.append((piece, text))
        # A pre-token never crosses from a letter or digit to punctuation: what stands before it is often known.
        fresh |= {w: w.decode() for _, _, w, _ in plain if w not in known and w not in old}
        words = list(fresh)
        fresh = dict(zip(words, self._words(list(fresh.values()))))
        other = dict(other) | {k: stem for _, stem, _ in cut if (k := stem.encode()) not in known and k not in old}
        spaced = [k for k, t in other.items() if t[0] == " " and " " not in t[1:] and t[1:2] > " " and not t[-1].isspace()]
        fresh.update(zip(spaced, self._spaced([other.pop(k)[1:] for k in spaced])))
        fresh.update(zip(other, self._ids(list(other.values()))))

        def ids_of(piece: bytes) -> bytes:
            ids = fresh.get(piece) or known.get(piece)
            if ids is None:
                ids = fresh[piece] = old[piece]
            return ids

        for piece, space, word, end in plain:
            # White space before a bare word: its last character is a pre-token of its own.
            if space and word[0] != 32:
                space = self._separator(space[:-1]) + self._separator(space[-1])
            else:
                space = self._separator(space)
            fresh[piece] = space + ids_of(word) + self._separator(end)
        for piece, stem, end in cut:
            fresh[piece] = ids_of(stem.encode()) + self._separator(end)
        return fresh

    def encode(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """The ids of all texts in a row, and where each begins, in bytes; the last ends with the row."""
        known, old = self.known, self.known.old
        cut, firsts = pieces(texts)
        distinct = cut.dictionary.to_pylist()
        ids = list(map(known.get, distinct))
        if missing := [i for i, x in enumerate(ids) if x is None]:
            new = [distinct[i] for i in missing]
            again = {p: old[p] for p in new if p in old} if old else {}
            fresh = self._fresh([p for p in new if p not in again] if again else new)
            fresh.update(again)
            for i, piece in zip(missing, new):
                ids[i] = fresh[piece]
            known.update(kept := {p: x for p, x in fresh.items() if len(p) <= CACHED_BYTES})
            known.added(len(kept), sum(map(len, kept)) + sum(map(len, kept.values())))
        row = pa.array(ids, pa.large_binary()).take(cut.indices)
        at = np.frombuffer(row.buffers()[1], np.int64)[firsts].tolist() if len(row) else [0] * len(firsts)
        return memoryview(row.buffers()[2] or b""), at

    def __call__(self, texts: list[str]) -> list[bytes]:
        row, at = self.encode(pa.array(texts, pa.string()))
        return [bytes(row[a:b]) for a, b in zip(at, at[1:])]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def by_size(batch: pa.RecordBatch, column: str = "text", size: int = 8 << 20):
    """Slices of a batch with texts of about size bytes together: the more, the fewer words are looked up twice."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cuts = np.unique(np.cumsum(lengths) // size, return_index=True)[1].tolist()
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def open_fs(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url)


def write_parts(url: str, parts) -> None:
    """Bytes as they come, under a name of its own, then renamed: a task that runs again replaces the file as a whole."""
    fs, path = open_fs(url)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        for p in parts:
            out.write(p)
    fs.move(own, path)


def write_bytes(url: str, *parts: bytes) -> None:
    write_parts(url, parts)


def train_dictionary(docs: DataFrame, tokenizer: str, dict_bytes: int = DICT_BYTES, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """From those of at most sample_docs documents, with the least hashes of their id, that have up to SAMPLE_CHARS characters."""
    import zstandard

    some = docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(F.broadcast(some.distinct()), "doc_id").where(F.length(text) <= SAMPLE_CHARS).orderBy("doc_id", "text").select(text.alias("t")).limit(sample_docs)
    samples = rows.mapInArrow(lambda it: _serialized(it, tokenizer), "ids binary").toArrow().column(0).to_pylist()
    try:
        return zstandard.train_dictionary(dict_bytes, samples, level=LEVEL).as_bytes() if len(samples) > 16 else b""
    except zstandard.ZstdError:  # too little material
        return b""


def _serialized(batches, tokenizer: str):
    ids_of = encoder(tokenizer)
    ids_of.known.use()
    for batch in batches:
        for part in slices(batch):
            yield pa.RecordBatch.from_arrays([pa.array(ids_of([t or "" for t in part.column(0).to_pylist()]), pa.binary())], names=["ids"])


def write_token_files(docs: DataFrame, folder: str, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Writes documents (doc_id, text) to files in folder; returns the manifest (file, url, n_docs, n_ids, dictionary)."""
    import zstandard

    tokenizer = tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).digest()
    write_bytes(f"{folder}/dictionary", dictionary)
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)
    bounds = range_bounds(docs, "doc_id", max(1, min(FILES, docs.count() // ROWS_PER_FILE)))

    def compress(batches):
        ids_of = encoder(tokenizer)
        ids_of.known.use()
        end = np.array([end_id], f"<u{ids_of.width}").tobytes()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None, write_content_size=True)
        for batch in batches:
            for part in by_size(batch):
                row, at = ids_of.encode(part.column("text"))
                ids = [bytes(row[a:b]) + end for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("file"), part.column("doc_id"), pa.array([len(x) // ids_of.width for x in ids], pa.int64()), pa.array([packer.compress(x) for x in ids], pa.binary()), pa.array([ids_of.width] * len(ids), pa.int32())],
                    names=["file", "doc_id", "n", "frame", "width"],
                )

    def write(batches):
        for file, parts in _by_file(batches):
            entries, url = [], f"{folder}/{file:05d}.tok"

            def body():
                at, width = len(MAGIC), 2
                yield MAGIC
                for doc_id, n, frame, width in parts:
                    entries.append((doc_id or 0, doc_id is None, at, n))
                    at += len(frame)
                    yield frame
                yield np.array(entries, ENTRY).tobytes()
                yield struct.pack(FOOTER, at, len(entries), width, digest, MAGIC)

            write_parts(url, body())
            yield pa.RecordBatch.from_pylist([{"file": file, "url": url, "n_docs": len(entries), "n_ids": sum(e[3] for e in entries), "dictionary": f"{folder}/dictionary"}])

    n_files = len(bounds) + 1
    frames = docs.withColumn("file", range_bucket("doc_id", bounds)).mapInArrow(compress, "file int, doc_id long, n long, frame binary, width int")
    placed = frames.repartitionById(n_files, F.col("file")).sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "n", "frame")
    return materialise(placed.mapInArrow(write, "file long, url string, n_docs long, n_ids long, dictionary string"))


def _by_file(batches):
    """(file, rows) of batches sorted by file; rows are read as they come."""
    rows = (r for b in batches for part in slices(b, 512) for r in zip(*(part.column(n).to_pylist() for n in ("file", "doc_id", "n", "frame", "width"))))
    for file, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield file, (r[1:] for r in group)


def read_index(source) -> tuple[np.ndarray, int, bytes, int]:
    """Of an open file: index entries, id width, dictionary hash, offset of the index."""
    size = source.size()
    source.seek(size - struct.calcsize(FOOTER))
    at, n, width, digest, magic = struct.unpack(FOOTER, source.read(struct.calcsize(FOOTER)))
    if magic != MAGIC:
        raise ValueError("not a token file")
    source.seek(at)
    return np.frombuffer(source.read(n * ENTRY.itemsize), ENTRY), width, digest, at


def read_document(url: str, dictionary: str, k: int) -> np.ndarray:
    """Ids of the k-th document of a file, by the index and one range read."""
    import zstandard

    fs, path = open_fs(url)
    with fs.open_input_file(path) as source:
        index, width, digest, end = read_index(source)
        known = _dictionary(dictionary, digest)
        stop = int(index["offset"][k + 1]) if k + 1 < len(index) else end
        source.seek(int(index["offset"][k]))
        frame = source.read(stop - int(index["offset"][k]))
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=known).decompress(frame), f"<u{width}")


def _dictionary(url: str, digest: bytes):
    import zstandard

    fs, path = open_fs(url)
    with fs.open_input_stream(path) as source:
        raw = source.read()
    if hashlib.sha256(raw).digest() != digest:
        raise ValueError("the dictionary is not the one that the file was written with")
    return zstandard.ZstdCompressionDict(raw) if raw else None


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all documents of the files; ids as little-endian 32-bit binary."""
    import zstandard

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.withColumn("base", before).select("file", "url", "dictionary", "base")
    n_files = max(1, manifest.count())

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = open_fs(row["url"])
                with fs.open_input_file(path) as source:
                    index, width, digest, end = read_index(source)
                    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(row["dictionary"], digest))
                    base = row["base"]
                    stops = np.append(index["offset"][1:], end)
                    for i in range(0, len(index), 256):
                        part = index[i : i + 256]
                        source.seek(int(part["offset"][0]))
                        raw = source.read(int(stops[i : i + 256][-1] - part["offset"][0]))
                        edges = (np.append(part["offset"], stops[i : i + 256][-1]) - part["offset"][0]).tolist()
                        ids = [np.frombuffer(unpack.decompress(raw[a:b]), f"<u{width}").astype("<u4") for a, b in zip(edges, edges[1:])]
                        start = base + np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                        base = int(start[-1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(part["doc_id"], mask=part["null"].astype(bool)), pa.array(start[:-1].astype("i8")), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "ids"]
                        )

    return starts.repartition(n_files, "file").mapInArrow(read, "doc_id long, start long, ids binary")


def op8_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), shared_dir(spark))
    n = (F.octet_length("ids") / 4).cast("long")
    return read_token_files(manifest).select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
