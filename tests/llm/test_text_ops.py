"""Operators on documents against brute force and on odd rows."""

import base64
import collections
import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockloom.llm import bpe, common, imatch, mixing, ngram_join, tokencounts, tokenfiles, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_tokens string, ids string"
LONG = "word " * 30_000 + "x" * 5000


def odd_documents(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, columns with names that outputs have."""
    rows = [
        (1, "one two three four five six seven", "en", "a", 33, "s", "t", "i"),
        (2, "one two three four five six seven", None, "a", None, None, None, None),
        (2, "one two three four five six seven", None, "a", None, None, None, None),
        (3, None, "en", None, 0, "s", "t", "i"),
        (4, "", "en", "b", 0, "s", "t", "i"),
        (None, "one two", "en", "b", 7, "s", "t", "i"),
        (5, " \n\t ", "de", "c", 4, "s", "t", "i"),
        (6, LONG, "de", "c", len(LONG), "s", "t", "i"),
        (7, "it's  the <|endoftext|> é文\x1c ok\n", "de", "c", 9, "s", "t", "i"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (7, 0, 1)], "doc_id bigint, quality int, toxic int")


def reference_encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = ["a", "b", "'s", "'re", "'", "ll", "'ll", " ", "  ", "\n", "\t", "1", "22", "é", "!", "?'", "　", "\x1c", "\x00", "文", " '", "\x85", " the", "²", "_"]


def random_texts(n, seed=1, longest=30):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_bpe_equals_the_library():
    e, m = reference_encoding(), bpe.merger(bpe.default_ranks())
    texts = random_texts(3000) + ["", "a" * 5000, "ab" * 3000 + " " * 500, "x" * 101]
    for t, (pieces, ends) in zip(texts, bpe.pretokenise(texts)):
        ids = b"".join(m[p] for p in pieces)
        assert np.frombuffer(ids, "<u4").tolist() == e.encode_ordinary(t)
        assert m.decode(ids) == t.encode() and "".join(pieces) == t and (not t or ends[-1] == len(t))


def test_new_words_are_merged_side_by_side():
    e, m = reference_encoding(), bpe.Merger(bpe.default_ranks())
    texts = random_texts(2000, seed=5) + [f" {i * 7919:06x}é{i}" for i in range(20_000)] + ["", "z" * 101, "ab" * 50]
    pieces = [p for found, _ in bpe.pretokenise(texts) for p in found]
    m._merge = None  # whatever is merged alone fails
    m.learn(pieces)
    assert [np.frombuffer(m[p], "<u4").tolist() for p in pieces] == [e.encode_ordinary(p) for p in pieces]
    ids = b"".join(m[p] for p in pieces)
    assert len(ids) > 4 * bpe.DECODED_IDS and m.decode(ids) == "".join(pieces).encode()


def test_registered_bpe_takes_one_pass_of_workers(spark, sf):
    plan = bpe.op10_bpe(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "offsets" not in plan


def test_classes_of_all_code_points_equal_the_library():
    import public_tokenizers as P
    import tiktoken

    e = reference_encoding()
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = bpe._class_table()
    for kind, pattern in ((bpe.LETTER, r"\p{L}"), (bpe.NUMBER, r"\p{N}"), (bpe.BLANKS, r"\s")):
        only = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=e._mergeable_ranks, special_tokens={})
        known = set(map(ord, only.decode_bytes(only.encode_ordinary(every)).decode()))
        assert known == {c for c in np.flatnonzero(table == kind).tolist() if not 0xD800 <= c < 0xE000}
    assert P.PATTERN == e._pat_str


def test_registered_bpe_equals_the_library(spark, sf):
    e = reference_encoding()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = bpe.op10_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = e.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_rows(odd, none):
    encoded = bpe.encode(odd)
    assert "score" in encoded.columns and encoded.columns.count("ids") == 1
    for r in bpe.decode(encoded).collect():
        assert bytes(r["decoded"]).decode() == (r["text"] or "") and r["n_tokens"] * 4 == len(r["ids"])
        pairs = np.frombuffer(bytes(r["offsets"]), "<u4").reshape(-1, 2)
        assert not len(pairs) or pairs[-1].tolist() == [len(r["text"]), r["n_tokens"]]
    assert bpe.decode(bpe.encode(none)).count() == 0


def test_tokenizer_parts_equal_the_whole():
    e = tokenfiles.encoder(tokenfiles.default_tokenizer())
    texts = random_texts(3000, 2) + ["", " ", "a" * 50 + " " + "b" * 60 + " c", LONG]
    assert e(texts) == e._ids(texts)


def test_tokenizer_parts_with_a_small_cache():
    """Generations of the cache come and go between batches; odd spaces, marks and long words in between."""
    e = tokenfiles.Encoder(tokenfiles.default_tokenizer())
    e.known.most = 300_000
    r, flips = random.Random(9), 0
    words = ["alpha", "it's", "x\n", "\ny", "", "é!", "\x00", "a\x00b", "w" * 60, "\u3000z", "q\u3000", "\x1c", "1,2", "_a_"]
    for _ in range(60):
        texts = [" ".join(r.choice(words) if r.random() < 0.1 else f"{r.choice('abc')}{r.randrange(400)}{r.choice(['', ',', '.'])}" for _ in range(r.randrange(40))) for _ in range(20)]
        assert e(texts) == e._ids(texts)
        flips += bool(e.known.old)
        assert e.known.held <= e.known.most and not {"", "x\n", "q\u3000"} & set(e.known)
    assert flips > 20


def test_punctuation_is_cut_off_new_words(monkeypatch):
    e = tokenfiles.Encoder(tokenfiles.default_tokenizer())
    texts = ["x said héllo 文 it's 12 a.b", "x said. héllo, 文) it's;! 12 a.b?!. said.,.,., ,, -"]
    whole = [np.array(x.ids, "<u2").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert e(texts[:1]) == whole[:1]
    seen = []
    monkeypatch.setattr(e, "_spaced", lambda words, f=e._spaced: seen.extend(words) or f(words))
    assert e(texts[1:]) == whole[1:] and sorted(seen) == [",,", "-", "said.,.,.,"]


def test_words_of_a_batch_are_looked_up_once(monkeypatch):
    """However often a word stands in a batch; and a word after a line feed isn't a new one with each word before it."""
    e, looked, new = tokenfiles.Encoder(tokenfiles.default_tokenizer()), [], []

    class Seen(common.Cache):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    e.known = Seen(1 << 20)
    texts = ["alpha beta\nGamma delta\nGamma beta alpha" + " alpha beta" * 500] * 3
    assert e(texts) == e._ids(texts) and len(looked) < 50
    monkeypatch.setattr(e, "_fresh", lambda words, f=e._fresh: new.extend(words) or f(words))
    texts = ["alpha alpha\nGamma alpha\nGamma delta", "", "alpha"]
    assert e(texts) == e._ids(texts) and not new


def test_cuts_at_every_code_point():
    """Texts are cut beside white space, words from the punctuation after them, whatever version of Unicode a library has."""
    e = tokenfiles.encoder(tokenfiles.default_tokenizer())
    kinds = [c for c in map(chr, range(0x30000)) if not "\ud800" <= c <= "\udfff" and (c < "\u3400" or c.isspace() or unicodedata.category(c) not in ("Lo", "Cn", "Co"))]
    texts = [f"{c} a{c} {c}b\n{c}\n\n{c}c {c}. x{c}, {c}" for c in kinds]
    for i in range(0, len(texts), 4000):
        assert e(texts[i : i + 4000]) == e._ids(texts[i : i + 4000])
    r = random.Random(6)
    ends = ["a", "é", " ", "  ", "\n", " \n", "\t", "\r\n", ".", ",", "'s", "!?", "1", "文", "\u3000", "\xa0", "\u2003", "\x1c", "\0", "_", "Word", "<|endoftext|>", "×", "😀", "\u200b", "%%%"]
    texts = ["".join(r.choice(ends) for _ in range(r.randrange(12))) for _ in range(20000)]
    assert e(texts) == e._ids(texts)


def test_ids_of_a_slice_with_nulls():
    e = tokenfiles.encoder(tokenfiles.default_tokenizer())
    row, at = e.encode(pa.array(["zz", None, "b c", "", None, "x\ny "]).slice(1, 4))
    assert [bytes(row[a:b]) for a, b in zip(at, at[1:])] == e._ids(["", "b c", "", ""])
    assert e([]) == [] and e([""]) == [b""]


def test_token_files(spark, odd, none):
    folder = common.shared_dir(spark)
    manifest = tokenfiles.write_token_files(odd, folder)
    rows = tokenfiles.read_token_files(manifest).orderBy("start").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfiles.default_tokenizer())
    t.encode_special_tokens = True
    at = 0
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 3, 4, 5, 6, 7]
    for r in rows:
        ids = [*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert r["start"] == at and np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        at += len(ids)
    m = manifest.first()
    assert tokenfiles.read_document(m["url"], m["dictionary"], 1).tolist() == np.frombuffer(bytes(rows[1]["ids"]), "<u4").tolist()
    with pytest.raises(ValueError):
        tokenfiles._dictionary(m["dictionary"], b"\0" * 32)
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(none, common.shared_dir(spark))).count() == 0


def test_registered_token_files_of_many_files(spark, sf, monkeypatch):
    """Rows of the query, with starts over several files, against the library."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfiles, "ROWS_PER_FILE", 9)
    t = Tokenizer.from_file(tokenfiles.default_tokenizer())
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = {r["doc_id"]: r for r in tokenfiles.op8_tokenfiles(spark, sf).collect()}
    assert len(docs) == len(rows) >= 27
    at = 0
    for i, text in docs:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    manifest = tokenfiles.write_token_files(spark.read.parquet(f"{sf}/documents.parquet"), common.shared_dir(spark))
    assert manifest.count() >= 3


def test_edited_counts_equal_whole_counts(monkeypatch):
    monkeypatch.setattr(tokencounts, "LEAF", 4)
    m, r = bpe.merger(bpe.default_ranks()), random.Random(3)
    for t in random_texts(1500, 4, 60):
        tree = tokencounts.build(t, bpe.pretokenise([t])[0][0], m)
        for _ in range(3):
            start, n, new = r.randint(0, len(t) + 2), r.choice([0, 1, 3, 20]), random_texts(1, r.random(), 6)[0]
            tokencounts.edit(tree, start, n, new, m)
            start = min(start, len(t))
            t = t[:start] + new + t[min(start + n, len(t)) :]
            assert "".join(tree.leaves) == t and tree.n_chars == len(t)
            assert tree.n_tokens == sum(len(m[p]) >> 2 for p in bpe.pretokenise([t])[0][0])


def test_registered_counts_equal_the_library(spark, sf):
    e = reference_encoding()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = tokencounts.op9_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        n = len(t)
        assert r["n_tokens"] == len(e.encode_ordinary(t))
        for start, length, new in ((n // 4, 7, ""), (n // 2, 0, " (edited) "), (n * 3 // 4, 5, "it's\n")):
            start = min(start, len(t))
            t = t[:start] + new + t[start + length :]
        assert (r["n_tokens_edited"], r["n_chars_edited"], r["edited_sha256"]) == (len(e.encode_ordinary(t)), len(t), hashlib.sha256(t.encode()).hexdigest())


def test_words_are_counted_once():
    m = bpe.Merger(bpe.default_ranks())
    m.counts.use()
    words = [f" {i:06x}q" for i in range(150_000)]
    before = [tokencounts.build("".join(part), part, m).n_tokens for part in (words[:4000], words)]
    m.merge = m.counts.merge = None  # whatever is merged again fails
    assert before == [tokencounts.build("".join(part), part, m).n_tokens for part in (words[:4000], words)]


def test_count_rows(odd, none):
    edits = "array(struct(2L AS start, 3L AS length, 'new' AS replacement), CAST(struct(null, null, null) AS struct<start:bigint,length:bigint,replacement:string>), null)"
    counted = tokencounts.count_tokens(odd.withColumn("edits", F.expr(edits)))
    for r in counted.collect():
        t = r["text"] or ""
        assert r["edited_text"] == t[:2] + "new" + t[5:] and r["n_chars_edited"] == len(r["edited_text"])
    assert tokencounts.count_tokens(none.withColumn("edits", F.expr(edits))).count() == 0


def brute_components(texts: dict, n: int, percent: int):
    sets = {}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        for j, k in collections.Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_components_of_chains_and_groups(spark, n, percent):
    r = random.Random(5)
    texts, i = {}, 0
    for group in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([4, 12, 60, 150]))]
        for copy in range(r.choice([1, 3, 25])):
            own = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 25))):
                own[r.randrange(len(own))] = f"e{r.randrange(10**6)}"
            texts[i * 7 % 1009] = " ".join(own).upper() if copy == 1 else "\n".join(own)
            base = own if group % 2 else base  # chains drift, groups don't
            i += 1
    got = ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3), n, percent).collect()
    want, sizes = brute_components(texts, n, percent)
    assert {x["doc_id"]: x["component_id"] for x in got} == want
    assert {x["doc_id"]: x["n_shingles"] for x in got} == sizes


@pytest.mark.parametrize("small", [512, 100])
def test_links_equal_brute_force(spark, monkeypatch, small):
    """Every pair of a group of near copies, copies of one set as members, and the number of links; without and with finer parities."""
    monkeypatch.setattr(ngram_join, "SMALL_SET", small)
    r = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(40):
        own = list(base)
        own[r.randrange(len(own))] = f"e{i % 30}"
        texts[i] = " ".join(own) if i < 36 else texts[i - 36]
    sets = {i: set(ngram_join.shingles(t, 3).tolist()) for i, t in texts.items()}
    near = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    pairs, members, links, placed = ngram_join.jaccard_links(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), 3, 90)
    of = {x["doc_id"]: x["id"] for x in members.collect()}
    assert {(x["u"], x["v"]) for x in pairs.collect()} == {(i, j) for i, j in near if of[i] == i and of[j] == j}
    assert {x["doc_id"]: x["n_links"] for x in links.collect()} == {i: sum(i in p for p in near) for i in sets}
    assert {x["doc_id"]: x["component_id"] for x in placed.collect()} == brute_components(texts, 3, 90)[0]


def test_shuffled_joins_give_the_same(spark, odd, monkeypatch):
    """Beyond the bounds of broadcasts."""
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    ways = [lambda: rows(ngram_join.jaccard_links(odd)[-1]), lambda: rows(imatch.fingerprints(odd))]
    broadcast = [w() for w in ways]
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    assert [w() for w in ways] == broadcast


def test_component_rows(odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(odd).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 0, 3), (4, 0, 4), (None, 1, None), (5, 0, 5), (6, 2, 6), (7, 1, 7)], key=repr)
    assert ngram_join.jaccard_components(none).count() == 0


def test_prefix_shares_a_gram_of_every_similar_pair():
    for n in range(1, 200):
        for percent in (80, 90):
            k = ngram_join.prefix_length(n, percent)
            assert 1 <= k <= n and n - k + 1 >= -(-percent * n // 100)


def test_suffix_filter_bounds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a = rng.integers(0, 2**64, rng.integers(1, 300), np.uint64)
        b = np.unique(np.concatenate([a[: len(a) // 2], rng.integers(0, 2**64, rng.integers(1, 900), np.uint64)]))
        a = np.unique(a)
        apart = len(np.setxor1d(a, b))
        assert ngram_join.least_difference(ngram_join.parity(a), ngram_join.parity(b)) == ngram_join.least_difference(ngram_join.parity(b), ngram_join.parity(a)) <= apart
        assert np.bitwise_count((ngram_join.digest(a) ^ ngram_join.digest(b)).view(np.uint64)).sum() <= apart
    far = [np.unique(rng.integers(0, 2**64, 400, np.uint64)) for _ in range(2)]
    assert ngram_join.least_difference(*map(ngram_join.parity, far)) > 2 * 400 * 20 / 180  # unrelated sets are told apart at 0.8


def test_pairs_of_repeated_ids_and_long_shared_prefixes(spark, monkeypatch):
    """A doc_id of several texts, repeated rows, and pairs whose common n-grams are more than a row carries."""
    monkeypatch.setattr(ngram_join, "BEFORE", 2)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(30):
        own = list(base)
        own[i * 7] = f"e{i}"
        rows.append((i % 20, " ".join(own)))
    rows += rows[:5] + [(100 + i, f"alone {i} " * 9) for i in range(5)]
    pairs, members, _, placed = ngram_join.jaccard_links(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), 3, 90)
    assert {x["component_id"] for x in placed.collect() if x["doc_id"] < 20} == {0}
    assert sorted((x["doc_id"], x["component_id"]) for x in placed.collect() if x["doc_id"] >= 100) == [(100 + i, 100 + i) for i in range(5)]
    assert {(x["u"], x["v"]) for x in pairs.collect()} >= {(i, j) for i in range(20) for j in range(i + 1, 20)}
    assert {x["component_id"] for x in ngram_join.jaccard_components(spark.createDataFrame(rows[:35], "doc_id bigint, text string"), 3, 90).collect()} == {0}


def test_mix_near_targets(spark, odd, none):
    rows = [(i, "w " * (i % 50 + 1), None if i % 11 == 0 else f"s{i % 5}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    once, again = (sorted(map(tuple, mixing.mix(d).select("doc_id", "size", "source_size", "target", "taken", "source").collect()), key=repr) for d in (docs, docs.repartition(7)))
    assert once == again
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for _, s, n, t, k, source in once:
        assert 0 <= k <= 2 * s
        size[source] += s
        taken[source] += k
        target[source] = (n, t)
    for s in size:
        assert target[s][0] == size[s] and abs(taken[s] - target[s][1]) <= 1 and target[s][1] <= 2 * size[s]
    assert abs(sum(t for _, t in target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    assert mixing.mix(none).count() == 0
    # Sizes by source: a 21, b 2, c 30,005; 150 % of all, weights 5, 2, 1, each at most twice: a and b are clamped, c takes the rest.
    got = sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["source"]) for r in mixing.mix(odd).collect()), key=repr)
    size = {"a": 21, "b": 2, "c": 30_001 + 5}
    left = 1.5 * sum(size.values()) - 2 * (size["a"] + size["b"])
    target = {"a": 42.0, "b": 4.0, "c": left}
    words_of = {1: 7, 2: 7, 3: 0, 4: 0, None: 2, 5: 0, 6: 30_001, 7: 5}
    assert [(i, n) for i, n, *_ in got] == sorted([(i, words_of[i]) for i in (1, 2, 2, 3, 4, None, 5, 6, 7)], key=repr)
    named = [x for x in got if x[4] is not None]
    assert {x[4] for x in named} == set(size) and all(x[2] == size[x[4]] and abs(x[3] - target[x[4]]) < 1e-6 for x in named)
    free = [x for x in got if x[4] is None]
    assert [(x[0], x[2], x[3]) for x in free] == [(3, 0, 0.0)]
    taken = {(r["doc_id"], r["source"]): r["taken"] for r in mixing.mix(odd).collect()}
    assert taken[(1, "a")] == taken[(2, "a")] == 14 and taken[(None, "b")] == 4 and taken[(3, None)] == taken[(4, "b")] == taken[(5, "c")] == 0


def test_fingerprints(spark, odd, none):
    rows = {(r["doc_id"], r["n_chars"]): r for r in imatch.fingerprints(odd).collect()}
    assert len(rows) == 8  # the repeated row twice under one key
    by_id = {r["doc_id"]: r for r in rows.values()}
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    order = [7, 6, 5, 4, 3, 1, None]
    for a, b in zip(order, [*order[1:], 7]):
        if a in (3,):  # a row of doc_id 2 follows
            b = 2
        t = texts[a]
        h = len(t) // 2
        edited = t[: len(t) - h] + texts[b][:h]
        assert by_id[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), a
        assert by_id[a]["n_chars"] == len(t)
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] != by_id[7]["fingerprint"]
    assert by_id[4]["near_next"] == 1.0 and by_id[4]["fingerprint"] == by_id[3]["fingerprint"]
    assert imatch.fingerprints(none).count() == 0
    alone = imatch.fingerprints(odd.where("doc_id = 1")).first()
    assert alone["near_next"] == 1.0


def brute_fingerprints(rows):
    """Rows (doc_id, text) without nulls, unique ids: the expected rows of imatch.fingerprints by doc_id."""
    import struct

    import xxhash

    h = lambda raw, seed=42: xxhash.xxh64_intdigest(raw, seed)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    long = lambda x, seed: h(struct.pack("<q", x), seed)
    words = lambda t: list(dict.fromkeys(re.findall(r"[^\x20\x09-\x0D]+", t.lower())))
    df = collections.Counter(w for _, t in rows for w in words(t))
    n = len(rows)
    band = {w for w, k in df.items() if max(2, n / imatch.RARE) <= k <= max(2, n / imatch.FREQUENT)}
    int_ = lambda x, seed: h(struct.pack("<i", x), seed)

    def mask(term):
        return sum(1 << i for i, (seed, rate) in enumerate(imatch.SUBSETS[1:]) if signed(int_(seed, long(term, 42))) % rate == 0)

    def hashed(members):
        seed = 42
        for term, m in members:
            seed = long(m, long(term, seed))
        return signed(seed) >> 32

    def of(text):
        kept = sorted((signed(h(w.encode())), mask(signed(h(w.encode())))) for w in words(text) if w in band)
        if not kept:
            every, seed = sorted(words(text)), 42
            for w in every:
                seed = h(w.encode(), seed)
            return [signed(h(b"all", seed)) >> 32 if every else None] + [None] * (len(imatch.SUBSETS) - 1)
        drawn = [[x for x in kept if x[1] >> i & 1] for i in range(len(imatch.SUBSETS) - 1)]
        return [hashed(kept)] + [hashed(d) if d else None for d in drawn]

    def alike(a, b):
        known = [(x, y) for x, y in zip(a, b) if x is not None or y is not None]
        return sum(x == y for x, y in known) / len(known) if known else 1.0

    text = lambda a: ":".join("-" if x is None else f"{x & 0xFFFFFFFF:08x}" for x in a)
    ordered = sorted(rows, reverse=True)
    out = {}
    for (i, t), (_, after) in zip(ordered, [*ordered[1:], ordered[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = of(t), of(edited), of(after)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), alike(a, b), alike(a, c))
    return out


def test_fingerprints_equal_brute_force_over_many_ranges(spark, sf, monkeypatch):
    monkeypatch.setattr(imatch, "ROWS_PER_RANGE", 7)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in imatch.fingerprints(docs).collect()}
    want = brute_fingerprints(rows)
    assert len(rows) > 14 and got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4] and got[i][4:] == pytest.approx(w[4:]), i


def test_fingerprints_of_words_out_of_the_band(spark):
    rows = [(i, t) for i, t in enumerate(["", " \n", "only once here", "Again again", "again AGAIN again", "x y z", "z y x", "common a", "common b", "common c"])]
    got = {r["doc_id"]: tuple(r)[1:] for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, w in brute_fingerprints(rows).items():
        assert got[i] == pytest.approx(w), i


def test_fingerprints_tell_edits_from_other_texts(spark, sf):
    r = imatch.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert r[0] > 5 * r[1]


def test_toxicity_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.held_out()).select("score", "predicted", "toxic").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.93
    assert {r["h"] for r in docs.select((toxicity.held_out() == (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).alias("h")).collect()} == {True}
    assert zlib.crc32(b"5") == docs.select(F.crc32(F.lit("5"))).first()[0]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    m = toxicity.Model([f"f{i}" for i in range(40)], [1.0] * 40)

    def vector():
        at = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
        w = rng.random(len(at)) + 0.01
        return at, w / np.sqrt(w @ w)

    vectors = [vector() for _ in range(700)]
    m.index(list(range(700)), [i % 2 for i in range(700)], [1.0] * 700, vectors)
    dense = np.zeros((700, 40))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for _ in range(50):
        at, w = vector()
        q = np.zeros(40)
        q[at] = w
        want = np.sort(dense @ q)[::-1][: toxicity.NEIGHBOURS]
        docs, scores = m.nearest(at, w)
        assert np.allclose(scores, want[want > 0]) and np.allclose(dense[m.ids[docs]] @ q, scores)


def test_toxicity_searches_all_words(spark):
    """A toxic word of two examples only, and words that say nothing, are searched like all others."""
    free = [i for i in range(1, 2000) if zlib.crc32(str(i).encode()) % 5]
    plain = [(i, f"plain words number w{i % 40} of day d{i % 7}", 0) for i in free[:300]]
    toxic = [(i, f"gronk fool w{i % 40}", 1) for i in free[300:340]] + [(i, f"zwatch snarl w{i % 40}", 1) for i in free[340:342]]
    rows = spark.createDataFrame(plain + toxic, "doc_id bigint, text string, toxic int")
    model = toxicity.train(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert {w for _, t, _ in plain + toxic for w in t.split()} == set(model.feature) and (model.weight > 0).all()
    at, w = model.vector("plain words w3")
    assert len(at) == 3
    _, near, _ = model.score("zwatch snarl")
    assert set(model.ids[near[:2]]) == set(free[340:342]) and model.labels[near[:2]].tolist() == [1, 1]
    assert len(model.score("some plain words")[1]) == toxicity.NEIGHBOURS and model.score("unseen")[0] == model.bare


def test_toxicity_scores_equal_brute_force(spark, sf):
    """Vectors, search, votes, leave-one-out calibration and scores against a plain version without index or blocks."""
    import math

    at = sf.replace("0.001", "0.01")
    docs, labelled = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, at).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    label = {r["doc_id"]: r["toxic"] for r in labelled.collect() if r["doc_id"] in texts and not held[r["doc_id"]]}
    assert len(label) <= toxicity.EXAMPLES_PER_CLASS
    words = {i: collections.Counter(w for t in texts[i].lower().split() if (w := re.sub(r"^\W+|\W+$", "", t))) for i in texts}
    n = [sum(1 for y in label.values() if y == c) for c in (0, 1)]
    count = [collections.Counter(w for i, y in label.items() if y == c for w in words[i]) for c in (0, 1)]
    weight = {}
    for w in count[0] | count[1]:
        a, b = count[1][w], count[0][w]
        share = (a + b) / sum(n)
        g2 = 2 * sum(x * math.log(x / e) for x, e in ((a, n[1] * share), (b, n[0] * share), (n[1] - a, n[1] * (1 - share)), (n[0] - b, n[0] * (1 - share))) if x)
        weight[w] = math.log((sum(n) + 1) / (a + b)) * math.sqrt(1 + max(g2, 0))

    def vector(i):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in words[i].items() if w in weight}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    vectors = {i: vector(i) for i in texts}

    def vote(i):
        cosines = [(sum(x * vectors[j][w] for w, x in vectors[i].items() if w in vectors[j]), j) for j in label if j != i or held[i]]
        near = sorted(((c, j) for c, j in cosines if c > 0), key=lambda x: (-x[0], x[1]))[: toxicity.NEIGHBOURS]
        return (sum(c * label[j] for c, j in near) + 1e-3 * n[1] / sum(n)) / (sum(c for c, _ in near) + 1e-3), near

    bins = [[0.0, 0] for _ in range(toxicity.BINS)]
    for i in label:
        k = min(int(vote(i)[0] * toxicity.BINS), toxicity.BINS - 1)
        bins[k][0] += label[i]
        bins[k][1] += 1
    pools = []
    for k, (t, m) in enumerate(bins):
        pools.append([t + (k + 0.5) / toxicity.BINS, m + 1, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    rates = [t / m for t, m, k in pools for _ in range(k)]
    some = [i for i in sorted(texts) if held[i]][:60]
    for i in some:
        v, near = vote(i)
        want = np.interp(v, (np.arange(toxicity.BINS) + 0.5) / toxicity.BINS, rates)
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["held_out"]
        assert np.allclose([e["cosine"] for e in got[i]["evidence"]], [c for c, _ in near])
    assert sum(len(r["evidence"]) > 0 for r in got.values()) >= 0.95 * sum(bool(t.split()) for t in texts.values())


def test_toxicity_rows(spark, odd, none, labels):
    model = toxicity.train(odd, labels)
    scored = toxicity.score(odd, model)
    assert scored.count() == 9 and scored.columns.count("score") == 1
    empty = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in toxicity.score(odd, toxicity.train(odd, empty)).collect()} == {0.0}
    assert toxicity.score(none, toxicity.train(none, labels)).count() == 0


def test_range_buckets(spark):
    r = random.Random(0)
    cuts = sorted(r.sample(range(-1000, 1000), 37))
    rows = spark.createDataFrame([(i,) for i in range(-1005, 1005, 3)] + [(None,)], "k bigint")
    for k, b in rows.select("k", common.range_bucket("k", cuts)).collect():
        assert b == (0 if k is None else sum(c < k for c in cuts))
