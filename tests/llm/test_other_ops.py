"""Pages, archives, vectors, the pipeline and the registered queries."""

import collections
import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.llm import common, html_text, neighbours, ngram_join, queries, toxicity, warc
from tests.conftest import same_rows
from tests.llm.test_text_ops import odd_documents

PAGES = "page_id bigint, url string, html string, text string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a.example/1", "<article><h1>T</h1><p>One &amp; two</p></article>", "x"),
        (2, "http://a.example/2", "<article><h1>T</h1><p>One &amp; two</p></article>", "x"),
        (2, "http://a.example/2", "<article><h1>T</h1><p>One &amp; two</p></article>", "x"),
        (None, None, "<article><h1>T</h1><p>One &amp; two</p></article>", None),
        (3, None, None, None),
        (4, "not a url\r\nx", "", None),
        (None, "http://a.example/5", "only here", None),
        (6, "http://b.example/", "<p>" + "long words here " * 50_000, None),
    ]
    return spark.createDataFrame(rows, PAGES)


def test_archives_give_the_pages_back(spark, pages):
    got = warc.read_archives(warc.write_archives(pages, common.shared_dir(spark))).collect()
    by = sorted((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["payload_bytes"] == 49)
    assert by == [(False, 1, "revisit", 2, 49), (False, 2, "response", None, 49), (False, 2, "response", None, 49), (True, 0, "revisit", 2, 49)]
    empty = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got if not r["payload_bytes"]}
    assert empty == {4: ("response", None), 3: ("revisit", 4)}
    assert any(r["page_id"] is None and r["record_type"] == "response" and bytes(r["payload"]) == b"only here" for r in got)
    assert len(got) == 8
    assert warc.read_archives(warc.write_archives(pages.limit(0), common.shared_dir(spark))).count() == 0


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_several_archives_of_a_task(spark, pages, monkeypatch):
    few = {tuple(r) for r in warc.read_archives(warc.write_archives(pages, common.shared_dir(spark))).drop("payload").collect()}
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    manifest = warc.write_archives(pages.coalesce(1), common.shared_dir(spark), archive_bytes=300)
    assert manifest.count() > 2 and manifest.agg({"n_records": "sum"}).first()[0] == pages.count()
    assert {tuple(r) for r in warc.read_archives(manifest).drop("payload").collect()} == few


def test_zip64_directory():
    """The same archive with its directory in ZIP64 form: all fields that can overflow do."""
    records = [warc.record(i, None, b"p%d" % i, warc.digest_of(b"p%d" % i), None) for i in range(5)]
    plain = warc.pack(records)
    end = plain.rfind(b"PK\x05\x06")
    count, length, offset = struct.unpack_from("<HII", plain, end + 10)
    central, at, raw = b"", 0, plain[offset : offset + length]
    for _ in range(count):
        stored, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", raw, at + 20)
        header, = struct.unpack_from("<I", raw, at + 42)
        extra = struct.pack("<HHQ", 0x9999, 8, 7) + struct.pack("<HHQQQ", 1, 24, full, stored, header)
        fixed = raw[at : at + 20] + struct.pack("<IIHHH", 0xFFFFFFFF, 0xFFFFFFFF, n_name, len(extra), n_note) + raw[at + 34 : at + 42] + struct.pack("<I", 0xFFFFFFFF)
        central += fixed + raw[at + 46 : at + 46 + n_name] + extra
        at += 46 + n_name + n_extra + n_note
    record64 = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, len(central), offset)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, offset + len(central), 1)
    tail = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"end"
    for data in (plain, plain[:offset] + central + record64 + locator + tail):
        got = list(warc.read_records(warc.ZipReader(Source(data)), range_bytes=300))
        assert [r["payload"] for r in got] == [b"p%d" % i for i in range(5)]


def test_broken_archives_are_refused():
    with pytest.raises(ValueError):
        warc.ZipReader(Source(b"no archive"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"abc" * 100)
    with pytest.raises(ValueError):
        warc.ZipReader(Source(out.getvalue())).read("x")
    wrong = warc.record(1, None, b"payload", "A" * 32, None)
    with pytest.raises(ValueError):
        warc.parse_record(wrong)


def test_html_structure():
    page = """<html><head><title>No</title></head><body class="with-sidebar"><header>Top</header><div class=menu><ul><li>A<li>B</ul></div><div id=content>
    <p>Real  text\none&nbsp;two.<p>Second &lt;b&gt; <b>bo</b>ld</div><p class="notice">This site uses</p><p>After<div class="comments"><p>nice</div><form><input>go</form>
    <script>x("<p>no</p>")</script><!-- <p>no</p> --><style>p{}</style><div style="display: none">no</div><aside>no</aside><footer>no</body>"""
    assert [t for t, kind in html_text.blocks(page) if kind] == ["Real text one two.", "Second <b> bold", "After"]
    assert html_text.main_texts(["<nav>x</nav><main><h1>H</h1><p>P<br>Q</p><div class=ads>ad</div></main><p>outside"]) == ["H\n\nP Q\n\noutside"]
    for broken in ("<", "<p", "<!--", "<script>", "</p></div>", "<a href='x", "&#xffffff; &bad;", "<article><p>x</article></article>"):
        html_text.main_texts([broken])


@pytest.mark.parametrize(
    "page,want",
    [
        ('<div class="content hidden-print"><p>Only text</div>', "Only text"),
        ('<div class="no-sidebar"><p>Only text</div>', "Only text"),
        ('<div class="comments"><p>Only text</div>', "Only text"),
        ('<div class="comments"><p>nice</div><p>Text', "Text"),
        ('<article><p class="share-prices">Prices</p><figure><figcaption>Caption</figcaption></figure><p>x <math><mi>y</mi></math> z</article>', "Prices\n\nCaption\n\nx y z"),
        ('<article>a<div class="site-footer">no</div><div class="ad-slot wide">no</div></article>', "a\n\nno"),
        ('<div class="page-header">no</div><p>yes<div id="main-menu">no</div>', "yes"),
        ("<p>a < b and <3 <a href='x>y'>link</a>", "a < b and <3 link"),
    ],
)
def test_names_of_classes(page, want):
    assert html_text.main_texts([page]) == [want]


UNITS = ["<a href='x ", '<p "', "<div>", "<a '><a ''>", "<a '\"><a \"'>", "<", "</b>", "<!--", "<span class=ad>", "<!", "<a b=\" c='", "&amp", "<head><body>", "<script", "<li>"]


@pytest.mark.parametrize("unit", UNITS)
def test_broken_markup_takes_linear_time(unit):
    import time

    for tail in ("", ">", "</b>" * 100_000, "<div></div>" * 40_000):
        page = unit * ((1 << 20) // len(unit) // (2 if len(tail) > 1 else 1)) + tail
        start = time.thread_time()
        list(html_text.blocks(page))
        assert time.thread_time() - start < 10  # under 2 s here; a quadratic scan takes minutes


def test_the_array_alone_decides_beside_articles():
    """An unmarked footer and an unmarked line beside articles go as they repeat; what is unique there stays, and so do repeats inside articles."""
    foot = "all rights are reserved by the people who make this fine site"
    quoted = "a passage that three articles quote word for word from one old book"
    made = [f"<div>read more of our stories about the sea every day of {i}</div><article><p>story {i} begins</p><p>{quoted}</p></article><div>note {i} of the editor</div><div>{foot}</div>" for i in range(4)]
    assert html_text.main_texts(made) == [f"{i}\n\nstory {i} begins\n\n{quoted}\n\nnote {i} of the editor" for i in range(4)]
    assert foot in html_text.main_texts(made[:2])[0]


def test_main_texts_equal_brute_force():
    """Random hosts of pages with and without article: every token by the definition of a repeat."""
    import random

    r = random.Random(4)
    pool = [" ".join(f"b{k}x{j}" for j in range(r.randint(2, 14))) for k in range(6)]
    for _ in range(40):
        made = []
        for i in range(r.randint(1, 7)):
            made.append([(r.choice([0, 1, 1, 2]), r.choice(pool) if r.random() < 0.6 else f"u{i} v{r.random()}") for _ in range(r.randint(0, 6))])
        tag = {0: "nav", 1: "div", 2: "article"}
        html = ["".join(f"<{tag[k]}>{t}</{tag[k]}>" for k, t in page) for page in made]
        where = collections.defaultdict(set)
        streams = [[t for k, text in page if k != 2 for t in text.split()] for page in made]
        for h, s in zip(html, streams):
            for i in range(len(s) - 7):
                where[tuple(s[i : i + 8])].add(h)
        want = []
        for page, s in zip(made, streams):
            hit = [any(len(where[tuple(s[j : j + 8])]) >= 3 for j in range(max(0, i - 7), min(i, len(s) - 8) + 1)) for i in range(len(s))]
            out, at = [], 0
            for k, text in page:
                if k == 2:
                    out.append(text)
                    continue
                words = text.split()
                here = hit[at : at + len(words)]
                at += len(words)
                gone = [any(all(here[a : a + 8]) and len(here[a : a + 8]) == 8 for a in range(max(0, i - 7), i + 1)) for i in range(len(words))]
                left = [] if all(here) else [w for w, g in zip(words, gone) if not g]
                if k == 1 and left:
                    out.append(" ".join(left))
            want.append("\n\n".join(out))
        assert html_text.main_texts(html) == want


def test_registered_main_texts(spark, sf):
    """Rows of the query against the article of each page, cut out by a plain pattern."""
    import html
    import re

    made = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = html_text.op2_html_text(spark, sf).collect()
    assert len(rows) == len(made)
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", made[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_repeats_of_a_host_go_and_unique_runs_stay():
    boiler = "please read our terms of use and the rules of this house before you write"
    made = [f"<div>{boiler}</div><div>article number {i} says {'abc'[i % 3]}{i} and more {i * i} of it</div>" for i in range(12)]
    got = html_text.main_texts(made)
    assert all("terms of use" not in t and f"article number {i} says" in t for i, t in enumerate(got))
    assert "terms of use" in html_text.main_texts(made[:2])[0]
    marked = [f"<article>{m}</article>" for m in made]
    assert all(boiler in t for t in html_text.main_texts(marked))


def test_suffix_runs_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        streams = [[f"t{x}" for x in rng.integers(0, 3, rng.integers(0, 40))] for _ in range(6)]
        run = 4
        where = {}
        for p, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                where.setdefault(tuple(s[i : i + run]), set()).add(p)
        for s, hit in zip(streams, html_text.repeated(streams, run, 3)):
            want = np.zeros(len(s), bool)
            for i in range(len(s) - run + 1):
                if len(where[tuple(s[i : i + run])]) >= 3:
                    want[i : i + run] = True
            assert (want == hit).all()


def test_short_unique_runs_stay():
    made = [f"<div>this offer of our house is on sale for everyone at {i}99</div>" for i in range(5)]
    assert html_text.main_texts(made) == [f"{i}99" for i in range(5)]


def test_repeats_count_over_all_shards_of_a_host(spark):
    """Four pages of a host of 60 share a passage; no shard of 6 pages needs to hold three of them."""
    shared = "this passage is found on a few of the pages of this large host"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    rows = [(i, f"http://big.example/{i}", f"<div>{shared if i % 15 == 0 else 'no'}</div><div>{own(i)}</div>") for i in range(60)]
    rows += [(100 + i, f"http://twice.example/{i}", f"<div>{own(i % 2)}</div>") for i in range(20)]  # two pages of different content
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), shard_pages=6).collect()}
    assert len(got) == 80 and all(shared not in t for t in got.values())
    assert all(own(i) in got[i] for i in range(60)) and all(got[100 + i] == own(i % 2) for i in range(20))


def test_page_rows(pages):
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    assert got[(1, "http://a.example/1")] == ("T\n\nOne & two", 12) and got[(3, None)] == ("", 0) and got[(6, "http://b.example/")][1] == 799_999
    assert html_text.extract(pages).count() == 8 and html_text.extract(pages.limit(0)).count() == 0
    assert html_text.extract(pages, shard_pages=1).count() == 8


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16 if i % 9 else 5).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[20][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [None] + [1.0] * 15), (2080, [float("nan")] * 16), (None, [1.0] * 16), (2100, [float("inf")] * 16)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id bigint, embedding array<float>, score string")
    got = neighbours.nearest(df.where("vec_id % 20 = 0"), df, k=7, query_block=10, slice_rows=100).collect()
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and i < 2000 and v]
    want = []
    for i, q in good:
        if i % 20 == 0:
            near = sorted((-float(neighbours.in_order(q[None], v[None])[0]), j) for j, v in good if j != i and len(v) == len(q))[:7]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_int8_bound_holds():
    rng = np.random.default_rng(4)
    for d in (1, 64, 1500):
        x, y = rng.normal(size=(50, d)), rng.normal(size=(60, d)) * rng.random((60, 1)) * 100
        (a, s, e), (b, t, f) = neighbours.quantise(x), neighbours.quantise(y)
        unit = s[:, None] * t[None]
        assert (np.abs(neighbours.whole_products(a, b) * unit - x @ y.T) <= (e[:, None] + f[None]) * unit * (1 + 1e-9)).all()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(name, spark, sf, duck):
    df = queries.QUERIES[name](spark, sf)
    if name in queries.ORACLE_SQL:
        same_rows(df, duck, queries.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_pipeline_stages_follow_their_rules(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = common.materialise(p.STAGES[0][1](spark, docs, sf))
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r["doc_id"] for r in docs.collect() if model.score(r["text"])[0] >= 0.5}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad and kept.columns == docs.columns
    single = common.materialise(p.STAGES[1][1](spark, kept, sf))
    from tests.llm.test_text_ops import brute_components

    roots, _ = brute_components({r["doc_id"]: r["text"] for r in kept.collect()}, ngram_join.WORDS, ngram_join.PERCENT)
    assert {r["doc_id"] for r in single.collect()} == set(roots.values())
    mixed = common.materialise(p.STAGES[2][1](spark, single, sf))
    from blockloom.llm import mixing

    want = {r["doc_id"]: int(r["taken"] // r["size"]) + (2 * (r["taken"] % r["size"]) >= r["size"]) for r in mixing.mix(single).where("taken > 0").collect()}
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    last = p.STAGES[3][1](spark, mixed, sf).collect()
    assert len(last) == mixed.count() and all(r["decodes"] for r in last)


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    for name, docs in (("odd", odd_documents(spark)), ("none", odd_documents(spark).limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        rows = p.run(spark, str(tmp_path / name)).collect()
        assert all(r["decodes"] for r in rows) and bool(rows) == (name == "odd")


def test_near_duplicates_let_the_driver_collect_finished_plans(spark, sf, monkeypatch):
    import corpus_pipeline

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    collected = lambda: sum(b.getCollectionCount() for b in beans.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = collected()
    corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert collected() - before >= ngram_join.ROUNDS + 2  # at the start and after each step


def test_pipeline_keeps_one_row_of_each_group(spark, sf):
    """Repeated rows, several texts of one doc_id, rows without doc_id and rows without words."""
    import corpus_pipeline as p

    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w59", "x59")
    other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "vu")
    rows = [
        (1, long), (1, long), (2, near), (None, long), (None, near),  # one group
        (None, other), (None, other), (None, other + " end"),  # one without any doc_id
        (5, third), (5, third), (None, third),
        (7, ""), (7, ""), (None, None), (None, " "),  # no words: all stay
        (9, "one two"), (2**62 - 1, "three four"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in p.drop_near_duplicates(spark, docs, sf).collect()), key=repr)
    free = [r for r in got if r[0] is None and r[1] and r[1].strip()]
    assert len(free) == 1 and free[0][1] in (other, other + " end")
    assert [r for r in got if r not in free] == sorted([(1, long), (5, third), (7, ""), (7, ""), (None, None), (None, " "), (9, "one two"), (2**62 - 1, "three four")], key=repr)
    assert p.drop_near_duplicates(spark, docs.limit(0), sf).count() == 0
    top = docs.withColumn("doc_id", F.when(F.col("doc_id") == 9, (1 << 63) - 1).otherwise(F.col("doc_id")))
    assert p.drop_near_duplicates(spark, top, sf).count() == len(got)


def test_pipeline_mixing_takes_what_the_mix_takes_without_a_shuffle_of_texts(spark, sf):
    """Repeated rows, equal sizes under one doc_id or none, and sources of one row."""
    from collections import Counter

    import corpus_pipeline as p
    from blockloom.llm import mixing

    plan = p.mix_sources(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 1  # rows at a border
    rows = [(i % 7 or None, f"{'w ' * (i % 5)}", "en", ("a", "b", None)[i % 3], i) for i in range(150)] + [(3, "w w w", "en", "a", 0)] * 40 + [(None, "one", None, "c", 1), (8, None, "en", "d", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = Counter()
    for r in mixing.mix(docs.select("doc_id", "text", "source")).where("taken > 0").collect():
        want[r["doc_id"], r["source"], r["size"]] += r["taken"] // r["size"] + (2 * (r["taken"] % r["size"]) >= r["size"])
    got = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in p.mix_sources(spark, docs, sf).collect())
    assert got == +want


def test_n_grams_of_known_components_travel_no_further(spark, monkeypatch):
    looked_at = []
    whole = ngram_join.with_digests
    monkeypatch.setattr(ngram_join, "with_digests", lambda rows, single: looked_at.append(rows.count()) or whole(rows, single))
    texts = [" ".join([f"g{g}w{i}" for i in range(80)] + [f"x{k}"] * (k > 0)) for g in range(20) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {i: i // 3 * 3 for i in range(60)} and looked_at == [0]
