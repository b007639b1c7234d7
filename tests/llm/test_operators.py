"""The operators against brute force on small inputs, and their cases of nulls, repeats and names."""

import base64
import hashlib
import html as entities
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, html, neardup, passages, pieces, pii, quality, queries, sharding, urls, warc

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (None, None, "x", 1),
    (None, "one two three", "x", 2),
    (1, "", "y", 3),
    (2, " \t\n ", "y", 3),
    (3, "one two three four five six seven eight nine ten eleven twelve", None, 4),
    (3, "one two three four five six seven eight nine ten eleven twelve", None, 4),
    (4, "ann@example.org 1.2.3.4 4242424242424242 +49 30 1234567", "z", 5),
    (5, "word " * 30_000, "z", 6),
    (6, "ß😀é\x00\x0b日本語", "z", 7),
]
#: Names that the operators use on the way or add.
ODD_SCHEMA = "doc_id long, text string, size string, k int"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    return df.withColumns({c: F.lit("own") for c in ("row", "doc", "id", "base", "tokens", "kept", "host", "shard", "terms", "entry")})


OPERATORS = {
    "sharded": lambda df: sharding.sharded(df, 4),
    "matches": lambda df: decontamination.matches(df, df.sparkSession.createDataFrame([(1, "two three four")], "item_id long, text string"), slop=2),
    "decontaminated": lambda df: decontamination.decontaminated(df, df.sparkSession.createDataFrame([(None, None), (1, "")], "item_id long, text string")),
    "near_duplicates": neardup.near_duplicates,
    "with_spans": pii.with_spans,
    "sanitised": pii.sanitised,
    "deduplicated": passages.deduplicated,
    "judged": quality.judged,
    "kept_rows": quality.kept_rows,
    "urls": lambda df: urls.judged(df, url_col="text"),
    "html": lambda df: html.extracted(df, url_col="size", html_col="text"),
    "encode": lambda df: pieces.encode(df, pieces.load_pieces(queries.MODEL)),
}
FILTERS = {"decontaminated", "kept_rows"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_names(odd, name):
    out = OPERATORS[name](odd).collect()
    assert len(out) <= len(ODD) if name in FILTERS else len(out) == len(ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(odd, name):
    assert OPERATORS[name](odd.limit(0)).collect() == []


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def result(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


def test_shards(spark, docs):
    rows = result(spark, "op1_histogram_shards")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    shards = {}
    for r in rows:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        shards.setdefault(r["shard"], []).append(r)
    for own in shards.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    sizes = [sum(r["size"] for r in own) for own in shards.values()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_one_text_may_fill_many_shards(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    sizes = [r.n for r in sharding.sharded(df, 8).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)


@pytest.mark.parametrize("ids", ["equal", "null", "own"])
def test_equal_rows_are_parted(spark, ids):
    """Half of all rows are equal in text and id, or have no id: shards are even all the same, and they are
    runs of the texts in the order of their hashes."""
    hot = {"equal": 7, "null": None}
    texts = ["the same text" if i % 2 else f"text {i}" for i in range(2000)]
    rows = [(i, hot.get(ids, i) if i % 2 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n long, doc_id long, text string")
    got = sharding.sharded(df, 8).withColumn("k", sharding.text_key(F.col("text"))).collect()
    assert sorted(r.n for r in got) == list(range(2000))
    own = [[r for r in got if r.shard == s] for s in range(8)]
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in own)
    sizes, mean = [sum(r["size"] for r in rows) for rows in own], sum(len(t) + 1 for t in texts) / 8
    assert all(abs(size - mean) <= 2 * 0.002 * mean + 28 for size in sizes)
    hashes = [r.k for rows in own for r in sorted(rows, key=lambda r: r.slot)]
    assert hashes == sorted(hashes)


def test_main_text_of_the_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in result(spark, "op2_main_text"):
        found = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]], re.DOTALL)
        blocks = [" ".join(entities.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br|article)>", found[1])]
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_wrappers_tell_slots_from_template(spark):
    page = '<div>Welcome to our site</div><div class=x><p>Story {0} of the day</p><p>More {0}</p></div><div><p>All rights reserved</p></div>'
    df = spark.createDataFrame([("http://a/", page.format(i)) for i in range(4)], "url string, html string")
    assert sorted(r.main_text for r in html.extracted(df).collect()) == [f"Story {i} of the day More {i}" for i in range(4)]


def test_simple_tree_matching_is_largest():
    def tree(spec):
        return [spec[0], [tree(c) for c in spec[1:]]]

    a, b = tree(("d", ("u", ("l",), ("l",)), ("p",), ("d",))), tree(("d", ("p",), ("u", ("l",)), ("d", ("p",))))
    assert html.matching(a, b, {})[0] == 4


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a &amp;amp; b<p>c<br>d", "a &amp; b c d"),
        ("<article><h1>T</h1><p>on<b>e</b></p><div class='ad'>x</div></article><p>out", "T one"),
        ("<nav>n</nav><main><p>m</p><form><p>f</form></main><footer>x</footer>", "m"),
        ("<article><p>a<section id=comments><p>c</section></article>", "a"),
        ("<script>var a='<p>no</p>'</script>yes<!-- c -->", "yes"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_pages_without_a_wrapper(page, text):
    assert html.main_text(page, None) == text


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    out = []
    for k, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (
                k == 0
                or k == 1 and all(int(x) <= 255 for x in m[0].split("."))
                or k == 2 and 14 <= len(d) <= 19 and luhn(d)
                or k == 3 and 10 <= len(d) <= 15
            ):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark, docs):
    rng = random.Random(7)
    texts = list(docs.values()) + ["".join(rng.choice("0123456789 .-+@ab()😀") for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["a@b.c_d@e.f 1.2.3.4.5.6.7.8 001.02.3.255 999.1.1.1", "4242 4242 4242 4242 42424242424242424242", "1.1.1.1 " * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.with_spans(df).collect():
        assert [(s.start, s.kind, s.end) for s in r.base] == brute_spans(texts[r.doc_id])


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} from Zebulon at zeb@example.org about {'alpha beta gamma delta'.split()[i % 4]} thing{i}") for i in range(6)]
    rows += [(10 + i, f"plain text about thing {i}") for i in range(60)]
    out = {r.doc_id: r for r in pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zebulon" in [s.value for s in out[i].spans] for i in range(6))
    assert all(not out[10 + i].spans for i in range(60))
    assert "about" not in [s.value for s in out[0].spans]
    clean = pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 0").first().text
    assert "Zebulon" not in clean and "[EMAIL]" in clean


def test_base_quality_features(spark, docs):
    for r in result(spark, "op7_quality_votes"):
        text = docs[r["doc_id"]]
        w = SPACED.findall(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["kept"] and r["base_failed"])


def test_votes_find_the_labelled_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in queries.QUERIES["op7_quality_votes"](spark, "/root/testdata/sf0.01").collect()}
    good = [kept[d] for d, q in labels.items() if q == 1 and d in kept]
    assert sum(good) / len(good) > 0.8


def test_url_rules(spark):
    cases = {
        "http://A.example.net/en/x?q": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://a.example.net/fr": ("a.example.net", "/fr", "net/", "block"),
        "https://example.com/de/1#x": ("example.com", "/de/1", "example.com/de/", "block"),
        "x.org/fr/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(df).collect()} == cases


def test_templates_learn_from_labels(spark):
    rows = [(f"http://h.io/shop/{i}", True if i % 2 else None) for i in range(200)] + [(f"http://h.io/news/{i}", False if i % 2 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    out = urls.judged(df, label=F.col("bad")).groupBy(F.col("url").contains("/shop/").alias("shop"), "verdict").count().collect()
    assert {(r.shop, r.verdict) for r in out} == {(True, "block"), (False, "allow")}


def test_warc_round_trip(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, None), (4, "u\r\nx", ""), (None, "u", "same"), (5, "v", "é" * 9)]
    out = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for page, _, text in rows:
        data = (text or "").encode()
        assert out[page].payload_bytes == len(data)
        assert out[page].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {p: (r.record_type, r.refers_to) for p, r in out.items()} == {
        1: ("revisit", 2), None: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None),
    }


def test_lossless_and_reproducible_pieces(spark, docs):
    vocabulary = pieces.load_pieces(queries.MODEL)
    rows = [(i, t) for i, t in docs.items()] + [(10**6, " a  b\t\x00😀"), (10**6 + 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r.doc_id: r.tokens for r in pieces.encode(df, vocabulary).collect()}
    two = {r.doc_id: r.tokens for r in pieces.encode(df.repartition(7), vocabulary).collect()}
    assert one == two
    back = {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(df, vocabulary), vocabulary).collect()}
    assert back == dict(rows)


def test_proximity_matches(spark):
    df = spark.createDataFrame([(1, "a b c x d e f g h i j"), (2, "a b c d e f g h i j"), (3, "j i h")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d e f g h i j")], "item_id long, text string")
    out = {r.doc_id: (r.n_hit, r["items"], r.near_items) for r in decontamination.matches(df, items, slop=2).collect()}
    assert out == {1: (0, [], [7]), 2: (10, [7], [7]), 3: (0, [], [])}
