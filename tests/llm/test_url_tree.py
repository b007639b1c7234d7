"""Small sections and long paths in the tree of url templates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import shared, urls


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, "url string, bad boolean")
    return {r.url: r.verdict for r in urls.judged(df, label=F.col("bad")).collect()}


def test_labels_of_a_small_section_stay_in_it(spark):
    rows = [(f"http://h.io/main/{i}/a", None) for i in range(3000)]
    rows += [(f"http://h.io/de/{i}/a", True if i < 6 else None) for i in range(30)]
    rows += [(f"http://h.io/few/{i}/a", True) for i in range(6)]
    clean = [(f"http://h.io/clean{'abcdefghij'[i % 10]}/{i}/a", None) for i in range(400)]
    clean += [(f"http://h.io/tiny{'abcdefghij'[i]}/{i}/a", None) for i in range(10)]
    out = verdicts(spark, rows + clean)
    assert {url for url, verdict in out.items() if verdict == "block"} == {url for url, _ in rows if "/de/" in url or "/few/" in url}


def test_branches_that_part_far_down(spark):
    deep = "http://h.io/a/b/c/d/e/f/g"
    rows = [(f"{deep}/{kind}/{i}", kind == "bad" if i % 2 else None) for kind in ("bad", "good") for i in range(100)]
    out = verdicts(spark, rows)
    assert all(verdict == ("block" if "/bad/" in url else "allow") for url, verdict in out.items())


def test_rare_last_segments_are_judged_by_their_siblings(spark):
    rows = [(f"http://h.io/{kind}/item-{i}x", kind == "shop" if i % 2 else None) for kind in ("shop", "news") for i in range(100)]
    out = verdicts(spark, rows)
    assert all(verdict == ("block" if "/shop/" in url else "allow") for url, verdict in out.items())


def brute_templates(counts, o):
    """{(host, shape): (template, purity)} by a recursive walk in Python."""
    out = {}

    def leaf(rows, template):
        bad, good = sum(r[3] for r in rows), sum(r[4] for r in rows)
        for host, shape, *_ in rows:
            leaves.setdefault((host, template), []).append((shape, bad, good))

    def walk(rows, template, level):
        if max(len(r[1]) for r in rows) <= level or len(rows) == 1 or not sum(r[3] for r in rows):
            return leaf(rows, template)
        groups = {}
        for r in rows:
            groups.setdefault(r[1][level] if len(r[1]) > level else "", []).append(r)
        child = {}
        for value, own in groups.items():
            n, bad, good = (sum(r[k] for r in own) for k in (2, 3, 4))
            kids = len({r[1][level + 1] for r in own if len(r[1]) > level + 1})
            enough = bad + good + 0.5 * o.smoothing >= o.reject * (bad + good + o.smoothing)
            stays = n >= o.min_urls or kids >= o.min_kids or bad + good > 0 and (kids > 0 or enough)
            child[value] = (value if stays else "*", n, bad, good)
        literal = [c for c in child.values() if c[0] != "*"]
        first = max(literal, key=lambda c: (c[1], c[0])) if literal else None
        parts = {}
        for value, own in groups.items():
            name, _, bad, good = child[value]
            if name != "*":
                n1, n2 = bad + good, first[2] + first[3]
                if n1 and n2:
                    share = (bad + first[2]) / (n1 + n2)
                    alike = abs(bad / n1 - first[2] / n2) <= o.merge_z * math.sqrt(share * (1 - share) * (1 / n1 + 1 / n2))
                else:
                    alike = not n1 and not n2
                name = first[0] if alike else name
            parts.setdefault(name, []).extend(own)
        for name, own in parts.items():
            walk(own, f"{template}/{name}", level + 1)

    leaves = {}
    hosts = {}
    for r in counts:
        hosts.setdefault(r[0], []).append(r)
    for own in hosts.values():
        walk(own, "", 0)
    for (host, template), found in leaves.items():
        # parts of one template that end at different levels are one
        rows = [r for r in counts if r[0] == host and r[1] in {tuple(s) for s, _, _ in found}]
        bad, good = sum(r[3] for r in rows), sum(r[4] for r in rows)
        for shape, _, _ in found:
            out[host, tuple(shape)] = (template, (bad + 0.5 * o.smoothing) / (bad + good + o.smoothing))
    return out


@pytest.mark.parametrize("share", [0.001, 0.2])
def test_the_tree_against_a_walk(spark, share, monkeypatch):
    monkeypatch.setattr(shared, "HOT_SHARE", share)
    rng = random.Random(14)
    counts = {}
    for _ in range(1500):
        host = rng.choice(["a", "a", "a", "b", "c"])
        shape = tuple(rng.choice(["en", "de", "shop", "*", f"x{rng.randrange(30)}"]) for _ in range(rng.randrange(5)))
        n = rng.randrange(1, 9)
        bad = rng.randrange(n + 1) if "shop" in shape and rng.random() < 0.7 else 0
        good = rng.randrange(n - bad + 1) if rng.random() < 0.3 else 0
        old = counts.get((host, shape), (0, 0, 0))
        counts[host, shape] = tuple(x + y for x, y in zip(old, (n, bad, good), strict=True))
    rows = [(host, shape, *c) for (host, shape), c in counts.items()]
    df = spark.createDataFrame([(h, list(s), *c) for h, s, *c in rows], "host string, shape array<string>, n long, bad long, good long")
    for o in (urls.Options(), urls.Options(min_urls=5, min_kids=4, reject=0.6, smoothing=1.0)):
        found = {(r.host, tuple(r["shape"])): (r.template, round(r.purity, 9)) for r in urls.templates(df, o).collect()}
        expected = {k: (t, round(p, 9)) for k, (t, p) in brute_templates(rows, o).items()}
        assert found == expected and len({t for t, _ in found.values()}) > 3


def test_listed_words_label_and_templates_decide(spark):
    rows = [(f"http://m.casino-win.example.com/{'en es fr'.split()[i % 3]}/{i}",) for i in range(30)] + [("http://www.bets-one.example.com/en/1",)]
    rows += [(f"http://castrack.example.com/en/{i}",) for i in range(30)] + [(None,), ("x",)]
    out = urls.judged(spark.createDataFrame(rows, "url string")).collect()
    assert {r.host for r in out if r.verdict == "block"} == {"m.casino-win.example.com"} and sum(r.verdict == "block" for r in out) == 30
