"""Votes, expectation-maximisation and posterior against brute force, and odd rows."""

import math
import random
import re

from millrace.llm import quality

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute_votes(text):
    """The votes of one text, worked out in Python."""
    t = text or ""
    w = SPACED.findall(t)
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in t.split("\n") if SPACED.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(n - 2)]
    repeated = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    share = lambda a, b: a / b if b else None
    symbols, stops = share(len(re.findall(r"[#*$%&|<>]", t)), n), share(t.count("."), n)
    function = len(set(w) & set(quality.FUNCTION_WORDS))
    length, dup = share(chars, n), share(len(lines) - len(set(lines)), len(lines))
    capitals, marks = share(sum(c in quality.CAPITALS for c in t), chars), share(len(re.findall("[!?]", t)), n)
    vote = lambda good, bad: "b" if bad else "g" if good else "-"
    no = lambda x, f: x is not None and f(x)
    votes = [
        vote(no(symbols, lambda x: x < 0.02), no(symbols, lambda x: x > 0.1)),
        vote(function >= 4, function <= 1 and n >= 50),
        vote(no(stops, lambda x: 0.01 <= x <= 0.3), no(stops, lambda x: x < 0.002)),
        vote(False, no(length, lambda x: x < 2 or x > 14)),
        vote(False, no(dup, lambda x: x > 0.3)),
        vote(False, no(share(len(repeated), n), lambda x: x > 0.3)),
        vote(False, no(capitals, lambda x: x > 0.4)),
        vote(False, no(marks, lambda x: x > 0.3)),
    ]
    return "".join(votes), n < 50 or 100 * len(repeated) > 50 * n


def brute_fit(patterns, only_bad, rounds=400):
    """The same model by a loop over documents, with the beliefs added as so many documents."""
    beliefs = [quality.ONLY_BAD if x else quality.BOTH for x in only_bad]
    prior, tables = quality.GOOD_SHARE, [[dict(b[c]) for b in beliefs] for c in (0, 1)]
    for _ in range(rounds):
        weight = []
        for p in patterns:
            good, bad = prior, 1 - prior
            for j, v in enumerate(p):
                good, bad = good * tables[0][j][v], bad * tables[1][j][v]
            weight.append(good / (good + bad))
        new = []
        for c in (0, 1):
            share = [w if c == 0 else 1 - w for w in weight]
            mass = sum(share)
            new.append(
                [
                    {v: (sum(s for s, p in zip(share, patterns, strict=True) if p[j] == v) + quality.STRENGTH * mass * b[c][v]) / ((1 + quality.STRENGTH) * mass) for v in "gb-"}
                    for j, b in enumerate(beliefs)
                ]
            )
        tables, prior = new, (sum(weight) + quality.GOOD_SHARE) / (len(patterns) + 1)
    return prior, tables


def simulated(rng, n, prior, good, bad):
    out, truth = [], []
    for _ in range(n):
        is_good = rng.random() < prior
        out.append("".join(rng.choices("gb-", [t[v] for v in "gb-"])[0] for t in (good if is_good else bad)))
        truth.append(is_good)
    return out, truth


GOOD = [{"g": 0.7, "b": 0.05, "-": 0.25}] * 3 + [{"g": 0, "b": 0.02, "-": 0.98}] * 2
BAD = [{"g": 0.1, "b": 0.6, "-": 0.3}] * 3 + [{"g": 0, "b": 0.5, "-": 0.5}] * 2
ONLY = (False, False, False, True, True)


def test_expectation_maximisation_against_a_loop_over_documents():
    patterns, _ = simulated(random.Random(17), 300, 0.75, GOOD, BAD)
    counts = {p: patterns.count(p) for p in set(patterns)}
    model = quality.fit(counts, ONLY, rounds=400, tolerance=0)
    prior, tables = brute_fit(patterns, ONLY)
    assert math.isclose(model.prior, prior, rel_tol=1e-6)
    for c, own in enumerate((model.good, model.bad)):
        for j, table in enumerate(own):
            assert all(math.isclose(table[v], tables[c][j][v], rel_tol=1e-5, abs_tol=1e-9) for v in "gb-")


def test_accuracies_and_posterior_are_recovered():
    patterns, truth = simulated(random.Random(18), 20_000, 0.75, GOOD, BAD)
    model = quality.fit({p: patterns.count(p) for p in set(patterns)}, ONLY)
    assert abs(model.prior - 0.75) < 0.03
    assert all(abs(m["b"] - t["b"]) < 0.05 for own, true in ((model.good, GOOD), (model.bad, BAD)) for m, t in zip(own, true, strict=True))
    said = [model.log_odds(p) >= 0 for p in patterns]
    assert sum(s == t for s, t in zip(said, truth, strict=True)) / len(truth) > 0.93


def test_votes_and_posterior_of_odd_rows(spark):
    rng = random.Random(19)
    words = [*quality.FUNCTION_WORDS[:40], "Word", "###", "a.", "b!", "SHOUT", "long" * 5]
    texts = [None, "", " \n\t ", "same " * 5000, "\n".join(["one line of words"] * 30), "é😀 " * 80]
    texts += ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    rows = [(i if i % 10 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS pattern", "'own' AS kept", "'own' AS row", "'own' AS quality")
    out = quality.judged(df).collect()
    brute = {t: brute_votes(t) for t in set(texts) if t is None or len(t) < 20_000}
    counts = {}
    for r in quality._voted(df, "text", ["text"]).collect():
        if r.row.text in brute:
            assert (r.pattern, r.base_failed) == brute[r.row.text]
        counts[r.pattern] = counts.get(r.pattern, 0) + 1
    model = quality.fit(counts, quality.ONLY_BAD_RULES)
    assert len(out) == len(rows) and all(r.pattern == "own" and r.row == "own" for r in out)
    for r in out:
        if r.text in brute:
            posterior = 1 / (1 + math.exp(-model.log_odds(brute[r.text][0])))
            assert math.isclose(r.quality, posterior, rel_tol=1e-9) and r.kept == (not r.base_failed and posterior >= 0.5)
    kept = quality.kept_rows(df).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(str((r.doc_id, r.text)) for r in out if r.kept) and kept[0].pattern == "own"
    assert quality.judged(df.limit(0)).collect() == [] and quality.kept_rows(df.limit(0)).collect() == []
