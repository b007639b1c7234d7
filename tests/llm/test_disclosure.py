"""What copies and distance do to disclosing terms."""

import math
import random
import re

from pyspark.sql import functions as F

from millrace.llm import pii

NOTES = [f"note {i} from Zebulon at zeb@example.org about {'alpha beta gamma delta'.split()[i]} thing" for i in range(4)]
PLAIN = [f"plain text about thing {'abcdefgh'[i % 8] * (1 + i // 8)} {i}" for i in range(60)]


def spans(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [(s.start, s.kind, s.end, s.context) for s in r.spans] for r in pii.with_spans(df).collect()}


def test_copies_of_a_document_change_no_span(spark):
    once = spans(spark, NOTES + PLAIN)
    assert any(kind == len(pii.KINDS) for _, kind, _, _ in once[0])
    for copied in (0, 10):
        more = spans(spark, NOTES + PLAIN + [(NOTES + PLAIN)[copied]] * 1000)
        assert {i: more[i] for i in once} == once
        assert all(more[i] == once[copied] for i in more if i not in once)


def test_terms_far_from_the_entity_are_found(spark):
    # words between that many texts have, so that only the name gives the address away
    filler = "common words of every letter " * 20
    letters = [f"Zebulon {filler}{'alpha beta gamma delta'.split()[i]} {filler} zeb@example.org" for i in range(4)]
    found = spans(spark, letters + [f"{filler}{text}" for text in PLAIN])
    assert all((0, len(pii.KINDS), 7, "removed") in found[i] for i in range(4))
    assert all(len(found[i]) == 2 for i in range(4)) and not any(found[4 + i] for i in range(60))


def test_one_text_supports_a_term_in_different_contexts(spark):
    text = " ".join(f"Zebulon at zeb@example.org {'alpha beta gamma delta'.split()[i]} {'x ' * 60}" for i in range(4))
    found = spans(spark, [text, *PLAIN])
    assert sum(kind == len(pii.KINDS) for _, kind, _, _ in found[0]) == 4


def test_certainty_and_bits_against_brute_force(spark):
    """All pairs of an entity, group or kind and a term, counted in Python over different texts."""
    rng = random.Random(13)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    texts = []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randrange(2, 30))]
        if i % 4 == 0:
            box = rng.randrange(6)
            w += [f"user{rng.randrange(3)}@host{box}.example.org", *rng.choice([["Boxword" + "abcdef"[box]], []]), *rng.choice([["mailbox"], []])]
        if i % 9 == 0:
            w += [f"10.0.{rng.randrange(3)}.{rng.randrange(4)}", "gateway"]
        texts.append(" ".join(w))
    texts += texts[:50]
    options = pii.Disclosure(support=3, certainty=0.3, bits=1.0)
    email = re.compile(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
    ip = re.compile(r"([0-9]+\.[0-9]+\.[0-9]+)\.[0-9]+")
    different, holds, has = set(texts), {}, {}
    for t in different:
        for kind, pattern in ((0, email), (1, ip)):
            for m in pattern.finditer(t):
                for e in ((0, kind, m[0]), (1, kind, m[1]), (2, kind, "")):
                    holds.setdefault(e, set()).add(t)
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            has.setdefault(w, set()).add(t)
    expected = set()
    for e, own in holds.items():
        for w, with_w in has.items():
            both, n = len(own & with_w), len(with_w)
            p = both / n
            if e[0]:
                z = options.z
                p = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if len(w) >= 3 and both >= 3 and p >= 0.3 and math.log2(p / (len(own) / len(different))) >= 1:
                expected.add((w, round(p, 9), round(math.log2(p / (len(own) / len(different))), 9)))
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("of", F.md5("text"))
    held = pii.with_base_spans(df, "text", options.context).select("of", F.explode("base").alias("s"))
    held = held.select("of", F.explode(pii.entities_of(F.col("s"))).alias("e"), F.col("s.context").alias("context")).select("of", "e.level", "e.entity", "context")
    found = {(r.term, round(r.certainty, 9), round(r.bits, 9)) for r in pii.disclosing(df, held, options).collect()}
    # a single text supports a term in different contexts; here no text has an entity three times
    assert found == expected and {w for w, _, _ in found} >= {"boxworda", "gateway"}


def test_entities_of_a_group_share_evidence(spark):
    fill = "words of many letters that are in all the texts here and wrote from"
    notes = [f"{fill} Acme person{i}@acme.example.com {i}" for i in range(9)]
    found = spans(spark, notes + [f"{fill} {i}" for i in range(150)])
    # the parts of the address itself lie within the base span
    assert all([(s[1], s[0]) for s in found[i]] == [(len(pii.KINDS), len(fill) + 1), (0, len(fill) + 6)] for i in range(9))
    assert not any(found[9 + i] for i in range(150))
