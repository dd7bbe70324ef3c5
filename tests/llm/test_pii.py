import hashlib
import math
import random
import re
import time
from collections import Counter

from llm_data import SHAPE, awkward_rows, prose

from loomspark.llm.pii import CONTEXT, DISCLOSURE, op2_pii_sanitisation, pii_spans, sanitise

RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


KIND = {name: k for k, (name, _, _) in enumerate(RULES)}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, text) if ok(m[0])]
    return [f"{RULES[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def agree(found, rows):
    exact = {}
    for doc_id, text, *_ in rows:
        exact.setdefault(doc_id, []).append(base(text or ""))
    for r in found:
        spans = next((s for s in exact[r.doc_id] if hashlib.sha256(",".join(s).encode()).hexdigest() == r.base_sha256), None)
        assert spans is not None, r
        counts = [sum(s.startswith(name + ":") for s in spans) for name, _, _ in RULES]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        listed = r.spans.split(",") if r.spans else []
        assert [s for s in listed if not s.startswith("term:")] == spans


def test_random_strings_match_brute_force(spark):
    draw = random.Random(2)
    rows = []
    for i in range(3_000):
        kind = draw.choice(["ab@.-+ 0", "0123456789 -", "0129.", "+0123456789 ().-", "aB0@._%+-é😀\n 12", "@a.", "4 -"])
        rows.append((i, "".join(draw.choice(kind) for _ in range(draw.randrange(1, 90))), "en", "a", 1))
    rows += [(5_000 + i, f"x {t} y", "en", "a", 1) for i, t in enumerate(["4111111111111111", "4111-1111-1111-1111", "+49 30 12345678", "255.255.255.255", "256.1.1.1", "000255.1.1.1", "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "a@b@c.d", "a@b.c..x@y.z", "é@é.com", "9" * 5000, "1 " * 5000])]
    agree(pii_spans(spark.createDataFrame(rows, SHAPE)).collect(), rows)


def terms(rows):
    """The term spans of each row, by the definition."""
    told, df_term, df_entity, both = [], Counter(), Counter(), Counter()
    for _, text, *_ in rows:
        spans = [(m.start(), m.end(), (k, m[0])) for k, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, text) if ok(m[0])]
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]{3,}", text)]
        free = [w for w in words if not any(a < w[1] and w[0] < b for a, b, _ in spans)]
        near = {(e, t) for x, y, t in free for a, b, e in spans if a - CONTEXT <= x and y <= a or b <= x and y <= b + CONTEXT}
        df_term.update({t for *_, t in words})
        df_entity.update({e for *_, e in spans})
        both.update(near)
        told.append((free, {e for *_, e in spans}))
    n = len(rows)
    pairs = {(e, t) for (e, t), c in both.items() if (own := math.log(n / df_entity[e])) > 0 and math.log(c * n / (df_entity[e] * df_term[t])) >= DISCLOSURE * own - 1e-12}
    return [sorted((x, y) for x, y, t in free if any((e, t) in pairs for e in held)) for free, held in told]


def test_term_spans_match_brute_force(spark):
    draw, rows = random.Random(8), []
    for i in range(150):
        bits = prose(i, 40).split()
        for _ in range(draw.choice([0, 0, 1, 2, 3])):
            at, k = draw.randrange(len(bits)), draw.randrange(40)
            bits[at:at] = [draw.choice([f"Name{k}", f"Name{k}", "name of", f"Boss{k % 3}x"]), (f"p{k}@site{k % 4}.org", f"10.0.0.{k}", f"+49 30 123456{k:02}")[k % 3]]
        rows.append((i, " ".join(bits) + draw.choice(["", " Name3 at last"]), "en", "a", 1))
    rows += rows[:5]
    found = Counter((r.doc_id, ",".join(x for x in r.spans.split(",") if x.startswith("term"))) for r in pii_spans(spark.createDataFrame(rows, SHAPE)).collect())
    wanted = Counter((r[0], ",".join(f"term:{a}:{b}" for a, b in own)) for r, own in zip(rows, terms(rows), strict=True))
    assert found == wanted and sum(bool(k[1]) for k in wanted) > 20


def test_very_many_matches_in_one_text(spark):
    """100,000 addresses in one text take seconds, and all of them go."""
    text = " ".join(f"user{i}@host{i % 977}.example" for i in range(100_000))
    df = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, prose(1, 50), "en", "a", 1)], SHAPE)
    began = time.time()
    told = {r.doc_id: r for r in pii_spans(df).collect()}
    assert told[1].n_email == 100_000 and told[1].spans.startswith("email:0:19,email:20:")
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert clean[1] == " ".join(["<EMAIL>"] * 100_000) and clean[2] == prose(1, 50)
    assert time.time() - began < 90


def test_sanitised_text_is_cut_where_spans_are(spark):
    draw, rows = random.Random(9), []
    for i in range(60):
        rows.append((i, " ".join(draw.choice([prose(j, 9), "é😀" * draw.randrange(40), f"a{j}@b.example", "4111 1111 1111 1111", "+49 30 1234567 10.1.2.3"]) for j in range(draw.randrange(1, 300))), "en", "a", 1))
    df = spark.createDataFrame(rows, SHAPE)
    spans = {r.doc_id: [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)] for r in pii_spans(df).collect()}
    for r in sanitise(df).collect():
        text, out, at = rows[r.doc_id][1], [], 0
        for a, b, kind in spans[r.doc_id]:
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        assert r.text == "".join(out) + text[at:] and r.n_chars == (len(r.text) if spans[r.doc_id] else 1)


def test_terms_that_disclose_an_entity(spark):
    """A word that occurs only next to one address gives it away; common words don't."""
    rows = [(i, f"{prose(i, 12)} Please ask Zorblatt at z@corp.example today {prose(99 + i, 12)}", "en", "a", 1) for i in range(4)]
    rows += [(100 + i, f"please see the note today at noon {prose(500 + i, 30)}", "en", "a", 1) for i in range(40)]
    rows += [(200 + i, f"ask at u{i}@corp.example {prose(700 + i, 20)}", "en", "a", 1) for i in range(10)]
    df = spark.createDataFrame(rows, SHAPE)
    found = {r.doc_id: r.spans for r in pii_spans(df).collect()}
    for i, text, *_ in rows[:4]:
        at = text.index("Zorblatt")
        assert f"term:{at}:{at + 8}" in found[i].split(",")
        assert f"term:{text.index('today')}" not in found[i]
    clean = {r.doc_id: r.text for r in sanitise(df).collect()}
    assert "Zorblatt" not in clean[0] and "z@corp" not in clean[0] and "<EMAIL>" in clean[0] and "<TERM>" in clean[0]
    assert clean[100] == rows[4][1]


def test_terms_that_disclose_an_entity_of_one_text(spark):
    """An entity that occurs in a single text is judged like any other."""
    rows = [(0, f"{prose(1, 12)} ask Zorblatt at z@corp.example today {prose(2, 12)}", "en", "a", 1)]
    rows += [(1 + i, f"ask today {prose(100 + i, 60)}", "en", "a", 1) for i in range(40)]
    found = {r.doc_id: r.spans.split(",") for r in pii_spans(spark.createDataFrame(rows, SHAPE)).collect()}
    at, today = rows[0][1].index("Zorblatt"), rows[0][1].index("today")
    assert f"term:{at}:{at + 8}" in found[0]
    assert f"term:{today}:{today + 5}" not in found[0]


def test_sanitise_keeps_columns_and_recounts(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    found = sanitise(docs)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    rows = {r.doc_id: r for r in found.where("doc_id in (10, 16, 17)").collect()}
    assert rows[16].text.count("<EMAIL>") == 5 and "4111" not in rows[16].text and rows[16].n_chars == len(rows[16].text)
    assert found.count() == docs.count()


def test_awkward_rows(spark, awkward):
    agree(op2_pii_sanitisation(spark, awkward).collect(), awkward_rows())


def test_empty(spark, empty):
    assert op2_pii_sanitisation(spark, empty).count() == 0
