import hashlib
import math
import random
import re

from hypothesis import given, settings, strategies as st

from loam.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def by_regex(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@given(st.text("ab@@..%0123456789+ ()-é_", max_size=60))
@settings(max_examples=2000, deadline=None)
def test_spans_equal_plain_regexes(text):
    assert pii.base_spans(text) == by_regex(text)


def test_known_values():
    text = "mail a.b@x.org ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (988) 555-2485."
    assert [k for _, k, _ in pii.base_spans(text)] == [0, 1, 2, 3]
    assert pii.masked(text, [(a, b, pii.KINDS[k]) for a, k, b in pii.base_spans(text)]) == "mail [email] ip [ip] card [card] tel [phone]."
    assert pii.masked("abcdef", [(0, 3, "X"), (2, 5, "Y")]) == "[X]f"


def test_long_text_is_linear():
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_long_numbers(spark):
    text = "0" * 5000 + ".1.1.1 " + "9" * 5000 + ".1.1.1 +" + "1" * 100_000
    assert pii.base_spans(text) == [(0, 1, 5006)] == by_regex(text)
    rows = pii.report(pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).collect()
    assert rows[0].n_ip == 1 and rows[0].spans == "ip:0:5006"


def plain_terms(texts, threshold=0.5, support=3, width=5):
    """(entity, term) pairs that disclose, straight from the definition of pointwise mutual information."""
    seen, df, word = set(), {}, re.compile(r"[^\W\d_]{3,}")
    for text in texts:
        spans = by_regex(text or "")
        for w in set(word.findall((text or "").lower())):
            df[w] = df.get(w, 0) + 1
        said = [(m[0].lower(), m.start(), m.end()) for m in word.finditer(text or "") if not any(m.start() < b and m.end() > a for a, _, b in spans)]
        for a, k, b in spans:
            near = [w for w in said if w[2] <= a][-width:] + [w for w in said if w[1] >= b][:width]
            key = tuple(w for w, _, _ in near)
            digits = text[a:b].lower() if k == 0 else "".join(c for c in text[a:b] if c.isdigit() or k == 1 and c == ".")
            seen |= {((k, digits), key, w) for w in key}
    out = set()
    for entity in {e for e, _, _ in seen}:
        contexts = {c for e, c, _ in seen if e == entity}
        for term in {w for e, _, w in seen if e == entity}:
            both = len({c for e, c, w in seen if e == entity and w == term})
            n = max(len(texts), len(contexts))
            if both >= support and len(contexts) < n and math.log(both * n / (len(contexts) * max(df[term], both))) / math.log(n / len(contexts)) >= threshold:
                out.add((entity, term))
    return out


def test_terms_equal_a_plain_count(spark):
    rnd = random.Random(4)
    names, common = ["zorblax", "quentin", "ferrum", "oslo"], "and the with other plain words here some more filler text".split()
    mails = [f"user{i}@x.org" for i in range(4)] + ["+1 (988) 555-2485", "10.0.0.1"]
    texts = []
    for _ in range(250):
        i = rnd.randrange(8)
        words = rnd.choices(common, k=rnd.randrange(3, 14))
        if i < 6:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(names) if rnd.random() < 0.2 else names[i % 4], *(["ab", "."] * rnd.choice([0, 200])), mails[i], rnd.choice(common)]
        texts.append(" ".join(words))
    texts += [None, ""] + texts[:20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = pii.find_base(docs).checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else pii.find_base(docs)
    got = {(r.entity, r.term) for r in pii.disclosing_terms(docs, found).collect()}
    want = {(f"{pii.KINDS[k]}:{name}", term) for (k, name), term in plain_terms(texts)}
    assert got == want and len(want) > 3


def test_whole_table(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op9_pii(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = by_regex(d.text or "")
        assert [rows[d.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert rows[d.doc_id].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(rows[d.doc_id].spans.split(","))


def test_terms_that_disclose_an_entity(spark):
    rows = [(i, f"word{'abcdefgh'[i]} other{'abcdefgh'[i]} zorblax q{'abcdefgh'[i]}q boss@x.org and tail{'abcdefgh'[i]}") for i in range(5)]
    rows += [(100 + i, f"some plain words and nothing {i}") for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in pii.report(pii.find_personal_data(docs)).collect()}
    assert len(found) == len(rows)
    assert found[0].spans.count("term:") == 1 and found[0].spans.split(",")[0] == "term:13:20"
    assert found[150].spans == "" and found[900].spans == "" and found[901].n_email == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == "worda othera [TERM] qaq [EMAIL] and taila" and clean[150] == rows[55][1] and clean[900] is None


def test_terms_go_wherever_the_entity_is_known_with_or_without_id(spark):
    rows = [(i, f"word{'abcdefgh'[i]} other{'abcdefgh'[i]} zorblax q{'abcdefgh'[i]}q boss@x.org and tail{'abcdefgh'[i]}") for i in range(5)]
    far = "Zorblax came first. " + "plain words go on and on here. " * 20 + "write to boss@x.org now, says zorblax"
    rows += [(None, rows[0][1]), (None, far), (200, "zorblax alone names nobody")] + [(300 + i, f"some plain words and nothing {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    clean = [r.text for r in pii.redact(docs).collect()]
    assert clean.count("worda othera [TERM] qaq [EMAIL] and taila") == 2 and "zorblax alone names nobody" in clean
    assert [t for t in clean if t.startswith("[TERM] came first.") and t.endswith("says [TERM]")] and len(clean) == len(rows)
    spans = [r.spans for r in pii.report(pii.find_personal_data(docs)).collect()]
    assert sum(s.count("term:") for s in spans) == 5 + 1 + 2


def test_copies_of_one_document_disclose_nothing(spark):
    docs = spark.createDataFrame([(i, "alpha zorblax boss@x.org beta") for i in range(50)] + [(99, "filler text here")], "doc_id bigint, text string")
    assert all("term" not in r.spans for r in pii.report(pii.find_personal_data(docs)).collect())


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.co", 5, "x")], "doc_id bigint, text string, n_email int, spans string")
    assert pii.report(pii.find_personal_data(docs)).collect()[0].n_email == 1
    assert pii.redact(docs).collect()[0].asDict() == {"doc_id": 1, "text": "[EMAIL]", "n_email": 5, "spans": "x"}
    assert pii.report(pii.find_personal_data(docs.limit(0))).count() == 0
