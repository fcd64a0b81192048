import hashlib
import random
import re

from tests.llm.corpus import documents, frame, prose
from weirspan.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


CASES = [
    "mail a.b+c@x-y.example.com, A@b.c._d@e.f.g x@y a@b@c.d.e @x.y é@é.com", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9999999999.1.1.1 1..2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 or 4111  1111 1111 1111 and 4111111111111112", "+1 (456) 555-2186 +49 30 1234567 +1 2 +12345678901234567 ++1-234-567-8901.",
    "🎉🎉 é x@y.zz 🎉 10.0.0.1", "+1 415 555 2671 4012888888881881", "0000.00.0.0", "5" * 4000, "1 " * 3000, "a" * 20_000, "a." * 5000 + "@b.c", "+1" + " " * 9000 + "2", "378282246310005 6011111111111117",
]


def spell(text):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute(text))


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("a1+@.- ()9é") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = documents() + [(1000 + i, t) for i, t in enumerate(CASES + noise)] + [(5000, CASES[0])] * 2
    got = pii.report(frame(spark, rows)).collect()
    want = []
    for doc, text in rows:
        kinds = [k for _, k, _ in brute(text)]
        want.append((doc, *[kinds.count(k) for k in range(4)], hashlib.sha256(spell(text).encode()).hexdigest()))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.KINDS] == [s for s in spell(dict(rows).get(r.doc_id) if r.doc_id != 98 else "").split(",") if s] or r.doc_id is None


def disclosing():
    rows = [(i, f"{prose(i, 30)} Zanzibar wrote from ann@x.example.com about Quimby again {prose(50 + i, 30)} Zanzibar") for i in range(4)]
    rows += [(10 + i, f"{prose(20 + i, 40)} Quimby {prose(30 + i, 5)}") for i in range(2)]
    return rows + [(100 + i, prose(900 + i, 60)) for i in range(60)]


def test_terms_that_disclose_an_entity(spark):
    """A name seen only beside the address is removed wherever the address is; one seen elsewhere too is generalised; common words stay."""
    docs = spark.createDataFrame(disclosing(), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    for doc, text in disclosing()[:4]:
        spans = [s.split(":") for s in got[doc].split(",")]
        named = {(k, text[int(a) : int(b)]) for k, a, b in spans}
        assert {("email", "ann@x.example.com"), ("remove", "Zanzibar")} <= named
        assert sum(k == "remove" and text[int(a) : int(b)] == "Zanzibar" for k, a, b in spans) == 2
        assert ("generalise", "Quimby") in named
        assert not {w for k, w in named if k in pii.TERM_KINDS} & set(prose(1, 500).split())
    assert all(not got[d] for d, _ in disclosing()[4:])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "[EMAIL]" in clean[0] and "Zanzibar" not in clean[0] and " Q. " in clean[0] and clean[100] == dict(disclosing())[100]


def test_sanitise_keeps_rows_and_columns(spark):
    docs = frame(spark, documents() + [(1000 + i, t) for i, t in enumerate(CASES)])
    found = pii.sanitise(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    assert "x@y.zz" not in found.where("doc_id = 1004").first().text


def test_empty_table(spark):
    assert pii.report(frame(spark, [])).collect() == []
