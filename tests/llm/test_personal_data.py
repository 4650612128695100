from __future__ import annotations

import hashlib
import random
import re

import pytest
from fixtures import awkward, documents, with_clashes

from docketflow.llm import personal_data as op

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        v = int(c) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(rows, got):
    want = []
    for i, text in rows:
        spans = plain(text)
        want.append((i, *[sum(s.startswith(k) for s in spans) for k in PATTERNS], hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)


ODD = [
    "a@b.c_d@e.f g@h", "x@y.z.w-v@q.r", "a@b@c.d.e", "1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.01 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111-1",
    "+1 (555) 123-4567 +12 3 +1+2+3 +44 20 7946 0958)", "\U0001f600 mail é@ü.com ünï@x.de 4111111111111111 end", "5 5 5 a 12 34-56", "%%@a.b@c.d",
    "a.b.c@d.e..f@g.h", "0000000000000", "+1(((((((" + "(" * 500, "x" * 3000, "1" * 3000, "a@" + ".".join("b" for _ in range(4000)), "+1 23 45 67 89 +1-2-3-4-5-6-7-8-9-0",
]


def test_base_spans(spark):
    random.seed(2)
    signs = ["a", "B", "7", "1", "4", "@", ".", "-", "+", " ", "(", ")", "_", "%", "\n", "é", "\U0001f600"]
    rows = [*awkward(), *[(100 + n, t) for n, t in enumerate(ODD)]]
    rows += [(1000 + n, "".join(random.choices(signs, k=random.randrange(80)))) for n in range(800)]
    check(rows, op.personal_data(with_clashes(documents(spark, rows))).drop("text").collect())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op.personal_data(docs).drop("text").collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check(rows, got)
    texts = dict(rows)
    for r in got:
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(plain(texts[r["doc_id"]])) <= set(spans)
        assert not spans or re.search("[0-9@]", texts[r["doc_id"]])


def test_added_spans_need_the_form_of_true_ones(spark):
    """Phones without the plus have the form of true ones; other numbers don't."""
    random.seed(4)
    rows = []
    for n in range(400):
        number = f"({random.randrange(100, 999)}) 555-{random.randrange(1000, 9999)}"
        lead = "+1 " if n % 40 else ""
        rows.append((n, f"some words call {lead}{number} and more {n} or {n * 7}.{n % 9} in all"))
    got = {r["doc_id"]: r for r in op.personal_data(documents(spark, rows), precision=0.9).collect()}
    added = [n for n in range(0, 400, 40) if "phone" in got[n]["spans"]]
    assert len(added) >= 5
    assert all(len(got[n]["spans"].split(",")) == 1 for n in range(400) if n % 40)


def test_redaction(spark):
    out = op.redacted(documents(spark, [(1, "to a@b.co or 1.2.3.4!"), (2, None), (3, "nothing")])).collect()
    assert sorted(map(tuple, out)) == [(1, "to [EMAIL] or [IP]!"), (2, ""), (3, "nothing")]


def test_empty(spark):
    assert op.personal_data(documents(spark, [], 1)).count() == 0


def planted(missed, n=1500):
    """Texts with a phone, an email and a number of another form; ``missed`` of the phones and emails are outside base."""
    random.seed(9)
    rows, want = [], {}
    for i in range(n):
        out_phone, out_email = random.random() < missed, random.random() < missed
        phone = f"({random.randrange(200, 999)}) {random.randrange(200, 999)}-{random.randrange(1000, 9999)}"
        phone = phone if out_phone else f"+1 {phone}"
        user, host = f"user{i}", random.choice(["example", "mail-host", "post"])
        email = f"{user} (at) {host} (dot) org" if out_email else f"{user}@{host}.org"
        text = f"please call {phone} today or write to {email} about part {random.randrange(10, 99)}-{random.randrange(1000, 9999)}-{random.randrange(100, 999)} thanks"
        rows.append((i, text))
        want[i] = {f"{kind}:{text.index(x)}:{text.index(x) + len(x)}" for kind, x, out in (("phone", phone, out_phone), ("email", email, out_email)) if out}
    return rows, want


@pytest.mark.parametrize("missed", [0.1, 0.3])
def test_spans_that_base_misses_are_added(spark, missed):
    rows, want = planted(missed)
    hits = extra = 0
    for r in op.personal_data(documents(spark, rows)).collect():
        added = set(r["spans"].split(",")) - set(plain(r["text"]))
        hits, extra = hits + len(added & want[r["doc_id"]]), extra + len(added - want[r["doc_id"]])
    total = sum(map(len, want.values()))
    print(f"missed {missed}: added {hits} of {total}, others {extra}")
    assert hits >= 0.95 * total and extra <= 0.03 * hits


def test_a_rare_kind_keeps_its_spans_beside_a_hot_one(spark):
    """Number groups of a hot source neither crowd the emails out of the sample nor out of the threshold."""
    rows, want = planted(0.3, 200)
    for i in range(300):
        groups = [f"{random.randrange(10, 99)}-{random.randrange(1000, 9999)}-{random.randrange(100, 999)}" for _ in range(400)]
        rows.append((10_000 + i, " ; ".join(groups)))
    got = {r["doc_id"]: set(r["spans"].split(",")) for r in op.personal_data(documents(spark, rows)).where("doc_id < 10000").collect()}
    for kind in ("email", "phone"):
        spans = [(i, s) for i, found in want.items() for s in found if s.startswith(kind)]
        print(f"{kind}: added {sum(s in got[i] for i, s in spans)} of {len(spans)}")
        assert len(spans) > 40 and sum(s in got[i] for i, s in spans) >= 0.95 * len(spans)
