import hashlib
import re

from bidloom.llm import pii
from data import DOCS, docs

TEXTS = [
    None,
    "",
    "write to a.b@c-d.org, x@y.z_q@w.ee or a@b.c_d@e.f ünïcödé \U0001F600 me@x.y.z.",
    "ip 1.2.3.4 and 999.1.1.1 and 1.2.3.4.5.6.7.8 and 0001.2.3.255 and 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 5500000000000004 12345678901234567890 7",
    "call +1 (743) 555-3824 or +49 30 1234567. or +1-2 and +123456789012345678",
    "Mrs Smith called 743-555-3824; Alice Walker too. Dr. Jekyll!",
    "@@@@ ++++ .... 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    " ".join(f"u{i}@mail.example.com" for i in range(1500)),
    "a" * 60_000 + "@" + "b" * 10,
    "1" * 30_000,
    "+1" + " " * 30_000,
    "same twice 10.0.0.1  x@y.de",
    "same twice 10.0.0.1  x@y.de",
]


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        t += n - 9 if n > 9 else n
    return t % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    out = []
    for kind, (pattern, good) in kinds.items():
        if kind == "email" and "@" not in text:
            continue
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text if len(text) < 50_000 else text.lstrip("a")) if good(m.group())]
    return out


def test_base_spans_equal_brute_force(spark):
    got = sorted(pii.digests(docs(spark, TEXTS)).collect())
    assert len(got) == len(TEXTS)
    for row, text in zip(got, TEXTS):
        want = brute(text)
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), (row, want)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for k, _, _ in want) for x in pii.BASE]
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(row.spans.split(","))


def test_redaction_keeps_clean_text_and_replaces_spans(spark):
    rows = {r.doc_id: r for r in pii.redact(docs(spark, TEXTS)).collect()}
    assert rows[3].text == "ip <IP> and 999.1.1.1 and <IP>.<IP> and <IP> and 1.2.3"
    assert rows[7].text == TEXTS[7] and rows[1].text == "" and rows[0].text == ""
    assert rows[12].text == "same twice <IP>  <EMAIL>" and rows[12].n_chars == len(rows[12].text)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOCS)
    assert pii.digests(empty).count() == 0
    odd = spark.createDataFrame([(None, "x@y.de", "a", 1)], "doc_id long, text string, spans string, k int")
    assert pii.digests(odd).first().n_email == 1


def test_reliabilities_prefer_the_labeler_that_agrees(spark):
    rows = [(0, 1, 1, -1)] * 60 + [(0, 0, 0, -1)] * 60 + [(0, 1, 0, 1)] * 5 + [(0, 0, 1, 0)] * 5
    q = pii.reliabilities(spark.createDataFrame(rows, "k int, r int, g int, c int")).first().q
    assert q.r1 > 0.85 and q.r0 < 0.15


def cut_up(text, spans):
    """The text with its spans as find() lists them replaced, by a loop."""
    spans = sorted((int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0]), int(x.split(":")[2])) for x in spans.split(",") if x)
    out, last = "", 0
    for start, kind, end in spans:
        if start >= last:
            out += text[last:start] + f"<{pii.KINDS[kind].upper()}>"
        last = max(last, end)
    return out + text[last:]


def test_redaction_equals_a_loop_over_the_spans(spark):
    texts = [*TEXTS, "\ufeffx@y.de\ufeff\U0001F600 +1 743 555 3824", "+49 4111 1111 1111 1111 x@1.2.3.4", "a@b.c " * 20_000, "Call Anna Berger or Mr 4111-1111-1111-1111"]
    spans = {r.doc_id: r.spans for r in pii.digests(docs(spark, texts)).collect()}
    for row in pii.redact(docs(spark, texts)).collect():
        assert row.text == cut_up(texts[row.doc_id] or "", spans[row.doc_id])


def test_the_classifier_finds_names_and_local_phones(spark):
    texts = ["Mrs Smith and Dr Jekyll met", "see 743-555-3824 today", "Anna Berger wrote", "in Victoria Street", "Maria March 800-123-4567 x", "nobody"] + ["order 12 with nothing"] * 5
    got = {r.doc_id: r.spans for r in pii.digests(docs(spark, texts)).collect()}
    assert got[0] == "name:0:9,name:14:23" and got[1] == "local_phone:4:16" and got[2] == "name:0:11"
    assert got[3] == "" and got[6] == ""


def test_labelers_can_disagree_on_every_kind(spark):
    texts = ["x@y.de a..b@y.z", "10.0.0.1 8.8.8.8 1.2.3.4 08.1.1.1", "4111 1111 1111 1111 4111111111111112 91 1111 1111 1111 1111", "+49 30 1234567 +999 --- 1234567", "743-555-3824 800-155-3824", "Anna Berger Anna XX Mr Monday"]
    for row in pii.candidates(docs(spark, texts)).selectExpr("explode(spans) x").groupBy("x.k").agg({"x.r": "collect_set"}).toDF("k", "r").collect():
        assert len(row.r) > 1, row


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "x@y.de", None, None, None)] * 2 + [(1, None, None, None, None)] * 2
    assert sorted((r.doc_id or -1, r.n_email) for r in pii.digests(spark.createDataFrame(rows, DOCS)).collect()) == [(-1, 1), (-1, 1), (1, 0), (1, 0)]
    assert sorted(r.text for r in pii.redact(spark.createDataFrame(rows, DOCS)).collect()) == ["", "", "<EMAIL>", "<EMAIL>"]
