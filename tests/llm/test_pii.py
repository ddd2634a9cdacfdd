import hashlib
import random
import re

from grovespark.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            s, digits = m.group(), re.sub(r"\D", "", m.group())
            if kind == "ip" and not all(int(p) <= 255 for p in s.split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and brute_luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def brute_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_base_spans_equal_the_rules():
    rng = random.Random(7)
    for _ in range(6000):
        text = "".join(rng.choice(["a", "b.c", "@", ".", "1", "23", "255.", " ", "-", "+", "(", ")", "é", "4539578763621486", "_", "x@y.z", "+1 (017) 555-7713"]) for _ in range(rng.randrange(14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000, "ab at " * 50_000):
        pii.scan_text(text + "@")


def test_query_adds_and_keeps(spark):
    rows = [
        (1, "Mail jo@mail.example.com or call +1 (017) 555-7713."),
        (2, None),
        (3, ""),
        (4, "write to jo.doe (at) mail (dot) example (dot) com today"),
        (5, "order 1234 5678 shipped, é 10.20.30.40"),
        (1, "Mail jo@mail.example.com or call +1 (017) 555-7713."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.op8(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert (by[1]["n_email"], by[1]["n_phone"], by[1]["n_ip"], by[1]["n_card"]) == (1, 1, 0, 0)
    assert by[1]["spans"] == "email:5:24,phone:33:50"
    assert by[1]["base_sha256"] == hashlib.sha256(b"email:5:24,phone:33:50").hexdigest()
    assert by[2]["spans"] == by[3]["spans"] == ""
    assert by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[4]["n_email"] == 0 and by[4]["spans"].startswith("email:9:")
    assert by[5]["spans"] == "ip:27:38"


def test_mask_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "x jo@mail.example.com y", "k", 2), (2, None, "k", 3)], "id long, text string, kind string, votes int")
    out = {r["id"]: r for r in pii.mask(docs).collect()}
    assert out[1]["text"] == "x [EMAIL] y" and out[2]["text"] is None and out[1].asDict().keys() == {"id", "text", "kind", "votes"}
    assert pii.mask(docs.where("id > 5")).count() == 0 and pii.spans(docs.where("id > 5"), id_col="id").count() == 0


def test_classifier_finds_what_rules_miss(spark):
    """Planted spans that no plain rule has, and decoys of the same shapes: the classifier adds the ones, not the others."""
    rng = random.Random(12)
    n = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    filler = lambda: " ".join(rng.choice("river stone walk paper green the of and".split()) for _ in range(12))
    rows, planted = [], {}
    for i in range(600):
        text = f"{filler()} mail jo{n(2)}@mail.example.com or call +1 ({n(3)}) 555-{n(4)} {filler()} "
        kind = i % 4
        if kind == 0:
            extra, lead = f"({n(3)}) {n(3)}-{n(4)}", "call the office phone "
        elif kind == 1:
            extra, lead = f"ann{n(2)} (at) mail (dot) example (dot) com", "write to our email "
        elif kind == 2:
            extra, lead = f"{n(4)} {n(4)} {n(4)} {n(3)}", "invoice order "
        else:
            extra, lead = f"{n(3)}-{n(3)}-{n(4)}", "serial no "
        if kind < 2:
            planted[i] = (len(text + lead), len(text + lead + extra))
        rows.append((i, text + lead + extra + " " + filler()))
    out = pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if not s["base"]] for r in out}
    caught = sum(planted[i] in added[i] for i in planted)
    wrong = sum(len(v) for i, v in added.items() if i not in planted)
    assert all(sum(s["base"] for s in r["spans"]) >= 2 for r in out)
    print("caught", caught, "of", len(planted), "wrong", wrong)
    assert caught >= 0.95 * len(planted) and wrong <= 15


def test_longer_spans_before_are_not_overlapped():
    text = "x@y.z (at) b (dot) com 1.2.3.4 1.2.3.4 1.2.3.4 1.2.3.4 1.2.3.4"
    base = pii.base_spans(text)
    assert all(a >= e or b <= s for _, a, b in pii.more_candidates(text, base) for _, s, e in base)
