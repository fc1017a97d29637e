import hashlib
import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from meridian.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("0123459. -+@()ab%é\n"), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_known_values():
    text = "mail a.b+c@x-y.co.uk, 10.0.0.255 and 10.0.0.256; card 4111 1111 1111 1111 not 4111 1111 1111 1112; +1 (212) 555-0100 a@b@c.d é@f.g"
    assert pii.base_spans(text) == brute(text)
    assert {k for k, _, _ in pii.base_spans(text)} == {"email", "ip", "card", "phone"}


def test_digit_runs_are_linear():
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("a" * 300_000 + "@") == []


def _docs(spark):
    rows = [(i, f"note {i} about zanzibar project: contact Boss at boss@corp.example today number {i}") for i in range(6)]
    rows += [(i, f"plain text {i} about today and the project with nothing else number") for i in range(100, 160)]
    return spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")


def brute_disclosing(texts, window=pii.WINDOW):
    """The terms by plain sets of texts: every level of every entity against every term near it."""
    texts = sorted(set(texts))
    holds, near, has = {}, {}, {}
    for i, text in enumerate(texts):
        base = brute(text)
        spans = base + pii.secret_spans(text, base)
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(pii._WORD.pattern, text)]
        for _, _, w in words:
            has.setdefault(w, set()).add(i)
        for kind, a, b in spans:
            before, after = [x for x in words if x[1] <= a][-window:], [x for x in words if x[0] >= b][:window]
            for level in pii.levels(kind, text[a:b]):
                holds.setdefault(level, set()).add(i)
                for s, e, w in before + after:
                    if not any(x < e and s < y for _, x, y in spans):
                        near.setdefault((level, w), set()).add(i)
    out = set()
    for (level, w), both in near.items():
        left = math.log2((len(has[w]) + pii.SMOOTHING) / len(both))
        told = math.log2(len(texts) / len(holds[level])) - left
        if left <= pii.LEFT + 1e-9 and told >= pii.TOLD - 1e-9:
            out.add(w)
    return out


def test_disclosing_terms_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(200)
    texts = [r.text or "" for r in rows.collect()] + [r.text or "" for r in _docs(spark).collect()] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.term for r in pii.disclosing_terms(docs).collect()}
    want = brute_disclosing(texts)
    assert want and got == {pii._hash(w) for w in want}


def test_maps_alone_change_nothing(spark, monkeypatch):
    want = sorted(tuple(r) for r in pii.scan(_docs(spark)).collect())
    clean = sorted((r.doc_id, r.text) for r in pii.sanitise(_docs(spark)).collect() if r.text)
    monkeypatch.setattr(pii, "MOST_EXACT", 0)
    monkeypatch.setattr(pii, "sized", lambda n: 1 << 16)
    assert sorted(tuple(r) for r in pii.scan(_docs(spark)).collect()) == want
    assert sorted((r.doc_id, r.text) for r in pii.sanitise(_docs(spark)).collect() if r.text) == clean


def test_disclosing_terms_are_found_and_common_ones_left(spark):
    rows = {r.doc_id: r for r in pii.scan(_docs(spark)).collect()}
    text = {r.doc_id: r.text or "" for r in _docs(spark).collect()}
    spans = [s.split(":") for s in rows[3].spans.split(",")]
    found = {text[3][int(a) : int(b)].lower() for k, a, b in spans if k == "term"}
    assert found >= {"contact", "boss", "at"} and not found & {"about", "today", "project", "number"}
    assert rows[3].n_email == 1 and rows[3].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(text[3])).encode()).hexdigest()
    assert rows[3].n_spans == len(spans) == 1 + rows[3].n_terms
    assert all(rows[i].spans == "" and rows[i].n_spans == 0 for i in range(100, 160))
    assert rows[500].base_sha256 == rows[501].base_sha256 == hashlib.sha256(b"").hexdigest()
    cleaned = {r.doc_id: r.text for r in pii.sanitise(_docs(spark)).collect()}
    assert len(cleaned) == 68 and cleaned[500] is None and cleaned[100] == text[100]
    assert "boss" not in cleaned[3].lower() and "[email]" in cleaned[3] and "today" in cleaned[3]


def test_levels_go_from_the_value_to_the_kind():
    assert pii.levels("email", "A.B@X.org") == ["email:0:a.b@x.org", "email:1:@x.org", "email"]
    assert pii.levels("ip", "10.00.3.4") == ["ip:0:10.0.3.4", "ip:1:10.0.3", "ip:2:10.0", "ip"]
    assert pii.levels("card", "4111 1111-11") == ["card:0:4111111111", "card:1:411111", "card"]


def test_terms_of_a_kind_are_disclosing(spark):
    """Every value, domain and neighbour differs: only the kind recurs."""
    rows = [(i, f"some words hotline +1 212 555 {1000 + 37 * i} other words n{i} and the rest") for i in range(8)]
    rows += [(i, f"some words other words and the rest of text {i}") for i in range(100, 200)]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows[:8]:
        terms = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"}
        assert "hotline" in terms and not terms & {"some", "words", "other", "rest"}
    assert all(got[i].n_spans == 0 for i in range(100, 200))


def test_secrets():
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    text = f'the token = "{key}" and aaaaaaaaaaaaaaaaaaaaaaaaa1111, 11111111111111111111111111, internationalisationsandmore, a1b2c3'
    assert [text[a:b] for _, a, b in pii.secret_spans(text, [])] == [key]
    assert pii.secret_spans(text, [("email", text.index(key), text.index(key) + 5)]) == []
    assert pii.clean(text, []) == text.replace(key, "[secret]")


def test_words_of_stretches(monkeypatch):
    monkeypatch.setattr(pii, "_SLAB", 5)
    text = "alpha beta-gamma\u3000delta  x"
    assert "".join(pii._stretches(text)) == text
    assert {w for part in pii._stretches(text) for w in pii._WORD.findall(part)} == set(pii._WORD.findall(text))


def test_what_stands_beside_an_entity_that_occurs_once(spark):
    rows = [(i, f"plain text {i} about today and the project with nothing else number") for i in range(100, 200)]
    once = [(i, f"today the project of {name} {name.lower()}@corp.example and nothing else") for i, name in enumerate(["Quillon", "Zebrowski", "Ottoline"])]
    docs = spark.createDataFrame([*rows, *once, *once[:1] * 30], "doc_id long, text string")
    cleaned = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert all("project" in cleaned[i] and "[name] [email] and nothing else" in cleaned[i] for i in range(3))
    assert all(cleaned[i] == t for i, t in rows)
    found = {r.doc_id: r for r in pii.scan(docs).collect()}
    assert all(f"term:{t.index(n)}:{t.index(n) + len(n)}" in found[i].spans.split(",") for (i, t), n in zip(once, ["Quillon", "Zebrowski", "Ottoline"], strict=True))


def test_dotted_capitals_and_far_words(spark):
    assert pii.nearby("Anna " + "-" * 900 + " a@b.cd " + "x" * 300 + " Berta", [("email", 906, 912)]) == {(pii._hash(e), pii._hash(w)) for e in pii.levels("email", "a@b.cd") for w in ("anna", "x" * 300, "berta")}
    text = "today the project of İpek info@corp.example and nothing else"
    docs = spark.createDataFrame([(0, text), *((i, f"plain text {i} about today and the project with nothing else of and") for i in range(100, 200))], "doc_id long, text string")
    assert "[name] [email]" in {r.doc_id: r.text for r in pii.sanitise(docs).collect()}[0]
    assert f"term:{text.index('İ')}:{text.index('İ') + 4}" in {r.doc_id: r.spans for r in pii.scan(docs).collect()}[0].split(",")


def test_exact_copies_alone_disclose_nothing(spark):
    docs = spark.createDataFrame([(i, "unusual words near me@here.example again") for i in range(20)] + [(i, "other text") for i in range(30, 90)], "doc_id long, text string")
    assert pii.scan(docs).agg({"n_terms": "sum"}).first()[0] == 0


def test_hard_rows(hard, empty):
    rows = pii.scan(hard).collect()
    texts = [r.text or "" for r in hard.collect()]
    assert sorted(r.base_sha256 for r in rows) == sorted(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)).encode()).hexdigest() for t in texts if len(t) < 100_000 or True)
    out = pii.sanitise(hard)
    assert out.columns == hard.columns and out.count() == hard.count() and out.where("text is null").count() == 1
    assert not any(brute(r.text or "") for r in out.collect())
    assert pii.scan(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_overlaps_are_cleaned_once():
    assert pii.clean("mail a@10.0.0.1, now", []) == "mail [email], now"
    assert pii.clean("Boss met 42 aide", [(0, 4), (9, 11), (12, 16)]) == "[name] met [number] "


def test_removing_makes_no_personal_data():
    text = "ring +1 abc 234 5678 9"
    assert pii.clean(text, [(8, 11)]) == "ring [phone]"


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("0123459. -+@()abé\n"), max_size=60), st.data())
def test_nothing_is_left_to_find(text, data):
    words = [m.span() for m in pii._WORD.finditer(text) if m.group().isalpha()]
    terms = [w for w in words if data.draw(st.booleans())]
    out = pii.clean(text, terms)
    assert not brute(out) and not pii.secret_spans(out, [])
