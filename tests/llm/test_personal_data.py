import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from crossquote.llm import personal_data as pii
from crossquote.llm.bilstm_crf import NEVER, Tagger
from tests.llm.conftest import ODD, SF

LITERAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
           "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
           "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def literal(text):
    out = []
    for kind, pattern in LITERAL.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and double % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@pytest.mark.parametrize("seed", range(4))
def test_patterns_match_the_literal_ones(seed):
    rng = random.Random(seed)
    for _ in range(4000):
        text = "".join(rng.choices("0123456789.@+-() aZ_%\né", k=rng.randint(0, 40)))
        assert pii.base_spans(text) == literal(text)
    for _ in range(500):
        text = "".join(rng.choice(["4844508665317339", "a.b@c-d.ef.g", "1.22.255.4", "+1 (551) 555-0826", "@", ".", " ", "x", "7", "-"])
                       for _ in range(rng.randint(1, 8)))
        assert pii.base_spans(text) == literal(text)


def test_long_runs_are_linear():
    for text in ("@" * 100_000, "a" * 100_000 + "@", "1" * 100_000, "1." * 50_000, "+1(" * 30_000, "a@b." * 30_000):
        pii.base_spans(text)


def tiny():
    allowed, opening = pii.tag_rules()
    return Tagger.start(pii.PAD + 1, allowed, opening, width=3, hidden=4, seed=3)


def test_gradient():
    tagger, rng = tiny(), np.random.default_rng(0)
    tagger.weights = {k: v.astype(np.float64) for k, v in tagger.weights.items()}
    rows = [pii.labelled("ab 12 c", [("ip", 3, 5)]), pii.labelled("x1", [("card", 1, 2)]), pii.labelled("qwe@r", [])]
    batch = pii.padded(rows)
    gradient = tagger.loss(*batch)[1]
    for name, weight in tagger.weights.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in weight.shape)
            kept, sums = weight[at], []
            for step in (1e-3, -1e-3):
                weight[at] = kept + step
                sums.append(tagger.loss(*batch)[0])
            weight[at] = kept
            assert gradient[name][at] == pytest.approx((sums[0] - sums[1]) / 2e-3, abs=2e-3)


def test_crf_matches_all_paths():
    tagger, rng = tiny(), np.random.default_rng(1)
    scores, mask = rng.normal(0, 2, (4, 2, pii.TAGS)), np.ones((4, 2), bool)
    mask[3, 1] = False
    change = np.where(tagger.allowed, tagger.weights["change"], NEVER)
    tags, sure = tagger.decode(scores, mask), tagger.marginals(scores, mask)
    for col, n in ((0, 4), (1, 3)):
        paths = np.array(list(itertools.product(range(pii.TAGS), repeat=n)))
        value = scores[np.arange(n), col][np.arange(n), paths].sum(1) + np.where(tagger.opening, 0, NEVER)[paths[:, 0]]
        value += sum(change[paths[:, t], paths[:, t + 1]] for t in range(n - 1))
        assert tuple(tags[:n, col]) == tuple(paths[value.argmax()])
        weight = np.exp(value - value.max())
        for t in range(n):
            want = np.bincount(paths[:, t], weight, pii.TAGS) / weight.sum()
            assert np.allclose(sure[t, col], want, atol=1e-5)


def test_best_set_matches_all_subsets():
    rng = random.Random(5)
    for _ in range(200):
        spans = [(rng.random(), ("ip", a, a + rng.randint(1, 6))) for a in (rng.randint(0, 12) for _ in range(7))]

        def total(chosen):
            ordered = sorted(chosen, key=lambda s: s[1][1])
            fine = all(x[1][2] <= y[1][1] for x, y in zip(ordered, ordered[1:]))
            return sum(p * (b - a) for p, (_, a, b) in chosen) if fine else -1

        want = max(total(c) for r in range(8) for c in itertools.combinations(spans, r))
        assert total(pii.best_set(spans)) == pytest.approx(want)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return pii.fit(pii.training_windows(docs.select("doc_id", "text")))


def test_unreportable_spans_take_no_place(monkeypatch):
    """A long unsure span, and one that no check would pass, lie over a sure one."""
    text = "call 0049 551 555 0826 today, name at place, thank you"
    phone = ("phone", 5, 22)
    for other in [(0.6, ("email", 0, len(text))), (0.99, ("card", 3, 40)), (0.99, ("email", 0, len(text)))]:
        monkeypatch.setattr(pii, "windows", lambda text, known=(): [(0, len(text))])
        monkeypatch.setattr(pii, "tagged", lambda tagger, texts, other=other: [[(0.99, phone), other]] * len(texts))
        assert pii.plausible("phone", text[5:22])
        assert pii.added_spans(object(), [text], [[]]) == [[phone]]
        assert pii.redact_text(text, [phone]) == "call [PHONE] today, name at place, thank you"


def test_other_spellings_on_held_out_texts(spark, trained):
    rng = np.random.default_rng(8)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(
        "doc_id > 5000 and text rlike '[0-9@]'").collect()]
    hit = wanted = wrong = 0
    for text in [t for t in texts if len(t) < 5000 and pii.base_spans(t)][:150]:
        new, spans = pii.varied(text, rng)
        base = pii.base_spans(new)
        added = pii.added_spans(trained, [new], [base])[0]
        left = [s for s in spans if not any(s[1] < b[2] and b[1] < s[2] for b in base)]
        wanted, hit, wrong = wanted + len(left), hit + sum(s in added for s in left), wrong + sum(s not in spans for s in added)
        assert pii.joined(base) == pii.joined(literal(new))
    assert wanted > 50 and hit >= 0.7 * wanted and wrong <= 0.02 * wanted


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.op5_bilstm_pii(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = literal(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) - {""} <= set(r.spans.split(","))


def test_odd_rows(spark, odd, empty, trained):
    got = sorted((r.doc_id or -1, r.spans) for r in pii.find(odd, trained).collect())
    assert [d for d, _ in got] == sorted(x[0] or -1 for x in ODD)
    assert pii.find(empty, trained).collect() == [] and pii.training_windows(empty.select("doc_id", "text")) == []
    assert pii.fit([]) is None and pii.fit(["no span here"]) is None
    out = pii.redact(odd, trained)
    assert out.columns == odd.columns and out.count() == odd.count()
    clean = {r.doc_id: r for r in pii.redact(spark.createDataFrame(
        [(1, "mail a.b@c.de or +1 (551) 555-0826 now", None, "s", 9), (2, None, "en", None, None)],
        "doc_id long, text string, lang string, source string, n_chars long"), None).collect()}
    assert clean[1].text == "mail [EMAIL] or [PHONE] now" and clean[1].n_chars == 27
    assert clean[2].text is None and clean[2].n_chars is None


@pytest.mark.parametrize("name,domain", [(5, 5), (40, 5), (5, 40), (60, 60), (150, 10), (10, 150), (300, 300)])
def test_spans_longer_than_windows_stay_whole(monkeypatch, name, domain):
    def lower_runs(tagger, texts):
        return [[(0.99, ("email", *m.span())) for m in re.finditer(r"[a-z\[\].]+", t)] for t in texts]

    monkeypatch.setattr(pii, "tagged", lower_runs)
    address = f"{'n' * name}[at]{'d' * domain}.org"
    for lead in range(0, 200, 7):
        text = "W" * lead + " " + address + " " + "WORD " * 40
        assert pii.added_spans(object(), [text], [[]]) == [[("email", lead + 1, lead + 1 + len(address))]]
        assert pii.redact_text(text, pii.added_spans(object(), [text], [[]])[0]) == text.replace(address, "[EMAIL]")


def test_no_reportable_span_is_outside_the_windows():
    rng = random.Random(3)
    spellings = [("email", "jane at example dot com"), ("email", "jane{at}example.com"), ("email", "jane＠example．com"),
                 ("email", "jane < AT > mail(dot)example dot org"), ("email", "jane@example dot com"),
                 ("phone", "＋１ ５５１ ５５５ ０８２６"), ("ip", "１２.٣.4 . 5"), ("card", "４８４４-5086-6531-7339")]
    for kind, new in spellings:
        assert pii.plausible(kind, new)
        for _ in range(20):
            lead = "w " * rng.randint(0, 200)
            a, b = len(lead), len(lead) + len(new)
            text = lead + new + " w" * rng.randint(0, 200)
            for x in range(0, len(text), pii.STRIDE):  # each window of the whole text with the span in it is read
                y = min(x + pii.WINDOW, len(text))
                assert not (x <= a and b <= y) or y < x + pii.STRIDE or (x, y) in pii.windows(text) or x > 0 and y - x <= pii.STRIDE
            assert any(x <= a and b <= y for x, y in pii.windows(text))
    assert pii.windows("at home. the end dot " * 30) == []
    assert pii.grown(("email", 8, 17), "x johan.doe[at]a.b-c.org. Then")[1:] == (2, 24)
    assert not pii.plausible("email", "at home. the end")
    assert (pii.symbols("jane＠x．y ５٣") == pii.symbols("jane@x.y 53")).all()


@pytest.mark.parametrize("spelling", ["{0} at {2}", "{0}{{at}}{1}", "{0}＠{1}", "full width"])
def test_spellings_without_an_ascii_sign_are_found(spark, trained, spelling):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(
        "doc_id > 5000 and text like '%@%'").collect()]
    wanted = hit = 0
    for text in [t for t in texts if len(t) < 5000][:150]:
        for _, a, b in [s for s in pii.base_spans(text) if s[0] == "email"][:1]:
            name, domain = text[a:b].split("@")
            new = spelling.format(name, domain, domain.replace(".", " dot "))
            if spelling == "full width":
                new = "".join(chr(ord(c) + 0xFEE0) for c in text[a:b])
            whole = text[:a] + new + text[b:]
            wanted += 1
            hit += ("email", a, a + len(new)) in pii.added_spans(trained, [whole], [pii.base_spans(whole)])[0]
    assert wanted > 30 and hit >= 0.7 * wanted
