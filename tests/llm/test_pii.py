import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import regex

from cartweave.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def base_spans(text):
    return sorted((m.start(), rank, m.end(), m[0]) for rank, (kind, p) in enumerate(PATTERNS.items()) for m in (re.finditer(p, text) if kind != "email" or "@" in text else ()) if valid(kind, m[0]))


def patterns(text, start, end):
    """Of an instance: up to 80 characters on either side, as words; the nearest are glued to it, or empty."""
    plain = lambda x: re.split(r"[ \t\n\x0b\f\r]+", re.sub("[1-9]", "0", x).lower())
    left, right = plain(text[max(0, start - 80) : start]), plain(text[end : end + 80])
    glued, near, far = ([*left[::-1], "", "", ""])[:3]
    closed, after = ([*right, "", ""])[:2]
    out = []
    if regex.search(r"\p{L}.*[^\p{L}\p{N}]", glued):
        out.append(("g", glued))
    if near:
        out.append(("1", near, glued))
    if far:
        out += [("2", far, near, glued), ("*", far, glued)]
    if near and after:
        out.append(("t", near, after, glued, closed))
    return out


def instances(text):
    base = base_spans(text)
    out = [(s, e, x, True, True) for s, _, e, x in base]
    for m in re.finditer(r"[A-Za-z0-9@._+-]+", text):
        inner = re.search("[A-Za-z0-9].*[A-Za-z0-9]", m[0])
        if inner and len(inner[0]) >= 6 and len(re.findall("[0-9]", inner[0])) >= 3:
            s, e = m.start() + inner.start(), m.start() + inner.end()
            if not any(a < e and s < b for a, _, b, _ in base):
                secret = re.fullmatch("[0-9A-Fa-f]{32,}", inner[0]) and re.search("[A-Fa-f]", inner[0])
                out.append((s, e, inner[0], False, bool(secret)))
    return out


def trusted_patterns(rows):
    """Patterns that have half of their occurrences in believed instances, and three of these, until none comes in."""
    weight, seeds, totals = defaultdict(lambda: defaultdict(int)), set(), Counter()
    for _, text in rows:
        if text is not None:
            totals.update(re.split(r"[ \t\n\x0b\f\r]+", re.sub("[1-9]", "0", text).lower()))
        for s, e, x, _, seed in instances(text or ""):
            seeds |= {x} if seed else set()
            for c in patterns(text, s, e):
                weight[c][x] += 1
    own = {"g": lambda c: [], "1": lambda c: c[1:2], "2": lambda c: c[1:3], "*": lambda c: c[1:2], "t": lambda c: c[1:3]}
    most = {c: 1 + max(sum(w.values()), min([totals[x] for x in own[c[0]](c) if totals[x]], default=0)) for c, w in weight.items()}
    belief, trusted = {x: Fraction(1) for x in seeds}, {}
    while True:
        score = {c: Fraction(int(10**6 * sum(n * belief.get(x, 0) for x, n in w.items()) / most[c]), 10**6) for c, w in weight.items()}
        now = {c: s for c, s in score.items() if s >= Fraction(1, 2) and sum(x in belief for x in weight[c]) >= 3}
        if len(now) == len(trusted):
            return set(now)
        trusted = now
        for c, s in now.items():
            for x in weight[c]:
                belief[x] = max(belief.get(x, 0), s)


def brute(rows):
    good, names, out = trusted_patterns(rows), [*PATTERNS, "context"], []
    written = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
    for doc, text in rows:
        text = text or ""
        base = [(s, k, e) for s, k, e, _ in base_spans(text)]
        more = {(s, 4, e) for s, e, _, of_base, _ in instances(text) if not of_base and good & set(patterns(text, s, e))}
        counts = [sum(k == x for _, k, _ in base) for x in range(4)]
        out.append((doc, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + list(more)), len(more)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus(prose, odd_rows):
    r = random.Random(11)
    rows = list(odd_rows)
    card = lambda: next(x for x in iter(lambda: "".join(r.choice("0123456789") for _ in range(16)), None) if luhn(x))
    kinds = [
        lambda: f"write to user{r.randrange(99)}.x+y@mail-{r.randrange(20)}.example.org", lambda: f"from host {r.randrange(300)}.{r.randrange(256)}.0{r.randrange(99)}.{r.randrange(999)}", lambda: "paid by card " + card(),
        lambda: "paid by card " + "-".join(re.findall("....", card())), lambda: f"phone: +{r.randrange(1, 99)} (0) {r.randrange(10**8)}-{r.randrange(100)}", lambda: f"write to handle{r.randrange(1000, 9999)}x", lambda: f"phone: x{r.randrange(10**6)}ab", lambda: f"version {r.randrange(10**6)}.{r.randrange(100)}",
        lambda: "a@b a@b.c. @x.y 1.2.3.4.5.6.7.8 1..2", lambda: f"Écrire 文 to: user{r.randrange(9)}@ex.org;b@c.d.e-f", lambda: "+1234567890123456789 +12 +1 2 3 4 5 6 7 8 9 0 1 2", lambda: f'token = "{r.randbytes(20).hex()}"', lambda: f'token = "key-{r.randrange(10**6)}_{"z" * r.choice([2, 200])}9"', lambda: f"ref=ab{r.randrange(10**6)},cd{r.randrange(10**6)}", lambda: f"ref={r.randrange(256)}.{r.randrange(256)}.1.2;end", lambda: "4111 1111 1111 1111 4111111111111111",
    ]
    for i in range(250):
        parts = [prose(i, r.randrange(8))]
        for _ in range(r.randrange(5)):
            parts += [r.choice(kinds)(), prose(r.randrange(10**6), r.randrange(6))]
        rows.append((100 + i, r.choice([" ", "  ", "\n"]).join(parts)))
    return [*rows, (600, "a" * 5000 + "@" + "b." * 2000 + "c"), (601, "12 " * 4000), (602, "1" * 3000), (603, "+" * 2000 + "1"), (604, "1." * 3000 + "1"), (605, "x1" * 40 + "@")]


def result(out):
    return sorted((tuple(r[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_context")) for r in out.collect()), key=str)


def test_as_brute_force(frame, corpus, with_clashes):
    want = brute(corpus)
    assert sum(r[-1] for r in want) > 60 and all(sum(r[k] for r in want) > 20 for k in (1, 2, 3, 4))
    assert result(pii.report(with_clashes(frame(corpus)))) == want


def test_contexts_are_learnt(frame):
    seeds = [(i, f"please write to name{i}@mail.example now") for i in range(8)]
    other = [(20, "please write to nick_4711 now"), (21, "please count from 471100 now"), (22, "nothing 123456 here"), (23, "please write to x" + "9" * 160 + " now"), (24, "please write to abc12345_,abc12345 now")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(frame(seeds + other)).collect()}
    assert [got[i] for i in range(20, 25)] == ["context:16:25", "", "", "context:16:177", "context:16:24"]


def test_common_words_are_no_evidence(frame):
    """The same seeds, after words that mostly stand before something else."""
    rows = [(i, f"a line of to name{i}@mail.example now") for i in range(8)] + [(20, "a line of to nick_4711 now")] + [(100 + i, "of to and line now") for i in range(20)]
    assert {r["n_context"] for r in pii.report(frame(rows)).collect()} == {0}


def test_found_instances_induce_patterns(frame):
    """What the first pattern finds makes the second one trusted, whose instances no seed stands beside."""
    rows = [(100 + i, f"mailto: name{i}@mail.example end") for i in range(30)]
    rows += [(10 + i, f"mailto: handle{i}777 end") for i in range(5)] + [(20 + i, f"login: handle{i}777 bye") for i in range(5)] + [(30, "login: other_9191 bye"), (31, "logout: other_9292 bye")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(frame(rows)).collect()}
    assert got[10] == "context:8:18" and got[20] == "context:7:17" and got[30] == "context:7:17" and got[31] == ""


def test_secrets_are_found_by_their_context(frame):
    r = random.Random(3)
    rows = [(i, f'set token = "{r.randbytes(20).hex()}" there') for i in range(6)] + [(10, 'set token = "hunter2-2024" there'), (11, f"hash {r.randbytes(20).hex()} alone")]
    got = {x["doc_id"]: x["spans"] for x in pii.report(frame(rows)).collect()}
    assert all(got[i] == "context:13:53" for i in range(6)) and got[10] == "context:13:25" and got[11] == ""


def test_long_text_of_tokens(frame):
    """40,000 instances in one text take time by their number, not its square."""
    text = " ".join(f"id=ab{i:06d},10.0.{i % 256}.{i // 256 % 256}" for i in range(20_000))
    pii.redacted(frame([(1, "x")])).collect()
    began = time.time()
    got = pii.redacted(frame([(1, text)])).collect()[0]["text"]
    assert time.time() - began < 120
    assert got == " ".join(f"id=ab{i:06d},[IP]" for i in range(20_000))


def test_redacted(frame, corpus, with_clashes, own_columns):
    rows = own_columns(pii.redacted(with_clashes(frame(corpus))))
    assert len(rows) == len(corpus)
    by = {r["doc_id"]: r["text"] for r in rows}
    spans = {r["doc_id"]: r["spans"] for r in pii.report(frame(corpus)).collect()}
    for i, text in corpus:
        if i is None or i in (5, 7):
            continue
        if not spans[i]:
            assert by[i] == text
            continue
        out, at = "", 0
        for kind, a, b in (x.split(":") for x in spans[i].split(",")):
            if int(a) >= at:
                out += text[at : int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert by[i] == out + text[at:]


def test_empty_table(frame):
    assert pii.report(frame([])).collect() == [] and pii.redacted(frame([])).collect() == []


def test_no_python(frame, corpus):
    plan = pii.report(frame(corpus[:20]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
