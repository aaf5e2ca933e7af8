"""URL filter, secret scan and personal data against plain rules."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pingloom.llm import pii, secrets, urls

TEXT = st.text(alphabet="ab1.9@-+_ ()%:é=\"'AKIAtokenpswd0\n", max_size=120)

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", CARD, lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))), ("phone", PHONE, lambda s: 8 <= len(digits(s)) <= 15))
    return [(k, m.start(), m.end()) for k, rx, ok in rules for m in re.finditer(rx, text) if ok(m[0])]


def base_secrets(text):
    rules = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", 0, lambda m: len(m[0]) >= 24))
    found = [(m.start(), i, k, m.end()) for i, (k, rx, flags, ok) in enumerate(rules) for m in re.finditer(rx, text, flags) if ok(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans):
    return hashlib.sha256(joined(spans).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_base_spans_equal_the_plain_patterns(text):
    got = [(pii.KINDS[k], a, b) for k, a, b, base, *_ in pii.candidates(text) if base]
    assert got == base_pii(text)


NUMBERS = st.text(alphabet="0123456789.+- ()@a", max_size=80)


@settings(max_examples=400, deadline=None)
@given(NUMBERS)
def test_base_spans_of_numbers_equal_the_plain_patterns(text):
    got = [(pii.KINDS[k], a, b) for k, a, b, base, *_ in pii.candidates(text) if base]
    assert got == base_pii(text)


PERSONAL = ["mail ab.c@d-e.example.com now", "ip 1.2.3.4 and 300.1.1.1", "card 4539 5787 6362 1486 ok", "+1 (444) 555-4984 call", "call (444) 555-4984 phone", "Mr. John Smith lives at 12 Oak Street", "ssn 123-45-6789"]


def test_pii_report_and_its_cases(docs_of, odd_texts):
    texts = [*odd_texts, *PERSONAL * 5, "1" * 50_000, "@" * 5_000, "a@b.c_d@e.f x@y"]
    rows = {r["doc_id"]: r for r in pii.report(docs_of(texts, extra=["spans", "cands", "votes"])).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = base_pii(t or "")
        r = rows[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert r["base_sha256"] == digest(want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",")) | {""}
    every = ",".join(r["spans"] for r in rows.values())
    assert "localphone:5:19" in every and "ssn:4:15" in every


def test_em_finds_the_unreliable_labeler():
    # the first two labelers agree with the truth, the third is random
    counts = {"++0": 30, "+++": 30, "---": 40, "--+": 40, "++-": 30, "--0": 20}
    p = pii.em(counts)
    assert all(p[k] > 0.9 for k in counts if k.startswith("++")) and all(p[k] < 0.1 for k in counts if k.startswith("--"))


def test_redact_keeps_rows_and_columns(docs_of):
    docs = docs_of([None, "", "write to ab@c.example.com or 1.2.3.4!", "nothing"], extra=["cands", "spans"])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == [None, "", "write to <EMAIL> or <IP>!", "nothing"]
    assert pii.redact(docs.limit(0)).count() == 0 and pii.report(docs.limit(0)).count() == 0


def test_secret_report_and_its_cases(docs_of, odd_texts):
    texts = [*odd_texts, "my PassWord = 'abc123def' x", "AKIA" + "A1" * 10, "dead" * 8 + " token: abcdef", 'api_key="12345678', "apikey : short", "ghp_" + "a" * 36, "TOKEN:abcdef token=xyzxyz", "-----BEGIN RSA PRIVATE KEY-----", "to\u212aen: abcdefgh"]
    rows = {r["doc_id"]: r for r in secrets.report(docs_of(texts, extra=["spans"])).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = base_secrets(t or "")
        assert rows[i]["base_sha256"] == digest(want)
        assert [rows[i]["n_assign"], rows[i]["n_access"], rows[i]["n_hex"]] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(rows[i]["spans"].split(",")) | {""}
    assert "forge:0:40" in rows[len(odd_texts) + 5]["spans"] and "pem:0:31" in rows[len(odd_texts) + 7]["spans"]
    assert secrets.report(docs_of([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_index_loses_no_match(texts):
    got = secrets.scanner(secrets.RULES)(pa.array(texts, pa.large_string()))
    for t, spans in zip(texts, got, strict=True):
        want = sorted((m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, t) if r.accept(m))
        assert [(a, k, b) for k, a, b in spans] == want


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == ()
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == (frozenset(["akia"]),)
    assert secrets.trigram_query("ab(?:cde|fgh)?x*yzw") == (frozenset(["yzw"]),) or all(len(s) >= 3 for c in secrets.trigram_query("ab(?:cde|fgh)?x*yzw") for s in c)
    assert secrets.trigram_query("foo|ba[rz]") == (frozenset(["foo", "bar", "baz"]),)


URLS = [None, "", "no-scheme.com/", "http://a.com", "http://a.com/x", "https://www.example.com/en/1", "https://m.example.com/en/1", "https://example.com/en", "HTTP://NL.NET/fr/1", "http://net/es/", "http://x.net/esp/", "http://x.internet/es/1", "ftp://com/", "http://h?p://x.com/", "http://a.org/cart/add?x", "http://a.org/?utm_source=feed", "http://a.org/a://b.com/c", "http://a.org/p\nq?r"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match("[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest, re.S)[1]
    fits = [r for r in urls.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    other = None if best else next((r for r in urls.PATTERN_RULES if re.search(r.regex, url or "")), None)
    return host, path, best.name if best else None, (best or other).verdict if best or other else "allow"


def test_urls(spark):
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in urls.report(rows).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(URLS[r["page_id"]]), URLS[r["page_id"]]
    assert urls.report(rows.limit(0)).count() == 0
    assert urls.judge(rows.select("page_id", "url"), hosts=(), patterns=(), keep=["page_id"]).where(F.col("verdict") != "allow").count() == 0


def test_rules_are_filed_under_their_rarest_token():
    counts = {"example": 10, "com": 50, "en": 20, "www": 3, "net": 4, "fr": 9, "es": 2}
    filed, rest = urls.index_rules(list(urls.HOST_RULES), counts)
    assert filed == {"com": [0], "example": [1], "www": [2], "es": [3], "net": [4]} and rest == []


def test_pattern_rules_are_found_under_each_of_their_tokens(spark):
    fitting = ["http://a.org/?utm_source=feed", "http://a.org/?x&utm_source=feed#y", "http://a.org/?sid=abcdefgh1", "http://a.org/cart/add?x", "http://a.org/cart/remove/1", "http://a.org/wp-login.php", "http://a.org/wp-login.php5", "http://a.org/wp-login.phpx", "http://a.org/?replytocom=12"]
    for url in fitting:
        (rule,) = [r for r in urls.PATTERN_RULES if re.search(r.regex, url)]
        assert set(rule.tokens) <= set(re.findall(urls.TOKEN, url.lower())), url
    # other rows make the rule's tokens common, but for one
    for rare in ("wp", "login", "php"):
        others = [f"http://b.org/{t}/{i}" for t in {"wp", "login", "php"} - {rare} for i in range(15)]
        rows = spark.createDataFrame([(i, u) for i, u in enumerate([*fitting, *others])], "page_id long, url string")
        got = {r["page_id"]: r["verdict"] for r in urls.report(rows).collect()}
        assert [got[i] for i in range(len(fitting))] == ["block"] * len(fitting), rare


def test_accepted_spans_equal_a_pairwise_rule():
    rng = np.random.default_rng(6)
    for _ in range(200):
        cands = []
        for kind in range(6):
            at = 0
            while at < 60:
                at += int(rng.integers(0, 9))
                end = at + int(rng.integers(1, 7))
                cands.append((kind, at, end, kind < 3, "", [int(rng.integers(0, 2))]))
                at = end
        kept, more = [c for c in cands if c[3]], []
        for c in sorted(c for c in cands if not c[3] and c[5] == [0]):
            if not any(x[1] < c[2] and c[1] < x[2] for x in [*kept, *more]):
                more.append(c)
        assert pii.accepted(cands, [0.5, -2.0, 0.5]) == sorted(c[:4] for c in [*kept, *more])


def test_a_text_of_a_hundred_thousand_numbers(spark, docs_of):
    """Time in proportion to the text: pairwise comparison of its spans would take minutes."""
    import time

    text = " ".join(f"+1 555 {i:07d} or 555-{i % 1000:03d}-{i % 10000:04d}" for i in range(50_000))
    start = time.time()
    found = pii.candidates(text)
    assert len(found) == 100_000
    assert len(pii.accepted(found, [1.0] * (pii.BUCKETS + 1))) == 100_000
    assert time.time() - start < 20


def test_copies_of_one_candidate_take_one_training_row(spark, docs_of, monkeypatch):
    """A number copied into most documents doesn't fill the sample: all kinds of candidates are in it, with their counts."""
    seen = []
    fit = pii.fit
    monkeypatch.setattr(pii, "fit", lambda rows, *a: seen.append(rows) or fit(rows, *a))
    texts = ["call 555-123-4567 now"] * 400 + [f"isbn no {k} 123-45-678{k}" for k in range(5)]
    docs = docs_of(texts)
    found = pii.proposed(docs, "text", [])
    pii.learn(found, found.columns[-1], 3)
    (rows,) = seen
    assert len(rows) <= 3 and len({tuple(f) for f, _, _ in rows}) == len(rows)
    pii.learn(found, found.columns[-1])
    assert sum(n for _, _, n in seen[1]) == 405 and max(n for _, _, n in seen[1]) == 400


def test_a_url_column_of_any_name(spark):
    pages = spark.createDataFrame([(1, "http://www.example.com/en/x")], "page_id long, `page.url` string")
    assert [r["verdict"] for r in urls.judge(pages, "page.url", keep=["page_id"]).collect()] == ["allow"]
    assert urls.judge(pages, "page.url").columns == ["page_id", "page.url", "host", "path", "rule", "pattern", "verdict"]


def test_thousands_of_rules(spark):
    """A url's cost doesn't grow with the rules: the plan holds them in a few constants, and a token looks up one small map."""
    import time

    hosts = tuple(urls.HostRule(f"site{i}.org", "/" if i % 2 else f"/p{i % 7}/", "block" if i % 3 else "allow") for i in range(5000))
    rows = [(i, f"https://{'www.' * (i % 2)}site{i * 7 % 6000}.org/p{i % 5}/x?{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    start = time.time()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, hosts=hosts, patterns=(), keep=["page_id"]).collect()}
    assert time.time() - start < 20
    for i, url in rows:
        n = i * 7 % 6000
        path = "/" + url.split("/", 3)[3]
        fits = n < 5000 and path.startswith(hosts[n].path)
        assert got[i] == ((hosts[n].name, hosts[n].verdict) if fits else (None, "allow")), url
