"""Operators that judge each document by itself: licences, quality, secrets, HTML."""

import collections
import itertools
import math
import random
import re
import string
import time

import pytest
from pyspark.sql import functions as F

from tablemill.llm import html_extraction, license_scan, quality_rules, queries, secret_scan
from tablemill.llm.license_rules import RULES
from tests.conftest import same_rows
from tests.llm.helpers import awkward, docs, prose


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, small, duck, name):
    same_rows(queries.QUERIES[name](spark, small), duck.execute(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("add", [license_scan.with_licenses, quality_rules.with_ledger, secret_scan.with_secrets])
def test_awkward_rows_and_names(spark, add):
    rows = awkward(spark)
    out, name = add(rows)
    assert out.count() == rows.count() and out.columns[:-1] == rows.columns and name not in rows.columns
    assert out.where(F.col(name).isNull()).count() == 0
    assert add(rows.limit(0))[0].count() == 0


# Licences


def licenses(spark, *texts):
    out, name = license_scan.with_licenses(docs(spark, list(enumerate(texts))))
    return [r[name] for r in out.orderBy("doc_id").collect()]


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    found = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return len(words), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_base_places(spark):
    texts = [
        "Released under the MIT License. MIT-license mit  LICENSE;mit\nlicense", "émit license", "mit licenses", "Apache License General Public License", "K mit license é",
        None, "", "mit license" * 3, "xİ MIT LICENSE", "general public\x00license mit license",
    ]
    for text, found in zip(texts, licenses(spark, *texts), strict=True):
        assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == brute_base(text), text


def test_longer_better_match_suppresses(spark):
    a, b, c = licenses(spark, "Licensed under the Apache License, Version 2.0.", "This is under CC BY-NC 4.0 or so.", "GNU General Public License, version 3")
    assert a["labels"] == "apache,apache-2.0" and a["score"] == 1.0 and a["n_matches"] == 1
    assert b["labels"] == "cc-by-nc-4.0"
    assert c["labels"] == "gpl,gpl-3.0" and c["base_labels"] == "gpl"


@pytest.mark.parametrize("n", [1, 255, 256, 257, 600])
def test_places_across_blocks_of_matches(spark, n):
    text = " ".join(f"{'x ' * (k % 5)}MIT license" for k in range(n))
    (found,) = licenses(spark, text)
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]) == brute_base(text)
    assert found["n_matches"] == n


def test_time_grows_with_the_matches_not_with_their_square(spark):
    """A hundred thousand matches in one text take seconds."""
    out, name = license_scan.with_licenses(docs(spark, [(k, "an mit license, an apache license " * 50_000) for k in range(1)]))
    began = time.perf_counter()
    found = out.select(f"{name}.*").first()
    assert time.perf_counter() - began < 60
    assert (found["n_base"], found["first_word"], found["last_word"], found["n_matches"]) == (100_000, 1, 299_998, 100_000)


def test_rules_are_many_and_gated():
    assert len(RULES) >= 200
    for _, _, keyword, pattern, priority, _ in RULES:
        always = re.sub(r"\([^()]*(\([^()]*\))?[^()]*\)\?", "", pattern)
        assert keyword in always and priority in (1, 2, 3)


def expansions(pattern):
    """What the expression matches, classes by one of their letters, each option taken and left."""
    m = re.search(r"\(([^()]*)\)(\??)", pattern)
    if not m:
        yield from (re.sub(r"\[\^?(.)[^]]*\][+]?", r"\1", x) for x in pattern.split("|"))
        return
    for part in [*m[1].split("|"), *([""] if m[2] else [])]:
        yield from expansions(pattern[: m.start()] + re.sub(r"\|", "", part) + pattern[m.end() :])


def test_rules_match_texts_without_the_stem(spark):
    assert licenses(spark, "It is under Mulan PSL v2, as said.")[0]["labels"] == "mulan-2.0"
    without = 0
    for _, _, keyword, pattern, _, _ in RULES:
        texts = {x for x in itertools.islice(expansions(pattern), 5000) if license_scan.STEM not in x}
        without += bool(texts)
        assert not texts or keyword in license_scan.OTHER_KEYWORDS, pattern
    assert without > 50


def test_plan_has_no_python(spark, small, capsys):
    queries.op1_license_scan(spark, small).explain()
    assert "Python" not in (said := capsys.readouterr().out) and "Arrow" not in said and "Exchange" not in said


# Quality


def test_measures():
    text = "a b c a b c x\n\nline one\nline one\nsym # | x"
    n, chars, symbols, lines, dup, repeats, unique = quality_rules.measure(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + i for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for i in range(3)}
    assert (n, chars, symbols, lines, dup, repeats, unique) == (len(words), sum(map(len, words)), 2, 4, 1, len(covered), len(set(words)))
    assert quality_rules.measure(None) == quality_rules.measure(" \t") == (0,) * 7
    assert quality_rules.measure("a\xa0b")[0] == 1  # not one of the six white-space characters


def test_policies_and_ablations(spark):
    rows = docs(spark, [(1, prose(1, 100)), (2, "short"), (3, "### " * 60), (4, "the same line\n" * 30), (5, prose(5, 100))])
    out, name = quality_rules.with_ledger(rows)
    kept = {r["doc_id"] for r in out.where(quality_rules.passes(F.col(name)["fail_bits"])).collect()}
    assert kept == {1, 5} == {r["doc_id"] for r in quality_rules.keep_good(rows).collect()}
    bits = out.select(F.col(name)["fail_bits"].alias("fail_bits"))
    table = {r["rule"]: (r["n_failed"], r["n_failed_alone"], r["n_kept"]) for r in quality_rules.ablations(bits).collect()}
    for rule in quality_rules.POLICIES[quality_rules.DEFAULT_POLICY]:
        bit, mask = next(r.bit for r in quality_rules.RULES if r.name == rule), quality_rules.mask(quality_rules.DEFAULT_POLICY)
        own = [r["fail_bits"] & mask for r in bits.collect()]
        assert table[rule] == (sum(bool(b >> bit & 1) for b in own), sum(b == 1 << bit for b in own), 2)


# Secrets


def brute_spans(text):
    text, out = text or "", []
    for k, m in enumerate([re.finditer(secret_scan.ASSIGN.pattern, text, re.I | re.A), re.finditer(r"AKIA[A-Z0-9]+", text), re.finditer(r"[0-9a-f]+", text)]):
        for x in m:
            if len(x[2]) >= 6 if k == 0 else len(x[0]) >= (20 if k == 1 else 24):
                out.append((x.start(), k, x.end()))
    return sorted(out)


def test_base_spans_match_brute_force():
    texts = [
        'token = "ede43f42c939b6405768150e0411590525cf889e" x', "password: short passwd=longenough1 API_KEY='abc.def/ghi'", "AKIA" + "Z9" * 8 + "AKIA" * 5, "f" * 23 + "g" + "0" * 24 + "f" * 3,
        "ſecret=abcdef", "secret=ab secret:=abcdefg token=token=abcdef", None, "", "é🙂 Token: Abcdef1",
    ]
    for text in texts:
        assert [s for s in secret_scan.scan(text) if s[1] < 3] == brute_spans(text)


def test_guess_cost_orders_values():
    cost = secret_scan.guess_cost
    assert cost("") == 0
    for weak in ("password", "Password1", "qwertyuiop", "aaaaaaaaaaaa", "2019-05-07", "changeme2020", "p4ssw0rd", "P@$$w0rd", "1qaz2wsx", "tomorrow1", "elephant9", "university3", "keyboard7"):
        assert cost(weak) < 8, weak
    assert cost("x8#Kq0vLw2") > 15 and cost("abc" * 30) < cost("q7Z" * 30)
    assert secret_scan.is_guarded("x8#Kq0vLw2") and not secret_scan.is_guarded("changeme2020") and not secret_scan.is_guarded("thequickbrownfox")


def test_enough_decides_as_the_whole_cost_does():
    rnd = random.Random(2)
    for _ in range(300):
        value = "".join(rnd.choice(["password", "2020", "aaaa", "qwer", "x", "7", "K", "tomorrow"]) for _ in range(rnd.randint(1, 40)))
        for enough in (3.0, 10.0, 25.0):
            assert (secret_scan.guess_cost(value, enough) >= enough) == (secret_scan.guess_cost(value) >= enough), value


def test_very_long_values(spark):
    """Values of a megabyte, strong and weak, through the query's expression."""
    strong = "".join(random.Random(3).choice(string.ascii_letters + string.digits) for _ in range(1_000_000))
    texts = [f"pwd = {strong} end", f"pwd = {'z' * 1_000_000} end", f"token: {'0123456789abcdef' * 60_000}", "pwd = " + "x" * 7]
    began = time.perf_counter()
    out, s = secret_scan.with_secrets(docs(spark, list(enumerate(texts))))
    found = {r["doc_id"]: r[s] for r in out.collect()}
    assert time.perf_counter() - began < 60
    assert found[0]["spans"] == "guess:6:1000006" and found[1]["spans"] == "guess:6:1000006" and found[3]["spans"] == ""
    assert found[2]["n_assign"] == found[2]["n_hex"] == found[2]["n_guess"] == 1 and found[0]["redacted"] == "pwd = [SECRET] end"


def test_plain_words_are_rarely_secrets():
    """Words of English prose that isn't in this repository, bare and with what people add to them."""
    from pydoc_data import topics

    words = sorted(set(re.findall(r"\b[a-z]{6,14}\b", " ".join(topics.topics.values()))))
    for tail, most in (("", 0.01), ("1", 0.04), ("!", 0.05), ("2020", 0.08), ("42", 0.15)):
        assert sum(secret_scan.is_guarded(w + tail) for w in words) <= most * len(words), tail
    rnd = random.Random(1)
    strong = ["".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(12)) for _ in range(500)]
    assert all(map(secret_scan.is_guarded, strong))


def segment_cost(value, a, b, each):
    """The least cost of value[a:b] as one segment."""
    part, low = value[a:b], value[a:b].lower()
    costs = [each] if len(part) == 1 else []
    step = math.log10(2)
    if len(part) >= 3:
        if len(set(part)) == 1:
            costs.append(step + math.log10(secret_scan.CLASS_SIZE[secret_scan._class(part[0])] * len(part)))
        for board in (["1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"], ["abcdefghijklmnopqrstuvwxyz"]):
            # Keys half a key apart stand at odd and even places.
            place = {c: (r, 2 * i + r) for r, row in enumerate(board) for i, c in enumerate(row)}
            ways = [(place[b][0] - place[a][0], place[b][1] - place[a][1]) if a in place and b in place else None for a, b in zip(low, low[1:], strict=False)]
            if all(w in ((0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1)) for w in ways):
                costs.append(step + math.log10(180 * len(part)) + sum(a != b for a, b in itertools.pairwise(ways)) * math.log10(5))
        for said, extra in ((low, 1), (low.translate(secret_scan.LEET), 4)):
            if said in secret_scan.WORDS:
                costs.append(step + math.log10(secret_scan.WORDS[said] * extra * (1 if part.islower() else 3)))
    if secret_scan.DATE.fullmatch(part):
        costs.append(step + math.log10(365 * 120 if len(part) > 4 else 120))
    return min(costs, default=math.inf)


@pytest.mark.parametrize("value", ["Dragon2019z", "aaa1qwerty", "p4ssw0rd!!!", "x9Kfoo2020", "zzzzabcd77", "20190507ab", "1qaz2wsx", "zaq1@WSX", "fghbvcde", "$ecret@7"])
def test_guess_cost_is_the_least_over_all_segmentations(value):
    n = len(value)
    each = math.log10(sum(secret_scan.CLASS_SIZE[k] for k in {secret_scan._class(c) for c in value}))
    least = math.inf
    for cuts in itertools.product((False, True), repeat=n - 1):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), n]
        least = min(least, sum(segment_cost(value, a, b, each) for a, b in itertools.pairwise(at)))
    assert secret_scan.guess_cost(value) == pytest.approx(least)


def test_every_context_value_is_judged_by_its_cost():
    for text, value in (
        ("pwd = qzxvkjwpmhtbnrlc.", "qzxvkjwpmhtbnrlc"), ("passcode: 840271593026", "840271593026"), ('pwd = "x8#K,q0vLw2Zt" x', "x8#K,q0vLw2Zt"),
        ("auth='a;Q<9x>k2,Lp' y", "a;Q<9x>k2,Lp"), ('pwd="x8#K\'q0vLw2Zt', "q0vLw2Zt"), (r'pwd="x8\"Kq0vLw2" z', r"x8\"Kq0vLw2"),
    ):
        found = [text[a:b] for a, k, b in secret_scan.scan(text) if k == 3]
        assert found == [value] if value != "q0vLw2Zt" else found == [], text
    for text in ("The secret: authentication", "auth: configuration, then", "token: description of it", "key access key: international", "secret: 'everything'"):
        assert not [s for s in secret_scan.scan(text) if s[1] == 3], text


def test_context_values_and_redaction(spark):
    text = "pwd: x8#Kq0vLw2! and login; passphrase = plainprose token = Zx81kqPp02Vm"
    spans = secret_scan.scan(text)
    assert [(secret_scan.KINDS[k], text[a:b]) for a, k, b in spans] == [("guess", "x8#Kq0vLw2"), ("assign", "token = Zx81kqPp02Vm"), ("guess", "Zx81kqPp02Vm")]
    out = secret_scan.redacted(docs(spark, [(1, text), (2, "clean text"), (3, None)])).orderBy("doc_id").collect()
    assert out[0]["text"] == "pwd: [SECRET]! and login; passphrase = plainprose [SECRET]" and out[0]["n_chars"] == len(out[0]["text"])
    assert out[1]["text"] == "clean text" and out[2]["text"] is None


# HTML


@pytest.fixture(scope="module")
def model(spark, small):
    return html_extraction.train(spark.read.parquet(f"{small}/pages.parquet"))


def test_held_out_pages(spark, model):
    """Pages of another table: the article's blocks, exactly."""
    import html as h

    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1|article|div|ul|li)\b[^>]*>", article)]
        assert model.extract(r["html"]) == "\n\n".join(b for b in blocks if b)


LONG = "A longer sentence with some words, and a second part of it that goes on. " * 5


@pytest.mark.parametrize(("body", "want"), [
    (f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>", 3),
    (f"<div id='cookie-banner'><p>We use cookies, as you know.</p></div><main><h1>T</h1><p>{LONG}</p><form><label>Mail</label></form></main><div class=sidebar><p>{LONG}</p></div>", 2),
    (f"<nav><a href=/>Home</a></nav><article><h1>T</h1><p>{LONG}</p><section class=comments><h2>Comments</h2><p>{LONG}</p></section></article><footer>x</footer>", 2),
    (f"<div class=wrap><div class=header><a href=/>Home</a></div><div><h1>T</h1><p>{LONG}</p></div><div class=comments><p>{LONG}</p></div></div>", 2),
])
def test_layouts(model, body, want):
    assert len(model.extract(f"<html><body>{body}</body></html>").split("\n\n")) == want


def test_broken_and_empty_pages(spark, model):
    for page in (None, "", "<", "<p", "</p></div>", "<script>var a='</p>'", "<p>" * 3000 + "x", "<!-- never closed", '<a href="x>y', "a & b &lt; &nbsp; c"):
        assert isinstance(model.extract(page), str)
    assert model.extract("<p>a &amp;\n b&eacute;<br>c</p>" * 3).split("\n\n")[0] == "a & bé c"
    pages = spark.createDataFrame([(1, None, "x"), (1, "", None), (None, f"<p>{LONG}</p>", "y")], "page_id long, html string, main_text string")
    out, name = html_extraction.with_main_text(pages, model)
    assert [r[name] == "" for r in out.collect()] == [True, True, False]
    empty = html_extraction.train(pages.limit(0))
    assert empty.extract(f"<html><body><p>{LONG}</p></body></html>") == " ".join(LONG.split())


@pytest.mark.parametrize("name", ["button", "svg", "object", "math", "canvas", "video", "audio", "select", "noscript", "template", "iframe"])
def test_unclosed_elements_drop_no_article_text(model, name):
    want = model.extract(f"<html><body><article><h1>T</h1><p>{LONG}</p><p>Last, {LONG}</p></article></body></html>")
    assert want.count("A longer sentence") == 10
    for tag in (f"<{name}>", f"<{name} class=x/>"):
        assert model.extract(f"<html><body><article><h1>T</h1>{tag}<p>{LONG}</p><p>Last, {LONG}</p></article></body></html>") == want
    assert model.extract(f"<html><body><article><h1>T</h1><p>{LONG}</p><{name}>Sh</{name.upper()} ><p>Last, {LONG}</p></article></body></html>").count("A longer sentence") == 10


def test_deep_pages_take_linear_time(model):
    began = time.perf_counter()
    text = model.extract("<html><body><article><h1>T</h1>" + "<div>" * 30_000 + f"<p>{LONG}</p>" + "</b></i>" * 30_000 + "</div>" * 30_000 + f"<p>{LONG}</p></article></body></html>")
    assert time.perf_counter() - began < 20 and text.count("A longer sentence") == 10


def test_embedded_text_is_judged(model):
    article = "<html><body><article><h1>T</h1><p>{0}</p>{1}<p>{0}</p></article></body></html>"
    assert "x = 2" in model.extract(article.format(LONG, f"<p>So <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> holds. {LONG}</p>"))
    assert model.extract(article.format(LONG, f"<object><p>{LONG}</p></object>")).count("A longer sentence") == 15
    assert "Share" not in model.extract(article.format(LONG, "<button>Share</button>"))


def test_raw_elements_end_in_any_case(model):
    text = model.extract(f"<html><head><STYLE>p {{}}</STYLE></head><body><article><h1>İstanbul</h1><SCRIPT>var a</sCript><p>{LONG}</p></article></body></html>")
    assert text == "İstanbul\n\n" + " ".join(LONG.split())


def test_marginals_are_exact(model):
    """Messages against brute force over all states of a small page."""
    page = html_extraction.Page("<div><p>Some words, here.</p><div class=ad>Buy</div></div>")
    features, n = page.features(), len(page.tag)
    total, content = 0.0, [0.0] * n
    for states in itertools.product(range(3), repeat=n):
        if states[0]:
            continue
        log = 0.0
        for k in range(n):
            if k:
                log += sum((1 if f[:4] == "hint" else html_extraction.TEMPER) * model.node[f][states[k]] for f in features[k][1:] if f in model.node)
                p = states[page.parent[k]]
                log += (model.edge.get(f"edge {p} {features[k][0][4:]}") or model.edge[f"edge {p} any"])[states[k]]
        total += math.exp(log)
        for k in range(n):
            content[k] += math.exp(log) * (states[k] == html_extraction.CONTENT)
    assert model.marginals(page) == pytest.approx([c / total for c in content], abs=1e-6)
