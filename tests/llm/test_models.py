"""Operators that learn: quality, line labels, extraction, toxicity."""

import html
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from blockcodec.llm import boosting
from blockcodec.llm import quality as Q
from blockcodec.llm import quality_rules as R
from blockcodec.llm import toxicity as X
from blockcodec.llm.html_extraction import Page, _labels, decode, extract, extract_pages, trained
from blockcodec.llm.html_pages import training_pages

SF = "/root/testdata/sf0.01"


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        y, w = rng.integers(0, 5, n) / 4, rng.integers(1, 4, n).astype(float)
        knots, levels = Q.isotonic(np.arange(n, dtype=float), y, w)
        # The minimax formula of isotonic regression.
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(np.interp(np.arange(n), knots, levels), want)


def test_quality_on_held_out_rows(spark):
    got = {r["doc_id"]: r for r in Q.quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    held = [(got[i]["predicted"], y) for i, y in labels.items() if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95 and np.mean([p for p, y in held if y]) > 0.97


def test_quality_against_a_plain_fit(spark):
    """The whole query by one ridge regression over all rows: features, folds,
    normal equations and calibration without partitions."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in Q.quality(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["doc_id"] in texts and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    stats, y = np.array([Q.statistics(texts[i]) for i, _ in known]), np.array([q for _, q in known], float)
    fold = np.array([r[0] for r in spark.createDataFrame([(i,) for i, _ in known], "key long").selectExpr("cast(pmod(xxhash64(key, 'fold'), 2) as int)").collect()])
    rng = np.random.default_rng(17)
    omega, phase = rng.normal(0, np.sqrt(2 * 0.04), (Q.N_STATS, Q.FEATURES)), rng.uniform(0, 2 * np.pi, Q.FEATURES)
    scale = np.where(stats.std(axis=0) > 1e-9, stats.std(axis=0), 1)

    def features(s):
        z = np.cos(np.clip((s - stats.mean(axis=0)) / scale, -6, 6) @ omega + phase) * np.sqrt(2 / Q.FEATURES)
        return np.column_stack([z, np.ones(len(s))])

    def ridge(x, y):
        penalty = np.eye(x.shape[1]) * 1e-2
        penalty[-1, -1] = 0
        return np.linalg.solve(x.T @ x + penalty, x.T @ y)

    x = features(stats)
    raw = np.round(np.clip([r @ ridge(x[fold != f], y[fold != f]) for r, f in zip(x, fold)], -1, 2), 3)
    levels = np.unique(raw)
    knots, values = Q.isotonic(levels, np.array([y[raw == v].mean() for v in levels]), np.array([(raw == v).sum() for v in levels], float))
    ids = sorted(got)
    want = np.interp(features(np.array([Q.statistics(texts[i]) for i in ids])) @ ridge(x, y), knots, values)
    assert np.abs(want - [got[i] for i in ids]).max() < 0.05 and np.abs(want - [got[i] for i in ids]).mean() < 1e-3


def test_quality_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "a b", 1), (2, "a b", 1), (3, "x" * 100_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    got = Q.quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = Q.quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert Q.quality(docs.limit(0), labels).collect() == []


def plain_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = (text or "").split("\n")
    dups = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(covered)


def test_rule_counts():
    rng = random.Random(1)
    for text in [None, "", " ", "\n\n", "é é", "a a a a"] + ["".join(rng.choice("ab \n\té|# ") for _ in range(rng.randint(0, 80))) for _ in range(400)]:
        assert R.base_counts(text) == plain_counts(text)


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 8))
        x, w, t = rng.normal(size=(n, R.N_FEATURES)), rng.normal(size=(R.N_FEATURES, 2)), rng.normal(size=(2, 2))
        e = x @ w
        assert R.viterbi(x, w, t) == list(max(itertools.product((0, 1), repeat=n), key=lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))))
    assert R.viterbi(np.zeros((0, R.N_FEATURES)), w, t) == []


def test_crf_gradient_finds_a_likelier_field():
    rng = np.random.default_rng(2)
    features = [rng.normal(size=(5, R.N_FEATURES)) for _ in range(30)]
    seqs = [(x, (x[:, 0] + 0.5 * x[:, 3] > 0).astype(int)) for x in features]

    def loss(w, t):
        total = 0
        for x, y in seqs:
            e = x @ w
            score = [sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in itertools.product((0, 1), repeat=5)]
            total += np.logaddexp.reduce(score) - (sum(e[i, s] for i, s in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:])))
        return total

    w, t = R.train_crf(seqs, l2=0)
    assert loss(w, t) < 0.5 * loss(np.zeros_like(w), np.zeros_like(t))
    assert [R.viterbi(x, w, t) == y.tolist() for x, y in seqs].count(True) >= 24


@pytest.fixture(scope="module")
def field(spark):
    return R.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def plain_share(text, w, t):
    """The share of content by the best of all labellings of a few lines."""
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    e = R.line_features(lines) @ w
    best = max(itertools.product((0, 1), repeat=len(lines)), key=lambda p: sum(e[i, s] for i, s in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])))
    return sum(len(x) for x, s in zip(lines, best) if s == 0) / sum(map(len, lines)) if lines else 0.0


def test_quality_rules(spark, field):
    good = "".join("Some plain words " + " ".join(f"word{i}x{j}" for j in range(9)) + ".\n" for i in range(9))
    bad = "".join(f"nav{i} | item{i} | more{i} | link{i} |\n" for i in range(30))
    rows = [(1, good), (2, bad), (3, "few words"), (4, None), (5, "a b c " * 40), (None, good), (1, good), (6, "y" * 200_000), (7, (good + bad[:300]) * 700)]
    docs = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    got = R.quality_rules(docs, field=field).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(rows[-1][1]) > 1 << 19 and len(got) == len(rows) and by[1]["kept"] and by[None]["kept"] and not by[2]["kept"] and not by[2]["base_failed"]
    assert by[3]["base_failed"] and by[4]["base_failed"] and by[5]["base_failed"] and not by[4]["kept"]
    assert R.quality_rules(docs.limit(0), field=field).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["kept"] == (not r["base_failed"]) for r in R.quality_rules(docs, none).collect()} == {True}


def test_verdicts_against_all_labellings(spark, field):
    """kept as a whole: base rules, and the share of content by trying every
    labelling, on the texts of up to 9 lines."""
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if (r["text"] or "").count("\n") < 9]
    got = {r["doc_id"]: r for r in R.quality_rules(spark.createDataFrame(docs, "doc_id long, text string"), field=field).collect()}
    assert len(docs) > 300
    for i, text in docs:
        n, _, _, _, repeats = plain_counts(text)
        failed, share = n < 50 or 100 * repeats > 50 * n, plain_share(text, *field)
        assert abs(got[i]["content_share"] - share) < 1e-9 and got[i]["base_failed"] == failed and got[i]["kept"] == (not failed and share >= 0.5)


def test_rules_on_held_out_rows(spark):
    """Sequence labelling tells good from bad on rows that it did not learn
    from, and a line's neighbours change verdicts."""
    big = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    w, t = R.train(docs, labels)
    known = [r for r in docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    passed = [(r["text"], r["quality"]) for r in known for c in [R.base_counts(r["text"])] if c[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    share = [(R.content_share(x, w, t), R.content_share(x, w, 0 * t), q) for x, q in passed]
    assert np.mean([s >= 0.5 for s, _, q in share if q]) > 0.99
    assert np.mean([s >= 0.5 for s, _, q in share if not q]) < 0.1 and sum(not q for *_, q in share) > 40
    assert any((s >= 0.5) != (alone >= 0.5) for s, alone, _ in share)
    assert t[0, 0] + t[1, 1] > t[0, 1] + t[1, 0]


def test_runs_come_from_anywhere():
    text = "\n".join(f"line {i} of a long text" for i in range(5000))
    runs = R.chosen_runs(text)
    lines = R.line_features([x.encode() for x in text.split("\n")])
    assert len(runs) == R.RUNS and all(len(x) <= R.RUN_LINES for x in runs)
    assert len(R.chosen_runs("a b\n\nc d")) == 1 and R.chosen_runs(None) == [] and len(lines) == 5000


def test_boosting_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:1500], y[:1500], trees=40, depth=3)
    assert np.mean((model.probability(x[1500:]) > 0.5) == y[1500:]) > 0.95


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(i)) for i in range(1, n)]
        p = rng.uniform(0.01, 0.99, n)
        best = max((k for k in itertools.product((0, 1), repeat=n) if all(i == 0 or not k[i] or k[parent[i]] for i in range(n))), key=lambda k: sum(np.log(q if s else 1 - q) for q, s in zip(p, k)))
        assert decode(parent, p).astype(int).tolist() == list(best)


def test_extraction_on_unseen_layouts():
    model, right = trained(), 0
    pages = training_pages(150, 4242)
    for source, text in zip(pages, extract(pages, model)):
        page = Page(source, marked=True)
        right += text == page.text(_labels(page) > 0)
    assert right >= 145


@pytest.mark.parametrize(
    "article,text",
    [
        ("<p>One  two\n three.</p><p>Four.</p>", "One two three. Four."),
        ("<p>a<b>b</b>c &amp; &lt;d&gt; &eacute;&#233;&#x41;</p>", "abc & <d> ééA"),
        ("<p><b>Bold text here.<br><p>Next one.</p>", "Bold text here. Next one."),
        ("<p>Start.<script>var t = '</p>';</script> End.</p>", "Start. End."),
        ("<p>Before.</p><div class='advert'><p>Buy it now!</p></div><p>After.</p>", "Before. After."),
        ("<p>cut off &am", "cut off &am"),
    ],
)
def test_blocks(article, text):
    filler = "<p>" + "Words of the story go on here, and on. " * 6 + "</p>"
    page = f"<html><body><nav><ul><li><a href='/x'>x</a></li></ul></nav><article>{filler}{article}</article><footer>&copy; someone</footer></body></html>" if "&am" not in article else f"<html><body><article>{filler}{article}"
    assert extract([page], trained())[0] == " ".join((("Words of the story go on here, and on. " * 6) + text).split())


def test_marks_of_a_page_are_no_marks():
    page = '<article><p data-mark="x">Some text is here, in full.</p><p data-mark="">And more of it.</p><p data-mark="0">The end.</p></article>'
    assert extract([page], trained()) == ["Some text is here, in full. And more of it. The end."]


def test_deep_nesting_takes_linear_time():
    import time

    took = []
    for n in (20_000, 160_000):
        began = time.perf_counter()
        Page("<div>" * n + "<p>x<li>y" + "</b>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0]


def article_text(source):
    """The article of the tables' pages by plain string work: its blocks
    without elements that a class or a tag calls an advert."""
    body = re.sub(r"<(script|style|form|aside|nav|header|footer)\b.*?</\1>", "", source[source.index("<article") : source.index("</article>")], flags=re.S)
    body = re.sub(r'<div class="?ad\b.*?</div>', "", body, flags=re.S)
    parts = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", b))) for b in re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|article|blockquote|section|pre|table|tr|td)\b[^>]*>", body)]
    return " ".join(" ".join(p.split()) for p in parts if p.strip())


def test_pages_table_against_plain_string_work(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_pages(pages).collect()}
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    some = {i: article_text(s) for i, s in source.items() if s.count("<article") == 1 == s.count("</article>")}
    assert len(got) == len(source) and len(some) > 0.5 * len(source)
    assert np.mean([got[i] == t for i, t in some.items()]) > 0.99


def test_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<p", 3), (4, "u", "<article><p>Some text is here, in full.</p></article>", 4), (4, "u", "x" * 300_000, 5), (5, "u", '<a href="' * 300, 6)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in X.toxicity(docs, labels).collect()}
    known = [(got[r["doc_id"]], r["toxic"]) for r in labels.collect()]
    assert np.mean([g["toxic"] for g, y in known if not y]) < 0.01
    assert np.mean([g["toxic"] for g, y in known if y]) > 0.9
    assert all(0 <= g[f"p_{c}"] <= 1 for g, _ in known for c in X.CHAIN)


def test_a_chain_against_plain_fits():
    """fit_chain by hand: each model on words, out-of-fold probabilities of the
    models before it, and an intercept, by plain gradient steps."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (300, 5)).astype(np.float32)
    first = (x[:, 0] + rng.random(300) > 1.2).astype(float)
    labels, folds, l2 = np.column_stack([first, (first + x[:, 1] + rng.random(300) > 1.8)]), np.arange(300) % 4, 1e-2

    def plain(z, y):
        w = np.zeros(z.shape[1])
        for _ in range(20_000):
            d = z.T @ (y - 1 / (1 + np.exp(-z @ w))) / len(y)
            d[:-1] -= l2 * w[:-1]
            w += 0.5 * d
        return w

    chain, earlier = X.fit_chain(("a", "b"), {}, x, labels, folds, l2), np.zeros((300, 0))
    for k in range(2):
        z, held = np.column_stack([x, earlier, np.ones(300)]), np.zeros(300)
        assert np.abs(chain.weights[k] - plain(z, labels[:, k])).max() < 0.05
        for f in range(4):
            held[folds == f] = 1 / (1 + np.exp(-z[folds == f] @ plain(z[folds != f], labels[folds != f, k])))
        earlier = np.column_stack([earlier, held])


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "you idiot", 1), (2, "", 1), (2, "fine", 1)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None)], "doc_id long, toxic int")
    assert len(X.toxicity(docs, labels).collect()) == 4
    assert len(X.toxicity(docs, labels.limit(0)).collect()) == 4
    assert X.toxicity(docs.limit(0), labels).collect() == []


def test_a_later_model_gets_earlier_probabilities():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (400, 6)).astype(np.float32)
    first = x[:, 0]
    labels = np.column_stack([first, first])
    chain = X.fit_chain(("a", "b"), {}, x, labels, np.arange(400) % 4)
    assert len(chain.weights[0]) == 7 and len(chain.weights[1]) == 8 and chain.weights[1][6] > 0
    assert ((chain.probabilities(x) > 0.5) == labels).all()
