"""Operators held against brute force or held-out accuracy: toxicity, quality, near dedup, extraction, pipeline."""

import collections
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from swarmlake.llm import html_extract, prob_minhash, queries, toxicity
from swarmlake.llm.common import words
from swarmlake.llm.quality import score_quality

ROWS = [(1, "one two three"), (2, None), (3, ""), (4, "!!!"), (None, "one two three"), (5, "ONE two, three"), (5, "one two three"), (6, "w " * 5000), (7, "w " * 5001)]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "s", "en", 0, 0.5) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long, score double")


def classes(rows, width=5, bound=0.8):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    shared = collections.Counter((a, b) for own in at.values() for j, b in enumerate(own) for a in own[:j])
    for (a, b), n in shared.items():
        if n >= bound * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    out = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        out[find(i)].append(doc)
    return sorted((doc, max((x for x in own if x is not None), default=None), len(own)) for own in out.values() for doc in own if doc is not None)


def test_near_duplicates_are_brute_force(spark, sf):
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in queries.op9_minhash_near_dedup(spark, sf).collect())
    assert got == classes(rows)


def near_matrix(rows, width=5, bound=0.8):
    """Class ids by all pairs, through a matrix of shingles."""
    sets = [{tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (t.split() for _, t in rows)]
    column = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(rows), len(column)), np.float32)
    for i, own in enumerate(sets):
        m[i, [column[x] for x in own]] = 1
    n = m.sum(1)
    common = m @ m.T
    near = common >= bound * (n[:, None] + n[None, :] - common)
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label[None, :], -1).max(1)
        if (new == label).all():
            return {rows[i][0]: rows[label[i]][0] for i in range(len(rows))}
        label = new


def test_near_duplicates_in_a_large_family(spark):
    """Copies of one text with a few words changed: all fall in the same large buckets, and no link is lost."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(2500):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(120)] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["class_id"] for r in prob_minhash.near_duplicates(documents(spark, rows)).collect()}
    want = near_matrix(rows)
    assert got == want and len(set(want.values())) > 500


def test_near_duplicates_pairs_in_large_buckets(spark):
    """Texts that share large buckets with many others, but whose only partner is one of them."""
    rng = random.Random(11)
    rows = []
    for i in range(200):
        places = [k + rng.randrange(20) for k in (10, 60, 110, 160)]
        for j in (0, 1):  # the same places, other words: what the two share, most texts share
            text = [f"b{k}" for k in range(200)]
            for k in places:
                text[k] = f"e{2 * i + j}x{k}"
            rows.append((2 * i + j, " ".join(text)))
    want = {i: (c, n) for i, c, n in classes(rows)}
    assert sum(n == 2 for _, n in want.values()) > 300
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in prob_minhash.near_duplicates(documents(spark, rows)).collect()} == want
    assert {r["doc_id"]: (r["class_id"], r["class_size"]) for r in prob_minhash.near_duplicates(documents(spark, rows), block=20).collect()} == want


def test_near_duplicates_of_texts_with_repeats(spark):
    """The same shingles, many times over in one text: equal as sets, far apart by weights."""
    rows = []
    for i in range(40):
        text = [f"t{i}w{k}" for k in range(400)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text + text[10 : 20 + i % 15] * (20, 50, 200)[i % 3]))]
    got = sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in prob_minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == classes(rows) and all(n == 2 for _, _, n in got)


def test_near_duplicates_edges(spark):
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in prob_minhash.near_duplicates(documents(spark)).collect()), key=str)
    want = [(1, 5, 4, False), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 4, True), (5, 5, 4, True), (6, 7, 2, False), (7, 7, 2, True), (None, 5, 4, False)]
    assert got == sorted(want, key=str)
    assert prob_minhash.near_duplicates(documents(spark, [])).count() == 0


def test_registers_estimate_probability_jaccard():
    import pyarrow as pa

    rng = random.Random(1)
    a = [f"a{i}" for i in range(300)]
    b = a[:240] + [f"b{i}" for i in range(60)]
    rng.shuffle(a)
    s = prob_minhash.Shingled(pa.array([" ".join(a), " ".join(b)]), 1)
    got = prob_minhash.signatures(s, 2, 2048)
    assert abs((got[0] == got[1]).mean() - 240 / 360) < 0.04
    s = prob_minhash.Shingled(pa.array(["x x x y", "x y"]), 1)  # weights (3, 1) and (1, 1): 1/(1+1) + 1/(3+1)
    got = prob_minhash.signatures(s, 2, 4096)
    assert abs((got[0] == got[1]).mean() - 0.75) < 0.04


def scored(frame, labels, label):
    both = labels.merge(frame, on="doc_id")
    both = both[both.held_out]
    return both[both[label] == 1].predicted.mean(), both[both[label] == 0].predicted.mean()


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = duckdb.connect().execute(f"SELECT * FROM '{sf}/labels.parquet'").df()
    hit, wrong = scored(queries.op2_toxicity(spark, sf).toPandas(), labels, "toxic")
    assert hit >= 0.75 and wrong <= 0.03


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(documents(spark), labels).toPandas()
    assert len(got) == len(ROWS) and got.score.between(0, 1).all() and got.predicted.sum() == 0
    rude = toxicity.score_toxicity(documents(spark, [(1, "You idiot, moron and loser!"), (2, "a calm text")]), labels).toPandas().set_index("doc_id")
    assert rude.predicted.to_dict() == {1: 1, 2: 0}
    assert toxicity.score_toxicity(documents(spark, []), labels).count() == 0
    late = toxicity.score_toxicity(documents(spark, [(1, "calm words " * 30_000 + "you idiot, moron and loser"), (2, "calm words " * 30_000)]), labels).toPandas().set_index("doc_id")
    assert late.predicted.to_dict() == {1: 1, 2: 0}


def test_label_model_finds_accuracies_and_a_correlated_pair():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.2
    votes = np.zeros(20000, np.int64)
    for v, (hit, wrong) in enumerate([(0.8, 0.02), (0.6, 0.05), (0.5, 0.1), (0.7, 0.03)]):
        votes |= (rng.random(20000) < np.where(y, hit, wrong)).astype(np.int64) << v
    votes |= ((votes >> 2) & 1) << 4  # voter 4 repeats voter 2
    patterns, where, counts = np.unique(votes, return_inverse=True, return_counts=True)
    few = np.arange(500)
    labelled = np.stack([np.bincount(where[few][y[few] == k], minlength=len(patterns)) for k in (0, 1)]).astype(float)
    model = toxicity.LabelModel(patterns, counts.astype(float), labelled)
    assert (2, 4) in model.factors
    assert abs(model.balance - 0.2) < 0.03
    assert ((model.posterior[where] > 0.5) == y).mean() > 0.94
    assert model.accuracy[(0,)][1] > model.accuracy[(1,)][1] > 3


def test_label_model_is_plain_em():
    """The fit on counted patterns against the same steps, row by row, in plain Python."""
    rng = np.random.default_rng(1)
    y = rng.random(600) < 0.3
    votes = np.zeros(600, np.int64)
    for v in range(3):
        votes |= (rng.random(600) < np.where(y, 0.7, 0.1)).astype(np.int64) << v
    labelled = [int(k) if i < 60 else None for i, k in enumerate(y)]
    patterns, where, counts = np.unique(votes, return_inverse=True, return_counts=True)
    known = np.stack([[sum(labelled[i] == k and where[i] == p for i in range(60)) for p in range(len(patterns))] for k in (0, 1)]).astype(float)
    model = toxicity.LabelModel(patterns, counts.astype(float), known, rounds=25)
    assert model.factors == [(v,) for v in range(toxicity.VOTERS)]
    post = [(known[1][p] + 0.1) / (known[:, p].sum() + 1) for p in where]
    for _ in range(25):
        weight = [float(labelled[i]) if labelled[i] is not None else post[i] for i in range(600)]
        toxic = sum(weight)
        share = (toxic + 1) / 602
        odds = {}
        for v in range(toxicity.VOTERS):
            sums = [[0.2, 0.2], [0.2, 0.2]]
            for i in range(600):
                fires = int(votes[i]) >> v & 1
                sums[0][fires] += 1 - weight[i]
                sums[1][fires] += weight[i]
            for fires in (0, 1):
                odds[v, fires] = np.log(sums[1][fires] / sum(sums[1])) - np.log(sums[0][fires] / sum(sums[0]))
        logit = [np.log(share / (1 - share)) + sum(odds[v, int(votes[i]) >> v & 1] for v in range(toxicity.VOTERS)) for i in range(600)]
        post = [1 / (1 + np.exp(-x)) for x in logit]
    assert np.allclose(model.posterior[where], post, atol=1e-6)


def test_repeated_labelled_ids_teach_once(spark, monkeypatch):
    """A labelled id with 200 different texts is one row of what is mined."""
    mined = []
    monkeypatch.setattr(toxicity, "mine_terms", lambda rows, real=toxicity.mine_terms: (mined.append(rows.count()), real(rows))[1])
    docs = spark.createDataFrame([(i, f"plain words {i}") for i in range(30)] + [(0, f"other words {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 230
    assert mined and mined[0] <= 30


def test_toxicity_learns_from_unlabelled_documents(spark):
    """A word that no labelled text holds gets its weight from the posteriors of the documents it stands in; odd columns and long texts do no harm."""
    rng = random.Random(2)
    calm, rude = [f"calm{i}" for i in range(300)], ["hatex", "vilex", "foulx"]
    rows, labels = [], []
    for i in range(3000):
        toxic = i % 6 == 0
        said = rng.choices(calm, k=30) + (rng.sample(rude, 2) if toxic else [])
        rng.shuffle(said)
        rows.append((i, " ".join(said)))
        labels.append((i, int(toxic)))
    rows += [(5000, "calm1 " * 100_000), (5001, "calm1 " * 100_000 + " hatex vilex foulx"), (None, None), (5002, "")]
    table = spark.createDataFrame([(i, t, 7, "v", 0.5, "x") for i, t in rows], "doc_id long, text string, hits int, votes string, score double, share string")
    got = toxicity.score_toxicity(table, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["predicted"] for r in got}
    wrong = [i for i, k in labels if by[i] != k]
    assert len(wrong) <= 15 and (by[5000], by[5001], by[5002], by[None]) == (0, 1, 0, 0)


def test_linear_fit_is_logistic_regression():
    """Weighted counts give the same weights as the rows they stand for."""
    row, col = np.array([0, 1, 1, 2]), np.array([0, 0, 1, 1])
    once = toxicity.fit_linear(np.concatenate((row, row + 3)), np.concatenate((col, col)), np.array([1, 0.5, 0, 1, 0.5, 0.0]), np.ones(6), 2)
    assert np.allclose(once, toxicity.fit_linear(row, col, np.array([1, 0.5, 0.0]), np.full(3, 2.0), 2))
    assert once[0] > 0 > once[1]


def test_shrinkage_is_plain_python(spark):
    from swarmlake.llm import quality

    rng = random.Random(3)
    groups = [(sum(rng.random() < p for _ in range(n)), n) for n, p in ((rng.randrange(1, 60), rng.random()) for _ in range(80))]
    above = 0.45
    many = [(s / n, n) for s, n in groups if n > 1]
    spread, noise, var = sum(n * (m - above) ** 2 for m, n in many), len(many) * above * (1 - above), sum(n for _, n in many) * above * (1 - above)
    share = max(0.0, (spread - noise) / var)
    want = min(1e4, max(1.0, (1 - min(share, 0.999)) / share))
    df = spark.createDataFrame([(float(s), n) for s, n in groups], "_sum double, _n long")
    assert quality.shrunk(df, F.lit(above)) == pytest.approx(want)
    assert quality.shrunk(df.filter("_n = 1"), F.lit(above)) == 1e4


@pytest.mark.parametrize("hosts", [50_000, 1])
def test_quality_posteriors_are_plain_python(spark, hosts):
    """Scores against sums over hosts and paths in plain Python, with a host of most documents; columns have the operator's names."""
    from swarmlake.llm import quality

    rng = random.Random(5)
    rows = []
    for i in range(2600):
        host = "big" if i % 2 else f"h{i % 40}"
        text = " ".join(rng.choices(["Good", "words", "stand", "here."], k=40)) if rng.random() < (0.8 if host == "big" else (i % 40) / 40) else "%%% $$ 1 2 3 ### " * rng.randrange(1, 5)
        rows.append((i, text, host, "en" if i % 3 else "fr", i % 2, 0.5))
    rows += [(9000, None, None, None, 0, 0.5), (9001, "long text. " * 50_000, "big", "en", 0, 0.5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, host int, score double")
    labels = spark.createDataFrame([(i, int(t is not None and t.startswith(("Good", "words", "stand", "here")))) for i, t, *_ in rows if i % 2 == 0], "doc_id long, quality int")
    got = quality.score_quality(table, labels, max_hosts=hosts).toPandas()
    assert len(got) == len(rows)
    taught = labels.toPandas()
    import zlib

    taught = taught[[zlib.crc32(str(i).encode()) % 3 != 1 for i in taught.doc_id]]
    rate = (taught.quality.sum() + 1) / (len(taught) + 2)
    p = 1 / (1 + np.exp(-(got.evidence + np.log(rate / (1 - rate)))))
    top = (p.sum() + 0.5) / (len(p) + 1)

    def strength(sums, above):
        many = sums[sums.n > 1]
        a = above[sums.n > 1] if hasattr(above, "__len__") else above
        m = many.s / many.n
        var, noise = (many.n * a * (1 - a)).sum(), (a * (1 - a) * np.ones(len(many))).sum()
        share = max(0.0, ((many.n * (m - a) ** 2).sum() - noise) / var)
        return min(1e4, max(1.0, (1 - min(share, 0.999)) / max(share, 1e-9)))

    host = got.assign(p=p).groupby("host").agg(s=("p", "sum"), n=("p", "size"))
    j = strength(host, top)
    host["post"] = (host.s + j * top) / (host.n + j)
    path = got.assign(p=p).groupby(["host", "path"]).agg(s=("p", "sum"), n=("p", "size")).reset_index()
    above = path.host.map(host.post)
    k = strength(path, above)
    both = got.assign(p=p).merge(path, on=["host", "path"]).merge(host.reset_index(), on="host", suffixes=("", "_host"))
    rest = (both.s_host - both.p + j * top) / (both.n_host - 1 + j)
    post = (both.s - both.p + k * rest) / (both.n - 1 + k)
    want = 1 / (1 + np.exp(-(both.evidence + np.log(post / (1 - post)))))
    assert np.allclose(both.score, want, atol=1e-9)


def test_a_lone_document_counts_once(spark):
    """The only document of a site: its site says what all sites say, whatever its own evidence."""
    rows = [(i, "Good words stand here. " * 20 if i % 2 else "%%% $$ 1 2 ", f"h{i}", "en") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = score_quality(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), labels).toPandas()
    site = np.log(got.score / (1 - got.score)) - got.evidence
    assert site.std() < 1e-6


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = duckdb.connect().execute(f"SELECT * FROM '{sf}/labels.parquet'").df()
    good, bad = scored(queries.op6_quality_classifier(spark, sf).toPandas(), labels, "quality")
    assert good >= 0.95 and bad <= 0.1


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = score_quality(documents(spark), labels).toPandas()
    assert len(got) == len(ROWS) and got.score.between(0, 1).all()
    assert score_quality(documents(spark, []), labels).count() == 0
    long = score_quality(documents(spark, [*ROWS, (8, "some words, and more. " * 20_000)]), labels).toPandas()
    assert len(long) == len(ROWS) + 1 and long.score.between(0, 1).all()


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header class="site">Site</header>
<nav><ul><li><a>Menu</a></ul></nav><div class="cookie-notice">Cookies</div>
<article><header><h1>Title &amp; more</h1></header><p>First&nbsp;line<br>goes   on <b>bo</b>ld<script>var x="</p>";</script><p>a &lt; b<aside>side</aside>
<div class="promo">Buy</div><ul><li>one<li>two</ul><form><p>mail</p></form><section id="comments"><p>Nice!</p></section></article><footer>&copy; x</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 0) for i, u, h in rows], "page_id long, url string, html string, text string, n long")


def test_extraction(spark):
    got = {r["page_id"]: r for r in html_extract.extract_text(pages(spark, [(1, "http://h/x", PAGE), (2, None, None), (3, "u", ""), (4, "u", "just <i>te</i>xt & more"), (5, "u", "<p>a<p>b</div></p>c<")])).collect()}
    assert got[1]["text"] == "Title & more\nFirst line goes on bold\na < b\none\ntwo"
    assert [got[i]["text"] for i in (2, 3, 4, 5)] == ["", "", "just text & more", "a\nb\nc<"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract_text(pages(spark, [])).count() == 0


def test_marks(spark):
    page = """<div class="page has-sidebar sidebar-right"><main id="main"><article class="post"><div class="entry-header"><h1>T</h1></div><p>x</p>
<article class="comment"><p>Nice</p></article><div id="respond">r</div></article></main><div class="related"><article><p>Teaser</p></article></div></div>"""
    assert html_extract.extract_text(pages(spark, [(1, "u", page)])).first()["text"] == "T\nx"


@pytest.mark.parametrize("shared", [200_000, 0])
def test_site_templates_go(spark, shared):
    body = "<body><div><div>About us</div><div>Imprint</div></div><div><p>Story {i} tells this</p><p>Same ending</p></div><div>Part {j}</div></body>"
    rows = [(i, f"https://www.a.org/{i}", body.format(i=i, j=i % 2)) for i in range(40)] + [(100 + i, f"http://b.org/{i}", body.format(i=i, j=i)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages(spark, rows), max_shared=shared).collect()}
    assert got[7] == "Story 7 tells this"
    assert got[101] == "About us\nImprint\nStory 1 tells this\nSame ending\nPart 1"


@pytest.mark.parametrize("shared", [200_000, 0])
def test_copies_are_no_template(spark, shared):
    """Copies of a page or an article count once; what different pages share still goes."""
    plain = "<body><div><div>About us</div></div><div><p>Story {i} tells this</p><ul><li>point {i}</ul></div></body>"
    article = "<body><div>Part {j}</div><article><div><h1>Title {i}</h1><p>Text {i}</p></div><section><p>Share it</p></section></article></body>"
    rows = [(i, f"http://a.org/{i}", plain.format(i=0)) for i in range(30)] + [(100 + i, f"http://a.org/o{i}", plain.format(i=i)) for i in range(1, 20)]
    rows += [(200 + i, f"http://b.org/{i}", article.format(i=0, j=i)) for i in range(30)] + [(300 + i, f"http://b.org/o{i}", article.format(i=i, j=i)) for i in range(1, 20)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages(spark, rows), max_shared=shared).collect()}
    assert {got[i] for i in range(30)} == {"Story 0 tells this\npoint 0"} and got[107] == "Story 7 tells this\npoint 7"
    assert {got[200 + i] for i in range(30)} == {"Title 0\nText 0"} and got[307] == "Title 7\nText 7"


def test_names_alone_remove_no_article_text(spark):
    """Names that only hold a mark, and marked text elements, stay; whole names of marks go; one that hints goes once it recurs."""
    kept = '<div class="search-results">found</div><div id="form-factor">small</div><div class="social-history">past</div><blockquote class="notice">said</blockquote>'
    gone = '<div class="ad">Buy</div><div class="comment-list"><p>Nice</p></div><section id="related-posts">More</section><div class="cookie-notice">Cookies</div><div class="ad-slot2">Ad</div>'
    page = lambda i, more="": f"<body><article><h1>T{i}</h1>{kept.replace('found', f'found {i}').replace('small', f'small {i}').replace('past', f'past {i}')}{gone}{more}</article></body>"
    share = '<div class="share-our-story">Tell friends</div>'
    rows = [(i, f"http://a.org/{i}", page(i, share)) for i in range(2)] + [(9, "http://b.org/9", page(9, share))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert got[0] == "T0\nfound 0\nsmall 0\npast 0\nsaid" and got[1] == "T1\nfound 1\nsmall 1\npast 1\nsaid"
    assert got[9] == "T9\nfound 9\nsmall 9\npast 9\nsaid\nTell friends"


def test_markup_of_all_kinds(spark):
    cases = {
        "<article><a title=it's>two</a> b</article>": "two b", "<article><p title='a>b' data-x=\"c>d\">one</p></article>": "one", "<article><p class=x data=a\"b>q</p></article>": "q",
        '<article>a<img alt="x > y">b</article>': "ab", "<article>1 < 2 &amp; 3 > 2</article>": "1 < 2 & 3 > 2", "<article><p title=\"open>rest</p></article>": "rest",
        "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>": "deep", "<article><p>" + "long &eacute; " * 100_000 + "</p></article>": ("long é " * 100_000).strip(),
    }
    rows = [(i, "http://h/x", page) for i, page in enumerate(cases)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == list(cases.values())


def test_wrappers_keep_their_article(spark):
    """What an article or a page lies in stays, whatever it is called; whole names decide, not words in names."""
    cases = {
        '<div class="page-wrapper modal-ready"><article><p>Hello</p></article></div>': "Hello", '<div class="layout-header-fixed"><article><p>Hello</p></article></div>': "Hello",
        "<form><article><p>Hello</p></article></form>": "Hello", '<form id="aspnetForm"><div><p>Hello all</p></div></form><p>x</p>': "Hello all\nx",
        '<div class="widget"><div class="modal"><main><p>Hello</p></main></div></div><p>a</p>': "Hello", '<div id="content" class="social-history"><p>Hello</p></div>': "Hello",
        '<div><p class="share-price">12</p><p class="comment-on-law">Hello</p></div>': "12\nHello", "<article data-u=/a/><p>Hello</p></article>": "Hello", "<article><br/><div class='x'/>a</article>": "a",
        "<article><!--><p>Hello</p></article>": "Hello", "<article><!---><p>Hello</p></article>": "Hello", "<article><!-- x --!><p>Hello</p></article>": "Hello", '<p>Hello</p><p class="a': "Hello",
        '<div class="related"><article><p>Teaser</p></article></div><div><p>A longer text of the page</p></div>': "A longer text of the page", '<div class="notice"><p>All there is</p></div>': "All there is",
        '<article><ul class="menu"><li>Soup</ul><div class="widget">A lever</div><div class="ad">Buy</div></article>': "Soup\nA lever", '<p>Text</p><form><input name=q><label>Find</label></form>': "Text",
    }
    rows = [(i, f"http://h{i}/x", page) for i, page in enumerate(cases)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == list(cases.values())


def test_counts_alone_remove_the_frame_of_a_site(spark):
    """1,000 generated pages of a host without a telling name: menu, side column and foot recur, in 40 sections with links of their own."""
    import random

    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    foot, sections = f"<div><div>{word()} {word()}</div><p>{word()}</p></div>", [f"<div><ul><li>{word()}<li>{word()}</ul></div>" for _ in range(40)]
    rows, want = [], {}
    for i in range(1000):
        body = [" ".join(word() for _ in range(12)) for _ in range(3)]
        rows.append((i, f"http://a.org/{i}", f"<html><body><div><div>Home</div><div>News</div></div>{sections[i % 40]}<div><p>{'</p><p>'.join(body)}</p></div>{foot}</body></html>"))
        want[i] = "\n".join(body)
    got = {x["page_id"]: x["text"] for x in html_extract.extract_text(pages(spark, rows), min_share=0.02).collect()}
    assert got == want


def test_templates_of_a_large_host(spark):
    """A section's sidebar on a hundredth of a large host's pages is a template by number."""
    rows = [(i, f"http://a.org/{i}", f"<body><div><p>Text {i}</p></div>{'<div><p>Section links</p></div>' if i < 120 else ''}</body>") for i in range(4000)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages(spark, rows)).collect()}
    assert got[3] == "Text 3" and got[500] == "Text 500"
    few = html_extract.extract_text(pages(spark, rows), min_many=10**6)
    assert {r["page_id"]: r["text"] for r in few.collect()}[3] == "Text 3\nSection links"


def test_pages_of_the_tables(spark, sf):
    import html
    import re

    want = {}
    for i, h in duckdb.connect().execute(f"SELECT page_id, html FROM '{sf}/pages.parquet'").fetchall():
        body = re.sub("</?b>", "", re.search("<article>(.*?)</article>", h, re.S)[1].replace("<br>", " "))
        want[i] = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in re.split("</?(?:p|h1)>", body)) if x)
    assert {r["page_id"]: r["text"] for r in queries.op10_html_extraction(spark, sf).collect()} == want


def test_pipeline(spark, sf):
    """Each stage against a plain computation on what the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    bench = [words(t) for (t,) in duckdb.connect().execute(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[k : k + 10]) for w in bench for k in range(len(w) - 9)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf)
        assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name == "toxicity":
            scores = queries.op2_toxicity(spark, sf).collect()
            assert kept[name] == {r["doc_id"] for r in scores if not r["predicted"]}
        elif name == "exact_dedup":
            low = {t.translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})): i for i, t in sorted(before.items())}
            assert kept[name] == set(low.values())
        elif name == "near_dedup":
            assert kept[name] == {c for _, c, _ in classes(list(before.items()))}
        else:
            clean = lambda w: not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))
            assert kept[name] == {i for i, t in before.items() if clean(words(t))}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == kept["decontamination"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == kept["decontamination"]


def test_pipeline_edges(spark, sf):
    rows = documents(spark, [*ROWS, (5, "one two three"), (8, "very long " * 60_000)]).withColumns({"keep": F.lit(1), "__kept_id": F.lit(2), "n_hit": F.lit(3), "_row": F.lit(4)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, sf).columns == rows.columns
        assert stage(spark, rows.limit(0), sf).count() == 0
    assert [r["doc_id"] for r in corpus_pipeline.exact(spark, documents(spark, [(5, "a"), (5, "a"), (4, "A")]), sf).collect()] == [5]
