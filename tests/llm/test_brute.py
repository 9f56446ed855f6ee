"""Queries that SQL can't express, or only in part, against brute-force versions of the whole; and empty tables."""

import html
import math
import random
from collections import Counter
from urllib.parse import urljoin, urlsplit

import numpy as np

import corpus_pipeline
from tabdrift.llm import op03_url_filters, op04_decontaminate, op07_quality_model
from tabdrift.llm.common import Scratch, words_of


def host_and_path(url):
    if "://" not in (url or ""):
        return "", ""
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def said(host, path):
    fits = [(len(r), v) for r, v in op03_url_filters.RULES for name, _, rest in [r.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
    return max(fits)[1] if fits else None


def test_link_graphs(spark):
    """Random pages with links of all forms: blocks spread over classes, explicit allows win."""
    rng = random.Random(11)
    hosts = ["a.org", "B.org", "c.net", "example.com", "d.org", "e.org"]
    url = lambda: f"http://{rng.choice(hosts)}/{rng.choice(['es', 'en', 'x', 'y'])}/{rng.randint(0, 6)}{rng.choice(['', '?q=1&r=2'])}"
    pages, edges = [], []
    for k in range(120):
        own, target = url(), rng.choice([url(), f"../{rng.choice(['es', 'x'])}/{rng.randint(0, 6)}", f"{rng.randint(0, 6)}", f"/y/{rng.randint(0, 6)}"])
        form = rng.randint(0, 5)
        text = html.escape(target)
        doc = {
            0: f'<link rel="canonical" href="{text}">', 1: f"<LINK href='{text}' rel=canonical>", 2: f'<meta http-equiv="refresh" content="0; url={text}">',
            3: f'<meta content="5;URL={text}" http-equiv=refresh>', 4: f'<a href="{text}">no link of ours</a>', 5: "",
        }[form]
        pages.append((k, own, doc))
        if form < 4:
            edges.append((own, urljoin(own, target)))
    node = lambda u: (urlsplit(u).netloc.lower(), (urlsplit(u).path, urlsplit(u).query))
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(node(a))] = root(node(b))
    verdicts = {}
    for n in list(parent):
        verdicts.setdefault(root(n), set()).add(said(n[0], n[1][0]))
    want = {}
    for k, u, _ in pages:
        known = verdicts.get(root(node(u)), set())
        want[k] = said(*host_and_path(u)) or ("block" if "block" in known and "allow" not in known else "allow")
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in op03_url_filters.judge(df, Scratch(spark)).collect()}
    assert got == want and "block" in want.values()


def test_bm25(spark):
    """Scores of all passages against all items, with question and answer overlap, by the formulas alone."""
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefghij") * rng.randint(1, 4)
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 30)))) for i in range(25)]
    alter = lambda t: " ".join(w if rng.random() > 0.15 else "zz" for w in t.split())
    docs = [(k, " ".join([*[word() for _ in range(rng.randint(0, 60))], *(alter(items[k % 25][1]).split() if k % 2 else []), *[word() for _ in range(5)]])) for k in range(60)]
    docs += [(100, ""), (101, None), (7, docs[1][1])]
    terms = {i: Counter(words_of(t)) for i, t in items}
    mean = sum(sum(c.values()) for c in terms.values()) / len(terms)
    df = Counter(w for c in terms.values() for w in c)
    k1, b = op04_decontaminate.K1, op04_decontaminate.B

    def weight(i, w):
        c = terms[i]
        return math.log(1 + (len(terms) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean))

    own = {i: sum(weight(i, w) for w in c) for i, c in terms.items()}
    step = max(sum(c.values()) for c in terms.values())
    grams = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}

    def inside(part, near):
        if len(part) < 5 or len(grams(part)) == 1:
            return any(near[k : k + len(part)] == part for k in range(len(near) - len(part) + 1)) if len(part) <= 5 else len(grams(part) & grams(near)) / len(grams(part)) >= 0.5
        return len(grams(part) & grams(near)) / len(grams(part)) >= op04_decontaminate.OVERLAP

    want = []
    for d, text in docs:
        ws = words_of(text)
        found = {}
        for a in range(0, len(ws), step):
            seen = set(ws[a : a + 2 * step])
            near = ws[max(0, a - step) : a + 3 * step]
            for i, t in items:
                score = sum(weight(i, w) for w in terms[i] if w in seen) / own[i]
                full = words_of(t)
                middle = (len(full) + 1) // 2
                if score >= op04_decontaminate.THRESHOLD - 1e-9 and all(inside(p, near) for p in (full[:middle], full[middle:]) if p):
                    found[i] = max(found.get(i, 0), score)
        want.append((d, sorted(found), [round(found[i], 6) for i in sorted(found)]))
    got = op04_decontaminate.find(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, list(r["items"]), [round(s, 6) for s in r.scores]) for r in got) == sorted(want)
    assert any(0 < s < 0.99 for _, _, scores in want for s in scores)


def test_additive_scores(spark):
    """A score is the base plus one table entry a feature and a pair; boosting lowers the loss it is fitted to."""
    rng = np.random.default_rng(13)
    x = rng.random((400, len(op07_quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.6)).astype(float)
    model = op07_quality_model.fit(x, y)
    for row, score in zip(x[:50], model.score(x[:50])):
        at = [sum(v >= e for e in edges) for v, edges in zip(row, model.edges)]
        total = model.base + sum(t[k] for t, k in zip(model.tables, at)) + sum(t[at[i] // 4, at[j] // 4] for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + math.exp(-total))) < 1e-9
    loss = lambda s: -np.log(np.where(y == 1, s, 1 - s)).mean()
    assert loss(model.score(x)) < 0.6 * loss(np.full(len(y), y.mean()))


def test_empty_tables(spark, tmp_path):
    """Every stage, and the queries that make further tables, give no rows for no rows."""
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, node string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = Scratch(spark).save(stage(spark, out, str(tmp_path)), name)
        assert out.count() == 0
    rows = op07_quality_model.extract(docs)
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, quality int")
    assert op07_quality_model.apply(spark, rows, op07_quality_model.train(rows, labels)).count() == 0
