"""URL filter: rules against a plain reading of their definition, trees that learn, edge rows."""

import math
import random

import gritstone.llm.url_filter as url_filter_module
from gritstone.llm.url_filter import RULES, _out_of_fold, fit_trees, host_path, lexical, op1_url_filter, url_filter

SMALL = "/root/testdata/sf0.001"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    cut = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return host, path[:cut]


def judged(url, rules=RULES):
    host, path = parts(url)
    fit = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fit)[1:] if fit else (None, None)


URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/", "https://WWW.Example.COM/en/x?y=/en/", "http://example.com", "http://example.com?x", "http://x.com/", "http://xcom/", "http://com/a",
    "http://b.example.net/es/1#t", "http://b.example.net/fr/1", "http://b.example.net/de/1", "http://b.example.org/en/1", None, "", "no scheme", "://", "http://", "ftp://a.net/es/", "http://a.net:80/es/",
    "http://É.com/A", "http://a.net/ES/1", "x" * 5000, "http://evil.com/\n/a", "http://a.com/a://b",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string").repartition(3)
    got = {r.page_id: r for r in url_filter(pages).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate(URLS * 2):
        rule, verdict = judged(u)
        assert (got[i].host, got[i].path, got[i].rule) == (*parts(u), rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    good = [f"http://site{i}.example/news/story-{i}" for i in range(150)]
    bad = [f"http://x{i * 7919}{i}.example/?a={i}&b={i * 31}&c=1&d=2" for i in range(150)]
    labelled = spark.createDataFrame([(u, 0.0) for u in good[:100]] + [(u, 1.0) for u in bad[:100]] + [(None, None)], "url string, y double")
    pages = spark.createDataFrame(list(enumerate(good[100:] + bad[100:])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter(pages, labelled, rules=()).collect()}
    assert sum(got[i] == ("allow" if i < 50 else "block") for i in got) >= 95


def test_without_labels_or_pages(spark):
    one = url_filter(spark.createDataFrame([(None, "http://a.org/x")], "page_id long, url string")).collect()
    assert [(r.page_id, r.verdict) for r in one] == [(None, "allow")]
    assert url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_query_against_a_plain_reading_of_the_rules(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()}
    got = {r.page_id: r for r in op1_url_filter(spark, SMALL).collect()}
    assert got.keys() == pages.keys()
    for k, r in got.items():
        rule, verdict = judged(pages[k])
        assert (r.host, r.path, r.rule) == (*parts(pages[k]), rule)
        assert r.verdict == (verdict or ("block" if r.score > 0.5 else "allow"))


def test_suffix_statistics_hold_no_label_of_their_own_row(spark):
    """Each url has a domain of its own, so its domain says nothing of others; parameters say nine tenths."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        many = rng.random() < 0.5
        y = float(many if rng.random() < 0.9 else not many)
        rows.append((f"http://w{rng.randrange(10**9)}.example/{'?a=1&b=2&c=3&d=4' if many else 'story/of/the/day'}", y))
    labelled = spark.createDataFrame(rows[:400], "url string, y double")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[400:])], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter(pages, labelled, rules=()).collect()}
    assert sum((got[i] == "block") == (y == 1.0) for i, (_, y) in enumerate(rows[400:])) >= 0.84 * 200
    folds = _out_of_fold(lexical(host_path(labelled))).collect()
    assert len(folds) == 400
    assert {(r.domain_rate, r.domain_rows) for r in folds} == {(0.5, 0.0)}  # a domain that no other fold has


def test_informative_suffixes_are_learnt(spark):
    rows = [(f"http://s{i}.{'bad' if i % 2 else 'good'}{i % 6}.example/p", float(i % 2)) for i in range(300)]
    labelled = spark.createDataFrame(rows, "url string, y double")
    pages = spark.createDataFrame([(i, u.replace("/s", "/t")) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter(pages, labelled, rules=()).collect()}
    assert all(got[i] == ("block" if y else "allow") for i, (_, y) in enumerate(rows))


def test_suffixes_that_rules_name_do_not_decide(spark):
    """Labels from rules: two urls that differ in their suffix alone have one score."""
    pages = [(i, f"http://{'www' if i % 3 else 'm'}.site{i % 40}.example.{t}/{'en' if i % 2 else 'es'}/{i}") for i, t in enumerate(["com", "net", "org", "xyz"] * 60)]
    twins = [(1000 + i, f"http://a.b{i}.example.{t}/de/{i}") for i in range(5) for t in ("net", "org", "xyz")]
    frame = spark.createDataFrame(pages + twins, "page_id long, url string")
    found = {}
    for r in url_filter(frame).where("page_id >= 1000").collect():
        found.setdefault(r.page_id, []).append(round(r.score, 12))
    assert all(len(v) == 3 and len(set(v)) == 1 for v in found.values())


def test_every_feature_fitted_on_can_tell_urls_apart(spark, monkeypatch):
    """Labels from rules: no feature is the same for all urls, so none is carried along for nothing."""
    seen = []
    monkeypatch.setattr(url_filter_module, "fit_trees", lambda rows, features=url_filter_module.FEATURES, **k: seen.append((rows.select(*features).collect(), features)) or fit_trees(rows, features, **k))
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, "http://a-b.com/x"])], "page_id long, url string")
    assert url_filter(pages).count() == len(URLS) + 1
    (rows, features), = seen
    assert rows and [f for f in features if len({r[f] for r in rows}) == 1] == []


def margins(x, y, trees, depth, rate, bins, l2, least, balanced):
    """Histogram boosting said plainly: every node looks at all its rows for every feature and cut."""
    n = len(y)
    share = sum(y) / n
    base = 0.0 if balanced else math.log(share / (1 - share))
    w = [(0.5 / share if b else 0.5 / (1 - share)) if balanced else 1.0 for b in y]
    cuts = [sorted({sorted(c)[max(0, math.ceil(n * i / bins) - 1)] for i in range(1, bins)}) for c in zip(*x)]
    out = [base] * n
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in out]
        g, h = [c * (a - b) for a, b, c in zip(p, y, w)], [c * a * (1 - a) for a, c in zip(p, w)]

        def grow(rows, left, g=g, h=h, out=out):
            gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
            best, pick = 1e-3, None
            for f in range(len(cuts)) if left else ():
                for c in cuts[f]:
                    lo = [i for i in rows if x[i][f] <= c]
                    gl, hl = sum(g[i] for i in lo), sum(h[i] for i in lo)
                    if min(hl, hs - hl) * 4 < least:
                        continue
                    gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                    if gain > best + 1e-7:
                        best, pick = gain, (f, c)
            if pick is None:
                for i in rows:
                    out[i] -= rate * gs / (hs + l2)
                return
            for side in (True, False):
                grow([i for i in rows if (x[i][pick[0]] <= pick[1]) == side], left - 1)

        grow(list(range(n)), depth)
    return out


def test_trees_equal_a_plain_search(spark):
    rng = random.Random(5)
    x = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(160)]
    y = [float(a[0] + a[1] * a[2] + rng.gauss(0, 0.5) > 0.6) for a in x]
    rows = spark.createDataFrame([(i, *a, b) for i, (a, b) in enumerate(zip(x, y))], "i int, a double, b double, c double, y double")
    for balanced in (False, True):
        model = fit_trees(rows, ("a", "b", "c"), trees=3, depth=3, bins=8, balanced=balanced)
        got = [r.m for r in rows.select("i", model.margin().alias("m")).orderBy("i").collect()]
        want = margins(x, y, 3, 3, 0.4, 8, 1.0, 5.0, balanced)
        assert max(abs(a - b) for a, b in zip(got, want)) < 1e-6
