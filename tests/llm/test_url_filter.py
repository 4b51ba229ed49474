import random
from urllib.parse import urlsplit

from dunlin.llm import url_filter as U
from dunlin.llm.url_filter import RULES

URLS = {1: "https://A.Example.ORG/es/1?x#y", 2: "http://example.org/en/12", 3: "http://xexample.org/es/", 4: "ftp://b.com/fr/x", 5: "http://com/de/", 6: "http://b.com/de", 7: None, 8: "no url",
        9: "http://shop.net", 10: "http://shop.net?u=http://c.com/de/", 11: "x://É.org/é\n/z", 12: "http://b.com:80/de/", 13: "://org/", 14: "http://example.org.evil.com/fr/a", 15: "http://example.org/en/2"}


def brute(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in RULES
            for h, p in [(r[: r.index("/")], r[r.index("/"):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def pages(spark, urls, repeat=()):
    rows = [(i, u, "h", "x", 1.0) for i, u in [*urls.items(), *((i, urls[i]) for i in repeat)]]
    return spark.createDataFrame(rows, "page_id long, url string, host string, template string, purity double").repartition(3)


def test_hosts_paths_and_rules(spark):
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = U.judge(pages(spark, URLS, repeat=(1, 7)), none).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), URLS[r.page_id]
    assert urlsplit(URLS[1]).hostname == "a.example.org"
    assert U.judge(pages(spark, URLS).limit(0), none).count() == 0


def test_impure_templates_go_and_like_siblings_merge(spark):
    urls, bad = {}, {}
    for k in range(240):
        kind = ("casino", "news", "blog", "deals")[k % 4]
        urls[k] = f"http://shop.net/{kind}/{k}.html"
        if k % 2 or k % 3 == 0:
            bad[k] = kind in ("casino", "deals") and k % 24 != 3
    for k in range(300, 330):
        urls[k] = f"http://other.net/{'x' * (k % 7 + 1)}/{k}"
        bad[k] = k % 9 == 0
    labels = spark.createDataFrame([(None, True), (5, None), *bad.items(), *list(bad.items())[:5]], "page_id long, bad boolean")
    got = {r.page_id: r for r in U.judge(pages(spark, urls), labels).collect()}
    for k in range(240):
        kind = ("casino", "news", "blog", "deals")[k % 4]
        assert (got[k].verdict == "block") == (kind in ("casino", "deals")), got[k]
        assert got[k].template.endswith("{n}.html")
    assert {got[k].template for k in range(300, 330)} == {"/*/{n}"} and all(got[k].verdict == "allow" for k in range(300, 330))


def test_shapes(spark):
    df = spark.createDataFrame([("/a/12/x9y/deadbeef00/q/r/s",), ("",), ("//a//",), ("/p/7.html",)], "path string")
    got = [r[0] for r in df.select(U.shape(df["path"])).collect()]
    assert got == [["a", "{n}", "{v}", "{h}", "**"], [], ["a"], ["p", "{n}.html"]]


def test_labels_of_pages(spark):
    y = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 1, 0), (4, None, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert {r.page_id: r.bad for r in U.page_labels(y).collect()} == {1: True, 2: True, 3: False, 5: True}


def test_sections_below_the_fourth_segment_stay_apart(spark):
    urls = {k: f"http://deep.net/en/site/blog/posts/all/{('casino', 'news')[k % 2]}/{k}" for k in range(80)}
    labels = spark.createDataFrame([(k, k % 2 == 0) for k in range(0, 60)], "page_id long, bad boolean")
    got = {r.page_id: (r.verdict, r.template) for r in U.judge(pages(spark, urls), labels).collect()}
    assert got == {k: (("block", "allow")[k % 2], f"/en/site/blog/posts/all/{('casino', 'news')[k % 2]}/{{n}}") for k in urls}


def tree(rows):
    """(host, shape) -> template, level by level as far as any path goes; rows are (host, shape, labelled, bad)."""
    at = {(h, s): "" for h, s, _, _ in rows}
    for level in range(max(len(s) for _, s, _, _ in rows)):
        groups = {}
        for h, s, m, b in rows:
            if len(s) > level:
                groups.setdefault((h, at[h, s]), []).append((s, m, b))
        step = {}
        for (h, _), own in groups.items():
            every_m, every_b, kinds = sum(m for _, m, _ in own), sum(b for _, _, b in own), {s[level] for s, _, _ in own}
            for kind in kinds:
                m, b = (sum(x[k] for x in own if x[0][level] == kind) for k in (1, 2))
                rm, rb, p = every_m - m, every_b - b, (every_b + 0.5) / (every_m + 1)
                apart = m >= U.LEAST_LABELLED and rm > 0 and abs(b / m - rb / rm) >= U.Z * (p * (1 - p) * (1 / m + 1 / rm)) ** 0.5
                for s, _, _ in own:
                    if s[level] == kind:
                        step[h, s] = "/" + (kind if apart or len(kinds) == 1 else "*")
        for k, v in step.items():
            at[k] += v
    return at


def test_template_tree_against_every_level(spark):
    rnd = random.Random(6)
    rows, seen = [], set()
    for _ in range(500):
        h = rnd.choice("hhhg") + ".net"
        s = tuple(rnd.choice(("a", "b", "c", "x{n}")[: rnd.randrange(1, 5)]) for _ in range(rnd.randrange(0, 7)))
        if (h, s) not in seen:
            seen.add((h, s))
            m = rnd.randrange(0, 14)
            rows.append((h, s, m, min(m, rnd.randrange(0, m + 1) if len(s) % 2 else (m if "b" in s else 0))))
    df = spark.createDataFrame([(h, list(s), 1, m, b) for h, s, m, b in rows], "host string, shape array<string>, n long, m long, b long").repartition(3)
    got = {(r.host, tuple(r["shape"])): r.template for r in U.templates(df, 0.3).collect()}
    assert got == tree(rows)
    assert len(set(got.values())) > 8


def test_a_very_long_path_adds_no_rounds(spark, monkeypatch):
    urls = {k: f"http://deep.net/{('casino', 'news')[k % 2]}/{k}" for k in range(60)} | {1000: "http://deep.net/casino/" + "/".join("ab" for _ in range(1000)),
                                                                                  1001: "http://trap.net/" + "/".join(f"x{k}" for k in range(1500))}
    labels = spark.createDataFrame([(k, k % 2 == 0) for k in urls], "page_id long, bad boolean")
    written, of = [], U.stored
    monkeypatch.setattr(U, "stored", lambda df, folder=None: written.append(folder) or of(df, folder))
    got = {r.page_id: r for r in U.judge(pages(spark, urls), labels).collect()}
    assert len(written) < 10
    assert got[0].verdict == "block" and got[1].verdict == "allow" and got[1001].template.count("/") == 1500
