"""URL filter: hosts, paths and rules against plain Python; the models against dictionaries."""

import numpy as np
import pytest

from uqframe.llm import url_filter as uf

URLS = ["http://example.com/en/7", "http://a.EXAMPLE.com/en/77?x#y", "https://example.com/en/8", "http://com/en/", "http://xcom/en/1", "http://shop.net/de/8", "http://example.net/de/8", "http://a.example.net/de/80", "http://notexample.net/de/8",
        "http://b.org/es/1", "http://b.org/es", "http://b.org?/es/", "no scheme", "", None, "x://", "x:///path", "x://HOST#f/en/", "a://b://c/d", "http://ÄÖ.org/es/é", "http://h\n.org/es/\nx", "HTTP://Q.COM/en/" + "z" * 5000]


def plain(url):
    rest = (url or "").partition("://")[2]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    path = rest[cut:].split("?")[0].split("#")[0]
    rule, verdict = max(((r, v) for r, v in uf.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])), key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


def test_hosts_paths_and_rules(spark, sf_dir):
    rows = list(enumerate(URLS)) + [(r.page_id + 1000, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()] + [(0, URLS[0])]
    got = uf.judge(spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id bigint, url string, host string, m string")).collect()
    assert len(got) == len(rows)
    url = dict(rows)
    for r in got:
        host, path, rule, verdict = plain(url[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_the_longest_rule_wins_of_any_order(spark):
    df = spark.createDataFrame([("a.b.com", "/x/y")], "host string, path string")
    rules = (("com/", "block"), ("b.com/x", "allow"), ("a.b.com/x/y", "block"), ("c.com/", "allow"))
    for some in (rules, rules[::-1]):
        assert df.select(uf.matching_rule(df.host, df.path, some).alias("m")).head().m.rule == "a.b.com/x/y"


def unhashed(urls, labels):
    """Score function of two variable-order models kept in dictionaries."""
    n = [{}, {}]
    for u, good in zip(urls, labels):
        b = b"\0" * uf.ORDER + u.encode()
        for i in range(uf.ORDER, len(b)):
            for o in range(uf.ORDER + 1):
                after = n[good].setdefault(b[i - o : i], {})
                after[b[i]] = after.get(b[i], 0) + 1

    def score(u):
        b, out = b"\0" * uf.ORDER + u.encode(), [0.0, 0.0]
        for c in (0, 1):
            for i in range(uf.ORDER, len(b)):
                p = 1 / 256
                for o in range(uf.ORDER + 1):
                    after = n[c].get(b[i - o : i])
                    if after:
                        p = (after.get(b[i], 0) + len(after) * p) / (sum(after.values()) + len(after))
                out[c] += np.log(p)
        return (out[1] - out[0]) / max(len(u.encode()), 1)

    return score


def labelled_urls():
    rng = np.random.default_rng(1)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    return [(f"http://{word('abcdef')}.org/{word('abc')}", 1) for _ in range(60)] + [(f"http://{word('uvwxyz')}.biz/{word('123')}", 0) for _ in range(60)]


def scores_of(spark, rows, urls, head=uf.HEAD):
    """Score of each of ``urls`` by models of ``rows`` (url, good)."""
    seen = [(None, *r) for r in rows] + [(i, u, None) for i, u in enumerate(urls)]
    df = spark.createDataFrame(seen, "id int, url string, good int")
    ratios = uf.log_ratios(uf.gather(df))
    return {r.id: r.score for r in uf.scored(df, ratios, head=head).where("id is not null").collect()}


@pytest.mark.parametrize("head", [uf.HEAD, 40, 1])
def test_scores_equal_models_kept_in_dictionaries(spark, head, monkeypatch):
    monkeypatch.setattr(uf, "PORTION", 50)
    rows = labelled_urls()
    urls = [*(u for u, _ in rows), "http://new.org/", "é\x00", "x", "", None, "http://new.org/", "http://" + "ab" * 3000]
    got, score = scores_of(spark, rows, urls, head), unhashed(*zip(*rows))
    for i, u in enumerate(urls):
        assert got[i] == pytest.approx(score(u or ""), abs=1e-9)


def test_one_class_or_none(spark):
    rows = [(u, g) for u, g in labelled_urls() if g]
    score = unhashed(*zip(*rows))
    assert scores_of(spark, rows, ["http://a.org/b"])[0] == pytest.approx(score("http://a.org/b"), abs=1e-9)
    assert scores_of(spark, [], ["http://a.org/b"])[0] == 0.0


def test_the_fit_tells_labels_apart(spark):
    rows = labelled_urls()
    got, score = scores_of(spark, rows, [u for u, _ in rows]), unhashed(*zip(*rows))
    t = uf.threshold_of(spark.createDataFrame([(g, got[i]) for i, (_, g) in enumerate(rows)], "good int, score double"))
    for i, (u, good) in enumerate(rows):
        assert (got[i] >= t) == bool(good) == (score(u) >= 0)


def test_verdicts_without_a_rule_equal_brute_force(spark, sf_dir):
    """Every page of the table: the query's scores and verdicts against dictionaries and a threshold tried at every bin edge."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    held = {r.page_id for r in pages.where(f"pmod(xxhash64(url), {uf.CALIBRATION_SHARE}) = 0").collect()}
    url = {r.page_id: r.url for r in pages.collect()}
    rule = {i: plain(u)[3] for i, u in url.items()}
    teach = [(url[i], int(v == "allow")) for i, v in rule.items() if v and i not in held]
    score = unhashed(*zip(*teach))
    got = {r.page_id: r for r in uf.judge(pages, head=200).collect()}
    own = {i: score(u) for i, u in url.items()}
    for i in url:
        assert got[i].score == pytest.approx(own[i], abs=1e-9)
    tried = [(own[i], rule[i] == "allow") for i in held if rule[i]]
    edges = [k * 2 * uf.LIMIT / uf.BINS - uf.LIMIT for k in range(uf.BINS + 1)]
    good, bad = max(sum(a for _, a in tried), 1), max(sum(not a for _, a in tried), 1)
    right = lambda t: sum(a for s, a in tried if s >= t) / good + sum(not a for s, a in tried if s < t) / bad
    top = max(map(right, edges))
    t = min((e for e in edges if right(e) > top - 1e-9), key=abs) if {a for _, a in tried} == {True, False} else 0.0
    for i, r in got.items():
        if rule[i] is None and abs(own[i] - t) > 1e-6:
            assert r.verdict == ("allow" if own[i] >= t else "block")


def test_calibration_takes_the_best_balanced_accuracy():
    per = np.zeros((2, uf.BINS + 1))
    per[0, 800], per[0, 1100], per[1, 1050], per[1, 1300] = 90, 10, 5, 95
    t = uf.best_threshold(per)
    bin_ = round((t + uf.LIMIT) / (2 * uf.LIMIT) * uf.BINS)
    assert 800 < bin_ <= 1050 or 1100 < bin_ <= 1300
    assert uf.best_threshold(np.zeros((2, uf.BINS + 1))) == 0.0


def test_without_labels_and_empty(spark):
    assert uf.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    got = uf.judge(spark.createDataFrame([(1, "http://q/z"), (None, None)], "page_id bigint, url string")).collect()
    assert [r.verdict for r in got] == ["allow", "allow"]
    with pytest.raises(ValueError):
        uf.matching_rule(None, None, (("a/", "allow"),) * (uf.MOST_RULES + 1))
