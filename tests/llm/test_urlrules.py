"""Mined rules decide urls that no stated rule fits."""

import random
import time
from collections import Counter
from itertools import combinations

import pytest

from loomline.llm import urlrules


def test_mined_rules_decide_unruled_urls(spark):
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "org", "/es/")]
    urls = [f"http://m.casino.example.com/en/{1 + i % 6}{i}" for i in range(18)] + ["http://m.casino.example.com/en/71", "http://m.casino.example.com/en/72"]
    urls += [f"http://shop{i % 40}.example.org/es/{i}" for i in range(40)]  # every labelled url of org is blocked, but few are labelled
    unruled = [f"http://m.casino.example.com/fr/{1 + i % 6}" for i in range(8)]
    other = [f"http://shop{i % 40}.example.org/en/{i}" for i in range(120)] + [f"http://site{i}.example.com/fr/{i}" for i in range(120)] + [f"http://site.example.net/fr/{i}" for i in range(20)]
    df = spark.createDataFrame(list(enumerate(urls + unruled + other)), "page_id long, url string")
    got = {r.page_id: r for r in urlrules.judge(df, rules).collect()}
    assert len(got) == len(urls + unruled + other)
    lo, hi = len(urls), len(urls) + len(unruled)
    assert {got[i].verdict for i in range(lo, hi)} == {"block"} and all(got[i].rule is None for i in range(lo, hi))
    assert {got[i].verdict for i in range(hi, len(got))} == {"allow"}


def test_without_mined_rules_the_verdicts_differ(spark, monkeypatch):
    """Sites of both verdicts are mined: taken away, the urls that they decide fall to the default."""
    rules = [("block", "com", "/en/"), ("allow", "net", "/de/")]
    urls = [f"http://bad.example.com/en/{i}" for i in range(12)] + [f"http://good.example.net/de/{i}" for i in range(12)]
    urls += [f"http://bad.example.com/fr/{i}" for i in range(5)] + [f"http://good.example.net/fr/{i}" for i in range(5)] + [f"http://other{i}.example.org/fr/{i}" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    verdicts = lambda **k: [r.verdict for r in sorted(urlrules.judge(df, rules, **k).collect())]
    mined = verdicts(default="allow")
    assert mined[24:] == ["block"] * 5 + ["allow"] * 35 and verdicts(default="block")[24:] == ["block"] * 5 + ["allow"] * 5 + ["block"] * 30
    monkeypatch.setattr(urlrules, "mine", lambda *a, **k: [])
    assert verdicts(default="allow")[24:] == ["allow"] * 40 and verdicts(default="block")[24:] == ["block"] * 40


def test_rules_of_a_site_recover_verdicts_held_out(spark):
    """Half of a site's labels are taken away: the mined rules give them back."""
    items = [[f"host:s{i % 5}.com", "host:com", f"path:{i}"] for i in range(200)]
    truth = ["block" if i % 5 < 2 else "allow" for i in range(200)]
    rows = spark.createDataFrame([(t, v) for i, (t, v) in enumerate(zip(items, truth)) if i % 10 < 5], "items array<string>, label string")
    decide = urlrules.matcher(urlrules.mine(rows, general=frozenset(["host:com"])), "none")
    assert [decide(t) for t in items] == truth


def test_long_urls_that_are_frequent_are_mined_in_time(spark):
    """One url of 200 segments fills a third of the labelled rows; hosts of many labels and long urls pass too."""
    rules = [("block", "com", "/en/"), ("allow", "net", "/de/")]
    long = "http://hot.example.com/en/" + "/".join(f"s{i}" for i in range(200))
    urls = [long] * 100 + [f"http://x{i % 9}.example.net/de/{i}" for i in range(200)] + ["http://" + "a." * 5000 + "com/en/", "http://h.com/" + "p/" * 20000, None, "", "no scheme"] + ["http://hot.example.com/fr"]
    start = time.perf_counter()
    got = sorted(urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect())
    assert time.perf_counter() - start < 60
    assert len(got) == len(urls) and got[-1].verdict == "block" and got[-1].rule is None


def brute_rules(items, labels, support, confidence, general):
    """All combinations of at most three tokens, counted one by one."""
    stats = {}
    for own, v in zip(items, labels):
        for n in (1, 2, 3):
            for c in combinations(sorted(own), n):
                stats.setdefault(frozenset(c), Counter())[v] += 1
    least = {v: max(3, -(-labels.count(v) * support // 1)) for v in ("block", "allow")}
    good = {s for s, n in stats.items() if any(n[v] >= least[v] for v in least) and 2 * (n["block"] + n["allow"]) >= n.total()}
    site = lambda s: general is None or any(t.startswith("host:") and t not in general and frozenset([t]) in good for t in s)
    out = {}
    for s in sorted(good, key=len):
        for v in ("block", "allow"):
            share = stats[s][v] / (stats[s]["block"] + stats[s]["allow"])
            if site(s) and share >= confidence and not any(out.get((f, v), 0) >= share for n in range(1, len(s)) for f in map(frozenset, combinations(s, n))):
                out[s, v] = share
    return [(s, v, c) for (s, v), c in out.items()]


@pytest.mark.parametrize("general", [frozenset(["host:com"]), None])
@pytest.mark.parametrize("width", [3, 8, 30])
def test_rules_of_long_rows_equal_brute_force(spark, general, width):
    """Rows of 3 to 17 tokens, some in the same rows: a rule for the same rows for each of brute force, and no other."""
    rng = random.Random(5)
    items, labels = [], []
    for i in range(160):
        host = rng.randrange(6)
        own = {"host:com", f"host:s{host}.com", f"host:{'m' if i % 3 else 'n'}.s{host}.com"} | {f"path:{rng.randrange(22)}" for _ in range(rng.choice((0, 2, 4, 16)))}
        own |= {f"path:{x}{'same' * n}" for x in "ab" if i % 7 == 0 for n in range(6)}
        wanted = "block" if host < 2 or {"path:3", "path:5"} <= own or host == 2 and "path:7" in own else "allow"
        items.append(sorted(own, key=lambda t: rng.random()))
        labels.append(rng.choice((wanted, wanted, wanted, wanted, "allow", None)))
    rows = spark.createDataFrame(list(zip(items, labels)), "items array<string>, label string").repartition(3)
    fits = lambda rules: {(tuple(i for i, own in enumerate(items) if s <= set(own)), v, round(c, 9)) for s, v, c in rules}
    got, want = urlrules.mine(rows, 0.03, 0.8, general=general, width=width), brute_rules(items, labels, 0.03, 0.8, general)
    assert fits(got) == fits(want) and any(len(s) == 3 for s, _, _ in got)
    decide, brute = urlrules.matcher(got, "none"), urlrules.matcher(want, "none")
    assert [decide(t) for t in items] == [brute(t) for t in items]


def test_the_pair_that_decides_may_be_of_the_least_telling_tokens(spark):
    """Ten tokens of each blocked url tell more than the one that decides with its site."""
    rules = [("block", "com", "/en/"), ("allow", "com", "/de/")]
    more = "/".join(f"{x}x" for x in "abcdefghij")
    urls = [f"http://s.com/en/z/{more}/{i}" for i in range(6)] + [f"http://s.com/de/{i}" for i in range(12)]
    urls += [f"http://t{i}.com/en/{more}/{i}" for i in range(60)] + [f"http://t{i}.com/de/z" for i in range(60)]
    urls += [f"http://s.com/fr/z/{i}" for i in range(3)] + [f"http://s.com/fr/{i}" for i in range(3)]
    got = sorted(urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, support=0.02).collect())
    assert [r.verdict for r in got[-6:]] == ["block"] * 3 + ["allow"] * 3


def test_every_frequent_site_is_mined(spark):
    urls = [f"http://s{i}.org/{p}" for i in range(4300) for p in ("es/1", "es/2", "es/3", "fr")]
    got = urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), [("block", "org", "/es/")], support=0.0002).collect()
    assert len(got) == len(urls) and {r.verdict for r in got} == {"block"}


def test_hosts_that_differ_beyond_127_labels_are_told_apart(spark):
    rules = [("block", "com", "/en/"), ("allow", "com", "/de/")]
    tail = "x." * 150 + "com"
    urls = [f"http://bad.{tail}/en/{i}" for i in range(6)] + [f"http://good.{tail}/de/{i}" for i in range(6)] + [f"http://{h}.{tail}/fr" for h in ("bad", "good")]
    got = sorted(urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect())
    assert [r.verdict for r in got[-2:]] == ["block", "allow"]


def test_copies_of_a_long_url_grow_no_further(spark):
    """A url of 200 segments, all of which other sites have too, among urls of its site that lack them."""
    rules = [("block", "com", "/en/"), ("allow", "net", "/de/")]
    long = "http://hot.example.com/en/" + "/".join(f"s{i}" for i in range(200))
    urls = [long] * 100 + [f"http://hot.example.com/en/{i}" for i in range(20)] + [f"http://x{i % 9}.example.net/de/s{i}" for i in range(200)] + ["http://hot.example.com/fr"]
    start = time.perf_counter()
    got = sorted(urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect())
    assert time.perf_counter() - start < 60
    assert len(got) == len(urls) and got[-1].verdict == "block" and got[-1].rule is None
