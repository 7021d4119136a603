import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.llm import urls
from lodestone.llm.urls import filter_urls, host_of, url_key

T0 = datetime(2024, 1, 1)


def test_hosts(spark):
    rows = ["http://User@A.Example.com.:80/x/?q#f", "https://b.org", "ftp+x://c/", "nothing", "", None, "http:///x"]
    got = spark.createDataFrame([(u,) for u in rows], "u string").select(host_of(F.col("u")).alias("h"), url_key(F.col("u")).alias("k")).collect()
    assert [r.h for r in got] == ["a.example.com", "b.org", "c", None, None, None, None]
    assert [r.k for r in got][:3] == ["a.example.com/x", "b.org", "c"]


def brute(captures, events):
    spans = []
    for key in {(e[0], e[1], e[2]) for e in events if e[1] and e[4]}:
        on = None
        for _, _, _, what, at in sorted((e for e in events if e[:3] == key and e[4]), key=lambda e: (e[4], e[3] != "remove")):
            if what == "add" and on is None:
                on = at
            elif what == "remove" and on is not None:
                spans += [(*key, on, at)] * (on < at)
                on = None
        if on is not None:
            spans.append((*key, on, datetime.max))
    out = []
    for page, url, t in captures:
        host = url.split("//")[1].split("/")[0] if url and "//" in url else None
        path = url.split("//")[1].split("?")[0].rstrip("/") if host else None
        held = [s for s in spans if t and host and s[3] <= t < s[4] and (s[1] == path if s[0] == "url" else host == s[1] or host.endswith("." + s[1]))]
        best = max(held, key=lambda s: (s[0] == "url", len(s[1]), s[2] == "allow", s[1]), default=None)
        out.append((page, best[2] if best else "allow", best[1] if best else None))
    return sorted(out, key=str)


def test_as_of_equals_brute_force(spark):
    random.seed(7)
    hosts = ["a.example.com", "b.example.com", "example.com", "hot.net", "x.hot.net"]
    day = lambda n: T0 + timedelta(days=n)
    events = [(k, r, a, random.choice(["add", "add", "remove"]), day(random.randrange(500))) for k, r in [("domain", h) for h in [*hosts, "com"]] + [("url", "hot.net/p")] for a in ("allow", "block") for _ in range(5)]
    events += [("domain", None, "block", "add", day(1)), ("domain", "hot.net", "block", "add", None), events[0]]
    captures = [(i, f"http://{random.choice(hosts[3:]) if i % 3 else random.choice(hosts)}/{random.choice(['p', 'q?x=1', ''])}", day(random.randrange(520))) for i in range(400)]
    captures += [(900, None, day(3)), (901, "junk", day(3)), (902, "http://hot.net/p", None), captures[0], (None, "http://hot.net/", day(10))]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumn("rule", F.lit("clash"))
    e = spark.createDataFrame(events, "kind string, rule string, action string, event string, at timestamp")
    got = sorted(((r.page_id, r.verdict, r.rule) for r in filter_urls(c, e).collect()), key=str)
    assert got == brute(captures, events)
    plain = urls.as_of
    with pytest.MonkeyPatch.context() as patch:  # every (key, month) of more than four captures is salted
        patch.setattr(urls, "as_of", lambda *a: plain(*a, hot_share=0.01))
        assert sorted(((r.page_id, r.verdict, r.rule) for r in filter_urls(c, e).collect()), key=str) == got
    assert filter_urls(c.limit(0), e).count() == 0
    assert {r.verdict for r in filter_urls(c, e.limit(0)).collect()} == {"allow"}
