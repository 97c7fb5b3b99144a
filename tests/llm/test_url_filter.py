import datetime as dt
import random

from vecframe.llm.url_filter import entry_frame, url_filter

SCHEMA = "page_id long, url string, fetched timestamp_ntz, key string, action string"


def keys(url):
    """Keys from the most specific on, or none."""
    if "://" not in (url or ""):
        return None, []
    rest = url.strip().split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c)[0]
    authority, _, path = rest.partition("/")
    host = authority.split("@")[-1].lower()
    if ":" in host and host.rsplit(":", 1)[1].isdigit() or host.endswith(":"):
        host = host.rsplit(":", 1)[0]
    host = host.rstrip(".")
    if not host:
        return None, []
    dirs = [d for d in path.split("/")[:-1] if d]
    labels = host.split(".")
    few = lambda n: range(n, 0, -1) if n < 5000 else [n, n // 2, *range(500, 0, -1)]  # noqa: E731  the others are not in the list
    return host, [host + "/" + "/".join(dirs[:i]) + "/" for i in few(len(dirs))] + [".".join(labels[i:]) for i in range(len(labels))]


def brute(rows, entries):
    out = []
    for i, url, t in rows:
        host, ks = keys(url)
        hit = None
        for k in ks:
            past = [(d, {"allow": 1, "block": 2, "remove": 3}[a], a) for key, d, a in entries if key.lower() == k and t is not None and dt.datetime.fromisoformat(d) <= t]
            if past and max(past)[2] != "remove":
                hit = (max(past)[2], k)
                break
        out.append((i, host, *(hit or (None, None)), hit is not None and hit[0] == "block"))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(4)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "B.org", "b.org.", "c.net:80", "u:p@c.net", "d.io"]
    paths = ["", "/", "/p", "/p/", "/p/q/r.html", "/p//q/?x=/z/", "/s#/p/"]
    rows = [(i, f"http://{r.choice(hosts)}{r.choice(paths)}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.randrange(24 * 60))) for i in range(400)]
    rows += [(900, None, dt.datetime(2024, 1, 2)), (901, "", dt.datetime(2024, 1, 2)), (902, "nonsense", dt.datetime(2024, 1, 2)), (903, "http://a.com/", None), (None, "http://a.com/p/", dt.datetime(2024, 2, 1)), (5, rows[5][1], rows[5][2]), (904, "http:///p/", dt.datetime(2024, 1, 2)), (905, "http://a.com/" + "p/" * 300, dt.datetime(2024, 2, 2))]
    deep = "p/" * 300_000  # a URL of 600 KB, and keys of the list as deep as it and half as deep
    rows += [(906, f"http://a.com/{deep}x", dt.datetime(2024, 2, 2)), (907, "http://" + "s." * 3000 + "a.com/", dt.datetime(2024, 2, 2))]
    names = ["a.com", "x.a.com", "com", "b.org", "c.net", "a.com/p/", "a.com/p/q/", "x.a.com/p/", "B.ORG/p/", "d.io"]
    entries = [(r.choice(names), (dt.date(2024, 1, 1) + dt.timedelta(days=r.randrange(60))).isoformat(), r.choice(["block", "allow", "remove"])) for _ in range(60)]
    entries += [(f"a.com/{deep}", "2024-01-05", "allow"), (f"a.com/{deep[:300_000]}", "2024-01-05", "block")]
    got = url_filter(spark.createDataFrame([(*x, "k", "a") for x in rows], SCHEMA).repartition(3), entry_frame(spark, entries)).collect()
    assert sorted(((x.page_id, x.host, x.action, x.matched_key, x.blocked) for x in got), key=repr) == brute(rows, entries)


def test_empty(spark):
    none = entry_frame(spark, [])
    rows = spark.createDataFrame([(1, "http://a.com/", dt.datetime(2024, 1, 1), "", "")], SCHEMA)
    assert [x.blocked for x in url_filter(rows, none).collect()] == [False]
    assert url_filter(rows.limit(0), entry_frame(spark, [("a.com", "2024-01-01", "block")])).count() == 0
