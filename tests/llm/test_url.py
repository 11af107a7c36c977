"""Host reputation: rules and hosts by brute force, the whole by SQL."""

import random
import re

import duckdb

from tessera.llm import url_reputation
from tessera.llm.queries import op6_url_reputation

SF = "/root/testdata/sf0.01"


def _rule(host, path):
    fits = [(h + p, a) for a, h, p in url_reputation.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_hosts_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://A.B.Example.NET/en/1?x=/y#z", "https://example.net", "x://net/", "x://internet/", "a://b.example.com/de/2", "a://b.example.com/DE/2", "a://É.ORG/fr/", "a://org?/fr/", "a://h#://q/", "://host/p", "a://u:1@h.org:80/fr/3",
        "a://x.example.net\n/en/", "a://bad.test/1", "a://bad.test/1", "a://bad.test/2", "a://good.test/3", "a://sub.bad.test/999",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (2, 1, 0), (3, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in url_reputation.url_verdicts(spark, pages, labels).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        rule, action = _rule(host, path)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict == action if action else rows[i].verdict in ("allow", "block")
    assert rows[15].host_labels == 2 and rows[15].host_bad == 2 and rows[18].host_bad == 0
    assert rows[15].lower_bad > rows[19].lower_bad >= rows[18].lower_bad  # a host without labels follows its domain
    assert url_reputation.url_verdicts(spark, pages.where("false"), labels).count() == 0
    assert url_reputation.url_verdicts(spark, pages, labels.where("false")).count() == len(urls)


def test_a_bad_host_is_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'fine'}{i % 8}.example.{'edu' if i % 8 < 4 else 'info'}/x/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    for r in url_reputation.url_verdicts(spark, pages, labels).collect():
        assert r.verdict == ("block" if r.host.startswith("spam") else "allow")


def _verdicts(urls, bad):
    """Lower bounds by host in plain Python: counts, strengths level by level, rates from the top down."""
    counts = {}
    for u in urls:
        m = re.match(r".*?://([^/?#]*)[^?#]*?/(\d{1,18})", u)
        host = u.split("://")[1].split("/")[0].lower()
        c = counts.setdefault(host, [0, 0])
        if m and int(m[2]) in bad:
            c[0] += 1
            c[1] += bad[int(m[2])]

    def parts(host):
        name = re.sub(r":\d*$", "", host)
        labels = name.split(".")
        if re.fullmatch(r"[\d.]+", name):
            return name, ""
        two = len(labels) > 1 and labels[-2] in url_reputation.SECOND and re.fullmatch("[a-z]{2}", labels[-1])
        n = 2 if two else 1
        return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])

    levels = [{h: tuple(c) for h, c in counts.items()}, {}, {}, {}]
    up = [{h: parts(h) for h in counts}, {}, {}]
    for h, (n, b) in levels[0].items():
        d = parts(h)
        up[1][d], up[2][d[1]] = d[1], "all"
        for level, key in ((1, d), (2, d[1]), (3, "all")):
            old = levels[level].get(key, (0, 0))
            levels[level][key] = (old[0] + n, old[1] + b)

    def strength(child, parent, above):
        rows = [(n, b, parent[above[k]]) for k, (n, b) in child.items() if n]
        groups = [(n, b) for n, b in parent.values() if n]
        n, b, k, g = sum(r[0] for r in rows), sum(r[1] for r in rows), len(rows), len(groups)
        s2, q2, p2 = sum(r[1] ** 2 / r[0] for r in rows), sum(r[0] ** 2 / r[2][0] for r in rows), sum(x[1] ** 2 / x[0] for x in groups)
        low, high = url_reputation.STRENGTHS
        if k <= g or n <= k:
            return low
        between, within, n0 = (s2 - p2) / (k - g), (b - s2) / (n - k), (n - q2) / (k - g)
        return max(low, min(high, n)) if between <= within else max(low, min(high, (between + (n0 - 1) * within) / (between - within) - 1))

    strengths = [strength(levels[i], levels[i + 1], up[i]) for i in range(3)]
    told = [levels[0], {}, {}, {}]
    for level in range(3):
        m = strengths[level]
        for k, (n, b) in told[level].items():
            old = told[level + 1].get(up[level][k], (0, 0))
            told[level + 1][up[level][k]] = (old[0] + n * (1 + m) / (n + m), old[1] + b * (1 + m) / (n + m))
    rate = {"all": (told[3]["all"][1] + 1) / (told[3]["all"][0] + 2)}
    for level in (2, 1, 0):
        m = strengths[level]
        rate = {k: (b + m * rate[up[level][k]]) / (n + m) for k, (n, b) in told[level].items()}
    return {h: max(0.0, r - url_reputation.DEVIATIONS * (r * (1 - r) / (m + levels[0][h][0] + 1)) ** 0.5) for h, r in rate.items()}


def test_bounds_by_brute_force(spark):
    rng = random.Random(8)
    hosts = [f"{a}.{b}" for b in ("good.co.uk", "bad.co.uk", "x.com", "y.com", "co.uk", "disco.uk", "z.org.au", "10.0.0.1:80", "10.0.0.2") for a in ("a", "b", "c")] + ["10.0.0.1:80", "10.0.0.2", "localhost", "co.uk"]
    share = {h: rng.random() * (2 if "bad" in h else 0.5) for h in hosts}
    urls, bad = [], {}
    for i in range(900):
        h = rng.choice(hosts)
        urls.append(f"http://{h.upper() if i % 3 else h}/p/{i}")
        if i % 2:
            bad[i] = int(rng.random() < share[h])
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, b) for i, b in bad.items()], "doc_id int, quality int, toxic int")
    want = _verdicts(urls, bad)
    rows = url_reputation.url_verdicts(spark, pages, labels).collect()
    assert len(rows) == 900 and any(r.verdict == "block" for r in rows)
    for r in rows:
        assert abs(r.lower_bad - want[r.host]) < 2e-6, r.host
        if r.rule is None:
            assert r.verdict == ("block" if r.lower_bad > url_reputation.BAD_RATE else "allow")


def test_numbers_of_documents(spark):
    """The last segment, whole; each document once for a host."""
    urls = [f"http://dated.com/2024/01/post-{i}" for i in range(40)] + [f"http://same.com/7?page={i}" for i in range(40)]
    urls += ["http://long.com/12345678901234567890", "http://short.com/123456789012345678", "http://a.com/x/5", "http://a.com/5.html", "http://a.com/5/", "http://b.com/5/x", "http://b.com/5a", "http://b.com?/5"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(2024, 0, 1), (7, 0, 1), (123456789012345678, 0, 1), (5, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    rows = url_reputation.url_verdicts(spark, pages, labels).collect()
    assert {r.host: (r.host_labels, r.host_bad) for r in rows} == {"dated.com": (0, 0), "same.com": (1, 1), "long.com": (0, 0), "short.com": (1, 1), "a.com": (1, 0), "b.com": (0, 0)}


def test_neighbours_under_a_suffix_do_not_answer_for_each_other(spark):
    pages = spark.createDataFrame([(i, f"http://bad.co.uk/{i}") for i in range(50)] + [(99, "http://good.co.uk/x")] + [(200 + i, f"http://x.com/{200 + i}") for i in range(50)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 1) for i in range(50)] + [(200 + i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    verdict = {r.host: r.verdict for r in url_reputation.url_verdicts(spark, pages, labels).collect()}
    assert verdict["bad.co.uk"] == "block" and verdict["good.co.uk"] == "allow"


def test_sql_and_plan(spark):
    frame = op6_url_reputation(spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(url_reputation.verdict_sql("pages", "labels"))
    columns = [d[0] for d in result.description]
    expected = sorted(result.fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr) == expected
