import datetime as dt

from fragmill.llm import urlfilter

DAY = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_as_of_join_matches_a_replay_of_the_log(spark):
    log = [("bad.org", "spam", "add", DAY(3)), ("bad.org", "spam", "add", DAY(5)), ("bad.org", "spam", "remove", DAY(9)), ("bad.org", "spam", "add", DAY(9)), ("Bad.org", "spam", "add", DAY(20)), ("x.bad.org", "adult", "add", DAY(1)), ("x.bad.org", "adult", "remove", DAY(30)), ("ok.bad.org", "allow", "add", DAY(0)), (None, "spam", "add", DAY(0)), ("y.net", None, "add", DAY(0)), ("z.net", "spam", "remove", DAY(1))]
    urls = ["http://bad.org/a", "https://u:p@X.BAD.org:81/q?x", "http://ok.bad.org", "http://notbad.org/", "nonsense", None, "http://z.net/", "ftp://bad.org./x"]
    captures = [(k * 100 + d, u, DAY(d) if d < 40 else None, "kept") for k, u in enumerate(urls) for d in (0, 1, 3, 8, 9, 15, 20, 30, 40)]
    captures += captures[:3]
    got = urlfilter.screen(spark.createDataFrame(captures, "id long, url string, fetched_on date, pattern string"), spark.createDataFrame(log, "pattern string, category string, action string, listed_on date")).collect()
    assert len(got) == len(captures)

    def active(pattern, category, day):
        on = False
        for p, c, action, when in sorted((e for e in log if e[0] and e[1]), key=lambda e: (e[3], e[2])):
            if p.lower() == pattern and c == category and when <= day:
                on = action == "add"
        return on

    hosts = ["bad.org", "x.bad.org", "ok.bad.org", "notbad.org", None, None, "z.net", "bad.org"]
    for r in got:
        host = hosts[r.id // 100]
        assert r.host == host
        parts = host.split(".") if host and r.fetched_on else []
        names = [".".join(parts[k:]) for k in range(len(parts))]
        hits = [(p, c) for p in names for c in ("spam", "adult", "allow") if active(p, c, r.fetched_on)]
        assert r.n_active == len(hits)
        assert r.categories == (",".join(sorted({c for _, c in hits})) or None)
        assert r.pattern == (max((p for p, _ in hits), key=len) if hits else None)
        assert r.blocked == (bool(hits) and "allow" not in {c for _, c in hits})


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.org", DAY(0))], "id long, url string, fetched_on date")
    entries = spark.createDataFrame([("a.org", "spam", "add", DAY(0))], "pattern string, category string, action string, listed_on date")
    assert [r.blocked for r in urlfilter.screen(captures, entries.limit(0)).collect()] == [False]
    assert urlfilter.screen(captures.limit(0), entries).count() == 0


def test_addresses_have_no_parent_domains(spark):
    urls = ["http://10.1.2.3/a", "http://[2001:db8::1]:80/b", "http://[::1]/", "http://a.b.org/", "http://1.2.org/"]
    entries = [("2.3", "spam", "add", DAY(0)), ("10.1.2.3", "adult", "add", DAY(0)), ("[2001:db8::1]", "spam", "add", DAY(0)), ("b.org", "spam", "add", DAY(0)), ("2.org", "spam", "add", DAY(0))]
    captures = spark.createDataFrame([(k, u, DAY(5)) for k, u in enumerate(urls)], "id long, url string, fetched_on date")
    got = {r.id: (r.host, r.pattern) for r in urlfilter.screen(captures, spark.createDataFrame(entries, "pattern string, category string, action string, listed_on date")).collect()}
    assert got == {0: ("10.1.2.3", "10.1.2.3"), 1: ("[2001:db8::1]", "[2001:db8::1]"), 2: ("[::1]", None), 3: ("a.b.org", "b.org"), 4: ("1.2.org", "2.org")}
