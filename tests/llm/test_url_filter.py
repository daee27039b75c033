from parecer.llm import url_filter as m

SCHEMA = "page_id long, url string, html string, id long, component string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def canonical(url):
    return f'<html><LINK href="{url}" rel=canonical></html>'


def verdicts(df):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


def test_rules(spark):
    got = verdicts(m.judged(pages(spark, [
        (1, "http://WWW.Example.ORG/es/1?x#y", None), (2, "https://example.org/en/12", ""),
        (3, "https://example.org/en/2", None), (4, "https://a.com/de/", None),
        (5, "https://com/fr/x", None), (6, "https://notcom/de/", None), (7, None, None),
        (8, "", None), (9, "no scheme", None), (10, "x://", None), (11, "http://ex.org", None),
        (12, "http://a.com?q=/de/", None), (13, "http://xexample.org/es/", None),
        (14, "http://É.COM/de/", None), (15, "a://b.com/de/://c.org/", None),
    ])))
    assert got[1] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow")
    assert got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6][2:] == (None, "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10] == ("", "", None, "allow")
    assert got[11] == ("ex.org", "", None, "allow") and got[12] == ("a.com", "", None, "allow")
    assert got[13][2:] == ("org/", "allow") and got[14][0] == "É.com"
    assert got[15][:3] == ("b.com", "/de/://c.org/", "com/de/")


def test_decisions_reach_aliases(spark):
    rows = [
        (1, "http://a.net/1", canonical("https://b.net/2")),
        (2, "http://b.net/2#frag", '<meta http-equiv="refresh" content="0; URL=\'http://c.net/3\'">'),
        (3, "http://c.net/3", canonical("http://www.example.org/es/")),
        (4, "http://d.net/1", canonical("http://x.com/de/")),
        (5, "http://d.net/1?q", canonical("/1")),
        (6, "http://e.net/a/b", canonical("c")), (7, "http://e.net/a/c", canonical("http://y.com/de/1")),
        (8, "http://f.net/", canonical("http://x.com/de/")), (9, "http://f.net/", None),
        (10, "http://g.net/", canonical("http://x.org/")),
        (11, "http://h.net/", "<!-- " + canonical("http://x.com/de/") + " --><script>"
         + canonical("http://x.com/de/") + "</script>"),
        (12, "http://i.net/", canonical("http://i.net/")),
        (13, "http://x.com/fr/", canonical("http://x.com/de/k")),
        (14, "http://k.net/", canonical("http://x.com/de/k")),
    ]
    got = verdicts(m.judged(pages(spark, rows)))
    assert [got[i][3] for i in (1, 2, 3)] == ["block"] * 3
    assert [got[i][3] for i in (4, 5, 6, 7, 8, 9)] == ["block"] * 6
    assert [got[i][3] for i in (10, 11, 12)] == ["allow"] * 3
    assert [got[i][3] for i in (13, 14)] == ["allow"] * 2  # an allowed alias goes before a block
    assert all(got[i][2] is None for i in range(1, 13))


def test_redirects_and_long_chains(spark):
    hops = spark.createDataFrame(
        [(f"http://n{i}.net/", f"http://n{i + 1}.net/") for i in range(30)]
        + [("http://n30.net/", "http://x.com/de/"), (None, "http://n1.net/")],
        "url string, target string",
    )
    rows = [(i, f"http://n{i}.net/", None) for i in range(31)] + [(99, "http://m.net/", None)] * 2
    got = m.judged(pages(spark, rows), redirects=hops).collect()
    assert len(got) == 33
    assert {r["verdict"] for r in got if r["page_id"] < 99} == {"block"}
    assert {r["verdict"] for r in got if r["page_id"] == 99} == {"allow"}


def test_empty_table(spark):
    assert m.judged(pages(spark, [])).collect() == []


def test_every_link_of_a_page_counts(spark):
    refresh = '<meta http-equiv=refresh content="0; url={}">'
    rows = [
        (1, "http://a.net/", canonical("http://b.net/") + canonical("http://x.com/de/")),
        (2, "http://c.net/", refresh.format("http://d.net/") + refresh.format("http://x.com/de/")),
        (3, "http://b.net/", None), (4, "http://d.net/", None),
    ]
    links = m.alias_links(pages(spark, rows)).collect()
    assert sorted(r["target"] for r in links) == [
        "http://b.net/", "http://d.net/", "http://x.com/de/", "http://x.com/de/"]
    got = verdicts(m.judged(pages(spark, rows)))
    assert [got[i][3] for i in (1, 2, 3, 4)] == ["block"] * 4
