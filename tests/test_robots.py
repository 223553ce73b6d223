from lodestrata.operators import robots as R


def test_groups_agents_and_rules(spark):
    body = "Disallow: /lost\nUser-agent: *\r\nDisallow: /all # note\n\nUSER-AGENT : Bot\nuser-agent: other\nno colon here\nDisallow: /a\nAllow: /a/b*c$\nCrawl-delay: 3\nDisallow:\nUser-agent: third\nDisallow: /\nuser-agent: bot\nDisallow: /q?x=(1)\nDisallow: /*.html$"
    files = spark.createDataFrame([("a", 200, body), ("b", 404, body), ("c", 429, body), ("d", None, body), ("e", 301, body), ("f", 200, "User-agent: *\nDisallow: /all\nAllow: /all"), ("g", 204, None)], "site string, status int, body string")
    groups = [(r.at, r.field, r.group) for r in R.lines(files.where("site = 'a'")).orderBy("at").collect()]
    assert groups == [(0, "disallow", 0), (1, "user-agent", 1), (2, "disallow", 1), (4, "user-agent", 2), (5, "user-agent", 2), (7, "disallow", 2), (8, "allow", 2), (9, "crawl-delay", 2), (10, "disallow", 2), (11, "user-agent", 3), (12, "disallow", 3), (13, "user-agent", 4), (14, "disallow", 4), (15, "disallow", 4)]
    asked = [("a", "/lost"), ("a", "/all"), ("a", "/a"), ("a", "/a/bxc"), ("a", "/a/bxcd"), ("a", "/q?x=(1)&y"), ("a", "/x.html"), ("a", "/x.html?y"), ("b", "/a"), ("c", "/a"), ("d", "/a"), ("e", "/a"), ("f", "/all"), ("g", "/"), ("h", "/"), ("a", None)]
    urls = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(asked)], "id long, site string, path string")
    got = {r.id: (r.why, r.allowed) for r in R.decisions(urls, files, "Bot/2.1 (+http://bot.org)").collect()}
    assert [got[i][1] for i in range(8)] == [True, False, False, True, False, False, False, True]
    assert [got[i] for i in range(8, 16)] == [("unavailable", True), ("unreachable", False), ("unreachable", False), ("unreachable", False), ("parsed", True), ("parsed", True), ("unreachable", False), ("parsed", True)]
    assert R.decisions(urls, files.limit(0), "").where("allowed").count() == 0
