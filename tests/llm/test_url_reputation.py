import pytest

from laborlens.llm import url_reputation as U
from laborlens.plans.registry import all_queries
import laborlens.llm.queries  # noqa: F401
from tests.conftest import SF_SMALL
from tools.oracle_check import check, duck_con


@pytest.mark.parametrize("sf", [SF_SMALL, "/root/testdata/sf0.01"])
def test_oracle(spark, sf):
    status, msg = check(spark, duck_con(sf), all_queries()["op6_url_reputation"], sf)
    assert status == "ok", msg


def test_rules_hosts_and_paths(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://example.net/fr/1", "ftp://x.net", "http://x.net/", "http://b.org/fr/",
            "http://example.com/de/1#a", "http://notexample.com/de/", "http://borg/fr/", None, "", "no scheme", "http://",
            "http://h.com?q=/x", "http://h.com#/x", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, good int")
    rows = {r.page_id: r for r in U.judge(pages, none).collect()}
    assert len(rows) == len(urls)
    assert [rows[i].host for i in range(4)] == ["a.example.net", "example.net", "x.net", "x.net"]
    assert [rows[i].rule for i in range(8)] == ["example.net/en/", "net/", None, "net/", "org/fr/", "example.com/de/",
                                                None, None]
    assert [rows[i].verdict for i in (0, 1, 3, 4, 5)] == ["allow", "block", "block", "allow", "block"]
    for i in (8, 9, 10, 11):
        assert (rows[i].host, rows[i].path) == ("", "")
    assert (rows[12].host, rows[12].path, rows[13].path) == ("h.com", "", "")
    assert (rows[14].host, rows[14].path) == ("b:", "//c/d")


def test_bad_hosts_are_blocked_and_shared_evidence_counts(spark):
    urls = [(i, f"http://bad.evil.com/{i}") for i in range(300)] + [(300 + i, f"http://ok{i % 5}.fine.com/") for i in range(300)]
    urls += [(600, "http://new.evil.com/"), (601, "http://new.fine.com/"), (602, None), (602, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 AS host", "'p' AS allow")
    good = spark.createDataFrame([(i, int(i >= 300 and i % 7 > 0)) for i in range(600)] + [(5, None), (9999, 1)],
                                 "page_id long, good int")
    rows = U.judge(pages, good).toPandas()
    assert len(rows) == 604
    verdict = rows.set_index("page_id").verdict
    assert set(rows[rows.host == "bad.evil.com"].verdict) == {"block"}
    assert set(rows[rows.host.str.startswith("ok")].verdict) == {"allow"}
    assert verdict[600] == "block"
    assert U.judge(pages.limit(0), good).count() == 0
