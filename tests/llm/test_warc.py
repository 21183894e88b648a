import datetime as dt

from deltaweave.llm import warc

SCHEMA = "record_id long, record_type string, url string, captured timestamp, headers map<string,string>, payload string, period string, near string"


def at(s):
    return dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)


def run(spark, rows, **k):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r.record_id: r for r in warc.resolve_revisits(df, **k).collect()}


def test_validators_and_headers(spark):
    rows = [
        (1, "response", "http://www.A.com:80/x/?b=2&utm_source=q&a=1#f", at(0), {"etag": '"1"', "content-type": "text/html", "date": "d0"}, "one"),
        (2, "revisit", "https://a.com/x?a=1&b=2", at(5), {"etag": 'W/"1"', "date": "d5", "content-type": "no", "x-other": "no"}, None),
        (3, "response", "http://a.com/x?a=1&b=2", at(10), {"etag": '"2"', "last-modified": "m"}, "two"),
        (4, "revisit", "http://a.com/x?a=1&b=2", at(11), {"etag": '"1"'}, None),
        (5, "revisit", "http://a.com/x?a=1&b=2", at(12), {"last-modified": "m"}, None),
        (6, "revisit", "http://a.com/x?a=1&b=2", at(13), {"last-modified": "n"}, None),
        (7, "revisit", "http://a.com/x?a=1&b=2", at(14), None, None),
        (8, "revisit", "http://a.com/y", at(14), {}, None),
        (9, "revisit", None, at(14), {}, None),
        (10, "revisit", "http://a.com/x?a=1&b=2", None, {}, None),
        (11, "revisit", "http://a.com/x?a=1&b=2", at(10), {}, None),
        (12, "response", "http://a.com/x?a=1&b=2", at(10), None, "later of equal times"),
        (13, "metadata", "http://a.com/y", at(0), {}, "no"),
        (2, "revisit", "https://a.com/x?a=1&b=2", at(5), {"etag": 'W/"1"', "date": "d5", "content-type": "no", "x-other": "no"}, None),
    ]
    got = run(spark, rows, periods=3)
    assert len(got) == 9
    assert (got[2].outcome, got[2].response_id, got[2].payload) == ("resolved", 1, "one")
    assert got[2].headers == {"etag": 'W/"1"', "content-type": "text/html", "date": "d5"}
    assert got[2].canonical_url == "a.com/x?a=1&b=2"
    assert (got[4].response_id, got[4].outcome) == (12, "resolved")  # nothing to compare with
    assert (got[11].response_id, got[11].outcome) == (3, "resolved")
    assert [got[k].outcome for k in (8, 9, 10)] == ["no earlier response"] * 3
    rows = [r for r in rows if r[0] != 12]
    got = run(spark, rows)
    assert [got[k].outcome for k in (4, 5, 6, 7)] == ["etag mismatch", "resolved", "last-modified mismatch", "resolved"]
    assert got[4].payload is None and got[4].headers is None and got[5].payload == "two"


def test_hot_url_is_carried_over_periods(spark):
    rows = [(k, "response" if k % 50 == 0 else "revisit", "http://hot.example/", at(k), {}, f"p{k}" if k % 50 == 0 else None) for k in range(300)]
    got = run(spark, rows, periods=16)
    assert all(r.response_id == k // 50 * 50 and r.payload == f"p{k // 50 * 50}" for k, r in got.items()) and len(got) == 294


def test_empty_table(spark):
    assert run(spark, []) == {}
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.resolve_revisits(warc.records_of_pages(pages)).collect() == []


def test_records_without_an_id(spark):
    url = "http://a.com/x"
    rows = [
        (None, "response", url, at(0), {"etag": '"1"'}, "one"),
        (None, "response", url, at(10), {"etag": '"2"'}, "two"),
        (None, "response", "http://b.com/", None, {}, "no time"),
        (None, "revisit", url, at(5), {"etag": '"1"'}, None),
        (None, "revisit", url, at(5), {"etag": '"1"'}, None),
        (None, "revisit", url, at(10), {"etag": '"2"'}, None),
        (None, "revisit", "http://b.com/", None, {}, None),
        (None, "revisit", None, at(5), {}, None),
        (7, "revisit", url, at(11), {}, None),
        (7, "revisit", url, at(11), {}, None),
        (8, "response", url, at(12), {}, "eight"),
        (None, "revisit", url, at(13), {}, None),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for periods in (2, 4):
        got = warc.resolve_revisits(df, periods=periods).collect()
        assert sorted((str(r.record_id), str(r.canonical_url), str(r.response_id), r.outcome, str(r.payload)) for r in got) == [
            ("7", "a.com/x", "None", "resolved", "two"),
            ("None", "None", "None", "no earlier response", "None"),
            ("None", "a.com/x", "8", "resolved", "eight"),
            ("None", "a.com/x", "None", "resolved", "one"),
            ("None", "a.com/x", "None", "resolved", "one"),
            ("None", "a.com/x", "None", "resolved", "two"),
            ("None", "b.com", "None", "no earlier response", "None"),
        ]


def test_query_with_pages_without_an_id_against_sql(spark, tmp_path):
    import duckdb

    from deltaweave.llm.sql import OP10

    pages = [(k, f"http://h{k % 3}.com/p", f"<p>{k % 4}</p>") for k in range(1, 30)]
    pages += [(None, f"http://h{k % 3}.com/p", f"<p>{k % 2}</p>") for k in range(12)] + [(None, None, None), (None, None, "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(OP10).fetchall()
    got = warc.op10_warc_revisits(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) == 29 + 7


def test_repeats_with_other_content_in_any_order(spark):
    url = "http://a.com/x"
    rows = [
        (1, "response", url, at(0), {"etag": '"1"'}, "one"),
        (1, "response", url, at(0), {"etag": '"2"'}, "two"),
        (1, "response", url, at(0), {"etag": '"1"'}, "one"),
        (2, "revisit", url, at(5), {"etag": '"1"'}, None),
        (2, "revisit", url, at(6), {"etag": '"2"'}, None),
        (3, "revisit", url, at(7), {"etag": '"2"'}, None),
        (3, "response", url, at(9), {"etag": '"3"'}, "three"),
        (4, "revisit", url, at(11), {"etag": '"3"'}, None),
    ]
    answers = []
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = run(spark, order)
        answers.append(sorted((k, r.outcome, r.payload, r.response_id) for k, r in got.items()))
    assert answers[0] == answers[1] == answers[2]
    # of both contents of record 1 the same one is compared and returned; record 3 is a response, no revisit
    (two, four) = answers[0]
    assert two[0] == 2 and two[1:3] in (("resolved", "one"), ("etag mismatch", None)) and four == (4, "resolved", "three", 3)


def test_busy_responses_and_long_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "REVISITS", 3)
    long = "p" * 2_000_000
    rows = [(0, "response", "http://hot.example/", at(0), {"etag": '"e"'}, long), (None, "response", "http://no-id.example/", at(0), {}, "anonymous")]
    rows += [(k, "revisit", "http://hot.example/", at(k), {"etag": '"e"'}, None) for k in range(1, 40)]
    rows += [(100 + k, "revisit", "http://no-id.example/", at(k), {}, None) for k in range(1, 20)]
    rows += [(200 + k, "revisit", "http://nowhere.example/", at(k), {}, None) for k in range(30)]
    got = run(spark, rows, periods=4)
    assert len(got) == 39 + 19 + 30
    assert all(got[k].payload == long for k in range(1, 40)) and all(got[100 + k].payload == "anonymous" for k in range(1, 20))
    assert all(got[200 + k].outcome == "no earlier response" for k in range(30))
