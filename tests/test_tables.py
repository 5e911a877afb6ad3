import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from postloom import schemas
from postloom.operators import browse, lifecycle, stats, users
from postloom.session import new_folder, shared_folder, steps_cleared, within, written
from postloom.sources import frontier, tables

DAY = dt.datetime(2024, 1, 1)


def jobs(spark, rows):
    return spark.createDataFrame(rows, "id long, job_board string, last_seen_at timestamp_ntz, is_active boolean")


def test_expiry(spark):
    rows = [(1, "a", DAY, True), (2, "a", DAY + dt.timedelta(days=1), True), (3, "a", None, True), (4, "b", DAY, True), (5, "a", DAY, False)]
    got = {r["id"]: (r["is_active"], r["expired"]) for r in lifecycle.expire_stale(jobs(spark, rows), "2024-01-08 00:00:01", board="a").collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (True, False), 5: (False, False)}


def test_checks_and_deletes(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None)], "id long, url string")
    assert [tuple(r) for r in lifecycle.check_unique(rows, ["url"]).collect()] == [("x", 2)]
    assert {tuple(r) for r in lifecycle.check_not_null(rows, ["id", "url"]).collect()} == {("id", 0), ("url", 2)}
    children = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id long, user_id long")
    assert [r["id"] for r in lifecycle.check_fk(children, "user_id", rows).collect()] == [2]
    left = lifecycle.cascade_delete(children, "user_id", rows.where("id = 1"))
    assert {r["id"] for r in left.collect()} == {2, 3}


def test_schema_steps_there_and_back(spark):
    first = spark.createDataFrame([(1, "t", "$1", DAY)], "id long, title string, salary string, scraped_at timestamp_ntz")
    up = lifecycle.migrate_last_seen(lifecycle.migrate_jobs_v2(lifecycle.migrate_updated_at(first)))
    row = up.first()
    assert (row["updated_at"], row["salary_text"], row["last_seen_at"], row["is_active"]) == (DAY, None, DAY, True)
    down = up
    for step in ("last_seen", "jobs_v2", "updated_at"):
        down = lifecycle.migrate_down(down, step)
    assert set(down.columns) == set(first.columns) and down.first()["salary"] is None
    with pytest.raises(ValueError):
        lifecycle.migrate_down(first, "nothing")


def test_tokens(spark):
    people = spark.createDataFrame([(1, None), (2, "own"), (3, None)], "id long, access_token string")
    got = {r["id"]: r["access_token"] for r in lifecycle.migrate_tokens(people).collect()}
    assert got[2] == "own" and got[1] != got[3] and all(len(got[i]) == 43 for i in (1, 3))
    assert not set("".join(got.values())) & set("+/=")


def test_user_add(spark):
    known = spark.createDataFrame([(4, "a@x")], "id long, email string")
    wanted = spark.createDataFrame([("A", "a@x"), ("B", "b@x"), ("B2", "b@x"), ("C", "c@x")], "name string, email string")
    got = [tuple(r) for r in users.user_add(known, wanted, "http://h", salt="s").select("id", "name", "email", "url").orderBy("id").collect()]
    assert [g[:3] for g in got] == [(5, "B", "b@x"), (6, "C", "c@x")] and got[0][3].startswith("http://h/u/")
    assert users.empty_criteria(spark.createDataFrame([(5,)], "id long"), DAY).first()["keywords"] is None


def test_listings(spark):
    rows = [(i, f"Title {i}", "Ａcme" if i % 2 else "Other%", "b1" if i % 3 else "b2", f"Place_{i}", DAY + dt.timedelta(days=i // 4), i % 5 != 0) for i in range(40)]
    j = spark.createDataFrame(rows, "id long, title string, company string, job_board string, location string, scraped_at timestamp_ntz, is_active boolean")
    assert browse.f_location(j, "PLACE_1").count() == 11
    assert browse.f_search(j, "r%").count() == 20 and browse.f_search(j, None).count() == 40
    assert browse.f_active(j, "false").count() == 8 and browse.f_active(j, "any").count() == 40
    page, info = browse.jobs_browse(j, 2, 10, board="b1")
    want = sorted((r for r in rows if r[3] == "b1"), key=lambda r: (-r[5].toordinal(), r[0]))[10:20]
    assert [r["id"] for r in page.collect()] == [r[0] for r in want]
    assert tuple(info.first()) == (2, 10, 26, 3, 11, 20)
    after = browse.page_after(browse.f_board(j, "b1"), want[-1][5], want[-1][0], 10)
    assert {r["id"] for r in after.collect()} == {r[0] for r in rows if r[3] == "b1"} - {
        r["id"] for p in (1, 2) for r in browse.page_jobs(browse.f_board(j, "b1"), p, 10).collect()}
    with pytest.raises(ValueError):
        browse.page_jobs(j, 0)
    assert tuple(stats.agg_totals(j).first()) == (40, 32, 8)


def test_top_matches_cut_before_the_shuffle(spark):
    m = spark.createDataFrame([(i, 1 if i % 3 else i, i, i / 100, DAY) for i in range(50)],
                              "id long, user_id long, job_id long, match_score double, matched_at timestamp_ntz")
    j = spark.range(50).select("id", *[F.lit("x").alias(c) for c in ("title", "company", "location", "salary_text", "url", "job_board")],
                               F.lit(1).alias("salary_annual_min"), F.lit(1).alias("salary_annual_max"))
    best = browse.topk_matches_all_users(m, j, 3)
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
    assert [r["job_id"] for r in best.where("user_id = 1").orderBy("rank").collect()] == [49, 47, 46]


def test_settings(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"global":{"keywords":["a"],"max_pages":20},\n "scrapers":{"doda":{"enabled":false,"_c":"x"},"green":{"max_pages":3}}}', encoding="utf-8")
    row = tables.src_settings(spark, str(path)).select("global.max_pages", F.map_keys("scrapers").alias("k")).first()
    assert (row["max_pages"], sorted(row["k"])) == (20, ["doda", "green"])
    default = tables.src_settings(spark, str(tmp_path / "missing.json")).first()
    assert default["global"]["location"] == "東京" and sorted(default["scrapers"]) == ["doda", "green", "indeed"]
    own = spark.createDataFrame([("a", '{"max_pages":3,"location":null}'), ("b", None), ("c", "[1]")], "source string, settings string")
    got = {r["source"]: (r["keywords"], r["location"], r["max_pages"]) for r in frontier.j_settings(own, {"keywords": ["k"]}).collect()}
    assert got == {"a": (["k"], None, 3), "b": (["k"], "東京", 2), "c": (["k"], "東京", 2)}
    assert frontier.f_only(own, ["all"]).count() == 3 and frontier.f_only(own, ["a", "zz"]).count() == 0


def test_files_and_tables(spark, tmp_path):
    saved = tmp_path / "html"
    saved.mkdir()
    for name, text in (("a", "<p>\n一</p>"), ("b", "<b>\n</b>")):
        (saved / f"{name}.html").write_text(text, encoding="utf-8")
    got = {r["url"].rsplit("/", 1)[1]: r["html"] for r in tables.src_html_files(spark, str(saved)).collect()}
    assert got == {"a.html": "<p>\n一</p>", "b.html": "<b>\n</b>"}
    seeded = tables.seed_rows(spark, "2024-01-01")
    for name in ("users", "jobs"):
        seeded[name].write.parquet(str(tmp_path / "db" / name))
    back = tables.src_tables(spark, str(tmp_path / "db"))
    assert {n: t.count() for n, t in back.items()} == {"users": 1, "jobs": 1, "criteria": 0, "matched_jobs": 0}
    assert back["jobs"].first()["url"] == seeded["jobs"].first()["url"] != ""
    assert set(schemas.RECORD_COLUMNS) - {"job_id"} <= set(back["jobs"].columns)
    for i in range(2):
        tables.sink_append(seeded["jobs"], str(tmp_path / "append"))
    assert spark.read.parquet(str(tmp_path / "append")).count() == 2
    landing = str(tmp_path / "pages")
    tables.sink_html(spark.createDataFrame([(1, "<p>")], "page_id long, html string"), landing)
    assert tables.src_pages(spark, landing).count() == 1


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    copy = written(spark.range(3), "t")
    assert shared_folder(spark) + "/t-" in copy.inputFiles()[0] and copy.count() == 3


def test_steps_go_with_their_block(spark):
    kept = written(spark.range(3), "kept")
    with pytest.raises(KeyError), steps_cleared(spark):
        result = new_folder(spark, "result")
        with steps_cleared(spark):
            inner = written(spark.range(5), "inner")
            inner.write.parquet(result)
        stored = spark.read.parquet(result)
        assert stored.count() == 5 and not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))
        new_folder(spark, "never-written")
        raise KeyError
    assert not os.path.exists(result) and kept.count() == 3
    after = written(spark.range(2), "after")
    assert after.count() == 2


def test_size_check_is_bounded(spark):
    rows = spark.createDataFrame([("a" * 10,)] * 5, "x string")
    width = F.length("x")
    assert within(rows, 5, 50, width) and not within(rows, 4, 50, width) and not within(rows, 5, 49, width)


def test_criteria_upsert_gives_the_table(spark):
    old = dt.datetime(2020, 1, 1)
    rows = [(1, 7, ["a"], None, 1, 2, True, old, old), (2, 7, ["b"], ["x"], 3, 4, None, old, old), (3, 8, ["c"], None, 5, 6, False, old, old)]
    criteria = spark.createDataFrame(rows, schemas.CRITERIA)
    forms = spark.createDataFrame(
        [(1, 7, old, " q ,", "", "10", "zz", "false"), (2, 9, old, None, None, None, None, None)],
        "id long, user_id long, updated_at timestamp_ntz, keywords string, locations string, min_salary string, max_salary string, remote_preference string")
    after = users.criteria_upsert(criteria, forms, "2024-01-01")
    assert after.columns == criteria.columns
    new = dt.datetime(2024, 1, 1)
    assert sorted(tuple(r) for r in after.collect()) == [
        rows[0], (2, 7, ["q"], None, 100000, None, False, old, new), rows[2], (4, 9, None, None, None, None, None, new, new)]
    again = users.criteria_upsert(after, forms, "2025-01-01").collect()
    assert sorted(r["id"] for r in again) == [1, 2, 3, 4]


def test_first_name_by_order(spark):
    known = spark.createDataFrame([], "id long, email string")
    wanted = spark.createDataFrame([("b", "e@x", 1), ("a", "e@x", 2)], "name string, email string, at int")
    assert users.user_add(known, wanted, salt="s", order="at").first()["name"] == "b"
    assert users.user_add(known, wanted, salt="s").first()["name"] == "a"


def test_one_decimal_is_rounded_by_the_exact_value(spark):
    values = [0.0, 0.25, 0.35, 0.75, 0.15, 0.05, 1.45, 2.5, 9.95, 99.95, 0.049999, 12.25, 1e6 + 0.15, 1234.85, 0.45, 7.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r["t"] for r in rows.select(stats.one_decimal(F.col("v")).alias("t")).collect()] == [f"{v:.1f}" for v in values]


def test_new_users_come_with_criteria(spark):
    have = spark.createDataFrame([(4, "a", "a@x", "t")], "id long, name string, email string, access_token string")
    wanted = spark.createDataFrame([("b", "b@x"), ("a", "a@x"), ("c", "c@x")], "name string, email string")
    criteria = spark.createDataFrame([(9, 4)], "id long, user_id long")
    added, rows = users.users_with_criteria(have, criteria, wanted, "2024-01-01")
    assert [(r["id"], r["user_id"], r["keywords"]) for r in rows.orderBy("id").collect()] == [(10, 5, None), (11, 6, None)]
    first, second = ({r["email"]: r["access_token"] for r in added.collect()} for _ in range(2))
    assert first == second and set(first) == {"b@x", "c@x"}  # drawn once, read twice


def test_green_search_keeps_the_space_before_a_place(spark):
    rows = spark.createDataFrame([(["a b"], "東京"), ([], "x"), (["a"], ""), ([], None)], "k array<string>, l string")
    got = [r["u"].split("keyword=")[1] for r in rows.select(frontier.frontier_green(F.col("k"), F.col("l")).alias("u")).collect()]
    assert got == ["a+b+%E6%9D%B1%E4%BA%AC", "+x", "a", ""]


def test_entry_without_an_optional_package():
    """Without a package that only the training-data operators need, the posting queries are still there."""
    code = "import sys; sys.modules['xxhash'] = sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    found, sql = map(int, out.stdout.split())
    assert found > 140 and sql == found - 1
