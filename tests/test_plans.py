"""Registered queries on rows of their own."""

import datetime as dt
import hashlib
from types import SimpleNamespace

from pyspark.sql import functions as F

from postloom.operators import matching
from postloom.plans import registry, views

QUERIES = registry.all_queries() and registry.QUERIES
DAY = dt.datetime(2024, 1, 1)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def scoring_views(spark, users=3):
    jobs = spark.createDataFrame(
        [(1, "red plate", "blue", "tokyo", 10, 20), (2, "grey", "red old", "osaka", None, None), (3, "grey", "none", "tokyo", 10, 20)],
        "id long, title string, description string, location string, salary_annual_min long, salary_annual_max long")
    criteria = spark.createDataFrame(
        [(i, i, ["red"], ["tokyo"], 5, 30, DAY) for i in range(1, users + 1)],
        "id long, user_id long, keywords array<string>, locations array<string>, min_salary long, max_salary long, updated_at timestamp_ntz")
    return SimpleNamespace(spark=spark, v_jobs=jobs, v_criteria=criteria)


def test_dashboard_threshold_keeps_scores_from_30(spark):
    # 70, 30 and 30 points: title, place and pay; description alone; place and pay alone
    got = {tuple(r) for r in QUERIES["f_threshold"](scoring_views(spark)).collect()}
    assert got == {(user, 3, 130, 1, 3) for user in (1, 2, 3)}


def test_saved_pages_come_back_one_by_one(spark):
    rows = [(1, "<p>a\nb</p>"), (2, "same"), (3, "same"), (4, ""), (5, None), (6, "first"), (6, "second"), (None, "x"), (-7, "y")]
    pages = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    got = QUERIES["src_html_files"](SimpleNamespace(spark=spark, table=lambda name: pages)).collect()
    assert sorted(map(str, got)) == sorted(
        f"Row(page_id={page}, digest={md5(html)!r})" if html is not None else f"Row(page_id={page}, digest=None)" for page, html in rows)


def test_new_matches_are_not_shuffled_to_be_merged(spark):
    matches = spark.createDataFrame([(5, 1, 1, 0.4, DAY), (6, 2, 9, 0.3, DAY)], "id long, user_id long, job_id long, match_score double, matched_at timestamp_ntz")
    scores = spark.range(3000).selectExpr("id % 3 AS user_id", "id div 3 AS job_id", "cast(50 + id % 7 AS int) AS score")
    rows = matching.merge_scores(matches, scores, "2024-02-01")
    assert rows.groupBy("change").count().orderBy("change").collect() == [("existing", 2), ("new", 2998)]
    joined, new = matching._merged_parts(matches, scores, "2024-02-01")
    assert joined.count() < 200 and new.count() > 2800
    # new pairs come straight from the scores: broadcasts, no exchange of rows
    assert new._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(user_id") == 0


def test_new_matches_are_numbered_over_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(matching, "JOB_BLOCK", 7)
    monkeypatch.setattr(matching, "GROUPS_PER_SLICE", 3)
    matches = spark.createDataFrame([(50, 1, 3, 0.4, DAY), (60, 9, 9, 0.3, DAY)], "id long, user_id long, job_id long, match_score double, matched_at timestamp_ntz")
    pairs = [(u, j, 60) for u in (None, 0, 1, 2) for j in (*range(40), None)]
    scores = spark.createDataFrame(pairs, "user_id long, job_id long, score int")
    rows = matching.match_upsert(matches, scores, "2024-02-01").collect()
    new = sorted((r["id"], r["user_id"], r["job_id"]) for r in rows if r["change"] == "new")
    first = lambda x: (x is not None, x or 0)
    want = sorted(((u, j) for u, j, _ in pairs if (u, j) != (1, 3)), key=lambda p: (first(p[0]), first(p[1])))
    assert new == [(61 + i, *p) for i, p in enumerate(want)]
    assert {(r["id"], r["match_score"], r["change"]) for r in rows if r["change"] != "new"} == {(50, 0.6, "existing"), (60, 0.3, "kept")}


def test_pages_are_spread_by_postings_and_cards_derived_once(spark, monkeypatch):
    monkeypatch.setattr(views, "POSTINGS_PER_TASK", 10)
    v = views.Views(spark, "/nowhere")
    v.v_card = spark.range(400).selectExpr(
        "id", "id div 5 AS page_no", "concat('t', id) AS title", "'c' AS company", "'l' AS location", "'s' AS salary_text", "uuid() AS description")
    pages = v.board_pages("doda")
    assert pages.rdd.getNumPartitions() == 40 > spark.sparkContext.defaultParallelism
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and "RepartitionByExpression [page_no" in plan
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    assert len(rows) == 80 and all(rows[p].index(f">ct{5 * p}<") < rows[p].index(f">ct{5 * p + 4}<") for p in rows)
    # both boards print the same derived cards, random text and all
    both = pages.union(v.board_pages("green")).groupBy("page_id").agg(F.count_distinct(F.regexp_extract("html", "<p>([0-9a-f-]{36})", 1)).alias("n"))
    assert both.where("n > 1").isEmpty()
