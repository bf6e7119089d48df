from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

import pytest
from sample_days import AS_OF
from pyspark.sql import functions as F

from havenlens import schemas
from havenlens.operators import decisions, insights
from havenlens.sources import tables as io
from havenlens.streaming import jobs

STAMP = dt.datetime(2001, 11, 5, 6)


def test_csv_nulls_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "calls.csv"
    path.write_text('T,C,P,TS,D,CH,A,S,L,TEXT\nt1,c1,NULL,2001-11-05 10:00:00,In,,a1,60,en,"Agent: ""hi""\nCustomer: yes, '
                    'thanks"\nt2,c1,"",2001-11-05 11:00:00,In,x,a1,NULL,en,plain\n', encoding="utf-8")
    got = io.read_raw_csv(spark, str(path), schemas.CALL_TRANSCRIPTS, multiline=True).orderBy("transcript_id").collect()
    assert got[0].transcript_text == 'Agent: "hi"\nCustomer: yes, thanks' and got[0].policy_id is None
    assert (got[0].channel, got[0].duration_sec, got[1].duration_sec, got[1].policy_id) == (None, 60, None, None)
    assert got[0].call_ts == dt.datetime(2001, 11, 5, 10)


@pytest.mark.parametrize("line", ["p1,c1,Health,Plan,abc,1,Annual,2001-01-01,2002-01-01,Active,x,1", "p1,c1"])
def test_bad_records_stop_the_read(spark, tmp_path, line):
    path = tmp_path / "policies.csv"
    path.write_text("h1,h2,h3,h4,h5,h6,h7,h8,h9,h10,h11,h12\n" + line + "\n")
    with pytest.raises(Exception):
        io.read_raw_csv(spark, str(path), schemas.POLICIES).collect()


def test_json_export(spark, tmp_path):
    df = spark.createDataFrame([("a�b", float("nan"), dt.datetime(2001, 1, 2, 3, 4, 5), ["x"])],
                               "s string, d double, call_ts timestamp_ntz, evidence array<string>")
    io.export_json({"interaction_insights": df}, str(tmp_path))
    (part,) = Path(tmp_path, "interaction_insights").glob("part-*.json")
    assert json.loads(part.read_text(encoding="utf-8")) == {
        "s": "a—b", "d": None, "call_ts": "2001-01-02T03:04:05", "evidence": ["x"]}


def test_normalised_types(spark):
    df = spark.createDataFrame([("2001-02-03", '[{"factor":"a","points":1,"detail":""},{"factor":"b","points":2,'
                                 '"detail":""}]', None), ("soon", None, '["t"]')],
                               "due_date string, risk_drivers string, evidence string")
    a, b = io.normalise_types(df).collect()
    assert a.due_date.date() == dt.date(2001, 2, 3) and b.due_date is None
    assert [d.factor for d in a.risk_drivers] == ["b", "a"] and (a.evidence, b.risk_drivers, b.evidence) == ([], [], ["t"])


def test_key_checks_find_what_is_wrong(spark):
    parent = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    child = spark.createDataFrame([("a",), ("z",), (None,)], "ref string")
    got = {r.check_name: r.n_bad for r in io.key_checks({"p": (parent, "id")}, {"r": (child, "ref", parent, "id")}).collect()}
    assert got == {"p.null_keys": 1, "p.duplicate_keys": 1, "r.orphans": 1}


def test_stages_equal_the_single_plan(book, plain_book):
    assert book.nba.exceptAll(plain_book.nba).count() == 0 and book.nba.count() == plain_book.nba.count()


def test_the_first_append_starts_the_log_and_ids_rise_with_every_other(spark, tmp_path):
    path = str(tmp_path / "log")
    for status in ("Accepted", "Done"):
        batch = spark.createDataFrame([("a", status), ("b", status)], "customer_id string, status string")
        decisions.append_action_log(batch, path, agent="me", now=STAMP)
    log = spark.read.parquet(path)
    assert log.count() == log.select("log_id").distinct().count() == 4
    assert {r.status for r in decisions.action_status(log).collect()} == {"Done"}
    assert {r.agent for r in log.collect()} == {"me"}


def test_several_writers_append_at_once(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "log")

    def append(i):
        batch = spark.createDataFrame([(f"c{i}", "Accepted"), ("all", "Done")], "customer_id string, status string")
        decisions.append_action_log(batch, path, agent=f"a{i}", now=STAMP + dt.timedelta(minutes=i))

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(append, range(6)))
    real = decisions.batch_entries

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(decisions, "batch_entries", lost)
    with pytest.raises(RuntimeError):
        append(6)
    monkeypatch.setattr(decisions, "batch_entries", real)
    before = {r.log_id for r in decisions.read_log(spark, path).select("log_id").collect()}
    append(7)
    append(8)
    log = decisions.read_log(spark, path)
    assert log.count() == log.select("log_id").distinct().count() == 16
    assert {r.customer_id for r in log.collect()} == {"all", *(f"c{i}" for i in (0, 1, 2, 3, 4, 5, 7, 8))}
    eight, seven = (min(r.log_id for r in log.where(F.col("agent") == a).collect()) for a in ("a8", "a7"))
    assert eight > seven > max(before)
    assert {r.agent for r in decisions.action_status(log).where("customer_id = 'all'").collect()} == {"a8"}


def test_later_stages_add_new_calls_only(spark, sample, tmp_path):
    import dataclasses

    from havenlens.plans.book import book_from_tables, run_stages

    whole = book_from_tables(sample, AS_OF, stamped_at=STAMP)
    early = dataclasses.replace(whole, call_transcripts=sample["call_transcripts"].where("call_ts < TIMESTAMP_NTZ '2001-10-01'"))
    first = run_stages(spark, early, str(tmp_path))["interaction_insights"]
    n_first, files = first.count(), set(first.inputFiles())
    stored = run_stages(spark, whole, str(tmp_path))
    assert files < set(spark.read.parquet(f"{tmp_path}/interaction_insights").inputFiles())
    assert 0 < n_first < stored["interaction_insights"].count() == sample["call_transcripts"].count()
    assert stored["next_best_actions"].exceptAll(whole.nba).count() == 0
    from havenlens.operators import customer360

    recent = customer360.since(stored["interaction_insights"], AS_OF, 180)
    assert "PartitionFilters: [isnotnull(month" in recent._jdf.queryExecution().executedPlan().toString()


def test_months_are_rebalanced_on_a_first_append(spark, tmp_path):
    calls = spark.range(4000).selectExpr("id", "TIMESTAMP_NTZ '2001-01-05' + make_interval(0, cast(id % 12 AS int)) AS call_ts").repartition(40)
    io.write_table(calls, str(tmp_path / "t"), "call_ts", "append")
    assert len(list(Path(tmp_path, "t").glob("month=*/part-*"))) <= 24


def test_export_sorts_a_busy_day_by_id(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i:03d}", dt.date(2001, 1, 1)) for i in range(200)][::-1], "payment_id string, due_date date").repartition(5)
    io.export_json({"payments": df}, str(tmp_path))
    parts = sorted(Path(tmp_path, "payments").glob("part-*.json"))
    ids = [json.loads(line)["payment_id"] for part in parts for line in part.read_text().splitlines()]
    assert ids == sorted(ids) and len(ids) == 200


def test_arrivals_meet_their_own_months_only_and_repeats_have_a_rule(spark, sample, tmp_path):
    path, calls = str(tmp_path / "t"), sample["call_transcripts"]
    io.create_empty(spark, insights.interaction_insights(calls), path)
    io.write_table(insights.interaction_insights(calls.where("call_ts < TIMESTAMP_NTZ '2001-10-01'")), path, "call_ts", "append")
    batch = calls.where("call_ts >= TIMESTAMP_NTZ '2001-09-15'")
    twins = batch.limit(1).withColumn("transcript_text", F.lit("Customer: z later text"))
    fresh = jobs.fresh_calls(batch.unionByName(twins), path)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    got = {r.transcript_id: r for r in fresh.collect()}
    assert got.keys() == {r.transcript_id for r in calls.where("call_ts >= TIMESTAMP_NTZ '2001-10-01'").collect()}
    twin = twins.first().transcript_id
    if twin in got:
        assert got[twin].transcript_text == max("Customer: z later text", calls.where(F.col("transcript_id") == twin).first().transcript_text)


def test_stream_equals_batch_and_repeats_add_nothing(spark, sample, tmp_path):
    arriving, store, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    calls = sample["call_transcripts"]
    calls.repartition(3).write.parquet(arriving)

    def run(checkpoint):
        stream = spark.readStream.schema(schemas.CALL_TRANSCRIPTS).option("maxFilesPerTrigger", 1).parquet(arriving)
        jobs.stream_enrich(stream, store, checkpoint, enriched_at=STAMP).awaitTermination()

    run(progress)
    calls.where(F.col("customer_id") == "calls").write.mode("append").parquet(arriving)  # a late repeat
    run(progress)
    run(progress + "-lost")  # everything replayed without its progress
    got = spark.read.parquet(store).drop("month")
    want = insights.interaction_insights(calls, enriched_at=STAMP)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_status_stream_equals_batch(spark, rows, tmp_path):
    arriving, store, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    log = rows(schemas.ACTION_LOG, [
        dict(log_id=i, customer_id=f"c{i % 7}", status=("Accepted", "Done", "Odd", "Rejected")[i % 4],
             ts=dt.datetime(2001, 11, 1 + i % 3)) for i in range(60)])
    log.repartition(20).write.parquet(arriving)
    stream = spark.readStream.schema(schemas.ACTION_LOG).option("maxFilesPerTrigger", 1).parquet(arriving)
    jobs.stream_action_status(stream, store, progress).awaitTermination()
    got, want = jobs.current_status(spark, store), decisions.action_status(log)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0
    places = jobs.whole_versions(spark, f"{store}/places")
    assert len(places) == 2 and places[-1] >= 15
    last = rows(schemas.ACTION_LOG, [dict(log_id=900, customer_id="c3", status="Done", ts=dt.datetime(2001, 12, 1)),
                                     dict(log_id=901, customer_id="new", status="Rejected", ts=dt.datetime(2001, 12, 1))])
    last.coalesce(1).write.mode("append").parquet(arriving)
    before = jobs._places(spark, store, places[-1])
    jobs.stream_action_status(stream, store, progress).awaitTermination()
    after = jobs._places(spark, store, places[-1] + 1)
    assert 1 <= sum(after[b] != before.get(b) for b in after) <= 2  # two customers, two buckets at most
    got, want = jobs.current_status(spark, store), decisions.action_status(log.unionByName(last))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert len(list(Path(store, "data").glob("version=*/bucket=*"))) <= 2 * len(after)


def crash_once(monkeypatch, module, name, after=True):
    """The first call of a function breaks, after it did its work or before."""
    real, calls = getattr(module, name), []

    def broken(*args, **more):
        calls.append(name)
        if len(calls) == 1:
            if after:
                real(*args, **more)
            raise RuntimeError("lost")
        return real(*args, **more)

    monkeypatch.setattr(module, name, broken)
    return calls


def test_a_replayed_status_batch_gives_the_same_table(spark, rows, tmp_path, monkeypatch):
    arriving, store, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    log = rows(schemas.ACTION_LOG, [dict(log_id=i, customer_id=f"c{i % 5}", status="Done", ts=dt.datetime(2001, 11, 1 + i % 9)) for i in range(30)])
    log.repartition(2).write.parquet(arriving)
    stream = spark.readStream.schema(schemas.ACTION_LOG).option("maxFilesPerTrigger", 1).parquet(arriving)
    crash_once(monkeypatch, jobs, "drop")  # everything is written, the commit of the batch is not
    with pytest.raises(Exception, match="lost"):
        jobs.stream_action_status(stream, store, progress, 4).awaitTermination()
    jobs.stream_action_status(stream, store, progress, 4).awaitTermination()
    got, want = jobs.current_status(spark, store), decisions.action_status(log)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 5


def test_a_replayed_batch_of_decisions_appends_nothing(spark, rows, tmp_path, monkeypatch):
    arriving, store, progress = (str(tmp_path / n) for n in ("in", "log", "progress"))
    made = rows(schemas.ACTION_LOG, [dict(customer_id=f"c{i % 40}", status="Accepted", note=f"n{i % 70}") for i in range(90)]).drop("log_id")
    made.repartition(3).write.parquet(arriving)
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    seen = []
    real = decisions.batch_entries

    def broken(*args, **more):
        entries = real(*args, **more)
        seen.append(args[1])
        if len(seen) == 2:  # the second batch is written, but not committed
            entries.write.mode("overwrite").parquet(f"{store}/batch={args[1]}")
            seen.append(sorted(entries.select("log_id", "customer_id", "note").collect()))
            raise RuntimeError("lost")
        return entries

    monkeypatch.setattr(decisions, "batch_entries", broken)
    with pytest.raises(Exception, match="lost"):
        jobs.stream_action_log(stream, store, progress, "me", STAMP).awaitTermination()
    jobs.stream_action_log(stream, store, progress, "me", STAMP).awaitTermination()
    log = decisions.read_log(spark, store)
    got, want = log.drop("log_id"), made.withColumns({"agent": F.lit("me"), "ts": F.lit(STAMP).cast("timestamp_ntz")}).select(*log.drop("log_id").columns)
    assert got.count() == 90 and got.exceptAll(want).count() == 0
    assert log.select("log_id").distinct().count() == 90
    ids = {(r.log_id, r.customer_id, r.note) for r in log.collect()}
    assert {tuple(r) for r in seen[2]} <= ids  # the replay gave the same ids
    by_batch = sorted(i >> decisions.BATCH_BITS for i, *_ in ids)
    assert set(by_batch) == {1, 2, 3}


def test_insights_and_index_arrive_together(spark, sample, tmp_path, monkeypatch):
    from havenlens.operators import search, search_index

    monkeypatch.setattr(search_index, "TERM_PARTS", 3)
    arriving, store, path, progress = (str(tmp_path / n) for n in ("in", "out", "index", "progress"))
    calls = sample["call_transcripts"].where("customer_id <> 'hot' OR transcript_id < 'h00020'")
    calls.repartition(2).write.parquet(arriving)
    stream = spark.readStream.schema(schemas.CALL_TRANSCRIPTS).option("maxFilesPerTrigger", 1).parquet(arriving)
    crash_once(monkeypatch, search_index, "_write_load", after=False)  # insights are written, the load is not published
    with pytest.raises(Exception, match="lost"):
        jobs.stream_index(stream, store, path, progress, enriched_at=STAMP).awaitTermination()
    assert search_index.open_index(spark, path).docs.count() == 0
    jobs.stream_index(stream, store, path, progress, enriched_at=STAMP).awaitTermination()
    want = insights.interaction_insights(calls, enriched_at=STAMP)
    got = spark.read.parquet(store).drop("month")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert sorted(r.id for r in search_index.open_index(spark, path).live_docs.collect()) == sorted(r.transcript_id for r in want.collect())
    asked = spark.createDataFrame([("q", "cancel or port")], "query_id string, text string")
    scanned = search.keyword_search(search.search_corpus(want), [search.SearchQuery("q", "cancel or port")], 6)
    assert {(r.id, r["rank"]) for r in search_index.search_index(asked, path, 6).collect()} == {(r.transcript_id, r["rank"]) for r in scanned.collect()}


def test_shared_folder_is_the_configured_one(spark):
    from havenlens.session import shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert AS_OF.year == 2001


def test_shared_folder_without_a_setting_is_in_the_warehouse(monkeypatch):
    from havenlens import session

    class Conf:
        def get(self, name, default=None):
            return {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}.get(name, default)

    chosen = {"spark.sql.warehouse.dir"}

    class Settings:
        contains = staticmethod(lambda name: name in chosen)

    class Bare:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Settings)
            getCheckpointDir = staticmethod(lambda: None)

    assert session.shared_folder(Bare) == "hdfs://x/warehouse/scratch"
    chosen.clear()  # a cluster where nobody has said which folder is shared
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Bare)
    Bare.sparkContext.master = "local[4]"
    assert session.shared_folder(Bare) == "hdfs://x/warehouse/scratch"
