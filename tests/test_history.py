import datetime
import json
import os
import pathlib
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from pagetables.functions.text import field
from pagetables.plans import history
from pagetables.session import new_folder, shared_folder
from pagetables.sources import sinks
from pagetables.sources.history_store import HistoryStore
from pagetables.sources.pages import PAGE_SCHEMA, read_html_files, write_html_files
from pagetables.streaming import jobs
import workload.history

SCHEMA = (
    "url string, scrape_type string, record_count bigint, status string, execution_time double, timestamp string, "
    "error_message string, preview_json string"
)
HOSTS = ["orchard.example", "mill.example/flour", "harbour.example"]


def saved_runs(spark, first, n):
    """Runs number first to first + n - 1: every third one fails, the others find as many
    records as their number says."""
    rows = []
    for i in range(first, first + n):
        bad = i % 3 == 2
        kind = ("Images", "Paragraphs")[i % 2]
        note, shown = ("no answer", None) if bad else (None, json.dumps([{"No": str(i)}]))
        at = f"2031-07-{10 + i // 60:02d} 08:{i % 60:02d}:00"
        rows.append((f"https://{HOSTS[i % 3]}", kind, 0 if bad else i, ("Success", "Failed")[bad], i / 8, at, note, shown))
    return spark.createDataFrame(rows, SCHEMA)


def ids(store):
    return [r.id for r in store.read().orderBy("id").collect()]


def new_store(spark):
    return HistoryStore(spark, new_folder(spark, "history"))


def test_an_empty_history(spark):
    store = new_store(spark)
    assert ids(store) == [] and store.clear() and store.delete(4) and ids(store) == []
    assert tuple(history.stats(store.read()).first()) == (0, 0, 0, 0, 0.0, 0.0)
    assert history.page_kpis(store.read()).first().time_of_day == "Never"


def test_what_is_saved_can_be_searched(spark):
    store = new_store(spark)
    assert store.append(saved_runs(spark, 0, 9), ["timestamp"]) == 9
    runs = store.read()
    # runs 2, 5 and 8 failed; the others found 0 + 1 + 3 + 4 + 6 + 7 records
    assert tuple(history.stats(runs).first()) == (9, 6, 3, 21, 0.44, 66.7)
    assert [r.id for r in history.recent(runs, "MILL").collect()] == [8, 5, 2]
    assert [r.id for r in history.recent(runs, "paragraphs", "Success").collect()] == [8, 4, 2]
    assert [r.id for r in history.recent(runs, limit=2).collect()] == [9, 8]
    assert history.rename_display(history.recent(runs, status="Failed")).first()["Notes / Error"] == "no answer"
    assert tuple(history.page_kpis(runs).first()) == (0, "1.00s", "harbour.example", "08:08:00")
    assert sorted(r.record["No"] for r in history.preview_rows(runs).collect()) == list("013467")
    assert history.by_id(runs, 4).first().execution_time == 0.38


def test_repeated_batches_undo_nothing(spark):
    store = new_store(spark)
    batches = [saved_runs(spark, 0, 3), saved_runs(spark, 3, 2)]
    store.append(batches[0], ["timestamp"], batch=0)
    store.delete(2)
    store.append(batches[0], ["timestamp"], batch=0)
    assert ids(store) == [1, 3]
    store.append(batches[1], ["timestamp"], batch=1)
    store.delete(5)
    for again in (1, 0, 1):
        store.append(batches[again], ["timestamp"], batch=again)
        assert ids(store) == [1, 3, 4]
    store.clear()
    for again in (0, 1):
        assert store.append(batches[again], ["timestamp"], batch=again) == (3, 5)[again]
    assert ids(store) == []
    assert store.append(batches[0], ["timestamp"]) == 8
    assert ids(store) == [6, 7, 8]


def test_a_repeated_batch_must_have_its_rows(spark):
    store = new_store(spark)
    store.append(saved_runs(spark, 0, 3), ["timestamp"], batch=0)
    store.append(saved_runs(spark, 3, 1), ["timestamp"], batch=1)
    with pytest.raises(ValueError, match="batch 0 had 3 rows and now has 4"):
        store.append(saved_runs(spark, 0, 4), ["timestamp"], batch=0)
    assert ids(store) == [1, 2, 3, 4]


def test_writers_at_the_same_time(spark):
    """Every row is kept and every id given once, also to writers of one batch."""
    store = new_store(spark)
    store.append(saved_runs(spark, 0, 2), ["timestamp"])
    jobs = [(3 + k, 4, None) for k in range(3)] + [(30, 5, 7)] * 3
    with ThreadPoolExecutor(6) as pool:
        save = lambda j: HistoryStore(spark, store.path).append(saved_runs(spark, j[0], j[1]), ["timestamp"], batch=j[2])
        last = list(pool.map(save, jobs))
    assert ids(store) == list(range(1, 2 + 3 * 4 + 5 + 1))
    assert len(set(last[3:])) == 1 and len(set(last)) == 4
    assert store.read().where("url IS NOT NULL").groupBy("timestamp").count().where("count > 3").isEmpty()


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["before the claim", "after the claim", "while writing", "before closing", "after closing"])
def test_a_writer_that_dies(spark, monkeypatch, step):
    store = new_store(spark)
    store.append(saved_runs(spark, 0, 2), ["timestamp"], batch=0)
    publish = HistoryStore._publish

    def crash(self, name, **row):
        claim = name.startswith("claims")
        if step == "before the claim" and claim or step == "before closing" and not claim:
            raise Crash
        done = publish(self, name, **row)
        if step == "after the claim" and claim or step == "after closing" and not claim:
            raise Crash
        return done

    def half_written(self, path, *args, **kwargs):
        if "/rows/" in path:
            write(self, path, *args, **kwargs)
            raise Crash
        return write(self, path, *args, **kwargs)

    write = DataFrameWriter.parquet
    with monkeypatch.context() as dying:
        dying.setattr(HistoryStore, "_publish", crash)
        if step == "while writing":
            dying.setattr(DataFrameWriter, "parquet", half_written)
        with pytest.raises(Crash):
            store.append(saved_runs(spark, 2, 3), ["timestamp"], batch=1)
    # The batch's ids are taken once it claimed them; its rows show when they are closed.
    begun = step != "before the claim"
    assert ids(store) == [1, 2, 3, 4, 5] if step == "after closing" else ids(store) == [1, 2]
    assert store.append(saved_runs(spark, 5, 1), ["timestamp"], batch=2) == (6 if begun else 3)
    assert store.append(saved_runs(spark, 2, 3), ["timestamp"], batch=1) == (5 if begun else 6)
    assert ids(store) == [1, 2, 3, 4, 5, 6]
    assert [r.record_count for r in store.read().orderBy("id").collect()] == ([0, 1, 0, 3, 4, 0] if begun else [0, 1, 0, 0, 3, 4])


def test_a_file_appears_once(spark):
    store = new_store(spark)
    assert store._publish("claims/1", claim=1, batch=4, first_id=1, n=2)
    assert not store._publish("claims/1", claim=1, batch=5, first_id=1, n=9)
    assert [tuple(r) for r in store._small("claims", "claim bigint, batch bigint, n bigint").collect()] == [(1, 4, 2)]


def test_nothing_is_left_of_the_numbering(spark):
    store = new_store(spark)
    store.append(saved_runs(spark, 0, 3), ["timestamp"])
    shared = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in shared.glob("numbering-*")}
    store.append(saved_runs(spark, 3, 3), ["timestamp"])
    assert {p.name for p in shared.glob("numbering-*")} == before


def test_numbering_follows_the_order(spark):
    keys = list(range(5000))
    random.Random(1).shuffle(keys)
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(7)
    numbered = history.number_rows(rows, ["k"], 11, partitions=6)
    assert [(r.k, r.id) for r in numbered.orderBy("k").collect()] == [(k, k + 11) for k in range(5000)]


def test_log_tail(spark):
    logs = spark.range(700).select(F.col("id").alias("ts"))
    assert [r.ts for r in history.log_tail(logs, ["ts"]).collect()] == list(range(200, 700))


def parts(folder, suffix):
    return sorted(pathlib.Path(folder).glob(f"*{suffix}"))


def test_csv(spark):
    folder = new_folder(spark, "csv")
    records = [("a, b", 'say "x"', 1), (" é ", "two\nlines", None), ("", None, 3)]
    frame = spark.createDataFrame(records, "Name string, Note string, Score int").coalesce(1)
    sinks.write_csv(frame, folder)
    data = parts(folder, ".csv")[0].read_bytes()
    assert data.startswith(b"\xef\xbb\xbfName,Note,Score")
    back = sinks.read_csv(spark, folder, frame.schema.simpleString()[7:-1].replace(":", " "))
    assert [r.Score for r in back.collect()] == [1, None, 3]
    assert [r.Name for r in back.collect()][:2] == ["a, b", " é "]
    assert back.first().Note == 'say "x"'


def test_json_and_widths(spark):
    folder = new_folder(spark, "json")
    frame = spark.createDataFrame([("Zoë/x", 0), (None, 12345)], "Name string, A_very_long_column bigint")
    sinks.write_json(frame, folder)
    lines = [json.loads(x) for p in parts(folder, ".json") for x in p.read_text(encoding="utf-8").splitlines()]
    assert sorted(lines, key=str) == sorted(
        [{"Name": "Zoë/x", "A_very_long_column": 0}, {"Name": None, "A_very_long_column": 12345}], key=str
    )
    wide = spark.createDataFrame([("x" * 100 + "\ny", 1.5, True)], "t string, d double, flag boolean")
    widths = {r.column_name: r.width for r in sinks.column_widths(wide.unionByName(wide)).collect()}
    assert widths == {"t": 60, "d": 12, "flag": 12}
    assert {r.width for r in sinks.column_widths(frame).collect()} == {12, 22}


def test_html_files(spark, tmp_path):
    (tmp_path / "one.html").write_text("<title>One</title>\n<p>x</p>", encoding="utf-8")
    (tmp_path / "two.html").write_text("<title>Two</title>", encoding="utf-8")
    name = F.regexp_extract("path", "([a-z]+)[.]html$", 1)
    page_id = F.when(name == "one", 1).otherwise(2)
    pages = read_html_files(spark, str(tmp_path), page_id, F.concat(F.lit("https://x.example/"), name))
    assert [(r.page_id, r.url) for r in pages.orderBy("page_id").collect()] == [
        (1, "https://x.example/one"), (2, "https://x.example/two"),
    ]
    assert pages.where("page_id = 1").first().html.count("\n") == 1


def test_html_files_of_many_pages_need_few_folders(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"<p>{i}</p>é\n") for i in range(200)] + [(200, None)], "page_id bigint, html string")
    write_html_files(pages.repartition(3), str(tmp_path))
    assert len([p for p in tmp_path.rglob("*") if p.is_dir()]) <= 3
    page_id = F.regexp_extract("path", "page_id=([0-9]+)", 1)
    found = {r.page_id: r.html for r in read_html_files(spark, str(tmp_path), page_id, F.lit("")).collect()}
    assert found == {i: f"<p>{i}</p>é\n\n" for i in range(200)} | {200: "\n"}


def test_streams_read_a_table_of_many_files(spark, tmp_path):
    rows = [(i, "https://x.example/", f"<title>{i}</title>") for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "many" / "pages.parquet"))
    pages.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "one").mkdir()
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "one" / "pages.parquet")
    for table in ("many", "one"):
        found = workload.history.stream_extract(spark, str(tmp_path / table))
        assert sorted(r.page_id for r in found.collect()) == list(range(20))


def test_stream_picks_up_new_files_once(spark):
    folder = new_folder(spark, "stream")
    store = HistoryStore(spark, f"{folder}/history")

    def arrive(number):
        rows = [(number, "https://x.example/", f"<h1>Page {number}</h1>")]
        spark.createDataFrame(rows, PAGE_SCHEMA).write.mode("append").parquet(f"{folder}/in")

    def run():
        pages = spark.readStream.schema(PAGE_SCHEMA).parquet(f"{folder}/in")
        jobs.stream_extract(pages, f"{folder}/out", f"{folder}/checkpoint", store).awaitTermination()

    arrive(1)
    run()
    run()
    arrive(2)
    run()
    records = spark.read.parquet(f"{folder}/out").where("scrape_type = 'Headings'")
    assert sorted(r.page_id for r in records.collect()) == [1, 2]
    assert [r.id for r in store.read().orderBy("id").collect()] == list(range(1, 13))


def test_a_page_that_comes_again_counts_once(spark):
    folder = new_folder(spark, "stream")
    schema = "page_id bigint, url string, html string, seen_at timestamp"

    def arrive(number, *pages):
        rows = [(i, "https://x.example/", f"<h1>{t}</h1>", datetime.datetime(2031, 5, 1, h, m)) for i, t, h, m in pages]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{number}")

    def run():
        pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        jobs.stream_extract(pages, f"{folder}/out", f"{folder}/checkpoint", event_time="seen_at", repeats_within="2 hours").awaitTermination()
        found = spark.read.parquet(f"{folder}/out").where("scrape_type = 'Headings'").orderBy("page_id", "payload").collect()
        return [(r.page_id, json.loads(r.payload)["Heading Text"]) for r in found]

    arrive(0, (1, "first", 9, 0), (2, "two", 9, 10), (2, "two", 9, 10))
    assert run() == [(1, "first"), (2, "two")]
    arrive(1, (1, "again", 10, 0), (3, "late, but not too late", 8, 0))
    assert run() == [(1, "first"), (2, "two"), (3, "late, but not too late")]
    # Five hours on, page 1 is new again, and a page of nine o'clock comes too late.
    arrive(2, (4, "four", 15, 0))
    run()
    arrive(3, (1, "much later", 15, 30), (5, "too late", 9, 0))
    assert run() == [(1, "first"), (1, "much later"), (2, "two"), (3, "late, but not too late"), (4, "four")]


def _log_stream(spark, folder):
    """Adds files of lines (minute of the day, level) and starts streams over them."""

    def arrive(number, *lines):
        rows = [(i, f"[2031-05-01 {m // 60:02d}:{m % 60:02d}:00] [{level}] x" if m is not None else "no time") for i, m, level in lines]
        spark.createDataFrame(rows, "line_id bigint, line string").coalesce(1).write.parquet(f"{folder}/in/{number}")

    def lines():
        return spark.readStream.schema("line_id bigint, line string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")

    return arrive, lines


def test_log_windows_count_late_lines_and_keep_little_state(spark):
    folder = new_folder(spark, "stream")
    arrive, lines = _log_stream(spark, folder)

    def run():
        started = jobs.stream_log_windows(lines(), F.col("line"), f"{folder}/out", f"{folder}/checkpoint", "10 minutes", "30 minutes")
        started.awaitTermination()
        found = spark.read.schema("window_start timestamp, level string, n bigint").parquet(f"{folder}/out")
        state = started.lastProgress.stateOperators[0].numRowsTotal if started.lastProgress else 0
        return sorted((r.window_start.hour * 60 + r.window_start.minute, r.level, r.n) for r in found.collect()), state

    arrive(0, (1, 0, "INFO"), (2, 5, "INFO"), (3, 9, "ERROR"), (4, 25, "INFO"), (5, None, "INFO"))
    assert run() == ([], 3)
    # Line 6 is late, but its window is open; line 7 closes the first window.
    arrive(1, (6, 3, "ERROR"), (7, 41, "SUCCESS"))
    assert run()[0] == [(0, "error", 2), (0, "info", 2)]
    # Hours later no window but the newest is kept; what belongs to a closed one is not counted.
    arrive(2, (8, 600, "INFO"))
    run()
    arrive(3, (9, 4, "INFO"), (10, 601, "INFO"))
    found, state = run()
    assert found == [(0, "error", 2), (0, "info", 2), (20, "info", 1), (40, "success", 1)] and state == 1


def test_log_tail_of_a_stream(spark):
    folder = new_folder(spark, "stream")
    arrive, lines = _log_stream(spark, folder)

    def run():
        jobs.stream_log_tail(lines(), F.col("line"), ["line_id"], f"{folder}/tail", f"{folder}/checkpoint", 3).awaitTermination()
        return sorted(r.line_id for r in jobs.read_log_tail(spark, f"{folder}/tail").collect())

    arrive(0, (1, None, ""), (2, 10, "INFO"))
    assert run() == [1, 2]
    # Ties go to the larger id; a late line counts while it is among the newest.
    arrive(1, (3, 20, "INFO"), (4, 20, "INFO"), (5, 20, "INFO"))
    assert run() == [3, 4, 5]
    arrive(2, (6, 15, "INFO"), (7, 30, "INFO"))
    assert run() == run() == [4, 5, 7]
    arrive(3, (8, 20, "INFO"))
    arrive(4, (9, 40, "INFO"))
    assert run() == [7, 8, 9]
    assert len([f for f in os.listdir(f"{folder}/tail") if f.startswith("batch_id")]) == 2


def test_rows_are_counted_as_they_are_written(spark, monkeypatch):
    store = HistoryStore(spark, new_folder(spark, "history"))

    def refused(frame):
        raise AssertionError("the rows were read to count them")

    monkeypatch.setattr(DataFrame, "count", refused)
    assert store.append(saved_runs(spark, 0, 9).repartition(5), ["timestamp"], batch=0) == 9
    assert store.append(saved_runs(spark, 0, 0), ["timestamp"], batch=1) == 9
    assert store.append(saved_runs(spark, 9, 4), ["timestamp"], batch=2) == 13
    monkeypatch.undo()
    assert sorted(r.id for r in store.read().collect()) == list(range(1, 14))


def test_previews_as_variants(spark):
    texts = ['[{"No": 1, "Text": "a"}, {"Text": null}]', "[]", None, "not json", '{"No": 1}', "[7]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, preview_json string")
    shown = history.preview_variants(rows).select("id", "record_no", field(F.col("record"), "No", "bigint"), field(F.col("record"), "Text"))
    assert sorted(tuple(r) for r in shown.collect()) == [(0, 1, 1, "a"), (0, 2, None, None), (5, 1, None, None)]
