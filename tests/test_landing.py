"""Landed feeds: the data source's listing and offsets, each type's reader, and a restart of the stream."""

from __future__ import annotations

import datetime

from trendspan.sources import landing as ld

FILES = {
    ("rss", "a", "01"): "<rss><channel><title>c</title><item><title>One & two</title><guid isPermaLink='false'>https://g/1</guid><pubDate>Wed, 31 Jan 2024 10:00:00 GMT</pubDate></item><item><title></title><link>https://x/2</link></item></channel></rss>",
    ("atom", "b", "02"): '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link rel="self" href="https://self"/><link href="https://x/3"/><published>2024-01-30T01:02:03Z</published><content type="html">&lt;b&gt;text&lt;/b&gt;</content></entry></feed>',
    ("github_md_folder", "c", "03"): "## 제목: Section\n**요약**: s\n**전체링크**: https://x/4\n---\n## none",
    ("github_json", "d", "04"): '{"articles":[{"title":"J","url":"https://x/5","confidence":0.9},{"title":"K","url":"https://x/6","confidence":0.2}]}',
    ("link", "e", "05"): "- [Some title](https://x.org/7)\n- [abc](https://x.org/8)",
    ("other", "f", "06"): "nothing",
}
LINKS = ["https://g/1", "https://x.org/7", "https://x/3", "https://x/4", "https://x/5"]


def land(root, files):
    for (kind, feed, stamp), body in files.items():
        path = root / f"type={kind}" / f"feed={feed}" / f"stamp={stamp}"
        path.mkdir(parents=True)
        (path / "part-0.txt").write_text(body)
        (path / "_SUCCESS").write_text("")


def test_one_folder_of_all_types(spark, tmp_path):
    land(tmp_path, FILES)
    got = {r.link: r for r in ld.dispatched(ld.landed(spark, str(tmp_path))).collect()}
    assert sorted(got) == LINKS
    assert got["https://g/1"].title == "One & two" and got["https://g/1"].published_at == datetime.datetime(2024, 1, 31, 10)
    assert got["https://x/3"].summary == "text" and got["https://x/3"].published_at == datetime.datetime(2024, 1, 30, 1, 2, 3)
    assert [r.link for r in ld.dispatched(ld.landed(spark, f"file://{tmp_path}")).where("origin = 'curated'").collect()] == ["https://x/4"]


def test_a_stream_goes_on_behind_the_last_stamp(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        stream = ld.dispatched(ld.landed(spark, str(root), stream=True))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.link for r in spark.read.parquet(out).collect())

    land(root, {k: v for k, v in FILES.items() if k[2] <= "03"})
    assert run() == ["https://g/1", "https://x/3", "https://x/4"]
    land(root, {k: v for k, v in FILES.items() if k[2] > "03"})
    assert run() == LINKS
    assert run() == LINKS


def test_partitions_are_bounded_and_missing_folders_are_empty(tmp_path):
    files = [(f"p{k}", "rss", "a", f"{k:02}", 10) for k in range(5)]
    assert [len(p.files) for p in ld.dealt(files, 20)] == [2, 2, 1]
    assert ld.listed(str(tmp_path / "nowhere")) == []
    assert [p.files for p in ld.dealt([])] == [[]]


def test_a_batch_is_read_without_python_and_as_the_source_reads_it(spark, tmp_path):
    assert ld.landed(spark, str(tmp_path / "nowhere")).count() == 0 and ld.landed(spark, str(tmp_path)).count() == 0
    land(tmp_path, FILES | {("rss", "a b", "0007"): "two\nlines\n"})
    (tmp_path / "type=rss" / "feed=a b" / "stamp=0007" / "part-0.txt").write_bytes(b"two\nli\xffnes\n")
    found = ld.landed(spark, str(tmp_path))
    assert "Python" not in ld.dispatched(found)._jdf.queryExecution().executedPlan().toString()
    want = [row for part in ld.dealt(ld.listed(str(tmp_path))) for row in ld.bodies(str(tmp_path), part)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_bodies_are_handed_on_in_bounded_batches():
    rows = [("rss", "f", "1", f"n{k}", "x" * 40) for k in range(7)]
    found = list(ld.batches(iter(rows), 100))
    assert [b.num_rows for b in found] == [3, 3, 1]
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == rows and list(ld.batches(iter([]))) == []


def test_selection(spark):
    rows = [("rss", "a", "1", k, f"t{k} good" if k in (2, 7) else f"t{k}", None) for k in range(9)]
    df = spark.createDataFrame(rows, "type string, feed string, stamp string, at int, title string, published_at timestamp_ntz")
    from pyspark.sql import functions as F

    got = ld.selected(df, "2024-01-31 00:00:00", F.when(F.contains("title", F.lit("good")), 2).otherwise(0), 2).collect()
    # The eighth item is beyond the first six; the best one stays whatever its score.
    assert [r.title for r in got] == ["t2 good"]
