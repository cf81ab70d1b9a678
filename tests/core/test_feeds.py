"""Feeds: the parsers, and the data source in batches, streams and restarts."""

import os
import time
from datetime import UTC, datetime

import pytest

from newsmill.functions.feedxml import entries, moment
from newsmill.sources.feedsource import FeedSource

RSS = """<?xml version="1.0" encoding="utf-8"?><rss xmlns:media="http://search.yahoo.com/mrss/"><channel><title>c</title><link>https://c.example</link>
<item><title><![CDATA[ One & <b>two</b> ]]></title><link> https://a.example/1?x=1&amp;y=2 </link><pubDate>Sat, 15 Jun 2024 10:30:00 +0700</pubDate>
<media:content url="https://i.example/v.mp4" type="video/mp4"/><media:content url="https://i.example/1.jpg" medium="image"/></item>
<item><title>No link</title><link></link></item>
<item><title>Enclosed &#233;</title><link>https://a.example/2</link><enclosure url="https://i.example/2.png" type="image/png"/></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title>E</title><link rel="self" href="https://s.example"/><link href="https://a.example/e"/><updated>2024-01-02T03:04:05Z</updated></entry></feed>"""


def test_rss_and_atom():
    found, well = entries(RSS.encode())
    assert well and [e["url"] for e in found] == ["https://a.example/1?x=1&y=2", "https://a.example/2"]
    assert found[0]["title"] == "One & <b>two</b>" and found[0]["image_url"] == "https://i.example/1.jpg"
    assert found[0]["published_at"] == datetime(2024, 6, 15, 3, 30, tzinfo=UTC) and found[1]["published_at"] is None
    assert found[1]["title"] == "Enclosed é" and found[1]["image_url"] == "https://i.example/2.png"
    found, well = entries(ATOM.encode())
    assert well and found == [{"url": "https://a.example/e", "title": "E", "published_at": datetime(2024, 1, 2, 3, 4, 5, tzinfo=UTC), "image_url": None}]
    assert entries(RSS.replace("utf-8", "latin-1").replace("&#233;", "é").encode("latin-1"))[0][1]["title"] == "Enclosed é"


@pytest.mark.parametrize("broken", [RSS.replace("</channel></rss>", ""), RSS.replace("<title>c</title>", "<title>c & d</title>"), RSS.replace("<rss ", "<rss <"), "junk " + RSS])
def test_malformed_feeds_keep_their_entries(broken):
    found, well = entries(broken.encode())
    assert not well and [e["url"] for e in found] == ["https://a.example/1?x=1&y=2", "https://a.example/2"]
    assert found[0]["title"] == "One & <b>two</b>"


@pytest.mark.parametrize("data", [b"", b"<rss>", b"no feed at all", b"<html><body><p>x</p></body></html>", b"\xff\xfe\x00", b"<rss><channel></channel></rss>"])
def test_feeds_without_entries(data):
    assert entries(data)[0] == []


def test_dates():
    assert moment("2024-06-15") == datetime(2024, 6, 15, tzinfo=UTC) and moment("yesterday") is None and moment(None) is None and moment("Mon, 99 Jun 2024 10:00:00 +0000") is None


def item(n):
    return f"<item><title>t{n}</title><link>https://a.example/{n}</link></item>"


def put(folder, name, text, at):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    os.utime(f"{folder}/{name}", ns=(at, at))


def test_batches_of_files(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    read = lambda **o: spark.read.format("feed").options(**o).load(f"{tmp_path}/in")
    assert read().count() == 0
    for n in range(30):
        put(f"{tmp_path}/in/{n % 3}", f"s{n}.xml", "<rss>" + "".join(item(n * 10 + k) for k in range(n % 4)) + ("</rss>" if n % 5 else ""), 10**18)
    put(f"{tmp_path}/in", "other.txt", item(1), 10**18)
    got = read(partition_bytes=200).collect()
    assert {(r.feed, r.url, r.well_formed) for r in got} == {(f"s{n}", f"https://a.example/{n * 10 + k}", n % 5 > 0) for n in range(30) for k in range(n % 4)}
    assert read(partition_bytes=200).rdd.getNumPartitions() > 5


def test_a_stream_restarts_without_loss_or_repeats(spark, tmp_path):
    spark.dataSource.register(FeedSource)
    base = time.time_ns() - 10**12

    def run():
        rows = spark.readStream.format("feed").option("max_files", 4).load(f"{tmp_path}/in")
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            q.processAllAvailable()
            return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        finally:
            q.stop()

    for n in range(10):
        put(f"{tmp_path}/in", f"a{n}.rss", f"<rss>{item(n)}</rss>", base + n // 3)  # some of one time
    assert run() == [4, 4, 2]
    for n in range(10, 15):
        put(f"{tmp_path}/in", f"b{n}.rss", f"<rss>{item(n)}</rss>", base + n)
    assert run() == [4, 1] and run() == []
    assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(f"https://a.example/{n}" for n in range(15))
