"""The tail source: ranges of bytes, malformed records, growing files."""

import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.sources import tail


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\né", max_size=40), st.lists(st.integers(0, 60), max_size=5))
def test_every_line_is_in_one_range(text, cuts):
    data = text.encode()
    at = sorted({0, len(data), *[c for c in cuts if c < len(data)]})
    got = [x for a, b in zip(at, at[1:]) for x in tail.lines(io.BytesIO(data), a, b, b == len(data))]
    expected, place = [], 0
    for line in data.split(b"\n"):
        expected.append((place, line))
        place += len(line) + 1
    if expected[-1][1] == b"":
        expected.pop()
    assert got == expected


def rows(df):
    return sorted((r["file"], r["place"], r["record"], r["problem"] is None) for r in df.collect())


def test_batch_keeps_malformed_records_aside(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_bytes(b'{"x": 1}\n\nbroken\n{"x": "\xff"}\n{"x": 2}')
    (tmp_path / "in/_hidden").write_text("{}")
    (tmp_path / "in/empty.json").write_text("")
    load = lambda **o: spark.read.format("tidemark_tail").options(path=f"file://{tmp_path}/in", **o).load()
    expected = [("a.json", 0, '{"x": 1}', True), ("a.json", 10, "broken", False), ("a.json", 17, '{"x": "�"}', False), ("a.json", 28, '{"x": 2}', True)]
    assert rows(load()) == expected == rows(load(splitBytes="7"))
    assert rows(spark.read.format("tidemark_tail").option("path", f"file://{tmp_path}/none").load()) == []


def test_feeds_give_their_items(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text("<rss><item><title>é</title></item> <ITEM x='1'>b</ITEM></rss>")
    (tmp_path / "in/b.xml").write_text("<feed><entry>c</entry><entry>cut off")
    (tmp_path / "in/c.xml").write_text("no feed")
    got = rows(spark.read.format("tidemark_tail").options(path=f"file://{tmp_path}/in", records="feed").load())
    assert got == [("a.xml", 5, "<item><title>é</title></item>", True), ("a.xml", 36, "<ITEM x='1'>b</ITEM>", True), ("b.xml", 6, "<entry>c</entry>", True), ("c.xml", 0, "no feed", False)]


def test_a_stream_follows_growing_files(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    source, out, state = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"
    source.mkdir()

    def run():
        stream = spark.readStream.format("tidemark_tail").options(path=f"file://{source}", splitBytes="5").load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r["file"], json.loads(r["record"])["n"]) for r in spark.read.parquet(out).where("problem is null").collect())

    (source / "a.json").write_text('{"n": 1}\n{"n": 2}\n{"n"')
    assert run() == [("a.json", 1), ("a.json", 2)]
    with (source / "a.json").open("a") as f:
        f.write(': 3}\n{"n": 4}\n')
    (source / "b.json").write_text('{"n": 5}\nbroken\n')
    assert run() == [("a.json", 1), ("a.json", 2), ("a.json", 3), ("a.json", 4), ("b.json", 5)]
    assert len(run()) == 5  # started again, nothing is read twice
    assert [r["record"] for r in spark.read.parquet(out).where("problem is not null").collect()] == ["broken"]
