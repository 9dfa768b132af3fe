"""Behaviour of the operators on small inputs."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import dates, images, languages, mathx, text
from tidemark.model import NOW
from tidemark.operators import baselines, clusters, lift, ranking, scoring, series, tables
from tidemark.sources import parsing


def one(df):
    return df.first()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def snapshots(spark, rows):
    return spark.createDataFrame(rows, "id string, source string, author long, ts long, views double, likes long, native_score long")


def hourly(name, views, author=1):
    return [(name, "s", author, NOW - 3600 * (len(views) - 1 - i), float(v), None, i + 1) for i, v in enumerate(views)]


def test_velocity_and_acceleration(spark):
    rows = hourly("one", [1000]) + hourly("line", [1000, 3000, 5000]) + hourly("fast", [2000, 8000, 35000, 180000]) + hourly("steady", [0, 10000, 20000, 30000])
    got = {r["id"]: r for r in series.shape(snapshots(spark, rows), NOW).collect()}
    assert got["one"]["velocity"] is None and got["one"]["acceleration"] is None
    assert got["line"]["velocity"] == pytest.approx(2000)
    assert got["fast"]["acceleration"] > 4
    assert got["steady"]["acceleration"] == pytest.approx(1, abs=0.1)


def test_falling_counter_is_negative(spark):
    assert one(series.shape(snapshots(spark, hourly("down", [50, 40, 30])), NOW))["velocity"] == pytest.approx(-10)


def test_engagement_null_is_not_zero(spark):
    rows = [("a", "s", 1, NOW, 1000.0, 100, 1), ("b", "s", 1, NOW, 1000.0, None, 1), ("c", "s", 1, NOW, 0.0, 5, 1)]
    got = {r["id"]: r["engagement"] for r in series.engagement_rate(snapshots(spark, rows), ["likes"]).collect()}
    assert got == {"a": 0.1, "b": None, "c": None}


def test_percentile_from_quantiles(spark):
    q = F.struct(F.lit(500).alias("n"), F.lit(10000.0).alias("p50"), F.lit(40000.0).alias("p75"), F.lit(120000.0).alias("p90"), F.lit(900000.0).alias("p99"))
    few = F.struct(F.lit(3).alias("n"), F.lit(1.0).alias("p50"), F.lit(2.0).alias("p75"), F.lit(3.0).alias("p90"), F.lit(4.0).alias("p99"))
    at = lambda v, qq=q: value(spark, mathx.percentile_from_quantiles(F.lit(float(v)), qq))
    assert at(10000) == 0.5 and at(0) == 0 and at(5000) == 0.25 and at(900000) >= 0.98 and 0.99 < at(9e9) <= 1
    assert at(5, few) is None


def test_normalisers(spark):
    v = lambda c: value(spark, c)
    assert v(mathx.normalise_anomaly(F.lit(10.0))) == 0.5 and v(mathx.normalise_anomaly(F.lit(1.0))) == 0
    assert v(mathx.decay(F.lit(-1.0), 8)) == 1 and v(mathx.decay(F.lit(8.0), 8)) == 0.5
    assert v(mathx.rounded(F.lit(-2.5), 0)) == -2 and v(mathx.clamp(F.lit(None).cast("double"))) is None
    assert v(mathx.two_sided_p(F.lit(1.96))) == pytest.approx(0.05, abs=1e-4)
    assert v(mathx.null_aware_sum([F.lit(None).cast("long"), F.lit(2)])) == 2
    assert v(mathx.null_aware_sum([F.lit(None).cast("long"), F.lit(None).cast("long")])) is None


def test_missing_signal_is_left_out(spark):
    s = {"velocity": F.lit(1.0), "acceleration": F.lit(None).cast("double"), "anomaly": F.lit(None).cast("double"), "engagement": F.lit(None).cast("double"), "cross_source": F.lit(0.0), "freshness": F.lit(1.0)}
    mean, coverage = scoring.combine(s)
    assert value(spark, mean) == pytest.approx(0.35 / 0.45) and value(spark, coverage) == pytest.approx(0.45)


@pytest.mark.parametrize(
    ("kw", "state"),
    [
        (dict(score=60, popularity=0.4, norm=0.5), "EMERGING"),
        (dict(score=85, popularity=0.95, norm=0.2), "VIRAL"),
        (dict(observations=1), "NEW"),
        (dict(score=30, velocity=-5, peak=90), "DECLINING"),
        (dict(score=10, age=200), "DEAD"),
        (dict(velocity=0), "NEW"),
        (dict(velocity=None, popularity=0.97), "HOT"),
    ],
)
def test_lifecycle(spark, kw, state):
    base = dict(score=50, popularity=0.5, velocity=10, ratio=1.0, norm=0.1, observations=5, age=5, peak=None) | kw
    args = [F.lit(base[k]).cast("double") for k in ("score", "popularity", "velocity", "ratio", "norm", "observations", "age", "peak")]
    assert value(spark, scoring.lifecycle(*args)) == state


def test_confidence(spark):
    f = lambda *a: value(spark, scoring.confidence(*[F.lit(x).cast("double") for x in a]))
    assert f(1, 0, 0, 0.5, 1.0, 1) < 0.5 and f(8, 8, 0, 1, 1.0, 4) > 0.85 and f(8, 8, 0, 1, 0.3, 4) < 0.5


def test_leave_one_out_removes_one_of_equal_values(spark):
    rows = spark.createDataFrame([(i, 7, v, i) for i, v in enumerate([5.0, 5.0, 5.0, 50.0])], "id long, author long, value double, published_at long")
    got = {r["id"]: (r["n"], r["median"]) for r in baselines.leave_one_out(rows).collect()}
    assert got[0] == (3, 5.0) and got[3] == (3, 5.0)


def test_breakout_needs_five(spark):
    rows = spark.createDataFrame([(i, 7, v, i) for i, v in enumerate([3000.0] * 6 + [1200000.0])], "id long, author long, value double, published_at long")
    assert [r["id"] for r in baselines.breakouts(baselines.leave_one_out(rows)).collect()] == [6]
    few = rows.where("id >= 4")
    assert baselines.breakouts(baselines.leave_one_out(few, least=1)).count() == 0


def test_lift_rules(spark):
    rows = [("a", 0.30 + 0.01 * (i % 5), 1.0) for i in range(60)] + [("b", 0.70 + 0.01 * (i % 5), 1.0) for i in range(60)] + [("few", 0.1 * i, 1.0) for i in range(3)] + [("flat", 0.5, 1.0)] * 40
    got = {r["key"]: r for r in lift.summarise(spark.createDataFrame(rows, "key string, v double, sc double"), ["key"], "v", "sc").collect()}
    assert got["a"]["significant"] and got["b"]["significant"] and got["a"]["lift"] < 0 < got["b"]["lift"]
    assert got["few"]["thin"] and not got["few"]["significant"]
    assert got["flat"]["margin"] == 100 and got["flat"]["p"] == 1 and not got["flat"]["significant"]


def test_false_discovery(spark):
    make = lambda ps: spark.createDataFrame([(f"k{i}", p, True, False) for i, p in enumerate(ps)], "key string, p double, significant boolean, thin boolean")
    kept = lambda ps: lift.control_discoveries(make(ps), ["key"]).where("significant").count()
    assert kept([1e-8] * 20) == 20 and kept([0.04] * 20 + [0.9] * 60) == 0 and kept([0.04]) == 1


def test_stratified_mean_is_the_raw_mean(spark):
    rows = spark.createDataFrame([(i % 3 or None, float(i)) for i in range(30)], "g long, v double")
    got = lift.stratified(rows, "v", ["g"]).agg(F.avg("adjusted"), F.avg("v")).first()
    assert got[0] == pytest.approx(got[1])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 1e6), min_size=1, max_size=12))
def test_scores_are_in_range(spark, views):
    got = scoring.scored(snapshots(spark, hourly("x", sorted(views))), NOW).first()
    assert 0 <= got["score"] <= 100 and 0 <= got["confidence"] <= 1 and not math.isnan(got["score"])


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(text.normalise(F.lit("كتاب ١٢ https://x.y/z #Tag"))) == "کتاب 12 #tag"
    assert v(text.content_tokens(text.words_of(F.lit("The cats, and 12 dogs @me ñandú")))) == ["cats", "dogs", "ñandú"]
    assert v(text.words_of(F.lit("東京都 ab 中"))) == ["東京", "京都", "ab", "中"]
    stems = {"erupts": "erupt", "eruption": "erupt", "evacuated": "evacuat", "stories": "stori", "story": "stori", "passes": "pass", "class": "class", "proceeding": "proceed", "dies": "die", "cat": "cat", "über": "über"}
    for word, want in stems.items():
        assert v(text.stem(F.lit(word))) == want, word
    assert v(text.mentions(F.lit("@Ann_B @ann_b @x"))) == ["ann_b"]
    assert v(text.proper_nouns(F.lit("The New York Times saw Paris, Paris"))) == ["The New York Times", "Paris"]
    assert [v(text.length_band(F.lit(n))) for n in (30, 31, 70, 71, 101)] == ["0-30", "31-50", "51-70", "71-100", "100+"]
    assert [v(text.word_band(F.lit(n))) for n in (4, 5, 12, 13, 19)] == ["1-4", "5-8", "9-12", "13-18", "19+"]
    assert v(text.hashtags(F.lit("#One #one #x"))) == ["one"]
    assert v(text.domain(F.lit("https://www.Example.org/a?b"))) == "example.org"
    assert v(text.strip_html(F.lit("<p>a &amp; b</p>\n<br>c"))) == "a & b c"
    assert v(text.csv_field(F.lit('=1,"x"'))) == '"\'=1,""x"""'
    has = lambda title, lang: {k for k, c in text.title_features(F.lit(title), F.lit(lang)).items() if v(c)}
    assert has("5 cats \U0001F600?", "en") == {"question", "number", "emoji", "listicle"}
    assert has("Why YOU need (3) tips!", "en") == {"exclaim", "number", "bracket", "shout", "you", "listicle"}
    assert has("Your tips", "de") == set() and has("تو", "fa") == {"you"} and has("a #tag", None) == {"hashtag"}
    assert v(text.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)) == ["a b", "b c"]
    assert v(text.ngrams(F.array(F.lit("a")), 2)) == []
    assert v(text.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0


def test_images():
    flat = images.features_of(bytes([200, 100, 50] * 4))
    assert flat == pytest.approx(((0.299 * 200 + 0.587 * 100 + 0.114 * 50) / 255, 0.0, 0.75, 0.8, 1.0), abs=1e-9)
    assert images.features_of(b"ab") is None and images.features_of(None) is None and images.features_of(bytes(6)) == (0.0, 0.0, 0.0, 0.5, 0.0)
    head = bytes.fromhex("FFD8FFE000040000FFC0000B080010002003")
    assert images.jpeg_size(head) == (32, 16) and images.jpeg_size(head[:15]) is None and images.jpeg_size(b"<html>") is None
    assert images.jpeg_size(head[:2] + b"\xff\xff\xd0" + head[2:]) == (32, 16)


def test_languages(spark):
    v = lambda s: tuple(value(spark, languages.detect(F.lit(s))))
    assert v("The cat is on the table and it was not there")[0] == "en" and v("The cat is on the table and it was not there")[1] > 0.4
    assert v("Der Hund und die Katze sind nicht im Haus")[0] == "de" and v("Le chat est dans une maison avec des amis")[0] == "fr"
    assert v("El perro y los gatos están en una casa por la noche")[0] == "es"
    assert v("Привет мир это текст") == ("ru", 0.85) and v("これはテストです、はい")[0] == "ja" and v("이것은 시험 문장입니다") == ("ko", 0.9)
    assert v("سلام دنیا چطوری گل")[0] == "fa" and v("مرحبا بالعالم هذا نص")[0] == "ar"
    assert v("short") == (None, 0.0) and v("12345 6789 !!") == (None, 0.0) and v("oneword12345") == (None, 0.0)
    assert value(spark, languages.country_of(F.lit("ja"), F.lit(0.9), {"ja": "JP"})) == ("JP", 0.35)


def test_simhash_is_near_for_near_texts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = spark.createDataFrame([(words, words[:-1] + ["new"], [f"z{i}" for i in range(60)])], "a array<string>, b array<string>, c array<string>")
    h = rows.select(text.simhash("a").alias("a"), text.simhash("b").alias("b"), text.simhash("c").alias("c"))
    near, far = h.select(text.hamming(F.col("a"), F.col("b")), text.hamming(F.col("a"), F.col("c"))).first()
    assert near <= 8 < 15 < far


def test_dates(spark):
    v = lambda c: value(spark, c)
    assert v(dates.iso_duration_seconds(F.lit("PT1H2M3S"))) == 3723 and v(dates.iso_duration_seconds(F.lit("x"))) is None
    assert v(dates.weekday(F.lit(NOW))) == 3 and v(dates.hour(F.lit(NOW), "Asia/Tehran")) == 3
    assert v(dates.quiet(F.lit(23), 22, 7)) and not v(dates.quiet(F.lit(12), 22, 7))


def test_parsing(spark):
    v = lambda c: value(spark, c)
    assert v(parsing.compact_count(F.lit("14.7M"))) == 14700000 and v(parsing.compact_count(F.lit("20K+"))) == 20000 and v(parsing.compact_count(F.lit("none"))) is None
    assert tuple(v(parsing.headline(F.lit("A - b - Paper")))) == ("A - b", "Paper")
    assert tuple(v(parsing.headline(F.lit("A - " + "p" * 57)))) == ("A", "p" * 57)
    assert tuple(v(parsing.headline(F.lit("A - " + "p" * 58)))) == ("A - " + "p" * 58, None)
    feed = "<rss><item><title><![CDATA[A &amp;amp; B]]></title><link>http://x</link><pubDate>Thu, 01 Jan 2026 12:00:00 GMT</pubDate></item></rss>"
    item = v(parsing.feed_items(F.lit(feed)))[0]
    assert item["title"] == "A & B" and item["link"] == "http://x" and v(parsing.feed_date(F.lit(item["published"]))) == 1767268800


def test_merge_rules(spark):
    rows = spark.createDataFrame([("k", 1, "a", None, 5), ("k", 2, None, "x", 3), ("k", 3, "c", None, 4)], "key string, seen long, a string, b string, n long").withColumn("first_a", F.col("a")).withColumn("last_b", F.col("b"))
    got = tables.merged(rows, ["key"], "seen", {"a": "last", "first_a": "first", "b": "newest", "last_b": "last", "n": "max"}).first()
    assert (got["a"], got["first_a"], got["b"], got["last_b"], got["n"]) == ("c", "a", "x", None, 5)


def test_lag_join_ignores_gaps(spark):
    hours = spark.createDataFrame([("k", 0, 5), ("k", 7200, 9)], "keyword string, hour long, mentions long")
    got = {r["hour"]: r["before"] for r in tables.keyword_breakouts(hours).collect()}
    assert got == {0: 0, 7200: 0}


def test_ranked_pages_do_not_overlap(spark):
    rows = spark.createDataFrame([(i, 1.0, None) for i in range(30)], "id long, score double, lang string")
    pages = [[r["id"] for r in ranking.page(rows, ranking.RankedQuery(limit=10, offset=o, languages=["en"])).collect()] for o in (0, 10, 20)]
    assert sorted(sum(pages, [])) == list(range(30))
    assert ranking.count(rows, ranking.RankedQuery(limit=10)).first()["total"] == 30


def test_topics_join_shared_stories(spark):
    rows = [(1, "volcano eruption iceland tonight"), (2, "volcano eruption iceland flights"), (3, "chess final winner"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "id long, title string")
    got = {r["id"]: r["component"] for r in clusters.topics(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_topics_span_sources_and_follow_all_three_rules(spark):
    base = [f"word{i}" for i in range(30)]
    rows = [(1, "a", " ".join(base)), (2, "b", " ".join(base)), (3, "c", " ".join(base[:-1] + ["other"]))] + [(10 + i, "z", f"lone{i} thing{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, source string, title string")
    got = {r["id"]: r["component"] for r in clusters.topics(docs).collect()}
    assert got[1] == got[2] == got[3] == 1 and all(got[10 + i] == 10 + i for i in range(20))


def test_many_copies_are_one_topic(spark):
    docs = spark.createDataFrame([(i, "same seven words stand in every title") for i in range(260)], "id long, title string")
    assert {r["component"] for r in clusters.topics(docs).collect()} == {0}


def test_reposts_are_exact(spark):
    import random

    rng = random.Random(3)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [rng.getrandbits(64) for _ in range(40)]
    for h in list(hashes):
        for bits in (0, 3, 6, 7):
            hashes.append(h ^ sum(1 << b for b in rng.sample(range(64), bits)))
    rows = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hashes)] + [(900, 0), (901, 0)], "id long, simhash long")
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    want = {(first[h], i, 0) for i, h in enumerate(hashes) if first[h] != i}
    distinct = sorted((i, h) for h, i in first.items())
    want |= {(a, b, (x ^ y).bit_count()) for a, x in distinct for b, y in distinct if a < b and (x ^ y).bit_count() <= 6}
    assert {tuple(r) for r in clusters.reposts(rows).collect()} == want


def test_components_that_do_not_settle_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        clusters.components(edges, max_rounds=2)


def test_labels(spark):
    v = lambda c: value(spark, c)
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    assert v(clusters.label(words("air condition", "condition luxury", "luxury necessity", "rome", "x", "paris", "oslo"))) == "Air Condition · Rome · Paris"
    assert v(clusters.label(words("x"))) == "unlabelled"
    assert v(clusters.keyword_key(words("b c", "a", "d", "c", "e"))) == "a|b_c|c|d"


def test_quantiles_are_exact_whatever_the_key_sizes(spark):
    import random

    rng = random.Random(4)
    rows = [("hot", rng.choice([rng.uniform(-5, 5), rng.expovariate(1e-4), 0.0])) for _ in range(3000)] + [("two", 1.0), ("two", 4.0), ("one", -3.5), (None, 7.0), (None, 9.0), ("none", None)]
    got = {r["k"]: r for r in baselines.source_quantiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"]).collect()}
    assert set(got) == {"hot", "two", "one", None}
    for k, r in got.items():
        values = sorted(v for key, v in rows if key == k)
        for p in (50, 75, 90, 99):
            at = (len(values) - 1) * p / 100
            want = values[int(at)] + (values[min(int(at) + 1, len(values) - 1)] - values[int(at)]) * (at - int(at))
            assert r[f"p{p}"] == pytest.approx(want, rel=1e-9) and r["n"] == len(values)


def test_stream_state_spans_micro_batches(spark, tmp_path):
    from tidemark.streaming import stateful

    for i, rows in enumerate([[(1, 5.0, 10), (2, 1.0, 11)], [(1, 9.0, 20)], [(1, 7.0, 30), (2, None, 31)]]):
        spark.createDataFrame(rows, "author long, value double, t long").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("author long, value double, t long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {r["author"]: (r["peak"], r["peak_at"], r["observations"]) for r in stateful.drained(spark, stateful.peaks(stream), "update", ["author"], "observations").collect()}
    assert got == {1: (9.0, 20, 3), 2: (1.0, 11, 1)}


def test_plan_prunes_and_pushes_down(spark, small):
    plan = spark.read.parquet(f"{small}/lineitem.parquet").where("l_quantity > 10").select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
