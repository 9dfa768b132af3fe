"""Steps whose work must not outgrow the input, against brute force."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import languages
from tidemark.functions import text as t
from tidemark.operators import baselines, clusters, gaps, search
from tidemark.plans import catalog
from tidemark.sources.tables import written


def explained(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_crowded_hashes_meet_in_blocks(spark, monkeypatch):
    """All hashes share six of the seven parts; blocks are smaller than their number."""
    rng = random.Random(5)
    base = 0x0123456789ABCDEF
    rows = [(i, base ^ sum(1 << at for at in rng.sample(range(55, 63), rng.randrange(3)))) for i in range(90)]
    rows += [(100 + i, rng.getrandbits(63) | 1 << 40) for i in range(60)] + [(200, 0), (201, -(1 << 63)), (202, -(1 << 63) | 7)]
    monkeypatch.setattr(clusters, "BLOCK", 16)
    got = sorted(tuple(r) for r in clusters.reposts(spark.createDataFrame(rows, "id long, simhash long")).collect())
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = [(first[h], i, 0) for i, h in rows if h and first[h] != i]
    some = sorted((i, h) for h, i in first.items() if h)
    want += [(i, j, ((g ^ h) & (1 << 64) - 1).bit_count()) for i, g in some for j, h in some if i < j and ((g ^ h) & (1 << 64) - 1).bit_count() <= 6]
    assert got == sorted(want)


def test_proposed_overlaps_carry_no_words(spark):
    """Sets are joined by places and sizes; words only meet pairs that these leave."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, rng.sample(words[: rng.choice([12, 40])], rng.randrange(1, 12))) for i in range(150)]
    found = clusters.overlapping_pairs(spark.createDataFrame(rows, "id long, w array<string>"))
    joins = [line for line in explained(found).splitlines() if "Join" in line and "key" in line]
    assert joins and all("w_a" not in line for line in joins)
    got = {(r["a"], r["b"]): round(r["jaccard"], 9) for r in found.collect()}
    first = {}
    for i, w in rows:
        first.setdefault(frozenset(w), i)
    want = {(first[frozenset(w)], i): 1.0 for i, w in rows if first[frozenset(w)] != i}
    sets = sorted((i, s) for s, i in first.items())
    want |= {(i, j): round(len(x & y) / len(x | y), 9) for i, x in sets for j, y in sets if i < j and len(x & y) / len(x | y) >= 0.55}
    assert got == want


TEXTS = ["The flood and the river in the city", "la casa de mi amigo es muy grande", "le chat et la souris dans une maison", "der Hund und die Katze", "короткий текст на русском языке", "これはテストです 東京", "یک متن کوتاه برای آزمایش", "نص قصير للاختبار", "abc", "", None, "12345678 90", "ﬂood １２ ﬂood the", "x" * 700 + " the and of"]


def test_language_columns_are_the_expression(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, body string")
    want = {r["id"]: r["g"] for r in rows.select("id", languages.detect(F.col("body")).alias("g")).collect()}
    lean = languages.detected(rows, F.col("body"), "g")
    assert lean.columns == ["id", "body", "g"]
    assert {r["id"]: r["g"] for r in lean.collect()} == want
    # the text is normalised once, not anew for every word list
    assert explained(lean).count("https?://") <= 2


def test_texts_are_digested_without_lists_of_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(90, "東京都 東 #Flood @who 7 77 a bb bb")], "id long, body string")
    rows = written(rows.select("id", t.normalise(F.col("body")).alias("n")), "digested")
    rows = written(rows.select("id", "n", t.content_tokens(t.tokens(F.col("n"))).alias("w")), "listed")
    old = {r["id"]: (r["d"], r["s"]) for r in rows.select("id", t.token_digest("w").alias("d"), t.simhash("w").alias("s")).collect()}
    new = {r["id"]: (r["d"], r["s"]) for r in rows.select("id", t.text_digest("n").alias("d"), t.text_simhash("n").alias("s")).collect()}
    assert new == old


def test_shared_words_are_counted_in_both_ways(monkeypatch):
    """Words of many topics and of few, whatever the bound between them and the matches at once."""
    rng = random.Random(2)
    some = lambda n: [rng.sample("abcdefghijklmnop", rng.randrange(9)) if i % 7 else None for i in range(n)]
    topics, items = some(30), some(50)
    want = [[len(set(x or ()) & set(y or ())) for y in items] for x in topics]
    for common, matches in ((256, 1 << 22), (0, 4), (4, 3)):
        monkeypatch.setattr(gaps, "COMMON", common)
        monkeypatch.setattr(gaps, "MATCHES", matches)
        codes = {}
        sides = [gaps._words(pa.chunked_array([pa.array(x, pa.list_(pa.string()))]), codes, np.arange(len(x))) for x in (topics, items)]
        assert gaps._shared(*sides).tolist() == want


def test_words_are_counted_in_their_row(spark):
    """Rows of an id of its own move no words; those that share one, or none, count together."""
    rows = [(1, "flood river flood 東京都"), (2, "b1 a1 b1 c1 " * 3 + " ".join(f"z{i}" for i in range(12))), (3, "flood a1"), (3, "a1 river"), (None, "x1 y1"), (None, "y1"), (4, None), (5, "the of")]
    df = spark.createDataFrame(rows, "id long, body string")
    got = sorted(((r["id"] or 0, r["place"], r["term"], r["n"]) for r in t.top_words(df, F.col("body")).collect()))
    counts = {}
    for r in t.content_words(df, F.col("body"), "id").groupBy("id", "term").count().collect():
        counts.setdefault(r["id"] or 0, []).append((-r["count"], r["term"]))
    assert got == sorted((i, place, term, -n) for i, some in counts.items() for place, (n, term) in enumerate(sorted(some)[:10], 1))


def test_topics_of_crowded_hashes_and_long_titles(spark, monkeypatch):
    """Topics do not depend on the size of a block, and one long title moves no words with its proposals."""
    rng = random.Random(8)
    words = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(4, 9)))) for i in range(60)] + [(99, " ".join(f"long{i:04d}x" for i in range(800)))]
    docs = spark.createDataFrame(rows, "id long, title string")
    want = sorted(map(tuple, clusters.topics(docs).collect()))
    monkeypatch.setattr(clusters, "BLOCK", 4)
    assert sorted(map(tuple, clusters.topics(docs).collect())) == want and (99, 99) in want


def test_daily_scores_are_added_in_the_order_of_events(spark, tmp_path):
    """The rows of a day lie in files in falling order; its sum has the bits of the rising one."""
    rng = random.Random(9)
    rows = [(i, 1704067200 + i % 3 * 86400, i % 5, round(rng.random() * 100, 2)) for i in range(600)]
    for part in range(4):
        some = spark.createDataFrame(rows[::-1][part * 150 : part * 150 + 150], "event_id long, t long, user_id long, value double").coalesce(1)
        some.selectExpr("event_id", "timestamp_seconds(t) as ts", "user_id", "'view' as event_type", "value", "'{}' as props").write.mode("append").parquet(f"{tmp_path}/events.parquet")
    want = {}
    for _, day, user, value in rows:
        want[user, day] = want.get((user, day), 0.0) + value
    assert {(r["id"], r["day"]): r["score"] for r in catalog._daily(spark, str(tmp_path)).collect()} == want


def test_reposts_of_items_with_names(spark):
    """Items called by name meet as numbered ones do; the smaller name comes first."""
    rng = random.Random(6)
    base = 0x0123456789ABCDEF
    rows = [(f"click:{99 - i}", base ^ sum(1 << at for at in rng.sample(range(63), rng.randrange(4)))) for i in range(40)] + [("view:1", base), ("view:2", base)]
    got = {tuple(r) for r in clusters.reposts(spark.createDataFrame(rows, "id string, simhash long")).collect()}
    first = {}
    for i, h in sorted(rows):
        first.setdefault(h, i)
    want = {(first[h], i, 0) for i, h in rows if first[h] != i}
    want |= {(i, j, (g ^ h).bit_count()) for g, i in first.items() for h, j in first.items() if i < j and (g ^ h).bit_count() <= 6}
    assert got == want


def test_older_items_do_not_leave_the_sample(spark):
    """A row behind the newest takes nothing out, also if the sample holds its value; rows of the
    sample pass over one value, and no row carries an array of the others."""
    rng = random.Random(8)
    rows = [(i, 1, float(rng.randrange(5)), i) for i in range(20)] + [(20 + i, 2, None if i == 2 else float(i), i) for i in range(6)]
    out = baselines.leave_one_out(spark.createDataFrame(rows, "id long, author long, value double, published_at long"), newest=8)
    want = {}
    for i, author, value, _ in rows:
        others = [v for j, a, v, _ in sorted([r for r in rows if r[1] == author and r[2] is not None], key=lambda r: -r[3])[:8] if j != i]
        want[i] = (len(others), float(np.quantile(others, 0.5)), float(np.quantile(others, 0.9)))
    got = {r["id"]: (r["n"], r["median"], r["p90"]) for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[i], want[i]) for i in want)


def test_postings_leave_a_task_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(search, "_HELD", 100)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(50)] + [None, "ab"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "body": texts})
    out = list(search._postings(["body"])([batch]))
    assert len(out) > 10 and max(sum(len(p) for p in b["positions"].to_pylist()) for b in out) < 200
    got = {(g, i): p for b in out for g, i, p in zip(b["gram"].to_pylist(), b["id"].to_pylist(), b["positions"].to_pylist())}
    want = {}
    for i, text in enumerate(texts):
        for at, g in enumerate(search.grams(text or "").tolist()):
            want.setdefault((g, i), []).append(at)
    assert got == want


def test_texts_are_parsed_in_one_pass(spark):
    texts = ["Running runners ran; the stories 42 @you flying", "", "日本語の本 classes bosses ties lies", "É CAFÉ caffè nation wander_ed", None, "abbed inging ssss2 passes y1 cy e"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, title string")
    raw = t.content_tokens(t.words_of(F.coalesce("title", F.lit(""))))
    plain = {r["id"]: (r["raw"], r["w"]) for r in rows.select("id", raw.alias("raw"), t.stems(raw).alias("w")).collect()}
    assert {r["id"]: (r["raw"], r["w"]) for r in rows.select("id", t.parsed(t.normalise(F.col("title"))).alias("p")).select("id", "p.*").collect()} == plain


def test_terms_are_counted_in_their_row(spark, monkeypatch):
    monkeypatch.setattr(clusters, "_TERMS", 4)
    batch = pa.RecordBatch.from_pydict({"id": [7, 8, 9], "copies": [1, 2, 1], "w": [["a", "b", "a", "b"], ["c"], ["a", "a", "a"]]})
    out = list(clusters._term_uses(iter([batch])))
    got = [r for b in out for r in b.to_pylist()]
    assert len(out) == 2 and all(b.schema.names == ["id", "copies", "term", "tf"] for b in out)
    assert {(r["id"], r["copies"], r["term"], r["tf"]) for r in got} == {(7, 1, "a", 0.5), (7, 1, "b", 0.5), (7, 1, "a b", 0.75), (7, 1, "b a", 0.375), (8, 2, "c", 1.0), (9, 1, "a", 1.0), (9, 1, "a a", 1.0)}


def test_proposed_cosines_carry_no_vectors(spark, monkeypatch):
    """All pairs of brute force, and no array or map where proposals are made."""
    rng, tables = random.Random(5), {}
    monkeypatch.setattr(clusters, "written", lambda df, name: tables.setdefault(name.split("-")[0], written(df, name)))
    rows = []
    for item in range(150):
        terms = rng.sample([f"t{k}" for k in range(40)], 5) + [f"own{item}"]
        weights = np.array([rng.random() + 0.1 for _ in terms])
        rows += [(item, term, float(w)) for term, w in zip(terms, weights / np.linalg.norm(weights))]
    df = {term: sum(r[1] == term for r in rows) for _, term, _ in rows}
    table = spark.createDataFrame([(i, term, df[term], w) for i, term, w in rows], "id long, term string, df long, weight double")
    vectors = {i: {term: w for j, term, w in rows if j == i} for i in range(150)}
    dot = lambda a, b: sum(w * vectors[b].get(term, 0.0) for term, w in vectors[a].items())
    expected = {(a, b): dot(a, b) for a in range(150) for b in range(a + 1, 150) if dot(a, b) >= 0.34}
    got = {(r["a"], r["b"]): r["similarity"] for r in clusters.similar_pairs(table).collect()}
    assert set(got) == set(expected) and all(abs(got[p] - expected[p]) < 1e-9 for p in got)
    spread = tables["spread"]
    assert spread.columns == ["term", "id", "weight", "rest"] and spread.where("term like 'own%'").isEmpty()


def test_names_of_topics_read_the_texts_once(spark, small, monkeypatch):
    calls = []
    plain = t.normalise
    monkeypatch.setattr(t, "normalise", lambda text: calls.append(1) or plain(text))
    catalog.QUERIES["topic_names"](spark, small)
    assert len(calls) == 1


def test_postings_travel_in_one_row_a_bucket(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdéё ") for _ in range(400)) for _ in range(60)] + [None, "ab"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "body": texts})
    plain = [r for b in search._postings(["body"])([batch]) for r in b.to_pylist()]
    parcels = list(search._parcels(["body"], 8)([batch]))
    assert sum(b.num_rows for b in parcels) <= 8 and sum(b.nbytes for b in parcels) < 0.4 * sum(b.nbytes for b in search._postings(["body"])([batch]))
    opened = [r for b in search._opened(iter(parcels)) for r in b.to_pylist()]
    key = lambda r: (r["gram"], r["id"])
    assert sorted(({k: r[k] for k in ("gram", "field", "id", "positions")} for r in opened), key=key) == sorted(plain, key=key)
    grams = spark.createDataFrame([(r["gram"], r["bucket"]) for r in opened], "gram bigint, bucket int").distinct()
    assert grams.where(search.TrigramIndex(spark, "", 8)._bucket() != F.col("bucket")).isEmpty()
