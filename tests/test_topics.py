"""Topics: copies as one text, strongest-first rounds, close vectors, merging by meaning."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import mathx as m
from tidemark.operators import clusters, leaders, topic_reads, vectors
from tidemark.sources.tables import written

WORDS = "volcano eruption iceland flights ash cloud chess final winner match election vote count river flood rescue budget tax reform star concert ticket".split()


def titles(seed, n):
    """Stories retold with words swapped, dropped and added."""
    rng = random.Random(seed)
    stories = [rng.sample(WORDS, 6) for _ in range(n // 6)]
    out = []
    for i in range(n):
        words = list(rng.choice(stories))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        if rng.random() < 0.3:
            words.pop()
        out.append((i, " ".join(words), float(rng.randrange(40))))
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, score double")


def test_copies_are_one_text(spark):
    rows = [(3, "Chess final winner!", 1.0), (1, "chess, final winner", 2.0), (2, "winner final chess", 1.0), (7, None, 0.0), (8, "the of", 0.0), (9, "", None)]
    members, texts = clusters.text_classes(table(spark, rows))
    assert {r["id"]: r["first"] for r in members.collect()} == {1: 1, 3: 1, 2: 2, 7: 7, 8: 7, 9: 7}
    assert {r["id"]: r["copies"] for r in texts.collect()} == {1: 2, 2: 1, 7: 3}


def test_equal_titles_make_no_pairs(spark):
    """2,000 equal titles and 300 orders of another give a link an item, not one a pair."""
    rng = random.Random(1)
    rows = [(i, "same seven words stand in every title", 1.0) for i in range(2000)]
    rows += [(3000 + i, " ".join(rng.sample(WORDS[:7], 7)), 1.0) for i in range(300)]
    links = clusters.topic_links(table(spark, rows[:2000]))
    assert links.count() == 1999
    overlap = clusters.overlapping_pairs(clusters.stemmed(table(spark, rows)))
    assert overlap.count() == 1999 + 299
    assert {r["component"] for r in clusters.topics(table(spark, rows[:2000])).collect()} == {0}


def test_weights_count_copies(spark):
    rows = titles(2, 60) + [(100 + i, "volcano eruption iceland", 0.0) for i in range(9)]
    docs = table(spark, rows)
    members, texts = clusters.text_classes(docs)
    first = {r["id"]: r["first"] for r in members.collect()}
    plain = {(r["id"], r["term"]): (r["df"], round(r["weight"], 9)) for r in clusters.tfidf(docs).collect() if first[r["id"]] == r["id"]}
    assert {(r["id"], r["term"]): (r["df"], round(r["weight"], 9)) for r in clusters.weighted(texts).collect()} == plain


def cosine(mean, vector):
    length = math.sqrt(sum(x * x for x in mean.values()))
    return sum(w * mean.get(term, 0.0) for term, w in vector.items()) / length if length else 0.0


def replayed(nodes, vector, links, threshold):
    """The rounds of ``leaders.elected``, on dictionaries."""
    strength = lambda i: (-nodes[i][0], i)
    ups = {i: {} for i in nodes}
    for a, b, firm in links:
        up, down = sorted((a, b), key=strength)
        ups[down][up] = max(ups[down].get(up) or 0.0, firm or 0.0)
    leader = {i: (i, 1.0) for i in nodes if not ups[i]}
    while len(leader) < len(nodes):
        means = {}
        for i, (top, _) in leader.items():
            for term, w in vector[i].items():
                means.setdefault(top, {}).setdefault(term, 0.0)
                means[top][term] += w * nodes[i][1]
        made = {}
        for i in nodes:
            if i in leader or not (all(u in leader for u in ups[i]) or any(u in leader and leader[u][0] == u for u in ups[i])):
                continue
            sims = {}
            for u, firm in ups[i].items():
                if u in leader:
                    top = leader[u][0]
                    sims[top] = max(sims.get(top, 0.0), firm, round(cosine(means[top], vector[i]), 9))
            best = min(((-round(s, 9), top) for top, s in sims.items() if round(s, 9) >= threshold), default=None)
            if best:
                made[i] = (best[1], -best[0])
            elif all(u in leader for u in ups[i]):
                made[i] = (i, 1.0)
        assert made
        leader |= made
    return leader


def one_by_one(nodes, vector, links, threshold):
    """Strongest first, each to the topic whose running mean or firm members are most similar."""
    firm = {}
    for a, b, f in links:
        if f:
            firm[a, b] = firm[b, a] = max(f, firm.get((a, b), 0.0))
    topics = []
    for i in sorted(nodes, key=lambda i: (-nodes[i][0], i)):
        best, at = 0.0, None
        for topic in topics:
            sim = max([cosine(topic["mean"], vector[i]), *(firm.get((i, j), 0.0) for j in topic["items"])])
            if sim > best:
                best, at = sim, topic
        if at is not None and best >= threshold:
            n = at["n"]
            for term, w in vector[i].items():
                at["mean"][term] = (at["mean"].get(term, 0.0) * n + w) / (n + 1)
            at["n"] += 1
            at["items"].append(i)
        else:
            topics.append({"mean": dict(vector[i]), "n": 1, "items": [i]})
    return {i: t["items"][0] for t in topics for i in t["items"]}


def parts_of(spark, rows):
    members, texts = clusters.text_classes(table(spark, rows))
    copies = {r["id"]: r["copies"] for r in texts.collect()}
    first = {r["id"]: r["first"] for r in members.collect()}
    nodes = {}
    for i, _, score in rows:
        top = nodes.get(first[i], (float("-inf"), 0))[0]
        nodes[first[i]] = (max(top, score), copies[first[i]])
    weights = clusters.weighted(texts)
    vector = {i: {} for i in nodes}
    for r in weights.collect():
        vector[r["id"]][r["term"]] = r["weight"]
    links = [(r["a"], r["b"], None) for r in clusters.similar_pairs(weights).collect()] + [tuple(r) for r in leaders.firm_links(texts).collect()]
    return nodes, vector, links, first


def test_rounds_are_replayed_and_near_the_sequential_pass(spark):
    rows = titles(5, 150) + [(900 + i, "river flood rescue tonight", float(i)) for i in range(12)]
    nodes, vector, links, first = parts_of(spark, rows)
    expected = replayed(nodes, vector, links, clusters.THRESHOLD)
    got = {r["id"]: (r["leader"], r["similarity"]) for r in leaders.led_topics(table(spark, rows)).collect()}
    assert {i: got[i][0] for i in got} == {i: expected[first[i]][0] for i in got}
    assert all(got[i][1] == pytest.approx(expected[first[i]][1], abs=1e-6) for i in got)
    assert 5 < len({top for top, _ in got.values()}) < 60
    # pairs of texts that both passes put together, or both apart
    order = one_by_one(nodes, vector, links, clusters.THRESHOLD)
    pairs = list(itertools.combinations(sorted(nodes), 2))
    alike = sum((order[a] == order[b]) == (expected[a][0] == expected[b][0]) for a, b in pairs)
    joined = [(order[a] == order[b], expected[a][0] == expected[b][0]) for a, b in pairs]
    both, either = sum(x and y for x, y in joined), sum(x or y for x, y in joined)
    print(f"agreement with the sequential pass: {alike / len(pairs):.4f}, of pairs that either joins {both / either:.4f}")
    assert alike / len(pairs) > 0.95 and both / either > 0.5


def test_topics_of_small_inputs_equal_the_sequential_pass(spark):
    rows = [(1, "volcano eruption iceland tonight", 9.0), (2, "volcano eruption iceland flights", 5.0), (3, "volcano eruption iceland flights", 8.0), (4, "chess final winner", 7.0), (5, None, None), (6, "", 1.0), (7, "eruption iceland flights", None)]
    got = {r["id"]: r["leader"] for r in leaders.led_topics(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 1}
    assert leaders.led_topics(table(spark, [])).collect() == []


def test_a_crowd_takes_two_rounds(spark, monkeypatch):
    """A hundred texts that are all alike do not wait for one another."""
    rows = [(i, f"volcano eruption iceland flights ash cloud extra{i}", float(i)) for i in range(100)]
    names = []
    plain = leaders.written
    monkeypatch.setattr(leaders, "written", lambda df, name: names.append(name) or plain(df, name))
    got = {r["leader"] for r in leaders.led_topics(table(spark, rows)).collect()}
    assert got == {99} and sum(n.startswith("ready-") for n in names) == 1


@pytest.mark.parametrize("threshold, block", [(0.9, 7), (0.5, 16), (0.05, 2048)])
def test_close_vectors_are_brute_force(spark, threshold, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6))
    v = [list(map(float, base[i % 40] + rng.normal(size=6) * 0.4)) for i in range(150)] + [list(map(float, rng.normal(size=3))) for _ in range(20)]
    rows = [*enumerate(v), (500, v[3]), (501, v[3]), (502, None), (503, [0.0] * 6), (504, []), (505, [float("nan")] * 6), (506, [2 * x for x in v[4]])]
    got = {(r["a"], r["b"]): r["similarity"] for r in vectors.similar_vectors(spark.createDataFrame(rows, "id long, c array<double>"), threshold, block=block).collect()}
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if x and any(x) and not any(map(math.isnan, x))}
    firsts = {}
    for i in sorted(unit):
        firsts.setdefault(tuple(np.round(unit[i], 12)), i)
    first = {i: firsts[tuple(np.round(unit[i], 12))] for i in unit}
    expected = {(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold and (first[a] == a and first[b] == b or first[b] == a)}
    near = {p for p in set(got) ^ expected if abs(unit[p[0]] @ unit[p[1]] - threshold) > 1e-9}
    # a vector and its double are the same text of numbers only up to rounding
    assert {p for p in near if {first[p[0]], first[p[1]]} != {4} and 506 not in p} == set()
    assert all(s == pytest.approx(unit[a] @ unit[b], abs=1e-9) for (a, b), s in got.items())


def test_merging_names_the_strongest_topic(spark):
    centres = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.75, 0.35]), (4, [0.0, 1.0])], "component long, c array<double>")
    strength = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 9.0), (4, 1.0), (5, None)], "component long, score double")
    got = {r["component"]: r["merged"] for r in topic_reads.merged_topics(centres, strength).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 4, 5: 5}  # 1 and 3 meet through 2; a topic without a centroid stays
    members = spark.createDataFrame([(10, 1), (11, 3), (12, 5)], "id long, component long")
    merged = topic_reads.merged_topics(centres, strength)
    assert {r["id"]: r["component"] for r in topic_reads.contracted(members, merged).collect()} == {10: 2, 11: 2, 12: 5}


def test_vectors_are_scaled_once(spark, monkeypatch):
    """A vector's length is no part of the work at each of its places, and rows are scaled in one pass."""
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, []), (4, None), (5, [1.0, 2.0, 2.0])], "id long, v array<double>")
    scaled = rows.select("id", m.normalised(F.col("v")).alias("v"))
    assert {r["id"]: r["v"] for r in scaled.collect()} == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: [], 4: None, 5: [1 / 3, 2 / 3, 2 / 3]}
    per_place = [p for p in scaled._jdf.queryExecution().optimizedPlan().toString().split("lambdafunction(") if " / " in p]
    assert per_place and all("aggregate" not in p.split(" / ")[1][:60] for p in per_place)
    calls = []
    monkeypatch.setattr(vectors, "written", lambda df, name: calls.append(name.split("-")[0]) or written(df, name), raising=False)
    assert vectors.similar_vectors(rows.withColumnRenamed("v", "c"), 0.5).collect() == []
    assert calls == ["units", "firsts"]
