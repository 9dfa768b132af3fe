"""Operators against brute force, and their defined results on odd inputs."""

import hashlib
import json
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.oracle import assert_same, views
from tidemark.llm import bpe, catalog, chat, common, embeddings, fingerprints, language, mixing, near_dedup, packing, pretoken, sharding, shingles, toxicity

SPEC = bpe.read_spec(public_tokenizers.path("byte_bpe_50k.json"))
DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, score double, n long"


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_str(SPEC)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(20000))
    texts = [None, "", " \n\t ", "one", "same text here for all of us", "same text here for all of us", long, "Ünïcode ﬁ ½ 中文 text\r\n\ttabs", "<|endoftext|> a  b <|end|>\n"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), 7, 0.5, 3) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def base(rng, n):
    return [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(400)) for _ in range(n)]


# ── shingles and near-duplicates ─────────────────────────────────────────────


def brute_classes(texts):
    sets = {i: shingles.exact_shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_hashed_shingles_count_exactly():
    texts = [None, "", "a b", "A  B c\td e f", "x " * 50, "é " + "w " * 9]
    rows, hashes = shingles.hashed_shingles(texts)
    assert np.bincount(rows, minlength=len(texts)).tolist() == [len(shingles.exact_shingles(t)) for t in texts]
    assert len(hashes) == len(rows)


def test_near_duplicates_are_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for family in range(12):
        words = base(rng, rng.choice([3, 8, 40, 120, 700]))
        for _ in range(9):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    passage = " ".join(base(rng, 60))
    for _ in range(25):
        texts[len(texts)] = passage + " " + " ".join(base(rng, 50))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(texts)


def test_short_sets_lose_no_link(spark):
    """Sizes 1 to 40, pairs at 0.75 exactly, just above and just below: no link is lost."""
    rng, texts = random.Random(12), {}
    for size in range(1, 41):
        for drop in range(0, size // 3 + 1):
            words = [f"w{rng.randrange(10**9)}" for _ in range(size + 4)]
            texts[len(texts)] = " ".join(words)
            texts[len(texts)] = " ".join(words[: len(words) - drop])
    for _ in range(200):  # 8 words and their first 7: 3 of 4 shingles
        words = [f"w{rng.randrange(10**9)}" for _ in range(8)]
        texts[len(texts)], texts[len(texts)] = " ".join(words), " ".join(words[:7])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute_classes(texts)


@pytest.mark.parametrize("a, b, common", [(3, 4, 3), (6, 8, 6), (30, 40, 30), (108, 144, 108), (192, 256, 192), (195, 260, 195), (280, 280, 240), (700, 700, 600)])
def test_bands_recall_sets_of_every_size(a, b, common):
    rng, pairs = np.random.default_rng(a), 400
    every = [rng.integers(0, 2**64, a + b - common, dtype=np.uint64) for _ in range(pairs)]
    hashes = [np.sort(x) for h in every for x in (h[:a], h[a - common :])]
    raw = near_dedup.registers_of(np.repeat(np.arange(2 * pairs), [a, b] * pairs), np.concatenate(hashes), 2 * pairs)
    small = max(a, b) <= near_dedup.SMALL_TO
    reg = near_dedup._matrix(raw, small)
    keys = near_dedup.band_keys(reg, small)
    assert (keys[::2] == keys[1::2]).any(axis=1).all()
    near = near_dedup.estimate(reg[::2], reg[1::2], np.full(pairs, a), np.full(pairs, b), small)
    assert near.min() >= 0.5 and abs(near.mean() - common / (a + b - common)) < 0.01


def test_ids_with_several_texts_are_one_document(spark):
    t, u, v, w = (" ".join(f"{c}{i}" for i in range(30)) for c in "tuvw")
    rows = [(3, t), (5, t), (5, u), (7, u), (None, t), (9, v), (9, w), (11, w), (9, v), (12, None), (12, v), (13, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {(r["id"], r["component_id"], r["kept"]) for r in got} == {(3, 3, True), (5, 3, False), (7, 3, False), (None, None, True), (9, 9, True), (11, 9, False), (12, 9, False), (13, 13, True)}


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == odd.count() and by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0
    assert by[1]["component_id"] == 1 and by[5]["component_id"] == 4 and not by[5]["kept"] and by[4]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert near_dedup.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_gapless_numbers(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, "hot").when(F.col("id") < 4990, F.lit(None)).otherwise("few").alias("k"))
    got = common.gapless_number(rows, ["k"], ["id"], "no", rows_per_chunk=100).collect()
    for key in ("hot", None, "few"):
        mine = sorted(r["no"] for r in got if r["k"] == key)
        assert mine == list(range(len(mine)))


# ── toxicity ─────────────────────────────────────────────────────────────────


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(3)
    rude = ["gromblat", "snarfig", "pukzomb"]
    rows = []
    for i in range(1200):
        words = base(rng, 60)
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(rude) + rng.choice(["", "s", "en"])
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), held_out=2)
    got = scorer.score(docs).join(docs.select(F.col("doc_id").alias("id"), "toxic"), "id").where(toxicity.remainder(F.col("id")) == 2).collect()
    right = sum((r["score"] >= 0.3) == bool(r["toxic"]) for r in got)
    assert right / len(got) > 0.97


def test_toxicity_reads_runs_without_spaces_whole(spark):
    rng = random.Random(9)
    clean = ["".join(c for c in w if c.isalpha()) + rng.choice("abcdefgh") for w in base(rng, 400)]
    rude = ["gromblat", "snarfig", "pukzomb"]
    rows = []
    for i in range(800):
        words = [rng.choice(clean) for _ in range(90)]
        if i % 4 == 0:
            for r in rude:
                words[rng.randrange(60, 90)] = r
        rows.append((i, "".join(words) if i % 16 < 8 else " ".join(words), int(i % 4 == 0)))
    assert min(t.find(r) for _, t, toxic in rows if toxic for r in rude if r in t) > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scorer = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"), held_out=2)
    got = scorer.score(docs).join(docs.select(F.col("doc_id").alias("id"), "text", "toxic"), "id").where(toxicity.remainder(F.col("id")) == 2).collect()
    for spaced in (False, True):
        mine = [(r["score"] >= 0.3) == bool(r["toxic"]) for r in got if (" " in r["text"]) == spaced]
        assert len(mine) > 50 and sum(mine) / len(mine) > 0.95


def test_pieces_of_a_run_hold_each_gram_once():
    for n in (65, 68, 69, 124, 128, 129, 1000):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        padded = toxicity._PAD + word + toxicity._END
        pieces = [p[1:] for p in toxicity.counted_pieces([word])]
        assert [p[i : i + 5] for p in pieces for i in range(len(p) - 4)] == [padded[i : i + 5] for i in range(len(padded) - 4)]


def test_many_grams_keep_their_own_counts(spark):
    rng = random.Random(10)
    fresh = lambda: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(8))
    words = [(fresh(), rng.randrange(1, 5), rng.randrange(3)) for _ in range(60_000)]
    counts = spark.createDataFrame([(w, a, b, a, b) for w, a, b in words], "word string, first0 long, first1 long, all0 long, all1 long")
    model = toxicity.collected(toxicity.statistics(toxicity.gram_counts(counts), "all"))

    top = (Counter(), Counter())
    for w, *by in words:
        padded = toxicity._PAD + w + toxicity._END
        for i in range(len(padded) - 4):
            for y in (0, 1):
                top[y][padded[i : i + 5]] += by[y]
    low, total, types = {5: top[0] + top[1]}, {}, {}
    for k in (4, 3, 2, 1):
        low[k] = Counter(g[1:] for g in low[k + 1])
        total[k], types[k] = Counter(), Counter(g[:-1] for g in low[k])
        for g, n in low[k].items():
            total[k][g[:-1]] += n
    above, kinds = (Counter(), Counter()), tuple(Counter(g[:-1] for g, n in t.items() if n) for t in top)
    for y in (0, 1):
        for g, n in top[y].items():
            above[y][g[:-1]] += n

    def step(own, total, types, p):
        return (max(own - 0.9, 0) + 0.9 * types * p) / total if total else p

    def evidence(w):
        padded, out = toxicity._PAD + w + toxicity._END, 0.0
        for i in range(len(padded) - 4):
            g, p = padded[i : i + 5], 1 / 4096
            for k in (1, 2, 3, 4):
                p = step(low[k][g[-k:]], total[k][g[-k:-1]], types[k][g[-k:-1]], p)
            q = [step(top[y][g], above[y][g[:-1]], kinds[y][g[:-1]], p) for y in (0, 1)]
            out += np.log(q[1]) - np.log(q[0])
        return out / (len(padded) - 4)

    some = [w for w, _, _ in words[:300]] + [w[:5] + fresh()[:3] for w, _, _ in words[:300]] + [fresh() for _ in range(300)]
    assert np.allclose(model.evidence(some), [evidence(w) for w in some], atol=1e-4)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else i % 2) for i in range(9)], "doc_id long, quality int, toxic int")
    scorer = toxicity.fit(odd, labels, held_out=None)
    got = scorer.scored_rows(odd, out="risk").collect()
    assert len(got) == odd.count() and all(0 <= r["risk"] <= 1 for r in got) and all(r["score"] in (0.5, None) for r in got)
    assert toxicity.fit(none, labels.limit(0)).score(odd).count() == odd.count()


# ── tokens ───────────────────────────────────────────────────────────────────

TEXTS = st.text(alphabet=st.one_of(st.sampled_from(list("abcdetnsr AB 01.,'!\n\t")), st.characters(min_codepoint=32, max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=60)
_BPE = bpe.PrefixBpe(SPEC)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_bpe_equals_the_library(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert _BPE.encode(text) == ids
    assert _BPE.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False) == text


def test_compatible_is_plain_bpe():
    import json

    model = json.loads(SPEC)["model"]
    ranks = {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(model["merges"])}
    tokens = random.Random(2).sample(sorted(t for t in model["vocab"] if bpe._merged(t, ranks) == [t]), 1500)
    ids = np.array([model["vocab"][t] for t in tokens])
    want = [bpe._merged(a + b, ranks) == [a, b] for a, b in zip(tokens, tokens[1:])]
    for _ in range(2):  # tested, then from the table of pairs
        assert _BPE.compatible(ids[:-1], ids[1:]).tolist() == want


def test_chunks_join_to_the_text():
    texts = ["a b\nc", "x", "", None, "a, b\nc d.", "a  b", " a", "a\n\nb", "it's 3.14, no?", "a\u3000b"]
    got = pretoken.chunk_lists(pa.array(texts), lambda t: [t[:1], t[1:]]).to_pylist()
    assert ["".join(x) for x in got] == [t or "" for t in texts]
    assert got[5] == ["a", "  b"] and got[8] == ["it's", " 3", ".14", ",", " no", "?"]


def test_long_words_and_texts(tokenizer):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdeth") for _ in range(n)) for n in (191, 192, 193, 5000)] + ["é" * 3000, "a b " * 30_000 + "end"]
    got = _BPE.encode_texts(pa.array(texts))
    assert got.to_pylist() == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert _BPE.decode_lists(got).to_pylist() == texts


def test_ids_that_are_no_text_are_replaced(tokenizer):
    rng = random.Random(6)
    for _ in range(200):
        ids = [rng.randrange(50_000) for _ in range(12)]
        assert _BPE.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_of_odd_rows(odd, none, tokenizer):
    rows = bpe.decoded(bpe.encoded(odd, SPEC, keep=("doc_id", "id", "lang")), SPEC, keep=("doc_id", "id", "lang")).collect()
    want = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert r["decoded"] == want[r["doc_id"]] and r["ids"] == tokenizer.encode(want[r["doc_id"]], add_special_tokens=False).ids
    once = bpe.round_trip(odd, SPEC, keep=("doc_id", "id", "lang")).collect()
    assert sorted(map(str, once)) == sorted(map(str, rows))
    assert bpe.encoded(none, SPEC).count() == 0 and bpe.round_trip(none, SPEC).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=80), st.integers(0, 5))
def test_packing_round_trip(width, values, first):
    ids = np.array(values, np.uint32) & np.uint32((1 << width) - 1)
    first = min(first, len(ids))
    assert packing.unpack(packing.pack(ids, width), width, len(ids) - first, first).tolist() == ids[first:].tolist()


def test_packed_files(spark, odd, none, tokenizer, tmp_path):
    root = f"file://{tmp_path}/ids"
    manifest = packing.write_ids(odd, SPEC, root, partitions=3)
    got = sorted(packing.read_ids(spark, manifest, root).collect(), key=lambda r: r["start"])
    want = sorted(odd.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or ""))
    start = 0
    for r, w in zip(got, want, strict=True):
        ids = tokenizer.encode(w["text"] or "", add_special_tokens=False).ids + [0]
        assert (r["doc_id"], r["start"], r["ids"]) == (w["doc_id"], start, ids)
        start += len(ids)
    last = manifest.orderBy(F.desc("start")).first()
    one = packing.IdFile(last["path"], root)
    assert one.document(one.n_docs - 1).tolist() == got[-1]["ids"]
    assert packing.read_ids(spark, packing.write_ids(none, SPEC, root), root).count() == 0


def test_narrow_fields_read_at_random(tmp_path):
    ids = np.random.default_rng(1).integers(0, 2**17, 100_000).astype(np.uint32)
    w = packing._Writer(f"file://{tmp_path}", 17)
    for lo in range(0, len(ids), 999):
        part = ids[lo : lo + 999]
        w.add([lo], np.array([len(part)]), part)
    f = packing.IdFile(w.close()[0], f"file://{tmp_path}")
    for lo, hi in ((0, 5), (32767, 32770), (99_990, 100_000), (1234, 70_001)):
        assert f.ids(lo, hi).tolist() == ids[lo:hi].tolist()


# ── fingerprints ─────────────────────────────────────────────────────────────


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = {}
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        out[i] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.canonical(text) == fingerprints.canonical(changed), fingerprints.canonical(text) == fingerprints.canonical(following))
    return out


@pytest.mark.parametrize("bits", [128, 4])
def test_fingerprints_are_brute_force(spark, bits):
    rng = random.Random(4)
    texts = ["", None, "A  b", "a B ", "ﬁn", "fin", "x"] + [" ".join(base(rng, rng.randrange(1, 12))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts + texts[2:30])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.document_fingerprints(docs, bits=bits).collect()
    want = brute_fingerprints(rows)
    seen = {}
    for r in got:
        n, sha, near, nxt = want[r["id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert (r["fingerprint"] == r["edited_fingerprint"]) == near and (r["fingerprint"] == r["next_fingerprint"]) == nxt
        seen[r["id"]] = r["fingerprint"]
    by = {i: fingerprints.canonical(t) for i, t in rows}
    assert len(set(seen.values())) == len(set(by.values()))
    assert all((seen[a] == seen[b]) == (by[a] == by[b]) for a in by for b in by)


@pytest.mark.parametrize("bits", [128, 4])
def test_equal_texts_of_repeated_ids_have_equal_fingerprints(spark, bits):
    texts = ["alpha beta", "gamma delta", "alpha  BETA", None, "x", "gamma delta!", ""]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (2, texts[2]), (3, texts[1]), (3, texts[4]), (3, texts[3]), (None, texts[5]), (5, texts[6])]
    got = fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits).collect()
    prints = {}
    for r in got:
        prints.setdefault((r["id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert len(got) == len(rows)
    everyone = [fingerprints.canonical(t) for _, t in rows]
    assert len({r["fingerprint"] for r in got}) == len(set(everyone))
    assert prints[(1, 10)] == prints[(2, 10)] == prints[(2, 11)]
    assert prints[(3, 11)] == prints[(1, 11)] and prints[(3, 0)] == prints[(5, 0)]


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = fingerprints.document_fingerprints(odd)
    assert got.count() == odd.count()
    assert fingerprints.document_fingerprints(none).count() == 0
    alone = fingerprints.document_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert alone["next_id"] == 5 and alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


# ── chat ─────────────────────────────────────────────────────────────────────

NASTY = st.lists(st.sampled_from(["<|turn|>", "<|end|>", "\n", "<", "\\", "|", ">", "user", "é", "<\\|end|>\n", "<|n"]), max_size=8).map("".join)


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["<|turn|>", "<|end|>", "\n", "<", "\\", "|", ">", "assistant", "é", "<\\|end|>\n", "<|n", "<|end|>\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\nb", "<|turn|>x", ""]), "".join(rng.choice(bits) for _ in range(rng.randrange(7)))) for c in range(150) for t in range(rng.randrange(1, 6))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(turns).withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    for r in out:
        mine = sorted(x[1:] for x in rows if x[0] == r["conv_id"])
        assert r["identical"] and [tuple(t) for t in r["turns"]] == [(role, text) for _, role, text in mine]
        assert r["loss"] == "".join(text for _, role, text in mine if role == "assistant")


def test_chat_of_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, "assistant", None), (1, 0, "assistant", "x" * 100_000), (1, 0, "assistant", "x" * 100_000), (2, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("out", F.lit(1)).withColumn("plain", F.lit(2))
    got = {r["conv_id"]: r for r in chat.formatted(turns).collect()}
    assert len(got) == 3 and all(r["identical"] for r in got.values()) and len(got[1]["loss_spans"]) == 3
    assert chat.formatted(turns.limit(0)).count() == 0


def test_chat_query_equals_sql(spark, small):
    got = catalog.QUERIES["op6_chat_format"](spark, small).toPandas()
    assert_same(got, views(small).execute(catalog.ORACLE_SQL["op6_chat_format"]).df())


# ── language ─────────────────────────────────────────────────────────────────


def test_language_of_labelled_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.learn(docs)
    got = language.identify(docs, model, "doc_id", F.col("text"))
    right = got.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").where("language = lang").count()
    assert right >= 0.97 * docs.count()


def test_language_evidence_is_fused(spark, small):
    model = language.learn(spark.read.parquet(f"{small}/documents.parquet"))
    page = '<html lang="{}"><body>{}</body></html>'
    french = "les les vous avec pour dans une elle aux les des est la"
    rows = [(i, f"https://{'fr' if i < 60 else 'x'}.site.net/{i}", page.format("fr", french)) for i in range(61)]
    rows += [(100, "https://fr.site.net/q", "<html><body></body></html>"), (101, None, None), (102, "https://x.org/", page.format("", "Привет мир это текст"))]
    got = {r["id"]: r for r in language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[0]["language"] == "fr" and got[0]["declared"] == "fr" and got[0]["host"] == "fr.site.net" and got[0]["suffix"] == "net"
    assert got[100]["language"] == "fr"  # nothing but its host says so
    assert got[102]["language"] == "und" and got[101]["host"] is None


def test_language_fusion_is_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.learn(docs)
    rng = random.Random(11)
    texts = [r["text"][:120] for r in docs.orderBy("doc_id").limit(30).collect()] + [None, "", "123", "Привет мир"]
    rows = [(i, rng.choice(texts), rng.choice(["fr", "en", "xx", None]), rng.choice(["a.de", "b.de", "c.com", None]), rng.choice(["de", "com", None])) for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    got = {r["id"]: r for r in language.identify(frame, model, "doc_id", F.col("text"), F.col("declared"), F.col("host"), F.col("suffix")).collect()}
    logs, classes = model.ref.value.astype(float), [*model.languages, "und"]

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    def text_log(text):
        _, cell = language._cells([text])
        return logs[cell].mean(axis=0) * min(len(cell), 40) if len(cell) else np.r_[np.full(len(classes) - 1, -3.0), 0.0]

    of_text = [text_log(r[1]) for r in rows]
    p = [softmax(x) for x in of_text]
    root = sum(p) + 1
    root /= root.sum()
    sums = [{}, {}, {}, {}, {}]
    for r, x in zip(rows, p):
        for k in (2, 3, 4):
            if r[k] is not None:
                sums[k][r[k]] = sums[k].get(r[k], 0) + x
    for r, x, logs_of in zip(rows, p, of_text):
        parent = root if r[4] is None else (sums[4][r[4]] + 50 * root) / (sums[4][r[4]].sum() + 50)
        others = None if r[3] is None else np.maximum(sums[3][r[3]] - x, 0)
        prior = parent if others is None else (others + 20 * parent) / (others.sum() + 20)
        said = 0 if r[2] is None else np.log((np.maximum(sums[2][r[2]] - x, 0) + 20 * root) / (root + 1e-9))
        posterior = softmax(logs_of + np.log(np.maximum(prior, 1e-3)) + said)
        assert got[r[0]]["confidence"] == pytest.approx(posterior.max(), abs=1e-5)
        if np.sort(posterior)[-2] < posterior.max() - 1e-5:
            assert got[r[0]]["language"] == classes[posterior.argmax()]


def test_language_of_odd_rows(spark, odd, none):
    model = language.learn(odd)
    got = language.identify(odd, model, "doc_id", F.col("text"), declared=F.col("lang"), host=F.col("source"))
    assert got.count() == odd.count()
    assert language.identify(none, language.learn(none), "doc_id", F.col("text"), host=F.col("source")).count() == 0


# ── shards and mixes ─────────────────────────────────────────────────────────


def test_shards_are_even_and_keep_groups(spark, monkeypatch):
    rng = random.Random(7)
    texts = ["y" * rng.randrange(1, 400) for _ in range(900)] + [None, "", "", "big" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.sharded(docs, shards=5).collect()
    at, loads, slots = {}, Counter(), {}
    for r in got:
        text = texts[r["id"]]
        assert at.setdefault(text, r["shard"]) == r["shard"]
        assert r["size"] == len((text or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text or "").encode())
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_brute_force(spark):
    rng = random.Random(21)
    texts = [None, "", "hot" * 300] + ["z" * rng.randrange(1, 300) + str(i) for i in range(250)]
    rows = [(i, texts[2] if i % 3 == 0 else rng.choice(texts)) for i in range(700)]
    got = {r["id"]: r["shard"] for r in sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).collect()}
    group = {t: "null" if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts}
    sizes = Counter()
    for _, t in rows:
        sizes[group[t]] += len((t or "").encode()) + 1
    names = spark.createDataFrame([(g,) for g in sizes], "grp string").select("grp", F.pmod(F.xxhash64("grp"), F.lit(sharding.BUNDLES)).cast("string").alias("b"))
    bundle = {r["grp"]: r["b"] for r in names.collect()}
    item = {g: g if n * 5 * sharding.LARGE_PARTS >= sum(sizes.values()) else bundle[g] for g, n in sizes.items()}
    items = Counter()
    for g, n in sizes.items():
        items[item[g]] += n
    loads, at = [0] * 5, {}
    for name, n in sorted(items.items(), key=lambda x: (-x[1], x[0])):
        at[name] = loads.index(min(loads))
        loads[at[name]] += n
    assert got == {i: at[item[group[t]]] for i, t in rows}


def test_longest_first_is_lpt():
    assert sharding.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_shards_of_odd_rows(odd, none):
    assert sharding.sharded(odd).count() == odd.count()
    assert sharding.sharded(none).count() == 0


def brute_edf(weights, slots):
    """Earliest deadline first, slot by slot, over exact fractions of the weights."""
    total = sum(map(Fraction, weights.values()))
    w = {s: Fraction(x) / total for s, x in weights.items()}
    done, out = Counter(), []
    for t in range(slots):
        released = [s for s in w if done[s] // w[s] <= t]
        out.append(min(released, key=lambda s: (-(-(done[s] + 1) // w[s]), s is None, s or "")))
        done[out[-1]] += 1
        assert all(abs(done[s] - w[s] * (t + 1)) < 1 for s in w)
    return out


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("abc", max_size=3), st.integers(1, 40), min_size=1, max_size=9))
def test_pfair_is_edf_over_twenty_periods(weights):
    shares = mixing.whole_shares(weights)
    period = mixing.pfair_period(shares)
    assert len(period) == sum(shares.values()) and all(shares[s] * sum(weights.values()) == weights[s] * len(period) for s in weights)
    assert period * 20 == brute_edf(weights, 20 * len(period))


def test_decimal_weights_are_exact():
    assert mixing.whole_shares({"a": 0.9, "b": 0.1}) == {"a": 9, "b": 1}
    assert mixing.whole_shares({"a": 1, "b": 0}) == {"a": 1} and mixing.whole_shares({"a": 0.0}) == {}
    many = mixing.whole_shares({f"s{i}": i + 0.37 for i in range(5000)})
    assert len(many) == 5000 and min(many.values()) >= 1
    with pytest.raises(ValueError):
        mixing.whole_shares({"a": -1})


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.text("ab", max_size=2), st.tuples(st.integers(1, 9), st.integers(0, 60)), min_size=1, max_size=5))
def test_phases_place_every_block_once(sources):
    shares, blocks = {s: w for s, (w, _) in sources.items()}, {s: n for s, (_, n) in sources.items()}
    order, left = {}, dict(blocks)
    for phase in mixing.phases(shares, blocks):
        mine = {s: shares[s] for s in phase.turns}
        assert all(left[s] > 0 for s in mine) and set(mine) == {s for s in left if left[s] > 0}
        length = sum(phase.end[s] - phase.first[s] for s in mine)
        want = brute_edf(mine, length)
        for s, turns in phase.turns.items():
            for k in range(phase.end[s] - phase.first[s]):
                at = k // len(turns) * phase.period + turns[k % len(turns)]
                assert want[at] == s
                order[phase.start + at] = s
            left[s] -= phase.end[s] - phase.first[s]
    assert not any(left.values()) and sorted(order) == list(range(sum(blocks.values())))


def test_mix_keeps_all_rows_of_uneven_sources(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4995, "large").otherwise("small").alias("source"))
    got = mixing.mixed(rows, mixing.tempered_weights(rows)).collect()
    assert len(got) == 5000 and len({(r["slot"], r["place"]) for r in got}) == 5000
    slots = sorted({r["slot"] for r in got})
    assert slots == list(range(len(slots))) and len(slots) == 626


def test_mix_meets_its_weights(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "hot").when(F.col("id") < 5000, "mid").otherwise(F.lit(None)).alias("source"))
    weights = {"hot": 2.0, "mid": 1.0, None: 1.0}
    got = mixing.mixed(rows, weights, block_rows=8).collect()
    assert len(got) == 6000 and len({(r["slot"], r["place"]) for r in got}) == 6000
    by_slot = {r["slot"]: r["source"] for r in got if r["in_mix"]}
    assert len(by_slot) >= 495 and [by_slot[t] for t in range(len(by_slot))] == brute_edf(weights, len(by_slot))
    assert sorted({r["slot"] for r in got}) == list(range(750))


def test_mix_of_odd_rows(odd, none):
    got = mixing.mixed(odd, mixing.tempered_weights(odd)).collect()
    assert len(got) == odd.count() and all(r["slot"] is not None for r in got)
    assert mixing.mixed(none, mixing.tempered_weights(none)).count() == 0
    assert not any(r["in_mix"] for r in mixing.mixed(odd, {"nobody": 1.0}).collect())


# ── embeddings ───────────────────────────────────────────────────────────────


def test_nearest_e8_point():
    rng = np.random.default_rng(3)
    y = rng.normal(size=(200, 8)) * 2
    p = embeddings.nearest_e8(y)
    assert len(embeddings.minimal_vectors()) == 240 and np.allclose((embeddings.minimal_vectors() ** 2).sum(axis=1), 2)
    gap = ((y - p) ** 2).sum(axis=1)
    for v in embeddings.minimal_vectors():
        assert (((y - p - v) ** 2).sum(axis=1) >= gap - 1e-9).all()


def brute_links(every):
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    return unit @ unit.T >= 0.95


@pytest.mark.parametrize("dim", [2, 3, 8, 16])
def test_vectors_of_every_length_are_searched(spark, dim):
    rng = np.random.default_rng(dim)
    groups = [rng.normal(size=(40, dim)), rng.normal(size=(60, 24))]
    groups = [np.vstack([x, x + rng.normal(size=x.shape) * 0.05, x[:4]]) for x in groups]
    rows, want, first = [], {}, 0
    for x in groups:
        linked = brute_links(x)
        rows += [(first + i, v.tolist()) for i, v in enumerate(x)]
        want |= {first + i: int(linked[i].sum()) - 1 for i in range(len(x))}
        first += len(x)
    got = {r["id"]: r["n_links"] for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == want


def test_ids_with_several_vectors(spark):
    x = np.eye(16)
    rows = [(3, x[0]), (5, x[0]), (5, x[1]), (7, x[1] * 2), (9, x[2]), (9, x[3]), (None, x[0]), (11, None), (9, None)]
    rows = [(i, None if v is None else v.tolist()) for i, v in rows]
    got = sorted((str(r["id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([("3", 1, "3", True), ("5", 1, "3", False), ("5", 1, "3", False), ("7", 1, "3", False), ("9", 0, "9", True), ("9", 0, "9", True), ("None", 0, "None", True), ("11", 0, "11", True), ("9", 0, "9", True)])


@pytest.mark.parametrize("blocks", [2, 3, 4])
def test_pairs_at_the_threshold_meet(blocks):
    rng = np.random.default_rng(blocks)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rng.normal(size=x.shape)
    r -= (r * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    a, b = (embeddings.Lattice(64, blocks).cells(v) for v in (x, y))
    meets = (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    assert (1 - meets.mean()) ** len(a) < 5e-6 and meets.any(axis=0).all()


def test_near_vectors_are_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 64))
    close = x[:60] + rng.normal(size=(60, 64)) * 0.3
    crowd = x[0] + rng.normal(size=(90, 64)) * 0.12
    every = np.vstack([x, close, crowd, x[:5], 3 * x[5:8]]).astype(np.float32)
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    parent = np.arange(len(every))
    for _ in range(len(every)):
        parent = np.array([parent[linked[i]].min() for i in range(len(every))])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(every)]
    odd = [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [float("nan")] * 64, 1), (1003, [None] + [1.0] * 63, 1), (1004, [], 1), (1005, [1.0, 2.0], None)]
    docs = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int")
    got = {r["id"]: r for r in embeddings.near_vectors(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    for i in range(len(every)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (linked[i].sum() - 1, parent[i])
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i, _, _ in odd)
    assert embeddings.near_vectors(docs.limit(0)).count() == 0
