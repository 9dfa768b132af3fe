"""Line deduplication, fill-in-middle and spelling variants against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import assert_same, views
from tidemark.llm import catalog, infill, line_dedup, variants

DOC = "doc_id long, text string, line string, row long, doc long, keep string, word string, n long, id long"


def table(spark, rows):
    """Documents beside columns that are called like the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, 2, "k", "w", 3, 9) for i, t in rows], DOC)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_fill_in_middle", "op13_line_dedup"])
def test_query_equals_sql(spark, small, name):
    assert_same(catalog.QUERIES[name](spark, small).toPandas(), views(small).execute(catalog.ORACLE_SQL[name]).df())


# ── fill in the middle ───────────────────────────────────────────────────────

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\t-\r ]*[\t-\r ]+|[^\t-\r ]+", "char": r"[\s\S]"}


@pytest.mark.parametrize("unit", sorted(PATTERNS))
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet="ab\n\r é中😀\t", max_size=40))
def test_cuts_fall_where_units_end(unit, text):
    units = re.findall(PATTERNS[unit], text)
    runs = infill.ClassRuns(text, unit)
    assert runs.units == len(units)
    assert [runs.offset(n) for n in range(len(units) + 1)] == [len("".join(units[:n])) for n in range(len(units) + 1)]


def brute_infill(doc_id, text, percent, spm):
    text = text or ""
    units = re.findall(PATTERNS["line"], text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def infill_rows():
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n\n", "no end", "end\n", "a<P>b\nc", "<S>", "x<M", "P>\n<", "<P\n>", "é中😀\r\n\nz\n", "same\ntext", "same\ntext", "q" * 300_000 + "\n" + "w\n" * 50_000]
    texts += ["".join(rng.choice(["a", "b\n", "\n", "<", "P>", "<S", " "]) for _ in range(rng.randrange(30))) for _ in range(200)]
    return [*enumerate(texts), (3, "again\nthe id"), (None, "no\nid\n"), (12, "same\ntext")]


@pytest.mark.parametrize("percent, spm", [(100, 50), (60, 20), (0, 50)])
def test_infill_is_brute_force(spark, percent, spm):
    rows = infill_rows()
    made = infill.infilled(table(spark, rows), fim_percent=percent, spm_percent=spm)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    expected = [(i, *brute_infill(i, t, percent, spm), t or "") for i, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)


def test_infill_of_nothing(spark):
    assert infill.infilled(table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        infill.infilled(table(spark, []), unit="page")


# ── lines ────────────────────────────────────────────────────────────────────


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def brute_lines(rows, chars, documents):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= chars:
                held[line_key(line)].add(i)
    keeper = {k: max(d, key=lambda i: (i is not None, i or 0)) for k, d in held.items() if len(d) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(line_key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(5)
    known = ["é" * 45, "É" * 45, "Å" + "k" * 45, "Å" + "k" * 45, "MIXED case " * 5, "mixed CASE " * 5, "  mixed case mixed case mixed case mixed case mixed case\t", " " + "n" * 45, "n" * 45, "中" * 39, "中" * 40, "İ" * 45, "i̇" * 45, "K" * 45, "K" * 45, "short", "", "   "]
    rows = [(i, "\n".join(rng.choice(known) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100 + i, "\n".join(["hot line " * 8] * (1 + i % 3))) for i in range(400)]  # in most documents, repeated
    rows += [(600, "\n".join([f"line {i}" for i in range(63)] + ["hot line " * 8] * 3 + ["é" * 45] * 130 + ["end"]))]
    rows += [(7, "same id, another text\n" + "é" * 45), (7, None), rows[0], rows[0], (None, "no id\n" + "é" * 45), (None, "中" * 40 + "\n\n"), (700, ""), (701, "x" * 200_000)]
    return rows


def test_lines_are_brute_force(spark):
    rows = line_rows()
    got = line_dedup.deduplicated(table(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_lines(rows, 40, 5), key=key)


def test_line_bitmaps_hold_touched_words_only(spark):
    rows = line_rows()
    maps = {r["doc"]: r["keep"] for r in line_dedup.keep_bitmaps(table(spark, rows)).where("doc = 600 or doc = 100 or doc = 701").collect()}
    assert 701 not in maps
    lost = {64 * w + b for w, bits in maps[100].items() for b in range(64) if not bits >> b & 1}
    assert lost == {0}
    assert 600 not in maps or min(maps[600]) >= 0  # the largest holder of both keys keeps them
    few = line_dedup.keep_bitmaps(table(spark, [(1, "a\n" * 200 + "k" * 50), (2, "k" * 50)]), least_documents=2).collect()
    assert [(r["doc"], r["keep"]) for r in few] == [(1, {3: ~(1 << 200 % 64)})]


def test_a_line_of_all_documents_is_dealt_out(spark):
    """No group of the first pass holds a hot line whole, and no join key stands for all of it."""
    docs = table(spark, [(i, "the same long line in every document of them all") for i in range(3000)])
    lines = line_dedup._occurrences(docs, "doc_id", "text", 40)
    assert lines.groupBy("h1", "h2", "salt").count().agg(F.max("count")).head()[0] < 20
    got = line_dedup.deduplicated(docs)
    assert got.where("kept <> ''").select("id").collect() == [(2999,)]


def test_lines_of_nothing(spark):
    assert line_dedup.deduplicated(table(spark, [])).collect() == []
    assert [tuple(r) for r in line_dedup.deduplicated(table(spark, [(1, None)])).collect()] == [(1, 1, 0, "")]


def test_line_dedup_runs_no_python(spark, small):
    plan = catalog.op13_line_dedup(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ── spelling variants ────────────────────────────────────────────────────────


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, length, count, every, times=2):
    total = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                total[run] += 1
    words = {w: n for w, n in total.items() if n >= count}
    links = {w: sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: v[0] if v and words[v[0]] >= times * words[w] else None for w, v in links.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(links[w]), words.get(form[w])))
    return sorted(out)


def variant_rows(seed, alphabet):
    rng = random.Random(seed)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 7))) for _ in range(160)]
    text = lambda: " ".join(words[int(rng.random() ** 3 * len(words))] + rng.choice(["", "", "1", "_", "×"]) for _ in range(40))
    return [(i, text()) for i in range(60)] + [(3, text()), (None, text()), (61, None), (62, ""), (63, "1 2 3"), (64, text().upper())]


def found(spark, rows, **options):
    got = variants.spelling_variants(table(spark, rows), **options)
    return sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed, alphabet, length, every", [(1, "ab", 3, 7), (2, "aébÉ", 2, None), (3, "abcdefg", 3, 5)])
def test_variants_are_brute_force(spark, seed, alphabet, length, every):
    rows = variant_rows(seed, alphabet)
    expected = brute_variants(rows, length, 3, every)
    assert any(r[1] and r[2] != r[1] for r in expected) or seed != 1
    assert found(spark, rows, least_length=length, least_count=3, every=every) == expected


def test_long_runs_and_texts(spark, monkeypatch):
    monkeypatch.setattr(variants, "_PIECE", 50)
    monkeypatch.setattr(variants, "_HELD", 10)
    rows = [(i, "a" * 3000 + " " + "a" * 3001 + " " + "a" * 1500 + "b" + "a" * 1500 + " short words here, again " * 200) for i in range(4)]
    assert found(spark, rows) == brute_variants(rows, 5, 3, None)


def test_variants_of_nothing(spark):
    assert found(spark, []) == [] == found(spark, [(1, None), (None, "")])
    with pytest.raises(ValueError):
        variants.spelling_variants(table(spark, []), times=1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=7), min_size=1, max_size=20, unique=True))
def test_deletion_keys_are_keys_of_the_shortened_words(words):
    index, place, first, key = variants.deletion_keys(words)
    whole = {w: k for w, k in zip(words, key[place == -1])}
    shorter = {}
    for i, p, f, k in zip(index, place, first, key):
        if p >= 0:
            rest = words[i][:p] + words[i][p + 1 :]
            assert shorter.setdefault(rest, k) == k
            assert f == (p == 0 or words[i][p] != words[i][p - 1])
    assert all(whole[w] == k for w, k in shorter.items() if w in whole)
    assert len(set(shorter.values()) | set(whole.values())) == len(set(shorter) | set(whole))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-1, 3), st.booleans(), st.integers(0, 9)), max_size=30), st.integers(1, 7))
def test_keys_that_span_batches_meet(rows, size):
    rows = sorted((k, p, f and p >= 0, w) for k, p, f, w in rows)
    columns = lambda part: [pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.bool_(), pa.int64()))]
    batches = [pa.RecordBatch.from_arrays(columns(rows[i : i + size]), ["key", "place", "first", "word_id"]) for i in range(0, len(rows), size)]
    got = [x for b in variants._meeting(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
    expected = []
    for k, p, f, w in rows:
        same = [r for r in rows if r[0] == k]
        replaced = p >= 0 and sum(r[1] == p for r in same) > 1
        if replaced or (p < 0 and any(r[2] for r in same)) or (f and any(r[1] < 0 for r in same)):
            expected.append((p, f, w))
    assert sorted(got) == sorted(expected)


def test_collisions_part_on_the_strings(spark, monkeypatch):
    """With eight keys for all words, only the strings tell who is near."""
    rows = variant_rows(4, "abc")
    plain = variants._keyed

    def crowded(batches):
        for b in plain(batches):
            yield b.set_column(0, "key", pa.array(b.column(0).to_numpy() % np.int64(8)))

    monkeypatch.setattr(variants, "_keyed", crowded)
    assert found(spark, rows, least_length=3) == brute_variants(rows, 3, 3, None)
