"""Similarity joins, near-duplicate groups and history deduplication against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorevine.llm.components import components
from lorevine.llm import history_dedup
from lorevine.llm.history_dedup import HistoryDedup, needed, window_of, winnow
from lorevine.llm.near_dup import group_pairs, near_duplicates
from lorevine.llm import segments
from lorevine.llm.segments import candidate_pairs, segment_count, similar_pairs
from lorevine.llm.set_join import all_pairs, item_sets, note_items, pairs_between, similar_classes


def jaccard_pairs(sets: dict, t: float) -> set:
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12}


def edited(words: list[str], rng: random.Random, edits: int) -> list[str]:
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        if rng.random() < 0.4:
            out[at] = f"x{rng.randrange(10**6)}"
        elif rng.random() < 0.5:
            del out[at]
        else:
            out.insert(at, f"y{rng.randrange(10**6)}")
    return out


def corpus(seed: int, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    common = "a standing phrase that closes every single page of this collection".split()
    out = []
    for i in range(n):
        base = rng.choice(out)[2].split() if out and rng.random() < 0.5 else [f"w{rng.randrange(400)}" for _ in range(rng.randrange(15, 90))]
        out.append((i + 1, f"title {i % 3}" if i % 4 else None, " ".join(edited(base, rng, rng.randrange(0, 6)) + (common if i % 3 == 0 else [])), i * 4 // n))
    return out


def shingles(title, body, k=3, least=20):
    w = f"{title or ''} {body or ''}".lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= least else frozenset()


@pytest.mark.parametrize(("t", "seed"), [(0.6, 1), (0.6, 2), (0.8, 3), (0.5, 4), (0.95, 5)])
def test_join_is_exact(spark, t, seed):
    rng = random.Random(seed)
    sets = {}
    for i in range(250):
        size = rng.choice([1, 2, 3, 6, 9, 20, 60])
        base = set(rng.choice(list(sets.values()))) if sets and rng.random() < 0.6 else {rng.randrange(300) for _ in range(size)}
        for _ in range(rng.randrange(4)):
            base ^= {rng.randrange(300)}
        sets[i] = base or {1}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<long>")
    assert {(r.a, r.b) for r in similar_pairs(df, t).collect()} == jaccard_pairs(sets, t)


def test_candidates_are_few(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, sorted({rng.randrange(20_000) for _ in range(80)} | set(range(10**6, 10**6 + 15)))) for i in range(400)], "id long, tokens array<long>")
    assert candidate_pairs(df, 0.6).count() < 1000


def test_screen_over_chunks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(segments, "CHUNK_TOKENS", 60)
    monkeypatch.setattr(segments, "PART_SIGNATURES", 900)
    rng = random.Random(8)
    sets = {i: {rng.randrange(500) for _ in range(rng.randrange(1, 30))} for i in range(60)}
    sets |= {100 + i: sets[i] ^ {rng.randrange(500)} or {1} for i in range(40)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<long>")
    assert {(r.a, r.b) for r in similar_pairs(df, 0.6).collect()} == jaccard_pairs(sets, 0.6)
    assert similar_pairs(df.limit(0), 0.6).count() == 0


def test_signatures_do_not_depend_on_the_order_of_rows():
    rng = random.Random(5)
    sets = [(i, sorted({rng.randrange(300) for _ in range(rng.randrange(5, 90))})) for i in range(2500)]

    class Flat:
        value = np.ones(segments.FREQUENCY_BUCKETS, dtype=np.float32)

    plan = segments._Plan(0.6, Flat, 2500, 40, 3)
    made = []
    for _ in range(2):
        rng.shuffle(sets)
        out = plan.signatures(pa.table({"id": [i for i, _ in sets], "tokens": pa.array([s for _, s in sets], pa.list_(pa.int64()))}))
        made.append(sorted(zip(*(x.tolist() for x in out), strict=True)))
    assert made[0] == made[1]


@given(st.lists(st.integers(0, 2**60), max_size=50, unique=True))
@settings(max_examples=50, deadline=None)
def test_packed_hashes(values):
    h = np.array(sorted(values), dtype=np.uint64)
    assert (segments._unpacked(segments._packed(h), len(h)) == h).all() if len(h) else True


@given(st.integers(1, 4000), st.floats(0.3, 0.99))
@settings(max_examples=200, deadline=None)
def test_budget_can_be_spent(top, t):
    for size in {top, int(top / t + 1e-9)}:
        assert 2 * segment_count(top, t) >= (size + top) * (1 - t) / (1 + t) + 1 - 1e-6


def test_near_duplicate_groups(spark):
    rows = corpus(7) + [(1001, None, None, 3), (1002, "", "  ", 3), (1003, "same", rows_text := " ".join(f"z{i}" for i in range(40)), 0), (1004, "same", rows_text, 3), (1005, "SAME", rows_text.upper(), 3), (None, "x", rows_text, 3)]
    df = spark.createDataFrame(rows, "rec_id long, title string, body string, batch_no int").withColumn("content", F.lit(1)).withColumn("rep", F.lit("clash"))
    members, links = near_duplicates(df, "rec_id", ["title", "body"], 3, 0.6, 20)
    sets = {r[0]: shingles(r[1], r[2]) for r in rows if r[0]}
    pairs = jaccard_pairs({k: v for k, v in sets.items() if v}, 0.6)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = members.collect()
    assert {r.rec: r.group for r in got} == {x: find(x) for p in pairs for x in p}
    assert {r.rec: r.links for r in got} == {x: sum(x in p for p in pairs) for p in pairs for x in p}
    assert {(r.rec_a, r.rec_b) for r in group_pairs(members).collect()} == {(a, b) for a in parent for b in parent if a < b and find(a) == find(b)}
    assert all(r.jaccard >= 0.6 for r in links.collect())


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "rec_id long, title string, body string")
    members, links = near_duplicates(empty, "rec_id", ["title", "body"])
    assert members.count() == 0 and links.count() == 0


def test_long_text(spark):
    text = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one")], "k long, t string")
    assert [(r.rec_a, r.rec_b) for r in group_pairs(near_duplicates(df, "k", ["t"])[0]).collect()] == [(1, 2)]


@pytest.mark.parametrize(("part", "sent"), [(1 << 16, 500_000), (256, 0)])
def test_history(spark, tmp_path, monkeypatch, part, sent):
    monkeypatch.setattr(history_dedup, "PART_SIZE", part)
    monkeypatch.setattr(history_dedup, "SENT", sent)
    rows = corpus(11) + [(500 + i, None, rows_text, 4) for i, rows_text in enumerate([" ".join(f"q{i}" for i in range(30))] * 3 + ["too short", None])]
    df = spark.createDataFrame(rows, "rec_id long, title string, body string, batch_no int").withColumn("fp", F.lit("clash"))
    index = HistoryDedup(spark, f"file://{tmp_path}/h", ["title", "body"], 3, 0.6, 20)
    for b in range(3):
        index.add(df.where(F.col("batch_no") == b), "rec_id", b)
    with pytest.raises(ValueError):
        index.add(df.where("batch_no = 1"), "rec_id", 1)
    again = HistoryDedup(spark, f"file://{tmp_path}/h", ["title", "body"], 3, 0.6, 20)  # a new process goes on where the old one ended
    for b in (3, 4, 5):  # the last batch is empty
        again.add(df.where(F.col("batch_no") == b), "rec_id", b)
    sets = {r[0]: shingles(r[1], r[2]) for r in rows}
    pairs = jaccard_pairs({k: v for k, v in sets.items() if v}, 0.6)
    assert {r.rec for r in again.repeats().collect()} == {b for _, b in pairs}
    assert {(r.first, r.rec) for r in again.repeats().where("rec >= 500").collect()} == {(500, 501), (500, 502)}


@given(st.lists(st.lists(st.integers(-2**62, 2**62), max_size=40), max_size=6), st.integers(2, 9))
@settings(max_examples=100, deadline=None)
def test_winnowing_by_brute_force(rows, w):
    flat = np.array([x for r in rows for x in r], dtype=np.int64)
    rank = np.abs(flat) % 5
    key = lambda x: (abs(x) % 5, int(segments._mix(np.array([x], dtype=np.int64).view(np.uint64))[0] >> np.uint64(32)))
    want = {}
    for i, r in enumerate(rows):
        for at in range(max(1, len(r) - w + 1) if r else 0):
            best = min(r[at:at + w], key=key)
            want[i, best] = want.get((i, best), 0) + 1
    row, value, count = winnow(flat, rank, np.array([len(r) for r in rows], dtype=np.int64), w)
    assert {(int(a), int(b)): int(c) for a, b, c in zip(row, value, count, strict=True)} == want


@pytest.mark.parametrize(("t", "k"), [(0.6, 3), (0.8, 5), (0.5, 2), (0.9, 4)])
def test_similar_texts_share_the_windows_needed(t, k):
    rng = random.Random(4)
    w = window_of(t, k)
    tried = 0
    for _ in range(400):
        a = [rng.randrange(10**6) for _ in range(rng.randrange(k + w, 150))]
        b = edited(list(map(str, a)), rng, rng.randrange(1, 12))
        x, y = ([hash(tuple(map(str, s[i:i + k]))) // 4 for i in range(len(s) - k + 1)] for s in (a, b))
        if len(set(x) & set(y)) < t * len(set(x) | set(y)):
            continue
        tried += 1
        values = np.array(x + y, dtype=np.int64)
        row, value, count = winnow(values, np.abs(values) % 3, np.array([len(x), len(y)]), w)
        one, two = ({int(v): int(c) for r, v, c in zip(row, value, count, strict=True) if r == i} for i in (0, 1))
        for mine, other, n in ((one, two, len(x)), (two, one, len(y))):
            assert sum(c for v, c in mine.items() if v in other) >= needed(np.array([n]), t, k, w)[0]
    assert tried > 20


def test_history_survives_a_failed_first_batch(spark, tmp_path, monkeypatch):
    rows = corpus(12, 60)
    df = spark.createDataFrame(rows, "rec_id long, title string, body string, batch_no int")
    path = f"file://{tmp_path}/h"
    index = HistoryDedup(spark, path, ["title", "body"], 3, 0.6, 20)
    real = index.store.publish

    def fails(*args, **kwargs):
        monkeypatch.setattr(index.store, "publish", real)
        raise OSError("lost")

    monkeypatch.setattr(index.store, "publish", fails)
    with pytest.raises(OSError):
        index.add(df.where("batch_no = 0"), "rec_id", 0)
    index.add(df.where("batch_no = 0"), "rec_id", 0)
    again = HistoryDedup(spark, path, ["title", "body"], 3, 0.6, 20)
    for b in (1, 2, 3):
        again.add(df.where(F.col("batch_no") == b), "rec_id", b)
        if b == 2:
            again.merge()
    pairs = jaccard_pairs({k: v for k, v in {r[0]: shingles(r[1], r[2]) for r in rows}.items() if v}, 0.6)
    assert {r.rec for r in again.repeats().collect()} == {b for _, b in pairs}
    assert all(f.startswith(path) for f in again.store.state()["outputs"]) and len(again.store.state()["outputs"]) == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (5, 5), (None, 3), (300, 299)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 299, 299: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_set_join(spark):
    rows = [(1, ["#A", " b "], ["x/Y z", "x\\y-z.md", None]), (2, ["a", "B"], ["./x/y_z"]), (3, None, None), (4, ["a", None, "c", "x/y-z.md"], []), (5, [], ["q"]), (2, ["a", "B"], ["./x/y_z"])]
    df = spark.createDataFrame(rows, "rec_id long, tags array<string>, wiki_links array<string>").withColumn("items", F.lit(0))
    sets = item_sets(df, "rec_id", note_items())
    assert {r.rec: r["items"] for r in sets.collect()} == {1: ["l:x/y-z.md", "t:a", "t:b"], 2: ["l:x/y-z.md", "t:a", "t:b"], 4: ["t:a", "t:c", "t:x/y-z.md"], 5: ["l:q.md"]}
    assert [(r.rec_a, r.rec_b) for r in all_pairs(sets, 0.6).collect()] == [(1, 2)]
    members, pairs = similar_classes(sets, 0.2)
    assert {r.rec: r.rep for r in members.collect()} == {1: 1, 2: 1, 4: 4, 5: 5}
    assert [tuple(sorted((r.rep_a, r.rep_b))) for r in pairs.collect()] == [(1, 4)]
    assert all_pairs(sets.limit(0), 0.6).count() == 0


def test_hot_set(spark):
    same = [(i, ["a", "b", "c"]) for i in range(60)] + [(i, ["a", "b", "c", f"u{i}"]) for i in range(60, 80)]
    got = all_pairs(spark.createDataFrame(same, "rec long, items array<string>"), 0.6)
    assert got.count() == 80 * 79 // 2


def test_between_tables(spark):
    a = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"])], "rec long, items array<string>")
    b = spark.createDataFrame([(1, ["a", "b", "c"]), (7, ["a", "b", "c", "d"]), (8, ["k"])], "rec long, items array<string>")
    assert {(r.left_rec, r.right_rec) for r in pairs_between(a, b, 0.7).collect()} == {(1, 1), (1, 7)}
