"""Exact and near copies and repeated passages against loops over all pairs or windows."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from cases import AWKWARD
from kinosift.llm import content_sort, order_minhash, suffix_dedup

SF = "/root/testdata/sf0.001/documents.parquet"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("largest", [False, True])
def test_exact_groups(spark, table, largest):
    rows = [(d, t) for d, t in AWKWARD if d != 4] + [(i, "hot") for i in range(100, 400)] + [(i, f"É{i % 5}") for i in range(500, 530)]
    found = content_sort.duplicates(table(rows), largest).collect()
    groups = {}
    for doc, text in rows:
        groups.setdefault(low(text), []).append(doc)
    want = []
    for doc, text in rows:
        ids = [i for i in groups[low(text)] if i is not None]
        keep = (max if largest else min)(ids) if ids else None
        want.append((doc, keep, len(groups[low(text)]), doc == keep, hashlib.sha256(low(text).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_exact_groups_of_nothing_and_of_repeats(spark, table):
    assert content_sort.duplicates(table([])).count() == 0
    hot = content_sort.duplicates(table([(None, "hot")] * 500 + [(9, "HOT")] * 500 + [(10, None)] * 3)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in hot} == {(None, 9, 1000, False), (9, 9, 1000, True), (10, 10, 3, True)} and len(hot) == 1003
    found = content_sort.duplicates(table([(4, "a"), (4, "A")])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in found] == [(4, 2, True)] * 2


def test_runs_across_partitions():
    import pyarrow as pa

    rows = [(1, b"a", b"a", 0), (2, b"b", b"b", 0), (3, b"b", b"b", 0), (4, b"c", b"c", 0)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i]]) for i in range(4)], names=["doc_id", "norm", "head", "_hash"]) for r in rows]
    found = [r for b in content_sort._runs(False)(batches) for r in b.to_pylist()]
    assert [(r["doc_id"], r["keep_id"], r["group_size"], r["edge"]) for r in found] == [(1, 1, 1, True), (2, 2, 2, False), (3, 2, 2, False), (4, 4, 1, True)]


def plain_similarity(a, b):
    """Shared shingles in the best alignment, by dynamic programming."""
    best = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    shared = best[-1, -1]
    return shared / (len(a) + len(b) - shared)


@pytest.mark.parametrize("seed", range(20))
def test_banded_alignment_equals_the_plain_one(seed):
    draw = random.Random(seed)
    words = [f"w{draw.randint(0, 30)}" for _ in range(draw.randint(5, 80))]
    other = list(words)
    for _ in range(draw.randint(0, 4)):
        at = draw.randrange(len(other))
        other[at : at + draw.randint(0, 2)] = [f"n{draw.randint(0, 99)}"] * draw.randint(0, 2)
    a, b = (order_minhash.labelled_shingles(order_minhash.word_hashes(" ".join(w))[0]) for w in (words, other))
    assert len(set(a.tolist())) == len(a)
    plain, found = plain_similarity(a, b), order_minhash.similarity(a, b)
    assert (plain >= 0.8) == (found >= 0.8)
    if plain >= 0.8:
        assert found == pytest.approx(plain)


def classes(rows):
    """Components over all pairs."""
    shingles = [order_minhash.labelled_shingles(order_minhash.word_hashes(t or "")[0]) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (not len(shingles[i]) and not len(shingles[j])) or order_minhash.similarity(shingles[i], shingles[j]) >= 0.8:
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc)
    return {i: (min((d for d in groups[root(i)] if d is not None), default=None), len(groups[root(i)])) for i in range(len(rows))}


def near_copies(seed):
    draw = random.Random(seed)
    rows = []
    for base in range(12):
        words = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([6, 30, 120, 300]))]
        for copy in range(draw.randint(1, 8)):
            own = list(words)
            for _ in range(draw.randint(0, max(1, len(own) // 60))):
                own[draw.randrange(len(own))] = f"n{draw.randint(0, 999)}"
            rows.append((base * 100 + copy, " ".join(own)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_classes_equal_all_pairs(spark, table, seed):
    rows = near_copies(seed) + [r for r in AWKWARD if r[0] not in (4,)]
    found = order_minhash.near_duplicates(table(rows)).collect()
    assert sorted(str((r.doc_id, r.class_id, r.class_size)) for r in found) == sorted(str((d, *classes(rows)[i])) for i, (d, _) in enumerate(rows))
    assert sum(r.kept for r in found) == len(set(classes(rows).values()))


def test_open_buckets_are_split(spark, table):
    shared = " ".join(f"s{i}" for i in range(70))
    draw = random.Random(5)
    rows = [(i, shared + " " + " ".join(f"t{draw.randint(0, 10**6)}" for _ in range(30))) for i in range(25)] + near_copies(7)
    found = order_minhash.near_duplicates(table(rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == sorted((d, classes(rows)[i][0]) for i, (d, _) in enumerate(rows))


def test_copies_of_copies_and_their_strangers(spark, table):
    """One text with edits of all sizes, so that buckets hold links to the leader, links among the rest, and none."""
    draw = random.Random(11)
    base = [f"w{draw.randint(0, 3000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        own = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4, 6, 9])):
            own[draw.randrange(len(own))] = draw.choice([f"n{draw.randint(0, 9999)}", "the"])
        rows.append((i, " ".join(own)))
    rows += [(200 + i, " ".join([*r[1].split()[:60], *[f"k{i}x{j}" for j in range(20)]])) for i, r in enumerate(rows[:30])]
    found = order_minhash.near_duplicates(table(rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in found) == sorted((d, classes(rows)[i][0]) for i, (d, _) in enumerate(rows))


def test_links_at_the_bound_meet_in_rare_shingles(spark):
    """Every pair that is a link is found by the rare shingles alone, in classes of all lengths."""
    draw = random.Random(3)
    shingles, rows = {}, []
    for group in range(12):
        base = [draw.randint(0, 2**31) for _ in range(draw.choice([8, 20, 33, 60, 140]))]
        for _ in range(6):
            own = list(base)
            for _ in range(draw.randint(0, max(1, len(own) // 18))):
                at = draw.randrange(len(own))
                own[at : at + draw.randint(0, 1)] = [draw.randint(0, 2**31)] * draw.randint(0, 2)
            node = len(rows)
            rows.append((node, [x - 2**31 if x >= 2**31 else x for x in own]))
            shingles[node] = order_minhash.labelled_shingles(np.array(own, dtype=np.uint32))
    words = spark.createDataFrame(rows, "rid long, words array<int>")
    buckets = spark.createDataFrame([(n, 1) for n, _ in rows], "node long, bucket long")
    alone = spark.createDataFrame([(n, n) for n, _ in rows], "node long, comp long")
    pairs = {(r.a, r.b) for r in order_minhash._split(buckets, alone, words).collect()}
    links = {(a, b) for a in shingles for b in shingles if b < a and order_minhash.similarity(shingles[a], shingles[b]) >= 0.8}
    assert links and links <= pairs
    assert len(pairs) < len(rows) * len(rows) / 8


def test_recall_against_all_rows(spark):
    """Links of every row whose id is divisible by 50, against all rows of the standard documents."""
    frame = pd.read_parquet(SF.replace("0.001", "0.01"))
    found = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(spark.read.parquet(SF.replace("0.001", "0.01"))).collect()}
    shingles = {d: order_minhash.labelled_shingles(order_minhash.word_hashes(t or "")[0]) for d, t in zip(frame.doc_id.tolist(), frame.text)}
    links = [(a, b) for a in shingles if a % 50 == 0 for b in shingles if a != b and order_minhash.similarity(shingles[a], shingles[b]) >= 0.8]
    caught = sum(found[a] == found[b] for a, b in links)
    assert links and caught >= 0.99 * len(links)


def test_a_link_shares_a_sketch():
    """The stated bound of misses, at similarity 0.8, for texts of equal length and for one that holds the other."""
    from math import comb

    for union in range(5, 1000):
        shared = -(-4 * union // 5)
        long = (1 - comb(shared, order_minhash.MINIMA) / comb(union, order_minhash.MINIMA)) ** order_minhash.SKETCHES if shared >= order_minhash.MINIMA else 1.0
        for larger in (union - (union - shared) // 2, union):
            short = (1 - comb(shared, order_minhash.SHORT_MINIMA) / comb(union, order_minhash.SHORT_MINIMA)) ** order_minhash.SHORT_SKETCHES if larger <= order_minhash.SHORT else 1.0
            assert long * short < 1e-4, (union, larger)


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.comp for r in order_minhash.components(links).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_no_near_copies(spark, table):
    assert order_minhash.near_duplicates(table([])).count() == 0
    assert [r.kept for r in order_minhash.near_duplicates(table([(1, "a b c")])).collect()] == [True]


def test_stages_keep_one_row_of_each_group(spark, table):
    import corpus_pipeline

    long = " ".join(f"word{i}" for i in range(40))
    rows = [*AWKWARD, (7, long), (7, long), (7, "other"), (None, long.upper()), (None, "alone"), (None, "alone"), *[(None, f"hot {i % 3}") for i in range(300)], *[(8, "HOT 0")] * 300]
    first = {}
    for doc, text in rows:
        first.setdefault(low(text), []).append(doc)
    want = sorted((t, str(min((d for d in ids if d is not None), default=None))) for t, ids in first.items())
    docs = table(rows)
    exact = corpus_pipeline.exact_dedup(spark, docs, "")
    assert exact.columns == docs.columns and sorted((low(r.text), str(r.doc_id)) for r in exact.collect()) == want
    near = corpus_pipeline.near_dedup(spark, docs, "")
    found = sorted(str(r.doc_id) for r in near.collect())
    distinct = list(dict.fromkeys((d, low(t)) for d, t in rows))
    parts = {}
    for i, (doc, _) in enumerate(distinct):
        parts.setdefault(str(order_minhash.word_hashes(distinct[i][1])[1]), []).append(doc)
    assert near.columns == docs.columns and found == sorted(str(min((d for d in ids if d is not None), default=None)) for ids in parts.values())


def without_repeats(rows, threshold):
    """Byte by byte: rows (doc_id, text) without repeated ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - threshold + 1):
            window = raw[at : at + threshold]
            if window in seen:
                gone[at : at + threshold] = b"\1" * threshold
            seen.add(window)
        out[doc] = (len(raw), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_passages_equal_all_windows(spark, table, monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    draw = random.Random(3)
    passages = ["".join(draw.choice("abcdé ") for _ in range(draw.randint(90, 260))) for _ in range(6)]
    rows = [(i, "".join(draw.choice([*passages, "".join(draw.choice("xyz ") for _ in range(50))])[draw.randint(0, 40) :] for _ in range(draw.randint(0, 6)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "a" * 3000), (53, "ab" * 400), (None, passages[0] * 2), (54, passages[1]), (55, passages[1])]
    found = suffix_dedup.digest(suffix_dedup.without_repeats(table(rows))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == without_repeats(rows, 100)


def test_passages_of_nothing_and_of_repeated_rows(spark, table):
    assert suffix_dedup.without_repeats(table([])).count() == 0
    text = " ".join(f"word{i}" for i in range(60))
    found = suffix_dedup.digest(suffix_dedup.without_repeats(table([(1, text), (1, text)]))).collect()
    assert [r.n_removed for r in found] == [0, 0]


def test_texts_under_one_id(spark, table):
    """Different texts of one doc_id are documents in the order of a hash; repeated rows are one document; null ids come last."""
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(150))
    rows = [(1, passage + "x"), (1, "y" + passage), (1, "y" + passage), (2, passage), (None, passage + "z"), (None, passage + "z")]
    found = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.digest(suffix_dedup.without_repeats(table(rows))).collect()]
    first = [r for r in found if r[0] == 1]
    assert sorted(r[2] for r in first) in ([0, 150, 150], [0, 0, 150])  # one of the two texts is the earlier
    assert [r[2] for r in found if r[0] == 2] == [150] and [r[2] for r in found if r[0] is None] == [150, 150]


@pytest.mark.parametrize("seed", range(3))
def test_near_equal_stretches_equal_all_windows(spark, table, seed):
    """Copies with edits in all places: stretches that differ, with shared windows on either side of the edit."""
    draw = random.Random(seed)
    base = "".join(draw.choice("abcdefghij ") for _ in range(400))
    rows = []
    for i in range(25):
        own = list(base)
        for _ in range(draw.randint(0, 4)):
            at = draw.randrange(len(own))
            own[at : at + draw.randint(0, 2)] = draw.choice(["", "Q", "ZZ"])
        rows.append((i, "".join(own)))
    found = suffix_dedup.digest(suffix_dedup.without_repeats(table(rows))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == without_repeats(rows, 100)


@pytest.mark.parametrize(("threshold", "gram"), [(60, 20), (150, 40)])
def test_other_thresholds(spark, table, threshold, gram):
    draw = random.Random(threshold)
    passage = "".join(draw.choice("abcd ") for _ in range(300))
    rows = [(i, passage[draw.randint(0, 99) : draw.randint(150, 300)] + str(i)) for i in range(12)]
    found = suffix_dedup.digest(suffix_dedup.without_repeats(table(rows), threshold, gram)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == without_repeats(rows, threshold)


def test_thresholds_that_are_too_near(spark, table):
    with pytest.raises(ValueError):
        suffix_dedup.without_repeats(table([]), 50, 40)


def test_passages_of_the_standard_documents(spark):
    frame = pd.read_parquet(SF)
    found = suffix_dedup.digest(suffix_dedup.without_repeats(spark.read.parquet(SF))).collect()
    want = without_repeats(list(zip(frame.doc_id.tolist(), frame.text.tolist())), 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want
