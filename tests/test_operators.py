"""Hand-checked cases and comparisons with plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kinosift.config import PRODUCTION, RetrievalConfig
from kinosift.functions import text, vectors
from kinosift.operators import encoders, evaluation, joins, language_models, progress, scoring, sequence, suppression
from kinosift.plans.index import IndexModels, indexed, spoken, with_speech
from kinosift.plans.master import analysis, answered
from kinosift.sources import files, sinks


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_scene_cut(spark):
    assert one(spark, text.scene_segments(F.col("t")), t="The scene shifts to a dog next to a cat. Finally 3.5 m") == ["a dog", "to a cat", "Finally 3"]


def test_object_cut(spark):
    assert one(spark, text.object_segments(F.col("t")), t="a man runs and then jumps") == ["a man runs", "then jumps"]


def test_whole_text_if_nothing_is_long_enough(spark):
    assert one(spark, text.scene_segments(F.col("t")), t="a. b") == ["a. b"]


def test_registry_of_segmenters(spark):
    text.register_segmenter("halves", lambda t: [t[: len(t) // 2], t[len(t) // 2 :]])
    scene, objects = text.segmenters("halves", "none")
    assert objects is None
    assert one(spark, scene(F.col("t")), t="abcd") == ["ab", "cd"]
    assert text.segmenters("no such", "no such") == (text.scene_segments, text.object_segments)


def test_config_aliases():
    assert (RetrievalConfig(fusion="prod").fusion_mode, RetrievalConfig(chain="plus").chain_mode) == ("harmonic", "add")
    assert (PRODUCTION.discount, PRODUCTION.max_gap_ms) == (0.8, 6000)


def test_harmonic_of_one_segment(spark):
    rows = spark.createDataFrame([(0, 0, 1, 0, 0.3)], "task_idx int, sent_idx int, frame_id int, seg_idx int, sim double")
    assert scoring.scene_scores(rows).first()["score"] == pytest.approx(0.300001, abs=1e-9)


def test_missing_frames_score_zero(spark):
    queries = spark.createDataFrame([(1, 0, 0, 0), (2, 0, 1, 0)], "query_id long, task_idx int, sent_idx int, seg_idx int")
    sims = spark.createDataFrame([(1, 1, -0.2), (2, 2, 0.5)], "query_id long, frame_id long, sim double")
    rows = {(r.query_id, r.frame_id): r.sim for r in scoring.densified(sims, queries, None).collect()}
    assert rows == {(1, 1): -0.2, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 0.5}


def _scores(spark, rows):
    return spark.createDataFrame([(0, v, t, s) for v, t, s in rows], "task_idx int, video_id long, ts_ms long, s array<double>")


def test_chain_by_hand(spark):
    rows = _scores(spark, [(1, 0, [0.9, 0.1]), (1, 1000, [0.1, 0.8]), (1, 2000, [0.1, 0.1]), (2, 0, [1.0, 1.0])])
    found = {(r.video_id, r.ts_ms): (round(r.score, 9), r.path) for r in sequence.chains(rows, 2, 1000, 0.9).collect()}
    assert found == {(1, 1000): (1.62, [0, 1000]), (1, 2000): (0.19, [1000, 2000])}


def test_latest_of_equal_predecessors(spark):
    rows = _scores(spark, [(1, 0, [0.5, 0.0]), (1, 1000, [0.5, 0.0]), (1, 2000, [0.0, 1.0])])
    found = {r.ts_ms: r.path for r in sequence.chains(rows, 2, 5000, 0.9).collect()}
    assert found[2000] == [1000, 2000]


def test_product_chain_of_one_frame(spark):
    found = sequence.chains(_scores(spark, [(1, 0, [0.5, 0.5])]), 2, 1000, 0.9, "prod").collect()
    assert [(r.score, r.path) for r in found] == [(0.0, [0, 0])]


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_a_loop(spark, seed):
    draw = random.Random(seed)
    data = {v: sorted(draw.sample(range(0, 40_000, 500), 25)) for v in range(4)}
    scores = {(v, t): [draw.randint(0, 8) / 8 for _ in range(3)] for v, times in data.items() for t in times}
    gap, discount = 4000, 0.5
    want = {}
    for v, times in data.items():
        best = {t: (scores[v, t][0], [t]) for t in times}
        for m in (1, 2):
            following = {}
            for t in times:
                before = [(best[k][0], k) for k in times if t - gap <= k < t and k in best]
                if before:
                    value, k = max(before)
                    following[t] = (value + scores[v, t][m] * discount**m, [*best[k][1], t])
            best = following
        want |= {(v, t): b for t, b in best.items()}
    found = sequence.chains(_scores(spark, [(v, t, s) for (v, t), s in scores.items()]), 3, gap, discount)
    assert {(r.video_id, r.ts_ms): (r.score, r.path) for r in found.collect()} == want


@pytest.mark.parametrize("seed", range(2))
def test_best_moments_equal_a_loop(spark, seed):
    draw = random.Random(seed)
    frames = [(v, t, [draw.choice([0.1, 0.2, 0.3, None, float("nan"), -0.5])]) for v in range(4) for t in sorted(draw.sample(range(400), 60))]
    paths = [(v, t, [draw.randint(0, t), t]) for v, t, _ in frames if t % 3] + [(9, 5, [1, 5]), (0, 10**6, [10**6 - 1, 10**6])]
    # Spark's order: null first, NaN last.
    rank = lambda x: (0, 0.0) if x is None else (2, 0.0) if x != x else (1, x)
    want = {}
    for v, t, (start, end) in paths:
        inside = [(rank(s[0]), -at, s[0]) for w, at, s in frames if w == v and start <= at <= end]
        if inside:
            want[v, t] = (start, end, -max(inside)[1], str(max(inside, key=lambda x: x[:2])[2]))
    scores = spark.createDataFrame([(0, *f) for f in frames], "task_idx int, video_id long, ts_ms long, s array<double>")
    found = sequence.with_best_moment(spark.createDataFrame([(0, *p) for p in paths], "task_idx int, video_id long, ts_ms long, path array<long>"), scores)
    assert {(r.video_id, r.ts_ms): (r.start_ms, r.end_ms, r.best_ms, str(r.best_score)) for r in found.collect()} == want


def test_best_moment_of_a_sequence_of_any_length(spark):
    scores = _scores(spark, [(1, 0, [0.5, 0.5]), (1, 7, [0.9, 0.9]), (1, 10**15, [0.1, 0.1])])
    found = spark.createDataFrame([(0, 1, 10**15, [0, 10**15])], "task_idx int, video_id long, ts_ms long, path array<long>")
    assert [(r.start_ms, r.end_ms, r.best_ms) for r in sequence.with_best_moment(found, scores).collect()] == [(0, 10**15, 7)]


def test_touching_intervals_clash(spark):
    rows = spark.createDataFrame([(0, 1, 0.9, 5, 0, 5), (0, 1, 0.8, 9, 5, 9), (0, 1, 0.7, 20, 10, 20)], "task_idx int, video_id long, score double, ts_ms long, start_ms long, end_ms long")
    assert sorted(r.ts_ms for r in suppression.per_video(rows).collect()) == [5, 20]


@pytest.mark.parametrize("cap", [10, 1])
def test_exclusion_pads_both_sides(spark, cap):
    rows = [(0, 1, 1, 0, 0.9, 0, 10), (1, 1, 1, 14, 0.8, 14, 20), (1, 2, 2, 0, 0.7, 0, 1)]
    rows = spark.createDataFrame(rows, "task_idx int, rank int, video_id long, frame_ms long, sim double, start_ms long, end_ms long")
    kept = suppression.exclusion(rows, 2, cap).collect()
    assert sorted((r.task_idx, r.video_id, r["rank"]) for r in kept) == [(0, 1, 1), (1, 2, 1)]


def test_slides_by_the_place_in_the_sequence(spark):
    frames = spark.createDataFrame([(1, 1000, [1.0, 0.0]), (1, 2000, [1.0, 0.01])], "video_id long, ts_ms long, emb array<double>")
    moments = [("left", 1, 1000, 2000, 2000, -1), ("right", 1, 1000, 2000, 1000, 1), ("middle", 1, 1000, 2000, 1000, 0)]
    moments = spark.createDataFrame(moments, "key string, video_id long, start_ms long, end_ms long, frame_ms long, edge int")
    assert {r.key: r.slid_ms for r in sequence.slid(moments, frames).collect()} == {"left": 1000, "right": 2000, "middle": 1000}


def test_positions_of_sparse_keys(spark):
    keys = [5, 9, 100, 101, 500, 900]
    rows = spark.createDataFrame([(k,) for k in keys], "k long")
    assert sorted((r.k, r.position) for r in joins.positioned(rows, ["k"]).collect()) == list(zip(keys, range(6)))
    assert sorted(r.k for r in joins.sharded(rows, ["k"], 3, 1).collect()) == [9, 500]
    assert [r.k for r in joins.sharded(rows, ["k"], 3, 1, 1).collect()] == [9]
    assert sorted((r.k, r.chunk) for r in joins.chunked(rows, ["k"], 4).collect()) == [(k, i // 2) for i, k in enumerate(keys)]
    assert joins.positioned(rows.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("ranges", [2, 50])
def test_positions_in_many_ranges(spark, ranges):
    draw = random.Random(ranges)
    rows = [(draw.choice([None, 1, 1, 1, draw.randint(0, 99)]), i) for i in range(600)]
    found = joins.positioned(spark.createDataFrame(rows, "k long, i long"), ["k", "i"], ranges).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.i) for r in sorted(found, key=lambda r: r.position)] == want and sorted(r.position for r in found) == list(range(600))


@pytest.mark.parametrize("ranges", [1, 2, 3, 7, 8, 9, 33])
def test_ranges_are_found_by_halving(spark, ranges):
    draw = random.Random(ranges)
    rows = [(draw.choice(["a", "a", "b", None]), draw.choice([0.5, float("nan"), -1.0, None]), i) for i in range(12 * ranges + 5)]
    found = joins.positioned(spark.createDataFrame(rows, "k string, x double, i long"), ["k", "x", "i"], ranges)
    # Not one comparison per splitter and row.
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    # Spark's order: null first, NaN last.
    rank = lambda x: (0, 0.0) if x is None else (2, 0.0) if x != x else (1, x)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", rank(r[1]), r[2]))
    assert [(r.i, r.position) for r in found.orderBy("position").collect()] == [(r[2], n) for n, r in enumerate(want)]


@pytest.mark.parametrize("seed", range(2))
def test_nearest_frames_equal_a_loop(spark, seed):
    draw = random.Random(seed)
    frames = [(v, n, draw.randint(0, 300)) for v in range(4) for n in range(15)]
    points = [(k, draw.randint(0, 4), draw.randint(-20, 320)) for k in range(200)]
    want = {}
    for key, video, ms in points:
        own = [(abs(t - ms), n, t) for v, n, t in frames if v == video]
        want[key] = min(own)[1:] if own else (None, None)
    found = joins.nearest(spark.createDataFrame(points, "key long, video_id long, ms long"), spark.createDataFrame(frames, "video_id long, frame_no int, ts_ms long"))
    assert {r.key: (r.frame_no, r.ts_ms) for r in found.collect()} == want
    points, frames = spark.createDataFrame(points, "key long, video_id long, ms long"), spark.createDataFrame(frames, "video_id long, frame_no int, ts_ms long")
    for width in (7, 50):  # buckets without frames between those that have some
        assert {r.key: tuple(r.near)[::-1] if r.near else (None, None) for r in joins.with_nearest(points, "ms", frames, width).collect()} == want


def test_top_similar_in_several_blocks(spark, monkeypatch):
    draw = random.Random(1)
    queries = spark.createDataFrame([(i, [draw.random(), draw.random()]) for i in range(9)], "query_id long, vec array<double>")
    frames = spark.createDataFrame([(i, [draw.randint(0, 3) / 4, 0.5]) for i in range(300)], "frame_id long, emb array<double>").repartition(3)
    monkeypatch.setattr(scoring, "BLOCK_VALUES", 6)
    monkeypatch.setattr(scoring, "FRAME_ROWS", 7)
    rows = lambda df: sorted((r.query_id, r["rank"], r.frame_id) for r in df.collect())
    assert rows(scoring.top_similar(queries, frames, 12)) == rows(scoring.top_frames(scoring.similarity_blocks(queries, frames), 12))
    assert scoring.top_similar(queries.limit(0), frames, 3).count() == 0


def test_exclusion_without_an_action(spark):
    rows = spark.createDataFrame([(0, 1, 1, 0, 0.9, 0, 10), (1, 1, 1, 14, 0.8, 14, 20)], "task_idx int, rank int, video_id long, frame_ms long, sim double, start_ms long, end_ms long")
    assert [r.task_idx for r in suppression.exclusion(rows, 2, 10, most=10).collect()] == [0]


def test_too_many_predictions_for_one_fold(spark, monkeypatch):
    monkeypatch.setattr(suppression, "FOLD_ROWS", 1)
    rows = spark.createDataFrame([(0, 1, 1, 0, 0.9, 0, 10), (1, 1, 1, 14, 0.8, 14, 20)], "task_idx int, rank int, video_id long, frame_ms long, sim double, start_ms long, end_ms long")
    with pytest.raises(ValueError):
        suppression.exclusion(rows, 2)


def test_language_model_answers():
    assert language_models.parsed('Sure: {"scenes": [" a ", "", 3, "b"]} done') == ["a", "b"]
    assert language_models.parsed('["x"]') == ["x"]
    assert language_models.parsed("[]") == []
    assert [language_models.parsed(t) for t in ("no", "{broken", '{"a": [1}', '{"scenes": 3}')] == [None] * 4


def test_language_model_batches_are_halved():
    sizes = []

    def generate(prompts, temperature):
        sizes.append(len(prompts))
        if len(prompts) > 2 or "bad" in prompts:
            raise RuntimeError("too much")
        return [p.upper() for p in prompts]

    assert language_models.answers(generate, ["a", "b", "bad", "c"], 4) == ["A", "B", "", "C"]
    assert sizes[:2] == [4, 2] and max(sizes[2:]) <= 2


def test_language_model_attempts():
    tried = []

    def generate(prompts, temperature):
        tried.append(temperature)
        return ['["ok"]' if temperature > 0.4 else "?"]

    assert language_models.attempted(generate, "x") == ["ok"] and tried == [0.3, 0.5]
    assert language_models.attempted(lambda p, t: ["?"], "x") is None


def test_language_model_cache(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a. b"), (2, "a. b"), (3, "known"), (4, "odd"), (5, None)], "id long, text string")
    cache = texts.filter("id = 3").select(F.sha2("text", 256).alias("text_hash"), F.array(F.lit("from"), F.lit("cache")).alias("segments"))
    make = lambda: lambda prompts, t: ["?" if p == "odd" else '["' + p.replace(". ", '","') + '"]' for p in prompts]
    found, gained = language_models.segmented(texts, cache, make, prompt="{text}")
    assert {r.id: r.segments for r in found.collect()} == {1: ["a", "b"], 2: ["a", "b"], 3: ["from", "cache"], 4: ["odd"], 5: [None]}
    assert [r.segments for r in gained.collect()] == [["a", "b"]]


def test_failures_are_set_aside_and_their_videos_wait(spark, tmp_path):
    encoders.register("ocr", "picky", lambda: lambda texts: [t.upper() if t != "bad" else 1 / 0 for t in texts])
    rows = [("v", 0, 0, "a"), ("v", 1, 1000, "b"), ("w", 0, 0, "bad"), ("w", 1, 1000, "c")]
    frames = spark.createDataFrame(rows, "video_id string, frame_no int, ts_ms int, image string")
    whole, failed = indexed(frames, IndexModels(ocr="picky", image=None))
    assert sorted((r.video_id, r.ocr) for r in whole.collect()) == [("v", "A"), ("v", "B")]
    assert [(r.video_id, r.frame_no, r.error) for r in failed.collect()] == [("w", 0, "ocr: ZeroDivisionError: division by zero")]
    sinks.write_failures(failed, str(tmp_path / "failed"))
    assert spark.read.text(str(tmp_path / "failed")).first()["value"].startswith("w\tocr: ")
    expected = spark.createDataFrame([("v", 2), ("w", 3)], "video_id string, n_frames int")
    sinks.write_metadata(frames, expected, str(tmp_path / "meta"))
    assert {r.video_id for r in spark.read.json(str(tmp_path / "meta")).collect()} == {"v"}
    sinks.write_index(frames.withColumn("model", F.lit("m")), str(tmp_path / "index"), expected)
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2


def test_batches_of_one_size():
    import pandas as pd

    sizes = []
    call = lambda inputs: (sizes.append(len(inputs)), [x * 2 for x in inputs])[1]
    found = list(encoders._batched(iter([pd.Series([1, 2, 3]), pd.Series([4, 5]), pd.Series([], dtype=int), pd.Series([6, 7])]), 4, call))
    assert [x for s in found for x in s] == [2, 4, 6, 8, 10, 12, 14] and sizes == [4, 3]
    assert [len(s) for s in encoders._batched(iter([pd.Series([1, 2, 3]), pd.Series([4])]), None, call)] == [3, 1]


def test_from_images_to_moments(spark):
    lines = ["red car", "blue boat", "green tree", "old man", "white dog", "tall house"]
    rows = [(10 * v + n, v, n, 1000 * n, lines[(n + 2 * v) % 6]) for v in range(3) for n in range(5)]
    images = spark.createDataFrame(rows, "frame_id long, video_id long, frame_no int, ts_ms int, image string")
    tasks = spark.createDataFrame([("t0", 0, "white dog"), ("t1", 1, "green tree. old man")], "task_id string, task_idx int, description string")
    config = RetrievalConfig(smoothing_window=0, overlap_ms=0, position="first", max_gap_ms=5000)
    found, failed = answered(images, tasks, config)
    first = {r.task_id: r for r in found.filter("rank = 1").collect()}
    told = {(r[1], r[3]): r[4] for r in rows}
    assert told[first["t0"].video_id, first["t0"].frame_ms] == "white dog"
    assert (told[first["t1"].video_id, first["t1"].start_ms], told[first["t1"].video_id, first["t1"].end_ms]) == ("green tree", "old man")
    assert failed.count() == 0


def test_reports(spark):
    sims = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "sim double")
    texts = spark.createDataFrame([("a",), (None,)], "text string")
    labels = spark.createDataFrame([(1, 0, 3), (1, 1, 3), (1, 2, 4)], "video_id long, frame_no int, category int")
    found = {name: sorted(map(tuple, rows.collect())) for name, rows in analysis(sims, texts, labels, 2).items()}
    assert found["histogram"] == [(0, 1), (1, 2)] and found["coverage"] == [(50.0,)] and found["categories"] == [(3, 3)]


def test_speech_at_frames(spark):
    index = spark.createDataFrame([("v", 0), ("v", 1500), ("w", 0)], "video_id string, ts_ms int")
    segments = spoken(spark.createDataFrame([("v", "one two\nthree four")], "video_id string, sound string"))
    assert sorted((r.video_id, r.ts_ms, r.speech) for r in with_speech(index, segments).collect()) == [("v", 0, "one two"), ("v", 1500, "three four"), ("w", 0, "")]


def test_array_archives_and_folders(spark, tmp_path):
    import numpy as np

    for video, n in (("a", 2), ("b", 0), ("c", 1)):
        np.savez(tmp_path / f"{video}.npz", emb=np.full((n, 3), 0.5, dtype=np.float16), ts_ms=np.arange(n) * 1000)
        (tmp_path / video).mkdir()
    (tmp_path / "c" / "ts_ms.npy").write_bytes(b"x")
    found = sorted((r.video_id, r.frame_no, r.ts_ms, list(r.emb)) for r in files.index_shards(spark, str(tmp_path)).collect())
    assert found == [("a", 0, 0, [0.5] * 3), ("a", 1, 1000, [0.5] * 3), ("c", 0, 0, [0.5] * 3)]
    assert [r.video_id for r in files.keyframe_folders(spark, str(tmp_path)).collect()] == ["c"]


def test_videos_and_lists(spark, tmp_path):
    (tmp_path / "V3C1" / "videos" / "00001").mkdir(parents=True)
    (tmp_path / "V3C1" / "videos" / "00001" / "00001.mp4").write_bytes(b"x")
    assert [r.video_id for r in files.videos(spark, str(tmp_path)).collect()] == ["v3c1_00001"]
    (tmp_path / "list.txt").write_text("/x/V3C2/7.mp4\n\n  \n/y/8.mp4\n")
    assert sorted(r.video_id for r in files.video_list(spark, str(tmp_path / "list.txt")).collect()) == ["v3c2_7", "v3c_8"]


def test_globs_and_runs():
    assert [files.video_glob(p) for p in ("/d", "/d/V3C1/videos/", "/x/*.mp4")] == ["/d/*/videos/*/*.mp4", "/d/V3C1/videos/*/*.mp4", "/x/*.mp4"]
    assert files.latest_run(["a", "b"], {"a": 2.0, "b": 1.0}) == "a" and files.latest_run(["a"]) is None
    assert (files.next_run([]), files.next_run(["002", "x", "010"])) == ("001", "011")


def test_a_saved_run(spark, tmp_path):
    import json
    import zipfile

    rows = spark.createDataFrame([("t", 1, "v", 5, 0, 9, 0.5)], "task_id string, rank int, video_id string, frame_ms long, start_ms long, end_ms long, sim double")
    for number in ("001", "002"):
        run = sinks.save_run(rows, str(tmp_path / "runs"), {"gap": 3})
        assert run.endswith(number)
    plain = json.loads((tmp_path / "runs" / "002" / "submission.json").read_text())
    assert plain == {"predictions": [{"task_id": "t", "results": [{"rank": 1, "video_id": "v", "frame_ms": 5}]}]}
    assert json.loads((tmp_path / "runs" / "002" / "detailed_submission.json").read_text())["predictions"][0]["results"][0]["sim"] == 0.5
    assert json.loads((tmp_path / "runs" / "002" / "config.json").read_text()) == {"gap": 3}
    assert json.loads(zipfile.ZipFile(tmp_path / "runs" / "002" / "submission.zip").read("submission.json")) == plain
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["video_id"] == "v"


def test_counts_on_the_side(spark):
    rows, seen = progress.counted(spark.range(10), most=F.max("id"))
    assert len(rows.collect()) == 10 and seen.get == {"n": 10, "most": 9}
    ticks = iter([0.0, 2.0, 4.0])
    meter = progress.Progress(10, lambda: next(ticks))
    assert meter.add(4) == {"done": 4, "rate": 2.0, "left_s": 3.0}
    assert meter.add(4) == {"done": 8, "rate": 2.0, "left_s": 1.0}


def test_language_models_have_no_stand_in():
    with pytest.raises(ValueError):
        text.segmenters("qwen", "none")
    assert text.segmenters("SAT", "spacy") == (text.whole_text, text.whole_text)


def test_smoothing_windows(spark):
    frames = spark.createDataFrame([(1, 0, [1.0, 0.0])], "video_id long, frame_no int, emb array<double>")
    assert vectors.smoothed(frames, 1) is frames
    with pytest.raises(ValueError):
        vectors.smoothed(frames, 4)
    assert vectors.smoothed(frames, 3).first()["emb"] == [1.0, 0.0]


def test_block_similarity_in_several_blocks(spark, monkeypatch):
    queries = spark.createDataFrame([(i, "m", [float(i), 1.0]) for i in range(5)], "query_id long, model string, vec array<double>")
    frames = spark.createDataFrame([(i, "m", [1.0, float(i)]) for i in range(7)], "frame_id long, model string, emb array<double>")
    monkeypatch.setattr(scoring, "BLOCK_VALUES", 4)
    rows = lambda df: sorted((r.query_id, r.frame_id, round(r.sim, 9)) for r in df.collect())
    want = sorted((q, f, round(0.8 * (q + f), 9)) for q in range(5) for f in range(7))
    assert rows(scoring.similarity_blocks(queries, frames)) == rows(scoring.similarity(queries, frames)) == rows(scoring.similarity_models(queries, frames)) == want


def test_similarity_of_several_models(spark):
    vectors_of = {("q", "a"): [1.0, 2.0], ("q", "b"): [0.5, 0.0, 1.0], ("f", "a"): [3.0, -1.0], ("f", "b"): [2.0, 7.0, 1.0]}
    queries = spark.createDataFrame([(1, m, v) for (k, m), v in vectors_of.items() if k == "q"], "query_id long, model string, vec array<double>")
    frames = spark.createDataFrame([(5, m, v) for (k, m), v in vectors_of.items() if k == "f"], "frame_id long, model string, emb array<double>")
    for way in (scoring.similarity, scoring.similarity_models):
        assert way(queries, frames).first()["sim"] == pytest.approx(0.8 * (1.0 + 2.0) / 2)
    with pytest.raises(Exception):
        scoring.similarity_models(queries, frames.filter("model = 'a'")).collect()


@pytest.mark.parametrize("block", [1, 1_000])
def test_similarity_shuffles_no_pair(spark, monkeypatch, block):
    """A pair counts the models that both have; without any it is left out, and products that are null don't count."""
    monkeypatch.setattr(scoring, "BLOCK_VALUES", block)
    queries = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "b", [4.0, 0.0]), (2, "a", [1.0, 1.0]), (3, "c", [9.0, 9.0]), (4, None, [1.0, 1.0])], "query_id long, model string, vec array<double>")
    frames = spark.createDataFrame([(5, "a", [3.0, 1.0]), (5, "b", [1.0, 1.0]), (6, "b", [0.5, 1.0]), (7, "a", None), (8, "b", [None, 1.0]), (8, "a", [1.0, 0.0]), (9, None, [1.0, 1.0])], "frame_id long, model string, emb array<double>")
    found = scoring.similarity(queries, frames)
    plan = found._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\((query_id#\d+L?, frame_id|model)", plan)
    want = {(1, 5): 4.5, (1, 6): 2.0, (1, 7): None, (1, 8): 1.0, (2, 5): 4.0, (2, 7): None, (2, 8): 1.0}
    assert {(r.query_id, r.frame_id): r.sim for r in found.collect()} == {k: None if v is None else pytest.approx(0.8 * v) for k, v in want.items()}
    assert scoring.similarity(queries.limit(0), frames).count() == 0


def test_frames_that_do_not_align(spark):
    left, right = (spark.createDataFrame([(k, 1)], f"id long, {side}_row int") for k, side in ((1, "left"), (2, "right")))
    with pytest.raises(Exception, match="don't align"):
        joins.aligned(left, right, ["id"]).collect()


def test_first_matching_segment_counts(spark):
    frames = spark.createDataFrame([("v", 2000), ("w", 5)], "video_key string, ts_ms long")
    segments = spark.createDataFrame([("v", 0, 1.0, 2.0, " a "), ("v", 1, 2.0, 3.0, "b")], "video_key string, seg_no int, start double, end double, text string")
    assert {r.video_key: r.text for r in joins.transcript_text(frames, segments).collect()} == {"v": "a", "w": ""}


def test_half_to_even_times(spark):
    log = "pts_time:0.0005 x pts_time:0.0015 y pts_time:0.0025"
    assert one(spark, files.frame_times(F.col("t")), t=log) == [0, 2, 2]


def test_rank_by_video_and_by_distinct_video(spark):
    rows = spark.createDataFrame([("t", "s", 1, "A"), ("t", "s", 2, "A"), ("t", "s", 3, "B")], "task_id string, submission string, rank int, video_id string")
    labels = spark.createDataFrame([("t", "B")], "task_id string, answer_video_id string")
    assert evaluation.hit_ranks(rows, labels).first()["hit_rank"] == 3
    board = evaluation.leaderboard(rows, labels.withColumnRenamed("answer_video_id", "video_id")).first()
    assert (board["hits"], board["mrr"], board["evaluated"]) == (1, 0.5, 1)


def test_unknown_model():
    with pytest.raises(ValueError):
        encoders.model("text", "no such model")


def test_files(spark, tmp_path):
    (tmp_path / "tasks.jsonl").write_text('{"task_id":"b","description":"x"}\n\n{"task_id":"a","description":"y","max_predictions":3}\n')
    rows = files.tasks(spark, str(tmp_path / "tasks.jsonl"), 1).collect()
    assert [(r.task_idx, r.task_id, r.max_predictions) for r in rows] == [(0, "b", 10)]
    (tmp_path / "labels.csv").write_text('task_id,description,answer_video_id,answer_start_ms,answer_end_ms,confidence,description_quartile\nt,"a ""b"", c",v,1,2,0.5,4\n')
    assert files.labels(spark, str(tmp_path / "labels.csv")).first()["description"] == 'a "b", c'
    (tmp_path / "s.json").write_text('{"predictions":[{"task_id":"t","results":[{"rank":1,"video_id":"v","frame_ms":5}]},{"task_id":"t","results":[{"rank":1,"video_id":"w","frame_ms":6}]}]}')
    assert [r.video_id for r in files.submission(spark, str(tmp_path / "s.json")).collect()] == ["w"]
    (tmp_path / "m.jsonl").write_text('{"video_id":"v","ts_ms":5,"ocr":"x"}\nnot json\n')
    assert files.metadata(spark, str(tmp_path / "m.jsonl")).count() == 1
    for name, said in (("a.json", "old"), ("b.json", "new")):
        (tmp_path / f"transcripts_{name}").write_text('{"v":[{"start":0.0,"end":1.0,"text":"%s"}]}' % said)
    assert [r.text for r in files.transcripts(spark, str(tmp_path / "transcripts_*.json")).collect()] == ["new"]
    assert files.latest_run(["9", "10", "x"]) == "10"


def test_sinks_and_increments(spark, tmp_path):
    from kinosift.streaming.incremental import index_new

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a", 1.0)], "video_id string, x double").write.mode("append").parquet(source)
    run = lambda: index_new(spark, source, "video_id string, x double", target, str(tmp_path / "progress"), lambda df: df.withColumn("y", F.col("x") + 1))
    run()
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "video_id string, x double").write.mode("append").parquet(source)
    run()
    run()
    assert sorted((r.video_id, r.y) for r in spark.read.parquet(target).collect()) == [("a", 2.0), ("b", 3.0)]
    good, bad = sinks.quarantine(spark.createDataFrame([("a", None), ("b", "x")], "id string, error string"))
    assert (good.count(), bad.count()) == (1, 1)
    rows = spark.createDataFrame([("t", 1, "v", 5)], "task_id string, rank int, video_id string, frame_ms long")
    sinks.write_submission(rows, str(tmp_path / "sub"))
    assert spark.read.text(str(tmp_path / "sub")).first()["value"] == '{"task_id":"t","results":[{"rank":1,"video_id":"v","frame_ms":5}]}'


def test_retrieval_takes_scenes_and_limits_from_each_task(spark):
    from kinosift.plans.retrieve import retrieve

    # Video v has six frames; frame k is the k-th unit vector, so scene k of a task matches frame k.  Each task has videos of its own.
    unit = lambda k, v: [float(i == 6 * v + k) for i in range(18)]
    frames = spark.createDataFrame([(6 * v + k, v, k, 1000 * k, unit(k, v)) for v in range(3) for k in range(6)], "frame_id long, video_id long, frame_no int, ts_ms long, emb array<double>")
    asked = [(10 * t + k, t, k, 0, unit(k, t)) for t, scenes in enumerate((1, 2, 5)) for k in range(scenes)]
    queries = spark.createDataFrame(asked, "query_id long, task_idx long, sent_idx int, seg_idx int, vec array<double>")
    tasks = spark.createDataFrame([(0, None, 1), (1, 0, 1), (2, 3, 1)], "task_idx long, target_scene int, max_predictions int")
    config = RetrievalConfig(smoothing_window=0, max_gap_ms=6000, overlap_ms=0, position="first")
    found = {r.task_idx: r for r in retrieve(frames, queries, config, tasks=tasks).collect()}
    assert {t: (r.video_id, r.frame_ms, r.start_ms, r.end_ms, r["rank"]) for t, r in found.items()} == {0: (0, 0, 0, 0, 1), 1: (1, 0, 0, 1000, 1), 2: (2, 3000, 0, 4000, 1)}
    for t, scenes in enumerate((1, 2, 5)):
        assert found[t].sim == pytest.approx(sum(0.8 * 0.9**m for m in range(scenes)), abs=1e-4)
