"""Operators on small cases with known results, and kernels by their properties."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import kernels, keyed
from tessera.operators import aggregates, conditions, joins, metrics, ordered, selection
from tessera.sources import arrays, folds


def pairwise_auc(p, y):
    wins = [(a > b) + 0.5 * (a == b) for a, s in zip(p, y, strict=True) if s for b, t in zip(p, y, strict=True) if not t]
    return sum(wins) / len(wins)


def test_auc_with_ties_and_constant_class(spark):
    rng = np.random.default_rng(3)
    p, y = rng.integers(0, 6, 60) / 5, rng.integers(0, 2, 60)
    rows = [(0, float(a), int(b), int(1 - b)) for a, b in zip(p, y, strict=True)] + [(1, 0.5, 1, 0)]
    got = metrics.class_auc(spark.createDataFrame(rows, "class int, p double, positive int, negative int"), ["class"], "p").collect()
    assert len(got) == 1 and abs(got[0].auc - pairwise_auc(p, y)) < 1e-12


def test_average_precision(spark):
    rows = [(0.9, 1, 0), (0.8, 0, 1), (0.7, 1, 0), (0.7, 0, 1)]
    got = metrics.class_ap(spark.createDataFrame([(0, *r) for r in rows], "class int, p double, positive int, negative int"), ["class"], "p").collect()[0].ap
    assert abs(got - (0.5 * 1.0 + 0.5 * 2 / 4)) < 1e-12


def test_bootstrap_by_matrix_and_by_join_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(c, k, f"f{i % 7}", float(rng.integers(0, 40)) / 40, float(rng.random() < 0.4)) for c in ("reference", "A1", "A2") for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "condition_name string, class int, family string, p double, t double")
    by_matrix = sorted(map(tuple, metrics.bootstrap_delta_auc(df, 25).collect()))
    monkeypatch.setattr(metrics, "FAMILIES_TO_BROADCAST", 3)
    by_join = sorted(map(tuple, metrics.bootstrap_delta_auc(df, 25).collect()))
    assert len(by_matrix) == 2 and all(a[0] == b[0] and a[3] == b[3] and np.allclose(a[1:3], b[1:3]) for a, b in zip(by_matrix, by_join, strict=True))


def test_all_degenerate_gives_no_row(spark):
    rows = spark.createDataFrame([(0, 0.1, 1, 0), (0, 0.2, 1, 0)], "class int, p double, positive int, negative int")
    assert metrics.class_auc(rows, ["class"], "p").count() == 0


def test_combine_folds_leaves_zero_variance_out(spark):
    rows = [("A1", 0, 10, 0.2, 0.0), ("A1", 1, 10, 0.4, 0.5), ("A1", 2, 20, 0.6, 0.5)]
    r = metrics.combine_folds(spark.createDataFrame(rows, "condition_name string, fold int, n int, delta double, variance double")).collect()[0]
    assert abs(r.iv_mean - 0.5) < 1e-12 and abs(r.size_weighted_delta - 0.45) < 1e-12


def test_zero_sum_label_row_stays_zero(spark):
    h = spark.range(1).select(aggregates.normalised(F.array(F.lit(0.0), F.lit(0.0))).alias("h")).collect()[0].h
    assert h == [0.0, 0.0]


def test_slope_without_energy_is_nan(spark):
    p = spark.createDataFrame([(1, 3, 0.0), (1, 4, 0.0)], "k int, r int, profile double")
    assert np.isnan(aggregates.loglog_slope(p, "k", "r", 2, 9).collect()[0].alpha)


def test_strict_lookup_fails_on_missing(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no reference row"):
        joins.strict_lookup(left, right, ["k"], "v").collect()


def test_apportion_sums_with_fewer_rows_than_bins(spark):
    density = spark.createDataFrame([(i, 0.25) for i in range(4)], "bin int, density double")
    totals = spark.createDataFrame([("a", 3), ("b", 10)], "k string, total int")
    got = ordered.apportion(density, totals, "k").groupBy("k").agg(F.sum("n").alias("n")).collect()
    assert {r.k: r.n for r in got} == {"a": 3, "b": 10}


def test_balancer_waits_for_its_lag(spark):
    rows = [(t, e, float(v)) for t, vs in (("a", [4, 3, 2, 1]), ("b", [1, 1, 1, 1])) for e, v in enumerate(vs)]
    ema = ordered.moving_average(spark.createDataFrame(rows, "term string, epoch int, loss double"), "term", "epoch", "loss", 0.5)
    got = {r.epoch: r.weight_a for r in ordered.balanced_weights(ema, "term", "epoch", ("a", "b"), 2, 0.1, (0.3, 0.7)).collect()}
    assert got[0] == got[1] == 0.5 and got[2] == 0.3 == got[3]


def test_condition_counts_and_marginals(spark):
    all_ = conditions.all_conditions(spark)
    assert {r.k: r["count"] for r in all_.groupBy("k").count().collect()} == {0: 1, 1: 7, 2: 15, 3: 13}
    m = {r.code: round(r.probability, 3) for r in conditions.marginals(all_).collect()}
    assert m == {c: 0.140 if c in conditions.EXCLUSIVE else 0.246 for c in conditions.CODES}
    assert conditions.fixed_grid(spark).count() == 23


def test_restricted_draw_rejects_whole_draws(spark):
    every = conditions.all_conditions(spark)
    mass = 0.2 + 0.4 * 6 / 7 + 0.3 * 12 / 15 + 0.1 * 10 / 13  # what drawing accepts without A7
    got = {r.condition_name: r.probability for r in conditions.restricted(every, [c for c in conditions.CODES if c != "A7"]).collect()}
    assert len(got) == 29 and abs(got["reference"] - 0.2 / mass) < 1e-12 and abs(got["A1+A3"] - 0.3 / 15 / mass) < 1e-12
    n = 20000
    items = spark.range(n).withColumnRenamed("id", "stem")
    drawn = conditions.draw(items, every, (F.col("stem") + 0.5) / n, ["A1", "A3"]).groupBy("condition_name").count().collect()
    share = {r.condition_name: r["count"] / n for r in drawn}
    weights = {"reference": 0.2, "A1": 0.4 / 7, "A3": 0.4 / 7, "A1+A3": 0.3 / 15}
    assert all(abs(share[c] - w / sum(weights.values())) < 1e-3 for c, w in weights.items()) and len(share) == 4


def test_blocks_move_as_wholes(spark):
    rows = [(c, y, x, 100 * y + x) for c in (0, 1) for y in range(8) for x in range(8)] + [(2, 0, 0, 7)]
    got = ordered.permute_blocks(spark.createDataFrame(rows, "c int, y int, x int, v int"), ["c"], 8, 4, lambda b: (b * 7 + F.col("c") + 3) % 4).collect()
    at = {(r.c, r.y, r.x): r.v for r in got}
    assert len(at) == len(rows) and at[2, 0, 0] == 7
    for c in (0, 1):
        order = sorted(range(4), key=lambda b: ((b * 7 + c + 3) % 4, b))
        for place, b in enumerate(order):
            assert all(at[c, place // 2 * 4 + i, place % 2 * 4 + j] == 100 * (b // 2 * 4 + i) + b % 2 * 4 + j for i in range(4) for j in range(4))


def test_ranks_fill_bins_exactly(spark):
    values = spark.createDataFrame([("a", float(i % 5), i) for i in range(20)] + [("b", 1.0, 0)], "k string, v double, t int")
    counts = spark.createDataFrame([("a", 0, 3), ("a", 1, 0), ("a", 2, 17), ("b", 0, 0), ("b", 1, 1)], "k string, bin int, n long")
    got = selection.matched_bins(values, counts, "k", "v", "t").collect()
    order = sorted((r.v, r.t, r.bin) for r in got if r.k == "a")
    assert [b for _, _, b in order] == [0] * 3 + [2] * 17 and [r.bin for r in got if r.k == "b"] == [1]


def test_probability_table_is_checked():
    from tessera.functions import palette

    good = np.ones((32**3, 11))
    assert np.allclose(palette.checked_table(good), 1 / 11)
    for bad in (good[:5], -good, good * np.nan, good * 0):
        with pytest.raises(ValueError, match="table|weight"):
            palette.checked_table(bad)


def test_named_colours_follow_an_injected_table(spark):
    from tessera.operators import colour

    pixels = spark.createDataFrame([(1, 0, 200, 30, 30), (1, 1, 0, 0, 0), (2, 0, 250, 250, 250)], "stem int, pix int, r int, g int, b int")
    weights = np.zeros((32**3, 11))
    weights[:, 9] = 1.0  # everything is white
    assert {r.label for r in colour.named(colour.foreground(pixels), weights).collect()} == {"white"}
    gone = colour.removed(pixels, "white", weights).collect()
    assert all(abs(r.r1 - r.g1) < 1e-3 and abs(r.g1 - r.b1) < 1e-3 for r in gone)


def test_gray_of_a_gray_is_itself(spark):
    from tessera.operators import colour

    rows = spark.createDataFrame([(v, v, v) for v in range(256)], "r int, g int, b int")
    assert all(abs(r.r8 - r.r) <= 1 and r.r8 <= r.r for r in colour.gray(rows).collect())


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 4, 8]))
def test_permutation_keeps_the_multiset(seed, side):
    rng = np.random.default_rng(seed)
    image = rng.integers(0, 256, (16, 16, 3), dtype=np.uint8)
    assert np.array_equal(np.sort(kernels.permute_blocks(image, side, rng).reshape(-1, 3), axis=0), np.sort(image.reshape(-1, 3), axis=0))


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_codec(seed):
    a = np.random.default_rng(seed).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert np.array_equal(kernels.decode_array(kernels.encode_array(a)), a)


def test_box_blur_against_loops():
    image = np.random.default_rng(0).integers(0, 256, (9, 11, 3), dtype=np.uint8)
    padded = np.pad(image.astype(float), ((0, 0), (2, 2), (0, 0)), mode="symmetric")
    want = np.rint(np.stack([padded[:, i : i + 5].mean(axis=1) for i in range(11)], axis=1))
    assert np.abs(kernels.box_blur(image, 0, 5) - want).max() <= 1e-9


def test_median_blur_against_loops():
    image = np.random.default_rng(0).integers(0, 256, (8, 8, 3), dtype=np.uint8)
    padded = np.pad(image, ((1, 1), (1, 1), (0, 0)), mode="edge")
    want = np.array([[np.median(padded[y : y + 3, x : x + 3].reshape(-1, 3), axis=0) for x in range(8)] for y in range(8)])
    assert np.array_equal(kernels.median_blur(image, 3), want)


def test_uniform_image_has_no_slope():
    assert np.isnan(kernels.slope_of(np.full((32, 32, 3), 7, dtype=np.uint8)))


def test_positions_of_each_kind():
    rng = np.random.default_rng(0)
    places = np.array([[1, 1], [1, 2], [5, 5]])
    assert kernels.sample_positions(0, (0, 0), places, np.array([0, 0, 1]), 3, rng).tolist() == [[0, 0]] * 3
    assert kernels.sample_positions(1, (4, 2), places, np.array([0, 0, 1]), 2, rng).tolist() == [[4, 2]] * 2
    assert len(kernels.sample_positions(2, (0, 0), places, np.array([0, 0, 1]), 5, rng)) == 5


def test_seed_is_stable():
    assert keyed.seed_of("a", 1) == keyed.seed_of("a", 1) != keyed.seed_of("a", 2)


def test_array_files(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "bird_Back_1.zst").write_bytes(kernels.encode_array(a))
    row = arrays.read_arrays(spark, str(tmp_path)).collect()[0]
    assert (row.stem, row.height, row.width, bytes(row.data)) == ("bird_Back_1", 2, 4, a.tobytes())
    spark.dataSource.register(arrays.NpyZst)
    assert spark.read.format("npyzst").load(str(tmp_path)).collect()[0].stem == "bird_Back_1"


def test_fold_file(spark, tmp_path):
    header = ",".join(["name_of_img", "family", *folds.HABITATS])
    (tmp_path / "f.csv").write_text(f"{header}\nx_Side_2.jpg,Paridae,{','.join(['10'] * 10)}\ny_Back_1.jpg,Paridae,{','.join(['0'] * 10)}\n")
    rows = {r.stem: r for r in folds.read_fold(spark, str(tmp_path / "f.csv")).collect()}
    assert rows["x_Side_2"].view == "Side" and abs(sum(rows["x_Side_2"].habitat) - 1) < 1e-12 and sum(rows["y_Back_1"].habitat) == 0


def test_config_includes(tmp_path):
    (tmp_path / "base.yaml").write_text("a: 1\nb: x\n")
    (tmp_path / "run.yaml").write_text("includes: base.yaml\nb: 2.5\n")
    assert folds.load_config(tmp_path / "run.yaml") == {"a": 1, "b": 2.5}


def test_sinks_resume(spark, tmp_path):
    from tessera.sources import sinks

    path = str(tmp_path / "t")
    sinks.append_missing(spark.range(5), path, ["id"])
    sinks.append_missing(spark.range(8), path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(8))
    assert sinks.reuse_or_build(spark, path, lambda: None).count() == 8
    sinks.write_table(spark.range(3), str(tmp_path / "s" / "v=1"))
    sinks.write_table(spark.range(4), str(tmp_path / "s" / "v=2"))
    (tmp_path / "s" / "v=2" / "_SUCCESS").unlink()
    assert sinks.latest_state(spark, str(tmp_path / "s")).count() == 3


def test_registry_refuses_a_second_kernel():
    from tessera.functions import ablations

    assert set(ablations.REGISTRY) == {"A3", "A4", "A5"}
    with pytest.raises(ValueError, match="registered"):
        ablations.ablation("A3", "crop")(lambda x: x)


def _plain_median(image, k):
    r = k // 2
    padded = np.pad(image, ((r, r), (r, r), (0, 0)), mode="edge")
    return np.array([[np.median(padded[y : y + k, x : x + k], axis=(0, 1)) for x in range(image.shape[1])] for y in range(image.shape[0])]).astype(np.uint8)


def _images(spark, n=3, side=20):
    rng = np.random.default_rng(1)
    rows, arrays_of = [], {}
    for stem in range(n):
        image = np.zeros((side, side, 3), np.uint8)
        image[3:-3, 3:-3] = rng.integers(20, 256, (side - 6, side - 6, 3))
        rows.append((stem, side, side, image.tobytes()))
        arrays_of[stem] = image
    return spark.createDataFrame(rows, "stem long, height int, width int, data binary"), arrays_of


def test_working_images_against_pixels(spark):
    from tessera.functions import palette
    from tessera.operators import chain, colour

    images, arrays_of = _images(spark)
    got = {(r.stem, r.member): chain.image_of(r) for r in chain.working_images(images, median=1).collect()}
    assert {m for s, m in got if s == 0} >= {"", "A1", "A2", "A7"}
    for stem, image in arrays_of.items():
        inside = (image != 0).any(axis=-1)
        pixels = spark.createDataFrame([(stem, i, *map(int, c)) for i, c in enumerate(image[inside])], "stem int, pix int, r int, g int, b int")
        for member, made in (("A1", colour.gray(pixels)), ("A7", colour.chroma_only(pixels))):
            want = np.array([(r.r8, r.g8, r.b8) for r in made.orderBy("pix").collect()])
            assert (got[stem, member][inside] == want).all() and (got[stem, member][~inside] == 0).all()
        for c in (m for s, m in got if s == stem and m.startswith("A6_")):
            changed = (got[stem, c] != image).any(axis=-1)
            labels = {r.pix: r.label for r in colour.named(pixels).collect()}
            hit = np.zeros(inside.shape, bool)
            hit[inside] = [labels[i] == c.removeprefix("A6_") for i in range(inside.sum())]
            assert hit.any() and not (changed & ~hit).any()
    # A2 gives every specimen the same histogram of lightness, up to what rounding to levels does.
    light = [np.sort(palette.lab(got[s, "A2"][(arrays_of[s] != 0).any(axis=-1)])[:, 0]) for s in arrays_of]
    assert all(np.abs(a - light[0]).mean() < 2 for a in light)


def test_bags_follow_the_chain_step_by_step(spark):
    from tessera.operators import chain

    images, arrays_of = _images(spark)
    working = chain.working_images(images, median=3)
    items = chain.condition_items(images.select("stem"), conditions.fixed_grid(spark).filter("side IS NULL OR side IN (1, 4)"), working)
    rows = chain.bags(items, working, chain.candidates(images, (4, 8)), (4, 8), n=3).collect()
    by = {}
    for r in rows:
        by.setdefault((r.stem, r.condition_name), []).append(r)
    names = {c for _, c in by}
    assert {"reference", "A1", "A2", "A5", "A7", "A3_h1_r1", "A4_theta90_L17"} <= names and any(c.startswith("A6_") for c in names)
    for stem, image in arrays_of.items():
        geometry = [(r.source_size, r.y, r.x, r.flip) for r in by[stem, "reference"]]
        assert [g[0] for g in geometry] == [4] * 3 + [8] * 3
        for name in {c for s, c in by if s == stem}:
            assert [(r.source_size, r.y, r.x, r.flip) for r in by[stem, name]] == geometry
        blurred = _plain_median(image, 3)
        for name, base in (("reference", blurred), ("A4_theta90_L17", kernels.box_blur(blurred, 90, 17))):
            for r in by[stem, name]:
                source = base[::-1] if r.flip else base
                crop = source[r.y : r.y + r.source_size, r.x : r.x + r.source_size]
                want = kernels.resize_cubic(np.ascontiguousarray(crop), 8) if r.source_size == 4 else crop
                assert (np.frombuffer(r.data, np.uint8).reshape(8, 8, 3) == want).all()
        for plain, mixed in zip(by[stem, "reference"], by[stem, "A3_h4_r1"], strict=True):
            assert sorted(np.frombuffer(plain.data, np.uint8)) == sorted(np.frombuffer(mixed.data, np.uint8)) and mixed.block == 4
        assert all(abs(r.alpha - (2.19 if r.source_size == 4 else 1.49)) <= 0.1 for r in by[stem, "A5"])


def test_median_blur_of_any_window():
    rng = np.random.default_rng(5)
    for shape, k, top in (((9, 14, 3), 15, 256), ((30, 20, 3), 17, 40), ((8, 8, 1), 1, 3), ((1, 5, 3), 5, 256)):
        image = rng.integers(0, top, shape).astype(np.uint8)
        padded = np.pad(image, ((k // 2, k // 2), (k // 2, k // 2), (0, 0)), mode="edge")
        want = np.median(np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(0, 1)), axis=(-2, -1)).astype(np.uint8)
        assert np.array_equal(kernels.median_blur(image, k), want)


def test_canvases_are_dealt_to_tasks(spark):
    """The supplier table is one small file: images that are made where it is read would all be one task's work."""
    from tessera.plans.bags import canvases

    assert canvases(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_bags_are_dealt_by_number(spark):
    """By bytes, a few tasks would get all images."""
    from tessera.operators import chain

    items = spark.createDataFrame([], "stem long, member string, condition_name string, code string, side int, theta int, length int")
    found = chain.bags(items, spark.createDataFrame([], chain.IMAGE), spark.createDataFrame([], "stem long, places array<array<int>>"), (4, 8))
    assert "RepartitionByExpression [stem" in found._jdf.queryExecution().logical().toString()


def test_resize_of_a_stack():
    stack = np.random.default_rng(6).integers(0, 256, (5, 16, 16, 3)).astype(np.uint8)
    assert np.array_equal(kernels.resize_cubic(stack, 28), np.stack([kernels.resize_cubic(image, 28) for image in stack]))


def test_crops_are_cut_once_for_conditions_that_share_them(monkeypatch):
    """Resizing anew for every condition took most of a bag's time."""
    from types import SimpleNamespace

    from tessera.operators import chain

    calls, resize = [], kernels.resize_cubic
    monkeypatch.setattr(kernels, "resize_cubic", lambda stack, side: calls.append(len(stack)) or resize(stack, side))
    image = np.random.default_rng(7).integers(1, 256, (24, 24, 3)).astype(np.uint8)
    asked = [{"condition_name": name, "code": code, "side": side, "theta": theta, "length": length} for name, code, side, theta, length in (("reference", "", None, None, None), ("A5", "A5", None, None, None), ("A3_h4_r1", "A3", 4, None, None), ("A3_h1_r1", "A3", 1, None, None), ("A4_theta90_L5", "A4", None, 90, 5))]
    row = SimpleNamespace(stem=3, height=24, width=24, data=image.tobytes(), asked=asked, flip=True, ys=[[0, 9], [3, 12]], xs=[[1, 16], [5, 0]])
    rows = list(chain.condition_rows(row, (8, 12), np.ndarray.tobytes))
    assert calls == [2, 2] and [len(made) for made in rows] == [4] * 5
    for source, made in ((image, rows[0]), (kernels.box_blur(image, 90, 5), rows[4])):
        for _, _, i, size, y, x, *_, data in made:
            crop = np.ascontiguousarray(source[::-1][y : y + size, x : x + size])
            assert data == (resize(crop, 12) if i < 2 else crop).tobytes()
    assert [r[4:6] for r in rows[0]] == [(16, 1), (7, 16), (9, 5), (0, 0)]


def test_colours_are_named_once_an_image(monkeypatch):
    """The images without a category named all colours once a category."""
    from tessera.functions import palette
    from tessera.operators import chain

    calls, names = [], palette.hard_names
    monkeypatch.setattr(palette, "hard_names", lambda lab, p: calls.append(len(lab)) or names(lab, p))
    image = np.random.default_rng(8).integers(0, 256, (12, 12, 3)).astype(np.uint8)
    image[:4] = (200, 30, 30)
    made = chain.recoloured_images(image, palette.synthetic_table())
    assert calls == [len(np.unique(image[kernels.foreground(image)], axis=0))] and any(m.startswith("A6_") for m in made)
    assert set(chain.recoloured_images(np.zeros((3, 3, 3), np.uint8), palette.synthetic_table())) == {"A1", "A7"}


def test_medians_of_merged_columns():
    """Windows of 2**n - 1 pixels are medians of merged lists, across tiles and at values of 255 too."""
    rng = np.random.default_rng(9)
    for shape, k, low in (((9, 14, 3), 3, 0), ((20, 33, 2), 7, 200), ((1, 5, 3), 15, 254), ((140, 131, 1), 15, 0), ((33, 40, 1), 31, 0)):
        image = rng.integers(low, 256, shape).astype(np.uint8)
        padded = np.pad(image, ((k // 2, k // 2), (k // 2, k // 2), (0, 0)), mode="edge")
        want = np.median(np.lib.stride_tricks.sliding_window_view(padded, (k, k), axis=(0, 1)), axis=(-2, -1)).astype(np.uint8)
        assert np.array_equal(kernels.median_blur(image, k), want)
        merged = kernels._merged_medians(np.ascontiguousarray(np.pad(padded, ((0, 0), (0, -shape[1] % ((k + 1) // 2)), (0, 0))).swapaxes(0, 1)), k)
        assert np.array_equal(merged.swapaxes(0, 1)[:, : shape[1]], kernels._counted_medians(padded, k))


def test_members_without_images(spark):
    from tessera.operators import chain

    images, _ = _images(spark)
    assert sorted(chain.members(images).collect()) == sorted(chain.working_images(images, median=1).select("stem", "member").collect())


def test_the_bag_chain_reads_no_images_back(spark):
    """A table's reader takes 4,096 rows at once, which are images here: six times sf0.1 ran out of memory."""
    from tessera.plans import bags

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    plan = bags.bag_chain(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert set(os.listdir(shared)) == before
    assert "ShuffledHashJoin [stem" in plan  # images aren't sorted either
