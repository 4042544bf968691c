import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import metrics as me, probs as pr, relational as rel, rollups as ru
from glyphmill.plans import compositions as co, fits as ft
from glyphmill.sources import tables
from glyphmill.sources.fixtures import Fixtures

SF = "/root/testdata/sf0.001"


def test_csv_roundtrip_and_unpivot(spark, tmp_path):
    wide = spark.createDataFrame([("s1", "A", "WT", "V600E"), ("s2", "B", "R1H", None)], "ID string, label string, g1 string, g2 string")
    path = str(tmp_path / "wide")
    tables.write_csv_ordered(wide, path, ["ID"])
    assert tables.roundtrip_difference(spark, wide, path) == 0
    genes = tables.feature_columns(wide, "ID", "label")
    long = tables.unpivot_cells(tables.read_wide_csv(spark, path, wide.columns), ["ID"], genes)
    assert sorted((r.ID, r.gene, r.cell) for r in long.collect()) == [("s1", "g2", "V600E"), ("s2", "g1", "R1H")]


def test_probability_export_import(spark):
    prob = spark.createDataFrame([(1, "A", 0.2), (1, "B", 0.2), (2, "A", 0.9), (2, "B", 0.1)], "sid long, cls string, p double")
    wide = tables.export_probabilities(prob, ["sid"], ["A", "B"])
    assert wide.columns == ["sid", "prob_A", "prob_B"]
    back = {(r.sid, r.cls): r.p for r in tables.import_probabilities(wide, ["sid"], ["A", "B"]).collect()}
    assert back[1, "A"] == 0.5 and back[2, "A"] == 0.9
    assert tables.probability_families(["m__A", "m__B", "n__A", "x"], ["A", "B"]) == ["m"]


def test_upsert_and_one_to_one(spark):
    a = spark.createDataFrame([("e1", 1.0), ("e2", 2.0)], "k string, v double")
    b = spark.createDataFrame([("e2", 5.0)], "k string, v double")
    assert sorted(map(tuple, tables.upsert(a, b, "k").collect())) == [("e1", 1.0), ("e2", 5.0)]
    with pytest.raises(ValueError):
        rel.join_one_to_one(a.unionByName(a), b, ["k"])


def test_macro_f1_on_union_of_classes(spark):
    pred = spark.createDataFrame([(1, "A", "A"), (2, "A", "B"), (3, "B", "C")], "sid long, truth string, pred string")
    row = me.overall(me.confusion(pred)).first()
    assert abs(row.macro_f1 - (2 / 3 + 0 + 0) / 3) < 1e-12 and abs(row.accuracy - 1 / 3) < 1e-12


def test_roll_up_is_row_independent(spark):
    fx = Fixtures(spark, SF)
    full = ru.sample_profile(fx.typed, fx.samples).filter("sid < 40")
    part = ru.sample_profile(fx.typed.filter("sid < 40"), fx.samples.filter("sid < 40"))
    assert full.exceptAll(part).count() == 0 and part.exceptAll(full).count() == 0


def test_gene_pairs_pruning_is_exact(spark):
    fx = Fixtures(spark, SF)
    presence = ru.gene_presence(fx.events)
    every = ru.gene_pairs(presence).filter("n >= 60")
    pruned = ru.gene_pairs(presence, 60)
    assert every.exceptAll(pruned).count() == 0 and pruned.exceptAll(every).count() == 0


def test_singular_vectors(spark):
    rng = np.random.default_rng(5)
    m = (rng.random((60, 12)) < np.linspace(0.9, 0.1, 12)).astype(float)
    tokens = spark.createDataFrame([(int(i), f"t{j:02d}") for i, j in zip(*np.nonzero(m))], "sid long, token string")
    basis, values = ft.singular_vectors(tokens, 2, rounds=8)
    want = np.linalg.svd(m)[1][:2]
    assert np.allclose(values, want, rtol=1e-3)
    got = np.array([r.v for r in basis.orderBy("token").collect()])
    assert np.allclose(got.T @ got, np.eye(2), atol=1e-6)


def test_out_of_fold_covers_every_row(spark):
    fx = Fixtures(spark, SF)
    oof = co.gene_baseline(fx.typed, fx.folds(3), fx.classes, iterations=5)
    assert oof.count() <= fx.samples.count()
    assert oof.select("sid").distinct().count() == oof.count()
    sums = oof.select(pr.total(F.col("p")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-6 for r in sums)


def test_bundle_applies_to_unseen_rows(spark, tmp_path):
    fx = Fixtures(spark, SF)
    folds = fx.folds()
    co.fit_bundle(fx.typed, folds.filter("fold <> 0").select("sid", "label"), fx.classes, str(tmp_path))
    rows = folds.filter("fold = 0").select("sid")
    z = co.apply_bundle(fx.typed, rows, fx.classes, str(tmp_path))
    assert z.count() == rows.count() * len(fx.classes) and z.filter("z is null or isnan(z)").count() == 0
    few = rows.limit(3)
    assert co.apply_bundle(fx.typed, few, fx.classes, str(tmp_path)).select("sid", "cls", F.round("z", 9)).exceptAll(
        z.select("sid", "cls", F.round("z", 9))).count() == 0


def test_ranker_rows_do_not_see_labels_of_the_held_fold(spark):
    """Turning the labels of the held fold changes nothing that the ranker is fitted on or applied to."""
    from pyspark.sql import functions as F

    fx = Fixtures(spark, SF)
    folds, classes = fx.folds(), fx.classes
    turned = folds.withColumn("label", F.when(F.col("fold") == 0, F.lit(classes[0])).otherwise(F.col("label")))
    tables = [co.ranker_rows(fx.tokens("gene_type"), x, fx.prob(["a"], 400), classes, 0).drop("label").select("sid", "inner_fold", "cls", *[F.round(c, 9).alias(c) for c in co.RANKER_COLUMNS])
              for x in (folds, turned)]
    assert tables[0].exceptAll(tables[1]).count() == 0 and tables[0].count() == 150 * len(classes)


def test_rows_without_a_label_count_nowhere(spark):
    from glyphmill.operators import weights as we

    samples = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "sid long, label string")
    tokens = spark.createDataFrame([(1, "t"), (2, "t"), (3, "t")], "sid long, token string")
    row = we.token_counts(tokens, samples, ["a", "b"]).first()
    assert (row["support"], row["n"], row["pos"]) == (2, 2, [1, 1])


def test_vote_and_bag_score_every_fold(spark, monkeypatch):
    """With models that only give back which rows were held, every sample has probabilities once."""
    import __spark_entry__ as entry

    fx = Fixtures(spark, SF)
    seen = []

    def held(typed, split, classes, *rest):
        counts = dict(split.groupBy("fold").agg(F.max("fit").alias("fit")).collect())
        seen.append(sorted(fold for fold, fit in counts.items() if not fit))
        part = split.filter("not fit").select("sid", F.array(*[F.lit(1.0 / len(classes)) for _ in classes]).alias("p"))
        return [part, part] if rest else part

    monkeypatch.setattr(co, "three_way_vote", held)
    monkeypatch.setattr(co, "selective_evidence", held)
    for name in ("c4_three_way_vote", "c5_selective_evidence_bag"):
        seen.clear()
        got = entry.queries()[name](spark, SF)
        assert seen == [[0], [1], [2], [3], [4]]
        assert got.count() == fx.folds().count() * len(fx.classes) == got.select("sid", "cls").distinct().count()


def test_fits_run_to_the_default_tolerance(spark):
    from pyspark.ml.classification import LogisticRegression

    assert ft.TOLERANCE <= LogisticRegression().getTol()


def test_template_keeps_its_order_and_faults_raise(spark, tmp_path):
    names = [f"s{(i * 37) % 101:03d}" for i in range(101)]
    for part, chunk in enumerate((names[:40], names[40:41], names[41:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"part-{part}.csv").write_text("sid\n" + "".join(f"{x}\n" for x in chunk))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")  # many blocks a file
    try:
        template = tables.read_placed(spark, str(tmp_path / "in"))
        assert [r.sid for r in template.orderBy("place").collect()] == names
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    template = spark.createDataFrame(list(enumerate(names)), "place long, sid string")
    pred = spark.createDataFrame([(x, "A" if i % 2 else "B") for i, x in enumerate(sorted(names))], "sid string, label string")
    back = tables.write_template(tables.checked_template(template, pred, "sid"), str(tmp_path / "out"), "sid")
    assert [r.sid for r in back.orderBy("place").collect()] == names
    back.select("place", "sid").write.parquet(str(tmp_path / "columnar"))
    again = tables.read_placed(spark, str(tmp_path / "columnar"), "parquet")
    assert sorted(r.place for r in again.select("place").collect()) == list(range(101))
    first = pred.filter("sid = 's000'")
    for rows, guess in ((template, pred.filter("sid <> 's000'")), (template, pred.unionByName(first)), (template.filter("sid <> 's000'"), pred),
                        (template.unionByName(template.filter("sid = 's000'")), pred), (template, pred.withColumn("label", F.expr("nullif(label, 'A')")))):
        with pytest.raises(ValueError):
            tables.checked_template(rows, guess, "sid")


def test_saved_model_gives_its_own_probabilities_in_another_session(spark, tmp_path):
    fx, folder = Fixtures(spark, SF), str(tmp_path / "model")
    typed = fx.typed
    split = fx.folds()
    fit, held = split.filter("fold <> 0").select("sid", "label"), split.filter("fold = 0").select("sid")
    co.fit_saved_model(typed, fit, fx.classes, folder, iterations=20)
    a = {(r.sid, r.cls): r.p for r in co.apply_saved_model(typed, held, folder).collect()}
    other = Fixtures(spark.newSession(), SF)
    rows = other.folds().filter("fold = 0").select("sid")
    unseen = other.typed.unionByName(other.typed.limit(1).withColumn("event", F.lit("NEVER1SEEN")))
    b = {(r.sid, r.cls): r.p for r in co.apply_saved_model(unseen, rows, folder).collect()}
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-12  # sums differ in their last digit by the order of rows
    assert len(a) == held.count() * len(fx.classes)
    assert abs(sum(a.values()) - held.count()) < 1e-6
    spark.createDataFrame([(99, fx.classes, {})], "version int, classes array<string>, schemas map<string, string>").write.mode("overwrite").json(f"{folder}/state")
    with pytest.raises(ValueError):
        co.apply_saved_model(typed, held, folder)
