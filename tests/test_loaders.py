from pyspark.sql import functions as F

from structweave.plans.loaders import candidate_losses, sequence_losses
from structweave.plans.schedules import L2Penalty
from structweave.plans.solvers import Run
from structweave.plans.train import fit

TRAIN = "-DOCSTART- -X- O O\n\nthe DT B O\ncat NN I A\n\nthe DT B O\ndog NN I A\nruns VB B O\n\n" * 3
DEV = "-DOCSTART- -X- O O\n\nthe DT B O\nbird NN I A\n"


def test_corpora_become_losses_that_train(spark, tmp_path):
    for name, text in (("train", TRAIN), ("dev", DEV)):
        (tmp_path / name).write_text(text)
    losses, vocab, tags = sequence_losses(spark, {n: str(tmp_path / n) for n in ("train", "dev")}, dim=97, threshold=2)
    assert {r.word: r.id for r in vocab.collect()} == {"the": 1, "cat": 2, "dog": 3, "runs": 4}
    assert losses["train"].table.n_tags == 2 and losses["train"].table.df.count() == 6
    assert [r.words[r.left : r.left + r.n] for r in losses["dev"].table.df.collect()] == [[1, 0]]
    run = Run("svrg", [L2Penalty(0.01)], {"learning_rate": 0.1, "smoothing_coefficient": 1.0})
    found = fit(losses["train"], run, num_passes=2, partitions=1, dev=losses["dev"])
    train = [row[4] for row in found.log if row[2] == "train"]
    assert train[-1] < train[0] and {row[3] for row in found.log if row[2] == "dev"} == {"objective", "weighted_f1"}


def test_labels_and_features_become_losses(spark):
    rows = [(g, c, (g * 7 + c * 3) % 10 / 10, [float(g % 3), float(c)]) for g in range(40) for c in range(1 + g % 4)]
    df = spark.createDataFrame([*rows, (None, 0, 0.5, [1.0, 1.0])], "group_id long, cand int, iou double, feats array<double>")
    losses = candidate_losses(df.drop("feats"), df.drop("iou"), 2)
    sizes = {n: loss.source.count() for n, loss in losses.items()}
    assert sizes == {"train": 30, "val": 11}
    packed = losses["train"].source.unionByName(losses["val"].source)
    assert packed.agg(F.sum(F.size("ious"))).first()[0] == len(rows) + 1
    assert losses["train"].value_means([[0.0, 0.0]])[0] >= 0


def test_models_do_not_depend_on_partitions_or_batches(spark):
    from structweave.plans.losses import LogisticLoss

    rows = [(i if i % 10 else None, [float(i % 7), 1.0, float(i % 3)], float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, feats array<double>, y double").where("id is not null")
    run = Run("svrg", [L2Penalty(0.1)], {"learning_rate": 0.1})
    found = []
    for n, batch in ((1, 10_000), (5, 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        loss = LogisticLoss(df.repartition(n), 3)
        found.append(fit(loss, run, num_passes=2, partitions=2, logging=False).w)
        loss.release()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert abs(found[0] - found[1]).max() < 1e-9
