"""Evaluation and history operators on small fixtures (incl. the published history table)."""

import pytest
from pyspark.sql import functions as F

from glossa.operators import evaluate as ev
from glossa.operators import history as hist

# Published training history of the reference's recurrent model (epoch, train_loss, val_loss, val_accuracy).
PUBLISHED_HISTORY = [
    (1, 0.5179451200264421, 0.3795497636795044, 0.8328),
    (2, 0.39596844413741067, 0.33956191329956054, 0.854),
    (3, 0.3529320731335743, 0.31532519025802613, 0.8632),
    (4, 0.32644100923260505, 0.2863735168457031, 0.8792),
    (5, 0.30572030147198925, 0.29599363918304444, 0.8744),
    (6, 0.2917161541567607, 0.27456500368118286, 0.8868),
    (7, 0.27937949444590643, 0.26961291999816894, 0.8884),
    (8, 0.26724618224596436, 0.2649617311477661, 0.8868),
    (9, 0.2570505255452273, 0.279564861869812, 0.8828),
    (10, 0.2406131402504715, 0.2606232961654663, 0.9048),
    (11, 0.22912557852793147, 0.25277399129867556, 0.8956),
    (12, 0.22038420996713368, 0.24532795639038085, 0.9032),
    (13, 0.21308865201320837, 0.25951842374801637, 0.9004),
    (14, 0.20046275467823513, 0.2666181276321411, 0.8932),
    (15, 0.1903089934282682, 0.2743835039138794, 0.898),
]


@pytest.fixture(scope="module")
def history(spark):
    return spark.createDataFrame(PUBLISHED_HISTORY, "epoch int, train_loss double, val_loss double, val_accuracy double")


def test_best_epoch_on_published_history(history):
    b = hist.best_epoch(history).first()
    assert b["best_epoch"] == 12 and abs(b["best_val_loss"] - 0.24532795639038085) < 1e-15
    assert b["best_accuracy_epoch"] == 10 and b["best_val_accuracy"] == 0.9048


def test_improved_epochs(history):
    got = [r["epoch"] for r in hist.improved_epochs(history).filter("improved").orderBy("epoch").collect()]
    assert got == [1, 2, 3, 4, 6, 7, 8, 10, 11, 12]


def test_history_long_and_checks(spark, history):
    assert hist.history_long(history).count() == 45
    with pytest.raises(ValueError, match="History lacks: val_accuracy"):
        hist.check_history(history.drop("val_accuracy"))
    with pytest.raises(ValueError, match="no epochs"):
        hist.check_history(history.filter("epoch < 0"))


def test_batch_mean_differs_from_row_mean(spark):
    # 3 rows in epoch 1 with batch size 2: batches {a,b} and {c}
    log = spark.createDataFrame([(1, 0, 0.0, 1), (1, 1, 0.0, 1), (1, 2, 4.0, 0)], "epoch int, row_id long, logit double, label int")
    import math
    l0 = math.log(2.0)
    l2 = 4.0 + math.log1p(math.exp(-4.0))
    b = hist.batch_mean_loss(log, batch_size=2).first()
    assert abs(b["train_loss"] - ((l0 + l0) / 2 + l2) / 2) < 1e-12 and b["batches"] == 2
    w = hist.weighted_loss(log).first()
    assert abs(w["val_loss"] - (2 * l0 + l2) / 3) < 1e-12
    assert abs(w["val_accuracy"] - 2 / 3) < 1e-12  # logit 0 is positive (>= 0.5)


def _preds(spark):
    rows = [("A", 1, "one two", 1, 1), ("A", 2, " ".join(["w"] * 150), 0, 1), ("A", 3, None, 1, 1),
            ("B", 1, "one two", 1, 0), ("B", 2, " ".join(["w"] * 150), 0, 0), ("B", 4, "x", 2, 1)]
    return spark.createDataFrame(rows, "model string, doc_id long, text string, label int, prediction int")


def test_accuracy_confusion_buckets(spark):
    p = _preds(spark)
    acc = {r["model"]: (r["samples"], r["accuracy"]) for r in ev.accuracy(p).collect()}
    assert acc == {"A": (3, 2 / 3), "B": (3, 1 / 3)}
    conf = {(r["model"], r["label"], r["prediction"]): r["n"] for r in ev.confusion(p).collect()}
    assert len(conf) == 8 and conf[("A", 0, 1)] == 1 and conf[("B", 1, 0)] == 1 and conf[("A", 0, 0)] == 0
    assert sum(v for (m, _, _), v in conf.items() if m == "B") == 2  # label 2 ignored in the grid
    summ = ev.accuracy_by_length(p).collect()
    assert len(summ) == 10
    first = [r for r in summ if r["model"] == "A" and r["bucket_id"] == 0][0]
    assert first["samples"] == 2 and first["accuracy"] == 1.0  # null text counts 0 words
    empty = [r for r in summ if r["bucket_id"] == 4]
    assert all(r["samples"] == 0 and r["accuracy"] is None for r in empty)
    assert [r["bucket_id"] for r in summ] == sorted(r["bucket_id"] for r in summ)
    pv = ev.accuracy_pivot(ev.accuracy_by_length(p), ["A", "B"]).orderBy("bucket_id").collect()
    assert len(pv) == 5 and pv[1]["A"] == 0.0


def test_same_examples_and_alignment(spark):
    p = _preds(spark)
    s = ev.same_examples(p, ["A", "B"]).first()
    assert (s["missing_left"], s["missing_right"], s["label_mismatch"], s["same_examples"]) == (1, 1, 0, False)
    a = ev.align_check(p.filter("model = 'A'"), p.filter("model = 'A'")).first()
    assert a["aligned"]
    mc = {r["model"]: r for r in ev.model_comparison(p).collect()}
    assert mc["A"]["accuracy_label"] == "66.67%" and mc["A"]["fp"] == 1
