import numpy as np
import pandas as pd
import pytest
from quillon.operators import gnn, runs


def rows(n=12, width=5, seed=0):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = int(r.integers(1, 6))
        parent = [int(r.integers(0, j)) for j in range(1, k)]
        src = parent + list(range(1, k)) + list(range(k))
        dst = list(range(1, k)) + parent + list(range(k))
        x = r.normal(size=(k, width)) + 2 * (i % 2)
        out.append({"graph_id": i, "label": i % 2, "rule_label": -1, "x": x.ravel().tolist(), "width": width, "src": src, "dst": dst, "type": [0] * (k - 1) + [2] * (k - 1) + [4] * k})
    return pd.DataFrame(out)


@pytest.mark.parametrize("kind", gnn.KINDS)
def test_gradients_and_sizes(kind):
    assert gnn.Model(kind, 64).start().count() == runs.parameters(kind, 64)
    m = gnn.Model(kind, 5, hidden=8, dropout=0.0).start(1)
    data = rows()
    b, y = gnn.Batch.of(data), data["label"].to_numpy()
    for loss in ("ce", "smoothed", "focal", "weighted"):
        logits, w = m.run(b, True, np.random.default_rng(0))
        out = gnn.loss_of(logits, y, loss, np.array([0.7, 1.6]))
        out.grad()
        for name in ("0.a", "head.b", f"{m.layers - 1}.norm.gain"):
            at = np.unravel_index(np.abs(w[name].gradient).argmax(), w[name].value.shape)
            old = m.weights[name][at]
            values = []
            for d in (1e-5, -1e-5):
                m.weights[name][at] = old + d
                values.append(float(gnn.loss_of(m.run(b, True, np.random.default_rng(0))[0], y, loss, np.array([0.7, 1.6])).value))
            m.weights[name][at] = old
            assert (values[0] - values[1]) / 2e-5 == pytest.approx(w[name].gradient[at], rel=1e-3, abs=1e-6)


@pytest.mark.parametrize("kind", ("gcn", "rgcn"))
def test_training_on_partitions(spark, kind):
    df = spark.createDataFrame(rows(80)).selectExpr("graph_id", "cast(label as int) label", "cast(rule_label as int) rule_label", "x", "cast(width as int) width", "src", "dst", "type").repartition(2)
    model, history = gnn.train(df, df, gnn.Model(kind, 5, hidden=16, dropout=0.1).start(3), epochs=6, batch=16, rate=0.02)
    assert history[-1]["loss"] < history[0]["loss"]
    assert max(h["f1_malware"] for h in history) > 0.8
    assert gnn.predict(df, model).count() == 80
