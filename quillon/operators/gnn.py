"""Graph models over token trees: GCN, GraphSAGE, GIN, GAT and RGCN, with training by averaged partitions.

A graph is one row: x (features, row by row), width, src, dst, type, label. All
its message passing happens in that row, so a forward pass is one mapInPandas
without a shuffle. In training every partition runs an epoch of mini-batches
from the same weights, a block of its rows at a time; weights and the optimiser's
moments are averaged by numbers of graphs, in two steps, so that the driver gets
about the square root of the number of cores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .autodiff import Var, join, sum_rows

KINDS = ("gcn", "sage", "gin", "gat", "rgcn")


@dataclass
class Batch:
    x: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    type: np.ndarray
    graph: np.ndarray
    n_graphs: int

    @staticmethod
    def of(rows: pd.DataFrame) -> "Batch":
        xs = [np.asarray(x, float).reshape(-1, w) for x, w in zip(rows["x"], rows["width"])]
        sizes = [len(x) for x in xs]
        start = np.concatenate([[0], np.cumsum(sizes)])
        flat = lambda c: [np.asarray(v, np.int64) for v in rows[c]]
        moved = lambda c: np.concatenate([v + s for v, s in zip(flat(c), start)]) if len(rows) else np.zeros(0, np.int64)
        return Batch(np.concatenate(xs), moved("src"), moved("dst"), np.concatenate(flat("type")), np.repeat(np.arange(len(xs)), sizes), len(xs))


@dataclass
class Model:
    kind: str
    width: int
    hidden: int = 128
    layers: int = 3
    classes: int = 2
    relations: int = 5
    heads: int = 4
    dropout: float = 0.5
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    running: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 0) -> "Model":
        """Glorot weights, and batch norms that change nothing."""
        rng = np.random.default_rng(seed)

        def glorot(name: str, *shape: int) -> None:
            self.weights[name] = rng.uniform(-1, 1, shape) * np.sqrt(6 / (shape[-2] + shape[-1]))

        def zero(name: str, n: int) -> None:
            self.weights[name] = np.zeros(n)

        def norm(name: str) -> None:
            self.weights[name + ".gain"] = np.ones(self.hidden)
            zero(name + ".shift", self.hidden)
            self.running[name] = np.stack([np.zeros(self.hidden), np.ones(self.hidden)])

        for k in range(self.layers):
            w = self.width if k == 0 else self.hidden
            if self.kind == "gin":
                glorot(f"{k}.a", w, self.hidden)
                zero(f"{k}.a0", self.hidden)
                norm(f"{k}.inner")
                glorot(f"{k}.b", self.hidden, self.hidden)
            else:
                glorot(f"{k}.a", w, self.hidden)
            zero(f"{k}.0", self.hidden)
            if self.kind == "sage":
                glorot(f"{k}.self", w, self.hidden)
            if self.kind == "gat":
                h = self._heads(k)
                for side in ("from", "to"):
                    glorot(f"{k}.{side}", h, self.hidden // h)
            if self.kind == "rgcn":
                for t in range(self.relations):
                    glorot(f"{k}.r{t}", w, self.hidden)
            norm(f"{k}.norm")
        pooled = self.hidden * (self.layers if self.kind == "gin" else 2)
        glorot("head.a", pooled, self.hidden)
        zero("head.a0", self.hidden)
        glorot("head.b", self.hidden, self.classes)
        zero("head.b0", self.classes)
        return self

    def _heads(self, layer: int) -> int:
        return self.heads if layer < self.layers - 1 else 1

    def count(self) -> int:
        return sum(w.size for w in self.weights.values())

    def forward(self, b: Batch, train: bool = False, rng: np.random.Generator | None = None) -> tuple[Var, dict[str, Var]]:
        """Logits per graph, and the weights as variables."""
        w = {k: Var(v) for k, v in self.weights.items()}
        x, pools = Var(b.x), []
        for k in range(self.layers):
            x = self._norm(f"{k}.norm", self._layer(k, x, b, w), w, train)
            x = x.elu() if self.kind == "gat" else x.relu()
            if train and self.dropout and k < self.layers - 1:
                x = x * ((rng.random(x.value.shape) >= self.dropout) / (1 - self.dropout))
            pools.append(x.scatter(b.graph, b.n_graphs))
        if self.kind == "gin":
            z = join(pools)
        else:
            size = np.maximum(np.bincount(b.graph, minlength=b.n_graphs), 1)[:, None]
            z = join([pools[-1] * (1 / size), x.largest(b.graph, b.n_graphs)])
        z = (z @ w["head.a"] + w["head.a0"]).relu()
        if train and self.dropout:
            z = z * ((rng.random(z.value.shape) >= self.dropout) / (1 - self.dropout))
        return z @ w["head.b"] + w["head.b0"], w

    def _norm(self, name: str, x: Var, w: dict[str, Var], train: bool) -> Var:
        if train and len(x.value) > 1:
            n = len(x.value)
            mean = x.total(0) * (1 / n)
            centred = x + mean * -1.0
            var = (centred * centred).total(0) * (1 / n)
            old = self.running[name]
            self.running[name] = 0.9 * old + 0.1 * np.stack([mean.value, var.value * n / (n - 1)])
            root = np.sqrt(var.value + 1e-5)
            x = centred * var.through(1 / root, -0.5 / root**3)
        else:
            mean, var = self.running[name]
            x = (x + -mean) * (1 / np.sqrt(var + 1e-5))
        return x * w[name + ".gain"] + w[name + ".shift"]

    def _layer(self, k: int, x: Var, b: Batch, w: dict[str, Var]) -> Var:
        n = len(x.value)
        bias = w[f"{k}.0"]
        if self.kind == "gcn":
            has_loop = np.zeros(n, bool)
            has_loop[b.dst[b.src == b.dst]] = True
            rest = np.flatnonzero(~has_loop)
            src, dst = np.concatenate([b.src, rest]), np.concatenate([b.dst, rest])
            degree = np.bincount(dst, minlength=n).astype(float)
            root = np.where(degree > 0, degree, 1) ** -0.5
            return ((x @ w[f"{k}.a"]).take(src) * (root[src] * root[dst])[:, None]).scatter(dst, n) + bias
        if self.kind == "sage":
            size = np.maximum(np.bincount(b.dst, minlength=n), 1)[:, None]
            return (x.take(b.src).scatter(b.dst, n) * (1 / size)) @ w[f"{k}.a"] + bias + x @ w[f"{k}.self"]
        if self.kind == "gin":
            h = (x + x.take(b.src).scatter(b.dst, n)) @ w[f"{k}.a"] + w[f"{k}.a0"]
            return self._norm(f"{k}.inner", h, w, False if k < 0 else self._training).relu() @ w[f"{k}.b"] + bias
        if self.kind == "rgcn":
            out = x @ w[f"{k}.a"] + bias
            for t in range(self.relations):
                of = b.type == t
                if of.any():
                    size = np.maximum(np.bincount(b.dst[of], minlength=n), 1)[:, None]
                    out = out + (x.take(b.src[of]).scatter(b.dst[of], n) * (1 / size)) @ w[f"{k}.r{t}"]
            return out
        heads = self._heads(k)
        other = b.src != b.dst
        every = np.arange(n)
        src, dst = np.concatenate([b.src[other], every]), np.concatenate([b.dst[other], every])
        h = (x @ w[f"{k}.a"]).reshape(n, heads, self.hidden // heads)
        score = ((h * w[f"{k}.from"]).total(2).take(src) + (h * w[f"{k}.to"]).total(2).take(dst)).leaky()
        top = np.full((n, heads), -np.inf)
        np.maximum.at(top, dst, score.value)
        e = (score + -top[dst]).exp()
        alpha = e * e.scatter(dst, n).inverse().take(dst)
        return (h.take(src) * alpha.reshape(len(src), heads, 1)).scatter(dst, n).reshape(n, self.hidden) + bias

    _training: bool = False

    def run(self, b: Batch, train: bool = False, rng=None) -> tuple[Var, dict[str, Var]]:
        self._training = train
        return self.forward(b, train, rng)


def loss_of(logits: Var, y: np.ndarray, kind: str = "ce", weights: np.ndarray | None = None, gamma: float = 2.0, alpha: float = 1.0, smoothing: float = 0.1) -> Var:
    """Mean loss: ce, weighted, smoothed (weighted, too) or focal."""
    z = logits.value - logits.value.max(1, keepdims=True)
    lp = z - np.log(np.exp(z).sum(1, keepdims=True))
    p, n = np.exp(lp), len(y)
    w = np.ones(2) if weights is None or kind == "ce" else np.asarray(weights, float)
    onehot = np.eye(lp.shape[1])[y]
    if kind == "focal":
        each = -(onehot * lp * w).sum(1)
        pt = np.exp(-each)
        value = (alpha * (1 - pt) ** gamma * each).mean()
        slope = alpha * ((1 - pt) ** gamma + gamma * (1 - pt) ** (gamma - 1) * pt * each) / n
        g = slope[:, None] * w[y][:, None] * (p - onehot)
    else:
        q = onehot if kind != "smoothed" else (1 - smoothing) * onehot + smoothing / lp.shape[1]
        norm = w[y].sum()
        value = -(q * w * lp).sum() / norm
        qw = q * w
        g = (qw.sum(1, keepdims=True) * p - qw) / norm
    return Var(value, (logits,), lambda up: (up * g,))


class AdamW:
    def __init__(self, rate: float = 1e-3, decay: float = 1e-4):
        self.rate, self.decay, self.t, self.m, self.v = rate, decay, 0, {}, {}

    def step(self, weights: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            weights[k] = weights[k] * (1 - self.rate * self.decay) - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def epoch(model: Model, rows: pd.DataFrame, optimiser: AdamW, loss: str, weights, batch: int, seed: int) -> float:
    """One pass of mini-batches; the mean loss."""
    rng = np.random.default_rng(seed)
    order, total = rng.permutation(len(rows)), 0.0
    for lo in range(0, len(rows), batch):
        part = rows.iloc[order[lo : lo + batch]]
        logits, w = model.run(Batch.of(part), True, rng)
        out = loss_of(logits, part["label"].to_numpy(np.int64), loss, weights)
        out.grad()
        optimiser.step(model.weights, {k: v.gradient for k, v in w.items() if v.gradient is not None})
        total += float(out.value) * len(part)
    return total / max(1, len(rows))


def predict(graphs: DataFrame, model: Model, rule: bool = True, batch: int = 256) -> DataFrame:
    """graph_id, label, pred and logits. With rule, a rule_label other than -1 replaces the prediction."""
    ship(graphs.sparkSession)
    shared = graphs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(shared.value)
        for rows in parts:
            for lo in range(0, len(rows), batch):
                part = rows.iloc[lo : lo + batch]
                z = m.run(Batch.of(part))[0].value
                pred = z.argmax(1)
                if rule:
                    pred = np.where(part["rule_label"] != -1, part["rule_label"], pred)
                yield pd.DataFrame({"graph_id": part["graph_id"], "label": part["label"], "pred": pred.astype(np.int32), "logit_0": z[:, 0], "logit_1": z[:, 1]})

    schema = f"graph_id {graphs.schema['graph_id'].dataType.simpleString()}, label int, pred int, logit_0 double, logit_1 double"
    return graphs.select("graph_id", "label", "rule_label", "x", "width", "src", "dst", "type").mapInPandas(run, schema)


State = dict[str, dict[str, np.ndarray]]


def _state(model: Model, optimiser: AdamW) -> State:
    return {"weights": model.weights, "running": model.running, "m": optimiser.m, "v": optimiser.v, "t": {"t": np.array(float(optimiser.t))}}


def _scaled(state: State, by: float) -> State:
    return {k: {name: x * by for name, x in d.items()} for k, d in state.items()}


def _sum_states(states: Iterable[State]) -> State:
    out: State = {}
    for state in states:
        for k, d in state.items():
            mine = out.setdefault(k, {})
            for name, x in d.items():
                mine[name] = mine[name] + x if name in mine else x
    return out


def _set_state(model: Model, optimiser: AdamW, state: State) -> None:
    model.weights, model.running, optimiser.m, optimiser.v = (state.get(k, {}) for k in ("weights", "running", "m", "v"))
    optimiser.t = round(float(state["t"]["t"]))


def train(graphs: DataFrame, held: DataFrame, model: Model, loss: str = "smoothed", epochs: int = 25, batch: int = 64, rate: float = 1e-3, decay: float = 1e-4, patience: int = 5, plateau: int = 3, seed: int = 0) -> tuple[Model, list[dict]]:
    """The model of the best epoch by F1 of the positive class on held, and the history of epochs.

    The rate halves after plateau epochs without a better macro F1; training ends
    after patience epochs without a better F1.
    """
    from . import metrics

    spark = graphs.sparkSession
    ship(spark)
    counts = {r["label"]: r["count"] for r in graphs.groupBy("label").count().collect()}
    n = sum(counts.values())
    weights = np.array([n / (2 * max(1, counts.get(k, 0))) for k in (0, 1)])
    graphs = graphs.select("graph_id", "label", "x", "width", "src", "dst", "type").persist()
    groups = max(1, int(spark.sparkContext.defaultParallelism**0.5))
    best, best_f1, best_macro, bad, flat, history = pickle.dumps(model), -1.0, -1.0, 0, 0, []
    optimiser = AdamW(rate, decay)
    for k in range(epochs):
        optimiser.rate = rate
        shared = spark.sparkContext.broadcast(pickle.dumps((model, optimiser)))

        def run(parts, shared=shared, k=k):
            m, o = pickle.loads(shared.value)
            seen, total = 0, 0.0
            for rows in parts:
                total += len(rows) * epoch(m, rows, o, loss, weights, batch, seed * 1000 + k)
                seen += len(rows)
            if seen:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId() % groups], "n": [seen], "loss": [total], "state": [pickle.dumps(_scaled(_state(m, o), seen))]})

        def add(parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": parts["part"][:1], "n": [parts["n"].sum()], "loss": [parts["loss"].sum()], "state": [pickle.dumps(_sum_states(map(pickle.loads, parts["state"])))]})

        kind = "part int, n long, loss double, state binary"
        parts = graphs.mapInPandas(run, kind).groupBy("part").applyInPandas(add, kind).collect()
        seen = sum(p.n for p in parts)
        _set_state(model, optimiser, _scaled(_sum_states(pickle.loads(p.state) for p in parts), 1 / seen))
        scores = metrics.metrics(predict(held, model)).first()
        history.append({"epoch": k, "loss": sum(p.loss for p in parts) / seen, "rate": rate, "f1_malware": scores.f1_malware, "f1_macro": scores.f1_macro})
        if scores.f1_macro > best_macro:
            best_macro, flat = scores.f1_macro, 0
        elif (flat := flat + 1) > plateau:
            rate, flat = rate / 2, 0
        if scores.f1_malware > best_f1:
            best, best_f1, bad = pickle.dumps(model), scores.f1_malware, 0
        elif (bad := bad + 1) >= patience:
            break
    graphs.unpersist()
    return pickle.loads(best), history


def _field(name: str):
    return lambda t: t[name]


def graph_rows(nodes: DataFrame, edge_rows: DataFrame, vector: str, labels: DataFrame, width: int) -> DataFrame:
    """One row per graph out of nodes (graph_id, idx and a vector of width numbers), edges, and (graph_id, label, rule_label). Rows of a node table go by idx."""
    x = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("idx", F.col(vector).alias("v")))).alias("rows"))
    x = x.select("graph_id", F.flatten(F.transform("rows", lambda t: t["v"])).alias("x"), F.lit(width).alias("width"))
    e = edge_rows.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "type"))).alias("e"))
    e = e.select("graph_id", *(F.transform("e", _field(c)).alias(c) for c in ("src", "dst", "type")))
    return labels.join(x, "graph_id").join(e, "graph_id")


__all__ = ["KINDS", "AdamW", "Batch", "Model", "epoch", "graph_rows", "loss_of", "predict", "sum_rows", "train"]
