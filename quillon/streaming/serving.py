"""A stream of commands, judged: graphs and predictions as commands come, with what each source has shown before as state.

Commands are parsed where they are, without state. They are then dealt by source
and by a hash of their tree, in ``lanes`` per source, so that a source with a
third of all commands is not one task's. A lane keeps the trees that it has
judged, with their predictions and the time they came last, and how many commands
it judged and skipped. Only trees that it does not keep are put through the
model. A timer in event time drops trees that have not come for ``forget``;
trees that come again later are judged again, with the same result.

Each judged command is a row; a batch's commands without a tree are one row per
lane, with their number. State and output go by Spark's checkpoint: a batch that
is run again gives the same rows and the same counts. The session's state store
must be RocksDB (state_store sets it).
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.shipping import ship
from ..operators import clean, embed, gnn, graph, serving, tree_graphs
from .commands import parsed_stream

OUT = "kind string, source string, command_line string, ts timestamp, tree_id string, first boolean, pred int, logit_0 double, logit_1 double, commands long, skipped_so_far long"
LANES = 16
BATCH = 64
STORE = "spark.sql.streaming.stateStore.providerClass"


def state_store(spark: SparkSession) -> None:
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Judge(StatefulProcessor):
    def __init__(self, model: bytes, config: str, ablation: str, forget_ms: int):
        self.model, self.config, self.ablation, self.forget_ms = model, config, ablation, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "tree_id string", "pred int, logit_0 double, logit_1 double, last long")
        self.totals = handle.getValueState("totals", "judged long, skipped long, wakes long")
        self.known = pickle.loads(self.model)
        self.embedder = embed.hashing_embedder()

    def _judged(self, trees: list[str]) -> np.ndarray:
        """Logits of trees (JSON)."""
        out = []
        for lo in range(0, len(trees), BATCH):
            rows = [(None, None, None, clean.arena(clean._tuples(json.loads(t)))) for t in trees[lo : lo + BATCH]]
            batch = tree_graphs.batch_of(clean.as_arrow(rows).field("nodes"), serving.parts_of(self.config), self.ablation, self.embedder)
            out.append(self.known.run(batch)[0].value)
        return np.concatenate(out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        judged, skipped, wakes = self.totals.get() if self.totals.exists() else (0, 0, 0)
        missed, latest = 0, None
        limit = timerValues.getCurrentWatermarkInMs() - self.forget_ms
        for frame in rows:
            latest = frame["ts"].max() if latest is None else max(latest, frame["ts"].max())
            usable = frame[frame["tree"].notna()].sort_values(["ts", "command_line"], kind="stable")
            missed += len(frame) - len(usable)
            if not len(usable):
                continue
            trees = usable.groupby("tree_id", sort=True).agg(tree=("tree", "first"), rule=("rule_label", "first"), last=("ts", "max"))
            kept = {t: self.seen.getValue((t,)) for t in trees.index if self.seen.containsKey((t,))}
            kept = {t: v for t, v in kept.items() if v[3] > limit}  # timers run behind a batch's rows
            new = trees[~trees.index.isin(kept)]
            if len(new):
                logits = self._judged(new["tree"].tolist())
                pred = np.where(new["rule"] != -1, new["rule"], logits.argmax(1))
                kept |= {t: (int(p), float(z[0]), float(z[1]), 0) for t, p, z in zip(new.index, pred, logits)}
            for t, last in trees["last"].items():
                p, a, b, before = kept[t]
                self.seen.updateValue((t,), (p, a, b, max(before, _ms(last))))
            judged += len(usable)
            found = usable["tree_id"].map(kept)
            first = ~usable["tree_id"].duplicated() & usable["tree_id"].isin(new.index)
            yield _frame("judged", key[0], usable["command_line"], usable["ts"], usable["tree_id"], first, *(found.map(lambda x, i=i: x[i]) for i in range(3)), 1, skipped + missed)
        if missed:
            one = pd.Series([None], dtype=object)
            yield _frame("skipped", key[0], one, pd.Series([latest]), one, one, one, one, one, missed, skipped + missed)
        if not wakes and latest is not None and not pd.isna(latest):
            wakes = _ms(latest) + self.forget_ms
            self.handle.registerTimer(wakes)
        self.totals.update((judged, skipped + missed, wakes))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Trees that have not come since go; the lane wakes again when the next one may."""
        limit = timerValues.getCurrentWatermarkInMs() - self.forget_ms
        last = {t[0]: v[3] for t, v in self.seen.iterator()}
        for t, when in last.items():
            if when <= limit:
                self.seen.removeKey((t,))
        stay = [when for when in last.values() if when > limit]
        judged, skipped, _ = self.totals.get()
        wakes = min(stay) + self.forget_ms if stay else 0
        if wakes:
            self.handle.registerTimer(wakes)
        self.totals.update((judged, skipped, wakes))
        yield from ()


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


def _frame(kind: str, source, command, ts, tree_id, first, pred, a, b, commands: int, so_far: int) -> pd.DataFrame:
    out = pd.DataFrame({"kind": kind, "source": source, "command_line": command, "ts": ts, "tree_id": tree_id, "first": first, "pred": pred, "logit_0": a, "logit_1": b})
    out["commands"], out["skipped_so_far"] = commands, so_far
    return out.astype({"pred": "Int32", "logit_0": "float64", "logit_1": "float64", "first": "boolean"}).reset_index(drop=True)


def judged_stream(stream: DataFrame, model: gnn.Model, config: str, ablation: str = "all", late: str = "10 minutes", forget_ms: int = 3_600_000, lanes: int = LANES) -> DataFrame:
    """OUT for a stream of (source, ts, command_line): a row per judged command, and one per lane and batch for those skipped. Rows later than late are not taken. A null source is ''; a row without time counts, but keeps no tree from being forgotten."""
    spark = stream.sparkSession
    ship(spark)
    rows = parsed_stream(stream.withWatermark("ts", late))
    tree_id = tree_graphs.tree_id(F.col("tree"))
    rows = rows.select(
        F.coalesce("source", F.lit("")).alias("source"), F.pmod(F.xxhash64(F.coalesce(tree_id, F.col("command_line"))), F.lit(lanes)).alias("lane"), "ts", "command_line",
        "tree", tree_id.alias("tree_id"), graph.rule_label(F.col("tokens")).alias("rule_label"),
    )
    return rows.groupBy("source", "lane").transformWithStateInPandas(Judge(pickle.dumps(model), config, ablation, forget_ms), outputStructType=OUT, outputMode="append", timeMode="eventtime")
