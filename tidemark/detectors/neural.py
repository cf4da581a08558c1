"""Reconstruction detectors trained data-parallel by parameter averaging.

Each round is one job: every task starts from the broadcast weights, runs one
pass of mini-batch Adam over its own rows, and returns its weights.  Tasks are
averaged on the cluster in groups before the driver averages the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.detectors.base import Detector
from tidemark.detectors.nets import Adam, AttentionNet, DenseNet, LstmNet, errors, flatten, unflatten
from tidemark.detectors.statistical import matrix_of, unit_scaled
from tidemark.frame import Frame
from tidemark.operators.sequences import pad_scores, window_blocks, windows_of
from tidemark.session import materialise, parallelism, small_batches

_PART = "worker bigint, rows bigint, loss double, val_rows bigint, val_loss double, weights array<double>"

_SMALL_BLOCK, _LARGE_BLOCK, _BLOCKS_PER_WORKER = 256, 8192, 32


def block_size(n: int, workers: int) -> int:
    """Rows of a block: many blocks a worker, dealt out in turn, as a round lasts as long as the worker that learns most."""
    return max(_SMALL_BLOCK, min(_LARGE_BLOCK, n // (_BLOCKS_PER_WORKER * workers)))


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf["rows"].to_numpy()
    weights = np.stack(pdf["weights"].to_numpy())
    share = rows if rows.sum() else np.ones(len(rows))
    return pd.DataFrame(
        {
            "worker": [0],
            "rows": [int(rows.sum())],
            "loss": [float((pdf["loss"] * rows).sum() / max(rows.sum(), 1))],
            "val_rows": [int(pdf["val_rows"].sum())],
            "val_loss": [float((pdf["val_loss"] * pdf["val_rows"]).sum() / max(pdf["val_rows"].sum(), 1))],
            "weights": [np.average(weights, axis=0, weights=share)],
        }
    )


def train(data: DataFrame, samples, net, first_val: int, options: dict) -> list[np.ndarray]:
    """Fit ``net``; ``samples(batch)`` yields (positions, inputs) from a pandas batch.

    Rows at or after ``first_val`` are held out; training stops after
    ``patience`` rounds without a better held-out loss, keeping the best weights.
    """
    seed, batch_size, rate = options["random_state"], options["batch_size"], options["learning_rate"]
    shapes = [p.astype(np.float32) for p in net.init(np.random.default_rng(seed))]
    params, best, best_loss, waited = shapes, shapes, math.inf, 0
    workers = parallelism(data.sparkSession)
    data = data.coalesce(workers)
    context = data.sparkSession.sparkContext
    # one extra round only measures the last weights
    for epoch in range(options["epochs"] + 1):
        shared = context.broadcast(flatten(params))
        learning = epoch < options["epochs"]

        def run(batches, shared=shared, epoch=epoch, learning=learning):
            worker = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, epoch, worker])
            start = unflatten(shared.value, shapes)
            local = [p.copy() for p in start]
            adam = Adam(local, rate)
            rows, loss, val_rows, val_loss = 0, 0.0, 0, 0.0
            for batch in batches:
                for at, x in samples(batch):
                    held = at >= first_val
                    if held.any():
                        val_rows += int(held.sum())
                        val_loss += float(errors(net, start, x[held]).sum())
                    x = x[~held].astype(np.float32)
                    if learning:
                        mixed = x[rng.permutation(len(x))]
                        for i in range(0, len(x), batch_size):
                            part = mixed[i : i + batch_size]
                            loss += adam.step(net, local, part, rng) * len(part)
                    rows += len(x)
            if rows + val_rows:
                yield pd.DataFrame(
                    {
                        "worker": [worker], "rows": [rows], "loss": [loss / max(rows, 1)],
                        "val_rows": [val_rows], "val_loss": [val_loss / max(val_rows, 1)],
                        "weights": [flatten(local)],
                    }
                )

        groups = max(1, math.isqrt(workers))
        merged = (
            data.mapInPandas(run, _PART)
            .groupBy(F.pmod("worker", F.lit(groups)).alias("g"))
            .applyInPandas(_merge, _PART)
            .toPandas()
        )
        if merged.empty:
            return params
        total = _merge(merged).iloc[0]
        if total["val_rows"]:
            if total["val_loss"] < best_loss:
                best, best_loss, waited = params, total["val_loss"], 0
            else:
                waited += 1
                if waited >= options["patience"]:
                    break
        if learning:
            params = unflatten(np.asarray(total["weights"], dtype=np.float32), shapes)
        shared.unpersist()
    return best if best_loss < math.inf else params


_COMMON = {
    "epochs": 50, "batch_size": 32, "validation_split": 0.2, "patience": 10,
    "learning_rate": 0.001, "random_state": 42, "contamination": 0.1,
}


def row_blocks(df: DataFrame, vector, size: int) -> DataFrame:
    """Rows as bytes of whole blocks: their row_ids, and their vectors in the single precision of the networks."""

    def block(ids, x):
        parts = [slice(at, at + size) for at in range(0, len(ids), size)]
        return pa.RecordBatch.from_pydict({
            "ids": pa.array([ids[p].tobytes() for p in parts], type=pa.binary()),
            "cells": pa.array([x[p].tobytes() for p in parts], type=pa.binary()),
        })

    def pack(batches):
        ids, x = None, None
        for batch in batches:
            if batch.num_rows:
                more = batch.column(0).to_numpy(), matrix_of(batch.column(1)).astype(np.float32)
                ids, x = more if ids is None else (np.concatenate([ids, more[0]]), np.concatenate([x, more[1]]))
                full = len(ids) // size * size
                yield block(ids[:full], x[:full])
                ids, x = ids[full:], x[full:]
        if ids is not None:
            yield block(ids, x)

    return df.select("row_id", vector.alias("v")).mapInArrow(pack, "ids binary, cells binary")


def rows_of(batch: pd.DataFrame, d: int, size: int):
    """The rows of as many blocks as make a large one: row_ids, and the vectors (count, d)."""
    step = max(1, _LARGE_BLOCK // size)
    for at in range(0, len(batch), step):
        part = batch.iloc[at : at + step]
        yield np.frombuffer(b"".join(part["ids"]), np.int64), np.frombuffer(b"".join(part["cells"]), np.float32).reshape(-1, d)


class Autoencoder(Detector):
    name = "autoencoder"
    defaults = {"encoding_dim": (64, 32, 16), "dropout": 0.2, **_COMMON}
    normaliser = (0.05, 0.95)

    def raw_scores(self, frame: Frame) -> DataFrame:
        scaled, d = unit_scaled(frame), len(frame.features)
        spark = frame.df.sparkSession
        workers = parallelism(spark)
        size = block_size(frame.n, workers)
        # the held-out rows lie last: dealt out in turn, they leave every worker as much to learn
        blocks = materialise(row_blocks(scaled.df, scaled.vector(), size).repartition(workers), "dense")
        net = DenseNet(d, list(self.options["encoding_dim"]), self.options["dropout"])
        first_val = int(frame.n * (1 - self.options["validation_split"]))

        def score(batches):
            for batch in batches:
                for at, x in rows_of(batch, d, size):
                    yield pd.DataFrame({"row_id": at, "raw": errors(net, params, x)})

        with small_batches(spark, max(1, 4 * _LARGE_BLOCK // size)):
            params = train(blocks, lambda batch: rows_of(batch, d, size), net, first_val, self.options)
            return materialise(blocks.mapInPandas(score, "row_id bigint, raw double"), "row-errors")


class _SequenceDetector(Detector):
    normaliser = (0.05, 0.95)

    def network(self, d: int):
        raise NotImplementedError

    def raw_scores(self, frame: Frame) -> DataFrame:
        length = self.options["sequence_length"]
        if frame.n < length:
            return frame.df.select("row_id", F.lit(0.0).alias("raw"))
        scaled = unit_scaled(frame)
        workers = parallelism(frame.df.sparkSession)
        blocks, size = window_blocks(scaled.df, frame.n, length, scaled.vector(), block_size(frame.n, workers))
        blocks = materialise(blocks.repartition(workers), "windows")
        net = self.network(len(frame.features))
        # windows are held out by their last row: the last fifth of n - length + 1 windows
        first_val = length - 1 + int((frame.n - length + 1) * (1 - self.options["validation_split"]))
        params = train(blocks, lambda batch: windows_of(batch, length, size), net, first_val, self.options)

        def score(batches):
            for batch in batches:
                for at, x in windows_of(batch, length, size):
                    yield pd.DataFrame({"row_id": at, "raw": errors(net, params, x)})

        scored = materialise(blocks.mapInPandas(score, "row_id bigint, raw double"), "window-errors")
        return pad_scores(frame.df, frame.n, scored, length)


class LstmAutoencoder(_SequenceDetector):
    name = "lstm_autoencoder"
    defaults = {"sequence_length": 10, "encoding_dim": 32, **_COMMON}

    def network(self, d: int):
        return LstmNet(d, self.options["sequence_length"], self.options["encoding_dim"])


class Transformer(_SequenceDetector):
    name = "transformer"
    defaults = {"sequence_length": 10, "d_model": 64, "nhead": 8, **_COMMON}

    def network(self, d: int):
        return AttentionNet(d, self.options["sequence_length"], self.options["d_model"], self.options["nhead"])
