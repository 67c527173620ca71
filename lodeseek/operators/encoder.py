"""A bi-encoder and a pair scorer that are trained here: tables of hashed tokens, AdamW, warmup, checkpoints and resume.

They stand where another engine fine-tunes a transformer: the loop, losses, schedule, checkpoints and history are the same,
the model is small enough to train on the driver from a bounded number of pairs. Encoding is distributed (retrieval.encode).
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from lodeseek.functions.encoders import token_slots
from lodeseek.operators.training import collate, limit_pairs


@dataclass
class TrainingConfig:
    """limit_pairs bounds what goes to the driver; the pairs are the first by id."""

    output_dir: str
    batch_size: int = 64
    epochs: int = 3
    learning_rate: float = 0.05
    weight_decay: float = 0.01
    warmup_ratio: float = 0.1
    temperature: float = 0.05
    clip: float = 1.0
    slots: int = 1 << 15
    dimensions: int = 64
    hard: int = 0
    random: int = 0
    limit_pairs: int = 100_000
    log_every: int = 50
    seed: int = 17

    def __post_init__(self) -> None:
        if self.batch_size < 2 or self.epochs < 1 or self.learning_rate <= 0 or self.temperature <= 0 or not 0 <= self.warmup_ratio < 1 or self.limit_pairs < 1:
            raise ValueError("batch_size must be 2 or more, epochs and limit_pairs positive, rates positive and warmup_ratio in [0, 1)")


class AdamW:
    """Adam with decoupled weight decay over one table."""

    def __init__(self, table: np.ndarray, decay: float):
        self.m, self.v, self.t, self.decay = np.zeros_like(table), np.zeros_like(table), 0, decay

    def step(self, table: np.ndarray, grad: np.ndarray, rate: float) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        table -= rate * (self.m / (1 - 0.9**self.t) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8) + self.decay * table)


def rate_at(step: int, total: int, warmup: int) -> float:
    """(step + 1) / warmup, then a line down to 0 at the last step."""
    return (step + 1) / warmup if step < warmup else max(0.0, (total - step) / max(1, total - warmup))


def _bags(texts: list[str], slots: int) -> list[np.ndarray]:
    return [token_slots(t, slots) for t in texts]


def _embed(table: np.ndarray, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.array([table[b].mean(0) if len(b) else np.zeros(table.shape[1]) for b in bags])
    n = np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    return x / n, n


def _spread(grad: np.ndarray, table_grad: np.ndarray, unit: np.ndarray, norm: np.ndarray, bags: list[np.ndarray]) -> None:
    """The gradient of unit vectors back to the rows of the table."""
    g = (grad - unit * (grad * unit).sum(1, keepdims=True)) / norm
    for row, b in zip(g, bags):
        if len(b):
            np.add.at(table_grad, b, row / len(b))


def contrastive_step(table: np.ndarray, queries: list[np.ndarray], positives: list[np.ndarray], negatives: list[np.ndarray], temperature: float) -> tuple[float, float, np.ndarray]:
    """(loss, accuracy, gradient): each query against all positives and all negatives of its batch."""
    q, qn = _embed(table, queries)
    c, cn = _embed(table, positives + negatives)
    logits = q @ c.T / temperature
    top = logits.max(1, keepdims=True)
    p = np.exp(logits - top)
    p /= p.sum(1, keepdims=True)
    own = np.arange(len(q))
    loss = float(-np.log(np.maximum(p[own, own], 1e-300)).mean())
    accuracy = float((logits[own, own] >= top[:, 0]).mean())
    p[own, own] -= 1
    p /= len(q) * temperature
    grad = np.zeros_like(table)
    _spread(p @ c, grad, q, qn, queries)
    _spread(p.T @ q, grad, c, cn, positives + negatives)
    return loss, accuracy, grad


def ranking_step(table: np.ndarray, queries: list[np.ndarray], groups: list[list[np.ndarray]], temperature: float) -> tuple[float, float, np.ndarray]:
    """(loss, accuracy, gradient): each query against its own group, whose first document is the positive."""
    q, qn = _embed(table, queries)
    flat = [d for g in groups for d in g]
    c, cn = _embed(table, flat)
    size = len(groups[0])
    c3 = c.reshape(len(q), size, -1)
    logits = np.einsum("id,ijd->ij", q, c3) / temperature
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss, accuracy = float(-np.log(np.maximum(p[:, 0], 1e-300)).mean()), float((logits[:, 0] >= logits.max(1)).mean())
    p[:, 0] -= 1
    p /= len(q) * temperature
    grad = np.zeros_like(table)
    _spread(np.einsum("ij,ijd->id", p, c3), grad, q, qn, queries)
    _spread((p[:, :, None] * q[:, None, :]).reshape(len(flat), -1), grad, c, cn, flat)
    return loss, accuracy, grad


def train(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, config: TrainingConfig, kind: str = "encoder", resume: bool = False) -> dict:
    """Trains on (question_id, answer_id, negatives) and gives the history, which is written with the table and the state of
    every epoch: output_dir/epoch-N/table.npy, state.npz, history.json. kind: encoder (in-batch) or scorer (own group, which
    needs negatives). With resume it goes on behind the last whole epoch. The last batch of an epoch is left out if it is
    not full; fewer pairs than a batch are an error."""
    out = Path(config.output_dir)
    table = np.random.default_rng(config.seed).standard_normal((config.slots, config.dimensions)) / np.sqrt(config.dimensions)
    rows = collate(limit_pairs(pairs, config.limit_pairs), queries, corpus).orderBy("question_id", "offset").toPandas()  # limit_pairs groups
    width = int(rows["offset"].max()) + 1 if len(rows) else 0
    firsts = rows.iloc[::width] if width else rows
    if len(firsts) < config.batch_size:
        raise ValueError("fewer pairs than one batch")
    if kind == "scorer" and width < 2:
        raise ValueError("a scorer needs negatives")
    q = _bags(firsts["query"].tolist(), config.slots)
    d = _bags(rows["text"].tolist(), config.slots)
    groups = [d[i : i + width] for i in range(0, len(d), width)]
    optimizer, history, first = AdamW(table, config.weight_decay), {"config": asdict(config), "kind": kind, "epochs": []}, 0
    done = sorted(int(p.parent.name.split("-")[1]) for p in out.glob("epoch-*/state.npz")) if resume else []
    if done:
        state = np.load(out / f"epoch-{done[-1]}" / "state.npz")
        table, optimizer.m, optimizer.v, optimizer.t, first = state["table"], state["m"], state["v"], int(state["t"]), done[-1]
        history = json.loads((out / "history.json").read_text())
    batches = len(q) // config.batch_size
    total = batches * config.epochs
    warmup = round(total * config.warmup_ratio)
    for epoch in range(first, config.epochs):
        began, losses, accuracies, logged = time.perf_counter(), [], [], []
        order = np.random.default_rng([config.seed, epoch]).permutation(len(q))
        for b in range(batches):
            pick = order[b * config.batch_size : (b + 1) * config.batch_size]
            asked, own = [q[i] for i in pick], [groups[i] for i in pick]
            if kind == "scorer":
                loss, accuracy, grad = ranking_step(table, asked, own, config.temperature)
            else:
                loss, accuracy, grad = contrastive_step(table, asked, [g[0] for g in own], [x for g in own for x in g[1:]], config.temperature)
            norm = float(np.sqrt((grad * grad).sum()))
            optimizer.step(table, grad * min(1.0, config.clip / (norm + 1e-6)), config.learning_rate * rate_at(epoch * batches + b, total, warmup))
            losses.append(loss)
            accuracies.append(accuracy)
            if b % config.log_every == 0:
                logged.append({"step": epoch * batches + b, "loss": round(loss, 6), "accuracy": round(accuracy, 6)})
        folder = out / f"epoch-{epoch + 1}"
        folder.mkdir(parents=True, exist_ok=True)
        np.save(folder / "table.npy", table)
        np.savez(folder / "state.npz", table=table, m=optimizer.m, v=optimizer.v, t=optimizer.t)
        history["epochs"].append({"epoch": epoch + 1, "loss": round(float(np.mean(losses)), 6), "accuracy": round(float(np.mean(accuracies)), 6), "seconds": round(time.perf_counter() - began, 3), "steps": logged})
        (out / "history.json").write_text(json.dumps(history, indent=2) + "\n")
    return history


def table_scorer(path: str):
    """A loader for retrieval.batch_scorer: cosine of the checkpoint's vectors of query and text."""

    def load():
        table = np.load(f"{path}/table.npy")

        def score(queries: list[str], texts: list[str]) -> np.ndarray:
            x, _ = _embed(table, _bags(queries, len(table)))
            y, _ = _embed(table, _bags(texts, len(table)))
            return (x * y).sum(1)

        return score

    return load
