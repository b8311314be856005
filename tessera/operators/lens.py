"""The lens: a frozen sparse autoencoder that turns vectors into signed codes, and its small trainer.

Weights are a fixed-size model, sent to tasks once; encoding is ``mapInArrow`` over batches of vectors.
Training runs in numpy on a capped, hash-drawn sample.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .select import drawn

#: Manifest fields that must be there, and arrays that name a lens kind.
REQUIRED = ("input_dim", "m_total", "k")
KINDS = ("difference", "individual", "prompt")
CHUNK = 16_384


def kind_of(input_rep: str | None, arrays: set[str]) -> str | None:
    """Lens kind from a declared representation, or else from the arrays that were saved."""
    if input_rep in KINDS:
        return input_rep
    if "z_prompt" in arrays:
        return "prompt"
    if {"z_a", "z_b"} & arrays:
        return "individual"
    return "difference" if "z_diff" in arrays else None


@dataclass
class Whitener:
    """``none``, ``standardize`` or ``pca``, fitted on training rows."""

    method: str = "none"
    mean: np.ndarray | None = None
    forward: np.ndarray | None = None
    backward: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, method: str, eps: float = 1e-5) -> Whitener:
        if method == "none":
            return cls()
        mean = x.mean(axis=0)
        if method == "standardize":
            sd = x.std(axis=0) + eps
            return cls(method, mean, np.diag(1 / sd), np.diag(sd))
        if method == "pca":
            values, vectors = np.linalg.eigh(np.cov((x - mean).T, bias=True))
            scale = np.sqrt(np.maximum(values, 0) + eps)
            return cls(method, mean, vectors / scale, (vectors * scale).T)
        raise ValueError(f"unknown whitening {method!r}: use none, standardize or pca")

    def apply(self, x):
        return x if self.method == "none" else (x - self.mean) @ self.forward

    def invert(self, x):
        return x if self.method == "none" else x @ self.backward + self.mean


@dataclass
class Lens:
    """Encoder W, c; decoder D, b; activation rule ``threshold``, ``topk`` or ``jump``."""

    encoder: np.ndarray
    bias: np.ndarray
    decoder: np.ndarray
    centre: np.ndarray
    rule: str = "threshold"
    threshold: np.ndarray | float = 0.0
    k: int = 16
    whitener: Whitener = field(default_factory=Whitener)
    info: dict = field(default_factory=dict)

    @property
    def input_dim(self) -> int:
        return self.encoder.shape[1]

    @property
    def m_total(self) -> int:
        return self.encoder.shape[0]

    @classmethod
    def identity(cls, dim: int, threshold: float) -> Lens:
        return cls(np.eye(dim), np.zeros(dim), np.eye(dim), np.zeros(dim), "threshold", threshold)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Codes of rows; entries under the rule are exactly zero."""
        if x.shape[1] != self.input_dim:
            raise ValueError(f"vectors have {x.shape[1]} entries, the lens takes {self.input_dim}")
        pre = (self.whitener.apply(x) - self.centre) @ self.encoder.T + self.bias
        if self.rule == "topk":
            keep = np.argpartition(-np.abs(pre), min(self.k, self.m_total) - 1, axis=1)[:, : self.k]
            out = np.zeros_like(pre)
            np.put_along_axis(out, keep, np.take_along_axis(pre, keep, 1), 1)
            return out
        if self.rule == "jump":
            return np.where(pre > np.exp(self.threshold), pre, 0.0)
        return np.where(np.abs(pre) > self.threshold, pre, 0.0)

    def reconstruct(self, z: np.ndarray) -> np.ndarray:
        return self.whitener.invert(z @ self.decoder.T + self.centre)

    def residual_norm(self, x: np.ndarray) -> np.ndarray:
        return np.linalg.norm(x - self.reconstruct(self.project(x)), axis=1)

    def decoder_cosine(self) -> float:
        """Mean over features of the largest |cosine| with another decoder column."""
        d = self.decoder / np.maximum(np.linalg.norm(self.decoder, axis=0, keepdims=True), 1e-12)
        g = np.abs(d.T @ d)
        np.fill_diagonal(g, 0)
        return float(g.max(axis=1).mean()) if len(g) > 1 else float("nan")

    def save(self, folder: str, overwrite: bool = False) -> None:
        """Arrays and manifest; a folder with content is refused unless ``overwrite``."""
        path = Path(folder)
        if path.exists() and any(path.iterdir()) and not overwrite:
            raise FileExistsError(f"{folder} is not empty")
        path.mkdir(parents=True, exist_ok=True)
        arrays = {"encoder": self.encoder, "bias": self.bias, "decoder": self.decoder, "centre": self.centre, "threshold": np.asarray(self.threshold)}
        arrays |= {f"white_{k}": v for k, v in asdict(self.whitener).items() if isinstance(v, np.ndarray)}
        np.savez(path / "weights.npz", **arrays)
        manifest = {"schema": 1, "input_dim": self.input_dim, "m_total": self.m_total, "k": self.k, "rule": self.rule, "whiten": self.whitener.method} | self.info
        (path / "manifest.json").write_text(json.dumps(manifest, indent=1))

    @classmethod
    def load(cls, folder: str) -> Lens:
        manifest = json.loads(Path(folder, "manifest.json").read_text())
        missing = [f for f in REQUIRED if f not in manifest]
        if missing:
            raise ValueError(f"manifest lacks {', '.join(missing)}")
        a = np.load(Path(folder, "weights.npz"))
        white = Whitener(manifest.get("whiten", "none"), *[a.get(f"white_{n}") for n in ("mean", "forward", "backward")])
        known = {"schema", "input_dim", "m_total", "k", "rule", "whiten"}
        return cls(a["encoder"], a["bias"], a["decoder"], a["centre"], manifest.get("rule", "threshold"), a["threshold"], manifest["k"], white, {k: v for k, v in manifest.items() if k not in known})


def encode(vectors: DataFrame, lens: Lens, vector: str = "vector", key: str = "row_id") -> DataFrame:
    """(key, feature_id, z) of the codes that fire; vectors of another length are an error."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(lens)
    kind = dict(vectors.dtypes)[key]

    def run(batches):
        for batch in batches:
            names, lists = batch.column(0), batch.column(1)
            for lo in range(0, len(names), CHUNK):
                part = lists.slice(lo, CHUNK)
                sizes = part.value_lengths().to_numpy()
                if not len(sizes):
                    continue
                if sizes.min() != sizes.max():
                    raise ValueError("vectors differ in length")
                z = sent.value.project(part.flatten().to_numpy().astype(np.float64).reshape(len(part), -1))
                row, feature = np.nonzero(z)
                yield pa.record_batch([names.slice(lo, CHUNK).take(pa.array(row)), pa.array(feature.astype(np.int32)), pa.array(z[row, feature])], [key, "feature_id", "z"])

    return vectors.filter(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {kind}, feature_id int, z double")


def training_rows(vectors: DataFrame, vector: str = "vector", key: str = "row_id", val_share: float = 0.1, most: int = 100_000, seed: int = 0, group: str | None = None):
    """(training, validation) matrices: the split is by hash (of ``group``, such as a token's battle), the training part a capped draw."""
    val = hashing.held_out(group or key, val_share)

    def collect(df):
        got = df.select(vector).toArrow().column(vector)
        return np.array(got.to_pylist(), np.float64) if len(got) else np.zeros((0, 0))

    return collect(vectors.filter(~val).orderBy(drawn(key, seed), key).limit(most)), collect(vectors.filter(val).orderBy(drawn(key, seed), key).limit(most // 5))


def train(x: np.ndarray, val: np.ndarray | None = None, m: int = 128, k: int = 16, prefixes: tuple[int, ...] = (8,), epochs: int = 200, batch: int = 512, lr: float = 1e-3,
          patience: int = 10, whiten: str = "none", seed: int = 0, dead_after: int = 256) -> tuple[Lens, list[dict]]:
    """A signed batch-top-k autoencoder by Adam, with nested prefixes and revived dead features.

    The loss averages the squared error of reconstructions from the first features (each prefix) and from
    all of them.  The kept threshold is a running mean of the smallest size that a batch keeps.
    """
    white = Whitener.fit(x, whiten)
    x = white.apply(x)
    val = white.apply(val) if val is not None and len(val) else x
    rng = np.random.default_rng(seed)
    dim, m = x.shape[1], int(m)
    decoder = rng.normal(size=(dim, m))
    decoder /= np.linalg.norm(decoder, axis=0, keepdims=True)
    p = {"W": decoder.T.copy(), "c": np.zeros(m), "D": decoder, "b": x.mean(axis=0)}
    first = {n: np.zeros_like(v) for n, v in p.items()}
    second = {n: np.zeros_like(v) for n, v in p.items()}
    cuts = sorted({*[q for q in prefixes if 0 < q < m], m})
    theta, silent, step, best, log, wait = None, np.zeros(m, int), 0, (np.inf, None), [], 0

    def keep(pre, n):
        flat = np.abs(pre).ravel()
        n = min(n, flat.size)
        return np.partition(flat, flat.size - n)[flat.size - n]

    for epoch in range(epochs):
        for at in range(0, len(x), batch):
            rows = x[rng.integers(0, len(x), min(batch, len(x)))] if at else x[rng.permutation(len(x))[: min(batch, len(x))]]
            pre = (rows - p["b"]) @ p["W"].T + p["c"]
            least = keep(pre, k * len(rows))
            mask = np.abs(pre) >= least
            theta = least if theta is None else 0.99 * theta + 0.01 * least
            z = pre * mask
            silent = np.where(mask.any(axis=0), 0, silent + 1)
            gz, gd, gb = np.zeros_like(z), np.zeros_like(p["D"]), np.zeros_like(p["b"])
            for q in cuts:
                miss = (z[:, :q] @ p["D"][:, :q].T + p["b"] - rows) * (2 / (len(rows) * len(cuts)))
                gz[:, :q] += miss @ p["D"][:, :q]
                gd[:, :q] += miss.T @ z[:, :q]
                gb += miss.sum(axis=0)
            dead = silent > dead_after
            if dead.any():  # let dead features explain what is left
                rest = rows - (z @ p["D"].T + p["b"])
                zd = np.where(dead, pre, 0)
                miss = (zd @ p["D"].T - rest) * (2 / (32 * len(rows)))
                gz += np.where(dead, miss @ p["D"], 0)
                mask = mask | dead
            gpre = gz * mask
            grads = {"W": gpre.T @ (rows - p["b"]), "c": gpre.sum(axis=0), "D": gd, "b": gb - gpre.sum(axis=0) @ p["W"]}
            step += 1
            for n in p:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                p[n] = p[n] - lr * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
            p["D"] /= np.maximum(np.linalg.norm(p["D"], axis=0, keepdims=True), 1e-12)
        pre = (val - p["b"]) @ p["W"].T + p["c"]
        z = np.where(np.abs(pre) > theta, pre, 0)
        loss = float(np.mean([((z[:, :q] @ p["D"][:, :q].T + p["b"] - val) ** 2).sum(axis=1).mean() for q in cuts]))
        log.append({"epoch": epoch, "val_loss": loss, "threshold": float(theta), "dead": int((silent > dead_after).sum())})
        if loss < best[0] - 1e-9:
            best, wait = (loss, ({n: v.copy() for n, v in p.items()}, float(theta))), 0
        else:
            wait += 1
            if wait >= patience:
                break
    w, theta = best[1]
    fvu = best[0] / max(1e-12, float(((val - val.mean(axis=0)) ** 2).sum(axis=1).mean()))
    return Lens(w["W"], w["c"], w["D"], w["b"], "threshold", theta, k, white, {"fvu": fvu, "explained_variance": 1 - fvu}), log


def train_plain(x: np.ndarray, val: np.ndarray | None = None, m: int = 128, k: int = 16, rule: str = "topk", epochs: int = 200, batch: int = 512, lr: float = 1e-3,
                patience: int = 10, whiten: str = "none", seed: int = 0, sparsity: float = 1e-3, bandwidth: float = 1e-3, threshold: float = 1e-3) -> tuple[Lens, list[dict]]:
    """An autoencoder by Adam that keeps the k largest sizes of a row (``topk``) or codes over a learned threshold (``jump``).

    The thresholds of ``jump`` are fitted with a penalty on the number of codes; its gradients are straight-through
    estimates from the codes within half a bandwidth of the threshold.
    """
    if rule not in ("topk", "jump"):
        raise ValueError(f"unknown rule {rule!r}: use topk or jump")
    white = Whitener.fit(x, whiten)
    x = white.apply(x)
    val = white.apply(val) if val is not None and len(val) else x
    rng = np.random.default_rng(seed)
    decoder = rng.normal(size=(x.shape[1], m))
    decoder /= np.linalg.norm(decoder, axis=0, keepdims=True)
    p = {"W": decoder.T.copy(), "c": np.zeros(m), "D": decoder, "b": x.mean(axis=0), "t": np.full(m, np.log(threshold))}
    first, second = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    step, best, log, wait = 0, (np.inf, None), [], 0

    def built(p) -> Lens:
        return Lens(p["W"], p["c"], p["D"], p["b"], rule, p["t"] if rule == "jump" else 0.0, min(k, m))

    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = x[order[at : at + batch]]
            z, n = built(p).project(rows), len(rows)
            miss = (z @ p["D"].T + p["b"] - rows) * (2 / n)
            gz = miss @ p["D"]
            gpre = gz * (z != 0)
            grads = {"W": gpre.T @ (rows - p["b"]), "c": gpre.sum(axis=0), "D": miss.T @ z, "b": miss.sum(axis=0) - gpre.sum(axis=0) @ p["W"]}
            if rule == "jump":
                theta = np.exp(p["t"])
                near = np.abs((rows - p["b"]) @ p["W"].T + p["c"] - theta) < bandwidth / 2
                grads["t"] = -(near * (gz * theta + sparsity / n)).sum(axis=0) * theta / bandwidth
            step += 1
            for g, grad in grads.items():
                first[g] = 0.9 * first[g] + 0.1 * grad
                second[g] = 0.999 * second[g] + 0.001 * grad**2
                p[g] = p[g] - lr * (first[g] / (1 - 0.9**step)) / (np.sqrt(second[g] / (1 - 0.999**step)) + 1e-8)
            p["D"] = p["D"] / np.maximum(np.linalg.norm(p["D"], axis=0, keepdims=True), 1e-12)
        now = built(p)
        z = now.project(val)
        error = float(((now.reconstruct(z) - val) ** 2).sum(axis=1).mean())
        loss = error + (sparsity * float((z != 0).sum(axis=1).mean()) if rule == "jump" else 0.0)
        log.append({"epoch": epoch, "val_loss": loss, "l0": float((z != 0).sum(axis=1).mean())})
        if loss < best[0] - 1e-9:
            best, wait = (loss, ({n: v.copy() for n, v in p.items()}, error)), 0
        else:
            wait += 1
            if wait >= patience:
                break
    weights, error = best[1]
    out = built(weights)
    fvu = error / max(1e-12, float(((val - val.mean(axis=0)) ** 2).sum(axis=1).mean()))
    out.whitener, out.info = white, {"fvu": fvu, "explained_variance": 1 - fvu}
    return out, log
