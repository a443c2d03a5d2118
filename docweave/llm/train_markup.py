"""Trains the block labeller of markup.py: ``python -m docweave.llm.train_markup`` writes markup_model.npz and prints how it does on held-out documents.

The documents are generated (generate_markup.py), so the class of every leaf is known and no table and no rule about marks is needed.  A tenth is held out.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from docweave.llm.generate_markup import classes, document, unmarked
from docweave.llm.markup import CLASSES, INPUTS, MARKS, WORD_BUCKETS, WORD_SIZE, BiLSTM, admitted, segment, vectors

DOCUMENTS = 14_000
HIDDEN = 32


def training_set(n: int = DOCUMENTS, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, classes, admitted) of each document."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        text, truth = document(rng)
        if leaves := segment(text):
            true = classes(leaves, truth)
            out.append((vectors(unmarked(leaves, rng)), true, admitted(leaves)))
    return out


def _initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w: dict[str, np.ndarray] = {"words": rng.normal(0, 0.3, (WORD_BUCKETS, WORD_SIZE))}
    for d in (0, 1):
        w[f"wx{d}"] = rng.normal(0, 0.2, (INPUTS, 4 * HIDDEN))
        w[f"wh{d}"] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        w[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), 2 * np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    w["out"] = rng.normal(0, 0.1, (2 * HIDDEN + INPUTS, len(CLASSES)))
    w["out_b"] = np.zeros(len(CLASSES))
    return {k: v.astype(np.float32) for k, v in w.items()}


def _direction(w: dict, z: np.ndarray, mask: np.ndarray, d: int):
    """Forward pass that keeps what the backward pass needs."""
    n, steps, _ = z.shape
    wx, wh, b = w[f"wx{d}"], w[f"wh{d}"], w[f"b{d}"]
    gates = z @ wx + b
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, kept = np.zeros((n, steps, HIDDEN), np.float32), []
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        g = gates[:, t] + h @ wh
        s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        u = np.tanh(g[:, 3 * HIDDEN :])
        c2 = f * c + i * u
        tc = np.tanh(c2)
        live = mask[:, t, None]
        kept.append((t, h, c, i, f, o, u, tc, live))
        h, c = np.where(live, o * tc, h), np.where(live, c2, c)
        out[:, t] = h
    return out, kept


def _direction_back(w: dict, z: np.ndarray, kept: list, grad_out: np.ndarray, d: int, grads: dict) -> np.ndarray:
    """Adds the gradients and returns that of the inputs."""
    wh = w[f"wh{d}"]
    n, steps, _ = z.shape
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dgates = np.zeros((n, steps, 4 * HIDDEN), np.float32)
    for t, h, c, i, f, o, u, tc, live in reversed(kept):
        dh = dh + grad_out[:, t]
        a, b = np.where(live, dh, 0), np.where(live, dc, 0)
        b = b + a * o * (1 - tc * tc)
        dg = np.concatenate([b * u * i * (1 - i), b * c * f * (1 - f), a * tc * o * (1 - o), b * i * (1 - u * u)], 1)
        dgates[:, t] = dg
        grads[f"wh{d}"] += h.T @ dg
        dh, dc = np.where(live, dg @ wh.T, dh), np.where(live, b * f, dc)
    flat = dgates.reshape(n * steps, -1)
    grads[f"wx{d}"] += z.reshape(n * steps, -1).T @ flat
    grads[f"b{d}"] += flat.sum(0)
    return dgates @ w[f"wx{d}"].T


def train(data: list, epochs: int = 16, rate: float = 1e-2, cells: int = 1500, verbose: bool = True, recurrent: bool = True) -> dict[str, np.ndarray]:
    w = _initial()
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    held, learned = data[: len(data) // 10], data[len(data) // 10 :]
    rng = random.Random(3)
    order = sorted(range(len(learned)), key=lambda k: len(learned[k][0]))
    groups, at = [], 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop - at + 1) * len(learned[order[stop]][0]) <= cells:
            stop += 1
        groups.append(order[at:stop])
        at = stop
    step, total = 0, epochs * len(groups)
    for epoch in range(epochs):
        rng.shuffle(groups)
        for group in groups:
            step += 1
            steps = max(len(learned[k][0]) for k in group)
            x, y, mask = np.zeros((len(group), steps, len(MARKS) + WORD_BUCKETS), np.float32), np.zeros((len(group), steps), np.int64), np.zeros((len(group), steps), bool)
            for j, k in enumerate(group):
                n = len(learned[k][0])
                x[j, :n], y[j, :n], mask[j, :n] = learned[k][0], learned[k][1], True
            z = BiLSTM.inputs(x, w["words"])
            f, kept_f = _direction(w, z, mask, 0)
            b, kept_b = _direction(w, z, mask, 1)
            both = np.concatenate([f * recurrent, b * recurrent, z], 2)
            scores = both @ w["out"] + w["out_b"]
            p = np.exp(scores - scores.max(2, keepdims=True))
            p /= p.sum(2, keepdims=True)
            p[np.arange(len(group))[:, None], np.arange(steps)[None, :], y] -= 1
            p *= mask[:, :, None] / mask.sum()
            grads = {k: np.zeros_like(v) for k, v in w.items()}
            flat = p.reshape(-1, len(CLASSES))
            grads["out"], grads["out_b"] = both.reshape(len(flat), -1).T @ flat, flat.sum(0)
            back = p @ w["out"].T
            dz = back[:, :, 2 * HIDDEN :]
            if recurrent:
                dz = dz + _direction_back(w, z, kept_f, back[:, :, :HIDDEN], 0, grads) + _direction_back(w, z, kept_b, back[:, :, HIDDEN : 2 * HIDDEN], 1, grads)
            grads["words"] = x[:, :, len(MARKS) :].reshape(len(flat), -1).T @ dz[:, :, len(MARKS) :].reshape(len(flat), -1)
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, step / 50) * 0.5 * (1 + np.cos(np.pi * step / total))
            for k, g in grads.items():
                g = g / max(1.0, size)
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.002 * (g * g - v)
                w[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.998**step)) + 1e-8)
        if verbose:
            print(epoch, "held-out accuracy: leaves, documents, leaves after the check:", *accuracy(w, held), flush=True)
    if not recurrent:
        w["out"][: 2 * HIDDEN] = 0
    return w


def accuracy(w: dict, data: list) -> tuple[float, float, float]:
    net = BiLSTM(w)
    right = whole = checked = n = 0
    for x, y, ok in data:
        s = net.scores(x[None], np.ones((1, len(x)), bool))[0]
        a, b = s.argmax(1), np.where(ok, s, -np.inf).argmax(1)
        right, checked, n, whole = right + (a == y).sum(), checked + (b == y).sum(), n + len(y), whole + bool((b == y).all())
    return round(float(right / n), 5), round(whole / len(data), 5), round(float(checked / n), 5)


def admission_only(data: list) -> float:
    """Share of leaves that are right if each becomes the first class its path admits."""
    right = n = 0
    for _, y, ok in data:
        right, n = right + (np.where(ok[:, 1:].any(1), ok[:, 1:].argmax(1) + 1, 0) == y).sum(), n + len(y)
    return round(float(right / n), 5)


def main() -> None:
    data = training_set()
    held = data[: len(data) // 10]
    print(len(data), "documents,", sum(len(x) for x, *_ in data), "leaves; by admission only:", admission_only(held), flush=True)
    w = train(data)
    np.savez_compressed(Path(__file__).with_name("markup_model.npz"), **{k: v.astype(np.float16) for k, v in w.items()})
    print("without recurrence:", *accuracy(train(data, epochs=8, verbose=False, recurrent=False), held))


if __name__ == "__main__":
    main()
