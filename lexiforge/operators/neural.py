"""A small network over words, applied in Arrow batches with broadcast weights."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAGIC = b"LXF1"


def write_model(tensors: dict[str, np.ndarray]) -> bytes:
    """Magic, number, then name, shape and 32-bit floats of each tensor."""
    out = [MAGIC, struct.pack("<I", len(tensors))]
    for name, t in tensors.items():
        raw = name.encode()
        out += [struct.pack("<HB", len(raw), t.ndim), raw, struct.pack(f"<{t.ndim}I", *t.shape), np.ascontiguousarray(t, "<f4").tobytes()]
    return b"".join(out)


def read_model(data: bytes) -> dict[str, np.ndarray]:
    """The tensors of write_model; a wrong magic, a short file or trailing bytes raise ValueError."""
    if data[:4] != MAGIC:
        raise ValueError("not a model")
    try:
        (count,), at, out = struct.unpack_from("<I", data, 4), 8, {}
        for _ in range(count):
            size, dims = struct.unpack_from("<HB", data, at)
            name = data[at + 3 : at + 3 + size].decode()
            at += 3 + size
            shape = struct.unpack_from(f"<{dims}I", data, at)
            at += 4 * dims
            n = int(np.prod(shape, dtype=np.int64))
            out[name] = np.frombuffer(data, "<f4", n, at).reshape(shape)
            at += 4 * n
    except (struct.error, UnicodeDecodeError) as e:
        raise ValueError("a model cut short") from e
    if at != len(data):
        raise ValueError("bytes behind the last tensor")
    return out


def _norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    m = x.mean(-1, keepdims=True)
    return (x - m) / np.sqrt(((x - m) ** 2).mean(-1, keepdims=True) + eps) * weight + bias


def _gelu(x: np.ndarray) -> np.ndarray:
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return 0.5 * x * (1 + (1 - poly * np.exp(-z * z)) * np.sign(x))


def forward(model: dict[str, np.ndarray], buckets: list[list[int]], shapes: list[int], heads: int) -> np.ndarray:
    """One window: rows of hashed letter runs and word shapes to class log-probabilities per word."""
    x = np.stack([model["grams"][b].mean(0) if b else np.zeros(model["grams"].shape[1], np.float32) for b in buckets])
    x = x @ model["in.weight"].T + model["in.bias"] + model["shape"][shapes] + model["place"][: len(buckets)]
    layer = 0
    while f"{layer}.qkv.weight" in model:
        w = lambda name, k=layer: model[f"{k}.{name}"]
        y = _norm(x, w("norm1.weight"), w("norm1.bias"))
        q, k, v = np.split(y @ w("qkv.weight").T + w("qkv.bias"), 3, -1)
        q, k, v = (a.reshape(len(x), heads, -1).swapaxes(0, 1) for a in (q, k, v))
        s = q @ k.swapaxes(1, 2) / np.sqrt(q.shape[-1])
        s = np.exp(s - s.max(-1, keepdims=True))
        y = ((s / s.sum(-1, keepdims=True)) @ v).swapaxes(0, 1).reshape(len(x), -1)
        x = x + y @ w("out.weight").T + w("out.bias")
        y = _norm(x, w("norm2.weight"), w("norm2.bias"))
        x = x + _gelu(y @ w("up.weight").T + w("up.bias")) @ w("down.weight").T + w("down.bias")
        layer += 1
    z = x @ model["head.weight"].T + model["head.bias"]
    z = z - z.max(-1, keepdims=True)
    return z - np.log(np.exp(z).sum(-1, keepdims=True))


def judge(df: DataFrame, model: dict[str, np.ndarray], key: str, heads: int = 4, top: int = 5) -> DataFrame:
    """K3: rows (key, buckets array<array<int>>, shapes array<int>) to (key, pos, top: array of (class,
    ln_p)), the `top` best classes of each word. The model is broadcast: its size is the caller's file."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, pos, best = [], [], []
            for k, grams, shapes in zip(*(c.to_pylist() for c in b.columns)):
                out = forward(shared.value, grams, shapes, heads)
                for i, row in enumerate(out):
                    order = np.lexsort((np.arange(len(row)), -row))[:top]
                    keys.append(k)
                    pos.append(i)
                    best.append([{"class": int(c), "ln_p": float(row[c])} for c in order])
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(pos, pa.int32()), pa.array(best, pa.list_(pa.struct([("class", pa.int32()), ("ln_p", pa.float64())])))], [key, "pos", "top"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "buckets", "shapes").mapInArrow(run, f"`{key}` {kind}, pos int, top array<struct<class:int,ln_p:double>>")
