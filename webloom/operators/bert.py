"""An embedder from a local model folder: a BERT encoder over numpy, mean pooling, length one.

The folder holds ``config.json``, ``tokenizer.json`` and ``model.safetensors`` as model hubs give them. Two forms of the
encoder are read, by what the configuration and the weights say: absolute positions or linear biases by distance (ALiBi),
and a plain or a gated feed-forward part.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

import numpy as np

_KINDS = {"F32": np.dtype("<f4"), "F16": np.dtype("<f2"), "F64": np.dtype("<f8"), "BF16": np.dtype("<u2")}


def read_tensors(path: str) -> dict[str, np.ndarray]:
    """The tensors of a safetensors file in single precision: a header in JSON, and where each one's bytes lie."""
    data = Path(path).read_bytes()
    size = int.from_bytes(data[:8], "little")
    out = {}
    for name, at in json.loads(data[8 : 8 + size]).items():
        if name != "__metadata__" and at["dtype"] in _KINDS:
            begin, end = at["data_offsets"]
            raw = np.frombuffer(data[8 + size + begin : 8 + size + end], dtype=_KINDS[at["dtype"]])
            if at["dtype"] == "BF16":
                raw = (raw.astype(np.uint32) << 16).view(np.float32)
            out[name.removeprefix("bert.")] = raw.astype(np.float32).reshape(at["shape"])
    return out


def slopes(heads: int) -> np.ndarray:
    """The slope of each head's linear bias: a geometric row for a power of two, else that of the next lower power and
    every second one of the next higher."""
    power = 1 << (heads.bit_length() - 1)
    row = lambda n: [2.0 ** (-8.0 * (i + 1) / n) for i in range(n)]
    return np.array(row(power) + row(2 * power)[::2][: heads - power], dtype=np.float32)


def _erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26, to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def _gelu(x: np.ndarray) -> np.ndarray:
    return x * 0.5 * (1 + _erf(x / np.sqrt(np.float32(2))))


_ACTIVATIONS = {"gelu": _gelu, "relu": lambda x: np.maximum(x, 0), "silu": lambda x: x / (1 + np.exp(-x))}


class Encoder:
    """Vectors of texts. Texts longer than the model's positions are cut to them."""

    def __init__(self, folder: str):
        from tokenizers import Tokenizer

        self.config = json.loads(Path(folder, "config.json").read_text())
        self.weights = read_tensors(f"{folder}/model.safetensors")
        self.tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
        self.tokenizer.enable_truncation(self.config["max_position_embeddings"])
        self.tokenizer.no_padding()
        self.alibi = self.config.get("position_embedding_type", "absolute") == "alibi"
        self.act = _ACTIVATIONS[self.config.get("hidden_act", "gelu")]
        self.gated = "encoder.layer.0.mlp.gated_layers.weight" in self.weights

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        y = x @ self.weights[f"{name}.weight"].T
        return y + self.weights[f"{name}.bias"] if f"{name}.bias" in self.weights else y

    def _norm(self, x: np.ndarray, name: str) -> np.ndarray:
        x = x - x.mean(-1, keepdims=True)
        x = x / np.sqrt((x * x).mean(-1, keepdims=True) + self.config.get("layer_norm_eps", 1e-12))
        return x * self.weights[f"{name}.weight"] + self.weights[f"{name}.bias"]

    def hidden(self, ids: list[int]) -> np.ndarray:
        """The last layer's vector of each token of one text."""
        n, heads = len(ids), self.config["num_attention_heads"]
        x = self.weights["embeddings.word_embeddings.weight"][ids] + self.weights["embeddings.token_type_embeddings.weight"][0]
        bias = np.zeros((heads, n, n), dtype=np.float32)
        if self.alibi:
            far = np.abs(np.arange(n)[:, None] - np.arange(n)[None, :])
            bias = -slopes(heads)[:, None, None] * far
        else:
            x = x + self.weights["embeddings.position_embeddings.weight"][:n]
        x = self._norm(x, "embeddings.LayerNorm")
        for i in range(self.config["num_hidden_layers"]):
            at = f"encoder.layer.{i}"
            q, k, v = (self._linear(x, f"{at}.attention.self.{s}").reshape(n, heads, -1).transpose(1, 0, 2) for s in ("query", "key", "value"))
            score = q @ k.transpose(0, 2, 1) / np.sqrt(np.float32(q.shape[-1])) + bias
            score = np.exp(score - score.max(-1, keepdims=True))
            met = (score / score.sum(-1, keepdims=True) @ v).transpose(1, 0, 2).reshape(n, -1)
            x = self._norm(self._linear(met, f"{at}.attention.output.dense") + x, f"{at}.attention.output.LayerNorm")
            if self.gated:
                gate, value = np.split(self._linear(x, f"{at}.mlp.gated_layers"), 2, axis=-1)
                x = self._norm(self._linear(self.act(gate) * value, f"{at}.mlp.wo") + x, f"{at}.mlp.layernorm")
            else:
                wide = self.act(self._linear(x, f"{at}.intermediate.dense"))
                x = self._norm(self._linear(wide, f"{at}.output.dense") + x, f"{at}.output.LayerNorm")
        return x

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            ids = self.tokenizer.encode(text or "").ids
            pooled = self.hidden(ids).mean(0) if ids else np.zeros(self.config["hidden_size"], dtype=np.float32)
            length = float(np.linalg.norm(pooled))
            out.append((pooled / length if length else pooled).tolist())
        return out


def local_embedder(folder: str) -> Callable[[], Encoder]:
    """A factory for `search.embedded`: each worker reads the model from a folder that it can reach, once."""
    return lambda: Encoder(folder)
