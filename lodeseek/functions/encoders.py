"""Text encoders by name: functions of parameters that give a loader, which gives a function from texts to vectors."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash

from lodeseek.functions.text import TOKEN

_TOKEN = re.compile(TOKEN)
Encoder = Callable[[list[str]], np.ndarray]


def token_slots(text: str, size: int) -> np.ndarray:
    """Slots of a text's distinct tokens in a table of `size` rows."""
    return np.array(sorted({xxhash.xxh3_64_intdigest(t) % size for t in _TOKEN.findall(text.lower())}), np.int64)


def table_encoder(table: np.ndarray) -> Encoder:
    """The mean of the rows of a text's distinct tokens; a text without tokens is the zero vector."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), table.shape[1]))
        for i, t in enumerate(texts):
            slots = token_slots(t, len(table))
            if len(slots):
                out[i] = table[slots].mean(0)
        return out

    return run


def hashing(parameters: dict) -> Callable[[], Encoder]:
    """Random directions of hashed tokens. Deterministic and not learned: a stand-in for a learned encoder."""
    size, dims, seed = int(parameters.get("slots", 1 << 15)), int(parameters.get("dimensions", 64)), int(parameters.get("seed", 17))
    return lambda: table_encoder(np.random.default_rng(seed).standard_normal((size, dims)) / np.sqrt(dims))


def trained(parameters: dict) -> Callable[[], Encoder]:
    """The encoder of a checkpoint folder written by lodeseek.operators.encoder."""
    path = str(parameters["model_name"])
    return lambda: table_encoder(np.load(f"{path}/table.npy"))


#: A learned encoder of another library is registered here by its user.
ENCODERS: dict[str, Callable[[dict], Callable[[], Encoder]]] = {"hashing": hashing, "trained": trained}
