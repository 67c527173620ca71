"""Words, shingle hashes and fast similarity sketches of texts, vectorised over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_U = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _Hashes()


def words(text: str | None) -> list[bytes]:
    """The longest runs of a-z and 0-9 in the lower-cased text."""
    return [] if text is None else text.lower().encode("utf-8", "replace").translate(_KEEP).split()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(docs: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of successive words, by document: (document's number, hash), sorted."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    h = np.fromiter((_HASH[w] for d in docs for w in d), _U, int(sizes.sum()))
    owner = np.repeat(np.arange(len(docs)), sizes)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    acc = np.zeros(n, _U)
    for k in range(width):
        acc = mix(acc * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    same = owner[:n] == owner[width - 1 :]
    owner, acc = owner[:n][same], acc[same]
    order = np.lexsort((acc, owner))
    owner, acc = owner[order], acc[order]
    first = np.ones(len(acc), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (acc[1:] != acc[:-1])
    return owner[first], acc[first]


def fast_sketch(owner: np.ndarray, items: np.ndarray, docs: int, bins: int) -> np.ndarray:
    """docs x bins minima. In round i < bins each item falls into a hashed bin, in round i >= bins all items fall into bin
    i - bins; a value is the round and a hash below it. A document stops after the round that fills its last bin, so every
    bin is filled and two sketches agree in a bin with the Jaccard similarity as probability."""
    empty = np.iinfo(_U).max
    out = np.full(docs * bins, empty, _U)
    for i in range(2 * bins):
        if not len(items):
            break
        h = mix(items + _U((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        b = (h % _U(bins)).astype(np.int64) if i < bins else np.full(len(h), i - bins)
        np.minimum.at(out, owner * bins + b, _U(i << 52) | (mix(h) >> _U(12)))
        open_ = (out.reshape(docs, bins) == empty).any(axis=1)
        go = open_[owner]
        if not go.all():
            owner, items = owner[go], items[go]
    return out.reshape(docs, bins)


def band_hashes(sketch: np.ndarray, rows: int) -> np.ndarray:
    """docs x bands: one hash of `rows` successive bins and the band's number."""
    s = sketch.reshape(len(sketch), -1, rows)
    acc = np.broadcast_to(np.arange(s.shape[1], dtype=_U), s.shape[:2]).copy()
    for k in range(rows):
        acc = mix(acc * _U(0x9E3779B97F4A7C15) + s[:, :, k])
    return acc.view(np.int64)


def fingerprints(width: int, least: int, bands: int, rows: int):
    """mapInPandas function: (id, text) to (id, code, bands) of texts with at least `least` words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), 1000):
                part = pdf.iloc[s : s + 1000]
                docs = [words(t) for t in part["text"]]
                ok = np.array([len(d) >= max(least, width) for d in docs], bool)
                docs = [d for d, k in zip(docs, ok) if k]
                if docs:
                    owner, items = shingles(docs, width)
                    b = band_hashes(fast_sketch(owner, items, len(docs), bands * rows), rows)
                    code = np.array([xxhash.xxh3_64_intdigest(b" ".join(d)) for d in docs], _U).view(np.int64)
                    yield pd.DataFrame({"id": part["id"].to_numpy()[ok], "code": code, "bands": list(b)})

    return run


def codes_of(width: int, least: int):
    """mapInPandas function: (id, text_key, text) to (id, text_key, code) of texts with at least `least` words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs = [words(t) for t in pdf["text"]]
            ok = np.array([len(d) >= max(least, width) for d in docs], bool)
            code = np.array([xxhash.xxh3_64_intdigest(b" ".join(d)) for d, k in zip(docs, ok) if k], _U).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[ok], "text_key": pdf["text_key"].to_numpy()[ok], "code": code})

    return run


def shingle_sets(width: int):
    """mapInPandas function: (id, text) to (id, items), the distinct shingle hashes of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), 1000):
                part = pdf.iloc[s : s + 1000]
                owner, items = shingles([words(t) for t in part["text"]], width)
                cuts = np.searchsorted(owner, np.arange(1, len(part)))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "items": np.split(items.view(np.int64), cuts)})

    return run
