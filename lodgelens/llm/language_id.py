"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (from a hash of the letter, so no table is stored).  A trigram's vector
is the elementwise product of its letters' vectors, the first rolled by two places and the second by one; a document's
vector is the sum over its trigrams, and a language's prototype the sum over its training documents.  A document gets
the language whose prototype has the largest cosine with it.

Sums are of whole numbers, so they do not depend on the order of rows.  A task bundles its documents before anything
is shuffled: one vector per language and task.  What reaches the driver is one prototype per language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelens.llm.common import others, quoted, text_of

DIMENSIONS = 1024
LETTERS = 20_000  # letter vectors that a task keeps (a byte per dimension); further ones are made again when needed
MAX_LANGUAGES = 10_000  # prototypes are broadcast: at most 80 MB
SHARPNESS = 20.0
CHUNK = 1 << 19
UNKNOWN = "und"


class TrigramEncoder:
    """Document vectors of texts."""

    def __init__(self, dimensions: int, seed: int = 7):
        self.dimensions, self.seed = dimensions, seed
        self.letter: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, dtype=np.int8)  # 1 letter, -1 other, 0 not seen yet

    def vector(self, code: int) -> np.ndarray:
        found = self.letter.get(code)
        if found is None:
            random = np.random.Generator(np.random.PCG64([self.seed, code]))
            found = random.integers(0, 2, self.dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)
            if len(self.letter) >= LETTERS:
                self.letter.clear()
            self.letter[code] = found
        return found

    def codes(self, text: str) -> np.ndarray:
        """Lower-case letters as code points, every run of other characters as one blank, a blank at both ends."""
        code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = self.is_letter[code]
        if not kind.all():
            for new in np.unique(code[kind == 0]).tolist():
                self.is_letter[new] = 1 if chr(new).isalpha() else -1
            kind = self.is_letter[code]
        letters = kind > 0
        keep = letters.copy()
        keep[0] = True
        keep[1:] |= letters[:-1]  # the first of a run of others stands for it
        return np.where(letters, code, 32)[keep]

    def add(self, out: np.ndarray, rows: list[tuple[int, np.ndarray]]) -> None:
        """Add the trigrams of code arrays to the rows of ``out`` that they name."""
        rows = [(row, code) for row, code in rows if len(code) >= 3]
        if not rows:
            return
        alphabet, small = np.unique(np.concatenate([code for _, code in rows]), return_inverse=True)
        k = len(alphabet)
        small = small.astype(np.int64)
        keys, owners, begin = [], [], 0
        for row, code in rows:
            s = small[begin : begin + len(code)]
            begin += len(code)
            key = (s[:-2] * k + s[1:-1]) * k + s[2:]
            keys.append(key)
            owners.append(np.full(len(key), row, dtype=np.int64))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        grams, gram = np.unique(key, return_inverse=True)
        base = np.stack([self.vector(int(c)) for c in alphabet]).astype(np.float32)
        first, second = np.roll(base, 2, axis=1), np.roll(base, 1, axis=1)
        for low in range(0, len(grams), 8192):  # bounds the gram vectors at once
            part = grams[low : low + 8192]
            vectors = first[part // (k * k)] * second[part // k % k] * base[part % k]
            here = (gram >= low) & (gram < low + 8192)
            counts = np.bincount(
                owner[here] * len(part) + gram[here] - low, minlength=len(out) * len(part)
            ).reshape(len(out), len(part))
            out += counts.astype(np.float32) @ vectors

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of texts and whether each has a letter."""
        out = np.zeros((len(texts), self.dimensions), dtype=np.float64)
        lettered = np.zeros(len(texts), dtype=bool)
        waiting, size = [], 0
        for row, text in enumerate(texts):
            code = self.codes(text)
            lettered[row] = bool((code != 32).any())
            for at in range(0, max(len(code) - 2, 0), CHUNK):
                part = code[at : at + CHUNK + 2]
                waiting.append((row, part))
                size += len(part)
                if size >= CHUNK:
                    self.flush(out, waiting)
                    waiting, size = [], 0
        self.flush(out, waiting)
        return out, lettered

    def flush(self, out: np.ndarray, waiting: list[tuple[int, np.ndarray]]) -> None:
        if waiting:
            rows = sorted({row for row, _ in waiting})
            at = {row: n for n, row in enumerate(rows)}
            part = np.zeros((len(rows), self.dimensions), dtype=np.float32)
            self.add(part, [(at[row], code) for row, code in waiting])
            out[rows] += part


def learn_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, label: str = "lang") -> dict[str, np.ndarray]:
    """The prototype of every non-null label.  Labels are languages: more than ``MAX_LANGUAGES`` are an error, since a
    prototype of each is sent to every task."""

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = TrigramEncoder(dimensions), {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                vectors, _ = encoder.encode(part["text"].tolist())
                for name, rows in part.groupby("label", sort=False).indices.items():
                    total = sums.setdefault(name, np.zeros(dimensions, dtype=np.int64))
                    total += np.rint(vectors[rows].sum(axis=0)).astype(np.int64)
        if sums:
            yield pd.DataFrame({"label": list(sums), "total": [v.tolist() for v in sums.values()]})

    labelled = docs.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), text_of().alias("text"))
    summed = (
        labelled.mapInPandas(bundle, "label string, total array<long>")
        .select("label", F.posexplode("total").alias("place", "value"))
        .groupBy("label", "place")
        .agg(F.sum("value").alias("value"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("total"))
        .select("label", F.col("total.value").alias("total"))
        .limit(MAX_LANGUAGES + 1)
        .collect()
    )
    if len(summed) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels; these are not languages")
    return {row["label"]: np.array(row["total"], dtype=np.float64) for row in sorted(summed)}


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``carry``) with ``lang_pred`` and ``score``, from the text alone.

    ``score`` is the share of the best language in a softmax over the cosines.  A text that is null or has no letter,
    and any text where nothing was learned, gets ``und`` and 0; a text with fewer than three characters still has the
    trigram of its letters and the blanks around them.  Equal cosines go to the first language in order.  Repeated rows
    are judged each; an empty table gives no rows.  Input columns named like a result are replaced.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in names]) if names else None
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    held = {}

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        guess, score = np.full(len(text), UNKNOWN, dtype=object), np.zeros(len(text))
        names, matrix = shared.value
        if matrix is not None:
            encoder = held.setdefault("encoder", TrigramEncoder(matrix.shape[1]))
            texts = text.tolist()
            for at in range(0, len(texts), 256):
                vectors, lettered = encoder.encode(texts[at : at + 256])
                cosine = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
                best = cosine.argmax(axis=1)
                weight = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
                share = weight.max(axis=1) / weight.sum(axis=1)
                guess[at : at + 256] = np.where(lettered, np.array(names, dtype=object)[best], UNKNOWN)
                score[at : at + 256] = np.where(lettered, share, 0.0)
        return pd.DataFrame({"lang_pred": guess, "score": score})

    kept = docs.select(*(docs.columns if carry is None else carry))
    columns: list[Column] = [quoted(n) for n in others(kept, ("lang_pred", "score"))]
    found = docs.select(*columns, predict(text_of()).alias("prediction of language"))
    return found.select(*columns, "prediction of language.lang_pred", "prediction of language.score")
