"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1/-1.  An n-gram of letters is bound
by multiplying its letters' vectors, each permuted (rotated) once per
position; a text is bundled by adding its n-grams' vectors.  A language's
prototype is the bundle of its training texts, each scaled to unit length.
A text goes to the prototype with the highest cosine, after the part that
all prototypes share has been taken out of both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import small_batches

SLOTS = 64  # word gap, a to z, and 37 shared by all other letters
DIMENSIONS = 512
GRAM = 3
CHUNK = 1 << 19  # characters that are encoded at once
GRAMS_AT_ONCE = 1 << 13
MAX_LANGUAGES = 1000


def letter_table() -> np.ndarray:
    """Slot of every code point of the basic plane: 0 for what is no letter."""
    table = np.zeros(0x10000, dtype=np.int32)
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[code] = low - 96 if 97 <= low <= 122 else 27 + low % (SLOTS - 27)
    return table


def letter_vectors(dimensions: int = DIMENSIONS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), size=(SLOTS, dimensions))


class Encoder:
    """Turns texts into their bundled vectors, a bounded number of characters at a time."""

    def __init__(self, dimensions: int = DIMENSIONS):
        base = letter_vectors(dimensions)
        self.dimensions = dimensions
        self.table = letter_table()
        self.rotated = [np.roll(base, GRAM - 1 - i, axis=1) for i in range(GRAM)]

    def slots(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        wide = codes >= 0x10000
        out = self.table[np.where(wide, 0, codes)]
        if wide.any():
            at = np.flatnonzero(wide)
            out[at] = [27 + c % (SLOTS - 27) if chr(c).isalpha() else 0 for c in codes[at].tolist()]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the texts, and whether each has a letter."""
        vectors = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        lettered = np.zeros(len(texts), dtype=bool)
        gap = np.zeros(1, dtype=np.int32)
        rows, held = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            slot = np.concatenate([gap, *[self.slots(text[at : at + CHUNK]) for at in range(0, len(text), CHUNK)], gap])
            slot = slot[(slot != 0) | np.concatenate(([True], slot[:-1] != 0))]  # one gap between words
            lettered[i] = slot.any()
            # pieces overlap, so that each n-gram is in just one of them
            for at in range(0, len(slot) - GRAM + 1, CHUNK):
                rows.append((i, slot[at : at + CHUNK + GRAM - 1]))
                held += len(rows[-1][1])
                if held > CHUNK:
                    self._bundle(rows, vectors)
                    rows, held = [], 0
        if rows:
            self._bundle(rows, vectors)
        return vectors, lettered

    def _bundle(self, rows: list[tuple[int, np.ndarray]], vectors: np.ndarray) -> None:
        slot = np.concatenate([piece for _, piece in rows])
        part = np.repeat(np.arange(len(rows)), [len(piece) for _, piece in rows])
        n = len(slot) - GRAM + 1
        code = np.zeros(n, dtype=np.int64)
        for i in range(GRAM):
            code = code * SLOTS + slot[i : n + i]
        inside = (part[:n] == part[GRAM - 1 :]) & (code > 0)
        code, part = code[inside], part[:n][inside]
        seen = np.zeros(SLOTS**GRAM, dtype=bool)
        seen[code] = True
        used = np.flatnonzero(seen)
        place = np.zeros(SLOTS**GRAM, dtype=np.int64)
        place[used] = np.arange(len(used))
        at = place[code]
        # a block of distinct n-grams at a time: texts in many scripts have very many
        for first in range(0, len(used), GRAMS_AT_ONCE):
            rest = used[first : first + GRAMS_AT_ONCE]
            width = len(rest)
            bound = np.ones((width, self.dimensions), dtype=np.int8)
            for i in reversed(range(GRAM)):
                bound *= self.rotated[i][rest % SLOTS]
                rest = rest // SLOTS
            bound = bound.astype(np.float32)
            here = (at >= first) & (at < first + width) if len(used) > width else slice(None)
            gram, of = at[here] - first, part[here]
            step = max(1, (1 << 20) // width)
            for low in range(0, len(rows), step):
                some = slice(*np.searchsorted(of, (low, low + step)))
                n = min(step, len(rows) - low)
                counts = np.bincount((of[some] - low) * width + gram[some], minlength=n * width).reshape(n, -1)
                np.add.at(vectors, [i for i, _ in rows[low : low + n]], counts.astype(np.float32) @ bound)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # one unit row a language, without the shared part
    shared: np.ndarray  # unit direction common to all prototypes


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, max_rows_per_language: int = 20_000) -> LanguageModel:
    """Learns prototypes from labelled rows.

    The fit reads a bounded sample: of a language with more than
    ``max_rows_per_language`` rows, those whose key hashes below
    bound / count.  Rows with null text or language teach nothing.
    Vectors are summed per task, then by language and dimension, so one
    language with most rows is no hot key.  Without usable rows the model is
    empty and predicts ``und``.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(key if key is not None else F.col(text_col)), F.lit(1 << 30)).alias("u")
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    large = {k: n for k, n in counts.items() if n > max_rows_per_language}
    if large:
        below = F.coalesce(F.create_map(*[F.lit(x) for k, n in large.items() for x in (k, int((1 << 30) * max_rows_per_language / n))])[F.col("lang")], F.lit(1 << 30))
        known = known.where(F.col("u") < below)

    def sums(batches):
        encoder, total = Encoder(), {}
        for batch in small_batches(batches):
            vectors, lettered = encoder.encode(batch.column(1).to_pylist())
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in set(langs[lettered]):
                total[lang] = total.get(lang, 0) + _unit(vectors[lettered & (langs == lang)]).sum(axis=0, dtype=np.float64)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(vector)), pa.array(range(len(vector)), type=pa.int32()), pa.array(np.round(vector * 1e6).astype(np.int64))], names=["lang", "dim", "value"])

    rows = known.select("lang", "text").mapInArrow(sums, "lang string, dim int, value bigint").groupBy("lang", "dim").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).collect()
    rows.sort(key=lambda r: r["lang"])
    if not rows:
        return LanguageModel((), np.zeros((0, DIMENSIONS), np.float32), np.zeros(DIMENSIONS, np.float32))
    matrix = _unit(np.array([[x["value"] for x in r["v"]] for r in rows], dtype=np.float64))
    shared = _unit(matrix.mean(axis=0)) if len(rows) > 1 else np.zeros(DIMENSIONS)
    matrix = _unit(matrix - np.outer(matrix @ shared, shared))
    return LanguageModel(tuple(r["lang"] for r in rows), matrix.astype(np.float32), shared.astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel, carry: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``carry`` columns of each row with ``lang_pred`` and ``score`` (or other ``names``).

    A carried column of either name is left out.
    The score is the cosine with the winning prototype, 0 to 1.  A null text
    or one without a letter is ``und`` with score 0; ties go to the language
    that comes first by name.  Texts may be of any length; repeated rows are
    judged each for itself; an empty table gives an empty one.  Row for row,
    without a shuffle.
    """
    carry = [c for c in carry if c not in names]
    schema = docs.select(*carry).schema
    text = docs.select(*carry, docs[text_col].alias("_text"))

    def apply(batches):
        encoder = Encoder()
        for batch in small_batches(batches):
            vectors, lettered = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
            if model.languages:
                vectors -= np.outer(vectors @ model.shared, model.shared)
                cosine = _unit(vectors) @ model.prototypes.T
                best = cosine.argmax(axis=1)
                score = np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
                found = [model.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
            else:
                score, found = np.zeros(len(lettered)), ["und"] * len(lettered)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, type=pa.string()), pa.array(score, type=pa.float64())], names=[*batch.schema.names[:-1], *names])

    out = schema.add(names[0], "string").add(names[1], "double")
    return text.mapInArrow(apply, out)
