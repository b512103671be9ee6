"""Language identification, word first: known words by per-language log frequency, unknown ones by character n-grams.

A word (run of letters, lower-cased) seen in training scores by its log frequency in each language. An unseen
word backs off to its 5-grams (with marks for its ends); where none of those was seen, to 4-grams, and so on
down to single bytes. A document's log-likelihood is the sum over all words of the whole text.

The model is fitted on the driver from a bounded sample of labelled rows (``most_rows`` a language and
``most_chars`` in all) and keeps at most ``most_words`` words and ``most_grams`` n-grams of each length, the
most frequent ones, so what is broadcast has a fixed bound.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything if no
language was learned. Ties go to the language first in order. Rows with a null language are not learned
from but are predicted. Repeated rows repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import labelled_sample
from .textvec import LETTER, LOWER, slices, utf8, words
from .work import crc_mod, table

LONGEST = 5


def grams(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the byte n-grams of each word between marks 1 and 2, and the word of each."""
    size = lengths + 2
    begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    owner = np.repeat(np.arange(len(starts)), size)
    place = np.arange(int(size.sum())) - begin[owner]
    marked = LOWER[data[np.clip(starts[owner] + place - 1, 0, max(len(data) - 1, 0))]].astype(np.uint64)
    marked[place == 0] = 1
    marked[place == size[owner] - 1] = 2
    if len(marked) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(len(marked) - n + 1, np.uint64)
    for j in range(n):
        code = (code << np.uint64(8)) | marked[j : j + len(code)]
    whole = owner[: len(code)] == owner[n - 1 :]
    return code[whole], owner[: len(code)][whole]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the place of one of each, and for every entry the index of its value."""
    order = np.argsort(h)
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    inverse = np.empty(len(h), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return s[new], order[new], inverse


@dataclass
class Table:
    keys: np.ndarray
    logp: np.ndarray

    @classmethod
    def of(cls, keys: list[np.ndarray], counts: list[np.ndarray], most: int) -> Table:
        every = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        c = np.zeros((len(every), len(keys)))
        for j, (k, n) in enumerate(zip(keys, counts)):
            c[np.searchsorted(every, k), j] += n
        if len(every) > most:
            keep = np.sort(np.argsort(-c.sum(1), kind="stable")[:most])
            every, c = every[keep], c[keep]
        alpha = 0.1
        return cls(every, np.log((c + alpha) / (c.sum(0) + alpha * max(1, len(every)))).astype(np.float32))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and which are really there."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h


class Model:
    def __init__(self, texts: list[str], langs: list[str], most_words: int = 200_000, most_grams: int = 200_000):
        self.langs = sorted(set(langs))
        seen: dict[int, list[list]] = {n: [[], []] for n in range(LONGEST + 1)}
        for lang in self.langs:
            per: dict[int, list] = {n: [] for n in seen}
            mine = [t for t, x in zip(texts, langs) if x == lang]
            for batch in slices(pa.RecordBatch.from_arrays([pa.array(mine, pa.large_string())], names=["t"]), "t", 8 << 20):
                data, offsets = utf8(batch.column(0))
                h, starts, lengths, _ = words(data, offsets, LETTER)
                u, one, inverse = distinct(h)
                n_of = np.bincount(inverse, minlength=len(u))
                per[0].append((u, n_of))
                for n in range(1, LONGEST + 1):
                    code, owner = grams(data, starts[one], lengths[one], n)
                    g, inv = np.unique(code, return_inverse=True)
                    per[n].append((g, np.bincount(inv, weights=n_of[owner], minlength=len(g))))
            for n, parts in per.items():
                k = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
                c = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
                u, inv = np.unique(k, return_inverse=True)
                seen[n][0].append(u)
                seen[n][1].append(np.bincount(inv, weights=c, minlength=len(u)))
        self.tables = {n: Table.of(k, c, most_words if n == 0 else most_grams) for n, (k, c) in seen.items()}

    def word_scores(self, data: np.ndarray, h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per distinct word and language."""
        at, known = self.tables[0].find(h)
        out = self.tables[0].logp[at] if len(self.tables[0].keys) else np.zeros((len(h), len(self.langs)), np.float32)
        todo = np.flatnonzero(~known)
        for n in range(LONGEST, 0, -1):
            if not len(todo):
                break
            code, owner = grams(data, starts[todo], lengths[todo], n)
            at, has = self.tables[n].find(code)
            count = np.bincount(owner[has], minlength=len(todo))
            total = np.stack([np.bincount(owner[has], weights=self.tables[n].logp[at[has], j], minlength=len(todo)) for j in range(len(self.langs))], 1)
            hit = count > 0
            out[todo[hit]] = total[hit] / count[hit, None]
            todo = todo[~hit]
        out[todo] = 0
        return out

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offsets = utf8(col)
        n = len(offsets) - 1
        h, starts, lengths, rows = words(data, offsets, LETTER)
        total, count = np.zeros((n, max(1, len(self.langs)))), np.zeros(n)
        if len(h) and self.langs:
            u, one, inverse = distinct(h)
            w = self.word_scores(data, u, starts[one], lengths[one])
            for j in range(len(self.langs)):
                total[:, j] = np.bincount(rows, weights=w[inverse, j], minlength=n)
            count = np.bincount(rows, minlength=n)
        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        lettered = np.zeros(n, bool)
        lettered[np.searchsorted(offsets, np.flatnonzero(ascii_letter[data]), "right") - 1] = True
        for i in np.flatnonzero((count > 0) & ~lettered):
            lettered[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode())
        lettered &= bool(self.langs)
        # Words of one document are far from independent: confidence is that of at most 50 of them.
        z = total / np.maximum(count, 1)[:, None] * np.minimum(count, 50)[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        best = z.argmax(1)
        score = np.where(lettered, p.max(1) / p.sum(1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered)], score


def learn(docs: DataFrame, learns, most_rows: int = 2000, most_chars: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    docs = docs.where(learns & F.col(text_col).isNotNull())
    texts, langs = labelled_sample(docs, docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("y")), most_rows, most_chars, id_col, text_col)
    return Model(texts, langs)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                lang, score = shared.value.predict(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, crc_mod("doc_id", 4) != 2)
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
