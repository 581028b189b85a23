"""Language identification by a small convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import bounded_batches, utf8

WINDOW, WIDTHS, SYMBOLS = 256, (2, 3, 4), 64
STEP = WINDOW - max(WIDTHS) + 1  # neighbours share what a filter needs, so no n-gram is cut
LETTER = regex.compile(r"\p{L}")


def windows(raw: bytes) -> np.ndarray:
    """All windows of a text, the last padded with zeros."""
    n = max(1, -(-(len(raw) - (WINDOW - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[:len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


@dataclass
class ByteCnn:
    """Bytes, reduced to the most frequent symbols, through an embedding, filters of several widths,
    max pooling over the window and a softmax layer."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol
    embedding: np.ndarray
    filters: list[np.ndarray]  # (width, embedding, filters)
    dense: np.ndarray
    bias: np.ndarray

    @classmethod
    def train(cls, rows: list[tuple[str, bytes]], *, n_filters: int = 16, embedding: int = 8,
              steps: int = 400, batch: int = 192, rate: float = 0.01, seed: int = 1) -> ByteCnn:
        """Adam on softmax loss over windows ``(lang, bytes)``; the same rows give the same model."""
        rng = np.random.default_rng(seed)
        langs = sorted({lang for lang, _ in rows})
        x = np.stack([np.frombuffer(w.ljust(WINDOW, b"\0"), np.uint8) for _, w in rows])
        y = np.array([langs.index(lang) for lang, _ in rows])
        counts = np.bincount(x.ravel(), minlength=256)
        counts[0] = 0
        symbol = np.ones(256, np.uint8)  # 1: rare
        symbol[0] = 0  # padding
        for s, b in enumerate(np.argsort(-counts, kind="stable")[:SYMBOLS - 2]):
            symbol[b] = s + 2
        x = symbol[x]
        model = cls(langs, symbol, rng.normal(size=(SYMBOLS, embedding)) * 0.5,
                    [rng.normal(size=(w, embedding, n_filters)) * 0.4 for w in WIDTHS],
                    rng.normal(size=(len(WIDTHS) * n_filters, len(langs))) * 0.1, np.zeros(len(langs)))
        params = [model.embedding, *model.filters, model.dense, model.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            grads = model._gradients(x[pick], y[pick])
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (1 - 0.9 * t / steps) * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-8)
        return model

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        pooled, places, size = [], [], len(x)
        for f in self.filters:
            n = WINDOW - len(f) + 1
            conv = sum((self.embedding @ f[k])[x[:, k:k + n]] for k in range(len(f)))
            places.append(conv.argmax(axis=1))
            pooled.append(np.maximum(conv.max(axis=1), 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ self.dense + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(size), y] -= 1
        p /= size
        back = (p @ self.dense.T) * (h > 0)
        d_embedding, d_filters, at = np.zeros_like(self.embedding), [], 0
        for f, place in zip(self.filters, places):
            g, d = back[:, at:at + f.shape[2]], np.zeros_like(f)
            at += f.shape[2]
            for k in range(len(f)):
                # Only the pooled position of each filter carries a gradient.
                table = np.zeros((SYMBOLS, f.shape[2]))
                np.add.at(table, (x[np.arange(size)[:, None], place + k], np.arange(f.shape[2])), g)
                d[k] = self.embedding.T @ table
                d_embedding += table @ f[k].T
            d_filters.append(d)
        return [d_embedding, *d_filters, h.T @ p, p.sum(axis=0)]

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Per width the filter responses to symbol pairs (and a last single symbol), by offset."""
        out = []
        for f in self.filters:
            by_symbol = [(self.embedding @ part).astype(np.float32) for part in f]
            listed = [(k, (by_symbol[k][:, None] + by_symbol[k + 1][None]).reshape(-1, f.shape[2]))
                      for k in range(0, len(f) - 1, 2)]
            if len(f) % 2:
                listed.append((-(len(f) - 1), by_symbol[-1]))
            out.append(listed)
        return out

    def probabilities(self, wins: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """(windows, langs)."""
        tables, out = self.tables(), np.zeros((len(wins), len(self.langs)))
        for a in range(0, len(wins), chunk):
            x = np.ascontiguousarray(self.symbol[wins[a:a + chunk]].T)
            pairs = x[:-1].astype(np.int32) * SYMBOLS + x[1:]
            pooled = []
            for f, listed in zip(self.filters, tables):
                best = np.zeros((x.shape[1], f.shape[2]), np.float32)
                for i in range(WINDOW - len(f) + 1):
                    sums = None
                    for k, table in listed:
                        part = table.take(x[i - k] if k < 0 else pairs[i + k], axis=0)
                        sums = part if sums is None else np.add(sums, part, out=sums)
                    np.maximum(best, sums, out=best)
                pooled.append(best)
            z = np.concatenate(pooled, axis=1) @ self.dense + self.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            out[a:a + chunk] = p / p.sum(axis=1, keepdims=True)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Per text the language with the highest mean log probability over all of its windows."""
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        # Windows of many texts at a time, within bounded memory.
        while at and self.langs:
            some, held = [], []
            while at and sum(map(len, held)) < 1 << 14:
                some.append(at.pop())
                held.append(windows(utf8(texts[some[-1]])))
            p = self.probabilities(np.concatenate(held))
            starts = np.cumsum([0] + [len(h) for h in held[:-1]])
            mean = np.add.reduceat(np.log(p + 1e-12), starts) / np.array([len(h) for h in held])[:, None]
            mean = np.exp(mean - mean.max(axis=1, keepdims=True))
            mean /= mean.sum(axis=1, keepdims=True)
            for i, row in zip(some, mean):
                best = int(row.argmax())
                langs[i], scores[i] = self.langs[best], float(row[best])
        return langs, scores


def held_out(id_col: str) -> Column:
    """Documents whose crc32 of the id, as text, leaves 1 by 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str,
                     docs_per_lang: int, windows_per_doc: int) -> list[tuple[str, bytes]]:
    """A bounded sample: of each language about ``docs_per_lang`` documents by hash, and of each up to
    ``windows_per_doc`` windows spread over the whole text."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                      & ~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                                                  F.xxhash64(F.lit(5), id_col).alias("h"))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, docs_per_lang / r["count"]))])
    picked = rows.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, text, h in batch.itertuples(index=False):
                if LETTER.search(text):
                    own = windows(utf8(text))
                    take = np.unique(np.linspace(0, len(own) - 1, windows_per_doc).astype(int))
                    out += [(lang, own[i].tobytes(), h) for i in take]
            yield pd.DataFrame(out, columns=["lang", "w", "h"])

    sample = picked.mapInPandas(cut, "lang string, w binary, h long").collect()
    return [(r.lang, bytes(r.w)) for r in sorted(sample, key=lambda r: (r.lang, r.h, bytes(r.w)))]


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang", docs_per_lang: int = 600, windows_per_doc: int = 8) -> DataFrame:
    """``id, held_out, lang_pred, score`` per document; learns from documents not held out.

    Trained once on a bounded sample (``docs_per_lang`` x ``windows_per_doc`` windows of each
    language) and applied to all windows of every text. ``lang_pred`` is ``und`` with score 0 for
    null texts, texts without a letter, and where nothing could be learned. Every row gives one row.
    """
    model = ByteCnn.train(rows) if (rows := training_windows(
        docs, id_col, text_col, lang_col, docs_per_lang, windows_per_doc)) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            langs, scores = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"id": batch["id"], "held_out": batch["held_out"],
                                "lang_pred": langs, "score": scores})

    # Ids travel as text: beside a null, pandas would hold long ones as floats.
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, "id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_col)
