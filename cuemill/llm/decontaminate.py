"""Benchmark decontamination: latent semantic retrieval, then LCS and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import bounded_batches, distinct, fresh_worker, utf8

#: Words per passage of the factorised matrix, and the grid on which passages start.
PASSAGE, GRID = 32, 8
#: Words in a row that make a quote: half of an item, but at least and at most so many, or all of a short item.
QUOTE = 8, 16
#: Words whose vectors are gathered at a time: some 1 KB each.
GATHERED = 8192
#: Bytes of text whose words are looked up at a time.
LOOKED_UP = 1 << 22
#: Lower-cases A-Z, blanks ASCII punctuation, keeps letters, digits and bytes beyond ASCII.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(TABLE).split()


def term_ids(texts: list[str | None], terms: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term number of every word of the texts (-1: none), and each text's number of words.

    Terms are numbered in their order. Whole stretches of text are cut and looked up at once, as
    ``words_of`` each text would take several times as long.
    """
    known = pa.array(list(terms), pa.large_binary())
    ids, sizes, some, held = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [], 0
    for k, text in enumerate(texts):
        some.append(utf8(text))
        held += len(some[-1])
        if held < LOOKED_UP and k + 1 < len(texts):
            continue
        data = np.frombuffer(b" ".join([*some, b""]).translate(TABLE), np.uint8)  # a blank ends each text
        blank = data == 32
        edges = np.flatnonzero(np.diff(blank, prepend=True))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(data[~blank])])
        ids.append(pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False))
        ends = np.cumsum([len(raw) + 1 for raw in some])
        sizes.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        some, held = [], 0
    return np.concatenate(ids), np.concatenate(sizes)


def row_sums(table: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``np.add.reduceat(table[rows], first)`` over about ``GATHERED`` rows at a time, by whole sums."""
    out, ends = np.empty((len(first), table.shape[1]), table.dtype), np.append(first[1:], len(rows))
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(ends, first[a] + GATHERED, side="right")))
        out[a:b] = np.add.reduceat(table[rows[first[a]:ends[b - 1]]], first[a:b] - first[a], axis=0)
        a = b
    return out


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence, with the table's rows as bits of one integer."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & masks.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def answer_of(text: str | None) -> list[bytes]:
    """What an item asks for or ends with: its last line or sentence that has three words, else all."""
    raw = utf8(text)
    for mark in (b"!", b"?", b"\n"):
        raw = raw.replace(mark, b".")
    for part in reversed(raw.split(b".")):
        if len(words := part.translate(TABLE).split()) >= 3:
            return words
    return raw.translate(TABLE).split()


def quote_length(n: int) -> int:
    return min(n, max(QUOTE[0], min(QUOTE[1], -(-n // 2))))


def window_length(n: int) -> int:
    """Words of the passages that are compared with an item of n words: whole grid steps, or, as
    foreign words would outweigh a short item, its own length."""
    return round(n / GRID) * GRID if n >= 3 * GRID // 2 else n


def window_step(length: int) -> int:
    """Words between the starts of such passages."""
    return GRID if length >= 2 * GRID else max(1, length // 4)


@dataclass
class Index:
    """The items' vectors in the latent space, and all that a worker needs to search a text."""

    terms: dict[bytes, int]
    idf: np.ndarray
    oov: float  # squared weight of a word that no item has
    basis: np.ndarray  # term -> latent vector, weight included
    items: np.ndarray  # unit latent vectors
    item_ids: list
    item_words: list[list[bytes]]
    answers: list[list[bytes]]
    spans: np.ndarray  # passage length of each item, in words
    cosine: float
    lcs: float
    answer: float
    by_span: dict[int, np.ndarray] = field(default_factory=dict)
    quotes: dict[int, dict[bytes, list]] = field(default_factory=dict)  # words in a row -> (item, place) by length

    def __post_init__(self):
        self.by_span = {int(s): np.flatnonzero(self.spans == s) for s in np.unique(self.spans)}
        # The most that one word can add to a passage's product with any item.
        self.most = np.maximum((self.basis @ self.items.T).max(axis=1, initial=0.0), 0.0).astype(np.float64)
        pairs = [np.zeros(0, np.int64)]
        for j, words in enumerate(self.item_words):
            item = np.array([self.terms[w] for w in words], np.int32)
            n = quote_length(len(item))
            pairs.append(item[:-1] * np.int64(len(self.terms)) + item[1:])
            for a in range(len(item) - n + 1):
                self.quotes.setdefault(n, {}).setdefault(item[a:a + n].tobytes(), []).append((j, a))
        self.pairs = distinct(np.concatenate(pairs))

    def search(self, texts: list[str | None]) -> list[tuple]:
        """(text, item id, cosine, lcs share, answer share, first word) of the confirmed passages."""
        ids, sizes = term_ids(texts, self.terms)
        found: dict[tuple, tuple] = {}
        ends = np.cumsum(sizes)
        begins = ends - sizes
        known = ids >= 0
        reach = np.concatenate([[0.0], np.cumsum(np.where(known, self.most[ids], 0.0))])
        rest = np.concatenate([[0], np.cumsum(~known)])
        # Passages start on the grid of each text, the last one at its end minus its length.
        for span, own in self.by_span.items():
            length, step = span, window_step(span)
            last = np.maximum(begins, ends - length)[sizes > 0]
            count = -(-np.maximum(last - begins[sizes > 0], 1) // step)
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts = distinct(np.append(np.repeat(begins[sizes > 0], count) + place * step, last))
            text = np.searchsorted(ends, starts, side="right")
            stops = np.minimum(starts + length, ends[text])
            outside = self.oov * (rest[stops] - rest[starts])
            # No item's product with the passage is above the sum over its words, which bounds the cosine.
            bound = (reach[stops] - reach[starts]) ** 2
            near = np.flatnonzero(bound >= self.cosine ** 2 * (bound + outside) * (1 - 1e-6) + 1e-12)
            for a in range(0, len(near), 2048):
                some = near[a:a + 2048]
                size = (stops - starts)[some]
                at = np.repeat(starts[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                term, row = ids[at], np.repeat(np.arange(len(some)), size)
                in_use = term >= 0
                term, row = term[in_use], row[in_use]
                latent = np.zeros((len(some), self.basis.shape[1]), np.float32)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                if len(first):
                    latent[row[first]] = row_sums(self.basis, term, first)
                norm = np.sqrt((latent ** 2).sum(axis=1) + outside[some]) + 1e-9
                cos = (latent @ self.items[own].T) / norm[:, None]
                for i, j in zip(*np.nonzero(cos >= self.cosine)):
                    self._verify(texts, ids, sizes, ends, int(text[some[i]]), int(starts[some[i]]), int(own[j]),
                                 float(cos[i, j]), found)
        self._quoted(ids, sizes, ends, found)
        return [(t, self.item_ids[j], *rest) for (t, j), rest in found.items()]

    def _verify(self, texts, ids, sizes, ends, t, start, j, cos, found) -> None:
        """Word order and answer decide about a candidate; the best passage of a pair stays."""
        begin, n = int(ends[t] - sizes[t]), len(self.item_words[j])
        span = int(self.spans[j])
        step = window_step(span)
        low, high = max(begin, start - step), min(int(ends[t]), start + span + step)
        # Terms stand for words here: words that no item has cannot match.
        item = [self.terms[w] for w in self.item_words[j]]
        window = ids[low:high].tolist()
        lcs = lcs_length(item, window) / n
        if lcs < self.lcs:
            return
        answer = [self.terms[w] for w in self.answers[j]]
        hit = lcs_length(answer, window) / len(answer)
        if hit < self.answer:
            return
        if (t, j) not in found or lcs > found[t, j][1]:
            found[t, j] = (cos, lcs, hit, low - begin)


    def _quoted(self, ids, sizes, ends, found) -> None:
        """Adds the pairs that have a quote, whatever its cosine and answer; words in a row prove it.

        A quote is a run of words each of which follows the one before in some item, too; few runs
        are long enough to be looked up.
        """
        if not len(ids):
            return
        linked = np.zeros(len(ids) + 1, np.int8)  # from each word to the one behind it
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        if len(self.pairs):
            code = ids[both] * np.int64(len(self.terms)) + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            linked[both[self.pairs[at] == code]] = 1
        linked[ends[sizes > 0] - 1] = 0
        edges = np.diff(linked, prepend=0)
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = last - first + 1 >= min(self.quotes)
        runs = list(zip(first[long].tolist(), (last[long] + 1).tolist()))
        if 1 in self.quotes:
            alone = np.array([np.frombuffer(k, np.int32)[0] for k in self.quotes[1]])
            runs += [(i, i + 1) for i in np.flatnonzero(np.isin(ids, alone)).tolist()]
        best: dict[tuple, tuple] = {}
        seen = set()
        for a, b in runs:
            t = int(np.searchsorted(ends, a, side="right"))
            begin, end = int(ends[t] - sizes[t]), int(ends[t])
            for n, quotes in self.quotes.items():
                for p in range(a, b - n + 1):
                    for j, place in quotes.get(ids[p:p + n].tobytes(), ()):
                        start, size = p - place, len(self.item_words[j])
                        if (t, j) in found or (t, j, start) in seen or best.get((t, j), (0, 0))[1] == 1:
                            continue
                        seen.add((t, j, start))
                        low, high = max(begin, start), min(end, start + size)
                        window = ids[low:high].tolist()
                        lcs = lcs_length([self.terms[w] for w in self.item_words[j]], window) / size
                        if (t, j) not in best or lcs > best[t, j][1]:
                            hit = lcs_length([self.terms[w] for w in self.answers[j]], window) / len(self.answers[j])
                            known = ids[low:high][ids[low:high] >= 0]
                            latent = self.basis[known].sum(axis=0)
                            norm = np.sqrt((latent ** 2).sum() + self.oov * (high - low - len(known))) + 1e-9
                            best[t, j] = (float(latent @ self.items[j] / norm), lcs, hit, low - begin)
        found.update(best)


def document_frequencies(docs: DataFrame, text_col: str, terms: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and passages: summed per task, then by slices of the terms."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        total, passages = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            ids, sizes = term_ids(list(batch["text"]), terms)
            row, n = passage_rows(sizes)
            known = ids >= 0
            pairs = distinct(row[known] * len(terms) + ids[known])
            total += np.bincount(pairs % len(terms), minlength=len(terms))
            passages += n
        if passages:
            yield pd.DataFrame({"slice": np.arange(SLICES), "v": [
                x.astype(np.float64).tobytes() for x in np.array_split(total, SLICES)], "n": passages})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "slice int, v binary, n long")
    sums = summed(rows)
    return np.concatenate([sums[k][0] for k in range(SLICES)]) if sums else np.zeros(len(terms)), (
        sums[0][1] if sums else 0)


#: Parts in which per-term sums travel, so that no task adds up all of them.
SLICES = 16


def summed(rows: DataFrame) -> dict[int, tuple[np.ndarray, int]]:
    """Adds up the vectors of each slice in two steps; the result is as long as the term list."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, np.float64) for v in group["v"])
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "v": [total.tobytes()], "n": [group["n"].sum()]})

    schema = "slice int, v binary, n long"
    parts = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16)))
    parts = parts.groupBy("slice", "salt").applyInPandas(add, schema)
    return {r.slice: (np.frombuffer(bytes(r.v), np.float64), r.n) for r in
            parts.groupBy("slice").applyInPandas(add, schema).collect()}


def passage_rows(sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """Passage number of every word, passages being ``PASSAGE`` words of one text; and their number."""
    counts = -(-sizes // PASSAGE)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    return np.repeat(np.cumsum(counts) - counts, sizes) + place // PASSAGE, int(counts.sum())


def latent_basis(docs: DataFrame, text_col: str, terms: dict[bytes, int], idf: np.ndarray, rank: int,
                 seed: int) -> np.ndarray:
    """Randomised SVD of the TF-IDF passage matrix A over all documents: term -> latent directions.

    Workers add up Y = A'(A G) for a Gaussian G, one pass over the corpus; the Nystroem formula
    turns the pair (G, Y) into the leading eigenvectors of A'A, which are A's right singular
    vectors. Only term x rank numbers reach the driver.
    """
    rank = min(rank, len(terms))
    test = np.random.default_rng(seed).normal(size=(len(terms), rank))
    weighted = (idf[:, None] * test).astype(np.float32)
    used = idf > 0

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        total, seen = np.zeros((len(terms), rank)), 0
        for batch in batches:
            ids, sizes = term_ids(list(batch["text"]), terms)
            row, n = passage_rows(sizes)
            known = np.flatnonzero((ids >= 0) & used[ids])
            seen += n
            for a in range(0, len(known), 1 << 18):
                # Slices begin and end at a passage, unless one is cut: its parts then count apart.
                some = known[a:a + (1 << 18)]
                term, r = ids[some], row[some]
                first = np.flatnonzero(np.diff(r, prepend=-1))
                inner = row_sums(weighted, term, first)
                order = np.argsort(term, kind="stable")
                which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(some))))[order]
                begin = np.flatnonzero(np.diff(term[order], prepend=-1))
                total[term[order][begin]] += row_sums(inner, which, begin)
        if seen:
            total *= idf[:, None]
            yield pd.DataFrame({"slice": np.arange(SLICES), "v": [
                x.tobytes() for x in np.array_split(total, SLICES)], "n": seen})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(sketch, "slice int, v binary, n long")
    sums = summed(rows)
    if not sums:
        return np.zeros((len(terms), 1))
    y = np.concatenate([sums[k][0] for k in range(SLICES)]).reshape(len(terms), rank)
    shift = 1e-7 * max(np.linalg.norm(y), 1e-12)
    core = test.T @ (y + shift * test)
    chol = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * np.trace(np.abs(core)) * np.eye(rank) / rank)
    u, _, _ = np.linalg.svd(np.linalg.solve(chol, (y + shift * test).T).T, full_matrices=False)
    return u


def build_index(docs: DataFrame, items: list[tuple], text_col: str, *, rank: int, cosine: float, lcs: float,
                answer: float, seed: int) -> Index | None:
    """Index of a bounded list of items (id, text); their terms are the columns of the matrix."""
    listed = [(i, w, answer_of(t)) for i, t in items if (w := words_of(t))]
    terms = {w: k for k, w in enumerate(sorted({w for _, words, _ in listed for w in words}))}
    if not terms:
        return None
    df, n = document_frequencies(docs, text_col, terms)
    idf = np.log((n + 1) / (df + 1)) + 0.05
    # The items are passages too: their own vectors complete the corpus's leading directions.
    basis = latent_basis(docs, text_col, terms, idf, rank, seed)
    own = np.zeros((len(listed), len(terms)))
    for r, (_, words, _) in enumerate(listed):
        np.add.at(own[r], [terms[w] for w in words], 1.0)
    own *= idf
    # No direction is cut: an item outside the space would lose even its verbatim passages to the
    # weight of the unknown words around it.
    basis = np.linalg.svd(np.concatenate([basis * np.linalg.norm(own, axis=1).mean(), own.T], axis=1),
                          full_matrices=False)[0]
    placed = own @ basis
    placed /= np.linalg.norm(placed, axis=1, keepdims=True) + 1e-12
    spans = np.array([window_length(len(w)) for _, w, _ in listed])
    return Index(terms, idf, float((np.log(n + 1) + 0.05) ** 2), (idf[:, None] * basis).astype(np.float32),
                 placed.astype(np.float32), [i for i, _, _ in listed], [w for _, w, _ in listed],
                 [a for _, _, a in listed], spans, cosine, lcs, answer)


def _indexes(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, chunk_items: int,
             latent: int, **options) -> Iterator[Index]:
    """One index per chunk of the benchmark: a worker holds at most about ``chunk_items`` items, and
    no more than the ``latent`` directions have room for beside the corpus's own."""
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunk_items = max(1, min(chunk_items, latent - options["rank"]))
    chunks = max(1, -(-items.count() // chunk_items))
    for k in range(chunks):
        part = items.where(F.pmod(F.xxhash64("text", "id"), F.lit(chunks)) == k).collect()
        part = sorted(((r.id, r.text) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
        if index := build_index(docs, part, text_col, **options):
            yield index


#: Latent dimensions: ``rank`` of the corpus, completed by one per item of the chunk, about ``latent`` in all.
OPTIONS = {"chunk_items": 1024, "rank": 32, "latent": 256, "cosine": 0.35, "lcs": 0.6, "answer": 0.5, "seed": 11}


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id",
                      text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """``id, item_id, cosine, lcs, answer, first_word``: every benchmark item found in a document.

    All passages of all texts are compared with all items of about their length: an upper bound on
    the cosine drops passages whose words add too little to any item, the cosine in the latent space
    picks candidates, and the shares of the item's words and of its answer (its last sentence) that
    the passage holds in order confirm them. A quote needs neither: an item of up to 8 words that is
    there word for word, or half of a longer one in a row (8 to 16 words), is always found. Term weights and the space come from all documents.
    Null, empty and wordless texts and items match nothing; repeated rows are found alike; items
    that share an id are searched each and give a row each. No partners are capped.
    """
    schema = f"`{id_col}` string, `{item_col}` string, cosine double, lcs double, answer double, first_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"))
    for index in _indexes(docs, benchmark, item_col, text_col, **{**OPTIONS, **options}):
        def run(batches: Iterator[pd.DataFrame], index: Index = index) -> Iterator[pd.DataFrame]:
            fresh_worker()
            for batch in batches:
                hits = index.search(list(batch["text"]))
                out = pd.DataFrame([h[2:] for h in hits], columns=["cosine", "lcs", "answer", "first_word"])
                out.insert(0, id_col, pd.Series([batch["id"].iloc[int(h[0])] for h in hits], dtype=object))
                out.insert(1, item_col, pd.Series([None if h[1] is None else str(int(h[1])) for h in hits], dtype=object))
                yield out

        found = found.union(rows.mapInPandas(run, schema))
    # Ids travel as text: beside a null, pandas would hold long ones as floats.
    return found.withColumns({c: F.col(f"`{c}`").cast("long") for c in (id_col, item_col)})


def _clean(index: Index):
    """A column function: true where no item of the index is found."""
    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fresh_worker()
        for batch in texts:
            flags = np.ones(len(batch), bool)
            flags[[hit[0] for hit in index.search(list(batch))]] = False
            yield pd.Series(flags)

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text",
                  item_col: str = "item_id", **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found; judged row by row, without a join."""
    kept = docs
    for index in _indexes(docs, benchmark, item_col, text_col, **{**OPTIONS, **options}):
        kept = kept.where(_clean(index)(F.col(text_col)))
    return kept
