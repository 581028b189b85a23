"""License notices: exact phrases, and near ones found by exact seeds and bounded-error matching."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import bounded_batches, utf8

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
           "mit license": "mit"}
#: Short notices searched with errors: notice, label, edits allowed.
NOTICES = (("gnu general public license", "gpl", 3), ("apache license version", "apache", 3),
           ("released under the mit license", "mit", 3), ("mit license", "mit", 1),
           ("apache license", "apache", 1), ("mozilla public license", "mpl", 2),
           ("creative commons attribution", "cc-by", 3), ("bsd license", "bsd", 1),
           ("all rights reserved", "all-rights-reserved", 2))

#: Lower-cases A-Z and blanks what is not a word byte, so that words are runs between blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(TABLE).split()


class Notice:
    """A notice, its k + 1 seeds (one of which k edits must leave whole) and its pattern."""

    def __init__(self, phrase: str, label: str, edits: int):
        raw = phrase.encode()
        self.label, self.edits, self.size = label, edits, len(raw)
        cuts = [round(i * len(raw) / (edits + 1)) for i in range(edits + 2)]
        self.seeds = [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(rb"(?:" + regex.escape(raw, literal_spaces=True) + rb"){e<=%d}" % edits,
                                     regex.BESTMATCH)

    def find(self, line: bytes) -> list[tuple[int, int, int]]:
        """(start, end, edits) in a line of blank-separated words with blanks at both ends.

        Every run of whole words that begins and ends within the edits of a seed's place is matched
        alone. Of overlapping runs the one with the fewest edits stays, then the first, then the shortest.
        """
        starts = set()
        for at, seed in self.seeds:
            place = line.find(seed)
            while place >= 0:
                starts.add(place - at)
                place = line.find(seed, place + 1)
        k, runs = self.edits, {}
        begins = {a for s in starts for a in range(max(1, s - k), min(len(line) - 1, s + k + 1)) if line[a - 1] == 32}
        for a in begins:
            for b in range(max(a + 1, a + self.size - k), min(len(line) - 1, a + self.size + k) + 1):
                if line[b] == 32:
                    m = self.pattern.fullmatch(line, a, b)
                    if m:
                        runs[a, b] = sum(m.fuzzy_counts)
        taken: list[tuple[int, int, int]] = []
        for (a, b), edits in sorted(runs.items(), key=lambda r: (r[1], r[0])):
            i = bisect(taken, (a, b, edits))
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                taken.insert(i, (a, b, edits))
        return taken


@lru_cache(maxsize=4)
def notices(listed: tuple) -> list[Notice]:
    return [Notice(*n) for n in listed]


def scan(text: str | None, phrases: dict[str, str] = PHRASES, listed: tuple = NOTICES) -> dict:
    """All exact places and near notices of a text; spans are (label, first word, last word, edits)."""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    places: list[tuple[int, str]] = []
    for phrase, label in phrases.items():
        wanted = b" " + phrase.encode() + b" "
        at = line.find(wanted)
        while at >= 0:
            places.append((int(np.searchsorted(blanks, at)), label))
            at = line.find(wanted, at + 1)
    near = []
    for notice in notices(listed):
        # Cheap test first: without any seed there is nothing to verify.
        if any(seed in line for _, seed in notice.seeds):
            near += [(notice.label, int(np.searchsorted(blanks, a)) - 1, int(np.searchsorted(blanks, b)) - 1, e,
                      1 - e / notice.size) for a, b, e in notice.find(line)]
    starts = [p for p, _ in places]
    base = sorted({label for _, label in places})
    return {"n_words": len(words), "n_base": len(places),
            "first_word": min(starts) if starts else None,
            "last_word": max(starts) if starts else None, "base_labels": ",".join(base),
            "labels": ",".join(sorted({*base, *(n[0] for n in near)})),
            "spans": "; ".join(f"{n[0]}@{n[1]}-{n[2]}~{n[3]}" for n in near),
            "score": 1.0 if places else max((n[4] for n in near), default=0.0)}


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 phrases: dict[str, str] = PHRASES, listed: tuple = NOTICES) -> DataFrame:
    """One row per document with its notices.

    Words are runs of ASCII letters, digits and bytes beyond ASCII, lower-cased. ``n_base`` counts
    the exact places of ``phrases``; ``spans`` lists the places within the notices' edits as
    ``label@first-last~edits``, per notice none overlapping another; ``score`` is 1 with an exact place, else the best near match's share
    of right characters, else 0. Null and empty texts have no words, empty labels and score 0.
    Every row, a repeated one too, gives one row; a null id stays null.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([scan(t, phrases, listed) for t in batch["text"]],
                               columns=[*scan(None, phrases, listed)])
            out.insert(0, id_col, batch["id"])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    # Ids travel as text: beside a null, pandas would hold long ones as floats.
    rows = docs.select(docs[id_col].cast("long").cast("string").alias("id"), docs[text_col].alias("text"))
    out = rows.mapInPandas(run, f"`{id_col}` string, n_words long, n_base long, first_word long, "
                            "last_word long, base_labels string, labels string, spans string, score double")
    return out.withColumn(id_col, F.col(f"`{id_col}`").cast("long"))
