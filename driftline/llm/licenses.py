"""License scan by ordered signature rules.

A text becomes a stream of its words; the keywords that stand in it open their rules (a text with
none is done), and every match of an open rule is a detection: an interval, a label, a priority. A
detection that lies within another of higher priority (or of the same interval and an earlier
family) is suppressed, and so is one within a longer interval of the same form. The labels of the
remaining detections are the method's; the score is the best confidence among them. Beside them
stand the base phrases, counted wherever their words stand consecutively; a text with a base phrase
always has its label.

One pass over the texts, no shuffle, whole texts, in time that grows with a text's length and the
logarithm of its detections. The operator returns the detections with their word intervals; the
query derives its digest from them.

Defined results: a null or empty text has no words, no labels and score 0; very long texts are read
whole; of detections of one interval the one of the higher form stays, then of the earlier family;
repeated rows and null doc_ids stay rows of their own; an empty table gives an empty result; other
columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table
from driftline.llm.license_rules import Rule, rules

BASE = [(b" gnu general public license ", "gpl"), (b" apache license ", "apache"), (b" cc by ", "cc-by"), (b" mit license ", "mit")]
BASE_SCORE = 0.6

_DETECTION = pa.struct([("label", pa.string()), ("form", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("confidence", pa.float64())])
_PLACE = pa.struct([("label", pa.string()), ("word", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(_PLACE)), ("detections", pa.list_(_DETECTION))])
_DDL = "doc_id bigint, n_words bigint, places array<struct<label string, word bigint>>, detections array<struct<label string, form string, first_word bigint, words bigint, confidence double>>"

_TO_SPACE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def stream(text: bytes) -> tuple[bytes, int]:
    """The text's words in lower case, each with a space on both sides, and how many they are."""
    words = text.lower().translate(_TO_SPACE).split()
    return b" " + b" ".join(words) + b" ", len(words)


class Places:
    """Word numbers of a stream's bytes; spaces are looked up only where something was found."""

    def __init__(self, words: bytes):
        self.words, self.spaces = words, None

    def word(self, at: int) -> int:
        """How many spaces stand before a byte: the number of the word behind a space there."""
        if self.spaces is None:
            self.spaces = np.flatnonzero(np.frombuffer(self.words, np.uint8) == 32)
        return int(np.searchsorted(self.spaces, at))


def base_places(words: bytes, places: Places | None = None) -> list[tuple[str, int]]:
    """Label and word number of every place of a base phrase."""
    found, places = [], places or Places(words)
    for phrase, label in BASE:
        at = words.find(phrase)
        while at >= 0:
            found.append((label, places.word(at)))
            at = words.find(phrase, at + 1)
    return found


def suppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """What containment leaves, in order of place. Only detections of one run of overlapping intervals meet."""
    found, out, run, reach = sorted(found, key=lambda x: (x[0], x[1])), [], [], -1
    for x in found:
        if x[0] >= reach:
            out += _one_run(run)
            run = []
        run.append(x)
        reach = max(reach, x[1])
    return out + _one_run(run)


class _Reach:
    """The greatest end among intervals that start at a place or before it; places are ranks (a Fenwick tree of maxima)."""

    def __init__(self, n: int):
        self.best = [-1 << 60] * (n + 1)

    def add(self, place: int, end: int) -> None:
        place += 1
        while place < len(self.best):
            self.best[place] = max(self.best[place], end)
            place += place & -place

    def most(self, place: int) -> int:
        place, found = place + 1, -1 << 60
        while place:
            found = max(found, self.best[place])
            place -= place & -place
        return found


def _one_run(run: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """By falling priority: out goes what lies within one that is kept, and what lies around one that is kept of another form, as a lower form says no more about the same words. Of what is left, each form keeps its longest."""
    if len(run) < 2:
        return run
    rank = {s: i for i, s in enumerate(sorted({x[0] for x in run}))}
    n, forms = len(rank), {x[2].form for x in run}
    over, under = _Reach(n), {f: _Reach(n) for f in forms}  # the latter turned round: starts from the right, ends negated
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in sorted(run, key=lambda x: (x[2].priority, x[0], -x[1])):
        at = rank[start]
        inside = over.most(at) >= end
        around = any(-under[f].most(n - 1 - at) <= end for f in forms if f != rule.form)
        if not inside and not around:
            kept.append((start, end, rule))
            over.add(at, end)
            under[rule.form].add(n - 1 - at, -end)
    out, reach, last = [], dict.fromkeys(forms, -1), dict.fromkeys(forms, (-1, -1))
    for start, end, rule in sorted(kept, key=lambda x: (x[0], -x[1])):
        if reach[rule.form] < end or last[rule.form] == (start, end):
            out.append((start, end, rule))
            reach[rule.form], last[rule.form] = end, (start, end)
    return sorted(out, key=lambda x: (x[0], x[1]))


class Scanner:
    def __init__(self, all_rules: list[Rule]):
        self.by_keyword: dict[bytes, list[Rule]] = defaultdict(list)
        for r in all_rules:
            self.by_keyword[r.keyword].append(r)

    def scan(self, words: bytes) -> list[tuple[int, int, Rule]]:
        found = [(m.start(), m.end(), r) for k, own in self.by_keyword.items() if k in words for r in own for m in r.pattern.finditer(words)]
        return suppressed(found) if found else []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules())
    for batch in batches:
        doc_ids, column = batch.column(0), batch.column(1).cast(pa.binary())
        for at in range(0, batch.num_rows, 1000):
            counts, places, detections = [], [], []
            for text in column.slice(at, 1000).to_pylist():
                words, n = stream(text or b"")
                at_word = Places(words)
                counts.append(n)
                places.append([{"label": a, "word": b} for a, b in base_places(words, at_word)])
                detections.append([
                    {"label": r.label, "form": r.form, "first_word": at_word.word(s) - 1, "words": at_word.word(e) - at_word.word(s) + 1, "confidence": r.confidence}
                    for s, e, r in scanner.scan(words)
                ])
            yield pa.RecordBatch.from_arrays([doc_ids.slice(at, 1000), pa.array(counts, pa.int64()), pa.array(places, pa.list_(_PLACE)), pa.array(detections, pa.list_(_DETECTION))], schema=_SCHEMA)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places of base phrases, detections; one row per row of docs."""
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(_scan, _DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own, base = F.transform("detections", lambda d: d["label"]), F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["word"])
    best = F.array_max(F.concat(F.transform("detections", lambda d: d["confidence"]), F.transform("places", lambda _: F.lit(BASE_SCORE)), F.array(F.lit(0.0))))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), best.alias("score"),
    )
