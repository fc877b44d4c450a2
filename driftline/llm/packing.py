"""Hierarchical multi-length packing of tokenised documents.

Documents go to the tier of the smallest context size that holds them; a longer one fills windows
of the largest size, and its tail goes to its own tier. From the longest piece down, each piece
opens a window of its tier; the gap is filled with the longest pieces of shorter tiers that fit,
and at last with a cut from the shortest piece left, so that every window is exactly full. What is
left at the end of a partition, less than one window, is cut into sequences whose lengths are
descending powers of two. So no sequence needs padding, and a window cuts one document at most
beyond those longer than the largest context. Sequences of one tier are put into step groups of
equal token counts (step_tokens), so that the steps of a training run are balanced.

Each partition of the input is packed by itself, in one pass, with no shuffle. A sequence lies in
one partition, whose number is the upper part of sequence_id: a lost task is simply run again. A
partition is read in blocks of about block_tokens tokens; pieces not yet packed wait for the next
block, so memory stays bounded but for the text of a single document.

Tokens. The tokenizer sees single words: its pre-tokeniser never matches across ASCII white space
and its normaliser works word by word, so ids of a text are the ids of its words joined. Words'
ids are cached, up to cache_words of them in two generations.

Defined results: a null text counts as empty and is one id (the end id); null or repeated doc_ids
and repeated rows are documents of their own; an empty table gives no rows; other columns are left
alone.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import table

TIERS = (256, 512, 1024, 2048, 4096)
END_ID, STEP_TOKENS, BLOCK_TOKENS, CACHE_WORDS = 2, 65_536, 1 << 21, 400_000


#: A word that ends in marks: no token of the pre-tokeniser reaches from a letter or digit into marks other than the apostrophe.
_MARKS_LAST = re.compile(rb"(.*[a-z0-9])([^A-Za-z0-9\x80-\xff']+)", re.S)


class WordCodec:
    """Ids of a text as little-endian unsigned 32-bit integers, by a cache of words.

    A new word that ends in marks is its stem and the marks. Words of letters only are one
    pre-token each, which ends with a token that is marked so (suffix): they are encoded together,
    joined by spaces, and the ids are parted behind these tokens.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, suffix: str = "</w>"):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _learn(self, words: set[bytes]) -> None:
        young, old, marked, new = self.young, self.old, [], set()
        for w in words:
            if w not in young:
                if (ids := old.get(w)) is not None:
                    young[w] = ids
                elif b"<|" not in w and (parts := _MARKS_LAST.fullmatch(w)):
                    marked.append((w, *parts.groups()))
                else:
                    new.add(w)
        for _, *parts in marked:
            for w in parts:
                if w not in young:
                    if (ids := old.get(w)) is not None:
                        young[w] = ids
                    else:
                        new.add(w)
        letters, others = [], []
        for w in new:
            (letters if w.isalpha() or w.decode().isalpha() else others).append(w)
        groups = [letters[i : i + 500] for i in range(0, len(letters), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group):  # a letter whose lower case is no single letter
                others += group
                continue
            data, at = ids.tobytes(), 0
            for w, end in zip(group, (ends * 4).tolist(), strict=True):
                young[w] = data[at:end]
                at = end
        for i in range(0, len(others), 10_000):
            part = others[i : i + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                young[w] = np.array(e.ids, "<u4").tobytes()
        for w, stem, marks in marked:
            young[w] = young[stem] + young[marks]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Lower-casing A-Z here changes no id, as the tokenizer does so too; its special tokens are in lower case, so words with them are left as they are."""
        lists = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        self._learn(set().union(*lists))
        get = self.young.__getitem__
        return [b"".join(map(get, words)) for words in lists]


class Packer:
    """Packs pieces, given in any order, into full windows. A piece is (length, serial, start); serial finds its document."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = tuple(sorted(tiers)), step_tokens
        self.pool: list[tuple[int, int, int]] = []
        self.total = self.sequences = self.groups = 0
        self.open: dict[int, list[int]] = {}  # by length of sequence: its step group and the tokens in it

    def tier(self, length: int) -> int:
        return next(t for t in self.tiers if t >= length)

    def _window(self, size: int, pieces: list[tuple[int, int, int]]) -> Iterator[tuple]:
        group = self.open.get(size)
        if group is None or group[1] + size > self.step_tokens:
            group = self.open[size] = [self.groups, 0]
            self.groups += 1
        group[1] += size
        offset = 0
        for length, serial, start in pieces:
            yield serial, start, length, self.sequences, offset, size, group[0]
            offset += length
        self.sequences += 1

    def add(self, serial: int, length: int) -> Iterator[tuple]:
        start, top = 0, self.tiers[-1]
        while length - start >= top:
            yield from self._window(top, [(top, serial, start)])
            start += top
        if length > start:
            self.pool.append((length - start, serial, start))
            self.total += length - start

    def pack(self, last: bool) -> Iterator[tuple]:
        """Windows from the pool; unless last, a reserve of pieces stays for the next block."""
        pool, reserve = self.pool, 0 if last else 8 * self.tiers[-1]
        pool.sort()
        while pool and self.total >= max(reserve, size := self.tier(pool[-1][0])):
            pieces = [pool.pop()]
            gap = size - pieces[0][0]
            while gap:
                i = bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if i >= 0:
                    piece = pool.pop(i)
                else:
                    length, serial, start = pool.pop(0)
                    piece = (gap, serial, start)
                    insort(pool, (length - gap, serial, start + gap))
                pieces.append(piece)
                gap -= piece[0]
            self.total -= size
            yield from self._window(size, pieces)
        if last:
            rest = self.total
            while rest:
                gap = size = 1 << (rest.bit_length() - 1)
                pieces = []
                while gap:
                    length, serial, start = pool.pop()
                    pieces.append((min(gap, length), serial, start))
                    if length > gap:
                        pool.append((length - gap, serial, start + gap))
                    gap -= pieces[-1][0]
                rest -= size
                yield from self._window(size, pieces)
            self.total = 0


def _schema(with_ids: bool) -> tuple[pa.Schema, str]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"]
    fields = [(n, pa.int64()) for n in names] + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    return pa.schema(fields), ", ".join(f"{n} bigint" for n in names) + (", ids array<int>" if with_ids else "")


def _packed(path: str, tiers, end_id: int, step_tokens: int, block_tokens: int, cache_words: int, with_ids: bool):
    schema, _ = _schema(with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        codec, packer = WordCodec(path, cache_words), Packer(tiers, step_tokens)
        end, held, serial, fresh = np.array([end_id], "<u4").tobytes(), {}, 0, 0

        def rows(windows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for k, start, length, sequence, offset, size, group in windows:
                doc_id, ids, left = held[k]
                part = ids[4 * start : 4 * (start + length)]
                out.append((doc_id, start, length, zlib.crc32(part), len(ids) // 4, base + sequence, offset, size, base + group, *([np.frombuffer(part, "<u4").astype("i4")] if with_ids else [])))
                if left == length:
                    del held[k]
                else:
                    held[k] = (doc_id, ids, left - length)
                if len(out) == 20_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            doc_ids, column = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for at in range(0, len(doc_ids), 256):
                coded = codec.encode([x or b"" for x in column.slice(at, 256).to_pylist()])
                windows = []
                for doc_id, ids in zip(doc_ids[at : at + 256], coded, strict=True):
                    held[serial] = (doc_id, ids + end, len(ids) // 4 + 1)
                    fresh += len(ids) // 4 + 1
                    windows.extend(packer.add(serial, len(ids) // 4 + 1))
                    serial += 1
                yield from rows(iter(windows))
                if fresh >= block_tokens:
                    yield from rows(packer.pack(last=False))
                    fresh = 0
        yield from rows(packer.pack(last=True))

    return run


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = STEP_TOKENS,
         block_tokens: int = BLOCK_TOKENS, cache_words: int = CACHE_WORDS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, step_group, and ids if asked for.

    tokenizer: path of a tokenizers file that the executors have. tiers: powers of two.
    """
    if any(t & (t - 1) or t < 1 for t in tiers) or max(tiers) > step_tokens:
        raise ValueError("tiers must be powers of two of at most step_tokens")
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(_packed(tokenizer, tiers, end_id, step_tokens, block_tokens, cache_words, with_ids), _schema(with_ids)[1])


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
