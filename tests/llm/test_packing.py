import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from driftline.llm import packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def codec():
    return packing.WordCodec(packing.tokenizer_path(), cache_words=500)


def test_words_joined_are_the_text(codec):
    rng, marks = random.Random(4), [*"abAB'.,!İſKÉéñΣσ ß́中文12 \n\t  <|>endoftextstr’", "<|endoftext|>", "'s", "'ll ", "\x1c"]
    for _ in range(3000):
        text = "".join(rng.choice(marks) for _ in range(rng.randint(0, 14)))
        want = codec.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode([text.encode()])[0], "<u4").tolist() == want, text


def test_pieces(spark, stored, awkward, codec):
    rows = awkward + [(100 + i, "word " * (i * 37 % 900), "en", "s") for i in range(120)]
    found = packing.pack(stored(rows), packing.tokenizer_path(), with_ids=True).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    groups = defaultdict(set)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        total = 0
        for r in own:
            assert r.offset == total
            total += r.length
        assert total == own[0].sequence_tokens <= 4096 and total & (total - 1) == 0  # no padding at all
        groups[own[0].step_group].add((own[0].sequence_id, total))
    assert all(sum(t for _, t in g) <= packing.STEP_TOKENS and len({t for _, t in g}) == 1 for g in groups.values())
    want = sorted(len(codec.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert sum(r.length for r in found) == sum(want)
    for i, t, *_ in rows:
        if i is not None and i >= 100:
            own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.start)
            assert [x for r in own for x in r.ids] == [*codec.tokenizer.encode(t, add_special_tokens=False).ids, packing.END_ID]
            assert {r.doc_tokens for r in own} == {sum(r.length for r in own)}


def test_few_documents_are_cut():
    rng, packer = random.Random(1), packing.Packer(packing.TIERS, packing.STEP_TOKENS)
    lengths = [rng.choice([30, 200, 400, 900, 1500, 3000]) + rng.randrange(90) for _ in range(2000)]
    out = []
    for i, n in enumerate(lengths):
        out += packer.add(i, n)
        if i % 500 == 499:
            out += packer.pack(last=False)
    out += packer.pack(last=True)
    assert sum(x[2] for x in out) == sum(lengths)
    assert len(out) - len(lengths) <= packer.sequences
    covered = defaultdict(list)
    for serial, start, length, *_ in out:
        covered[serial].append((start, length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(covered[i]):
            assert start == at
            at += length
        assert at == n


def test_empty_and_wrong_tiers(spark, stored):
    assert packing.pack(stored([]), packing.tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(stored([]), packing.tokenizer_path(), tiers=(100,))
