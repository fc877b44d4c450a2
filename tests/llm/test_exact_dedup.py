import hashlib
import re
from collections import defaultdict

import pytest

from driftline.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    groups = defaultdict(list)
    for (i, *_), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    keep = {t: min((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    key = lambda x: tuple((v is None, v or 0) for v in x[:3]) + x[3:]
    return sorted(((i, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, *_), t in zip(rows, norm, strict=True)), key=key)


@pytest.mark.parametrize("size", [4, 2048])
def test_against_brute_force(spark, stored, awkward, size):
    found = exact_dedup.exact_duplicates(stored(awkward), block_bytes=size).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x[:3]) + x[3:]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=key) == brute(awkward)
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})  # one row of each group, repeated rows included
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_empty_table(spark, stored):
    assert exact_dedup.exact_duplicates(stored([])).count() == 0


def test_white_space_at_the_ends_counts():
    assert exact_dedup.normalised(b"\n a\t\tb ") == b" a b "
    assert exact_dedup.normalised(b" \n") == b" " and exact_dedup.normalised(b"") == b""
