import re

from hypothesis import given, settings
from hypothesis import strategies as st

from driftline.llm import licenses as m
from driftline.llm.license_rules import rules


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    places = [(label, i) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["GNU", "general", "Public", "license", "apache", "cc", "by", "CC-BY", "MIT ", "é", "1", "\x7f", "İ", ".", "\n"]), max_size=25), st.sampled_from(["", " ", "-"]))
def test_base(parts, sep):
    text = sep.join(parts)
    words, n = m.stream(text.encode())
    assert (n, sorted(m.base_places(words))) == brute(text)


def test_rules_by_hand():
    own = rules()
    assert len(own) > 500 and all(len(r.keyword) > 1 for r in own)
    scanner = m.Scanner(own)
    labels = lambda t: [(r.label, r.form) for _, _, r in scanner.scan(m.stream(t.encode())[0])]
    assert labels("Licensed under the Apache License, Version 2.0 (the License)") == [("apache-2.0", "grant")]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == [("gpl-3.0", "grant")]
    assert labels("SPDX-License-Identifier: GPL-2.0-or-later") == [("gpl-2.0", "identifier")]
    assert labels("Licensed under CC BY-NC 4.0. The MIT License.") == [("cc-by-nc", "grant"), ("mit", "name")]
    assert labels("a commitment to license fees and the artist") == []


def test_a_keyword_never_hides_a_match():
    """The prefilter against trying every rule."""
    own = rules()
    texts = ["spdx license identifier mpl 2 0", "released under the three clause bsd license", "https creativecommons org licenses by sa 4 0", "dedicated to the public domain", "the european union public licence v 1 2",
             "under the terms of the gnu lesser general public license version 2 1", "neither the name of acme nor the names of its contributors may be used to endorse"]
    for t in texts:
        words, _ = m.stream(t.encode())
        every = m.suppressed([(x.start(), x.end(), r) for r in own for x in r.pattern.finditer(words)])
        assert every and m.Scanner(own).scan(words) == every


def all_pairs(found):
    """Suppression by comparing all pairs, as the docstring says it."""
    kept = []
    for start, end, rule in sorted(found, key=lambda x: (x[2].priority, x[0], -x[1])):
        if not any(s <= start and end <= e or start <= s and e <= end and r.form != rule.form for s, e, r in kept):
            kept.append((start, end, rule))
    longer = lambda y, x: y[2].form == x[2].form and y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0]
    return {x for x in kept if not any(longer(y, x) for y in kept)}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8), st.sampled_from([(f, p * 10 + k) for p, f in enumerate("abc") for k in range(3)])), max_size=30))
def test_suppression_by_all_pairs(parts):
    own = [m.Rule(f"{form}{priority}", form, priority, 0.5, b"x", re.compile(b"x")) for form, priority in {p[2] for p in parts}]
    by = {(r.form, r.priority): r for r in own}
    found = list({(start, start + size, by[kind]) for start, size, kind in parts})
    got = m.suppressed(found)
    assert len(got) == len(set(got)) and set(got) == all_pairs(found)
    assert got == sorted(got, key=lambda x: (x[0], x[1])) or len({x[:2] for x in got}) < len(got)


def test_phrases_are_found():
    """Each phrase that is plain words, in a text of its own."""
    from driftline.llm.license_rules import PHRASES

    scanner = m.Scanner(rules())
    plain = [(label, body) for label, body in PHRASES if not set(body) & set("(|?[\\.{")]
    assert len(plain) > 60 and len(PHRASES) > 100
    for label, body in plain:
        assert any(r.pattern.search(b" " + body.encode() + b" ") for r in rules() if r.label == label), body
        assert scanner.scan(b" some " + body.encode() + b" text "), body


def test_time_grows_with_the_text():
    """A text of nothing but phrases: places and suppression must not look back to its start."""
    import time

    scanner, seconds = m.Scanner(rules()), []
    for n in (5_000, 20_000):
        words, count = m.stream(b"license mit license apache license " * n)
        began = time.process_time()
        places = m.Places(words)
        base, found = m.base_places(words, places), scanner.scan(words)
        seconds.append(time.process_time() - began)
        assert count == 5 * n and len(base) == 2 * n and base[-1][1] < count and len(found) >= n
    assert seconds[1] < 10 * seconds[0] + 0.5


def test_query_digest(spark, stored, awkward, tmp_path):
    rows = awkward + [(50, "MIT License and Apache License, Version 2.0; cc by, cc by", "en", "s")]
    found = {r.doc_id: r for r in m.scan(stored(rows)).collect()}
    assert len(m.scan(stored(rows)).collect()) == len(rows)
    assert found[4].n_words == 0 and found[4].places == [] and found[4].detections == []
    assert [(p.label, p.word) for p in sorted(found[50].places, key=lambda p: p.word)] == [("mit", 0), ("apache", 3), ("cc-by", 8), ("cc-by", 10)]
    stored(rows).write.parquet(f"{tmp_path}/documents.parquet")
    r = {r.doc_id: r for r in m.query(spark, str(tmp_path)).collect()}[50]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 0, 10, "apache,cc-by,mit")
    assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and "apache-2.0" in r.labels and 0 < r.score <= 1
    assert m.scan(stored([])).count() == 0
