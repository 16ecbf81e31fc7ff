from __future__ import annotations

import textwrap

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import licences, tokens

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_families_are_found(documents):
    filler = "Ere thint onwh the and of."
    texts, want = [], {}
    for family, templates in licences.TEMPLATES.items():
        for template in templates:
            want[len(texts)] = family
            texts.append(f"{filler}\n{template}\n{filler}")
    want[len(texts)] = "unknown"
    texts.append("Licensed under whatever licence the moon allows.")
    clean = len(texts)
    texts += [filler, f"{filler}\n{filler}", None, ""]
    found = licences.licences(documents(texts)).collect()
    assert {r.doc_id: r.family for r in found} == want
    assert all(r.paragraph == 1 for r in found if r.doc_id < clean - 1)
    assert all(r.confirmed == (r.family != "unknown") for r in found)
    assert all(0 < r.probability <= 1 for r in found)


def test_disturbed_notices(documents):
    texts = ["x " * 30 + "this work is Licensed under the GNU General Public License, version 3. y z",
             "Released, hereby, under the MIT License!"]
    found = {r.doc_id: r.family for r in licences.licences(documents(texts)).collect()}
    assert found == {0: "GPL-3.0", 1: "MIT"}


def test_sentences_by_name_years_and_asides(documents):
    want = {
        "Copyright 2019 Foo Inc. All rights reserved.": ["unknown"],
        "Copyright (c) 2001 Jane Roe": ["unknown"],
        "SPDX-License-Identifier: MIT": ["MIT"],
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["Apache-2.0", "MIT"],
        "The Unlicense": ["Unlicense"],
        "Dual licensed under the MIT and Apache-2.0 licenses.": ["Apache-2.0", "MIT"],
        "Licensed under MIT/BSD, ISC, zlib at your choice.": ["BSD", "ISC", "MIT", "Zlib"],
        "You do not need a driving license to ride a bicycle here.": [],
        "She asked for permission to leave.": [],
        "The MIT professor lost his fishing licence.": [],
        "The copyright debate in the house went on.": [],
    }
    texts = [f"Ere thint.\n{t}\nEre thint." for t in want]
    got = {i: [] for i in range(len(texts))}
    for r in licences.licences(documents(texts)).collect():
        assert r.paragraph == 1 and r.confirmed == (r.family != "unknown")
        got[r.doc_id].append(r.family)
    assert {texts[i]: sorted(f) for i, f in got.items()} == dict(zip(texts, want.values()))


def test_what_is_learned_does_not_depend_on_the_corpus(documents):
    notice = "Copyright 2019 Foo Inc. All rights reserved."
    many = [f"Copyright {1990 + i % 30} {'abcdefghij'[i % 10] * 4} Inc." for i in range(300)]
    alone = licences.licences(documents([notice])).first()
    among = licences.licences(documents([notice, *many])).where("doc_id = 0").first()
    assert alone == among and alone.family == "unknown"


def test_wrapped_notices(documents):
    filler = "Ere thint onwh the and of."
    texts, want = [], {}
    for family, templates in [*licences.TEMPLATES.items(), ("unknown", licences.UNKNOWN)]:
        for template in templates:
            for width, mark in [(72, ""), (72, " * "), (30, "# "), (1, "")]:
                lines = [mark + x for x in textwrap.wrap(template, width, break_long_words=False)]
                # after a blank line, and right after a line of other text
                for before in ([filler, mark], [filler, filler]):
                    want[len(texts)] = [(2, family)]
                    texts.append("\n".join([*before, *lines, mark, filler]))
    found = licences.licences(documents(texts)).collect()
    got = {i: [] for i in want}
    for r in found:
        got[r.doc_id].append((r.paragraph, r.family))
    assert {i: (texts[i], got[i]) for i in want if got[i] != want[i]} == {}


def test_neighbouring_notices_stay_apart(documents):
    mit, bsd = licences.TEMPLATES["MIT"], licences.TEMPLATES["BSD"]
    wrapped = [textwrap.wrap(t, 40) for t in (mit[2], bsd[1])]
    texts = [f"{mit[0]}\n{bsd[0]}", "\n".join(wrapped[0] + wrapped[1]), "\n".join(wrapped[0] * 2)]
    found = licences.licences(documents(texts)).collect()
    n = len(wrapped[0])
    assert sorted((r.doc_id, r.paragraph, r.family) for r in found) == [
        (0, 0, "MIT"), (0, 1, "BSD"), (1, 0, "MIT"), (1, n, "BSD"), (2, 0, "MIT"), (2, n, "MIT")
    ]


def test_lines_without_a_licence_word(documents):
    filler = "Ere thint onwh the and of."
    want = {
        "Available under GPL-2.0.": ["GPL-2.0"],
        "Released under MIT": ["MIT"],
        "This file is distributed under the terms of Apache-2.0": ["Apache-2.0"],
        "Available under MIT/BSD, ISC at your choice.": ["BSD", "ISC", "MIT"],
        "He studied at MIT in Boston.": [],
        "The report is available to all of the people in the town.": [],
        "Das Haus mit dem Garten.": [],
    }
    texts = [f"{filler}\n{t}\n{filler}" for t in want]
    # a wrapped notice that holds none in the whole text
    bsd = licences.TEMPLATES["BSD"][1]
    tail = textwrap.wrap(bsd[bsd.index("source and binary"):], 30)
    texts.append("\n".join([filler, *tail, filler]))
    assert not any(s in t.lower() for t in texts for s in licences.STEMS)
    got = {i: [] for i in range(len(texts))}
    for r in licences.licences(documents(texts)).collect():
        got[r.doc_id].append(r.family)
        assert r.paragraph == 1 and r.confirmed
    assert {texts[i]: sorted(f) for i, f in got.items()} == dict(zip(texts, [*want.values(), ["BSD"]]))


def test_no_line_is_left_out_that_the_model_doubts(documents):
    """Every line is judged as if the model saw them all."""
    learned = licences.model()
    at = {g: i for i, g in enumerate(learned.grams)}
    rng = np.random.default_rng(5)
    pool = [licences.words(t) for t in [*sum(licences.TEMPLATES.values(), ()), *licences.UNKNOWN, *licences.NEGATIVES]]
    names = {n for ns in licences.NAMES.values() for n in ns}
    texts, want = [], set()
    for d in range(120):
        lines = []
        for k in range(3):
            found = []
            for i in rng.integers(0, len(pool), int(rng.integers(1, 4))):
                start = int(rng.integers(0, len(pool[i])))
                found += [*pool[i][start : start + int(rng.integers(2, 9))], *(["zq"] if rng.random() < 0.5 else [])]
            # what is judged for families by name, or by neighbouring lines, is tested above
            found = [w for w in found if w not in names and w not in licences.GRANT] or ["zq"]
            lines += [" ".join(found), "", ""]
            own = [found[i : i + n] for n in (1, 2, 3) for i in range(len(found) - n + 1)]
            z = learned.weights[-1].astype(float)
            for g in {" ".join(x) for x in own} & at.keys():
                z = z + learned.weights[at[g]]
            p = np.exp((z - z.max()) / learned.temperature)
            p /= p.sum()
            if learned.classes[int(p.argmax())] != "none" or p.max() < licences.SURE:
                want.add((d, 3 * k))
        texts.append("\n".join(lines))
    got = {(r.doc_id, r.paragraph) for r in licences.licences(documents(texts)).collect()}
    assert 10 < len(want) < 350 and got == want


def test_licences_odd_rows(odd, documents):
    assert licences.licences(odd).count() == 0
    assert licences.licences(documents([])).count() == 0


def test_counts_add_up(documents):
    texts = ["one two\n\n\nthree", "", None, "é漢字😀\n\n" * 50, "a\nb\r\n\r\nc", "\n", "x" * 5000]
    ranked = tokens.Ranked(FILE, public_tokenizers.PATTERN)
    found = tokens.token_counts(documents(texts), FILE, public_tokenizers.PATTERN).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.section)
        assert [r.section for r in own] == list(range(len(own)))
        whole = ranked.encoding.encode_ordinary(text or "")
        assert sum(r.n_tokens for r in own) == len(whole) == own[0].doc_tokens
        lines = (text or "").split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or not lines[:-1] else [])
        assert [(text or "")[r.start : r.end] for r in own] == lines


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=30), st.sets(st.integers(1, 100), max_size=10))
def test_allocation_rule(lengths, cuts):
    ends = np.cumsum(np.array(lengths, np.int64)) if lengths else np.zeros(0, np.int64)
    size = int(ends[-1]) if lengths else 0
    starts = np.array([0, *sorted(c for c in cuts if c < size)], np.int64)
    got, crossing = tokens.allocated(ends, starts, size)
    bounds = [*starts.tolist(), size]
    want, wide = [0] * len(starts), [0] * len(starts)
    begin = 0
    for end in ends.tolist():
        shares = [max(0, min(end, bounds[s + 1]) - max(begin, bounds[s])) for s in range(len(starts))]
        best = shares.index(max(shares))
        want[best] += 1
        wide[best] += sum(x > 0 for x in shares) > 1
        begin = end
    assert got.tolist() == want and crossing.tolist() == wide


def test_tokens_odd_rows(odd, documents):
    found = tokens.token_counts(odd, FILE, public_tokenizers.PATTERN)
    assert {r.doc_id for r in found.collect()} == {1, 2, 3, None, 4, 5, 6}
    assert tokens.token_counts(documents([]), FILE, public_tokenizers.PATTERN).count() == 0
