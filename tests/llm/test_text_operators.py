"""Mixing, packing, licenses, token counts, records, fingerprints: against plain Python on a small awkward corpus."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from linelens.llm import licenses, merkle, mix, packing, records, token_counts
from linelens.llm.pieces import Pieces

SIZE = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fair_targets(sizes):
    """Water filling by rounds: weights 5, 2, 1 by source order, at most three times a source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, cut = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in cut)
        share = left / max(1, sum(weight[s] for s in sizes if s not in cut))
        more = {s for s in sizes if s not in cut and weight[s] * share > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in cut else weight[s] * share for s in sizes}
        cut |= more


def test_mix_meets_targets(docs, rows):
    got = mix.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, SIZE(t)) for d, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += SIZE(t)
    want, taken = fair_targets(sizes), Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    again = mix.mix(docs.repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixed_documents_repeat_what_is_taken(docs, no_docs):
    taken = Counter()
    for r in mix.mix(docs).collect():
        taken[r.source] += r.taken
    out = mix.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r.source] += SIZE(r.text)
        assert r["size"] == 7 and r["hash"] == "h"  # extra columns of the same name stay
    assert got == +taken
    assert mix.mixed_documents(no_docs).count() == 0 and mix.mix(no_docs).count() == 0


def plain_best_fit(items, capacity, unit, parts):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = []
        for k, b in enumerate(bins):
            own = b["words"].get(source, 0)
            if b["left"] >= size and (cluster is None or cluster not in b["clusters"]) and not (own > max(0, parts - -(-size // unit)) * unit):
                fits.append((b["left"], k))
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "words": {}, "clusters": set()})
        b = bins[k]
        b["left"] -= size
        b["words"][source] = b["words"].get(source, 0) + size
        b["clusters"].add(cluster)
        out.append(k)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = np.random.default_rng(5)
    for _ in range(60):
        capacity = int(rng.choice([16, 64, 160]))
        n = int(rng.integers(1, 80))
        items = [(int(rng.integers(1, capacity + 1)), int(rng.integers(0, 4)), int(rng.integers(0, 20)) if rng.random() < 0.7 else None) for _ in range(n)]
        items.sort(key=lambda x: -x[0])
        assert packing.best_fit(items, capacity) == plain_best_fit(items, capacity, max(1, capacity // packing.PARTS), packing.SOURCE_PARTS)


def test_packing_keeps_rules(docs, rows, no_docs):
    got = packing.pack_documents(docs, capacity=256, shard_documents=20).collect()
    want = Counter()
    for d, t, _ in rows:
        want[d] += SIZE(t)
    have, bins = Counter(), defaultdict(list)
    for r in got:
        have[r.doc_id] += r.n_words
        assert (r.bin is None) == (r.n_words == 0)
        if r.bin is not None:
            bins[r.shard, r.bin].append(r)
    assert have == want and all(sum(r.n_words for r in b) <= 256 for b in bins.values())
    text = {d: (t or "").lower().split() for d, t, _ in rows if d not in (501, None)}
    for b in bins.values():
        held = [tuple(text[r.doc_id]) for r in b if r.doc_id in text]
        assert len(held) == len(set(held))
    assert packing.pack_documents(no_docs).count() == 0


def test_repeated_rows_are_dealt_over_all_shards(spark):
    rows = [(None, "one text", "s")] * 1000 + [(k, f"text number {k}", f"s{k % 3}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [packing.pack_documents(d, shard_documents=300).collect() for d in (docs, docs.repartition(7))]
    shards, copies = Counter(r.shard for r in runs[0]), Counter(r.shard for r in runs[0] if r.doc_id is None)
    assert set(copies.values()) == {100} and max(shards.values()) <= 450 and sum(shards.values()) == 3000
    assert len({(r.shard, r.bin) for r in runs[0] if r.doc_id is None}) == 1000
    assert Counter(runs[0]) == Counter(runs[1])


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""


def test_license_rules(spark, docs, no_docs):
    texts = [("plain", "Nothing here. Licensed under nothing."), ("line", "Abc.\nReleased under the MIT License.\nMore"), ("spdx", "// SPDX-License-Identifier: Apache-2.0"), ("two", "Licensed under CC BY-NC 4.0. Words.\nAll rights reserved."), ("twice", "Released under the MIT License. x. Released under the MIT License."), ("text", MIT), ("null", None)]
    got = {r.doc_id: (r.sentence_ids, r.licenses) for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    assert got["plain"] == ([], []) and got["null"] == ([], []) and got["line"] == (["mit-notice"], ["MIT"])
    assert got["spdx"] == (["spdx", "name-apache-2"], ["Apache-2.0"]) and got["two"][1] == ["CC-BY-NC-4.0", "Proprietary"]
    assert got["twice"] == (["mit-notice", "mit-notice"], ["MIT"]) and got["text"] == (["mit-title", "mit-grant", "mit-include"], ["MIT"])
    assert licenses.license_scan(no_docs).count() == 0 and licenses.license_scan(docs).count() == docs.count()
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES)
    lengths = [len(ids) for _, ids in licenses.RULES]
    assert lengths == sorted(lengths, reverse=True) and "rdd" not in licenses.license_scan.__code__.co_names


GPL_3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL_2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
FULL_MIT = MIT.replace("\n\nPerm", "\n\nCopyright (c) 2020 Someone\n\nPerm") + """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BSD_3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""


def test_wrapped_and_commented_licenses(spark):
    published = {"GPL-3.0-or-later": GPL_3, "MPL-2.0": MPL_2, "MIT": FULL_MIT, "ISC": ISC, "BSD-3-Clause": BSD_3}
    texts = [((lead + name), start + "\n".join((lead + line).rstrip() for line in text.split("\n")) + end, name) for name, text in published.items() for start, lead, end in (("", "", ""), ("#!/bin/sh\n", "# ", "\nimport os"), ("/*\n", " * ", "\n */\nint x;"), ("", "// ", "\r\n"))]
    texts += [("lines", "no end\nReleased under the MIT License.\nNo end", "MIT"), ("wrap", "Released under the\nMIT License.", "MIT"), ("apart", "Released under the\n\nMIT License.", ""), ("inner", "It was\nreleased under the MIT License.", "")]
    for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id string, text string, want string")).join(spark.createDataFrame(texts, "doc_id string, text string, want string"), "doc_id").collect():
        assert r.licenses == ([r.want] if r.want else []), r
        if r.want == "MIT" and r.doc_id.endswith("MIT"):
            assert r.sentence_ids == ["mit-title", "mit-grant", "mit-include", "mit-warranty", "mit-liability"]


GNU = """This {what} is free software{a} you can redistribute it and/or
modify it under the terms of the GNU {kind}General Public
License as published by the Free Software Foundation{b} either
version {v} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{kind}General Public License for more details."""
GNU_2_ONLY = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation."""
BSD_2 = """Copyright (c) 2019, Someone
All rights reserved.

""" + BSD_3[: BSD_3.index("   * Neither")].rstrip()
BOOST = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
http://www.boost.org/LICENSE_1_0.txt)"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
EPL_2 = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
HEADS = [
    (GNU.format(what="library", kind="Lesser ", a=";", b=";", v="2.1"), "LGPL-2.1-or-later"),
    (GNU.format(what="library", kind="Lesser ", a=":", b=",", v="3"), "LGPL-3.0-or-later"),
    (GNU.format(what="program", kind="Affero ", a=":", b=",", v="3"), "AGPL-3.0-or-later"),
    (GNU.format(what="program", kind="", a=";", b=";", v="2"), "GPL-2.0-or-later"),
    (GNU.format(what="program", kind="", a=";", b=";", v="3"), "GPL-3.0-or-later"),
    (GNU.format(what="program", kind="", a=":", b=",", v="3"), "GPL-3.0-or-later"),
    (GNU_2_ONLY, "GPL-2.0-only"), (BSD_2, "BSD-2-Clause"), (BOOST, "BSL-1.0"), (ZLIB, "Zlib"), (EPL_2, "EPL-2.0")]
TAGS = [
    ("GPL-2.0-or-later", "GPL-2.0-or-later"), ("GPL-2.0-only", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0"), ("GPL-2.0+", "GPL-2.0-or-later"), ("LGPL-2.1-only", "LGPL-2.1-only"),
    ("MIT OR Apache-2.0", "MIT,Apache-2.0"), ("(MIT AND BSD-3-Clause) OR GPL-3.0-or-later", "GPL-3.0-or-later,BSD-3-Clause,MIT"),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only"), ("GPL-2.0-or-later WITH Linux-syscall-note OR MIT", "GPL-2.0-or-later,MIT"),
    ("Unheard-Of-1.0", ""), ("MIT OR Unheard-Of-1.0", "MIT"), ("MIT AND MIT", "MIT")]


def _licenses_of(spark, texts):
    made = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "doc_id string, text string")
    return {int(r.doc_id): (r.sentence_ids, r.licenses) for r in licenses.license_scan(made).collect()}


def test_license_heads(spark):
    texts = [(start + "\n".join((lead + line).rstrip() for line in text.split("\n")) + end, want) for text, want in HEADS for start, lead, end in (("", "", ""), ("#!/bin/sh\n", "# ", "\nimport os"), ("/*\n", " * ", "\n */\nint x;"))]
    got = _licenses_of(spark, [t for t, _ in texts])
    for k, (text, want) in enumerate(texts):
        assert got[k][1] == [want], (text, got[k])


def test_license_tags(spark):
    frames = ("{}", "// {}\nint x;", "<!-- {} -->", "/* {} */")
    texts = [(f.format("SPDX-License-Identifier: " + e), want) for e, want in TAGS for f in frames]
    got = _licenses_of(spark, [t for t, _ in texts])
    for k, (text, want) in enumerate(texts):
        assert sorted(got[k][1]) == sorted(filter(None, want.split(","))), (text, got[k])
    assert got[5 * len(frames)][0] == ["spdx", "name-mit", "spdx", "name-apache-2"]


def test_reserved_counts_only_without_a_license_after_it(spark):
    texts = ["All rights reserved.", "All rights reserved.\nReleased under the MIT License.", "Released under the MIT License.\nAll rights reserved.", "All rights reserved.\nReleased under the MIT License.\nAll rights reserved."]
    assert [got[1] for _, got in sorted(_licenses_of(spark, texts).items())] == [["Proprietary"], ["MIT"], ["MIT", "Proprietary"], ["MIT", "Proprietary"]]


def test_license_twin_on_wrapped_texts(spark, rows):
    """The SQL of the query and the operator agree on heads, tags, wrapped and commented texts, and the awkward corpus."""
    import duckdb
    import pyarrow as pa

    frames = ("", "# ", " * ", "// ", "dnl ")
    texts = [t for t, _ in HEADS] + [GPL_3, MPL_2, FULL_MIT, ISC, BSD_3] + ["SPDX-License-Identifier: " + e for e, _ in TAGS] + ["a\nb\nc\nd\n\ne", "x.\x01Released under the MIT License.\x01", " \n ", ""]
    texts = ["\n".join(lead + line for line in t.split("\n")) for t in texts for lead in frames] + [t for _, t, _ in rows] + [None]
    texts += ["\r\n".join(t.split("\n")) for t in texts if t] + [a + " " + b for a, b in zip(texts[:40], texts[7:47]) if a and b]
    made = [(k, t) for k, t in enumerate(texts)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [k for k, _ in made], "text": pa.array([t for _, t in made], pa.string())}))
    want = {r[0]: r[1:] for r in con.execute(licenses.ORACLE_SQL).fetchall()}
    got = licenses.license_scan(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert len(got) == len(want) == len(made)
    for r in got:
        assert want[r.doc_id] == (len(r.sentence_ids), ",".join(r.sentence_ids), ",".join(r.licenses)), made[r.doc_id]


AWKWARD = ["it's we'LL don't 'S", "a  b\n\n c \t", "''''s __x__ 12½ ٣", "日本語 text ​ é é", "<|endoftext|> x <|startoftext|>", "x" * 500, "\r\n\x0b\x1c\x85 ", "ĳĲ ŉ İı ſ µ ² ª ß ẞ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_the_library(name, rows):
    p = Pieces(public_tokenizers.path(name))
    assert p.pattern is not None
    for text in AWKWARD + [t or "" for _, t, _ in rows]:
        if (cut := p.cut(text)) is not None:
            assert [i for ids in p.encode(cut) for i in ids] == p.whole(text)


def test_token_counts(docs, rows, no_docs, spark):
    t = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    want = Counter((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, _ in rows)
    got = token_counts.token_counts(docs, public_tokenizers.path(token_counts.TOKENIZER)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.token_counts(no_docs, public_tokenizers.path(token_counts.TOKENIZER)).count() == 0
    odd = spark.createDataFrame(list(enumerate(AWKWARD)), "doc_id long, text string")
    for r in token_counts.token_counts(odd, public_tokenizers.path(token_counts.TOKENIZER)).collect():
        assert r.n_tokens == len(t.encode(AWKWARD[r.doc_id], add_special_tokens=False).ids)


def test_pack_round_trip():
    ends, ids, freqs = [0, 0, 3, 3, 5, 5], [9, 2, 70000, 1, 0], [1, 2, 3, 4, 5]
    e, i, f = token_counts.unpack(token_counts.pack(ends, ids, freqs))
    assert list(e) == ends and list(i) == [2, 9, 70000, 0, 1] and list(f) == [2, 1, 3, 5, 4]
    assert [list(x) for x in token_counts.unpack(token_counts.pack([0, 0], [], []))] == [[0, 0], [], []]


def test_records_round_trip(spark, docs, rows, no_docs):
    t = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))
    folder = records.write_records(docs, public_tokenizers.path(records.TOKENIZER))
    got = sorted(records.positions(records.build_index(spark, folder)).collect(), key=lambda r: r.start)
    ordered = sorted(((d is None, d or 0, x or "") for d, x, _ in rows))
    assert [(r.doc_id is None, r.doc_id or 0) for r in got] == [o[:2] for o in ordered]
    at = 0
    for r, (_, _, x) in zip(got, ordered):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    one = got[-1]  # a shuffled reader: seek to one record by the index
    with open(one.file.removeprefix("file:"), "rb") as f:
        f.seek(one.offset)
        (_, payload), = records.frames(f.read(one.length))
    assert len(payload) == 10 + 2 * one.n_tokens
    empty = records.write_records(no_docs, public_tokenizers.path(records.TOKENIZER))
    assert records.positions(records.build_index(spark, empty)).count() == 0


def test_a_batch_asks_once_for_each_word(monkeypatch, rows):
    t = Tokenizer.from_file(public_tokenizers.path(records.TOKENIZER))
    encoder = records._Encoder(public_tokenizers.path(records.TOKENIZER), 2)
    asked = Counter()
    find = encoder._word
    monkeypatch.setattr(encoder, "_word", lambda w: asked.update([w]) or find(w))
    monkeypatch.setattr(records, "REMEMBERED", 20)
    many = ["first " + "again, and again and. " * 50 + "end"] * 40
    assert [x for x in encoder.encode(pa.array(many))] == [np.array(t.encode(many[0]).ids, "<u2").tobytes()] * 40
    assert max(asked.values()) == 1 and set(asked) <= set(many[0].split())
    odd = [*AWKWARD, None, "", " ", "a ", " a", "a  b", "a \n b", "a\n b", "a \nb", "a\nb\tc", "a\r b", "a.. b.) c's 'd 12a é1 _x", "a \xa0 b", "a <|endoftext|> b", "<|endoftext|>", "w" * 100 + " " + "v" * 100 + "!"]
    odd += [x for _, x, _ in rows]
    for _ in range(2):
        for texts in (pa.array(odd).slice(3), pa.array(odd, pa.large_string()), pa.array([], pa.string())):
            want = [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u2").tobytes() for x in texts.to_pylist()]
            assert encoder.encode(texts) == want


def test_damaged_records_are_refused():
    good = records.frame(b"payload\n with a line feed") + b"\n"
    assert [bytes(p) for _, p in records.frames(good * 2)] == [b"payload\n with a line feed"] * 2
    for k in range(len(good)):
        with pytest.raises(ValueError):
            list(records.frames(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :]))
    with pytest.raises(ValueError):
        list(records.frames(good[:-3]))


def test_fingerprints(docs, rows, no_docs):
    got = merkle.fingerprints(docs, buckets=4).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = Counter()
    for k, (d, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        a, b, c = map(merkle.fingerprint, (t, changed, after))
        want[d, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, merkle.likeness(a, b), merkle.likeness(a, c)] += 1
    assert Counter(map(tuple, got)) == want
    assert merkle.fingerprints(no_docs).count() == 0


def test_likeness_and_differences(rows):
    text = rows[0][1]
    a = merkle.fingerprint(text)
    assert merkle.likeness(a, a) == 1 and merkle.fingerprint(text) == a and merkle.likeness(a, merkle.fingerprint("")) == 0
    changed = text[:200] + "EDIT" + text[204:]
    b = merkle.fingerprint(changed)
    assert 0.6 < merkle.likeness(a, b) < 1 and merkle.likeness(a, b) == merkle.likeness(b, a)
    spans = merkle.differing(a, b)
    assert len(spans) == 1 and spans[0][0] <= 200 and spans[0][1] >= 204 and spans[0][1] - spans[0][0] <= 128
    assert merkle.differing(a, a) == []
