"""Substring dedup, packing, license scan, words, against brute force and exact round trips."""

from __future__ import annotations

import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cartcast.llm import licenses, ngram_join, packing, substring_dedup
from cartcast.llm.common import ship_package
from cartcast.llm.queries import tokenizer_path
from cartcast.llm.words import ALNUM, FOLD, NOT_SPACE, Block, blocks, find_words, ngram_hash
from helpers import FOLD as FOLD_TABLE
from helpers import ODD, invented, make_docs, vocabulary


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship_package(spark)


TEXTS = [t for _, t in ODD] + ["", "a", " a ", "x\x0by\tz", "é", "  not ascii space"]


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
@pytest.mark.parametrize("table, pattern", [(NOT_SPACE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_equal_the_patterns(table, pattern, size):
    at = 0
    for block in blocks(pa.array(TEXTS), size):
        words = find_words(block, table, FOLD)
        raw = block.data.tobytes()
        got = [[] for _ in range(block.n)]
        for s, e, d in zip(words.start, words.end, words.doc):
            got[d].append(raw[s:e].lower().decode())
        for k in range(block.n):
            assert got[k] == re.findall(pattern, (TEXTS[at + k] or "").translate(FOLD_TABLE))
        at += block.n
    assert at == len(TEXTS)


def test_hashes_tell_words_and_ngrams_apart():
    texts = ["ab ba abab baba a b", "AB ba", "ab ba"]
    (block,) = blocks(pa.array(texts))
    words = find_words(block, NOT_SPACE, FOLD)
    assert len(set(words.hash.tolist())) == 6
    doc, h = ngram_hash(words, 2)
    assert doc.tolist() == [0] * 5 + [1, 2] and h[0] == h[5] == h[6]
    plain = find_words(block, NOT_SPACE)
    assert plain.hash[6] != plain.hash[8]  # case counts without folding


def thue_morse(n, a, b):
    return "".join((a, b)[k.bit_count() & 1] for k in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_on_which_polynomials_cancel_are_told_apart(n):
    (block,) = blocks(pa.array([thue_morse(n, "a", "b") + " " + thue_morse(n, "b", "a") + " " + thue_morse(n, "A", "b")]))
    words = find_words(block, NOT_SPACE, FOLD)
    assert words.hash[0] != words.hash[1] and words.hash[0] == words.hash[2]  # folded alike
    assert len(set(find_words(block, NOT_SPACE).hash.tolist())) == 3


def test_cancelling_words_make_no_link_and_no_span(spark):
    x, y = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    pairs = [(1, " ".join([x] * 30)), (2, " ".join([y] * 30)), (3, " ".join([x] * 30))]
    links = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.jaccard_links(make_docs(spark, pairs)).collect()}
    assert links == {1: (1, 1), 2: (2, 0), 3: (1, 1)}
    pairs = [(1, f"{x} " + " ".join(f"p{k}" for k in range(23))), (2, f"{y} " + " ".join(f"p{k}" for k in range(23)))]
    assert substring_dedup.repeated_spans(make_docs(spark, pairs)).collect() == []


# packing


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("capacity", [2048, 50])
def test_packing_places_every_token(spark, reference_ids, capacity):
    rng = random.Random(1)
    words = vocabulary(rng, 300)
    pairs = ODD + [(100 + k, invented(rng, rng.randint(0, 120), words)) for k in range(80)] + [(900, "<|endoftext|> don't  I'LL")]
    rows = packing.best_fit_packing(make_docs(spark, pairs), tokenizer_path(), capacity).collect()
    ids = {}
    for i, t in pairs:
        ids.setdefault(i, []).append(reference_ids(t))
    seen = {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append(r)
    for i, wanted in ids.items():
        parts = sorted(seen[i], key=lambda r: r.piece)
        for got in (parts[k :: len(wanted)] for k in range(len(wanted))):  # rows repeating an id are alike here
            at = 0
            for k, r in enumerate(got):
                piece = wanted[0][r.start : r.start + r.length]
                assert r.start == at and r.piece == k and len(piece) == r.length
                assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
                assert k == 0 or r.length == capacity
                at += r.length
            assert at == len(wanted[0])
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // capacity) + 2


def test_minimum_bin_slack_fills_better_than_first_fit():
    rng = np.random.default_rng(2)
    lengths = rng.integers(30, 700, 900)
    counts = np.bincount(lengths, minlength=1001)
    slots, n = packing.minimum_bin_slack(counts)
    assert -(-lengths.sum() // 1000) <= n <= -(-lengths.sum() // 1000) + 1
    room = []
    for x in sorted(lengths, reverse=True):
        for k, r in enumerate(room):
            if r >= x:
                room[k] -= x
                break
        else:
            room.append(1000 - x)
    assert n <= len(room)
    assert packing.fullest(10, np.array([0, 0, 0, 1, 2, 0, 0, 1])) in ([(7, 1), (3, 1)],)
    assert packing.minimum_bin_slack(np.zeros(9, int))[1] == 0


def test_rank_encoder_equals_the_tokenizer(reference_ids):
    e = packing.Encoder(tokenizer_path())
    assert e.ranks is not None
    rng = random.Random(4)
    alphabet = [chr(c) for c in (32, 10, 9, 39, 0xA0, 0x3000, 0x1F600, 0xE9, 0x4E2D)] + list("abcXYZ019.,'s")
    for _ in range(300):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert list(np.frombuffer(e(t), "<u4")) + [0] == reference_ids(t)
    other = packing.Encoder(tokenizer_path("word_bpe_49k.json"))
    assert other.ranks is None and other("Some Words") == other.whole("Some Words")


@pytest.mark.parametrize("space", [" ", "\n", "\u3000", " \t"])
def test_very_long_white_space_is_encoded(reference_ids, space):
    e = packing.Encoder(tokenizer_path())
    for n in (99_999, 100_000, 1_200_000):
        text = "some words" + (space * n)[:n] + "x y"
        assert np.frombuffer(e(text), "<u4").tolist() + [0] == reference_ids(text)


def test_packing_of_an_empty_table(spark):
    assert packing.best_fit_packing(make_docs(spark, []), tokenizer_path()).count() == 0


# license scan


def scan_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD_TABLE))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    (201, "Licensed under CC BY-NC 4.0.\nText cc-by and CC  BY cc by cc bye acc by ccby"),
    (202, "the GNU General Public License, version 3 or any later version; all RIGHTS-reserved! general public licenses"),
    (203, "Licensed under the Apache License, Version 2.0. SPDX-License-Identifier: MIT"),
    (204, "écc by all rights reservedé all  rights\nreserved"),
]


def test_license_scan_equals_brute_force(spark):
    rows = licenses.license_scan(make_docs(spark, ODD + LICENSED)).collect()
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in rows)
    assert got == sorted(str((i, *scan_brute(t))) for i, t in ODD + LICENSED)
    labels = {r.doc_id: (r.labels, r.score) for r in rows}
    assert labels[201][0] == "cc-by,cc-by-nc-4.0,license-mention" and labels[202][0] == "gpl,gpl-3.0-or-later,reserved"
    assert labels[203][0].split(",") == ["apache-2.0", "license-mention", "mit"]
    assert labels[3] == ("", 0.0) and all(0 <= s <= 1 for _, s in labels.values())
    text = dict(LICENSED)[202].encode()
    spans = {d.label: text[d.start : d.end] for d in next(r for r in rows if r.doc_id == 202).detections}
    assert spans["gpl-3.0-or-later"] == b"GNU General Public License, version 3 or any later"
    assert licenses.license_scan(make_docs(spark, [])).count() == 0


def test_license_rules():
    assert len(licenses.rules()) > 300
    order = [r.priority for r in licenses.rules()]
    assert order == sorted(order)
    found = licenses.detect(b"licensed under the gnu lesser general public license version 2.1 or later")
    assert {d[2] for d in found} == {"lgpl-2.1-or-later", "license-mention"}  # the gpl rules lie inside


def test_outermost_detections_equal_brute_force():
    rng = random.Random(8)
    for n in (0, 1, 5, 40, 200):
        for _ in range(20):
            found = [(s := rng.randint(0, 60), s + rng.randint(1, 25), rng.choice("abc"), rng.randint(0, 3)) for _ in range(n)]
            want = []
            for d in sorted(set(found), key=lambda d: (d[3], d[0] - d[1], d[0], d[2])):
                if not any(t[0] <= d[0] and d[1] <= t[1] for t in want):
                    want.append(d)
            assert licenses.outermost(found) == want


def test_many_detections_in_one_text():
    """A notice list of a megabyte: time in proportion to the detections, not to their pairs."""
    rng = random.Random(3)
    found = [(s := rng.randint(0, 10_000_000), s + rng.randint(10, 60), "x", rng.randint(0, 3)) for _ in range(100_000)]
    text = b"all rights reserved; licensed under the mit license. " * 20_000
    began = time.process_time()
    assert len(licenses.outermost(found)) > 50_000
    assert len(licenses.detect(text)) >= 20_000
    assert time.process_time() - began < 15


def a_match(rng, parsed):
    """Lower-case bytes that a parsed pattern matches, gaps and options drawn at random."""
    out = b""
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            out += bytes([arg])
        elif op == "IN":
            kind, value = rng.choice(arg)
            chars = [c for c in (range(value[0], value[1] + 1) if str(kind) == "RANGE" else [value]) if not 0x41 <= c <= 0x5A]
            out += bytes([rng.choice(chars)])
        elif op == "MAX_REPEAT":
            low, high, inner = arg
            out += b"".join(a_match(rng, inner) for _ in range(rng.randint(low, min(high, low + 2))))
        elif op == "SUBPATTERN":
            out += a_match(rng, arg[-1])
        elif op == "BRANCH":
            out += a_match(rng, rng.choice(arg[1]))
        else:
            assert op == "ASSERT_NOT", op
    return out


def test_license_keywords_gate_no_match_away(monkeypatch):
    rng = random.Random(12)
    texts = [b"x is in the public\n# domain.", b"permission  is hereby\n * granted, free of charge, to any person obtaining a copy", b"released under"]
    for r in licenses.rules():
        for _ in range(20):
            found = a_match(rng, re._parser.parse(r.pattern.pattern))
            assert r.pattern.search(found) and r.keyword in found
        texts.append(b"a: " + found + b" z")
    gated = [licenses.detect(t) for t in texts]
    assert {d[2] for d in gated[0]} == {"public-domain"} and {d[2] for d in gated[1]} == {"mit"} and gated[2]
    monkeypatch.setattr(licenses, "_by_keyword", lambda: ((b"", licenses.rules()),))
    assert gated == [licenses.detect(t) for t in texts]


# substring dedup


def cuts_brute(data: bytes):
    """Cuts by the definition: every byte's rolling hash from its window alone, the smallest of its surroundings."""
    r, w = substring_dedup.RADIUS, substring_dedup.WINDOW
    h = [sum(int(substring_dedup._GEAR[data[i - age]]) << age for age in range(w) if i >= age) & 0xFFFF for i in range(len(data))]
    return [
        i for i in range(r + w - 1, len(data) - r) if h[i] < min(h[i - r : i]) and h[i] <= min(h[i + 1 : i + r + 1])
    ]


def test_chunks_follow_the_gear_hash():
    rng = random.Random(6)
    texts = ["", "short", "z" * 700] + [invented(rng, rng.randint(1, 200), vocabulary(rng, 90)) for _ in range(12)] + ["été " * 60]
    (block,) = blocks(pa.array(texts))
    doc, at = substring_dedup.cuts(block)
    for k, t in enumerate(texts):
        assert (at[doc == k] - block.offsets[k]).tolist() == cuts_brute(t.encode())
    assert len(substring_dedup.cuts(Block(0, np.zeros(0, np.uint8), np.array([0, 0])))[0]) == 0


def test_chunks_resist_insertions():
    rng = random.Random(7)
    text = invented(rng, 400, vocabulary(rng, 900))
    both = [text, text[:1000] + "INSERTED " + text[1000:]]
    (block,) = blocks(pa.array(both))
    doc, at = substring_dedup.cuts(block)
    one, two = set(at[doc == 0].tolist()), set((at[doc == 1] - block.offsets[1]).tolist())
    reach = substring_dedup.BEFORE + substring_dedup.RADIUS
    assert {c for c in one if c < 1000 - reach} == {c for c in two if c < 1000 - reach}
    assert {c + 9 for c in one if c > 1000 + reach} == {c for c in two if c > 1009 + reach}


def test_windows_hold_few_chunks_that_occur_once():
    rng = random.Random(11)
    (block,) = blocks(pa.array([invented(rng, 3000, vocabulary(rng, 3000)), "a b " * 40]))
    words = find_words(block, NOT_SPACE)
    start, stop = words.start[:-23], words.end[23:]
    _, cut = substring_dedup.cuts(block)
    some = words.counts[0] - 23
    left = substring_dedup.possible(cut, np.zeros(len(cut), bool), start, stop)
    assert left[:some].mean() < 0.1 and left[some + 23 :].all()  # a text without cuts stays possible
    assert substring_dedup.possible(cut, np.ones(len(cut), bool), start, stop).all()


def passages(spark):
    rng = random.Random(9)
    words = vocabulary(rng, 3000)
    passage = invented(rng, 60, words)
    line = invented(rng, 9, words)
    pairs = []
    for k in range(40):
        text = invented(rng, 80, words)
        if k % 4 == 1:
            text += " " + passage + " " + invented(rng, 30 + k, words)
        pairs.append((k, (line + "\n" if k % 3 == 0 else "") + text))
    return pairs, passage


def test_repeated_passages_are_found_and_clean_texts_left(spark):
    pairs, passage = passages(spark)
    rows = substring_dedup.repeated_spans(make_docs(spark, pairs)).collect()
    texts = {i: t.encode() for i, t in pairs}
    having = [i for i, t in pairs if passage in t]
    assert sorted(r.doc_id for r in rows) == having[1:]  # the first stays; short lines do not count
    for r in rows:
        assert r.first_doc_ids == [having[0]]
        assert texts[r.doc_id][r.start : r.end] in texts[having[0]]
        begin = texts[r.doc_id].index(passage.encode())
        covered = min(r.end, begin + len(passage.encode())) - max(r.start, begin)
        assert covered >= 0.5 * len(passage.encode())
    cut = {r.doc_id: r.text for r in substring_dedup.remove_repeats(make_docs(spark, pairs)).collect()}
    spans = {r.doc_id: (r.start, r.end) for r in rows}
    for i, t in pairs:
        s, e = spans.get(i, (0, 0))
        assert cut[i] == (t.encode()[:s] + t.encode()[e:]).decode(errors="ignore")


def test_whole_copies_and_odd_rows(spark):
    pairs, _ = passages(spark)
    copies = [(1000 + k, pairs[0][1]) for k in range(300)]  # one large group of copies
    rows = {r.doc_id: r for r in substring_dedup.repeated_spans(make_docs(spark, [pairs[0], *copies, *ODD])).collect()}
    assert set(rows) == {i for i, _ in copies}
    assert all((r.start, r.end) == (0, len(pairs[0][1].encode())) for r in rows.values())
    odd = make_docs(spark, ODD)
    out = substring_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert substring_dedup.repeated_spans(make_docs(spark, [])).count() == 0


@pytest.mark.parametrize("n_words", [24, 51, 60])
def test_no_repeated_passage_is_lost(spark, n_words):
    rng = random.Random(n_words)
    words = vocabulary(rng, 3000)
    pairs, passages = [], []
    for k in range(400):
        passages.append(invented(rng, n_words, words))
        pairs += [(2 * k + j, f"{invented(rng, rng.randint(1, 60), words)} {passages[k]} {invented(rng, 20, words)}") for j in (0, 1)]
    rows = {r.doc_id: r for r in substring_dedup.repeated_spans(make_docs(spark, pairs)).collect()}
    texts = dict(pairs)
    assert set(rows) == {2 * k + 1 for k in range(400)}
    for k, passage in enumerate(passages):
        r, text = rows[2 * k + 1], texts[2 * k + 1].encode()
        assert passage.encode() in text[r.start : r.end] and text[r.start : r.end].decode() in texts[2 * k]
        assert r.n_words == len(text[r.start : r.end].split()) and r.first_doc_ids == [2 * k] and r.n_chunks > 0


def spans_brute(pairs, n):
    """Spans of the windows of ``n`` words that occur before, not overlapping their first place."""
    first, out = {}, []
    for i, t in sorted((p for p in pairs if p[0] is not None), key=lambda p: p[0]):
        data = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        spans = []
        for k in range(len(at) - n + 1):
            start, stop = at[k][0], at[k + n - 1][1]
            doc, end = first.setdefault(data[start:stop], (i, stop))
            if doc != i or start >= end:
                if not spans or k > spans[-1][2] + n:
                    spans.append([start, stop, k])
                spans[-1][1:] = stop, k
        out += [(i, s, e) for s, e, _ in spans]
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 24])
def test_spans_equal_brute_force(spark, n):
    rng = random.Random(n)
    words = vocabulary(rng, 40)
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(20)]
    pairs = [(k, rng.choice(["\n", "  ", " "]).join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for k in range(150)]
    pairs += [(300 + k, pairs[k % 50][1]) for k in range(60)] + [pairs[3]]  # copies, a row twice
    pairs += [(500, "tie " * 300), (501, "tie " * 300), (502, "===== " * 23), (503, "é 漢字\t" * 40), (504, None), (None, lines[0])]
    rows = substring_dedup.repeated_spans(make_docs(spark, pairs), n).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in rows) == sorted(spans_brute(dict.fromkeys(pairs), n))
    for r in rows:
        assert r.first_doc_ids == sorted(set(r.first_doc_ids)) and max(r.first_doc_ids) <= r.doc_id
