"""Conversation trie, licence scan and importance resampling on small hostile tables against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

TURNS = "conv_id bigint, turn bigint, role string, text string, a bigint, depth int"
DOCS = "doc_id bigint, text string, key string, weight int, word string"
BLANK = re.compile("[^\x20\x09-\x0d]+")
TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mark(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def expected_trie(rows):
    """The nodes by their sequences, from the contract's words."""
    given = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            given[c].append(((turn is not None, turn or 0), mark(role, text), (role or "", text or "")))
    turns = {c: [t[2] for t in sorted(v)] for c, v in given.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children = collections.Counter(n[:-1] for n in members if n)
    leaves, saved = collections.Counter(), collections.Counter()
    for n, convs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(convs) - 1) * len(BLANK.findall(n[-1][1])) if n else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (v[0], len(n), members[n[:-1]][0] if n else -1, len(v), children[n], leaves[n], saved[n], digest([c for c in v if len(made[c]) == len(n)])) for n, v in members.items()
    )


def conversations():
    rng = random.Random(5)
    texts = ["", None, "a b  c", "yes", "x " * 5000, "tab\there", "é ü", "yes please do"]
    rows = []
    for c in [*range(0, 130), 200, 219, 221, 399]:  # 221 and 399 have no first conversation of their family
        if c % 17 == 3:
            turns = [("user", "same"), ("bot", "same too"), ("user", "end")]
        elif c == 40:
            turns = [("user", f"long {k % 7}") for k in range(120)]
        else:
            turns = [(rng.choice(["user", "bot", None]), rng.choice(texts)) for _ in range(rng.randint(1, 6))]
        for k, (role, text) in enumerate(turns):
            rows.append((c, None if k == 0 and c % 5 == 0 else k if c % 11 else k // 2, role, text, 7, 1))
        if c % 13 == 0:
            rows.append(rows[-1])
    return [*rows, (None, 1, "user", "nobody's", 7, 1)]


@pytest.mark.parametrize(("limit", "factor", "parts"), [(1 << 15, 1 << 10, 3), (40, 3, 5), (6, 2, 2)])
def test_trie_in_one_and_in_many_bands(spark, limit, factor, parts):
    from pricedex.llm.conversation_trie import prefix_trie

    rows = conversations()
    found = prefix_trie(spark.createDataFrame(rows, TURNS).repartition(parts), limit=limit, factor=factor).collect()
    got = sorted(
        (r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found
    )
    assert got == expected_trie(rows)


def test_trie_of_nothing_and_of_equal_conversations(spark, monkeypatch):
    from pricedex.llm import conversation_trie

    assert conversation_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    monkeypatch.setattr(conversation_trie, "BLOCK", 16)  # ids of one node in many blocks, joined in order
    rows = [(c, k, "user", "hello there", 0, 0) for c in range(0, 3000, 20) for k in range(2)]
    found = {r.depth: r for r in conversation_trie.prefix_trie(spark.createDataFrame(rows, TURNS), limit=20, factor=4).collect()}
    assert [(found[d].n_convs, found[d].saved_tokens) for d in range(3)] == [(150, 596), (150, 596), (150, 298)]
    assert found[2].ends_sha256 == hashlib.sha256(",".join(map(str, range(0, 3000, 20))).encode()).hexdigest()


def test_slots_are_minimal_and_verified():
    from pricedex.llm.conversation_trie import NodeTable

    rng = np.random.default_rng(2)
    a, b = rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(-(1 << 62), 1 << 62, 5000)
    table = NodeTable(a, b)
    assert sorted(table.find(a, b).tolist()) == list(range(5000))
    assert (table.find(a, b + 1) == -1).all() and (table.find(b, a) == -1).all()
    assert NodeTable(a[:0], b[:0]).find(a[:2], b[:2]).tolist() == [-1, -1]
    with pytest.raises(ValueError, match="twice"):
        NodeTable(np.append(a[:9], a[0]), np.append(b[:9], b[0]))


def documents():
    from pricedex.llm.license_scan import TEMPLATES

    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 6))) for _ in range(n))
    texts = [None, "", " \n", "cc by", "CC-BY cc/by cc by", "cc  bye", "All Rights\nReserved. all rights reserved", "general public licenses", "x" * 40_000]
    texts += [f"{prose(30)}\n# {t.text.upper()}, {prose(5)}" for t in TEMPLATES] + [" ".join(t.text.split()[:-3]) for t in TEMPLATES]
    texts += [" ".join(rng.sample(t.text.split(), len(t.text.split()))) for t in TEMPLATES] + [t.phrases[0] for t in TEMPLATES]
    texts += ["license " * 9000 + "released under the MIT license", prose(9000) + " mit license", prose(40), "É cc by é", texts[10], texts[10], "cc\x00by", "0cc by"]
    return [(i if i % 9 else None, t, "k", 1, "w") for i, t in enumerate(texts)]


def expected_scan(rows):
    from pricedex.llm.license_scan import ANCHORS, BASE, TEMPLATES

    words = [TOKEN.findall((t or "").translate(LOW)) for _, t, *_ in rows]
    df = collections.Counter(w for ws in words for w in set(ws))
    out = []
    for (doc_id, *_), ws in zip(rows, words):
        places = [(i, label) for p, label in BASE.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        labels, best = {x for _, x in places}, 0.0
        for t in TEMPLATES:
            tw = t.text.split()
            anchors = sorted(set(tw), key=lambda w: (df[w], w))[:ANCHORS]
            weight = {w: math.floor(1000 * math.log((len(rows) + 1) / (df[w] + 1))) + 1 for w in anchors}
            spots = [(next(i for i in range(len(tw)) if tw[i : i + len(p.split())] == p.split()), p.split()) for p in t.phrases]
            at = lambda i: ws[i] if 0 <= i < len(ws) else ""
            for start in range(-len(tw), len(ws)):
                if all([at(start + q + k) for k in range(len(p))] == p for q, p in spots):
                    got = sum(weight[w] for w in anchors if any(at(start + q) == w for q in range(len(tw)) if tw[q] == w))
                    if 2 * got >= sum(weight.values()):
                        labels, best = labels | {t.label}, max(best, got / sum(weight.values()))
        first = [i for i, _ in places]
        out.append((
            -1 if doc_id is None else doc_id, len(ws), len(places), min(first, default=-1), max(first, default=-1), ",".join(sorted({x for _, x in places})),
            ",".join(sorted(labels)), round(1.0 if places else best, 9)
        ))
    return sorted(out)


def test_license_scan(spark):
    from pricedex.llm.license_scan import scan

    rows = documents()
    found = scan(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    none = lambda v: -1 if v is None else v
    got = sorted((none(r.doc_id), r.n_words, r.n_base, none(r.first_word), none(r.last_word), r.base_labels, r.labels, round(r.score, 9)) for r in found)
    assert got == expected_scan(rows)
    assert {r.labels for r in found} > {"mit", "apache-2.0", "cc-by,cc-by-nc", "gpl"}
    assert scan(spark.createDataFrame([], DOCS)).count() == 0


def test_resampling(spark):
    from pricedex.llm.resampling import TABLE, features, resample

    rng = random.Random(7)
    words = lambda n: " ".join(rng.choice(["Alpha", "beta", "gamma7", "Straße", "x"]) for _ in range(n))
    texts = [None, "", "one", "two words", "a-b_c", "É é   z", "y" * 70_000] + [words(rng.randint(10, 60)) for _ in range(90)]
    texts += [texts[20]] * 8
    rows = [(None if i == 30 else 44 if i in (40, 41) else i, t, "k", 1, "w") for i, t in enumerate(texts)]
    target = [(1, words(30)), (2, None), (3, "gamma7 gamma7 beta")]
    found = resample(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(target, "item_id bigint, text string"), percent=20, least_words=20).collect()

    runs = lambda t: [" ".join(w[i : i + k]) for w in [TOKEN.findall((t or "").translate(LOW))] for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (collections.Counter(bucket(f) for x in side for f in runs(x)) for side in (texts, [x for _, x in target]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    expected = []
    for doc_id, text, *_ in rows:
        weight = sum(gain(bucket(f)) for f in runs(text))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        expected.append((doc_id, len(runs(text)), weight, score, len(TOKEN.findall((text or "").translate(LOW)))))
    eligible = sorted((e for e in expected if e[4] >= 20), key=lambda e: (-e[3], math.inf if e[0] is None else e[0], e[1]))
    drawn = collections.Counter((*e[:4], k + 1) for k, e in enumerate(eligible[: 20 * len(eligible) // 100]))
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in found if r.rank) == drawn
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in found) == collections.Counter(e[:4] for e in expected)
    assert features("Ab c".encode())[1] == [zlib.crc32(x) for x in (b"ab", b"c", b"ab c")] and len(TABLE) == 256
    empty = spark.createDataFrame([], DOCS)
    assert resample(empty, empty.select("text"), 5, 20).count() == 0
