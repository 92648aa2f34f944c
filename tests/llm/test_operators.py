"""Each operator on small hostile tables against brute force: nulls, empty and long texts, ties, copies, clashing columns, empty tables."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, n int, id string, key string, component_id int, w string"


def prose(rng: random.Random, n: int, letters: str = "etaoinshrdlu") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    texts = [None, "", " \t\n", "one", "one two three", "One two THREE", "é ñ ß", "1234 -- !!", base, base, base.upper()]
    for k in range(12):  # near copies with more and more changes
        changed = list(words)
        for _ in range(k // 2 + 1):
            changed[rng.randrange(len(changed))] = f"new{k}{rng.randrange(99)}"
        texts.append(" ".join(changed))
    texts += [prose(rng, n) for n in (5, 6, 20, 40, 80, 300)]
    texts += [
        "mail a.b@c.de or +1 (377) 555-0271, card 4111 1111 1111 1111 at 10.0.0.1 and 300.1.1.1",
        'token = "0123456789abcdef0123456789abcdef01234567" end', "x" * 50_000 + " tail", "9" * 30_000, "a@" * 4_000, prose(rng, 30_000),
        "<|endoftext|> a  b\r\n\u00a0c 's  ", "same line here\nsame line here\n" * 30
    ]
    return [
        (i, t, None if i % 7 == 0 else ("en", "de")[i % 2], None if i % 5 == 0 else "s", len(t or ""), "x", 1, "y", "k", 2, "z") for i,
        t in enumerate(texts)
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def test_jaccard_components(spark, rows, docs, empty):
    from pricedex.llm.similarity_join import jaccard_components

    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    assert got == {k: (len(s), find(k)) for k, s in sets.items()}
    assert jaccard_components(empty).count() == 0


def _components(texts):
    """Least index reachable by links of similarity 0.75 or more, by comparing all pairs."""
    numbers: dict = {}
    sets = [frozenset(numbers.setdefault(s, len(numbers)) for s in shingles(t)) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = find(a), find(b)
            if x != y and 100 * (both := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def _near_copies(rng, n, words, most):
    for _ in range(n):
        changed = list(words)
        for _ in range(rng.randint(1, most)):
            changed[rng.randrange(len(words))] = f"v{rng.randrange(100_000)}"
        yield " ".join(changed)


@pytest.mark.parametrize(("n", "block"), [(1000, 512), (300, 16)])
def test_large_group_without_a_centre(spark, monkeypatch, n, block):
    """Many near copies of a missing original: links between copies only, in more blocks than one."""
    from pricedex.llm import similarity_join

    monkeypatch.setattr(similarity_join, "BLOCK", block)
    rng = random.Random(n)
    texts = list(_near_copies(rng, n, prose(rng, 80).split(), 3 if n == 1000 else 5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in similarity_join.jaccard_components(docs).collect()}
    assert got == dict(enumerate(_components(texts)))


def test_repeated_ids_are_one_document(spark):
    from pricedex.llm.similarity_join import jaccard_components

    rng = random.Random(9)
    one, two, three = (prose(rng, 30) for _ in range(3))
    rows = [(1, one), (5, one), (5, two), (7, two), (7, two), (8, three), (None, one), (9, None)]
    got = sorted(
        (-1 if r.doc_id is None else r.doc_id, r.component_id) for r in jaccard_components(
            spark.createDataFrame(rows, "doc_id bigint, text string")
        ).collect()
    )
    assert got == [(-1, None), (1, 1), (5, 1), (5, 1), (7, 1), (7, 1), (8, 8), (9, 9)]


def test_tree_loses_no_pair():
    import numpy as np

    from pricedex.llm.similarity_join import POINT_GROUPS, CountVectorTree, fine_groups, overlap, point

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(150, 350), replace=False)) for _ in range(90)]
    sets += [np.unique(rng.integers(0, 1 << 62, 70_000).astype(np.uint64))] * 2  # counts at their type's end
    sizes, component = np.array([len(s) for s in sets]), np.arange(len(sets)) // 2
    component[-1] = -1
    for groups in (POINT_GROUPS, fine_groups(700)):
        tree = CountVectorTree(np.stack([point(s, groups) for s in sets]), sizes)
        runs = tree.pairs(75, lambda x, y: component[x][:, None] != component[y])
        found = {(min(i, j), max(i, j)) for x, y in runs for i, j in zip(x.tolist(), y.tolist())}
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                both = overlap(sets[i], sets[j])
                assert both == len(np.intersect1d(sets[i], sets[j]))
                if component[i] != component[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    assert (i, j) in found


def test_tokens(spark, rows, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pricedex.llm.bpe import encode_decode, prove_whole_tokens, read_spec, sha_digest, token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    expected = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    got = {r.doc_id: r for r in token_counts(docs, path, limit=512).collect()}
    assert {k: r.n_tokens for k, r in got.items()} == {k: len(v) for k, v in expected.items()}
    assert all(r.over_limit == (r.n_tokens > 512) and r.n_bytes == len((rows[k][1] or "").encode()) for k, r in got.items())
    digests = {
        r.doc_id: r for r in encode_decode(docs, path, sha_digest, "n_tokens bigint, ids_sha256 string, decoded_sha256 string").collect()
    }
    for k, ids in expected.items():
        assert digests[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[k].decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = {r.doc_id: r for r in encode_decode(docs, path).collect()}
    assert all(whole[k].ids == v and whole[k].decoded == (rows[k][1] or "") for k, v in expected.items())
    assert token_counts(empty, path, 512).count() == encode_decode(empty, path).count() == 0
    proven = prove_whole_tokens(read_spec(path))
    assert len(proven) > 49_000 and all(tokenizer.encode(p, add_special_tokens=False).ids == [i] for p, i in list(proven.items())[::500])


def test_chunks_are_shared_and_joins_repaired():
    import numpy as np
    import public_tokenizers

    from pricedex.llm.bpe import ChunkEncoder, chunk_bounds, encoder, read_spec

    rng = random.Random(1)
    shared = prose(rng, 3_000)
    enc = encoder(read_spec(public_tokenizers.path("byte_bpe_50k.json")))
    chunks = ChunkEncoder(enc)
    for text in (prose(rng, 50) + shared, prose(rng, 70) + shared, "ab" * 40_000, "é" * 30_000, "a   \n \n  b" * 3_000):
        data = np.frombuffer(text.encode(), np.uint8)
        assert chunks.encode(data) == enc.encode(text)
        cuts = chunk_bounds(data)
        assert cuts[0] == 0 and cuts[-1] == len(data) and sorted(set(cuts)) == cuts
    assert chunks.hits > 5


def test_quality_rules(spark, rows, docs, empty):
    from pricedex.llm.quality_rules import judge

    got = {r.doc_id: r for r in judge(docs).collect()}
    for i, text, *_ in rows:
        w = WORD.findall(text or "")
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count, covered = collections.Counter(windows), set()
        for k, v in enumerate(windows):
            if count[v] > 1:
                covered.update(range(k, k + 8))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)
        ), i
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert judge(empty).count() == 0


def test_robust_outliers_are_found(spark):
    from pricedex.llm.quality_rules import judge

    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(60, 200)).capitalize() + ".", "en", f"s{i % 3}") for i in range(600)]
    rows += [(1000 + i, " | ".join(prose(rng, 80).split()), "en", f"s{i % 3}") for i in range(60)]
    got = judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


def test_rare_sources_are_judged_by_their_language(spark):
    from pricedex.llm.quality_rules import judge

    rng = random.Random(6)
    good = lambda: prose(rng, rng.randint(60, 200)).capitalize() + "."
    junk = lambda: " | ".join(prose(rng, 80).split())
    rows = [(i, good(), "en", "large") for i in range(400)] + [(1000 + i, junk(), "en", "rare") for i in range(5)] + [
        (2000, junk(), "en", "single"), (500, good(), "en", "other")
    ]
    rows += [(600, good(), "de", "few"), (2001, junk(), "de", "few")]
    got = judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert len(got) == len(rows) and all(r.kept == (r.doc_id < 1000) for r in got)


def test_hot_source_with_much_junk(spark):
    from pricedex.llm.quality_rules import judge

    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(60, 200)).capitalize() + ".", "en", "hot") for i in range(360)]
    rows += [(1000 + i, " | ".join(prose(rng, 80).split()), "en", "hot") for i in range(240)]
    got = judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert len(got) == 600 and all(r.kept == (r.doc_id < 1000) for r in got)


def test_pii(spark, rows, docs, empty):
    from pricedex.llm import pii

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"
    }

    def valid(kind, found):
        digits = re.sub("[^0-9]", "", found)
        luhn = sum(
            int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(digits))
        ) % 10 == 0
        return {
            "email": True,
            "ip": all(p.isdigit() and len(p.lstrip("0")) < 4 and int(p) <= 255 for p in found.split(".")) if kind == "ip" else True,
            "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15
        }[kind]

    odd = [
        "a@b.cx_d@e.f", "a.b@c a@b.c.d.", "1.2.3.4.5.6.7.8", "001.002.003.0004", "+1+2 345 678 901",
        "é4111-1111-1111-1111é 12 34 56 78 90 12", "0 0 0 0 0 0 0 0 0 0 0 0"
    ]
    more = spark.createDataFrame([(500 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.digest(docs.select("doc_id", "text").unionByName(more)).collect()}
    for i, text in [(r[0], r[1]) for r in rows if r[0] != 31 or True] + [(500 + i, t) for i, t in enumerate(odd)]:
        if text and len(text) > 20_000 and " " not in text:
            continue  # the plain patterns are quadratic there
        found = sorted(
            (m.start(), k, m.end(), kind) for k,
            (kind, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "") if valid(kind, m.group())
        )
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (i, listed, got[i].spans)
        assert set(listed.split(",")) - {""} <= set(got[i].spans.split(","))
    assert "secret:" in got[30].spans
    assert pii.digest(empty.select("doc_id", "text")).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] is None and clean[29] == "mail [EMAIL] or [PHONE], card [CARD] at [IP] and 300.1.1.1"


def test_decontamination(spark, docs, empty):
    from pricedex.llm.decontamination import leaks

    rng = random.Random(9)
    items = [prose(rng, n) for n in (30, 40, 40, 12, 3, 1)] + [None, "", " "]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, items[0])], "item_id bigint, text string")
    one_changed = items[1].split()
    one_changed[20] = "changed"
    three = items[2].split()
    for k in (8, 20, 32):
        three[k] = "other"
    texts = [
        prose(rng, 50) + " " + items[0].upper() + "\n" + prose(rng, 20), " ".join(one_changed), "start " + " ".join(three), items[3],
        "x " + items[4] + " y", items[5], None, "", " ".join(items[0].split()[:15])
    ]
    halves = items[0].split()
    texts += [
        prose(rng, 9) + " " + " ".join(halves[15:] + halves[:15]) + " end", " ".join(halves[:28]),
        " ".join(halves[:15] + ["new"] * 2 + halves[15:])
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, texts[0])]
    sh = lambda w: collections.Counter(
        tuple(w[i : i + 5]) for i in range(len(w) - 4)
    ) if len(w) >= 5 else collections.Counter([tuple(w)])
    expected = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        for item, u in [*enumerate(items), (90, items[0])]:
            v = WORD.findall((u or "").translate(LOW))
            if not v or not w or len(v) < 5 and len(w) < len(v):
                continue
            b, windows = sh(v), [w[s : s + len(v)] for s in range(max(len(w) - len(v), 0) + 1)]
            similarities = [(100 * sum((sh(x) & b).values()) // sum((sh(x) | b).values()), s) for s, x in enumerate(windows)]
            if max(similarities)[0] >= 75:
                expected[i, item] = max(similarities)
    found = leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), benchmark)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in found.collect()} == expected
    assert {(0, 90), (1, 1), (10, 0)} <= set(expected) and (2, 2) not in expected
    assert leaks(empty, benchmark).count() == 0 and leaks(docs, benchmark.limit(0)).count() == 0


def test_decontamination_of_documents_shorter_than_the_item(spark):
    from pricedex.llm.decontamination import leaks

    item, other = ([f"{c}{i}" for i in range(50)] for c in "ab")
    texts = [item[:48], item[2:], item[:20] + ["new"] + item[21:49], item[:30], item[:4], other[:45], item[:48]]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, " ".join(item[:49]))], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in leaks(docs, benchmark).collect()}
    expected = {
        (0, 1): (0, 48, 95), (0, 3): (0, 48, 97), (1, 1): (0, 48, 95), (1, 3): (0, 48, 93), (2, 1): (0, 49, 78), (2, 3): (0, 49, 80),
        (5, 2): (0, 45, 89)
    }
    assert got == expected | {(6, 1): expected[0, 1], (6, 3): expected[0, 3]}


def test_decontamination_tries_windows_between_aligned_ones(spark):
    from pricedex.llm.decontamination import leaks

    item = [f"a{i}" for i in range(100)]
    passage = item[4:50] + [f"new{i}" for i in range(8)] + item[50:96]
    filler = [f"f{i}" for i in range(60)]
    texts = [filler + passage + filler, passage + filler, filler + passage, filler + item[:40] + filler]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = leaks(docs, spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert {(r.doc_id, r.start, r.n_words, r.similarity) for r in found.collect()} == {(0, 60, 100, 77), (1, 0, 100, 77), (2, 60, 100, 77)}


def test_url_filter(spark):
    from pricedex.llm.url_filter import Rule, judge

    rules = [
        Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
        Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")
    ]
    urls = [
        None, "", "no scheme", "http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://badexample.org/en/12",
        "https://example.org/en/2", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/9#z", "ftp://org", "a://b://c/d",
        "http://é.com/de/ü", "http://h?/fr/"
    ] + [f"https://good{i}.org/en/{i}" for i in range(60)] + [f"https://spam{i}.com/de/{i}" for i in range(60)] + ["https://good9.net/en/7", "https://spam9.net/de/7"]
    pages = spark.createDataFrame([(i, u, "h", "s") for i, u in enumerate(urls)], "page_id bigint, url string, html string, scored string")
    got = {r.page_id: r for r in judge(pages, rules).collect()}
    assert len(got) == len(urls)
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(14)] == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"),
        ("example.org", "/en/12", "example.org/en/1"), ("badexample.org", "/en/12", "org/"), ("example.org", "/en/2", "org/"),
        ("x.com", "/fr/", "com/fr/"), ("x.com", "/fr", None), ("x.com", "/de/9", "com/de/"), ("org", "", None), ("b:", "//c/d", None),
        ("é.com", "/de/ü", "com/de/"), ("h", "", None)
    ]
    assert got[len(urls) - 2].verdict == "allow" and got[len(urls) - 1].verdict == "block"
    assert judge(pages.limit(0), rules).count() == 0


def test_classifiers(spark, docs, empty):
    from pricedex.llm.language_id import identify
    from pricedex.llm.quality_mil import score_quality
    from pricedex.llm.sampling import crc_part
    from pricedex.llm.toxicity import score_toxicity

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        good, toxic = i % 3 > 0, i % 4 == 0
        text = prose(rng, rng.randint(30, 90), "etaoin" if i % 2 else "üöäkrz")
        words = text.split()
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vermin", "v3rmin", "scumbag", "v.e.r.m.i.n", "vermiiiin"])
        rows.append((i, " ".join(words) if good else " ".join(w + " " + w for w in words) + " |", ("en", "de")[i % 2 == 0]))
        labels.append((i, int(good), int(toxic)))
    made = spark.createDataFrame(
        [*rows, (900, None, "en"), (901, "", None), (902, "12 34", "de")], "doc_id bigint, text string, lang string"
    )
    marks = spark.createDataFrame([*labels, (7777, 1, 1), (8, None, None)], "doc_id bigint, quality int, toxic int")
    learn = crc_part("doc_id", 3) != 1
    lang = {r.doc_id: r for r in identify(made, learn).collect()}
    assert [(lang[k].lang_pred, lang[k].score) for k in (900, 901, 902)] == [("und", 0.0)] * 3
    assert sum(lang[i].lang_pred == lg for i, _, lg in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in lang.values())
    quality = {r.doc_id: r.score for r in score_quality(made, marks, learn).collect()}
    assert len(quality) == 243 and sum((quality[i] >= 0.5) == bool(q) for i, q, _ in labels) >= 0.95 * len(labels)
    toxic = {r.doc_id: r.score for r in score_toxicity(made, marks, crc_part("doc_id", 4) != 2).collect()}
    assert len(toxic) == 243 and sum((toxic[i] >= 0.3) == bool(t) for i, _, t in labels) >= 0.95 * len(labels)
    for data, mark in ((empty, marks), (made, marks.limit(0)), (docs, marks)):
        assert identify(data, learn).count() == score_quality(data, mark, learn).count() == score_toxicity(data, mark, learn).count() == data.count()


def test_restoration():
    import numpy as np

    from pricedex.llm import toxicity

    counts = np.zeros((28, 28, 28), np.int64)
    for word in ["vermin", "scumbag", "loser", "trash"] * 50 + ["letter", "tree", "seen"] * 20:
        code = [27, 27, *(ord(c) - 97 for c in word), 27]
        for a, b, c in zip(code, code[1:], code[2:]):
            counts[a, b, c] += 1
    restore = toxicity.Restorer(toxicity.language_model(counts))
    for shown, word in {
        "v3rm1n": b"vermin", "l.o.s.e.r": b"loser", "t r a s h": b"trash", "$cumb@g": b"scumbag", "tttrrraaash": b"trash"
    }.items():
        assert restore(shown.encode()) == word


def test_suspects_hold_all_matches():
    import numpy as np

    from pricedex.llm import toxicity
    from pricedex.llm.textkernel import words

    long = b"s" + b"o" * 60 + b"1"
    shown = {
        b"you s t u p 1 d man": [b"s t u p 1 d"], b"f * c k": [b"f * c k"], b"such 1 d 1 0 t s": [b"1 d 1 0 t s"],
        b"an " + long + b" end": [long], b"1 2 3 4": [], b"hey! you": []
    }
    rng = random.Random(8)
    texts = [*shown, *("".join(rng.choice("abss1$*. .-!(\n") for _ in range(60)).encode() for _ in range(400)), b"*" * 3000 + b"ab"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    begin, end, runs = toxicity._suspects(data, *words(data, offsets))
    raw = data.tobytes()
    for k, text in enumerate(texts):
        assert [
            m for r in range(runs[k], runs[k + 1]) for m in toxicity.found(raw[begin[r] : end[r]])
        ] == toxicity.found(text) == shown.get(text, toxicity.found(text)), text


def test_pipeline_stages_keep_columns(spark, tmp_path, docs):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    given = docs.select(columns)
    spark.createDataFrame(
        [(0, "nothing of this kind is in the documents at all")], "item_id bigint, text string"
    ).write.parquet(f"{tmp_path}/benchmark.parquet")
    given.write.parquet(f"{tmp_path}/documents.parquet")
    frame = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns, name
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < result.count() < given.count()
    assert result.select(F.countDistinct("doc_id")).first()[0] == result.count()


def test_samples_are_bounded_and_even(spark):
    from pricedex.llm.sampling import sampled_texts, stratified

    rows = [(i % 900, f"l{i % 3}") for i in range(3000)] + [(None, "l0"), (5, None)]
    labelled = spark.createDataFrame(rows, "doc_id bigint, label string")
    chosen = stratified(labelled, "label", 100, 240)
    counts = {r.label: r["count"] for r in chosen.groupBy("label").count().collect()}
    assert counts == {"l0": 80, "l1": 80, "l2": 80} and chosen.distinct().count() == 240
    hashes = {r.doc_id: r.h for r in labelled.where("label = 'l1'").select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect()}
    assert {
        r.doc_id for r in stratified(labelled, "label", 100, 300).where("label = 'l1'").collect()
    } == set(sorted(hashes, key=hashes.get)[:100])
    texts = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (3, "c")], "id bigint, text string")
    got = sampled_texts(texts, spark.createDataFrame([(1, 1), (2, 0)], "id bigint, label int"), "label")
    assert sorted((r.id, r.label, r.text or "") for r in got.collect()) == [(1, 1, "a"), (2, 0, "")]


def test_reliabilities_agree_with_likelihood():
    """Expectation-maximisation reaches a point where the penalised likelihood, computed plainly, is higher than at its neighbours'."""
    import math

    from pricedex.llm.pii import reliabilities, train

    patterns = {"yy-": 40.0, "yn-": 6.0, "nn-": 50.0, "ny-": 5.0, "-y-": 9.0, "y--": 4.0}
    posterior, table = reliabilities(patterns)
    prior = {"y": (4.0, 1.0), "n": (1.0, 4.0), "-": (2.5, 2.5)}

    def objective(share, t):
        total = sum(
            n * math.log(
                share * math.prod(t[k][v[k]][0] for k in range(3)) + (1 - share) * math.prod(t[k][v[k]][1] for k in range(3))
            ) for v,
            n in patterns.items()
        )
        return total + sum(prior[a][c] * math.log(t[k][a][c]) for k in range(3) for a in "yn-" for c in (0, 1))

    share = sum(n * posterior[v] for v, n in patterns.items()) / sum(patterns.values())
    best = objective(share, table)
    for k in range(2):
        for c in (0, 1):
            for move in (-0.02, 0.02):
                moved = [dict(t) for t in table]
                y, n = list(moved[k]["y"]), list(moved[k]["n"])
                y[c], n[c] = y[c] + move, n[c] - move
                moved[k] |= {"y": tuple(y), "n": tuple(n)}
                assert objective(share, moved) < best
    assert posterior["yy-"] > 0.9 > 0.1 > posterior["nn-"]
    model = train([(v, f, n) for v, n in patterns.items() for f in (None, "kind=a" if v[0] == "y" else "kind=b")])
    assert model.weights["kind=a"] > 0 > model.weights["kind=b"]


def test_robust_estimate_agrees_with_all_subsets(spark):
    """The outliers are those of the exact minimum covariance determinant over all halves of the rows."""
    from itertools import combinations

    import numpy as np

    from pricedex.llm.quality_rules import VECTOR, outlier_scores

    rng = np.random.default_rng(8)
    floors = np.array([f * f for f in VECTOR.values()])
    x = rng.normal(0, 1, (14, len(VECTOR))) * np.sqrt(floors) * 2
    x[:3] += 40 * np.sqrt(floors)
    best = min(combinations(range(14), 7), key=lambda s: np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) + np.diag(floors))[1])
    core = x[list(best)]
    off = x - core.mean(axis=0)
    exact = np.einsum("ij,jk,ik->i", off, np.linalg.inv(np.cov(core.T, bias=True) + np.diag(floors)), off)
    rows = spark.createDataFrame(
        [(i, "g", True, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, grp string, own boolean, v array<double>"
    )
    far = {r.id: r.far for r in outlier_scores(rows).collect()}
    assert set(np.argsort(exact)[-3:].tolist()) == set(sorted(far, key=far.get)[-3:]) == {0, 1, 2}
    assert min(far[i] for i in range(3)) > 20 * max(far[i] for i in range(3, 14))


def test_spelled_out_addresses_of_any_length(spark):
    from pricedex.llm import pii

    texts = [
        (1, f"write to {'a' * 90}.b [at] {'c' * 70} [dot] org now"), (2, "call joe [at] gmail.com"), (3, "x" * 30_000 + " [at] y"),
        (4, "ab" * 20_000)
    ]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = {
        r.doc_id: [c.found for c in r.c] for r in frame.select(
            "doc_id", pii.candidates(F.col("text"), pii.base_spans(F.col("text"))).alias("c")
        ).collect()
    }
    assert found[1] == [f"{'a' * 90}.b [at] {'c' * 70} [dot] org"] and found[2] == ["joe [at] gmail.com"] and found[3] == []


def test_pipeline_on_small_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda: prose(rng, rng.randint(60, 200)).capitalize() + "."
    item = prose(rng, 30)
    good = [(i, text()) for i in range(30)]
    leaky = prose(rng, 40) + " " + item + " " + prose(rng, 40)
    others = [(100, good[3][1]), (101, good[3][1].upper()), (102, "too short"), (103, None), (104, leaky), (105, ""), (None, text()), (None, None), (106, good[5][1] + " mail joe@example.org"), (30, text()), (30, text())]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, None if i == 7 else "en", None if i == 8 else "s", len(t or "")) for i, t in good + others]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sf/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/sf").collect()
    assert sorted(r.doc_id for r in found if r.doc_id is not None) == [*range(30), 30, 30]
    assert sum(r.doc_id is None for r in found) == 1 and all(r.n_tokens >= 0 for r in found)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_components_take_no_round_when_links_are_stars(spark, monkeypatch):
    from pricedex.llm import shared

    tables = []
    kept = shared.stored
    monkeypatch.setattr(shared, "stored", lambda df: tables.append(1) or kept(df))
    find = lambda links: sorted(tuple(r) for r in shared.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert find([(1, 5), (7, 1), (1, 7), (3, 4), (9, 9), (None, 2)]) == [(1, 1), (3, 3), (4, 3), (5, 1), (7, 1)]
    assert len(tables) == 1
    assert find([]) == []
    assert len(tables) == 2
    chain = [(k, k + 1) for k in range(20)] + [(30, 31), (32, 31), (33, 32)]
    assert find(chain) == [(k, 0) for k in range(21)] + [(k, 30) for k in range(30, 34)]


def test_pipeline_numbers_files_once_for_all_readers(spark, tmp_path):
    import corpus_pipeline

    for k in range(3):
        spark.range(k * 10, k * 10 + 5).write.mode("append").parquet(f"{tmp_path}/t")
    rows = corpus_pipeline.by_row(spark.read.parquet(f"{tmp_path}/t"))
    assert "Window" not in rows._jdf.queryExecution().toString()
    assert rows.select(corpus_pipeline.ROW).distinct().count() == 15


def test_pipeline_steps_take_few_jobs(spark, docs, tmp_path):
    """The driver's memory grows with jobs, broadcasts and plans; rows are counted while they are written."""
    from pricedex.llm import decontamination, similarity_join

    items = spark.createDataFrame([(1, prose(random.Random(3), 40)), (2, None)], "item_id bigint, text string")
    leaky = docs.withColumn("text", F.concat_ws(" ", "text", F.lit(items.first().text)))

    def jobs(group: str, found) -> int:
        spark.sparkContext.setJobGroup(group, group)
        try:
            found().write.parquet(f"{tmp_path}/{group}")
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    taken = {
        "leaks": jobs("leaks", lambda: decontamination.leaks(leaky, items)),
        "links": jobs("links", lambda: similarity_join.jaccard_components(docs))
    }
    assert all(taken[k] <= most for k, most in {"leaks": 32, "links": 75}.items()), taken


def test_simhash_of_an_array_is_the_majority_of_bits(spark):
    from pricedex.llm import decontamination

    frame = spark.createDataFrame([([5, -9, 5, 7],), ([3],), ([1, 2],)], "hs array<bigint>")
    rows = frame.select("hs", decontamination._simhash(F.col("hs")).alias("f"), F.transform("hs", lambda h: F.xxhash64(h, F.lit(17))).alias("m")).collect()
    for r in rows:
        bits = sum(1 << i for i in range(64) if 2 * sum((m >> i) & 1 for m in r.m) > len(r.m))
        assert r.f % (1 << 64) == bits


def test_rows_are_counted_while_they_are_written(spark):
    from pricedex.sources.stored import stored_counted

    table, n = stored_counted(spark.range(25), F.col("id") % 5 == 0)
    assert (n, table.count()) == (5, 25)
    empty, n = stored_counted(spark.range(5).where("id > 7").join(spark.range(3), "id").distinct())
    assert n == 0 and empty.columns == ["id"] and empty.isEmpty()
