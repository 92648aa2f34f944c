"""Added spans of personal data against a plain Python form of the whole method: candidates, votes, expectation-maximisation, classifier."""

from __future__ import annotations

import collections
import math
import random

import regex

from pricedex.llm import pii


def plain_spans(text, patterns):
    found = []
    for kind, pattern in patterns.items():
        for m in regex.finditer(pattern, text):
            digits = regex.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0
            fine = {"ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=digits, ok=luhn: 12 <= len(d) <= 19 and ok, "phone": lambda d=digits: 9 <= len(d) <= 15}
            if fine.get(kind, lambda: True)():
                found.append((m.start(), pii.KINDS.index(kind), m.end(), kind, m.group()))
    return sorted(found)


def plain_candidates(text):
    base = plain_spans(text, {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"})
    rest, pieces = [], {}
    for kind, pattern in pii.CANDIDATES.items():
        matches = list(regex.finditer(pattern, text))
        for k, m in enumerate(matches):
            pieces[m.start(), kind] = text[matches[k - 1].end() if k else 0 : m.start()][-24:], text[m.end() : matches[k + 1].start() if k + 1 < len(matches) else len(text)][:24]
    for c in plain_spans(text, pii.CANDIDATES):
        if not any(b[0] < c[2] and b[2] > c[0] for b in base):
            rest.append((*c, *pieces[c[0], c[3]]))
    return base, rest


def plain_votes(c):
    _, _, _, kind, found, before, after = c
    vote = lambda yes, no: "y" if yes else "n" if no else "-"
    has = lambda pattern, text: regex.search(pattern, text, regex.ASCII) is not None
    shape = has(r"^(?:AKIA[0-9A-Z]{12,}|[0-9a-f]{18}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|gh[pous]_[A-Za-z0-9]{20,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})$", found) or kind != "secret"
    share = sum(x.isdigit() for x in found) / len(found)
    mixed = 0.15 <= share <= 0.9
    known = has(rf"^(?:{pii.KEY_PREFIXES})|^(?:{pii.ACCOUNT_COUNTRIES})[0-9]{{2}}[A-Z0-9]{{11,30}}$", found) or has(rf"(?i)[\])]\x20?(?:{pii.MAIL_SERVICES})\b", found)
    return "".join([
        vote(known, has(pii.COMMON, found)), vote(shape, has("[-/_+]{2}|[a-z]{12}", found)),
        vote(has(rf"(?i)(?:^|[^a-z])(?:{pii.TELLING})[^A-Za-z0-9]{{0,6}}$", before), has(rf"(?i)(?:^|[^a-z])(?:{pii.OTHER})[^A-Za-z0-9]{{0,6}}$", before)),
        vote(has(r"[=:][\x20]?[\"']?$|[\"']$", before), has(r"[/\\#]$", before)), vote(has(r"^(?:[\"'\x20.,;)\n]|$)", after), has(r"^[/\\@=]", after)),
        vote(mixed and len(set(found)) / len(found) > 0.2, not mixed)
    ])


def plain_features(c):
    _, _, _, kind, found, before, after = c
    case = "mixed" if found != found.upper() and found != found.lower() else "upper" if found != found.lower() else "lower" if found != found.upper() else "none"

    def side(text, last):
        if not text:
            return "end"
        x = text[-1] if last else text[0]
        return "word" if x.isascii() and x.isalnum() else "space" if x in " \t\n\r\x0b\x0c" else "mark" if x in "\"'=:" else "other"

    return [
        f"kind={kind}", f"digits={4 * sum(x.isdigit() for x in found) // len(found)}", f"size={min(int(math.log2(len(found))), 8)}", f"case={case}",
        f"before={side(before, True)}", f"after={side(after, False)}", f"signs={'yes' if set(found) & set('+/_-') else 'no'}"
    ]


def plain_keepers(found):
    """Which candidates are kept: every candidate is its own row, nothing is counted beforehand."""
    votes = [plain_votes(c) for c in found]
    squash = lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))
    belief = [squash(1.5 * (v.count("y") - v.count("n"))) for v in votes]
    for _ in range(pii.ROUNDS):
        yes = math.fsum(belief)
        no = len(found) - yes
        odds = []
        for k in range(6):
            prior = {"y": (4, 1), "n": (1, 4), "-": (2.5, 2.5)}
            odds.append({
                a: math.log((math.fsum(b for v, b in zip(votes, belief) if v[k] == a) + prior[a][0]) / (yes + 7.5)) - math.log((math.fsum(1 - b for v, b in zip(votes, belief) if v[k] == a) + prior[a][1]) / (no + 7.5)) for a in "yn-"
            })
        belief = [squash(math.log((yes + 1) / (no + 1)) + sum(odds[k][v[k]] for k in range(6))) for v in votes]
    yes = math.fsum(belief)
    no = len(found) - yes
    marks = [plain_features(c) for c in found]
    for_yes, for_no = collections.Counter(), collections.Counter()
    for fs, b in zip(marks, belief):
        for f in fs:
            for_yes[f] += b
            for_no[f] += 1 - b
    weight = lambda f: math.log((for_yes[f] + 0.5) / (yes + 1)) - math.log((for_no[f] + 0.5) / (no + 1))
    return [math.log((yes + 0.5) / (no + 0.5)) + sum(map(weight, fs)) > 0 for fs in marks]


def corpus():
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    lines = []
    for k in range(240):
        lines.append(" ".join(word() for _ in range(8)) + " " + rng.choice([
            f'token = "{hexes(40)}" end', f"key: AKIA{hexes(16).upper()}.", f"see /files/report-{k}-final-version.html now", f"commit {hexes(40)} of the branch", f"call 555-{rng.randint(100, 999)}-{rng.randint(1000, 9999)} now",
            f"page 300-12-{rng.randint(1000, 9999)}", f"ssn {rng.randint(100, 899)}-45-{rng.randint(1000, 9999)},", f"write to {word()}.x [at] gmail [dot] com", f"mail a.{word()}@site.org and 10.0.0.{k}",
            f"ISBN_{rng.randint(10**12, 10**13)}_v2", f"account DE{rng.randint(10, 99)}{rng.randint(10**17, 10**18)}", f"path/to/{word()}{k}/x/y/z/{word()}", f"card 4111 1111 1111 1111 id=user{k}name{hexes(12)}", "x" * 40 + str(k), f"+1 377 555 {rng.randint(1000, 9999)}"
        ]) + " " + word() + ".")
    texts = ["\n".join(lines[k : k + 3]) for k in range(0, 240, 3)]
    return [*texts, None, "", texts[0], "é" + texts[1], "no data here"]


def test_added_spans_equal_the_plain_method(spark):
    texts = corpus()
    parts = [plain_candidates(t or "") for t in texts]
    kept = iter(plain_keepers([c for _, rest in parts for c in rest]))
    expected, added = {}, collections.Counter()
    for k, (base, rest) in enumerate(parts):
        more = [c for c in rest if next(kept)]
        added.update(c[3] for c in more)
        expected[k] = ",".join(f"{c[3]}:{c[0]}:{c[2]}" for c in sorted([*base, *(c[:5] for c in more)]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.spans for r in pii.digest(frame).collect()} == expected
    assert set(added) == set(pii.CANDIDATES) and sum(added.values()) < sum(len(rest) for _, rest in parts)
