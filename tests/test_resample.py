"""The bootstrap that chains each draw anew against a plain loop over draws."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from pricedex.operators import chain, resample

D0 = date(2026, 2, 2)


def test_draws_equal_a_plain_loop():
    rng = random.Random(3)
    cells = [f"r|c{k}|p{k % 2}" for k in range(7)]
    parent = {c: f"r|{c[-2:]}" for c in cells}
    weights = {c: rng.uniform(0.1, 1) for c in cells}
    links = []
    for k, c in enumerate(cells):
        for week in range(0 if k < 4 else 2, 10):
            kept = rng.choice([0, 0, 3, 4]) if k else 4
            logs = sum(rng.gauss(0.02, 0.05) for _ in range(kept))
            links.append({"cell_id": c, "collection_date": D0 + timedelta(days=7 * week), "relative": math.exp(logs / kept) if kept >= 3 else None, "undefined_reason": None, "logs": logs, "kept": kept})
    times = resample.draw_counts("r", len(cells), 20, 11)
    assert times.shape == (7, 20) and (times.sum(axis=0) == 7).all()

    def lent(count):
        out = {}
        for p in set(parent.values()):
            for day in {x["collection_date"] for x in links}:
                rows = [x for x in links if parent[x["cell_id"]] == p and x["collection_date"] == day]
                n = sum(count[x["cell_id"]] * x["kept"] for x in rows)
                if n:
                    out[p, day] = math.exp(sum(count[x["cell_id"]] * x["logs"] for x in rows) / n)
        return out

    plain = lent(dict.fromkeys(cells, 1))

    def states(shown, count):
        out = []
        for p in sorted(set(parent.values())):
            rows = [x | {"parent_relative": shown.get((p, x["collection_date"]), plain.get((p, x["collection_date"])))} for x in links if parent[x["cell_id"]] == p]
            out += chain.fold_states(rows, {c: w * count[c] for c, w in weights.items()})
        return out

    published = states(plain, dict.fromkeys(cells, 1))
    assert {s["status"] for s in published} >= {"PUBLISHED", "CARRIED", "ENTERED"}
    days = [D0 + timedelta(days=k) for k in range(75)]
    by_key = {(x["cell_id"], x["collection_date"]): x for x in links}
    rows, last = [], {}
    for s in sorted(published, key=lambda s: s["collection_date"]):
        x = by_key[s["cell_id"], s["collection_date"]]
        rows.append({
            "cell": cells.index(s["cell_id"]), "parent": parent[s["cell_id"]], "collection_date": s["collection_date"], "status": s["status"], "level": s["level"], "relative": x["relative"],
            "parent_relative": plain.get((parent[s["cell_id"]], s["collection_date"])), "logs": x["logs"], "kept": x["kept"], "weight": weights[s["cell_id"]],
            "last_matched_date": s["last_matched_date"], "fresh": s["status"] == "PUBLISHED" and last.get(s["cell_id"]) is None
        })
        last[s["cell_id"]] = s["level"]
    frame = pd.DataFrame(rows)
    frame["last_matched_date"] = frame["last_matched_date"].astype(object).where(frame["last_matched_date"].notna(), None)
    found = resample.fold_draws(frame, times, days)
    moved = 0
    for d in range(20):
        count = {c: float(times[k, d]) for k, c in enumerate(cells)}
        drawn = states(lent(count), count)
        for day in days:
            level = total = 0.0
            for c in cells:
                mine = [s for s in drawn if s["cell_id"] == c and s["collection_date"] <= day]
                if mine and (s := max(mine, key=lambda s: s["collection_date"]))["level"] is not None and (s["last_matched_date"] is None or (day - s["last_matched_date"]).days <= 13):
                    level, total = level + count[c] * weights[c] * s["level"], total + count[c] * weights[c]
            got = found[day][d]
            assert (np.isnan(got) and not total) or got == pytest.approx(level / total)
            moved += bool(total)
    assert moved > 500
