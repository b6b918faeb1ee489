"""The ordered fold against a plain one: prune, cap, still time, ties and nulls."""

import datetime
import random

from basketlens.operators.profiles import CAP, profiles

DAY = datetime.datetime(2024, 1, 1)


def plain(events, now):
    """Every event in turn over a list of [name, weight]."""
    at, maps = None, {"category": [], "brand": []}

    def decay(t):
        nonlocal at, maps
        if at is None:
            at = t
            return
        days = max(0, (t - at) / datetime.timedelta(days=1))
        if days >= 0.01:
            at = t
            maps = {k: [[n, w * 0.5 ** (days / 14)] for n, w in m if w * 0.5 ** (days / 14) >= 0.05] for k, m in maps.items()}

    for t, _, weight, names in sorted(events, key=lambda e: (e[0], e[1])):
        decay(t)
        for kind, name in names.items():
            if name is None:
                continue
            found = next((x for x in maps[kind] if x[0] == name), None)
            if found:
                found[1] += weight
            else:
                maps[kind].append([name, weight])
            if len(maps[kind]) > 60:
                maps[kind] = sorted(maps[kind], key=lambda x: -x[1])[:60]
    decay(now)
    return {(k, n): w for k, m in maps.items() for n, w in m}


def test_fold(spark):
    rng, rows = random.Random(4), []
    for i in range(3000):
        s = rng.choice([None, 1, 1, 1, 2, 3])
        names = 100 if s == 1 else 4
        at = DAY + datetime.timedelta(milliseconds=rng.choice([rng.randrange(120 * 86_400_000), rng.randrange(600_000)]))
        rows.append((s, None if rng.random() < 0.02 else at, i, rng.choice([1, 3, 4, 0, None]), rng.choice([None, f"c{rng.randrange(names)}"]), f"b{rng.randrange(names)}"))
    now = DAY + datetime.timedelta(days=130)
    table = spark.createDataFrame(rows, "session_id long, ts timestamp_ntz, event_id long, weight int, category string, brand string")
    found = profiles(table, ["category", "brand"], int((now - datetime.datetime(1970, 1, 1)).total_seconds()) * 1_000_000).collect()
    for s in (None, 1, 2, 3):
        want = plain([(r[1], r[2], r[3], {"category": r[4], "brand": r[5]}) for r in rows if r[0] == s and r[1] is not None and r[3]], now)
        got = {(r.kind, r.name): r.weight for r in found if r.session_id == s}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert s != 1 or sum(k == "brand" for k, _ in got) <= CAP
    assert profiles(table.limit(0), ["brand"], 0).count() == 0
