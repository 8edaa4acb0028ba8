"""Small tables and a sequential oracle for the chain rules."""

import datetime as dt
import random

from fleetsense.schema import TRIPS

BASE = dt.datetime(2026, 6, 1, 8, tzinfo=dt.timezone.utc)


def trip(bike, minute, seconds, same=True, metres=0.0, who=None, ord=0, station="00101"):
    t0 = BASE + dt.timedelta(minutes=minute)
    return (bike, ord, t0, station, t0 + dt.timedelta(seconds=seconds), station if same else "00999", float(metres), who)


def frame(spark, rows):
    return spark.createDataFrame([r[:1] + (i,) + r[2:] for i, r in enumerate(rows)], TRIPS)


def random_trips(seed=1, bikes=6, n=600, people=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        bike = "hot" if rng.random() < 0.4 else f"b{rng.randrange(bikes)}"
        who = None if rng.random() < 0.15 else f"p{rng.randrange(people)}"
        rows.append(trip(bike, i * 7 + rng.randrange(7), rng.choice([20, 60, 170, 400, 2400]), rng.random() < 0.85,
                         rng.choice([0, 50, 299, 300, 900]), who, station=f"0010{rng.randrange(3)}"))
    return rows


def fold(rows, k=2, mode="person", gap=120):
    """The rules applied one rental at a time: (bike, ord) -> (dud, retry, streak, alarm)."""
    out, last = {}, {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1][0], x[1][2], x[0])):
        bike, t0, st0, t1, st1, metres, who = r[0], r[2], r[3], r[4], r[5], r[6], r[7]
        dud = st0 == st1 and (t1 - t0).total_seconds() <= 180 and metres < 300
        p = last.get(bike)
        if mode == "person":
            retry = p is not None and who is not None and who == p["who"]
        elif mode == "gap":
            retry = p is not None and p["dud"] and (t0 - p["t1"]).total_seconds() < gap
        else:
            retry = False
        streak = p["streak"] + (not retry) if p and p["dud"] else 0
        out[(bike, i)] = (dud, retry, streak, dud and not retry and streak == k - 1)
        last[bike] = {"who": who, "dud": dud, "streak": streak, "t1": t1}
    return out
