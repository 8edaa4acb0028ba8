"""Common table expressions of the checking SQL (DuckDB dialect)."""

NOW = "timestamp '2024-01-30 12:00:00'"
STATUS_LIST = "['체인·기어','타이어','안장·핸들','브레이크','멀쩡함','기타 고장']"

# name -> (needed names, text)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev0": ((), """select event_id, ts, user_id, event_type, value,
        cast(regexp_extract(props, '"k": *([0-9]+)', 1) as int) as k from events"""),
    "trips": (("ev0",), """select cast(user_id as varchar) bike, event_id ord, ts t0,
        cast(1 + user_id % s.s as varchar) st0,
        ts + to_seconds(cast(round(value * 6) as bigint)) t1,
        cast(case when event_id % 5 = 0 then 1 + (user_id + event_id) % s.s else 1 + user_id % s.s end as varchar) st1,
        cast((event_id * 37) % 400 as double) dist_m,
        case when k % 10 <> 0 then cast(k % 7 as varchar) end who
        from ev0, (select count(*) s from supplier) s"""),
    "duds": (("trips",), """select *, (st0 = st1 and t1 - t0 <= interval 180 seconds and dist_m < 300) dud from trips"""),
    "m1": (("duds",), """select *, coalesce(who = lag(who) over w, false) retry, coalesce(lag(dud) over w, false) pd
        from duds window w as (partition by bike order by t0, ord)"""),
    "m2": (("m1",), """select *, sum(case when pd then 0 else 1 end) over (partition by bike order by t0, ord) run from m1"""),
    "m3": (("m2",), """select *, row_number() over (partition by bike, run order by t0, ord) rn from m2"""),
    "m4": (("m3",), """select * exclude (pd), cast(sum(case when rn > 1 and not retry then 1 else 0 end)
        over (partition by bike, run order by t0, ord) as bigint) streak from m3"""),
    "marked": (("m4",), """select * exclude (run, rn), dud and not retry and streak = 1 alarm,
        cast(case when dud then streak + 1 else 0 end as bigint) chain from m4"""),
    "faults": (("ev0",), """select distinct on (bike, t) cast(user_id as varchar) bike, ts + interval 6 hours t,
        'k' || cast(k % 4 as varchar) kind from ev0 where event_type = 'error'"""),
    "stations": ((), """select cast(s_suppkey as varchar) id, s_name as name, n_name gu, r_name region,
        37.45 + (s_suppkey * 7 % 50) * cast(0.004 as double) lat, 126.85 + (s_suppkey * 13 % 50) * cast(0.006 as double) lon
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""),
    "hours": (("trips",), """select date_trunc('hour', t0) t, count(*) as rows from
        (select *, cast(floor(epoch(t0 - timestamp '2024-01-01') / 3600) as bigint) h from trips)
        where h % 53 <> 7 and (h % 37 <> 5 or ord % 20 = 0) group by 1"""),
    "surveys": (("ev0",), f"""select event_id id, cast(user_id as varchar) bike, ts + interval 1 hour as at,
        {STATUS_LIST}[k % 6 + 1] status from ev0 where event_type = 'signup'"""),
    "evs0": (("ev0",), """select upper(substring(event_type, 1, 2)) || '-' || cast(user_id as varchar) charger, event_type op, event_id ord,
        ts as start, ts + to_seconds(case when event_type = 'error' and event_id % 4 = 0 then 0
            else cast(round(value * 60) as bigint) end) as "end",
        case when event_id % 11 = 0 then '5' when event_id % 3 = 0 then '3' else '2' end stat from ev0"""),
    "ev_snapshots": (("evs0",), """select charger, op, ord, start, "end", stat,
        make_timestamp(cast(ceil(epoch_us("end") / 300000000.0) as bigint) * 300000000 + d) as at
        from evs0, (values (0), (300000000)) v(d)"""),
}


def cte(name: str, needs: tuple[str, ...], text: str) -> None:
    PARTS[name] = (needs, text)


def sql(needs: str, body: str, recursive: bool = False) -> str:
    """Body with the named table expressions (and what they need) in front."""
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in PARTS[n][0]:
            visit(d)
        seen.append(n)

    for n in needs.split():
        visit(n)
    # expressions read more than once are computed once
    return ("with recursive " if recursive else "with ") + ",\n".join(f"{n} as materialized ({PARTS[n][1]})" for n in seen) + "\n" + body
