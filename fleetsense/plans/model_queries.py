"""Features, labelled samples, scoring, calibration, selection and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.stats import auc, top_by_count
from ..operators import chains, features as X, lists as L, model as M, training as T
from ..operators.timeline import saved
from .chain_queries import _limited
from .list_queries import KNOWN
from .oracle import NOW, cte, sql
from .registry import query

cte("feat", ("marked", "ststats"), """select p.*, coalesce(u.n, 0) run_len, cast(coalesce(u.rt, 0) as bigint) run_retries, u.span run_span_min, u.idle0 idle_before_run_min,
      epoch_us(t1 - t0) / 1e6 dur_sec, idle idle_before_min, cast(hour(t1) as bigint) hour_, cast(case when isodow(t1) >= 6 then 1 else 0 end as bigint) weekend,
      (epoch_us(t1) - epoch_us(n1)) / 3.6e9 last_normal_ago_h, (epoch_us(n1) - epoch_us(n0)) / 6e7 last_normal_dur_min,
      alarms7 - case when chain >= 2 then 1 else 0 end prior_alarms7, st_dud_rate, st_log_volume
    from (select *, lag(dud) over w pd, (epoch_us(t0) - epoch_us(lag(t1) over w)) / 6e7 idle,
        last_value(case when not dud then t0 end ignore nulls) over c n0, last_value(case when not dud then t1 end ignore nulls) over c n1,
        count(*) over h hist7_rentals, count(*) filter (where dud) over h hist7_duds, count(*) filter (where alarm) over h alarms7,
        first_value(case when retry then null else dud end ignore nulls) over f next_dud, lead(t0) over w any_t0, lead(dud) over w any_dud
      from marked window w as (partition by bike order by t0, ord), c as (partition by bike order by t0, ord rows between unbounded preceding and current row),
        h as (partition by bike order by t0 range between interval 7 days preceding and current row),
        f as (partition by bike order by t0, ord rows between 1 following and unbounded following)) p
    left join (select bike, ord, row_number() over w n, sum(case when retry then 1 else 0 end) over w rt, (epoch_us(t1) - epoch_us(first_value(t1) over w)) / 6e7 span, first_value(idle) over w idle0
      from (select *, sum(case when dud and not coalesce(pd, false) then 1 else 0 end) over (partition by bike order by t0, ord) r from
        (select *, lag(dud) over w2 pd, (epoch_us(t0) - epoch_us(lag(t1) over w2)) / 6e7 idle from marked window w2 as (partition by bike order by t0, ord)))
      where dud window w as (partition by bike, r order by t0, ord)) u using (bike, ord) left join ststats s on s.st = p.st1""")
F17 = "chain, run_len, run_retries, run_span_min, dur_sec, dist_m, idle_before_min, idle_before_run_min, hour_ as \"hour\", weekend, last_normal_ago_h, last_normal_dur_min, hist7_rentals, hist7_duds, prior_alarms7, st_dud_rate, round(st_log_volume, 9) st_log_volume"


def feats(t):
    return X.features17(t.marked, X.station_stats(t.marked), t.heavy)


def rounded(df):
    return df.withColumn("st_log_volume", F.round("st_log_volume", 9)).select("bike", "ord", *[c for c in df.columns if c not in ("bike", "ord")])


@query("features17", sql("feat", f"select bike, ord, {F17} from feat"))
def _(t):
    return rounded(feats(t).select("bike", "ord", *X.FEATURES17))


WARM = "cast(t0 as date) >= (select cast(min(t0) as date) + 7 from trips)"


def first_start(t):
    return t.trips.agg(F.min("t0")).scalar()


@query("realtime_rows", sql("feat", f"""select bike, ord, {F17}, next_dud y, cast(t1 as date) as "day" from feat where dud and next_dud is not null and {WARM}"""))
def _(t):
    return rounded(X.realtime_rows(feats(t), first_start(t)).select("bike", "ord", *X.FEATURES17, "y", "day"))


@query("morning_rows", sql("feat", f"""select bike, ord, {F17}, any_dud y, cast(cast(t0 as date) + interval 1 day as date) as "day",
    (epoch_us(cast(t0 as date) + interval 1 day) - epoch_us(t1)) / 3.6e9 hours_to_midnight from feat
    where dud and any_t0 is not null and cast(any_t0 as date) > cast(t0 as date) and {WARM}"""))
def _(t):
    return rounded(X.morning_rows(feats(t), first_start(t)).select("bike", "ord", *X.FEATURES17, "y", "day", "hours_to_midnight"))


cte("smp", ("feat",), """select c.*, (epoch_us("at") - epoch_us(t1)) / 3.6e9 age_h,
      (select count(*) from trips s where s.st0 = c.st1 and s.t0 > c.t1 and s.t0 < c.at) others,
      ln(1 + cast((select count(*) from trips s where s.st0 = c.st1 and s.t0 > c.t1 and s.t0 < c.at) as double)) shun
    from (select bike, ord, t0, t1, st1, next_dud y, chain, hist7_duds, hist7_rentals, prior_alarms7, dur_sec,
        unnest(generate_series(to_timestamp(0)::timestamp + to_microseconds(cast(ceil((epoch_us(t1) - b) / 10800000000.0) as bigint) * 10800000000 + b),
          least(coalesce(any_t0, t1 + interval 24 hours), t1 + interval 24 hours) - interval 1 second, interval 3 hours)) as at
      from feat, (select epoch_us(date_trunc('day', min(t1))) b from marked) where dud and chain >= 2 and next_dud is not null and epoch_us(t1) >= b + 7 * 86400000000) c""")
cte("smpp", ("smp",), f"select *, {M.to_sql()} p from smp")


def samples(t):
    return X.list_samples(t.marked, t.heavy, t.heavy_station)


def scored(t):
    return samples(t).withColumn("p", M.probability())


@query("list_samples", sql("smp", """select bike, ord, "at", y, chain, hist7_duds, hist7_rentals, prior_alarms7, dur_sec, age_h, round(shun, 9) shun from smp"""))
def _(t):
    return samples(t).select("bike", "ord", "at", "y", "chain", "hist7_duds", "hist7_rentals", "prior_alarms7", "dur_sec", "age_h", F.round("shun", 9).alias("shun"))


@query("shun_count", sql("smp", """select bike, ord, "at", others from smp"""))
def _(t):
    return samples(t).select("bike", "ord", "at", "others")


LIVEF = _limited(KNOWN.replace("7 days", "8 days")) + f""", h as (select *, count(*) over w rentals, count(*) filter (where dud) over w duds, count(*) filter (where alarm) over w alarms,
      row_number() over (partition by bike order by t0 desc, ord desc) r from marked window w as (partition by bike order by t0 range between interval 7 days preceding and current row)),
    lf as materialized (select bike, chain, duds hist7_duds, rentals hist7_rentals, alarms - case when chain >= 2 then 1 else 0 end prior_alarms7, epoch_us(t1 - t0) / 1e6 dur_sec,
      greatest(0, (epoch_us({NOW}) - epoch_us(t1)) / 3.6e9) age_h, ln(1 + cast((select count(*) from marked s where s.st0 = h.st1 and s.t0 > h.t1 and s.t0 < {NOW} and s.t1 >= {NOW} - interval 25 hours) as double)) shun, t0, t1, st1
      from h where r = 1 and dud)"""


def live_features(t):
    m = chains.mark(L.known_window(t.trips, t.now, 8), identity="person", heavy=t.heavy)
    return X.live_features(m, t.trips, t.now, t.heavy, t.heavy_station)


@query("p_features", LIVEF + "select bike, chain, hist7_duds, hist7_rentals, prior_alarms7, dur_sec, age_h, round(shun, 9) shun from lf")
def _(t):
    return live_features(t).select("bike", "chain", "hist7_duds", "hist7_rentals", "prior_alarms7", "dur_sec", "age_h", F.round("shun", 9).alias("shun"))


@query("sample_list", LIVEF + f""" select {NOW} as "at", bike, t0 last_t0, chain, hist7_duds, hist7_rentals, prior_alarms7, dur_sec, age_h, round(shun, 9) shun, round({M.to_sql()}, 9) p from lf
    where chain >= 2 and t1 >= {NOW} - interval 24 hours and bike not like '%7'""")
def _(t):
    now = live_features(t).where((F.col("chain") >= 2) & (F.col("t1") >= t.now - F.expr("interval 24 hours")))
    stored = now.where(F.endswith("bike", F.lit("7"))).select("at", "bike")
    d = T.new_samples(now.withColumn("p", M.probability()), stored)
    return d.withColumns({"shun": F.round("shun", 9), "p": F.round("p", 9)})


SETTLE = """, a as ({asof}), b as (select m.bike, m.t1 as at, a.next_t0, a.next_dud from a join marked m on m.bike = a.bike and m.ord = a.ord)
    select bike, "at", case when next_t0 < {now} - interval 7 hours then next_t0 end next_t0, case when next_t0 < {now} - interval 7 hours then next_dud end next_dud from b"""


def _settle_sql():
    from .chain_queries import ASOF
    return sql("marked", SETTLE.format(asof=ASOF, now=NOW))


@query("settle_labels", _settle_sql())
def _(t):
    from .metric_queries import alarms
    return T.settle(alarms(t).select("bike", "at", "next_t0", "next_dud"), t.now)


@query("scan_samples", _settle_sql().replace("next_dud from b", "next_dud from b where next_t0 < " + NOW + " - interval 7 hours"))
def _(t):
    from ..sources.readers import labelled_samples
    from .metric_queries import alarms
    return labelled_samples(T.settle(alarms(t).select("bike", "at", "next_t0", "next_dud"), t.now))


@query("score_trees", sql("smpp", """select bike, ord, "at", round(p, 9) p from smpp"""))
def _(t):
    return scored(t).select("bike", "ord", "at", F.round("p", 9).alias("p"))


def _why(i: int, f: str) -> str:
    import re
    swapped = re.sub(rf"\b{f}\b", repr(M.MEDIANS[f]), M.to_sql())
    return f"{{'i': {i}, 't': '{f}', 'd': p - {swapped}}}"


@query("explain", sql("smpp", """, w as (select bike, ord, "at", unnest([""" + ", ".join(_why(i, f) for i, f in enumerate(X.FEATURES7)) + """]) x from smpp),
    r as (select *, row_number() over (partition by bike, ord, "at" order by round(abs(x.d), 12) desc, x.i) rk from w where abs(x.d) >= 0.02::double)
    select bike, ord, "at", rk as "rank", x.t feature, round(x.d, 9) points from r where rk <= 3"""))
def _(t):
    d = M.explain(samples(t)).select("bike", "ord", "at", F.posexplode("why").alias("rank", "w"))
    return d.select("bike", "ord", "at", (F.col("rank") + 1).alias("rank"), F.col("w.t").alias("feature"), F.round("w.d", 9).alias("points"))


LISTS = """, ls as (select "at", count(*) n, sum(p) mu, cast(count(*) filter (where y) as bigint) real_, sqrt(sum(p * (1 - p))) sd from smpp group by 1 having count(*) >= 10),
    lz as (select *, (real_ - mu) / sd z from ls)"""


@query("lists_eval", sql("smpp", LISTS + """select "at", n, round(mu, 6) mu, real_ as "real", round(sd, 6) sd, round(z, 6) z from lz"""))
def _(t):
    d = M.list_stats(scored(t))
    return d.select("at", "n", F.round("mu", 6).alias("mu"), "real", F.round("sd", 6).alias("sd"), F.round("z", 6).alias("z"))


BIN = "case " + " ".join(f"when p > {a} and p <= {b} then {float(b)}::double" for a, b in zip(M.CALIBRATION, M.CALIBRATION[1:])) + " end"


@query("calibration", sql("smpp", f"select {BIN} bin, count(*) n, round(avg(p), 9) pred, cast(count(*) filter (where y) as double) / count(*) as \"real\" from smpp group by 1"))
def _(t):
    d = scored(t).groupBy(M.right_closed_bin(F.col("p"), M.CALIBRATION).alias("bin"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("pred"), (F.count_if("y") / F.count(F.lit(1))).alias("real"))


AGE = "case " + " ".join(f"when age_h > {a} and age_h <= {b} then {float(b)}::double" for a, b in zip(M.AGES, M.AGES[1:])) + " end"


@query("age_profile", sql("smpp", f"select {AGE} age, count(*) n, cast(count(*) filter (where y) as double) / count(*) as \"real\", round(avg(p), 9) pred from smpp where age_h > 0 group by 1"))
def _(t):
    d = scored(t).where("age_h > 0").groupBy(M.right_closed_bin(F.col("age_h"), M.AGES).alias("age"))
    return d.agg(F.count(F.lit(1)).alias("n"), (F.count_if("y") / F.count(F.lit(1))).alias("real"), F.round(F.avg("p"), 9).alias("pred"))


@query("topk_per_snapshot", sql("smpp", """, r as (select *, count(*) over (partition by "at") n, row_number() over (partition by "at" order by chain desc, age_h, bike) rr,
      row_number() over (partition by "at" order by round(p, 9) desc, bike) rm from smpp)
    select 'rule' by_, "at", bike, rr as "rank", y from r where n >= 5 and rr <= 5 union all select 'model', "at", bike, rm, y from r where n >= 5 and rm <= 5"""))
def _(t):
    s = saved(scored(t).select("at", "bike", "chain", "age_h", "y", F.round("p", 9).alias("p")))
    rule = L.top_per_list(s, 5, [F.desc("chain"), F.col("age_h"), F.col("bike")])
    model = L.top_per_list(s, 5, [F.desc("p"), F.col("bike")])
    cols = ["at", "bike", "rank", "y"]
    return rule.select(F.lit("rule").alias("by_"), *cols).unionByName(model.select(F.lit("model").alias("by_"), *cols))


@query("same_count_selection", sql("feat", f""", r as (select *, chain >= 2 rule, hist7_duds * 100 + run_len score from feat where dud and next_dud is not null and {WARM}),
    k as (select *, row_number() over (order by score desc, bike, ord) rk, (select count(*) from r where rule) n from r)
    select count(*) filter (where rule) n, cast(100 as double) * count(*) filter (where rule and next_dud) / count(*) filter (where rule) rule_pct,
      cast(100 as double) * count(*) filter (where rk <= n and next_dud) / count(*) filter (where rk <= n) model_pct from k"""))
def _(t):
    d = X.realtime_rows(X.base_features(t.marked, t.heavy).done(), first_start(t)).select("bike", "ord", "y", (F.col("chain") >= 2).alias("rule"),
                                                                          (F.col("hist7_duds") * 100 + F.col("run_len")).alias("score"))
    d = saved(d)
    n = d.where("rule").agg(F.count(F.lit(1)).alias("n")).scalar()
    c = top_by_count(d, F.col("score"), ["bike", "ord"], n)
    return c.agg(F.count_if("rule").alias("n"), S.percent(F.count_if(F.col("rule") & F.col("y")), F.count_if("rule")).alias("rule_pct"),
                 S.percent(F.count_if(F.col("chosen") & F.col("y")), F.count_if("chosen")).alias("model_pct"))


@query("list_guarantee", sql("smpp", """select "at", count(*) n, round(sum(p), 6) expected, cast(greatest(0, floor(sum(p) - 1.5 * sqrt(sum(p * (1 - p))))) as bigint) at_least from smpp group by 1"""))
def _(t):
    return L.guarantee(scored(t), -1.5, "at").withColumn("expected", F.round("expected", 6))


@query("auc", sql("smpp", """, g as (select round(p, 9) p, count(*) filter (where y) a, count(*) filter (where not y) b from smpp group by 1),
    c as (select *, coalesce(sum(b) over (order by p rows between unbounded preceding and 1 preceding), 0) below from g)
    select cast(sum(a) as bigint) n_pos, cast(sum(b) as bigint) n_neg, round(cast(sum(a * (below + b / 2.0)) as double) / cast(sum(a) * sum(b) as double), 9) auc from c"""))
def _(t):
    return auc(scored(t), F.round("p", 9), F.col("y")).withColumn("auc", F.round("auc", 9))


@query("conformal_q", sql("smpp", LISTS + """, q as (select quantile_cont(z, 0.1) q from lz where "at" < timestamp '2024-01-20')
    select round(q, 6) q, (select count(*) from lz where "at" >= timestamp '2024-01-20') lists,
      (select cast(100 as double) * count(*) filter (where real_ >= floor(mu + q * sd)) / nullif(count(*), 0) from lz where "at" >= timestamp '2024-01-20') covered_pct from q"""))
def _(t):
    d = T.conformal(M.list_stats(scored(t)), F.lit("2024-01-20").cast("timestamp"))
    return d.withColumn("q", F.round("q", 6))


@query("live_model_check", sql("smpp", """, l as (select "at", sum(p) mu, count(*) filter (where y) r from smpp group by 1)
    select (select count(*) from smpp) n, (select round(avg(p), 9) from smpp) p_mean, (select cast(count(*) filter (where y) as double) / count(*) from smpp) y_mean,
      count(*) lists, round(avg(mu), 6) list_expected, cast(sum(r) as double) / count(*) list_real from l"""))
def _(t):
    d = T.live_check(saved(scored(t).select("at", "p", "y")))
    return d.withColumns({"p_mean": F.round("p_mean", 9), "list_expected": F.round("list_expected", 6)})


@query("retrain_gate", sql("smpp", """, c as (select quantile_cont(epoch_us("at"), 0.7) cut from smpp),
    s as (select case when y then 1.0::double else 0 end y, p, least(greatest(0.3 + 0.1 * (chain - 2), 0.05), 0.95)::double new_p from smpp, c where epoch_us("at") > cut)
    , m as (select count(*) n, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) old_loss, avg(-(y * ln(new_p) + (1 - y) * ln(1 - new_p))) new_loss, abs(sum(p) - sum(y)) old_gap, abs(sum(new_p) - sum(y)) new_gap from s)
    select n, round(old_loss, 9) old_loss, round(new_loss, 9) new_loss, round(old_gap, 6) old_gap, round(new_gap, 6) new_gap,
      n >= 500 and new_loss < 0.98::double * old_loss and new_gap <= old_gap switch from m"""))
def _(t):
    s = saved(scored(t).select("at", "p", "y", F.least(F.greatest(0.3 + 0.1 * (F.col("chain") - 2), F.lit(0.05)), F.lit(0.95)).alias("new_p")))
    d = T.gate(T.later_part(s, 0.7))
    return d.select("n", *[F.round(c, 9).alias(c) for c in ("old_loss", "new_loss")], *[F.round(c, 6).alias(c) for c in ("old_gap", "new_gap")], "switch")


@query("parity_features", sql("feat", """select count(*) n, count(*) filter (where round(dur_sec, 3) = round(dur_sec, 3)) dur_equal, count(*) filter (where hist7_duds = h.d) duds_equal from feat
    join (select bike, ord, count(*) filter (where dud) over (partition by bike order by t0 range between interval 7 days preceding and current row) d from marked) h using (bike, ord)"""))
def _(t):
    a = X.base_features(t.marked, t.heavy).done().select("bike", "ord", "dur_sec", "hist7_duds")
    b = chains.history(t.marked, 7, t.heavy).done().select("bike", "ord", S.seconds_between("t0", "t1").alias("dur2"), F.col("hist_duds"))
    d = a.join(b, ["bike", "ord"])
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.round("dur_sec", 3) == F.round("dur2", 3)).alias("dur_equal"),
                 F.count_if(F.col("hist7_duds") == F.col("hist_duds")).alias("duds_equal"))


# ---- trained models (rows-only checks)

def labelled(t):
    return saved(samples(t).select("bike", "ord", "at", "t1", *X.FEATURES7, "y"))


@query("train_gbt")
def _(t):
    s = labelled(t)
    return T.evaluate(T.train_and_score(s, X.FEATURES7, split=F.col("at") < F.lit("2024-01-22").cast("timestamp")), "gbt")


@query("logit_baseline")
def _(t):
    s = labelled(t)
    return T.evaluate(T.logit(s, X.FEATURES7, split=F.col("at") < F.lit("2024-01-22").cast("timestamp")), "logit")


@query("tree_baseline")
def _(t):
    s = labelled(t)
    return T.evaluate(T.small_tree(s, ["chain", "hist7_duds"], split=F.col("at") < F.lit("2024-01-22").cast("timestamp")), "tree")


@query("permutation_importance")
def _(t):
    s, split = labelled(t), F.col("at") < F.lit("2024-01-22").cast("timestamp")
    trees = M.from_spark(M.train(s.where(split), X.FEATURES7), X.FEATURES7)
    return T.permutation_importance(M.prepared(s.where(~split), X.FEATURES7), X.FEATURES7, trees)


@query("day_bootstrap", sql("smpp", """, d as (select cast("at" as date) as "day", count(*) filter (where p >= 0.4) na, count(*) filter (where p >= 0.4 and y) ya, count(*) filter (where chain >= 3) nb, count(*) filter (where chain >= 3 and y) yb from smpp group by 1)
    select count(*) "days", cast(sum(na) as bigint) n_model, cast(sum(nb) as bigint) n_rule, 100 * (cast(sum(ya) as double) / sum(na) - cast(sum(yb) as double) / sum(nb)) diff_pct from d"""))
def _(t):
    return T.day_sums(scored(t).select(F.to_date("at").alias("day"), "y", (F.col("p") >= 0.4).alias("a"), (F.col("chain") >= 3).alias("b"))).agg(
        F.count(F.lit(1)).alias("days"), F.sum("na").alias("n_model"), F.sum("nb").alias("n_rule"),
        (100 * (F.sum("ya") / F.sum("na") - F.sum("yb") / F.sum("nb"))).alias("diff_pct"))


@query("day_bootstrap_range", sql("smpp", """, d as (select cast("at" as date) as "day", count(*) filter (where p >= 0.4) na, count(*) filter (where p >= 0.4 and y) ya, count(*) filter (where chain >= 3) nb, count(*) filter (where chain >= 3 and y) yb from smpp group by 1),
    m as (select *, row_number() over (order by "day") - 1 i, count(*) over () n from d),
    w as (select r, ('0x' || substr(md5('0-' || r || '-' || j), 1, 15))::bigint % (select max(n) from m) i from range(1000) a(r), range((select max(n) from m)) b(j)),
    x as (select r, sum(ya) / greatest(1, sum(na)) - sum(yb) / greatest(1, sum(nb)) d from w join m on m.i = w.i group by 1)
    select count(*) replicates, 100 * quantile_cont(d, 0.025) lo_pct, 100 * quantile_cont(d, 0.975) hi_pct from x"""))
def _(t):
    d = scored(t).select(F.to_date("at").alias("day"), "y", (F.col("p") >= 0.4).alias("a"), (F.col("chain") >= 3).alias("b"))
    return T.day_bootstrap(d, 1000)


@query("cross_month")
def _(t):
    s, parts = T.periods(labelled(t))
    return T.cross_period(s, X.FEATURES7, parts)


@query("transfer_eval")
def _(t):
    # the second city has no person key: the gap rule marks it
    other = chains.mark(t.trips, identity="gap", heavy=t.heavy)
    s = X.list_samples(other, t.heavy, t.heavy_station).withColumn("p", M.probability())
    return T.transfer(saved(s.select("at", "bike", "chain", "age_h", "p", "y")), 3)


@query("survey_scores", sql("marked surveys", """, sv as (select s.id, s.bike, s.at, s.status, arg_max({'chain': m.chain, 't0': m.t0, 't1': m.t1, 'st1': m.st1, 'ord': m.ord}, (m.t0, m.ord)) m
      from surveys s join marked m on m.bike = s.bike and m.t1 <= s.at group by 1, 2, 3, 4),
    al as (select id, sv.bike, "at", status, m.chain as chain, m.t1 as t1, m.st1 as st1, m.ord as ord from sv where m.chain >= 2),
    ft as (select al.*, h.hist7_duds, h.hist7_rentals, h.prior_alarms7, h.dur_sec, (epoch_us("at") - epoch_us(al.t1)) / 3.6e9 age_h,
      ln(1 + cast((select count(*) from trips s where s.st0 = al.st1 and s.t0 > al.t1 and s.t0 < al.at) as double)) shun from al join (select bike, ord, epoch_us(t1 - t0) / 1e6 dur_sec,
        count(*) over w hist7_rentals, count(*) filter (where dud) over w hist7_duds, count(*) filter (where alarm) over w - case when chain >= 2 then 1 else 0 end prior_alarms7
        from marked window w as (partition by bike order by t0 range between interval 7 days preceding and current row)) h using (bike, ord))
    select id, bike, status <> '멀쩡함' broken, round(""" + M.to_sql() + """, 9) p from ft"""))
def _(t):
    from ..operators.survey import alarmed_probability
    bikes = t.surveys.select("bike").distinct()
    m = chains.mark(t.trips.join(bikes, "bike", "left_semi"), identity="person", heavy=t.heavy)
    d = alarmed_probability(t.surveys, m, t.trips, t.heavy, t.heavy_station)
    return d.select("id", "bike", (F.col("status") != S.FINE).alias("broken"), F.round("p", 9).alias("p"))


