"""SQL twins of the registered queries, for DuckDB."""

from __future__ import annotations

from . import adapters

SHIFT = 28800000


def _limits(k: float, where: str) -> str:
    return f"""select station, signal, count(*) n, avg(value) mean, coalesce(stddev_samp(value), 0) sd, min(value) mn, max(value) mx, avg(value) - {k} * coalesce(stddev_samp(value), 0) lcl,
  avg(value) + {k} * coalesce(stddev_samp(value), 0) ucl from telemetry where {where} group by station, signal"""


def _oee(ideal: str, source: str = "part_events") -> str:
    return f"""select station, parts, good, availability * performance * quality oee, availability, performance, quality, 1 - quality defect_rate, ideal_cycle_s, ideal_configured, min_ms / 1000.0::double min_cycle_s,
  down / 1000.0::double down_s, blocked / 1000.0::double blocked_s, starved / 1000.0::double starved_s from (
  select *, greatest(0.0, (span - down)::double / span) availability, least(1.0, ideal_cycle_s * 1000 * parts / run) performance, good::double / parts quality from (
  select s.*, coalesce({ideal}, min_ms / 1000.0::double) ideal_cycle_s, {ideal} is not null ideal_configured, greatest(1, last_ts - first_ts) span from (
  select station, count(*) parts, sum(case when status = 'PASS' then 1 else 0 end)::bigint good, sum(cycle_ms)::bigint run, sum(down_ms)::bigint down, sum(blocked_ms)::bigint blocked, sum(starved_ms)::bigint starved,
    min(cycle_ms) min_ms, min(ts_end_ms) first_ts, max(ts_end_ms) last_ts from {source} where cycle_ms > 0 group by station) s left join base i on i.station = s.station))"""


def _policy(rise: str, sigma: str, extra: str = "", grid: str = "") -> str:
    return f"""select {extra}b.station, speed_setpoint, coalesce(round_even(l.mean - {sigma} * l.sd, 3), torque_lcl) torque_lcl, coalesce(round_even(l.mean + {sigma} * l.sd, 3), torque_ucl) torque_ucl,
  case when slope_per_h > 1e-9 and intercept > 0 and mean_cycle_s > 0 and l.mean is not null
    then greatest(400, least(20000, round_even({rise} * intercept / slope_per_h * 3600 / (case when utilisation > 0 then mean_cycle_s / utilisation else mean_cycle_s end), 0)))::bigint
    else pm_interval_cycles end pm_interval_cycles,
  case when b.station = c.station or lead(b.station) over ({'partition by sigma, target_rise ' if grid else ''}order by b.station) = c.station then greatest(4, least(24, round_even(buffer_capacity * 1.5, 0)))::bigint else buffer_capacity end buffer_capacity,
  ideal_cycle_s
  from {grid}base b cross join (select station from bott order by round(utilisation, 4) desc, station limit 1) c
  left join (select station, round(mean, 4) mean, round(sd, 4) sd from torque) l on l.station = b.station
  left join (select station, round(utilisation, 4) utilisation, round(mean_cycle_s, 3) mean_cycle_s from bott) u on u.station = b.station
  left join slopes s on s.station = b.station"""


CYCLE_ORDER = "ts_end_ms, part_id, cycle_ms, blocked_ms, starved_ms"
FULL_ORDER = f"{CYCLE_ORDER}, down_ms, status"
FIELDS = ["speed_setpoint", "torque_lcl", "torque_ucl", "pm_interval_cycles", "buffer_capacity"]


def _with() -> str:
    return f"""with {adapters.sql_tables()},
limits as ({_limits(3.0, "not (signal = 'torque' and value < 5.0)")}),
torque as (select * from limits where signal = 'torque'),
oee as ({_oee("i.ideal_cycle_s")}),
islands as (select station, blocked_ms, sum(case when blocked_ms > 0 then 0 else 1 end) over (partition by station order by {CYCLE_ORDER} rows unbounded preceding) island from part_events),
runs as (select station, max(n) longest_blocked_run from (select station, island, count(*) filter (blocked_ms > 0) n from islands group by all) group by station),
bott as (select p.station, count(*) cycles, sum(cycle_ms)::double / sum(cycle_ms + blocked_ms + starved_ms) utilisation, sum(blocked_ms + starved_ms) / 1000.0::double idle_s, sum(blocked_ms) / 1000.0::double blocked_s,
  sum(starved_ms) / 1000.0::double starved_s, sum(cycle_ms) / 1000.0::double / count(*) mean_cycle_s, any_value(r.longest_blocked_run) longest_blocked_run from part_events p join runs r on r.station = p.station group by p.station),
stops as (select station, ts_ms + duration_ms fresh from maintenance where ts_ms + duration_ms >= 0),
aged as (select t.*, s.fresh from telemetry t asof join stops s on t.station = s.station and t.ts_ms >= s.fresh),
curve as (select station, bucket * 1800 / 3600.0::double age_h, count(*) n, avg(value) mean, coalesce(stddev_samp(value), 0) sd
  from (select station, value, (ts_ms - fresh) // 1000 // 1800 bucket from aged where signal = 'torque' and not value < 5.0) group by station, bucket),
fitted as (select * exclude fullest from (select *, max(n) over (partition by station) fullest from curve) where n >= 0.2 * fullest),
slopes as (select * from (select station, regr_slope(mean, age_h) slope_per_h, regr_intercept(mean, age_h) intercept, count(*) buckets from fitted group by station) where buckets >= 3 and slope_per_h is not null),
scored as (select *, arm || '-' || seed run from part_events where ts_end_ms >= (select min(ts_end_ms) from part_events) + 1000::bigint * {SHIFT}),
run_stops as (select arm || '-' || seed run, station, count(*) filter (event = 'preventive') preventive, count(*) filter (event = 'corrective') corrective from maintenance group by all),
kpi as (select run, station, parts, good, run_ms, down_ms, blocked_ms, starved_ms, blocked_ms + starved_ms idle_ms, ideal_cycle_s, preventive, corrective, round_even(availability, 4) availability, round_even(performance, 4) performance,
  round_even(quality, 4) quality, round_even(availability * performance * quality, 4) oee, round_even(1 - quality, 5) defect_rate, round_even(run_ms::double / (run_ms + blocked_ms + starved_ms), 4) utilisation,
  round_even(run_ms / 1000.0::double / parts, 3) mean_cycle_s from (
  select k.*, i.ideal_cycle_s, coalesce(m.preventive, 0) preventive, coalesce(m.corrective, 0) corrective, greatest(0.0, 6000.0::double * {SHIFT} - down_ms) / (6000.0::double * {SHIFT}) availability,
    least(1.0, i.ideal_cycle_s * 1000 * parts / run_ms) performance, good::double / parts quality from (
    select run, station, count(*) parts, sum(case when status = 'PASS' then 1 else 0 end)::bigint good, sum(cycle_ms)::bigint run_ms, sum(down_ms)::bigint down_ms, sum(blocked_ms)::bigint blocked_ms, sum(starved_ms)::bigint starved_ms
    from scored group by all) k join base i on i.station = k.station left join run_stops m on m.run = k.run and m.station = k.station)),
line as (select run, max_by(good, station) throughput_good_parts, round_even(max_by(good, station) * 10 / 6000.0::double, 0) / 10 throughput_per_day, round_even(sum(round(oee * 10000, 0)) / count(*), 0) / 10000 line_oee, round_even(sum(down_ms) / 36000.0::double, 0) / 100 total_downtime_h,
  min_by(station, (idle_ms, station)) bottleneck_by_ground_truth from kpi group by run),
pairs as (select a.metric, a.v a, b.v b from (select run[1] arm, run[3:] seed, metric, v from (unpivot (select run, throughput_good_parts::double throughput_good_parts, total_downtime_h, line_oee from line) on throughput_good_parts, total_downtime_h, line_oee into name metric value v)) a
  join (select run[1] arm, run[3:] seed, metric, v from (unpivot (select run, throughput_good_parts::double throughput_good_parts, total_downtime_h, line_oee from line) on throughput_good_parts, total_downtime_h, line_oee into name metric value v)) b
  on a.seed = b.seed and a.metric = b.metric and a.arm = 'A' and b.arm = 'B'),
ci as (select metric, count(*) n, avg(a) a_mean, avg(b) b_mean, avg(b - a) delta_mean, case when count(*) < 2 then 0 else 1.96 * stddev_samp(b - a) / sqrt(count(*)) end delta_ci95,
  case when avg(a) <> 0 then avg(b - a) / avg(a) * 100 else 0 end delta_pct from pairs group by metric),
policy_b as ({_policy("0.15", "3.0")}),
diff as (select coalesce(a.station, b.station) station, coalesce(a.field, b.field) field, a.v "A", b.v "B", a.v is distinct from b.v changed from
  (unpivot (select station, {', '.join(f'{f}::double {f}' for f in FIELDS)} from base) on {', '.join(FIELDS)} into name field value v) a full join
  (unpivot (select station, {', '.join(f'{f}::double {f}' for f in FIELDS)} from policy_b) on {', '.join(FIELDS)} into name field value v) b on a.station = b.station and a.field = b.field),
split as (select station, state, secs / total as share, secs / 3600 as hours from (select station, cycles * mean_cycle_s + blocked_s + starved_s total,
  unnest(['busy', 'blocked', 'starved']) state, unnest([cycles * mean_cycle_s, blocked_s, starved_s]) as secs from bott)),
fields as (select value line, string_split(value, ',') f from raw_lines),
event_fields as (select value line, string_split(value, ',') f from event_lines),
log_fields as (select value line, string_split(value, ',') f from log_lines)
"""


OEE_COLUMNS = "station, parts, good, round(oee, 4) oee, round(availability, 4) availability, round(performance, 4) performance, round(quality, 4) quality, round(defect_rate, 5) defect_rate, ideal_cycle_s, ideal_configured, min_cycle_s, down_s, blocked_s, starved_s"
LIMIT_COLUMNS = 'station, signal, n, round(mean, 4) mean, round(sd, 4) sd, round(lcl, 4) lcl, round(ucl, 4) ucl, mn "min", mx "max"'
CLASS_REPORT = """select class, n, case when kept + other > 0 then round(100.0::double * other / (kept + other), 3) end other_signal_pct from (select class, count(*) n from c group by class)
  cross join (select count(*) filter (class = 'FILTERED_OTHER_SIGNAL') other, count(*) filter (class in ('KEPT', 'JOINED')) kept from c)"""


#: The first time of the chunk of 90 days from which cycles count as new.
NEW_MS = 118 * 90 * 86_400_000
HELD = f"""select *, coalesce(nth - breach_nth <= 40 and (stop_nth is null or stop_nth <= breach_nth), false) derated from (
  select *, max(case when cycle_ms >= 17600 then nth end) over w breach_nth, max(case when down_ms > 0 then nth end) over w stop_nth from (
  select *, row_number() over (partition by station order by {FULL_ORDER}) nth from part_events) window w as (partition by station order by nth rows between unbounded preceding and 1 preceding))"""
#: Lines with their class, as each job sees them.
CLASSES = {
    "oee": "select f, case when starts_with(line, 'ts_end_ms') then 'HEADER' when len(f) >= 8 and f[2] <> '' and try_cast(f[4] as bigint) > 0 then 'PARSED' else 'MALFORMED' end class from event_fields",
    "bottleneck": "select f, case when len(f) >= 8 and f[2] <> '' and try_cast(f[4] as bigint) is not null then 'PARSED' else 'MALFORMED' end class from event_fields where not starts_with(line, 'ts_end_ms')",
    "limits": """select f, case when starts_with(line, 'ts_ms') then 'HEADER' when len(f) < 4 or trim(f[2]) = '' then 'MALFORMED' when trim(f[3]) <> 'torque' then 'FILTERED_OTHER_SIGNAL'
  when try_cast(trim(f[4]) as double) is null then 'MALFORMED' when try_cast(trim(f[4]) as double) < 5.0 then 'FILTERED_NOT_RUNNING' else 'KEPT' end class from fields""",
    "degradation": """select f, case when len(f) < 4 then 'MALFORMED' when trim(f[3]) <> 'torque' then 'FILTERED_OTHER_SIGNAL' when try_cast(trim(f[1]) as bigint) is null or try_cast(trim(f[4]) as double) is null then 'MALFORMED'
  when try_cast(trim(f[4]) as double) < 5.0 then 'FILTERED_NOT_RUNNING' when first_fresh is null or try_cast(trim(f[1]) as bigint) < first_fresh then 'NO_MAINTENANCE_YET' else 'JOINED' end class
  from fields left join (select station, min(fresh) first_fresh from stops group by station) s on s.station = trim(f[2]) where not starts_with(line, 'ts_ms')""",
}


def oracle_sql() -> dict[str, str]:
    tables = _with()
    asof = "select ts_ms, station, signal, value, fresh from aged"
    stopped = "select t.ts_ms, t.station, t.signal, t.value, exists (select 1 from maintenance m where m.station = t.station and t.ts_ms >= m.ts_ms and t.ts_ms < m.ts_ms + m.duration_ms) stopped from telemetry t"
    bias = lambda kind, where: f"""(select station, case when count(*) >= 3 then regr_slope(mean, age_h) end slope from (select *, max(n) over (partition by station) fullest from (
      select station, (ts_ms - fresh) // 1000 // 1800 * 1800 / 3600.0::double age_h, count(*) n, avg(value) mean from aged where signal = 'torque' and {where} group by all)) where n >= 0.2 * fullest group by station) {kind}"""  # noqa: E731
    selects = {
        "control_limits": f"select {LIMIT_COLUMNS} from limits",
        "control_limits_partials": f"select {LIMIT_COLUMNS} from limits",
        "oee": f"select {OEE_COLUMNS} from oee",
        "oee_partials": f"select {OEE_COLUMNS} from oee",
        "oee_fallback_ideal": f"select {OEE_COLUMNS} from ({_oee("nullif(case when i.station = 'S05' then 0.0 else i.ideal_cycle_s end, 0.0)")})",
        "bottleneck": "select station, cycles, round(utilisation, 4) utilisation, round(idle_s, 1) idle_s, round(blocked_s, 1) blocked_s, round(starved_s, 1) starved_s, round(mean_cycle_s, 3) mean_cycle_s, longest_blocked_run from bott",
        "longest_blocked_run": "select * from runs",
        "longest_blocked_run_chunked": "select * from runs",
        "asof_maintenance": asof,
        "asof_maintenance_large": asof,
        "degradation": "select station, round(age_h, 2) age_h, n, round(mean, 4) mean, round(sd, 4) sd from curve",
        "fitted_buckets": "select station, round(age_h, 2) age_h, n, round(mean, 4) mean, round(sd, 4) sd from fitted",
        "degradation_slopes": "select station, round(slope_per_h, 4) slope_per_h, round(intercept, 3) intercept, buckets from slopes",
        "degradation_points": "select c.station, round(age_h, 2) age_h, n, round(mean, 4) mean_torque, round(sd, 4) sd, round((mean / nullif(intercept, 0) - 1) * 100, 2) rise_pct from curve c left join slopes s on s.station = c.station",
        "find_fastest_wear": "select station, round(slope_per_h, 4) slope_per_h from slopes order by slopes.slope_per_h desc, station limit 1",
        "label_stopped": stopped,
        "label_stopped_large": stopped,
        "attach_cycle": """select t.ts_ms, t.station, t.value, coalesce(p.ts_end_ms, (select max(ts_ms) from telemetry x where x.signal = 'motor_temp' and x.station = t.station)) cycle_end_ms from (select * from telemetry where signal = 'torque') t
  asof left join (select distinct ts_ms ts_end_ms, station from telemetry where signal = 'motor_temp') p on t.station = p.station and t.ts_ms <= p.ts_end_ms""",
        "cycles_since_maintenance": f"""select station, (case when stops > 0 then nth - 1 else nth end)::bigint since, count(*) n, sum(cycle_ms)::bigint cycle_ms, sum(part_id)::bigint part_ids from (
  select *, row_number() over (partition by station, stops order by {FULL_ORDER}) nth from (select *, sum(case when down_ms > 0 then 1 else 0 end) over (partition by station order by {FULL_ORDER} rows unbounded preceding) stops from part_events)) group by 1, 2""",
        "spc_derate": f"""select station, derated, count(*) n, sum(nth)::bigint places, sum(part_id)::bigint part_ids from (select *, coalesce(nth - breach_nth <= 40 and (stop_nth is null or stop_nth <= breach_nth), false) derated from (
  select *, max(case when cycle_ms >= 17600 then nth end) over w breach_nth, max(case when down_ms > 0 then nth end) over w stop_nth from (
  select *, row_number() over (partition by station order by {FULL_ORDER}) nth from part_events) window w as (partition by station order by nth rows between unbounded preceding and 1 preceding))) group by 1, 2""",
        "station_kpis": "select * from kpi",
        "line_kpis": "select * from line",
        "paired_ci": "select metric, n, round(a_mean, 6) a_mean, round(b_mean, 6) b_mean, round(delta_mean, 6) delta_mean, round(delta_ci95, 5) delta_ci95, round(delta_pct, 4) delta_pct from ci",
        "ab_table": """select metric, case metric when 'throughput_good_parts' then 'throughput (good parts)' when 'total_downtime_h' then 'maintenance downtime (h)' else 'line OEE' end "label",
  case metric when 'total_downtime_h' then 'lower' else 'higher' end direction, round(round_even(a_mean, 4), 3) a_mean, round(round_even(b_mean, 4), 3) b_mean, round(round_even(delta_mean, 4), 3) delta_mean, round(round_even(delta_ci95, 4), 3) delta_ci95,
  round(round_even(delta_pct, 3), 2) delta_pct, round(case when round_even(a_mean, 4) <> 0 then round_even(delta_ci95, 4) / round_even(a_mean, 4) * 100 else 0 end, 2) ci_pct, abs(delta_mean) > delta_ci95 significant,
  case when not abs(delta_mean) > delta_ci95 then 'no effect' when (delta_mean > 0) = (metric <> 'total_downtime_h') then 'B better' else 'B WORSE' end verdict from ci""",
        "find_constraint": "select station, round(utilisation, 4) utilisation from bott order by round(bott.utilisation, 4) desc, station limit 1",
        "station_table": """select b.station, round(oee, 4) oee, round(availability, 4) availability, round(performance, 4) performance, round(quality, 4) quality, round(defect_rate, 5) defect_rate, round(utilisation, 4) utilisation, round(mean_cycle_s, 3) mean_cycle_s,
  round(u.blocked_s, 1) blocked_s, round(u.starved_s, 1) starved_s, round(mean, 4) torque_mean, round(sd, 4) torque_sd, round(slope_per_h, 4) slope_per_h, round(intercept, 3) fresh_torque
  from base b left join oee o on o.station = b.station left join bott u on u.station = b.station left join torque l on l.station = b.station left join slopes s on s.station = b.station""",
        "time_split": "select station, state, round(share, 4) share, round(hours, 3) as hours from split",
        "pivot_time_split": "select station, round(max(share) filter (state = 'busy'), 4) busy, round(max(share) filter (state = 'blocked'), 4) blocked, round(max(share) filter (state = 'starved'), 4) starved from split group by station",
        "melt_oee": "select station, unnest(['availability', 'performance', 'quality']) factor, round(unnest([availability, performance, quality]), 4) \"value\" from oee",
        "synthesise_policy": "select * replace (round(torque_lcl, 2) as torque_lcl, round(torque_ucl, 2) as torque_ucl) from policy_b",
        "policy_grid": f"select * replace (round(torque_lcl, 2) as torque_lcl, round(torque_ucl, 2) as torque_ucl) from ({_policy('target_rise', 'sigma', 'sigma, target_rise, ', '(select unnest([2.0, 3.0])::double sigma) cross join (select unnest([0.1, 0.15, 0.2])::double target_rise) cross join ')})",
        "policy_diff": 'select station, field, round("A", 2) "A", round("B", 2) "B", changed from diff',
        "pivot_policy": "select station, " + ", ".join((f"round(max(\"B\") filter (field = '{f}'), 2) {f}" if "torque" in f else f"max(\"B\") filter (field = '{f}') {f}") for f in FIELDS) + " from diff group by station",
        "stack_policies": "select 'A' \"policy\", station, round(torque_lcl, 2) torque_lcl, round(torque_ucl, 2) torque_ucl from base union all select 'B', station, round(torque_lcl, 2), round(torque_ucl, 2) from policy_b",
        "validate_kpis": f"""select m.station, m.metric, round(m.v, 4) mined, round(t.v, 4) truth, abs(m.v - t.v) < 5e-4 "matches" from
  (select station, unnest(['oee', 'availability', 'performance', 'quality']) metric, unnest([oee, availability, performance, quality]) v from oee) m join
  (select station, unnest(['oee', 'availability', 'performance', 'quality']) metric, unnest([round_even(a * p * q, 4), round_even(a, 4), round_even(p, 4), round_even(q, 4)]) v from (
    select o.station, greatest(0.0, 18000.0::double * {SHIFT} - o.down_s * 1000) / (18000.0::double * {SHIFT}) a, performance p, quality q from oee o)) t on t.station = m.station and t.metric = m.metric""",
        "diff_outputs": """select station, cycle_ms, blocked_ms, status, case when d > 0 then 'A' else 'B' end side, abs(d)::bigint n from (
  select station, cycle_ms, blocked_ms, status, sum(case when arm = 'A' then 1 else -1 end) d from part_events group by all) where d <> 0""",
        "filter_bias": f"""select x.station, round(sd_running, 4) sd_running, round(sd_all, 4) sd_all, round(r.slope, 4) slope_running, round(a.slope, 4) slope_all, round(a.slope / nullif(r.slope, 0), 2) slope_ratio from (
  select station, coalesce(stddev_samp(value) filter (not value < 5.0), 0) sd_running, coalesce(stddev_samp(value), 0) sd_all from aged where signal = 'torque' group by station) x
  left join {bias('r', 'not value < 5.0')} on r.station = x.station left join {bias('a', 'true')} on a.station = x.station""",
        "count_per_station": """select case when len(f) >= 4 and f[2] <> '' then f[2] end station, count(*) filter (len(f) >= 4 and f[2] <> '') records, count(*) filter (not (len(f) >= 4 and f[2] <> '')) malformed
  from fields where not starts_with(line, 'timestamp') group by 1""",
        "quality_report": f"""select * from (with c as (select case when starts_with(line, 'ts_ms') then 'HEADER' when len(f) < 4 or trim(f[2]) = '' then 'MALFORMED' when trim(f[3]) <> 'torque' then 'FILTERED_OTHER_SIGNAL'
  when try_cast(trim(f[4]) as double) is null then 'MALFORMED' when try_cast(trim(f[4]) as double) < 5.0 then 'FILTERED_NOT_RUNNING' else 'KEPT' end class from fields) {CLASS_REPORT})""",
        "quality_degradation": f"""select * from (with c as (select case when len(f) < 4 then 'MALFORMED' when trim(f[3]) <> 'torque' then 'FILTERED_OTHER_SIGNAL' when try_cast(trim(f[1]) as bigint) is null or try_cast(trim(f[4]) as double) is null then 'MALFORMED'
  when try_cast(trim(f[4]) as double) < 5.0 then 'FILTERED_NOT_RUNNING' when first_fresh is null or try_cast(trim(f[1]) as bigint) < first_fresh then 'NO_MAINTENANCE_YET' else 'JOINED' end class
  from fields left join (select station, min(fresh) first_fresh from stops group by station) s on s.station = trim(f[2]) where not starts_with(line, 'ts_ms')) {CLASS_REPORT})""",
        "assign_shift_day": f"select (date '2024-01-01' + least(59199, ts_ms // {SHIFT})::int)::varchar dt, station, count(*) n from telemetry group by all",
        "score_window": "select arm, seed, station, count(*) n, min(ts_end_ms) first_ms from scored group by all",
        "kv_round_trip": "select station, parts::double parts, good::double good, round(oee, 4) oee, round(quality, 4) quality, round(min_cycle_s, 3) min_cycle_s, round(down_s, 1) down_s from oee",
        "breach_counts": f"""select t.station, t.signal, ts_ms // 3600000 * 3600000 window_start_ms, count(*) samples, count(*) filter (t.value > l.ucl) breaches from telemetry t join ({_limits(1.0, 'true')}) l
  on l.station = t.station and l.signal = t.signal group by all""",
        "read_telemetry": """select try_cast(trim(f[1]) as bigint) ts_ms, trim(f[2]) station, trim(f[3]) signal, try_cast(trim(f[4]) as double) "value" from fields
  where len(f) >= 4 and try_cast(trim(f[1]) as bigint) is not null and trim(f[2]) <> '' and try_cast(trim(f[4]) as double) is not null""",
        "read_part_events": """select ts_end_ms, station, part_id, cycle_ms, blocked_ms, starved_ms, down_ms, status, defect_code from (
  select try_cast(f[1] as bigint) ts_end_ms, f[2] station, try_cast(f[3] as bigint) part_id, try_cast(f[4] as bigint) cycle_ms, try_cast(f[5] as bigint) blocked_ms, try_cast(f[6] as bigint) starved_ms, try_cast(f[7] as bigint) down_ms,
    f[8] status, coalesce(f[9], '') defect_code, len(f) n from event_fields) where n >= 8 and station <> '' and ts_end_ms is not null and cycle_ms is not null""",
        "read_maintenance": "select try_cast(f[1] as bigint) ts_ms, f[2] station, f[3] event, try_cast(f[4] as bigint) duration_ms from log_fields where len(f) >= 4 and try_cast(f[1] as bigint) is not null",
        "maintenance_log": "select ts_ms, station, event, duration_ms from maintenance order by all",
        "policy_round_trip": "select 'B-mined' policy_id, 'mined: control limits at 3 sigma, maintenance at a rise of 15%, buffers around the constraint' provenance, * replace (round(torque_lcl, 2) as torque_lcl, round(torque_ucl, 2) as torque_ucl) from policy_b",
        "missing_stations": "select distinct station from part_events where station >= 'S05'",
        "ingest_runs": """select run, (date_trunc('month', date '1970-01-01' + (ts_ms // 86400000)::int))::date::varchar dt, station, count(*) n, min(ts_ms) first_ms
  from (select 'a' run, * from telemetry where signal = 'vibration' union all select 'b', * from telemetry) group by all""",
        "summary_round_trip": "select metric, n, round(a_mean, 6) a_mean, round(b_mean, 6) b_mean, round(delta_mean, 6) delta_mean, round(delta_ci95, 5) delta_ci95, round(delta_pct, 4) delta_pct from ci",
        "classify_oee": "select class, count(*) n, null::double other_signal_pct from (select case when starts_with(line, 'ts_end_ms') then 'HEADER' when len(f) >= 8 and f[2] <> '' and try_cast(f[4] as bigint) > 0 then 'PARSED' else 'MALFORMED' end class from event_fields) group by class",
        "classify_bottleneck": "select class, count(*) n, null::double other_signal_pct from (select case when len(f) >= 8 and f[2] <> '' and try_cast(f[4] as bigint) is not null then 'PARSED' else 'MALFORMED' end class from event_fields where not starts_with(line, 'ts_end_ms')) group by class",
        "kv_bottleneck": "select station, cycles::double cycles, round(utilisation, 4) utilisation, round(idle_s, 1) idle_s, round(blocked_s, 1) blocked_s, round(starved_s, 1) starved_s, round(mean_cycle_s, 3) mean_cycle_s, longest_blocked_run::double longest_blocked_run from bott",
        "kv_limits": 'select station, signal, n::double n, round(mean, 4) mean, round(sd, 4) sd, round(lcl, 4) lcl, round(ucl, 4) ucl, round(mn, 4) "min", round(mx, 4) "max" from limits',
        "kv_degradation": "select station, round(age_h, 2) age_h, n::double n, round(mean, 4) mean, round(sd, 4) sd from curve",
        "curve_ordered": "select station, round(age_h, 2) age_h, n, round(mean, 4) mean, round(sd, 4) sd from curve order by station, curve.age_h",
        "shares_ordered": "select station, state, round(share, 4) share, round(hours, 3) as hours from split order by station, state",
        "spc_derate_limits": f"""select station, derated, breach, count(*) n, sum(nth)::bigint places, sum(part_id)::bigint part_ids from (select *, coalesce(nth - breach_nth <= 5 and (stop_nth is null or stop_nth <= breach_nth), false) derated from (
  select *, max(case when breach then nth end) over w breach_nth, max(case when down_ms > 0 then nth end) over w stop_nth from (
  select *, cycle_ms / 1000.0::double > ucl breach, row_number() over (partition by station order by {FULL_ORDER}) nth from part_events join (
    select station, round(avg(cycle_ms / 1000.0::double) + stddev_samp(cycle_ms / 1000.0::double), 2) ucl from part_events group by station) using (station)) window w as (partition by station order by nth rows between unbounded preceding and 1 preceding))) group by 1, 2, 3""",
        "oee_rollup": f"select {OEE_COLUMNS} from oee",
        "limits_rollup": f"select {LIMIT_COLUMNS} from limits",
        "slopes_rollup": "select station, round(slope_per_h, 4) slope_per_h, round(intercept, 3) intercept, buckets from slopes",
        "bottleneck_stored": "select station, cycles, round(utilisation, 4) utilisation, round(idle_s, 1) idle_s, round(blocked_s, 1) blocked_s, round(starved_s, 1) starved_s, round(mean_cycle_s, 3) mean_cycle_s, longest_blocked_run from bott",
        "since_stored": f"""select station, (case when stops > 0 then nth - 1 else nth end)::bigint since, count(*) n, sum(part_id)::bigint part_ids from (
  select *, row_number() over (partition by station, stops order by {FULL_ORDER}) nth from (select *, sum(case when down_ms > 0 then 1 else 0 end) over (partition by station order by {FULL_ORDER} rows unbounded preceding) stops from part_events))
  where ts_end_ms >= {NEW_MS} group by 1, 2""",
        "derate_stored": f"select station, derated, count(*) n, sum(nth)::bigint places, sum(part_id)::bigint part_ids from ({HELD}) where ts_end_ms >= {NEW_MS} group by 1, 2",
        "diff_fingerprints": """select part_id, station, cycle_ms, status, arm, case when d > 0 then 'A' else 'B' end side, abs(d)::bigint n from (
  select part_id, station, cycle_ms, status, arm, sum(d) d from (select *, 1 d from part_events union all select *, -1 from part_events where part_id % 500 <> 0 union all select *, -1 from part_events where part_id % 700 = 0) group by all) where d <> 0""",
        "mined_counts": f"""select job, class, n, results, round(total, 3) total from (
  select 'oee' job, class, count(*) n from ({CLASSES["oee"]}) group by class union all select 'bottleneck', class, count(*) from ({CLASSES["bottleneck"]}) group by class
  union all select 'limits', class, count(*) from ({CLASSES["limits"]}) group by class union all select 'degradation', class, count(*) from ({CLASSES["degradation"]}) group by class) join (
  select 'oee' job, count(*) results, sum(x)::double total from (select f[2], count(*) filter (f[8] = 'PASS') x from ({CLASSES["oee"]}) where class = 'PARSED' group by f[2])
  union all select 'bottleneck', count(*), sum(x)::double from (select station, max(n) x from (select station, island, count(*) filter (blocked_ms > 0) n from (
    select *, sum(case when blocked_ms > 0 then 0 else 1 end) over (partition by station order by {CYCLE_ORDER} rows unbounded preceding) island from (
    select f[2] station, f[1]::bigint ts_end_ms, f[3]::bigint part_id, f[4]::bigint cycle_ms, f[5]::bigint blocked_ms, f[6]::bigint starved_ms from ({CLASSES["bottleneck"]}) where class = 'PARSED')) group by all) group by station)
  union all select 'limits', count(*), sum(x) from (select avg(f[4]::double) x from ({CLASSES["limits"]}) where class = 'KEPT' group by f[2])
  union all select 'degradation', count(*), sum(x) from (select avg(v) x from (select t.station, t.v, (t.ts_ms - s.fresh) // 1000 // 1800 bucket from (
    select f[2] station, f[1]::bigint ts_ms, f[4]::double v from ({CLASSES["degradation"]}) where class = 'JOINED') t asof join stops s on t.station = s.station and t.ts_ms >= s.fresh) group by station, bucket)) using (job)""",
        "ingest_days": """select 'a' run, dt, station, count(*) n, min(ts_ms) first_ms from (select *, (date '1970-01-01' + (ts_ms // 86400000)::int)::varchar dt from telemetry)
  where dt <> '2024-01-15' or station = 'S02' group by all""",
        "score_stored": """select arm run, station, count(*) n, min(ts_end_ms) first_ms from (select *, date_trunc('quarter', date '1970-01-01' + (ts_end_ms // 86400000)::int) dt from part_events)
  where dt >= case when arm = 'A' then date '1996-04-01' else date '2000-01-01' end group by all""",
        "breach_stream": f"""select t.station, t.signal, ts_ms // 3600000 * 3600000 window_start_ms, count(*) samples, count(*) filter (t.value > l.ucl) breaches from (
    select *, min(ts_ms) over () low, (max(ts_ms) over () - min(ts_ms) over ()) // 3 + 1 step from telemetry) t join ({_limits(1.0, 'true')}) l
  on l.station = t.station and l.signal = t.signal where not (ts_ms < low + step // 2 and floor(t.value) % 5 = 0) group by all""",
        "derate_stream": f"select station, derated, count(*) n, sum(part_id)::bigint part_ids from ({HELD}) group by 1, 2",
    }
    return {name: tables + text for name, text in selects.items()}
