"""Schemas of the line's tables; all times are milliseconds of the production clock."""

TELEMETRY = "ts_ms long, station string, signal string, value double"
PART_EVENTS = "ts_end_ms long, station string, part_id long, cycle_ms long, blocked_ms long, starved_ms long, down_ms long, status string, defect_code string"
MAINTENANCE = "ts_ms long, station string, event string, duration_ms long"
POLICY_STATION = "speed_setpoint double, torque_lcl double, torque_ucl double, pm_interval_cycles long, buffer_capacity long, ideal_cycle_s double"
POLICY = f"policy_id string, provenance string, stations map<string, struct<{POLICY_STATION.replace(' double', ':double').replace(' long', ':long')}>>"
POLICY_FIELDS = ["speed_setpoint", "torque_lcl", "torque_ucl", "pm_interval_cycles", "buffer_capacity", "ideal_cycle_s"]

SIGNALS = ["torque", "motor_temp", "vibration", "spindle_load"]
#: A production day is one shift of eight hours on the clock.
SHIFT_MS = 8 * 3600 * 1000
#: Order of a station's cycles where end times tie.
CYCLE_ORDER = ["ts_end_ms", "part_id", "cycle_ms", "blocked_ms", "starved_ms"]
