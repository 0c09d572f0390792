"""The study's queries in DuckDB's SQL, written from the rules and not from the operators."""

from __future__ import annotations

from concord.functions.rules import CURRENT, EXPANDED, LAT_COMPAT, LAT_EXECUTIONS, LONG_COMPAT, LONG_EXECUTIONS, STRICT, RuleSet
from concord.plans.fixtures import PHRASES

_SAMPLE, _SEED = 400, 99


def _quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _classified(name: str, rules: RuleSet) -> dict[str, str]:
    """Each phrase of the bank classified, then dealt to the clips."""
    axes = {"long": rules.longitudinal, "lat": rules.lateral}
    counts = [f"coalesce({' + '.join(f"len(regexp_extract_all(cot_text, {_quoted('(?i)' + p)}))" for p in patterns)}, 0)::BIGINT AS n_{c}" for a in axes.values() for c, patterns in a.items()]

    def win(classes: list[str]) -> str:
        best = f"greatest({', '.join('n_' + c for c in classes)})"
        return f"CASE WHEN {best} = 0 THEN 'unspecified' " + " ".join(f"WHEN n_{c} = {best} THEN '{c}'" for c in classes) + " END"

    long, lat = list(axes["long"]), list(axes["lat"])
    every = [f"n_{c}" for c in long + lat]
    return {
        f"{name}_bank": f"SELECT *, {win(long)} AS long_intent, {win(lat)} AS lat_intent, coalesce(greatest({', '.join(every)}) / nullif(({' + '.join(every)})::DOUBLE, 0), 0.0) AS confidence FROM (SELECT num, cot_text, {', '.join(counts)} FROM bank)",
        f"{name}_text": f"SELECT o.clip_id, b.* FROM o JOIN {name}_bank b ON b.num = (ok * 5 + ck) % 24",
    }


def _matrix(axis: str, cells: dict[str, tuple[float, ...]], executions: tuple[str, ...]) -> str:
    rows = ", ".join(f"('{i}', '{e}', {v}::DOUBLE)" for i, values in cells.items() for e, v in zip(executions, values))
    return f"SELECT * FROM (VALUES {rows}) AS t({axis}_intent, {axis}_execution, {axis}_compat)"


def _scored(source: str) -> str:
    """Scores of rows (intents and executions)."""
    return f"""
SELECT *, CASE WHEN long_intent = 'unspecified' AND lat_intent = 'unspecified' THEN 'unclassified_intent' WHEN mismatch_score < 0.3::DOUBLE THEN 'consistent'
  WHEN mismatch_score < 0.6::DOUBLE THEN 'partial_mismatch' ELSE 'severe_mismatch' END AS mismatch_type FROM (
SELECT s.*, coalesce(long_compat, 0.5::DOUBLE) AS long_match, coalesce(lat_compat, 0.5::DOUBLE) AS lat_match,
  round(1 - CASE WHEN long_compat IS NOT NULL AND lat_compat IS NOT NULL THEN 0.5::DOUBLE * long_compat + 0.5::DOUBLE * lat_compat
    ELSE coalesce(long_compat, lat_compat, 0.5::DOUBLE) END, 3) AS mismatch_score
FROM {source} s LEFT JOIN lm USING (long_intent, long_execution) LEFT JOIN tm USING (lat_intent, lat_execution))"""


def _features(way: str) -> str:
    return f"""
SELECT clip_id, count(*) AS n_steps, coalesce(min_by(speed, step) FILTER (speed IS NOT NULL), 0.0) AS initial_speed, coalesce(max_by(speed, step) FILTER (speed IS NOT NULL), 0.0) AS final_speed,
  coalesce(avg(speed), 0.0) AS mean_speed, coalesce(avg(accel), 0.0) AS mean_acceleration, max_by(y, step) - min_by(y, step) AS total_lateral_shift,
  max(abs(y - y0)) AS max_lateral_deviation, coalesce(sum(distance), 0.0) AS total_distance
FROM (SELECT *, (speed - lag(speed) OVER w) / 0.1::DOUBLE AS accel FROM (
  SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS distance, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / 0.1::DOUBLE AS speed, first_value(y) OVER w AS y0
  FROM {way} WINDOW w AS (PARTITION BY clip_id ORDER BY step)) WINDOW w AS (PARTITION BY clip_id ORDER BY step)) GROUP BY clip_id"""


_LAT = "CASE WHEN abs({0}) > 1.5 THEN CASE WHEN {0} > 0 THEN 'lane_change_left' ELSE 'lane_change_right' END WHEN abs({0}) > 0.2 THEN CASE WHEN {0} > 0 THEN 'shift_left' ELSE 'shift_right' END ELSE 'straight' END"
_LONG = "CASE WHEN final_speed < 0.5 THEN 'stopped' WHEN mean_acceleration > 0.3 THEN 'accelerating' WHEN mean_acceleration < -0.3 THEN 'decelerating' ELSE 'constant_speed' END"
_BUCKET = "CASE WHEN hour_of_day >= 0 AND hour_of_day < 7 THEN 'night' WHEN hour_of_day >= 7 AND hour_of_day < 11 THEN 'morning' WHEN hour_of_day >= 11 AND hour_of_day < 15 THEN 'midday' WHEN hour_of_day >= 15 AND hour_of_day < 19 THEN 'afternoon' WHEN hour_of_day >= 19 AND hour_of_day < 24 THEN 'evening' END"
_BAND = "CASE WHEN {0} < 0.3 THEN 'consistent' WHEN {0} < 0.6 THEN 'partial' ELSE 'severe' END"
_T0 = f"2000000 + ('0x' || substr(md5('{_SEED}|' || clip_id), 1, 8))::BIGINT % 11000000"
_XY = "(ck % 8) * 2.0::DOUBLE * (i * 0.1::DOUBLE) + 0.5::DOUBLE * ((ok % 7 - 3) * 0.21::DOUBLE) * (i * 0.1::DOUBLE) * (i * 0.1::DOUBLE)", "(ok % 11 - 5) * 0.4::DOUBLE * (i / 63.0::DOUBLE)"
_STEPS = "(SELECT o.*, i::INT AS step, i::DOUBLE AS i FROM o, range(64) AS r(i))"
_REGIME = "CASE WHEN mean_speed_ms < 5 THEN 'slow' WHEN mean_speed_ms < 15 THEN 'medium' ELSE 'fast' END"


def _r(*columns: str) -> str:
    """Rounded, without negative zeros."""
    return ", ".join(f"round({c.partition(' AS ')[0]}, 6) + 0.0::DOUBLE AS {c.rpartition(' AS ')[2] if ' AS ' in c else c}" for c in columns)


def _truth(name: str, errors: bool) -> str:
    gone = "WHERE NOT (ok % 101 = 0 AND step = 63)" if errors else ""
    return f"SELECT clip_id, step, {_XY[0]} + (ok % 4) * 0.02::DOUBLE * i AS x, {_XY[1]} - (ok % 5) * 0.01::DOUBLE * i AS y FROM {_STEPS} {gone}"


def _ade(way: str, truth: str) -> str:
    return f"SELECT p.clip_id, avg(sqrt((p.x - g.x) ** 2 + (p.y - g.y) ** 2)) AS ade_meters, count(*) AS n_joined FROM {way} p JOIN {truth} g USING (clip_id, step) GROUP BY p.clip_id"


_MD5 = "md5('{0}|' || clip_id), clip_id"

CTES: dict[str, str] = {
    "o": "SELECT 'c' || o_orderkey AS clip_id, o_orderkey AS ok, o_custkey AS ck, o_orderdate, o_orderpriority FROM orders",
    "idx": "SELECT clip_id, CASE WHEN ok % 10 < 3 THEN 'test' WHEN ok % 10 = 3 THEN 'val' ELSE 'train' END AS split, ok % 13 <> 0 AS clip_is_valid FROM o",
    "meta": "SELECT clip_id, n_name AS country, month(o_orderdate)::INT AS month, ((ok * 7 + ck) % 25)::INT AS hour_of_day, o_orderpriority AS platform_class FROM o JOIN customer ON ck = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE ok % 17 <> 0",
    "indexed": "SELECT * FROM idx LEFT JOIN meta USING (clip_id)",
    "elig": f"SELECT *, {_BUCKET} AS hour_bucket FROM indexed WHERE split = 'test' AND clip_is_valid",
    "ego": "SELECT clip_id, (ok % 4) * 150000 + i * 1000000 AS ts_us FROM o, range(22) AS r(i) WHERE i <= 19 + ok % 3",
    "cover": "SELECT clip_id, min(ts_us) AS ego_min, max(ts_us) AS ego_max FROM ego GROUP BY clip_id",
    "clips": f"SELECT clip_id, {_T0} AS t0_us, hour_bucket, country, substr(clip_id, 2)::BIGINT AS ord FROM elig",
    "done": "SELECT clip_id FROM clips WHERE ord % 3 = 0",
    "bank": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(p)})" for i, p in enumerate(PHRASES)) + ") AS t(num, cot_text)",
    **_classified("cur", CURRENT),
    **_classified("strict", STRICT),
    **_classified("wide", EXPANDED),
    "lm": _matrix("long", LONG_COMPAT, LONG_EXECUTIONS),
    "tm": _matrix("lat", LAT_COMPAT, LAT_EXECUTIONS),
    "way": f"SELECT clip_id, step, {_XY[0]} AS x, {_XY[1]} AS y FROM {_STEPS}",
    "way_e": f"SELECT clip_id, step, {_XY[0]} AS x, {_XY[1]} AS y FROM {_STEPS} WHERE ok % 103 <> 0",
    "gt": _truth("gt", False),
    "gt_e": _truth("gt_e", True),
    "feat": _features("way"),
    "feat_e": _features("way_e"),
    "cls": f"SELECT *, {_LONG} AS long_execution, {_LAT.format('total_lateral_shift')} AS lat_execution FROM feat",
    "ades": _ade("way", "gt"),
    "ades_e": _ade("way_e", "gt_e"),
    "evw": """SELECT 'u' || user_id || '-' || event_id // 65536 AS clip_id, step::INT AS step, x, y FROM (SELECT user_id, event_id, row_number() OVER w - 1 AS step, sum(value / 100) OVER w AS x, sum((event_id % 3 - 1) * 0.11::DOUBLE) OVER w AS y
  FROM events WINDOW w AS (PARTITION BY user_id, event_id // 65536 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))""",
    "evs": "SELECT *, distance / 0.1::DOUBLE AS speed FROM (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS distance FROM evw WINDOW w AS (PARTITION BY clip_id ORDER BY step))",
    "emb": "SELECT 'v' || vec_id AS clip_id, i::INT - 1 AS step, (i - 1) * 0.1::DOUBLE * (2 + label) AS x, embedding[i]::DOUBLE * 4 AS y FROM embeddings, range(1, 65) AS r(i) WHERE i <= len(embedding)",
    "embf": _features("emb"),
    "arcw": """SELECT clip_id, step, r * sin(u / r) - c * sin(u / r) AS x, r * (1 - cos(u / r)) + c * cos(u / r) AS y FROM (SELECT clip_id, step, u,
  CASE ok % 4 WHEN 0 THEN 30.0::DOUBLE WHEN 1 THEN 50.0 WHEN 2 THEN 200.0 ELSE -50.0 END AS r, CASE WHEN (ok // 4) % 2 = 1 THEN 3.5::DOUBLE * (0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * u / 60.0::DOUBLE)) ELSE 0.0 END AS c
  FROM (SELECT *, 60.0::DOUBLE * i / 63.0::DOUBLE AS u FROM """
    + _STEPS
    + "))",
    "arc1": "SELECT *, theta - lag(theta) OVER (PARTITION BY clip_id ORDER BY step) AS turn FROM (SELECT clip_id, step, y, sqrt(dx ** 2 + dy ** 2) AS s, atan2(dy, dx) AS theta FROM (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM arcw WINDOW w AS (PARTITION BY clip_id ORDER BY step)))",
    "arc2": "SELECT clip_id, sum(s) AS s, sum(turn - 2 * pi() * floor((turn + pi()) / (2 * pi()))) / (sum(s) - (min_by(s, step) FILTER (s IS NOT NULL) + max_by(s, step) FILTER (s IS NOT NULL)) / 2) AS kappa, min_by(s, step) FILTER (s IS NOT NULL) AS s1, min_by(theta, step) FILTER (s IS NOT NULL) AS th, max_by(y, step) - min_by(y, step) AS dy FROM arc1 GROUP BY clip_id",
    "arcs": "SELECT clip_id, dy, dy - CASE WHEN abs(kappa) < 1e-9 THEN s * sin(th - kappa * s1 / 2) ELSE (cos(th - kappa * s1 / 2) - cos(th - kappa * s1 / 2 + kappa * s)) / kappa END AS residual FROM arc2",
    "arcc": f"SELECT clip_id, residual, {_LAT.format('dy')} AS raw_class, {_LAT.format('residual')} AS curve_class FROM arcs",
    "raw": "SELECT c.clip_id, c.t0_us, c.hour_bucket AS scenario_type, t.cot_text, t.long_intent, t.lat_intent, t.confidence, p.long_execution, p.lat_execution, a.ade_meters, p.total_lateral_shift AS lat_shift_m, p.mean_speed AS mean_speed_ms FROM clips c JOIN cur_text t USING (clip_id) JOIN cls p USING (clip_id) JOIN ades a USING (clip_id)",
    "res": _scored("raw"),
    "raw_s": "SELECT c.clip_id, t.cot_text, t.long_intent, t.lat_intent, t.confidence, p.long_execution, p.lat_execution FROM clips c JOIN strict_text t USING (clip_id) JOIN cls p USING (clip_id)",
    "res_s": _scored("raw_s"),
    "raw_w": "SELECT c.clip_id, t.cot_text, t.long_intent, t.lat_intent, t.confidence, p.long_execution, p.lat_execution FROM clips c JOIN wide_text t USING (clip_id) JOIN cls p USING (clip_id)",
    "res_w": _scored("raw_w"),
    "pairs": "SELECT n.*, s.long_intent AS old_long_intent, s.lat_intent AS old_lat_intent, s.mismatch_type AS old_mismatch_type, n.long_intent <> s.long_intent OR n.lat_intent <> s.lat_intent OR n.mismatch_type <> s.mismatch_type AS changed FROM res n JOIN res_s s USING (clip_id)",
    "cand": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hour_bucket ORDER BY {_MD5.format(_SEED)}) AS rk FROM elig WHERE hour_bucket IS NOT NULL) WHERE rk <= {max(1, _SAMPLE * 3 // 5)}",
    "scen": "SELECT clip_id, scenario FROM (SELECT clip_id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY md5('42|' || clip_id || '|' || scenario), clip_id) AS rk FROM meta, (VALUES ('night'), ('clear'), ('rain')) AS s(scenario) WHERE scenario = 'rain' OR scenario = 'night' AND hour_of_day IN (0, 1, 2, 3, 4, 5, 20, 21, 22, 23) OR scenario = 'clear' AND hour_of_day BETWEEN 10 AND 15) WHERE rk <= 100",
    "strata": f"SELECT *, {_REGIME} AS regime, mismatch_score >= 0.6 AS severe FROM res",
}


def _sql(body: str) -> str:
    """body with the definitions that it needs before it."""
    import re

    needed: list[str] = []

    def add(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                add(CTES[name])
                needed.append(name)

    add(body)
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" if needed else "") + body


_RESULT = ("scenario_type", "cot_text", "long_intent", "lat_intent", "long_execution", "lat_execution")
_METRICS = ("mismatch_score", "ade_meters", "long_match", "lat_match")
_MEASURES = ("long_match", "lat_match", "mismatch_score", "confidence", "ade_meters", "lat_shift_m", "mean_speed_ms")
_FEATS = ("initial_speed", "final_speed", "mean_speed", "speed_change", "mean_acceleration", "total_lateral_shift", "max_lateral_deviation", "total_distance")


def _ci(n: str, mean: str, sd: str) -> str:
    return f"{mean} - 1.96 * {sd} / sqrt({n}) AS lo", f"{mean} + 1.96 * {sd} / sqrt({n}) AS hi"


def _counts(rules: dict[str, tuple[str, ...]]) -> str:
    return f"SELECT clip_id, {', '.join('n_' + c for c in rules)} FROM cur_text"


def _severe(source: str, name: str) -> str:
    return f"SELECT '{name}' AS variant, count(*) AS n, 100 * avg((mismatch_score >= 0.6)::INT) AS severe_pct FROM {source}"


def oracle_sql() -> dict[str, str]:
    n_each = _SAMPLE // 5
    drawn = f"SELECT clip_id, {_T0} AS t0_us, hour_bucket, coalesce(country, 'unknown') AS country"
    curve = """SELECT "group", count(*) AS n, 100 * avg((raw_score >= 0.6)::INT) AS severe_raw, 100 * avg((curve_score >= 0.6)::INT) AS severe_curve FROM (
  SELECT unnest(CASE WHEN lat_intent = 'hold_lane' THEN ['all', 'hold_lane'] ELSE ['all'] END) AS "group", raw_score, curve_score FROM both_scores) GROUP BY "group\""""
    q = {
        "clip_metadata_join": "SELECT * FROM indexed",
        "eligible_clips": "SELECT * EXCLUDE (hour_bucket) FROM elig",
        "hour_bucket": f"SELECT clip_id, hour_of_day, {_BUCKET} AS hour_bucket FROM meta",
        "draw_t0": f"SELECT clip_id, {_T0} AS t0_us FROM idx",
        "egomotion_coverage": "SELECT * FROM cover",
        "safe_window": "SELECT * FROM cover WHERE ego_max >= 19500000 AND ego_min <= 300000",
        "scenario_filter": "SELECT clip_id, hour_of_day, hour_of_day IN (0, 1, 2, 3, 4, 5, 20, 21, 22, 23) AS is_night, hour_of_day BETWEEN 10 AND 15 AS is_clear, true AS is_rain FROM meta",
        "stratified_sample": f"{drawn} FROM (SELECT *, row_number() OVER (PARTITION BY hour_bucket ORDER BY {_MD5.format(_SEED)}) AS k FROM elig WHERE hour_bucket IS NOT NULL) WHERE k <= {n_each}",
        "stratified_candidates": "SELECT clip_id, hour_bucket, hour_of_day FROM cand",
        "quota_fill": f"{drawn} FROM (SELECT *, row_number() OVER (PARTITION BY hour_bucket ORDER BY {_MD5.format(_SEED + 2)}) AS k FROM cand WHERE clip_id IN (SELECT clip_id FROM cover WHERE ego_max >= 19500000 AND ego_min <= 300000)) WHERE k <= {n_each}",
        "simple_sample": f"SELECT clip_id, {_T0} AS t0_us, 'all' AS hour_bucket, coalesce(country, 'unknown') AS country FROM elig ORDER BY {_MD5.format(_SEED)} LIMIT {_SAMPLE}",
        "scenario_sample": "SELECT * FROM scen",
        "clip_manifest": "SELECT clip_id, scenario, 'camera_front_wide,egomotion' AS sensors FROM scen",
        "overdrawn_candidates": f"SELECT clip_id, hour_bucket, hour_of_day FROM (SELECT *, row_number() OVER (PARTITION BY hour_bucket ORDER BY {_MD5.format(_SEED)}) AS k FROM elig WHERE hour_bucket IS NOT NULL) WHERE k = 1 ORDER BY {_MD5.format(_SEED + 1)} LIMIT 3",
        "shuffled_order": f"SELECT clip_id, ('0x' || substr(md5('{_SEED}|' || clip_id), 1, 15))::BIGINT AS ord FROM clips",
        "stored_eval_set": "SELECT * FROM clips",
        "normalize_clips": "SELECT clip_id, t0_us, hour_bucket AS scenario_type FROM clips",
        "limit_clips": "SELECT * FROM clips ORDER BY ord LIMIT 250",
        "eval_set_profile": f"SELECT hour_bucket, count(*) AS n, {_r('min(t0_us) / 1e6 AS t0_min_s', 'max(t0_us) / 1e6 AS t0_max_s')} FROM clips GROUP BY hour_bucket",
        "path_inventory": "SELECT split_part(concat_ws('/', source, lang, doc_id), '/', 1) AS top, count(*) AS n_files FROM documents GROUP BY 1",
        "long_counts": _counts(CURRENT.longitudinal),
        "lat_counts": _counts(CURRENT.lateral),
        "text_intent": f"SELECT clip_id, long_intent, lat_intent, {_r('confidence')} FROM cur_text",
        "step_speed": f"SELECT clip_id, step, {_r('distance', 'speed')} FROM evs",
        "step_accel": f"SELECT clip_id, step, {_r('(speed - lag(speed) OVER (PARTITION BY clip_id ORDER BY step)) / 0.1::DOUBLE AS acceleration')} FROM evs",
        "trajectory_features": f"SELECT clip_id, coalesce(n_steps, 0) AS n_steps, {_r(*[f'coalesce({c}, 0.0) AS {c}' for c in _FEATS if c != 'speed_change'], 'coalesce(final_speed - initial_speed, 0.0) AS speed_change')} FROM idx LEFT JOIN feat_e USING (clip_id)",
        "exec_class": "SELECT clip_id, long_execution, lat_execution FROM cls",
        "exec_class_packed": f"SELECT clip_id, {_r(*[c for c in _FEATS if c != 'speed_change'], 'final_speed - initial_speed AS speed_change')}, {_LONG} AS long_execution, {_LAT.format('total_lateral_shift')} AS lat_execution FROM embf",
        "pack_trajectory": f"SELECT clip_id, step, {_r('x', 'y')}, 0.0::DOUBLE AS z FROM evw",
        "unpack_trajectory": f"SELECT clip_id, step, {_r('x', 'y')}, 0.0::DOUBLE AS z FROM emb",
        "ade": f"SELECT clip_id, {_r('ade_meters')}, n_joined FROM ades_e",
        "curvature_lateral": "SELECT clip_id, round(residual, 3) + 0.0::DOUBLE AS residual, raw_class, curve_class FROM arcc",
        "long_compat": "SELECT clip_id, long_intent, long_execution, long_compat FROM cur_text JOIN cls USING (clip_id) LEFT JOIN lm USING (long_intent, long_execution)",
        "lat_compat": "SELECT clip_id, lat_intent, lat_execution, lat_compat FROM cur_text JOIN cls USING (clip_id) LEFT JOIN tm USING (lat_intent, lat_execution)",
        "score_clips": f"SELECT clip_id, t0_us, {', '.join(_RESULT)}, mismatch_type, NULL::VARCHAR AS error, {_r(*_MEASURES)} FROM res",
        "score_with_errors": f"""SELECT clip_id, t0_us, scenario_type, error, {', '.join(f'CASE WHEN error IS NULL THEN {c} END AS {c}' for c in (*_RESULT[1:], 'mismatch_type'))}, {_r(*[f'CASE WHEN error IS NULL THEN {c} END AS {c}' for c in _MEASURES])}
FROM (SELECT *, CASE WHEN ord % 103 = 0 THEN 'missing prediction' WHEN ord % 101 = 0 THEN 'length mismatch' END AS error FROM (SELECT *, substr(clip_id, 2)::BIGINT AS ord FROM res))""",
        "stream_scores": f"""SELECT clip_id, t0_us, scenario_type, error, {', '.join(f'CASE WHEN error IS NULL THEN {c} END AS {c}' for c in (*_RESULT[1:], 'mismatch_type'))}, {_r(*[f'CASE WHEN error IS NULL THEN {c} END AS {c}' for c in _MEASURES])} FROM res_a""",
        "run_summary": f"SELECT count(*) AS total_clips, count(mismatch_score) AS valid, {_r('avg(mismatch_score) AS mean_mismatch', 'avg(ade_meters) AS mean_ade', 'avg(long_match) AS mean_long_match', 'avg(lat_match) AS mean_lat_match')} FROM res",
        "type_distribution": f"SELECT mismatch_type, count(*) AS n, {_r('100.0 * count(*) / sum(count(*)) OVER () AS pct')} FROM res GROUP BY mismatch_type",
        "class_histograms": " UNION ALL ".join(f"SELECT '{c}' AS axis, {c} AS label, count(*) AS n FROM res GROUP BY {c}" for c in _RESULT[2:]),
        "by_scenario": f"SELECT scenario_type, count(*) AS n, {_r('avg(mismatch_score) AS mean_score', 'avg(ade_meters) AS mean_ade')} FROM res GROUP BY scenario_type",
        "rescore_by_scenario": f"SELECT scenario_type, count(*) AS n, {_r('avg(mismatch_score) AS mean_score', 'avg(ade_meters) AS mean_ade')}, count(*) FILTER (mismatch_type = 'unclassified_intent') AS n_unclassified FROM res WHERE scenario_type IS NOT NULL GROUP BY scenario_type",
        "mean_ci": " UNION ALL ".join(f"SELECT '{m}' AS metric, count(*) AS n, {_r(f'avg({m}) AS mean', f'stddev_samp({m}) AS sd', *_ci('count(*)', f'avg({m})', f'stddev_samp({m})'))} FROM res" for m in _METRICS),
        "severity_bands": f"SELECT band, n, {_r('100 * p AS pct', '100 * (p - 1.96 * sqrt(p * (1 - p) / total)) AS lo', '100 * (p + 1.96 * sqrt(p * (1 - p) / total)) AS hi')}, band <> 'consistent' AS inconsistent FROM (SELECT *, n / total::DOUBLE AS p FROM (SELECT band, count(*) AS n, sum(count(*)) OVER () AS total FROM (SELECT {_BAND.format('mismatch_score')} AS band FROM res) GROUP BY band))",
        "axis_gap_ci": f"SELECT count(*) AS n, {_r('avg(long_match - lat_match) AS mean', 'stddev_samp(long_match - lat_match) AS sd', *_ci('count(*)', 'avg(long_match - lat_match)', 'stddev_samp(long_match - lat_match)'))} FROM res",
        "severe_by_bucket": f"SELECT scenario_type, count(*) AS n, {_r('100 * avg((mismatch_score >= 0.6)::INT) AS severe_pct')} FROM res GROUP BY scenario_type",
        "crosstab_long": "SELECT *, row_number() OVER (ORDER BY n DESC, intent, execution) AS rank FROM (SELECT long_intent AS intent, long_execution AS execution, count(*) AS n FROM res GROUP BY 1, 2)",
        "crosstab_lat": "SELECT *, row_number() OVER (ORDER BY n DESC, intent, execution) AS rank FROM (SELECT lat_intent AS intent, lat_execution AS execution, count(*) AS n FROM res GROUP BY 1, 2)",
        "mismatch_ade_corr": f"SELECT {_r('corr(mismatch_score, ade_meters) AS corr')}, count(*) AS n FROM res",
        "ade_by_band": f"SELECT {_BAND.format('mismatch_score')} AS band, count(*) AS n, {_r('avg(ade_meters) AS mean_ade')} FROM res GROUP BY 1",
        "ade_stratified": f"SELECT scenario_type, {_REGIME} AS regime, {_BAND.format('mismatch_score')} AS band, count(*) AS n, {_r('avg(ade_meters) AS mean_ade')} FROM res GROUP BY 1, 2, 3",
        "classifiable_means": f"SELECT count(*) AS n, {_r(*[f'avg({m}) AS mean_{m}' for m in _METRICS])} FROM res WHERE mismatch_type <> 'unclassified_intent'",
        "curvature_effect": f"""SELECT "group", n, {_r('severe_raw', 'severe_curve', 'severe_raw - severe_curve AS drop_points')}, CASE WHEN round(severe_raw - severe_curve, 6) >= 10 THEN 'curvature_artifact' WHEN round(severe_raw - severe_curve, 6) < 5 THEN 'not_curvature' ELSE 'unclear' END AS verdict FROM ({curve})""",
        "parser_ablation": f"""SELECT variant, n, {_r('severe_pct', 'spread')}, CASE WHEN round(spread, 6) > 5 THEN 'parser_sensitive' WHEN round(spread, 6) <= 2 THEN 'robust' ELSE 'unclear' END AS verdict
FROM (SELECT *, max(severe_pct) OVER () - min(severe_pct) OVER () AS spread FROM ({_severe('res_s', 'strict')} UNION ALL {_severe('res', 'current')} UNION ALL {_severe('res_w', 'expanded')}))""",
        "audit_slice": f"""SELECT c.clip_id, c.scenario_type, c.regime, {_r('c.mismatch_score AS mismatch_score')}, c.lat_execution, k.clip_id AS control_id, {_r('k.mismatch_score AS control_score')}
FROM (SELECT *, row_number() OVER (PARTITION BY scenario_type, regime ORDER BY mismatch_score DESC, clip_id) AS k FROM (SELECT * FROM strata WHERE severe AND lat_intent = 'hold_lane' ORDER BY mismatch_score DESC, clip_id LIMIT 100)) c
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY scenario_type, regime ORDER BY {_MD5.format(7)}) AS k FROM strata WHERE NOT severe) k ON c.scenario_type = k.scenario_type AND c.regime = k.regime AND c.k = k.k""",
        "resume_batch": "SELECT * FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM done) ORDER BY ord LIMIT 400",
        "batch_progress": "SELECT total, done, total - done AS remaining, least(total - done, 400) AS this_batch, total - done - least(total - done, 400) AS after FROM (SELECT count(*) AS total, count(*) FILTER (ord % 3 = 0) AS done FROM clips)",
        "rescore": f"SELECT clip_id, t0_us, {', '.join(_RESULT)}, mismatch_type, NULL::VARCHAR AS error, {_r(*_MEASURES)} FROM res",
        "reclassified": "SELECT clip_id, cot_text, old_mismatch_type, mismatch_type, old_long_intent, long_intent, old_lat_intent, lat_intent FROM pairs WHERE changed",
        "reclassified_preview": "SELECT clip_id, substr(cot_text, 1, 80) AS text_80, substr(cot_text, 1, 65) AS text_65, old_mismatch_type, mismatch_type FROM pairs WHERE changed ORDER BY clip_id LIMIT 20",
        "rescore_summary": "SELECT count(*) AS n, count(*) FILTER (changed) AS n_changed FROM pairs",
        "type_shift": f"""SELECT mismatch_type, coalesce(a, 0) AS n_old, coalesce(b, 0) AS n_new, {_r('100.0 * coalesce(a, 0) / (SELECT count(*) FROM pairs) AS pct_old', '100.0 * coalesce(b, 0) / (SELECT count(*) FROM pairs) AS pct_new')}, coalesce(b, 0) - coalesce(a, 0) AS delta
FROM (SELECT old_mismatch_type AS mismatch_type, count(*) AS a FROM pairs GROUP BY 1) FULL JOIN (SELECT mismatch_type, count(*) AS b FROM pairs GROUP BY 1) USING (mismatch_type)""",
        "unspecified_shift": " UNION ALL ".join(f"SELECT '{a}' AS axis, count(*) FILTER (old_{a}_intent = 'unspecified') AS n_before, count(*) FILTER ({a}_intent = 'unspecified') AS n_after, count(*) FILTER ({a}_intent = 'unspecified') - count(*) FILTER (old_{a}_intent = 'unspecified') AS delta FROM pairs" for a in ("long", "lat")),
    }
    for n in (2000, 20_000):
        cand = q["stratified_candidates"].replace("FROM cand", f"FROM (SELECT *, row_number() OVER (PARTITION BY hour_bucket ORDER BY {_MD5.format(_SEED)}) AS rk FROM elig WHERE hour_bucket IS NOT NULL) WHERE rk <= {n * 3 // 5}").replace("clip_id, hour", "clip_id, country, hour", 1)
        q[f"quota_fill_{n}"] = f"{drawn} FROM (SELECT *, row_number() OVER (PARTITION BY hour_bucket ORDER BY {_MD5.format(_SEED + 2)}) AS k FROM ({cand}) WHERE clip_id IN (SELECT clip_id FROM cover WHERE ego_max >= 19500000 AND ego_min <= 300000)) WHERE k <= {n // 5}"
    q["simple_sample_2000"] = q["simple_sample"].replace(f"LIMIT {_SAMPLE}", "LIMIT 2000")
    texts = "(SELECT clip_id, ok, ck, cot_text || ' #' || ck % 97 AS cot_text, long_intent, lat_intent, confidence FROM o JOIN cur_bank b ON b.num = (ok * 5 + ck) % 24)"
    q["text_dictionary"] = f"""SELECT delivery, count(*) AS n_texts, count(DISTINCT cot_text) AS n_distinct, count(DISTINCT cot_text) FILTER (delivery = first) AS n_new
FROM (SELECT *, (ok % 3 <> 0)::INT AS delivery, min((ok % 3 <> 0)::INT) OVER (PARTITION BY cot_text) AS first FROM {texts}) GROUP BY delivery"""
    q["dictionary_intents"] = f"SELECT clip_id, long_intent, lat_intent, {_r('confidence')} FROM {texts} WHERE ok % 3 <> 0"
    q["ade_bucketed"] = q["ade"]
    q["features_bucketed"] = f"SELECT clip_id, n_steps, {_r(*[c for c in _FEATS if c != 'speed_change'], 'final_speed - initial_speed AS speed_change')} FROM feat_e"
    damaged = "SELECT *, substr(clip_id, 2)::BIGINT AS ord FROM res WHERE substr(clip_id, 2)::BIGINT % 5 = 0"
    q["results_quarantine"] = f"""SELECT 'taken' AS reason, count(*) AS n FROM res UNION ALL SELECT 'score out of range', count(*) FILTER (ord % 2 = 0) FROM ({damaged})
UNION ALL SELECT 'no clip', count(*) FILTER (ord % 3 = 0) FROM ({damaged}) UNION ALL SELECT 'malformed', count(*) FROM ({damaged})"""
    q["results_csv"] = q["score_clips"].replace(" cot_text,", " nullif(cot_text, '') AS cot_text,", 1)
    q["latest_run"] = q["run_summary"].replace("SELECT count", "SELECT '2026-01-03T00:00:00' AS timestamp, count", 1)
    q["sql_scores"] = f"SELECT clip_id, long_intent, lat_intent, long_execution, lat_execution, mismatch_type, {_r('confidence', 'CASE WHEN usr % 11 <> 0 THEN ade_meters END AS ade_meters', 'mismatch_score')} FROM res_sql"
    q["rescored_file"] = q["rescore"]
    q["rescore_csv"] = q["rescore"].replace(" cot_text,", " nullif(cot_text, '') AS cot_text,", 1)
    q["summary_json"] = q["latest_run"]
    q["checkpoint_rows"] = q["score_clips"]
    q["source_profile"] = " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS n, '{c}' AS columns FROM {table}" for n, table, c in (("index", "idx", "clip_id,split,clip_is_valid"), ("metadata", "meta", "clip_id,country,month,hour_of_day,platform_class"), ("egomotion", "ego", "clip_id,ts_us")))
    q["rescore_known"] = q["rescore"]
    q["run_until_done"] = q["score_with_errors"]
    return {k: _sql(v) for k, v in sorted(q.items())}


CTES["raw_c"] = "SELECT r.* EXCLUDE (lat_execution), a.curve_class AS lat_execution FROM raw r JOIN arcc a USING (clip_id)"
CTES["raw_r"] = "SELECT r.* EXCLUDE (lat_execution), a.raw_class AS lat_execution FROM raw r JOIN arcc a USING (clip_id)"
CTES["res_c"] = _scored("raw_c")
CTES["res_r"] = _scored("raw_r")
CTES["both_scores"] = "SELECT r.lat_intent, r.mismatch_score AS raw_score, c.mismatch_score AS curve_score FROM res_r r JOIN res_c c USING (clip_id)"

# Clips that arrive from events: who they are, what their features make of them, their error to the truth.
CTES["arr"] = "SELECT clip_id, step, x * 1.013::DOUBLE AS x, y, split_part(substr(clip_id, 2), '-', 1)::BIGINT AS usr, split_part(clip_id, '-', 2)::BIGINT AS block FROM evw"
CTES["arrf"] = _features("arr")
CTES["arrk"] = f"SELECT *, {_LONG} AS long_execution, {_LAT.format('total_lateral_shift')} AS lat_execution FROM arrf"
CTES["arre"] = "SELECT clip_id, usr, block, avg(sqrt((0.02::DOUBLE * step) ** 2 + (0.01::DOUBLE * step) ** 2)) AS ade_meters FROM arr GROUP BY ALL"
CTES["raw_a"] = "SELECT e.clip_id, 2000000 + usr * 1000 AS t0_us, 's' || usr % 5 AS scenario_type, b.cot_text, b.long_intent, b.lat_intent, b.confidence, k.long_execution, k.lat_execution, e.ade_meters, k.total_lateral_shift AS lat_shift_m, k.mean_speed AS mean_speed_ms, CASE WHEN usr % 13 = 0 THEN 'missing prediction' WHEN usr % 11 = 0 THEN CASE WHEN k.n_steps = 1 THEN 'missing ground truth' ELSE 'length mismatch' END END AS error FROM arre e JOIN arrk k USING (clip_id) JOIN cur_bank b ON b.num = (usr * 5 + block) % 24"
CTES["res_a"] = _scored("raw_a")
CTES["raw_sql"] = "SELECT *, substr(split_part(clip_id, '-', 1), 2)::BIGINT AS usr FROM raw_a WHERE error IS NULL OR error <> 'missing prediction'"
CTES["res_sql"] = _scored("raw_sql")
