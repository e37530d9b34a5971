"""Independent SQL for the driver's queries, written against the sample views.

Each text computes its result from the plain rows (window functions, quantile_cont, conditional aggregates),
not from the pre-aggregated cells the Spark plans use, so the two sides share the views and nothing else.
"""

from __future__ import annotations

from lodgelens.plans.daily import FEATURES, LAGS, SCALED, SERIES, WINDOWS
from lodgelens.schema import CURRENCIES, PPC_PAIRS, PPC_SOURCES, SEGMENTS, TABLE_NAMES
from lodgelens.sources.sample_views import VIEW_COLUMNS, VIEWS, WHOLE_VIEWS, raw_sql, with_views

_IN_CURRENCIES = "currency in (" + ", ".join(f"'{c}'" for c in CURRENCIES) + ")"
_PAIRS = ", ".join(f"'{p}'" for p in PPC_PAIRS)
_PAID = "utm_medium = 'cpc' and utm_source in (" + ", ".join(f"'{s}'" for s in PPC_SOURCES) + ")"

_SEG = """
toddler as (
    select distinct r.hotel_id, r.search_log_id
    from search_log_room r join search_log_room_child c
      on c.hotel_id = r.hotel_id and c.search_log_room_id = r.id
    where c.age <= 2),
seg as (
    select s.*, case
        when s.children = 0 then case s.adults when 1 then 'single' when 2 then 'couple' when 3 then 'three_adults'
                                 when 4 then 'four_adults' else 'group_5plus' end
        when t.search_log_id is not null then 'family_toddler'
        when s.children = 1 then 'family_1_child'
        when s.children = 2 then 'family_2_children'
        else 'family_3plus_children' end as segment
    from search_log s left join toddler t on t.hotel_id = s.hotel_id and t.search_log_id = s.id)"""

_BOOKED = f"{_SEG},\nbooked as (select * from seg where conversion = 1)"
_BOOKED_CUR = f"{_SEG},\nbooked as (select * from seg where conversion = 1 and {_IN_CURRENCIES})"

_LEAD = f"""{_SEG},
act as (
    select s.hotel_id, s.search_log_session_id, s.segment, month(s.utc_datetime) as booking_month,
           cast(floor(date_diff('microsecond', s.utc_datetime, s.arrival) / 86400000000.0) as int) as lead_time
    from seg s where exists (select 1 from booking_data b where b.hotel_id = s.hotel_id and b.search_log_id = s.id))"""
_LEAD_SOURCE = f"""{_LEAD},
src as (
    select a.*, u.utm_source || ' / ' || u.utm_medium as utm_source_and_medium
    from act a join search_log_session u on u.hotel_id = a.hotel_id and u.id = a.search_log_session_id
    where u.utm_source || ' / ' || u.utm_medium in ({_PAIRS}))"""


def _summary(keys: str, table: str) -> str:
    return f"""
select {keys}, count(*) as bookings, round(avg(lead_time), 6) as mean, median(lead_time) as median,
       round(stddev_samp(lead_time), 6) as std, min(lead_time) as min, max(lead_time) as max
from {table} group by {keys}"""


def _box(keys: str, table: str, head: str) -> str:
    join = " and ".join(f"x.{k} = b.{k}" for k in keys.split(", "))
    listed = ", ".join(f"x.{k}" for k in keys.split(", "))
    return f"""with {head},
box as (select {keys}, quantile_cont(lead_time, 0.25) as p25, quantile_cont(lead_time, 0.5) as p50,
               quantile_cont(lead_time, 0.75) as p75 from {table} group by {keys})
select {listed}, round(p25, 6) as p25, round(p50, 6) as p50, round(p75, 6) as p75,
       round(least(p25, min(case when lead_time >= p25 - 1.5 * (p75 - p25) and lead_time <= p75 + 1.5 * (p75 - p25)
                                 then lead_time end)), 6) as whisker_low,
       round(greatest(p75, max(case when lead_time >= p25 - 1.5 * (p75 - p25)
                                     and lead_time <= p75 + 1.5 * (p75 - p25) then lead_time end)), 6) as whisker_high
from {table} x join box b on {join} group by {listed}, p25, p50, p75"""


def _monthly(keys: str, table: str) -> str:
    months = ", ".join(f"round(avg(case when booking_month = {m} then lead_time end), 6) as m{m}" for m in range(1, 13))
    return f"select {keys}, {months} from {table} group by {keys}"


_FUNNEL_HEAD = """
ids as (select distinct hotel_id from website_daily_users union select distinct hotel_id from search_log
        union select distinct hotel_id from booking_data union select distinct hotel_id from datepicker_daily_visitors),
stages as (
    select hotel_id, 1 as stage_no, 'website_visits' as stage,
           (select coalesce(sum(user_count), 0) from website_daily_users x where x.hotel_id = ids.hotel_id) as users from ids
    union all
    select hotel_id, 2, 'datepicker_usage',
           (select coalesce(sum(user_count), 0) from datepicker_daily_visitors x where x.hotel_id = ids.hotel_id) from ids
    union all
    select hotel_id, 3, 'searches',
           (select {searches} from search_log x where x.hotel_id = ids.hotel_id) from ids
    union all
    select hotel_id, 4, 'bookings',
           (select {bookings}) from ids)"""
_SESSIONS = {
    "searches": "count(distinct search_log_session_id)",
    "bookings": "count(*) from booking_data x where x.hotel_id = ids.hotel_id",
}
_ROWS = {
    "searches": "count(*)",
    "bookings": "count(*) from search_log x where x.hotel_id = ids.hotel_id and conversion = 1",
}


def _funnel(definition: dict[str, str]) -> str:
    return f"""with {_FUNNEL_HEAD.format(**definition)}
select hotel_id, stage_no, stage, cast(users as bigint) as users,
       coalesce(round(100.0 * users / nullif(lag(users) over w, 0), 6),
                case when stage_no = 1 then 100.0 end) as step_pct,
       case when stage_no = 1 then 100.0 else round(100.0 * users / nullif(first_value(users) over w, 0), 6) end as from_start_pct
from stages window w as (partition by hotel_id order by stage_no)"""


_FUNNEL_RATES = f"""with {_FUNNEL_HEAD.format(**_ROWS)},
wide as (select hotel_id, cast(max(case when stage_no = 1 then users end) as double) as v,
                cast(max(case when stage_no = 2 then users end) as double) as d,
                cast(max(case when stage_no = 3 then users end) as double) as s,
                cast(max(case when stage_no = 4 then users end) as double) as b from stages group by hotel_id)
select hotel_id, round(100 * d / nullif(v, 0), 6) as visit_to_datepicker_pct,
       round(100 * s / nullif(d, 0), 6) as datepicker_to_search_pct,
       round(100 * b / nullif(s, 0), 6) as search_to_booking_pct,
       round(100 * b / nullif(d, 0), 6) as datepicker_to_booking_pct,
       round(100 * b / nullif(v, 0), 6) as visit_to_booking_pct
from wide"""

_CAMPAIGN = f"""
camp as (
    select s.hotel_id, s.currency, {{segment}} coalesce(u.utm_campaign, '(not set)') as utm_campaign, count(*) as bookings
    from {{table}} s left join search_log_session u on u.hotel_id = s.hotel_id and u.id = s.search_log_session_id
    where s.conversion = 1 and s.{_IN_CURRENCIES}
    group by all)"""

_PPC = f"""
ppc as (
    select b.*, u.utm_source from booked b
    join search_log_session u on u.hotel_id = b.hotel_id and u.id = b.search_log_session_id where {_PAID})"""

_ROOM_SOURCE = f"""
rooms as (
    select s.hotel_id, s.currency, r.picked_room, u.utm_source, s.total_price_final
    from search_log s
    left join search_log_room r on r.hotel_id = s.hotel_id and r.search_log_id = s.id
    left join search_log_session u on u.hotel_id = s.hotel_id and u.id = s.search_log_session_id
    where s.conversion = 1 and {_PAID} and r.picked_room is not null)"""

_UPSELL = f"""{_BOOKED_CUR},
sold as (
    select b.hotel_id, b.currency, b.segment, p.name, p.sum_price
    from booked b join booking_data d on d.hotel_id = b.hotel_id and d.search_log_id = b.id
    join upsell_data p on p.hotel_id = b.hotel_id and p.search_log_id = b.id)"""

_USERS = """
merged as (
    select s.*, u.uuid, u.utm_source, u.utm_medium from search_log s
    join search_log_session u on u.hotel_id = s.hotel_id and u.id = s.search_log_session_id
    where u.uuid is not null),
first_booking as (
    select hotel_id, uuid, min(utc_datetime) as booked_at from merged where conversion = 1 group by hotel_id, uuid),
visits as (
    select m.hotel_id, m.uuid, count(case when m.utc_datetime < f.booked_at then 1 end) as visits
    from merged m join first_booking f on f.hotel_id = m.hotel_id and f.uuid = m.uuid group by m.hotel_id, m.uuid),
currency_users as (
    select distinct m.hotel_id, m.currency, m.uuid, v.visits from merged m
    join visits v on v.hotel_id = m.hotel_id and v.uuid = m.uuid where m.conversion = 1)"""

_REPEAT = f"""{_USERS},
bookings as (select *, count(*) over (partition by hotel_id, uuid) as booking_count from merged where conversion = 1),
repeat as (select * from bookings where booking_count > 1),
top as (
    select * from (select hotel_id, uuid, booking_count,
                          row_number() over (partition by hotel_id order by booking_count desc, uuid) as rank
                   from (select distinct hotel_id, uuid, booking_count from repeat) x) y
    where rank <= 5)"""

_PRICES = """
prices as (
    select b.hotel_id, b.search_log_id, s.utc_datetime, s.currency, b.total_price_final,
           rooms_total_price + upsell_total_price - vouchers_total_price - loyalty_discount_total
             - redeemed_loyalty_points_total as recomposed
    from booking_data b left join search_log s on s.hotel_id = b.hotel_id and s.id = b.search_log_id),
diffs as (select *, recomposed - total_price_final as diff from prices where currency is not null)"""

_TAU = "2 * pi()"


def _moving() -> str:
    parts = []
    for short, column in SERIES.items():
        for w in WINDOWS:
            frame = f"over (partition by hotel_id order by date rows between {w - 1} preceding and current row)"
            parts.append(f"round(avg({column}) {frame}, 6) as {short}_ma{w}")
            if short == "fill_rate":
                parts.append(f"round(stddev_samp({column}) {frame}, 6) as fill_rate_std{w}")
        for k in LAGS:
            lagged = f"lag({column}, {k}) over (partition by hotel_id order by date)"
            parts.append(f"round(cast({lagged} as double), 6) as {short}_lag{k}")
    return ",\n       ".join(parts)


_SERIES = """
series as (
    select v.hotel_id, v.date, v.user_count, v.session_count, o.fill_rate,
           cast(p.daily_google_spend as bigint) + p.daily_microsoft_spend + p.daily_meta_spend as total_ppc_spend
    from (select hotel_id, date, cast(sum(user_count) as bigint) as user_count,
                 cast(sum(session_count) as bigint) as session_count
          from datepicker_daily_visitors group by hotel_id, date) v
    left join (select hotel_id, subject_date, fill_rate from daily_occupancy where recording_date = subject_date) o
      on o.hotel_id = v.hotel_id and o.subject_date = v.date
    left join daily_ppc_budget p on p.hotel_id = v.hotel_id and p.date = v.date)"""


def _features(rounded: bool) -> str:
    body = f"""
    select hotel_id, date, round(fill_rate, 6) as fill_rate, user_count, session_count, total_ppc_spend,
       cast(isodow(date) - 1 as int) as weekday, cast(case when isodow(date) >= 6 then 1 else 0 end as int) as is_weekend,
       round(cast(total_ppc_spend as double) / case when user_count = 0 then 1 else user_count end, 6) as ppc_per_user,
       round(cast(session_count as double) / case when user_count = 0 then 1 else user_count end, 6) as conversion_rate,
       round(sin({_TAU} * (isodow(date) - 1) / 7), 6) as weekday_sin,
       round(cos({_TAU} * (isodow(date) - 1) / 7), 6) as weekday_cos,
       round(sin({_TAU} * month(date) / 12), 6) as month_sin, round(cos({_TAU} * month(date) / 12), 6) as month_cos,
       {_moving()}
    from series"""
    return body if rounded else body.replace("round(", "(").replace(", 6)", ")")


_FEATURES_EXACT = f"{_SERIES},\nfeatures as ({_features(False)})"

_PREDICTIONS = f"""{_FEATURES_EXACT},
predictions as (select hotel_id, date, fill_rate_lag7 as prediction, fill_rate as label,
                       fill_rate - fill_rate_lag7 as residual
                from features where fill_rate_lag7 is not null and fill_rate is not null)"""

_COMPLETE = f"""{_FEATURES_EXACT},
complete as (select * from features where {" and ".join(f"{f} is not null" for f in ["fill_rate", *FEATURES])}),
numbered as (select *, row_number() over (partition by hotel_id order by date) as pos,
                    count(*) over (partition by hotel_id) as n from complete),
split as (select *, case when pos <= n - ceil(0.2 * n - 1e-9) then 'train' else 'test' end as role from numbered)"""


def _scaled() -> str:
    columns = ", ".join(
        f"round(({f} - avg({f}) over w) / coalesce(nullif(stddev_pop({f}) over w, 0), 1), 5) as {f}" for f in SCALED
    )
    complete = " and ".join(f"{f} is not null" for f in ["fill_rate", *FEATURES])
    return f"""with {_FEATURES_EXACT},
scaled as (select hotel_id, date, round(fill_rate, 5) as fill_rate, weekday, is_weekend, {columns}
           from features window w as (partition by hotel_id))
select * from scaled where {complete}"""


def _twins(seed: int = 42, noise: float = 0.1) -> str:
    def uniform(feature: str, first: int) -> str:
        key = f"concat_ws('|', '{seed}', '{feature}', cast(hotel_id as varchar), cast(date as varchar))"
        return f"((cast(cast('0x' || substr(md5({key}), {first}, 13) as bigint) as double) + 0.5) / {1 << 52})"

    twins = ", ".join(
        f"cast({f} as double) + case when copy = 0 then 0 else {noise} * sqrt(-2 * ln({uniform(f, 1)}))"
        f" * cos({_TAU} * {uniform(f, 20)}) end as {f}"
        for f in ["fill_rate", *FEATURES]
    )
    return f"""{_FEATURES_EXACT},
twins as (select hotel_id, date, copy, {twins} from features cross join (select unnest([0, 1]) as copy) c)"""


def _augmented() -> str:
    columns = ", ".join(
        f"round(({f} - avg({f}) over w) / coalesce(nullif(stddev_pop({f}) over w, 0), 1), 5) as {f}" for f in SCALED
    )
    complete = " and ".join(f"{f} is not null" for f in ["fill_rate", *FEATURES])
    return f"""with {_twins()},
scaled as (select hotel_id, date, copy, round(fill_rate, 5) as fill_rate, round(weekday, 5) as weekday,
                  round(is_weekend, 5) as is_weekend, {columns}
           from twins window w as (partition by hotel_id))
select * from scaled where {complete}"""


def _model_rows() -> str:
    """``wide``: scaled rows with their fold block (5: the test days); ``long``: one row per feature."""
    columns = ", ".join(
        f"({f} - avg({f}) over w) / coalesce(nullif(stddev_pop({f}) over w, 0), 1) as {f}" for f in SCALED
    )
    complete = " and ".join(f"{f} is not null" for f in ["fill_rate", *FEATURES])
    return f"""{_twins()},
scaled as materialized (select hotel_id, date, copy, fill_rate, weekday, is_weekend, {columns}
           from twins window w as (partition by hotel_id)),
placed as (select *, row_number() over (partition by hotel_id order by date, copy) - 1 as pos,
                  count(*) over (partition by hotel_id) as n from scaled where {complete}),
sized as (select *, cast(n - ceil(0.2 * n - 1e-9) as bigint) as train from placed),
wide as materialized (
    select hotel_id, date, copy, 1.0::double as one, fill_rate, {", ".join(FEATURES)},
           case when pos >= train then 5
                else greatest(-1, cast(floor((pos - (train - 5 * (train // 6))) / (train // 6)) as int)) end as block
    from sized),
long as materialized (
    select hotel_id, date, copy, block, name, value
    from wide unpivot (value for name in (one, fill_rate, {", ".join(FEATURES)})))"""


_PLACES = ", ".join(f"('{name}', {i})" for i, name in enumerate(["one", "fill_rate", *FEATURES]))
_PAIRED = f"""places(name, place) as (values {_PLACES}),
paired as (select x.hotel_id, x.block, x.name as a, y.name as b, x.value as va, y.value as vb
           from long x join long y on x.hotel_id = y.hotel_id and x.date = y.date and x.copy = y.copy
           join places p on p.name = x.name join places q on q.name = y.name and p.place <= q.place)"""

# Ridge by Gauss-Jordan elimination of the centred normal equations, one column a step.
_RIDGE = f"""with recursive {_model_rows()},
train as (select l.*, w.fill_rate from long l join wide w using (hotel_id, date, copy)
          where l.block < 5 and l.name not in ('one', 'fill_rate')),
ranked as (select hotel_id, name, row_number() over (partition by hotel_id order by r * r / (1 - r * r) desc, name) as p
           from (select hotel_id, name, corr(value, fill_rate) as r from train group by all) c where not isnan(r)),
picked as materialized (select t.hotel_id, t.date, t.copy, t.block, p, t.value, w.fill_rate
           from long t join wide w using (hotel_id, date, copy) join ranked r on r.hotel_id = t.hotel_id and r.name = t.name and p <= 20),
folds as (select unnest([0, 1, 2, 3, 4]) as fold),
centred as (
    select x.hotel_id, fold, x.p, y.p as q, covar_pop(x.value, y.value) * count(*) as v
    from picked x join picked y on x.hotel_id = y.hotel_id and x.date = y.date and x.copy = y.copy
    join folds on x.block < fold group by all
    union all
    select hotel_id, fold, p, 21, covar_pop(value, fill_rate) * count(*) from picked join folds on block < fold group by all),
means as (select hotel_id, fold, p, avg(value) as x, avg(fill_rate) as y from picked join folds on block < fold group by all),
lines as (select hotel_id, fold, alpha, p, list(v + case when p = q then alpha else 0 end order by q) as line
          from centred cross join (select unnest([0.1, 1.0, 10.0]) as alpha) a group by hotel_id, fold, alpha, p),
solved as (
    select hotel_id, fold, alpha, 0 as step, list(line order by p) as m from lines group by hotel_id, fold, alpha
    union all
    select hotel_id, fold, alpha, step + 1, list_transform(m, lambda line, i: case
        when i = step + 1 then list_transform(line, lambda v: v / m[step + 1][step + 1])
        else list_transform(line, lambda v, j: v - line[step + 1] * m[step + 1][j] / m[step + 1][step + 1]) end)
    from solved where step < len(m)),
weights as (select hotel_id, fold, alpha, unnest(range(1, len(m) + 1)) as p, unnest(list_transform(m, lambda line: line[len(line)])) as b
            from solved where step = len(m)),
told as (select t.hotel_id, w.fold, alpha, t.date, t.copy, any_value(t.fill_rate) - any_value(n.y) - sum(b * (t.value - n.x)) as residual
         from picked t join weights w on w.hotel_id = t.hotel_id and w.fold = t.block and w.p = t.p
         join means n on n.hotel_id = t.hotel_id and n.fold = w.fold and n.p = t.p
         group by t.hotel_id, w.fold, alpha, t.date, t.copy)
select hotel_id, cast(alpha as double) as alpha, cast(fold as int) as fold, round(avg(residual * residual), 4) as mse
from told group by hotel_id, alpha, fold"""


def _scores() -> str:
    parts = " union all ".join(
        f"select hotel_id, '{f}' as feature, corr({f}, fill_rate) as r, count(*) as n from split where role = 'train' group by hotel_id"
        for f in FEATURES
    )
    return f"""with {_COMPLETE},
correlations as ({parts}),
scored as (select hotel_id, feature, r * r / (1 - r * r) * (n - 2) as score from correlations
           where not isnan(r) and r is not null)
select hotel_id, feature, round(score, 3) as f_score, rank from
  (select *, row_number() over (partition by hotel_id order by score desc, feature) as rank from scored) x
where rank <= 20"""


_MISSING = "('', 'NA', 'NaN', 'null', 'N/A', 'NULL')"  # of the texts that stand for a missing value, those in the raw views


def _money(name: str) -> str:
    return f"cast(coalesce(try_cast(trim({name}) as decimal(14,2)), 0) as double) as {name}"


_RAW_BOOKINGS = f"""raw as ({raw_sql("booking_data")}),
judged as (select *, case
    when trim(total_price_final) not in {_MISSING} and try_cast(trim(total_price_final) as decimal(14,2)) is null
      then 'total_price_final: not a money'
    when trim(vouchers_total_price) in {_MISSING} then 'vouchers_total_price: missing value in an integer column'
    when try_cast(vouchers_total_price as decimal(25,6)) is null then 'vouchers_total_price: not an integer' end as reason from raw)"""
_RAW_VISITORS = f"""raw as ({raw_sql("datepicker_daily_visitors")}),
judged as (select *, case
    when date not in {_MISSING} and try_cast(date as date) is null then 'date: not a date'
    when session_count in {_MISSING} then 'session_count: missing value in an integer column' end as reason from raw)"""


def _quality() -> str:
    parts = []
    for table in TABLE_NAMES:
        columns = [c for c in VIEW_COLUMNS[table] if c != "hotel_id"]
        missing = " + ".join(f"case when {c} is null then 1 else 0 end" for c in columns)
        parts.append(
            f"""select a.hotel_id, '{table}' as table_name, a.missing_values, a.row_count, a.row_count - d.n as duplicate_rows
from (select hotel_id, cast(sum({missing}) as bigint) as missing_values, count(*) as row_count from {table} group by hotel_id) a
join (select hotel_id, count(*) as n from (select distinct * from {table}) x group by hotel_id) d on d.hotel_id = a.hotel_id"""
        )
    return "\nunion all\n".join(parts)


def _row_counts() -> str:
    return " union all ".join(
        f"select hotel_id, count(*) as row_count, '{t}' as table_name from {t} group by hotel_id" for t in TABLE_NAMES
    )


def _profile() -> str:
    """Types as DuckDB sees them, written in Spark's words."""
    parts = []
    for table in TABLE_NAMES:
        for i, column in enumerate(VIEW_COLUMNS[table], start=1):
            parts.append(
                f"select '{table}' as table_name, {i} as position, '{column}' as column_name, "
                f"typeof(any_value({column})) as t, count(*) as row_count from {table}"
            )
    return f"""with described as ({" union all ".join(parts)})
select table_name, position, column_name,
       case t when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz'
              else lower(t) end as data_type, row_count from described"""


_UPSELL_WIDE = ", ".join(f"cast(sum(case when segment = '{s}' then 1 else 0 end) as bigint) as {s}" for s in SEGMENTS)
_PPC_WIDE = ", ".join(
    f"cast(sum(case when utm_source = '{s}' then 1 else 0 end) as bigint) as {s}_bookings, "
    f"round(coalesce(cast(sum(case when utm_source = '{s}' then total_price_final end) as double), 0), 2) as {s}_revenue"
    for s in PPC_SOURCES
)
_ROOM_WIDE = ", ".join(
    f"round(cast(sum(case when utm_source = '{s}' then total_price_final end) as double)"
    f" / nullif(count(case when utm_source = '{s}' then 1 end), 0), 6) as {s}"
    for s in PPC_SOURCES
)

_TEXTS: dict[str, str] = {
    "lead_time_by_segment": f"with {_LEAD} {_summary('hotel_id, segment', 'act')}",
    "lead_time_percentiles": f"""with {_LEAD}
select hotel_id, segment, round(quantile_cont(lead_time, 0.25), 6) as p25, round(quantile_cont(lead_time, 0.5), 6) as p50,
       round(quantile_cont(lead_time, 0.75), 6) as p75 from act group by hotel_id, segment""",
    "lead_time_monthly": f"with {_LEAD} {_monthly('hotel_id, segment', 'act')}",
    "lead_time_box": _box("hotel_id, segment", "act", _LEAD),
    "lead_time_by_source": f"with {_LEAD_SOURCE} {_summary('hotel_id, utm_source_and_medium, segment', 'src')}",
    "lead_time_by_source_monthly": f"with {_LEAD_SOURCE} {_monthly('hotel_id, utm_source_and_medium, segment', 'src')}",
    "lead_time_by_source_box": _box("hotel_id, utm_source_and_medium, segment", "src", _LEAD_SOURCE),
    "bookings_by_source": f"""with {_LEAD_SOURCE}
select hotel_id, utm_source_and_medium, count(*) as bookings from src group by hotel_id, utm_source_and_medium""",
    "bookings_by_segment": f"with {_LEAD} select hotel_id, segment, count(*) as bookings from act group by hotel_id, segment",
    "funnel": _funnel(_SESSIONS),
    "funnel_rows": _funnel(_ROWS),
    "funnel_rates": _FUNNEL_RATES,
    "funnel_by_currency": """
select hotel_id, currency, count(*) as searches, count(case when conversion = 1 then 1 end) as bookings,
       round(100.0 * count(*) / sum(count(*)) over (partition by hotel_id), 6) as search_share_pct,
       round(100.0 * count(case when conversion = 1 then 1 end)
             / sum(count(case when conversion = 1 then 1 end)) over (partition by hotel_id), 6) as booking_share_pct,
       round(100.0 * count(case when conversion = 1 then 1 end) / count(*), 6) as conversion_pct
from search_log group by hotel_id, currency""",
    "segment_stats": f"""with {_BOOKED_CUR}
select hotel_id, currency, segment, count(*) as bookings, round(avg(nights), 6) as avg_nights,
       round(cast(sum(total_price_final) as double) / count(*), 6) as avg_price,
       round(avg(adults + children), 6) as avg_guests,
       round(cast(sum(total_price_final) as double) / sum(nights), 6) as cost_per_night,
       round(cast(sum(total_price_final) as double) / sum(adults + children), 6) as cost_per_person
from booked group by hotel_id, currency, segment""",
    "segment_revenue": f"""with {_BOOKED_CUR},
sums as (select hotel_id, currency, segment, cast(sum(total_price_final) as double) as revenue, count(*) as bookings
         from booked group by hotel_id, currency, segment)
select hotel_id, currency, segment, round(revenue, 2) as revenue, bookings,
       round(100 * revenue / sum(revenue) over (partition by hotel_id, currency), 6) as revenue_share_pct,
       round(revenue / bookings, 6) as avg_value from sums""",
    "segment_top3": f"""with {_BOOKED_CUR},
sums as (select hotel_id, currency, segment, cast(sum(total_price_final) as double) as revenue
         from booked group by hotel_id, currency, segment),
ranked as (select *, 100 * revenue / sum(revenue) over (partition by hotel_id, currency) as share,
                  row_number() over (partition by hotel_id, currency order by revenue desc, segment) as rank from sums)
select hotel_id, currency, rank, segment, round(revenue, 2) as revenue, round(share, 6) as revenue_share_pct
from ranked where rank <= 3""",
    "revenue_totals": f"""
select hotel_id, currency, round(cast(sum(total_price_final) as double), 2) as revenue, count(*) as bookings
from search_log where conversion = 1 and {_IN_CURRENCIES} group by hotel_id, currency""",
    "campaign_by_segment": f"""with {_SEG}, {_CAMPAIGN.format(segment="s.segment,", table="seg")}
select hotel_id, currency, segment, utm_campaign, bookings,
       round(100.0 * bookings / sum(bookings) over (partition by hotel_id, currency, segment), 6) as share_pct from camp""",
    "top_campaigns": f"""with {_CAMPAIGN.format(segment="", table="search_log")},
ranked as (select *, row_number() over (partition by hotel_id, currency order by bookings desc, utm_campaign) as rank
           from camp)
select hotel_id, currency, utm_campaign, bookings, rank,
       round(100.0 * bookings / sum(bookings) over (partition by hotel_id, currency), 6) as share_pct
from (select * from ranked where rank <= 5) x""",
    "campaign_summary": f"""with {_CAMPAIGN.format(segment="", table="search_log")}
select hotel_id, currency, cast(sum(bookings) as bigint) as bookings, count(*) as active_campaigns,
       round(avg(bookings), 6) as bookings_per_campaign,
       round(100.0 * max(bookings) / sum(bookings), 6) as largest_share_pct from camp group by hotel_id, currency""",
    "room_choice_by_segment": f"""with {_BOOKED_CUR},
cells as (select b.hotel_id, b.currency, b.segment, r.picked_room, count(*) as room_rows
          from booked b left join search_log_room r on r.hotel_id = b.hotel_id and r.search_log_id = b.id
          where r.picked_room is not null group by all)
select *, round(100.0 * room_rows / sum(room_rows) over (partition by hotel_id, currency, segment), 6) as share_pct
from cells""",
    "room_choice_by_source": f"""with {_ROOM_SOURCE},
cells as (select hotel_id, picked_room, utm_source, count(*) as room_rows from rooms group by all)
select *, round(100.0 * room_rows / sum(room_rows) over (partition by hotel_id, utm_source), 6) as share_pct from cells""",
    "room_choice_by_source_and_currency": f"""with {_ROOM_SOURCE},
cells as (select hotel_id, currency, picked_room, utm_source, count(*) as room_rows,
                 round(cast(sum(total_price_final) as double) / count(*), 6) as avg_price
          from rooms where {_IN_CURRENCIES} group by all)
select *, round(100.0 * room_rows / sum(room_rows) over (partition by hotel_id, currency, utm_source), 6) as share_pct
from cells""",
    "room_avg_price": f"""with {_ROOM_SOURCE}
select hotel_id, currency, picked_room, {_ROOM_WIDE} from rooms where {_IN_CURRENCIES}
group by hotel_id, currency, picked_room""",
    "ppc_daily_traffic": f"""
select hotel_id, date, utm_source_and_medium, cast(sum(user_count) as bigint) as user_count,
       cast(sum(session_count) as bigint) as session_count
from datepicker_daily_visitors where utm_source_and_medium in ({_PAIRS}) group by hotel_id, date, utm_source_and_medium""",
    "ppc_daily_spend": """
select hotel_id, date, 'google' as platform, daily_google_spend as spend from daily_ppc_budget union all
select hotel_id, date, 'bing', daily_microsoft_spend from daily_ppc_budget union all
select hotel_id, date, 'meta', daily_meta_spend from daily_ppc_budget""",
    "ppc_conversions": f"""with booked as (select * from search_log where conversion = 1), {_PPC},
v as (select hotel_id, split_part(utm_source_and_medium, ' / ', 1) as utm_source, cast(sum(user_count) as bigint) as visitors
      from datepicker_daily_visitors where utm_source_and_medium in ({_PAIRS}) group by all),
b as (select hotel_id, utm_source, count(*) as bookings from ppc group by all)
select coalesce(v.hotel_id, b.hotel_id) as hotel_id, coalesce(v.utm_source, b.utm_source) as utm_source,
       coalesce(visitors, 0) as visitors, coalesce(bookings, 0) as bookings,
       round(100.0 * coalesce(bookings, 0) / nullif(coalesce(visitors, 0), 0), 6) as conversion_pct
from v full join b on v.hotel_id = b.hotel_id and v.utm_source = b.utm_source
where coalesce(visitors, 0) > 0 or coalesce(bookings, 0) > 0""",
    "ppc_bookings_by_segment": f"""with {_BOOKED}, {_PPC}
select hotel_id, segment, utm_source, count(*) as bookings,
       round(100.0 * count(*) / sum(count(*)) over (partition by hotel_id, utm_source), 6) as share_pct
from ppc group by hotel_id, segment, utm_source""",
    "ppc_revenue_by_segment": f"""with {_BOOKED_CUR}, {_PPC},
cells as (select hotel_id, currency, segment, utm_source, count(total_price_final) as bookings,
                 sum(total_price_final) as revenue from ppc group by all)
select hotel_id, currency, segment, utm_source, bookings, round(cast(revenue as double), 2) as revenue
from (select *, sum(revenue) over (partition by hotel_id, currency, utm_source) as col from cells) x where col <> 0""",
    "ppc_revenue_wide": f"""with {_BOOKED_CUR}, {_PPC}
select hotel_id, currency, segment, {_PPC_WIDE} from ppc group by hotel_id, currency, segment""",
    "upsell_by_segment": f"""with {_UPSELL}
select hotel_id, currency, name, {_UPSELL_WIDE}, count(*) as total from sold group by hotel_id, currency, name""",
    "upsell_levels": f"""with {_UPSELL},
levels as (
    select hotel_id, currency, name, segment, 0 as level, sum_price from sold union all
    select hotel_id, currency, name, null, 1, sum_price from sold union all
    select hotel_id, currency, null, segment, 2, sum_price from sold union all
    select hotel_id, currency, null, null, 3, sum_price from sold)
select hotel_id, currency, name, segment, cast(level as int) as level, count(*) as sold,
       round(cast(sum(sum_price) as double), 2) as revenue
from levels group by hotel_id, currency, name, segment, level""",
    "upsell_revenue": f"""with {_UPSELL}
select hotel_id, currency, segment, name, round(cast(sum(sum_price) as double), 2) as revenue
from sold group by hotel_id, currency, segment, name""",
    "upsell_revenue_tiers": f"""with {_UPSELL},
items as (select hotel_id, currency, name, sum(sum_price) as revenue from sold group by all),
cuts as (select hotel_id, currency, quantile_cont(cast(revenue as double), [0, 1/3.0, 2/3.0, 1]) as q
         from items group by all),
edges as (select hotel_id, currency, round(q[1], 6) as e0, round(q[2], 6) as e1, round(q[3], 6) as e2, round(q[4], 6) as e3
          from cuts)
select i.hotel_id, i.currency, i.name, round(cast(revenue as double), 2) as revenue,
       case (case when e1 > e0 and e1 < e3 and e1 < cast(revenue as double) then 1 else 0 end)
          + (case when e2 > e0 and e2 > e1 and e2 < e3 and e2 < cast(revenue as double) then 1 else 0 end)
            when 0 then 'low' when 1 then 'medium' else 'high' end as tier
from items i join edges e on e.hotel_id = i.hotel_id and e.currency = i.currency where revenue > 0""",
    "upsell_revenue_tiers_all": f"""with {_UPSELL},
names as (select distinct hotel_id, name from upsell_data),
places as (select distinct hotel_id, currency from sold),
items as (select p.hotel_id, p.currency, n.name, coalesce(sum(s.sum_price), 0) as revenue
          from places p join names n on n.hotel_id = p.hotel_id
          left join sold s on s.hotel_id = p.hotel_id and s.currency = p.currency and s.name = n.name group by all),
cuts as (select hotel_id, currency, quantile_cont(cast(revenue as double), [0, 1/3.0, 2/3.0, 1]) as q
         from items group by all),
edges as (select hotel_id, currency, round(q[1], 6) as e0, round(q[2], 6) as e1, round(q[3], 6) as e2, round(q[4], 6) as e3
          from cuts)
select i.hotel_id, i.currency, i.name, round(cast(revenue as double), 2) as revenue,
       case (case when e1 > e0 and e1 < e3 and e1 < cast(revenue as double) then 1 else 0 end)
          + (case when e2 > e0 and e2 > e1 and e2 < e3 and e2 < cast(revenue as double) then 1 else 0 end)
            when 0 then 'low' when 1 then 'medium' else 'high' end as tier
from items i join edges e on e.hotel_id = i.hotel_id and e.currency = i.currency where revenue > 0""",
    "visits_before_booking": f"with {_USERS} select * from visits",
    "visits_distribution": f"""with {_USERS}
select hotel_id, currency, visits, count(*) as users,
       round(100.0 * count(*) / sum(count(*)) over (partition by hotel_id, currency), 6) as share_pct
from currency_users group by hotel_id, currency, visits""",
    "visits_summary": f"""with {_USERS},
s as (select hotel_id, currency, round(avg(visits), 6) as mean_visits, median(visits) as median_visits,
             min(visits) as min_visits, max(visits) as max_visits, count(*) as users
      from currency_users group by hotel_id, currency),
b as (select hotel_id, currency, count(*) as bookings, round(cast(sum(total_price_final) as double) / count(*), 6) as avg_value,
             round(cast(sum(total_price_final) as double), 2) as revenue, cast(sum(adults) as bigint) as adults,
             cast(sum(children) as bigint) as children
      from merged where conversion = 1 group by hotel_id, currency)
select s.*, b.bookings, b.avg_value, b.revenue, b.adults, b.children
from s join b on s.hotel_id = b.hotel_id and s.currency = b.currency""",
    "visits_overall": f"""with {_USERS}
select v.hotel_id, round(avg(visits), 6) as mean_visits, median(visits) as median_visits, min(visits) as min_visits,
       max(visits) as max_visits, count(*) as users,
       (select count(*) from merged m where m.conversion = 1 and m.hotel_id = v.hotel_id) as bookings
from visits v group by v.hotel_id""",
    "visits_levels": f"""with {_USERS},
s as (select hotel_id, 0 as level, currency, round(avg(visits), 6) as mean_visits, median(visits) as median_visits,
             min(visits) as min_visits, max(visits) as max_visits, count(*) as users
      from currency_users group by hotel_id, currency),
b as (select hotel_id, currency, count(*) as bookings, round(cast(sum(total_price_final) as double), 2) as revenue
      from merged where conversion = 1 group by hotel_id, currency)
select s.*, b.bookings, b.revenue from s join b on s.hotel_id = b.hotel_id and s.currency = b.currency
union all
select v.hotel_id, 1, null, round(avg(visits), 6), median(visits), min(visits), max(visits), count(*),
       (select count(*) from merged m where m.conversion = 1 and m.hotel_id = v.hotel_id),
       (select round(cast(sum(total_price_final) as double), 2) from merged m where m.conversion = 1 and m.hotel_id = v.hotel_id)
from visits v group by v.hotel_id""",
    "monthly_sketches": """
select s.hotel_id, strftime(cast(utc_datetime as date), '%Y-%m') as month, count(distinct uuid) as visitors,
       true as visitors_within, count(case when conversion = 1 and total_price_final is not null then 1 end) as bookings,
       true as median_within
from search_log s left join search_log_session u on u.hotel_id = s.hotel_id and u.id = s.search_log_session_id
group by 1, 2""",
    "report_fields": f"""with {_PREDICTIONS},
m as (select hotel_id, sqrt(avg(residual * residual)) as rmse, avg(abs(residual)) as mae,
             1 - sum(residual * residual) / (var_pop(label) * count(*)) as r2 from predictions group by hotel_id),
q as ({_quality()}),
b as (select hotel_id, count(*) as bookings from search_log
      where conversion = 1 and cast(utc_datetime as date) = date '1998-06-01' group by hotel_id),
o as (select hotel_id, avg(fill_rate) as occupancy_rate from daily_occupancy
      where recording_date = subject_date and subject_date = date '1998-06-01' group by hotel_id),
v as (select hotel_id, cast(sum(user_count) as bigint) as website_visitors from website_daily_users
      where date = date '1998-06-01' group by hotel_id),
d as (select hotel_id from b union select hotel_id from o union select hotel_id from v)
select m.hotel_id, '1998-06-01' as report_date, '1998-06-01 12:00:00' as timestamp, 'last_week' as model_name,
       round(rmse, 6) as rmse, round(mae, 6) as mae, round(r2, 6) as r2, round(rmse - 8.35, 6) as rmse_vs_baseline,
       table_name, missing_values, row_count, duplicate_rows,
       case when d.hotel_id is not null then coalesce(bookings, 0) end as bookings, round(occupancy_rate, 6) as occupancy_rate,
       case when d.hotel_id is not null then coalesce(website_visitors, 0) end as website_visitors
from m left join q on q.hotel_id = m.hotel_id left join d on d.hotel_id = m.hotel_id left join b on b.hotel_id = m.hotel_id
left join o on o.hotel_id = m.hotel_id left join v on v.hotel_id = m.hotel_id""",
    "metric_history": f"""with {_PREDICTIONS},
days as (select unnest([date '1995-06-01', date '1997-06-01', date '1998-06-01']) as day),
m as (select hotel_id, day, sqrt(avg(residual * residual)) as rmse, avg(abs(residual)) as mae,
             1 - sum(residual * residual) / (var_pop(label) * count(*)) as r2
      from predictions p join days on p.date < day group by hotel_id, day)
select hotel_id, 'last_week' as model_name, cast(day as varchar) || ' 12:00:00' as timestamp, round(rmse, 6) as rmse,
       round(mae, 6) as mae, round(r2, 6) as r2, round(rmse - 8.35, 6) as rmse_vs_baseline,
       round(rmse - lag(rmse) over w, 6) as rmse_change, round(mae - lag(mae) over w, 6) as mae_change
from m window w as (partition by hotel_id order by day)""",
    "repeat_bookers": f"""with {_REPEAT}
select hotel_id, utm_source, utm_medium, currency, count(*) as bookings, count(distinct uuid) as users,
       round(cast(sum(total_price_final) as double), 2) as revenue,
       round(cast(sum(total_price_final) as double) / count(*), 6) as avg_value,
       cast(sum(adults) as bigint) as adults, cast(sum(children) as bigint) as children
from repeat group by hotel_id, utm_source, utm_medium, currency""",
    "repeat_totals": f"""with {_REPEAT}
select hotel_id, currency, count(*) as bookings, round(cast(sum(total_price_final) as double), 2) as revenue,
       cast(sum(adults + children) as bigint) as guests, cast(sum(adults) as bigint) as adults,
       cast(sum(children) as bigint) as children
from repeat group by hotel_id, currency""",
    "booking_frequency": f"""with {_REPEAT}
select hotel_id, booking_count, count(distinct uuid) as users from repeat group by hotel_id, booking_count""",
    "top_bookers": f"""with {_REPEAT}
select r.hotel_id, t.rank, r.uuid, t.booking_count, r.currency, count(*) as bookings,
       round(cast(sum(total_price_final) as double), 2) as revenue,
       round(cast(sum(total_price_final) as double) / count(*), 6) as avg_value,
       cast(sum(adults + children) as bigint) as guests, cast(sum(adults) as bigint) as adults,
       cast(sum(children) as bigint) as children
from repeat r join top t on t.hotel_id = r.hotel_id and t.uuid = r.uuid
group by r.hotel_id, t.rank, r.uuid, t.booking_count, r.currency""",
    "top_booker_sources": f"""with {_REPEAT}
select r.hotel_id, r.uuid, r.utm_source, count(*) as bookings
from repeat r join top t on t.hotel_id = r.hotel_id and t.uuid = r.uuid group by r.hotel_id, r.uuid, r.utm_source""",
    "price_reconciliation": f"""with {_PRICES}
select hotel_id, currency, count(*) as bookings, count(case when diff <> 0 then 1 end) as diff_count,
       round(cast(sum(diff) as double), 2) as diff_sum from diffs group by hotel_id, currency""",
    "price_diff_top5": f"""with {_PRICES},
ranked as (select *, row_number() over (partition by hotel_id, currency order by abs(diff) desc, search_log_id) as rank,
                  max(abs(diff)) over (partition by hotel_id, currency) as largest from diffs)
select hotel_id, currency, rank, search_log_id, round(cast(recomposed as double), 2) as recomposed,
       round(cast(total_price_final as double), 2) as total_price, round(cast(diff as double), 2) as diff
from ranked where rank <= 5 and largest > 0""",
    "price_diff_series": f"""with {_PRICES}
select hotel_id, currency, utc_datetime, search_log_id, round(cast(diff as double), 2) as diff,
       case when diff > 0 then 'surplus' else 'shortfall' end as sign from diffs where diff <> 0""",
    "booking_stats": """with stacked as (
    select *, 'all' as dimension, 'all' as value from search_log union all
    select *, 'currency', currency from search_log union all
    select *, 'language', lang_code from search_log)
select hotel_id, dimension, value, count(*) as searches, count(case when conversion = 1 then 1 end) as bookings,
       round(100.0 * sum(conversion) / count(*), 6) as conversion_pct,
       round(cast(sum(case when conversion = 1 then total_price_final end) as double)
             / nullif(count(case when conversion = 1 then 1 end), 0), 6) as avg_value
from stacked group by hotel_id, dimension, value""",
    "utm_split": """with parts as (
    select hotel_id, user_count, session_count,
              case when utm_source_and_medium = '0' then 'unknown' when position('/' in utm_source_and_medium) > 0
                   then trim(substr(utm_source_and_medium, 1, position('/' in utm_source_and_medium) - 1))
                   else trim(utm_source_and_medium) end as utm_source,
              case when position('/' in utm_source_and_medium) > 0
                   then trim(substr(utm_source_and_medium, position('/' in utm_source_and_medium) + 1))
                   else 'unknown' end as utm_medium
    from datepicker_daily_visitors)
select hotel_id, coalesce(utm_source, 'unknown') as utm_source, coalesce(utm_medium, 'unknown') as utm_medium,
       cast(sum(user_count) as bigint) as user_count, cast(sum(session_count) as bigint) as session_count
from parts group by all""",
    "utm_split_untrimmed": """with parts as (
    select *, case when position('/' in utm_source_and_medium) > 0
                   then substr(utm_source_and_medium, 1, position('/' in utm_source_and_medium) - 1)
                   else utm_source_and_medium end as utm_source,
              case when position('/' in utm_source_and_medium) > 0
                   then substr(utm_source_and_medium, position('/' in utm_source_and_medium) + 1)
                   else 'unknown' end as utm_medium
    from website_daily_users)
select hotel_id, coalesce(utm_source, 'unknown') as utm_source, coalesce(utm_medium, 'unknown') as utm_medium,
       cast(sum(user_count) as bigint) as user_count, cast(sum(session_count) as bigint) as session_count
from parts group by all""",
    "utm_matches": """
select hotel_id, utm_source_and_medium, count(*) as n from datepicker_daily_visitors
where lower(utm_source_and_medium) like '%cpc%' group by hotel_id, utm_source_and_medium""",
    "utm_match_levels": """
select hotel_id, utm_source_and_medium, count(case when lower(utm_source_and_medium) like '%cpc%' then 1 end) as n
from datepicker_daily_visitors group by hotel_id, utm_source_and_medium""",
    "load_booking_data": f"""with {_RAW_BOOKINGS}
select hotel_id, cast(search_log_id as bigint) as search_log_id, {", ".join(_money(c) for c in (
    "total_price_final", "rooms_total_price", "upsell_total_price", "loyalty_discount_total", "redeemed_loyalty_points_total"))},
       cast(cast(vouchers_total_price as decimal(25,6)) as int) as vouchers_total_price
from judged where reason is null""",
    "load_sessions": f"""with raw as ({raw_sql("search_log_session")})
select hotel_id, cast(id as bigint) as id, case when uuid in {_MISSING} then null else uuid end as uuid,
       cast(session_id as bigint) as session_id, case when utm_source in {_MISSING} then '0' else utm_source end as utm_source,
       utm_medium, utm_campaign from raw""",
    "load_daily_visitors": f"""with {_RAW_VISITORS}
select hotel_id, try_cast(date as date) as date,
       case when utm_source_and_medium in {_MISSING} then '0' else utm_source_and_medium end as utm_source_and_medium,
       utm_campaign, cast(user_count as int) as user_count, cast(session_count as int) as session_count,
       case when utm_source_and_medium in {_MISSING} then 'unknown' when position('/' in utm_source_and_medium) > 0
            then trim(substr(utm_source_and_medium, 1, position('/' in utm_source_and_medium) - 1))
            else trim(utm_source_and_medium) end as utm_source,
       case when utm_source_and_medium in {_MISSING} or position('/' in utm_source_and_medium) = 0 then 'unknown'
            else trim(substr(utm_source_and_medium, position('/' in utm_source_and_medium) + 1)) end as utm_medium
from judged where reason is null""",
    "rejected_lines": f"""with bookings as (with {_RAW_BOOKINGS}
    select hotel_id, 'booking_data' as table_name, file, reason, concat_ws(';', search_log_id, total_price_final,
           rooms_total_price, upsell_total_price, vouchers_total_price, loyalty_discount_total, redeemed_loyalty_points_total) as line
    from judged where reason is not null),
visitors as (with {_RAW_VISITORS}
    select hotel_id, 'datepicker_daily_visitors' as table_name, file, reason,
           concat_ws(';', date, utm_source_and_medium, utm_campaign, user_count, session_count) as line
    from judged where reason is not null)
select hotel_id, table_name, file, reason, count(*) as n, min(line) as first_line
from (select * from bookings union all select * from visitors) x group by hotel_id, table_name, file, reason""",
    "base_stats": """
select s.hotel_id, s.searches, s.avg_nights, s.avg_adults, b.bookings, o.avg_fill_rate
from (select hotel_id, count(*) as searches, round(avg(nights), 6) as avg_nights, round(avg(adults), 6) as avg_adults
      from search_log group by hotel_id) s
full join (select hotel_id, count(*) as bookings from booking_data group by hotel_id) b on b.hotel_id = s.hotel_id
full join (select hotel_id, round(avg(fill_rate), 6) as avg_fill_rate from daily_occupancy group by hotel_id) o
  on o.hotel_id = s.hotel_id""",
    "profile_tables": _profile(),
    "row_counts": _row_counts(),
    "data_quality": _quality(),
    "daily_features": f"with {_SERIES} {_features(True)}",
    "scaled_features": _scaled(),
    "augmented_features": _augmented(),
    "daily_metrics": """
with b as (select hotel_id, cast(utc_datetime as date) as date, count(*) as bookings from search_log
           where conversion = 1 group by all),
o as (select hotel_id, subject_date as date, avg(fill_rate) as occupancy_rate from daily_occupancy
      where recording_date = subject_date group by all),
v as (select hotel_id, date, cast(sum(user_count) as bigint) as website_visitors from website_daily_users group by all),
days as (select hotel_id, date from b union select hotel_id, date from o union select hotel_id, date from v)
select d.hotel_id, d.date, coalesce(bookings, 0) as bookings, round(occupancy_rate, 6) as occupancy_rate,
       coalesce(website_visitors, 0) as website_visitors
from days d left join b on b.hotel_id = d.hotel_id and b.date = d.date
left join o on o.hotel_id = d.hotel_id and o.date = d.date
left join v on v.hotel_id = d.hotel_id and v.date = d.date""",
    "model_metrics": f"""with {_PREDICTIONS}
select hotel_id, count(*) as n, round(sqrt(avg(residual * residual)), 6) as rmse, round(avg(abs(residual)), 6) as mae,
       round(1 - sum(residual * residual) / (var_pop(label) * count(*)), 6) as r2,
       round(sqrt(avg(residual * residual)) - 8.35, 6) as rmse_vs_baseline
from predictions group by hotel_id""",
    "residual_histogram": f"""with {_PREDICTIONS},
ends as (select hotel_id, min(residual) as lo, max(residual) as hi from predictions group by hotel_id)
select p.hotel_id, cast(least(floor((residual - lo) / ((hi - lo) / 20)), 19) as int) as bin,
       round(lo + least(floor((residual - lo) / ((hi - lo) / 20)), 19) * ((hi - lo) / 20), 6) as bin_start, count(*) as n
from predictions p join ends e on e.hotel_id = p.hotel_id group by all""",
    "chronological_split": f"with {_COMPLETE} select hotel_id, date, role from split",
    "ts_folds": f"""with {_COMPLETE},
train as (select hotel_id, date, row_number() over (partition by hotel_id order by date) - 1 as i,
                 count(*) over (partition by hotel_id) as n from split where role = 'train'),
folds as (select t.*, f.fold, cast(floor(n / 6) as bigint) as size from train t
          cross join (select unnest([0, 1, 2, 3, 4]) as fold) f)
select hotel_id, fold, case when i < n - (5 - fold) * size then 'train' else 'test' end as role,
       count(*) as n, min(date) as first_date, max(date) as last_date
from folds where i < n - (4 - fold) * size group by all""",
    "feature_selection": _scores(),
    "model_statistics": f"""with {_model_rows()},
{_PAIRED}
select hotel_id, cast(block as int) as block, a, b, round(sum(va * vb), 2) as value from paired group by hotel_id, block, a, b""",
    "feature_covariance": f"""with {_model_rows()},
{_PAIRED}
select hotel_id, a, b, round(covar_samp(va, vb), 6) as covariance from paired
where block < 5 and a not in ('one', 'fill_rate') group by hotel_id, a, b""",
    "pca_total_variance": f"""with {_model_rows()}
select hotel_id, count(*) as components, round(sum(v), 6) as total_variance from
  (select hotel_id, name, var_samp(value) as v from long where block < 5 and name not in ('one', 'fill_rate') group by all) x
group by hotel_id""",
    "ridge_grid": _RIDGE,
}


# Columns shown the same way by both engines: days and times as text, ranks as 32-bit numbers.
_AS_TEXT = {
    "ppc_daily_traffic": ("date",),
    "ppc_daily_spend": ("date",),
    "price_diff_series": ("utc_datetime",),
    "daily_features": ("date",),
    "scaled_features": ("date",),
    "augmented_features": ("date",),
    "daily_metrics": ("date",),
    "chronological_split": ("date",),
    "ts_folds": ("first_date", "last_date"),
    "load_daily_visitors": ("date",),
}
# Queries over the tables that leave nothing out.
_WHOLE = {
    "campaign_by_segment", "room_choice_by_source", "ppc_daily_spend", "visits_before_booking", "daily_metrics",
    "model_metrics",
}
_RANKED = ("segment_top3", "top_campaigns", "top_bookers", "price_diff_top5", "feature_selection")


def _shown(name: str, text: str) -> str:
    columns = [f"cast({c} as varchar) as {c}" for c in _AS_TEXT.get(name, ())]
    columns += ["cast(rank as int) as rank"] if name in _RANKED else []
    return f"select * replace ({', '.join(columns)}) from ({text})" if columns else text


def oracle_sql() -> dict[str, str]:
    return {
        name: _shown(name, with_views(text, WHOLE_VIEWS if name in _WHOLE else VIEWS)) for name, text in _TEXTS.items()
    }
