"""One DuckDB statement per registered query."""

from __future__ import annotations

from oracle.tables import MONTH_HI, MONTH_LO, km, register, spread_provinces, with_tables

# The hubs of each transport mode.
MODES = {
    0: [(110.293096, 20.026518), (110.165718, 20.04586)],
    1: [(110.466232, 19.945878), (109.414883, 18.313457)],
    2: [(110.168949, 20.033696), (109.499415, 18.302055)],
}


def mode(lng: str, lat: str) -> str:
    d = {m: "least(" + ", ".join(km(lng, lat, str(x), str(y)) for x, y in hubs) + ")" for m, hubs in MODES.items()}
    return (f"(case when {d[0]}<={d[1]} and {d[0]}<={d[2]} and {d[0]}<=10 then 0 "
            f"when {d[1]}<={d[2]} and {d[1]}<=10 then 1 when {d[2]}<=10 then 2 else 3 end)")


def transport(day: str, direction: str) -> str:
    return f"""select v.user_id, cast(coalesce(t.mode, 3) as int) transport from visitor v left join (
          select user_id, {mode('lng', 'lat')} as mode from (
            select s.user_id, b.lng, b.lat,
                   row_number() over (partition by s.user_id order by s.ts {direction}, s.cell_id) rn
            from visitor_stop s join base_station b using(cell_id) join visitor v using(user_id)
            where cast(s.ts as date) = v.{day}) where rn = 1) t using(user_id)"""


# The words of a hotel's name and their labels.
HOTEL_NAMES = [
    ("1", ["快捷"]), ("2", ["公寓"]), ("3", ["家庭旅馆"]), ("4", ["客栈", "民宿"]), ("5", ["青年"]), ("6", ["商务"]),
    ("7", ["招待所"]), ("8", ["温泉"]), ("9", ["海景", "海滨"]), ("10", ["情侣"]), ("11", ["出租", "住宿", "短租"]),
    ("12", ["别墅", "公馆", "山庄"]),
]
_by_name = "concat_ws('#', " + ", ".join(
    "case when " + " or ".join(f"contains(name, '{w}')" for w in words) + f" then '{label}' end"
    for label, words in HOTEL_NAMES
) + ")"

# The eight POI classes and the tags of those that have some.
POI_CLASSES = ["star_hotel", "budget_hotel", "apartment_hotel", "other_hotel", "shopping", "restaurant", "sight", "other"]
POI_CLASS = """case when string_split(tags, ';')[1] = '酒店' then case string_split(tags, ';')[2]
      when '星级酒店' then 'star_hotel' when '快捷酒店' then 'budget_hotel' when '公寓式酒店' then 'apartment_hotel'
      else 'other_hotel' end
    else case string_split(tags, ';')[1] when '购物' then 'shopping' when '美食' then 'restaurant'
      when '旅游景点' then 'sight' else 'other' end end"""

DAY_COLUMNS = ", ".join(f"count(*) filter (where day(\"day\")={d}) as d{d}" for d in range(1, 32))
HOUR_COLUMNS = ", ".join(f"count(*) filter (where hour={h}) as h{h}" for h in range(24))

# Seconds since midnight of a timestamp.
SEC = "(hour(ts)*3600+minute(ts)*60+second(ts))"


def moments(place: str, alias: str, known: bool) -> str:
    only = "and p.lng is not null and p.lat is not null" if known else ""
    return f"""select s.user_id, s."day", {SEC} sec, s.cell_id, p.cell_id {alias},
        lag(s.cell_id) over w before_cell, lag({SEC}) over w before_sec, lead({SEC}) over w next_sec
      from (select distinct user_id, "day", ts, cell_id from local_stop where isodow("day") < 6) s
      join (select distinct user_id, cell_id, lng, lat from {place}) p on p.user_id = s.user_id {only}
      window w as (partition by s.user_id, s."day", p.cell_id order by ts, s.cell_id)"""


def home_left(known: bool) -> str:
    return f"""select user_id, sum(h) / cast(count(*) as double) / 7200 home_left from (
        select user_id, "day", min(sec+before_sec) h from ({moments('user_home', 'home', known)})
        where before_cell = home and cell_id <> home and sec+before_sec >= 28800
        group by user_id, "day", home) group by user_id"""


def work_left(known: bool) -> str:
    return f"""select user_id, sum(h) / cast(count(*) as double) / 7200 work_left from (
        select user_id, "day", 2*86399 - (sec+coalesce(next_sec, sec)) h from (
          select *, row_number() over (partition by user_id, "day", work order by sec desc) rn
          from ({moments('user_work', 'work', known)}) where cell_id = work)
        where rn = 1) where h <> 0 group by user_id"""


def rank(metric: str, value: str, sign: str) -> str:
    return f"""select c.user_id, avg(case when round(t.{value},6) {sign} round(o.{value},6) then 1.0 else 0.0 end) ratio
        from circle_pair c join {metric} o on o.user_id = c.user_id join {metric} t on t.user_id = c.contact
        where c.colleague group by c.user_id"""


def work_hours(days: str) -> str:
    return f"""select user_id, sum(h) / cast(count(*) as double) / 1e6 work_hours from (
        select s.user_id, s."day", sum(cast(round(dur_h*1e6) as bigint)) h from local_stop s
        join user_work w on w.user_id = s.user_id and w.cell_id = s.cell_id
        where isodow(s."day") {days} group by s.user_id, s."day", s.cell_id) group by user_id"""


CIRCLE = {"colleague": "colleague", "family": "family", "friend": "not colleague and not family"}

register(
    way_moment=f"""select distinct s.user_id, s."day", {SEC} sec, h.cell_id home, w.cell_id work, s.cell_id = h.cell_id at_home
        from local_stop s join user_home h on h.user_id = s.user_id join user_work w on w.user_id = s.user_id
        where isodow(s."day") < 6 and h.cell_id <> w.cell_id and s.cell_id in (h.cell_id, w.cell_id)""",
    poi_vector="select cell_id, coalesce(sum(n), 0)::bigint poi_sum, " + ", ".join(
        f"coalesce(sum(n) filter (where class = '{c}'), 0)::bigint n_{c}" for c in POI_CLASSES) + f"""
        from (select distinct cell_id, lng, lat, radius_m from base_station semi join visitor_stop using (cell_id)) b left join (
          select c.cell_id, {POI_CLASS} class, count(*) n from base_station c join poi p
          on {km('c.lng', 'c.lat', 'p.lng', 'p.lat')} <= coalesce(c.radius_m/1000, 1.0) group by 1, 2) using (cell_id)
        group by cell_id""",
    transport_out_t=transport("last_date", "desc"),
    home_t=f"""select v.user_id, h.cell_id home_cell, h.lng, h.lat from visitor v left join (
        select r.user_id, r.cell_id, b.lng, b.lat from (
          select user_id, cell_id, row_number() over (partition by user_id order by h desc, cell_id) rn from (
            select user_id, cell_id, round(sum(dur_h), 6) h from month_stop where hour(ts) <= 6
            group by user_id, cell_id)) r join base_station b using(cell_id) where rn = 1) h using(user_id)""",
    person_day="""select distinct spot, "day", user_id, prov from spot_visit""",
    stay_hours="""select spot, user_id, "day", cast(sum(cast(round(dur_h*1e6) as bigint)) as bigint) micro from spot_visit
        group by spot, user_id, "day" """,
    call_end="""select caller user_id, callee other, call_ts, dur_ms from cdr
        union all select callee, caller, call_ts, dur_ms from cdr""",
    contact_pair="""select user_id, other contact, count(*) freq, cast(sum(dur_ms) as bigint) dur_ms from call_end
        where user_id is not null and other is not null group by user_id, other""",
    visitor_calls="""select c.user_id, v.stay_days, cast(call_ts as date) d from call_end c join visitor v using(user_id)""",
    circle_pair="""select p.*,
          coalesce(exists(select 1 from user_home a join user_home b on a.cell_id=b.cell_id
                 where a.user_id=p.user_id and b.user_id=p.contact), false) family,
          coalesce(exists(select 1 from user_work a join user_work b on a.cell_id=b.cell_id
                 where a.user_id=p.user_id and b.user_id=p.contact), false) colleague
        from contact_pair p""",
    type_t="""select v.user_id, case when b.user_id is not null or v.stay_days >= 25 then 'bird'
            when z.user_id is not null then 'business' else 'bird' end visitor_type
        from visitor v left join (
          select c.user_id from (select user_id, count(*) n from contact_pair group by user_id) c
          left join (select user_id, count(*) n from (
              select distinct p.user_id, p.contact, v.stay_days from contact_pair p
              join local_user using(user_id) join visitor v on v.user_id = p.contact) group by user_id) o
            using(user_id) where coalesce(o.n, 0) >= c.n / 2.0) b using(user_id)
        left join (select user_id from (select user_id, d, count(*) n from visitor_calls where stay_days <= 7
            group by user_id, d) group by user_id having avg(n) >= 3) z using(user_id)""",
    duty_t="""select v.user_id, case when d.user_id is null then '0' else '1' end duty_free from visitor v
        left join (select distinct user_id from month_stop
            where cell_id in (select cell_id from scenic_spot where scenic_id = 19)) d using(user_id)""",
    strength_t="""select v.user_id, cast(case when m is null or m < 3 then 1 when m <= 6 then 2 else 3 end as int) call_level
        from visitor v left join (select user_id, avg(n) m from (
            select user_id, d, count(*) n from visitor_calls group by user_id, d) group by user_id) using(user_id)""",
    top3_t="""select v.user_id, {} from visitor v left join (
          select user_id, lng, lat, row_number() over (partition by user_id order by count(*) desc, lng, lat) rn
          from month_stop group by user_id, lng, lat) t on t.user_id = v.user_id group by v.user_id, v.prov""".format(
        ", ".join(f"max(t.{c}) filter (where rn={i}) {c}{i}" for i in (1, 2, 3) for c in ("lng", "lat"))),
    spot_count_t="""select v.user_id, coalesce(n, 0) spots, coalesce(h, 0.0) as hours from visitor v left join (
          select user_id, count(distinct scenic_id) n, sum(dur_h) h from month_stop join scenic_spot using(cell_id)
          group by user_id) using(user_id)""",
    max_dist_t=f"""select v.user_id, coalesce(max({km('s.lng', 's.lat', 'h.lng', 'h.lat')}), -1.0) max_km
        from visitor v left join month_stop s on s.user_id = v.user_id left join home_t h on h.user_id = v.user_id
        group by v.user_id, v.prov""",
    hotel="""select poi_id, lng, lat, case
            when len(string_split(tags, ';')) > 1 and string_split(tags, ';')[2] <> '其他' then
              case string_split(tags, ';')[2] when '星级酒店' then '0' when '快捷酒店' then '1'
                when '公寓式酒店' then case when contains(name, '家庭旅馆') then '3' else 'none' end else 'none' end
            when {0} = '' then 'none' else {0} end label
        from poi where string_split(tags, ';')[1] = '酒店'""".format(_by_name),
    hotel_t=f"""select h.user_id, coalesce(c.hotel_type, 'None') hotel_type from home_t h left join (
          select b.cell_id, coalesce(string_agg(label, '|' order by label) filter (where label <> 'none'), '') hotel_type
          from base_station b join hotel p on {km('b.lng', 'b.lat', 'p.lng', 'p.lat')} <= coalesce(b.radius_m/1000, 1.0)
          group by b.cell_id) c on c.cell_id = h.home_cell""",
    spot_flow_t=f"""select spot, count(*) total, {DAY_COLUMNS} from (
          select distinct spot, "day", user_id from spot_visit) group by spot""",
    spot_avg_t="select spot, sum(micro) / cast(count(*) as double) / 1e6 avg_hours from stay_hours group by spot",
    first_visit="select user_id, spot, min(ts) ts, max(stay_days) stay_days from spot_visit group by user_id, spot",
    migration_t="""select "day", s1, s2, count(*) n from (
          select distinct user_id, "day", s1, s2 from (
            select user_id, "day", spot s1, lead(spot) over (partition by user_id, "day" order by ts, spot) s2
            from spot_stop join visitor using(user_id)) where s2 is not null) group by "day", s1, s2""",
    home_left_t=home_left(True),
    work_left_t=work_left(True),
    work_left_all=work_left(False),
    work_arrival_t=f"""select user_id, sum(h) / cast(count(*) as double) / 7200 work_arrival from (
        select user_id, "day", sec+coalesce(before_sec, sec) h from (
          select *, row_number() over (partition by user_id, "day", work order by sec) rn
          from ({moments('user_work', 'work', False)}) where cell_id = work)
        where rn = 1) where h <> 0 group by user_id""",
    known_home="select * from user_home where lng is not null and lat is not null",
    known_work="select * from user_work where lng is not null and lat is not null",
    radius_t=f"""select user_id, avg(d) radius_km from (
        select s.user_id, s."day", max({km('s.lng', 's.lat', 'h.lng', 'h.lat')}) d
        from local_stop s join known_home h on h.user_id = s.user_id join known_work w on w.user_id = s.user_id
        where isodow(s."day") < 6 and dur_h >= 1 and s.cell_id <> w.cell_id group by s.user_id, s."day")
        group by user_id""",
    trips_t=f"""select u.user_id, coalesce(n, 0) trips, coalesce(h, 0.0) trip_hours from local_user u left join (
        select s.user_id, count(*) n, sum(dur_h) h
        from local_stop s join known_home h on h.user_id = s.user_id join known_work w on w.user_id = s.user_id
        where isodow(s."day") >= 6 and dur_h >= 6 and s.cell_id <> w.cell_id
          and {km('s.lng', 's.lat', 'h.lng', 'h.lat')} >= 10 group by s.user_id) t on t.user_id = u.user_id""",
    resident_spots_t="""select u.user_id, coalesce(n, 0) spots, coalesce(h, 0.0) spot_hours from local_user u left join (
        select user_id, count(distinct scenic_id) n, sum(dur_h) h from local_stop join scenic_spot using(cell_id)
        group by user_id) t using(user_id)""",
    commute_t=f"""select u.user_id, coalesce(t.d, 0.0) commute_km from local_user u left join (
        select h.user_id, {km('h.lng', 'h.lat', 'w.lng', 'w.lat')} d from known_home h
        join known_work w on w.user_id = h.user_id) t on t.user_id = u.user_id""",
    call_records_t="""select u.user_id, count(c.user_id) n from local_user u left join call_end c
        on c.user_id = u.user_id group by u.user_id""",
    callin_t="""select u.user_id, count(distinct c.caller) n from local_user u left join cdr c
        on c.callee = u.user_id group by u.user_id""",
    callout_t="""select u.user_id, count(distinct c.callee) n from local_user u left join cdr c
        on c.caller = u.user_id group by u.user_id""",
    call_features_t="""select u.user_id, coalesce(i.c, 0) callin_contacts, coalesce(i.n, 0) callin_calls,
          coalesce(i.h, 0.0) callin_hours, coalesce(o.c, 0) callout_contacts, coalesce(o.n, 0) callout_calls,
          coalesce(o.h, 0.0) callout_hours, coalesce(a.c, 0) all_contacts, coalesce(a.n, 0) all_calls,
          coalesce(a.ms, 0) all_ms
        from local_user u
        left join (select callee user_id, count(distinct caller) c, count(*) n, sum(dur_ms)/3600000.0 h from cdr
                   where caller is not null and callee is not null group by callee) i on i.user_id = u.user_id
        left join (select caller user_id, count(distinct callee) c, count(*) n, sum(dur_ms)/3600000.0 h from cdr
                   where caller is not null and callee is not null group by caller) o on o.user_id = u.user_id
        left join (select user_id, count(*) c, cast(sum(freq) as bigint) n, cast(sum(dur_ms) as bigint) ms
                   from contact_pair group by user_id) a on a.user_id = u.user_id""",
    circle_features_t="select u.user_id, {} from local_user u left join circle_pair p on p.user_id = u.user_id group by u.user_id".format(
        ", ".join(
            f"count(*) filter (where {c}) {n}_count, cast(coalesce(sum(freq) filter (where {c}), 0) as bigint) {n}_calls, "
            f"cast(coalesce(sum(dur_ms) filter (where {c}), 0) as bigint) {n}_ms" for n, c in CIRCLE.items())),
    local_edge="""select distinct least(caller, callee) a, greatest(caller, callee) b from cdr
        where caller <> callee and caller in (from local_user) and callee in (from local_user)""",
    triangle_t="""select u.user_id, count(t.v) triangles from local_user u left join (
          select unnest([x.a, x.b, y.b]) v from local_edge x join local_edge y on y.a = x.b
          join local_edge z on z.a = x.a and z.b = y.b) t on t.v = u.user_id group by u.user_id""",
    weekday_hours_t=work_hours("< 6"),
    weekend_hours_t=work_hours(">= 6"),
    commuter="""select distinct h.user_id, h.cell_id home, w.cell_id work from user_home h join user_work w
        on w.user_id = h.user_id where h.cell_id <> w.cell_id""",
    numbered="""select s.*, c.home, c.work, row_number() over (partition by s.user_id, s."day", home, work order by ts, s.cell_id) pos
        from (select distinct user_id, "day", ts, cell_id from local_stop) s join commuter c on c.user_id = s.user_id""",
    day_start="""select user_id, home, work, "day", min(pos) p from numbered where cell_id = home
        group by user_id, home, work, "day" """,
    day_end="""select n.user_id, home, work, n."day", min(pos) p from numbered n
        join day_start s using (user_id, home, work, "day")
        where cell_id = work and pos > s.p group by n.user_id, home, work, n."day" """,
    step="""select n.user_id, home, work, n."day", n.cell_id, min(pos) pos from numbered n
        join day_start s using (user_id, home, work, "day") join day_end e using (user_id, home, work, "day")
        where pos between s.p and e.p group by all""",
    edge="""select user_id, home, work, cell_id src, dst, count(*) n from (
        select *, lead(cell_id) over d dst, count(*) over (partition by user_id, home, work, "day") cells from step
        window d as (partition by user_id, home, work, "day" order by pos)) where cells >= 3 and dst is not null
        group by user_id, home, work, cell_id, dst""",
    edge_list="""select user_id, home, work, list(struct_pack(src := src, dst := dst, n := n) order by src, dst) edges
        from edge group by user_id, home, work""",
    # One row for each step of each search: open paths, best first, and the cells that were extended.
    search="""select user_id, home, work, edges,
          [struct_pack(w := 0.0::double, t := 0, i := 0::bigint, path := [home])] paths, []::bigint[] extended, 0 turn
        from edge_list
        union all
        select user_id, home, work, edges, list_sort(paths[2:] || list_transform(
            list_filter(edges, lambda e: e.src = here and not list_contains(extended, e.dst)),
            lambda e, i: struct_pack(w := best.w - e.n, t := -(turn + 1), i := i::bigint, path := list_append(best.path, e.dst)))),
          list_append(extended, here), turn + 1
        from (select *, paths[1] best, paths[1].path[-1] here from search where len(paths) > 0) where here <> work""",
    route_t="""select user_id, home, work, case when len(paths) = 0 then 0.0 else -paths[1].w end weight,
          case when len(paths) = 0 then []::bigint[] else paths[1].path end path
        from search where len(paths) = 0 or paths[1].path[-1] = work""",
)


def hot_routes(lo: int, hi: int) -> str:
    """Spots occur once per sequence, so ordered self-joins count the support of a route exactly."""
    base = f"(select * from first_visit where stay_days between {lo} and {hi})"
    before = "{0}.user_id = {1}.user_id and (({0}.ts, {0}.spot) < ({1}.ts, {1}.spot))"
    lengths = []
    for n in (2, 3, 4):
        joins = f"{base} s0" + "".join(f" join {base} s{i} on {before.format(f's{i-1}', f's{i}')}" for i in range(1, n))
        route = "||'#'||".join(f"s{i}.spot" for i in range(n))
        lengths.append(f"select {n} n, {route} route, count(*) freq from {joins} group by route")
    return f"""select route, freq from (
        select *, row_number() over (partition by n order by freq desc, route) rn from ({' union all '.join(lengths)})
        where freq >= (select ceil(0.001 * count(distinct user_id)) from {base})) where rn <= 3"""


def flow(period: str, keys: str) -> str:
    return f"""select {period} period, count(*) total, {spread_provinces()} from (
        select distinct {keys} user_id, prov from visitor_record
        where ts >= {MONTH_LO} and ts < {MONTH_HI} and user_id in (select user_id from visitor)) group by 1"""


BY_SPOT = f'select spot, {spread_provinces()} from person_day group by spot'

SQL = {
    "visitor_detect": "select user_id, prov, first_date, last_date, stay_days from visitor",
    "transport_mode": f"select user_id, ts, cell_id, {mode('lng', 'lat')} as mode from visitor_stop",
    "transport_in": transport("first_date", "asc"),
    "transport_out": "select * from transport_out_t",
    "visitor_home": "select * from home_t",
    "visitor_type": "select * from type_t",
    "duty_free_visit": "select * from duty_t",
    "call_strength": "select * from strength_t",
    "top3_locations": "select * from top3_t",
    "spot_visit_count": "select * from spot_count_t",
    "max_dist_from_home": "select * from max_dist_t",
    "hotel_classify": "select * from hotel_t",
    "visitor_profile": """select v.user_id, v.prov, transport, visitor_type, duty_free, call_level, spots, hours, max_km,
        lng1, lat1, lng2, lat2, lng3, lat3, home_cell, h.lng home_lng, h.lat home_lat, hotel_type
        from visitor v join transport_out_t using(user_id) join type_t using(user_id) join duty_t using(user_id)
        join strength_t using(user_id) join spot_count_t using(user_id) join max_dist_t using(user_id)
        join top3_t using(user_id) join home_t h using(user_id) join hotel_t using(user_id)""",
    "home_place_count": "select lng, lat, count(distinct user_id) visitors from home_t group by lng, lat",
    "visitor_flow_by_prov": "select * from (" + flow("'202401'", "") + ") union all select * from ("
                            + flow("strftime(d, '%Y%m%d')", "cast(ts as date) d,") + ")",
    "spot_flow_prov_month": BY_SPOT,
    "spot_flow_prov_day": f'select spot, "day", {spread_provinces()} from person_day group by spot, "day"',
    "spot_flow_month": "select * from spot_flow_t",
    "spot_flow_day_hour": f"""select spot, "day", {HOUR_COLUMNS} from (
        select distinct spot, "day", user_id, hour(ts) as hour from spot_visit) group by spot, "day" """,
    "transport_by_prov": f"select transport, {spread_provinces()} from transport_out_t join visitor using(user_id) group by transport",
    "prov_by_transport": "select prov, {} from transport_out_t join visitor using(user_id) group by prov".format(
        ", ".join(f"count(*) filter (where transport={m}) m{m}" for m in range(4))),
    "spot_avg_stay": "select * from spot_avg_t",
    "spot_stay_hist": "select spot, {}, count(*) filter (where micro >= 5000000) b5plus from stay_hours group by spot".format(
        ", ".join(f"count(*) filter (where micro // 1000000 = {h}) b{h}" for h in range(1, 5))),
    "stay_days_hist": """select cast(d as int) stay_days, count(distinct user_id) n from range(3, 16) r(d)
        left join visitor on stay_days = d group by d""",
    "daily_in_out": f"""select cast(d as date) as "day", count(distinct a.user_id) n_in, count(distinct b.user_id) n_out
        from range(timestamp '2024-01-01', timestamp '2024-02-01', interval 1 day) r(d)
        left join visitor a on a.first_date = d left join visitor b on b.last_date = d group by d""",
    "spot_rank": """select s.spot, coalesce(f.total, 0) flow, coalesce(a.avg_hours, 0.0) avg_hours,
        coalesce(f.total, 0) * coalesce(a.avg_hours, 0.0) / 1000 cum_hours
        from (select distinct scenic_id spot from scenic_spot) s left join spot_flow_t f on f.spot = s.spot
        left join spot_avg_t a on a.spot = s.spot""",
    "spot_concentration": """select spot, sqrt(sum(n*n)) / sum(n) * 100 g from (
        select spot, case when prov in (309, 327) or prov > 331 then -1 else prov end p, cast(count(*) as double) n
        from person_day group by spot, p) group by spot""",
    "nearest_poi_dist": f"""select s.scenic_id spot, min({km('b.lng', 'b.lat', 'p.lng', 'p.lat')}) km
        from scenic_spot s join base_station b using(cell_id),
             (select distinct lng, lat from poi where string_split(tags, ';')[1] = '购物') p group by s.scenic_id""",
    "hot_routes_short": hot_routes(3, 5),
    "hot_routes_long": hot_routes(6, 10),
    "hot_routes_deep": hot_routes(11, 15),
    "migration_day": "select * from migration_t",
    "migration_month": "select s1, s2, cast(sum(n) as bigint) n from migration_t group by s1, s2",
    "call_records_per_user": "select * from call_records_t",
    "callin_contacts": "select * from callin_t",
    "callout_contacts": "select * from callout_t",
    "home_left_time": "select * from home_left_t",
    "work_left_time": "select * from work_left_t",
    "home_left_time_all": home_left(False),
    "work_left_time_all": "select * from work_left_all",
    "work_arrival_time": "select * from work_arrival_t",
    "home_arrival_time": f"""select user_id, sum(h) / cast(count(*) as double) / 3600 home_arrival from (
        select s.user_id, s."day", coalesce(max(86399 - {SEC}) filter (
            where s.cell_id = h.cell_id and round((86399 - {SEC})/3600.0, 9) < round(w.work_left, 9)), 0) h
        from local_stop s join user_home h on h.user_id = s.user_id join work_left_all w on w.user_id = s.user_id
        where isodow(s."day") < 6 group by s.user_id, s."day", h.cell_id) group by user_id""",
    "life_radius": "select * from radius_t",
    "trip_count": "select user_id, trips from trips_t",
    "trip_hours": "select user_id, trip_hours from trips_t",
    "resident_spots": "select user_id, spots from resident_spots_t",
    "resident_spot_hours": "select user_id, spot_hours from resident_spots_t",
    "commute_dist": "select * from commute_t",
    "resident_profile": f"""select u.user_id, r.n call_records, i.n callin_contacts, o.n callout_contacts, home_left,
        work_left, radius_km, trips, trip_hours, spots, spot_hours,
        {km('h.lng', 'h.lat', 'w.lng', 'w.lat')} commute_km, h.lng home_lng, h.lat home_lat,
        w.lng work_lng, w.lat work_lat
        from local_user u join call_records_t r using(user_id) join callin_t i using(user_id)
        join callout_t o using(user_id) join home_left_t using(user_id) join work_left_t using(user_id)
        join radius_t using(user_id) join trips_t using(user_id) join resident_spots_t using(user_id)
        join known_home h using(user_id) join known_work w using(user_id)""",
    "work_hours_weekday": "select * from weekday_hours_t",
    "work_hours_weekend": "select * from weekend_hours_t",
    "rank_arrival": rank("work_arrival_t", "work_arrival", "<"),
    "rank_weekday_hours": rank("weekday_hours_t", "work_hours", ">"),
    "rank_weekend_hours": rank("weekend_hours_t", "work_hours", ">"),
    "social_circle_calls": """select 0 as type, freq, dur_ms/60000.0 as minutes from circle_pair where family
        union all select 1, freq, dur_ms/60000.0 from circle_pair where colleague
        union all select 2, freq, dur_ms/60000.0 from circle_pair where not family and not colleague""",
    "call_features": "select * from call_features_t",
    "all_contacts": "select user_id, all_contacts from call_features_t",
    "all_call_stats": "select user_id, all_calls, all_ms from call_features_t",
    "callin_stats": "select user_id, callin_calls, callin_hours from call_features_t",
    "callout_stats": "select user_id, callout_calls, callout_hours from call_features_t",
    "circle_features": "select * from circle_features_t",
    **{f"{n}_pairs": f"select user_id, contact from circle_pair where {c}" for n, c in CIRCLE.items()},
    **{f"{n}_count": f"select user_id, {n}_count from circle_features_t" for n in CIRCLE},
    **{f"{n}_stats": f"select user_id, {n}_calls, {n}_ms from circle_features_t" for n in CIRCLE},
    "triangle_count": "select * from triangle_t",
    "social_features": """select * from call_features_t join circle_features_t using(user_id)
        join triangle_t using(user_id)""",
    "daily_trajectory": """select user_id, home, work, "day", string_agg(cell_id, '#' order by pos) route, count(*) cells
        from step group by user_id, home, work, "day" """,
    "transition_weights": "select * from edge",
    "best_route": "select user_id, home, work, weight, array_to_string(path, '#') path from route_t",
    "representative_route": """select user_id, home, work, {}, string_agg(coalesce(lng::varchar, 'None') || ','
          || coalesce(lat::varchar, 'None'), ',' order by pos) route
        from (select user_id, home, work, unnest(path) cell_id, generate_subscripts(path, 1) pos from route_t)
        left join base_station using (cell_id) group by user_id, home, work""".format(
        ", ".join(f"max({c}) filter (where cell_id = {p}) {p}_{c}" for p in ("home", "work") for c in ("lng", "lat"))),
    "stop_speed": f"""select user_id, ts, cell_id, km, coalesce(km * 3600.0 / nullif(s, 0), 0.0) kmh from (
        select *, {km('f_lng', 'f_lat', 'lng', 'lat')} km, date_diff('second', f_ts, ts) s from (
          select *, lag(ts) over w f_ts, lag(lng) over w f_lng, lag(lat) over w f_lat from (
            select distinct user_id, "day", ts, cell_id, lng, lat from visitor_stop)
          window w as (partition by user_id, "day" order by ts, cell_id)) where f_ts is not null)""",
    "record_stamps": """select user_id, strftime(ts, '%Y%m%d%H%M%S') as text, epoch_ms(ts) as millis,
        strftime(ts, '%Y%m%d%H%M%S') as round_trip, isodow(ts) < 6 as weekday from local_record""",
    "stay_dates": """select user_id, prov, cast(unnest(generate_series(first_date, last_date, interval 1 day)) as date) "day"
        from visitor""",
    "poi_tfidf": "select cell_id, poi_sum, " + ", ".join(f"n_{c}" for c in POI_CLASSES) + ", " + ", ".join(
        f"""case when poi_sum = 0 then 1.0 else n_{c} * 1.0 / poi_sum
          * ln(count(*) over () * 1.0 / case when w_{c} = 0 then 1 else w_{c} end) end score_{c}"""
        for c in POI_CLASSES) + " from (select *, " + ", ".join(
        f"count(*) filter (where n_{c} > 0) over () w_{c}" for c in POI_CLASSES) + " from poi_vector)",
    "commute_time": """select coalesce(a.user_id, b.user_id) user_id, coalesce(a.home, b.home) home, coalesce(a.work, b.work) work,
          coalesce(a.n, 0) days_to_work, a.h to_work_h, coalesce(b.n, 0) days_to_home, b.h to_home_h
        from (select user_id, home, work, count(*) n, avg(way) / 3600 h from (
            select w.user_id, w.home, w.work, w."day", arg_min(w.sec - h.sec, w.sec) way from way_moment w
            asof join (select * from way_moment where at_home) h on h.user_id = w.user_id and h.home = w.home and h.work = w.work and h."day" = w."day" and w.sec > h.sec
            where not w.at_home group by all) group by user_id, home, work) a
        full join (select user_id, home, work, count(*) n, avg(way) / 3600 h from (
            select w.user_id, w.home, w.work, w."day", arg_max(h.sec - w.sec, w.sec) way from way_moment w
            asof join (select * from way_moment where at_home) h on h.user_id = w.user_id and h.home = w.home and h.work = w.work and h."day" = w."day" and w.sec < h.sec
            where not w.at_home group by all) group by user_id, home, work) b
        on a.user_id = b.user_id and a.home = b.home and a.work = b.work""",
}


# The columns of type double, which are rounded as in the registered queries.
DOUBLES = {
    "visitor_home": "lng lat",
    "top3_locations": "lng1 lat1 lng2 lat2 lng3 lat3",
    "spot_visit_count": "hours",
    "max_dist_from_home": "max_km",
    "visitor_profile": "hours max_km lng1 lat1 lng2 lat2 lng3 lat3 home_lng home_lat",
    "home_place_count": "lng lat",
    "spot_avg_stay": "avg_hours",
    "spot_rank": "avg_hours cum_hours",
    "spot_concentration": "g",
    "nearest_poi_dist": "km",
    "home_left_time": "home_left",
    "work_left_time": "work_left",
    "home_left_time_all": "home_left",
    "work_left_time_all": "work_left",
    "work_arrival_time": "work_arrival",
    "home_arrival_time": "home_arrival",
    "life_radius": "radius_km",
    "trip_hours": "trip_hours",
    "resident_spot_hours": "spot_hours",
    "commute_dist": "commute_km",
    "resident_profile": "home_left work_left radius_km trip_hours spot_hours commute_km "
                        "home_lng home_lat work_lng work_lat",
    "work_hours_weekday": "work_hours",
    "work_hours_weekend": "work_hours",
    "rank_arrival": "ratio",
    "rank_weekday_hours": "ratio",
    "rank_weekend_hours": "ratio",
    "social_circle_calls": "minutes",
    "call_features": "callin_hours callout_hours",
    "callin_stats": "callin_hours",
    "callout_stats": "callout_hours",
    "social_features": "callin_hours callout_hours",
    "best_route": "weight",
    "representative_route": "home_lng home_lat work_lng work_lat",
    "stop_speed": "km kmh",
    "poi_tfidf": " ".join(f"score_{c}" for c in POI_CLASSES),
    "commute_time": "to_work_h to_home_h",
}


def _rounded(name: str) -> str:
    columns = [f'floor("{c}" * 1e6 + 0.5) / 1e6 as "{c}"' for c in DOUBLES.get(name, "").split()]
    replaced = f" replace ({', '.join(columns)})" if columns else ""
    return f"select *{replaced} from ({SQL[name]})"


def statements() -> dict[str, str]:
    return {name: with_tables(_rounded(name)) for name in SQL}
