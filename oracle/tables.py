"""The derived input tables as DuckDB CTEs, and a helper that puts the needed ones before a query."""

from __future__ import annotations

import re

MONTH_LO, MONTH_HI = "date '2024-01-01'", "date '2024-02-01'"
IN_STAY = "m.user_id%2=0 and day(m.ts) between 1+(m.user_id*7)%15 and 2+(m.user_id*7)%15+(m.user_id*5)%17"
# The order of the province columns.
PROVINCES = [301, 303, 331, 311, 308, 325, 305, 318, 310, 328, 313, 322, 319, 323, 304,
             315, 329, 306, 302, 324, 312, 321, 320, 307, 316, 314, 326, 317, 330, 300]

STOP = """select cast(m.ts as date) "day", 'u'||m.user_id user_id, m.ts, m.cell_id, 0.5+m.value/20 dur_h, b.lng, b.lat
          from fx_move m join base_station b using(cell_id) where m.event_type<>'error' and """


def km(lng1: str, lat1: str, lng2: str, lat2: str) -> str:
    return (f"(2*6371.004*asin(sqrt(pow(sin(radians({lat1}-({lat2}))/2),2)+cos(radians({lat1}))"
            f"*cos(radians({lat2}))*pow(sin(radians({lng1}-({lng2}))/2),2))))")


def place(cell: str, unknown: str, second: str, has_second: str) -> str:
    return f"""select 'u'||u.user_id user_id, u.cell_id,
                 case when not ({unknown}) then b.lng end lng, case when not ({unknown}) then b.lat end lat
               from (select user_id, cast({cell} as bigint) cell_id from fx_user u
                     union all select user_id, cast({second} as bigint) from fx_user u where {has_second}) u
               join base_station b on b.cell_id=u.cell_id where u.user_id%2=1"""


CTES = {
    "fx_event": """select user_id, date_trunc('second', ts) ts, event_type, value,
                     cast(json_extract_string(props,'$.k') as int) k from (
          select * from events
          union all select * replace (ts - interval 31 day as ts) from events where event_id%23=0
          union all select * replace (ts + interval 31 day as ts) from events where event_id%23<>0 and event_id%29=0
          union all select * from events where event_id%23<>0 and event_id%29<>0 and event_id%31=0)""",
    "fx_user": "select distinct user_id from fx_event",
    "fx_move": """select user_id, ts, event_type, value, k,
                    cast(case k%5 when 0 then (user_id%6)*5 when 1 then (user_id%4)*5+51
                         else (user_id*13+(k%8)*7)%100 end as bigint) cell_id from fx_event""",
    "base_station": """select cast(k as bigint) cell_id,
          cast(case k%10 when 1 then 110.293096+k*0.0002 when 3 then 110.466232+k*0.0002
            when 7 then 109.499415+k*0.0002 else 108.8+((k*37)%100)*0.022 end as double) lng,
          cast(case k%10 when 1 then 20.026518 when 3 then 19.945878
            when 7 then 18.302055 else 18.3+((k*53)%100)*0.018 end as double) lat,
          cast(case when k%5=0 then null else 500+(k%7)*2000 end as double) radius_m
        from (select distinct k from fx_event)""",
    "scenic_spot": "select cast(1+cell_id%25 as int) scenic_id, cell_id from base_station where cell_id%3=0",
    "visitor_record": f"""select 'u'||m.user_id user_id, m.ts, m.cell_id, b.lng, b.lat, 300+c.c_nationkey prov
        from fx_move m join base_station b using(cell_id) join customer c on c.c_custkey=m.user_id
        where {IN_STAY}""",
    "visitor_stop": STOP + IN_STAY,
    "local_record": """select 'u'||m.user_id user_id, m.ts, m.cell_id, b.lng, b.lat, 327 prov
        from fx_move m join base_station b using(cell_id) where m.user_id%2=1""",
    "local_stop": STOP + "m.user_id%2=1",
    "user_home": place("(u.user_id%6)*5", "u.user_id%11=0", "(u.user_id*13+14)%100", "u.user_id%7=3"),
    "user_work": place("(u.user_id%4)*5+51", "u.user_id%13=0", "(u.user_id*13+21)%100", "u.user_id%9=4"),
    "cdr": """select ts call_ts, 'u'||user_id caller,
          case when k=99 then null else 'u'||(
            (case when k%2=0 then user_id+1+k%7 else user_id//8*8+k%3 end)::bigint
            % (select max(user_id)+1 from fx_event)) end callee,
          cast(round(value*100) as bigint)*600 dur_ms
        from fx_event where user_id%4<>0 or k%10=0""",
    "poi": """select p.p_partkey poi_id, p.p_name||' '||(['快捷','公寓','家庭旅馆','客栈','青年',
            '商务','招待所','温泉','海景','情侣','短租','别墅',''])[1+p.p_size%13] "name",
          case p.p_type when 'STANDARD' then '酒店;星级酒店' when 'SMALL' then '酒店;快捷酒店'
            when 'LARGE' then '酒店;公寓式酒店' when 'ECONOMY' then '酒店'
            when 'MEDIUM' then '酒店;其他' else '购物' end tags,
          b.lng+(p.p_size-25)*0.002 lng, b.lat+(p.p_size-25)*0.001 lat, p.p_retailprice price
        from part p join base_station b on b.cell_id=p.p_partkey%100""",
    "visitor": f"""select user_id, prov, cast(min(ts) as date) first_date, cast(max(ts) as date) last_date,
          cast(date_diff('day', cast(min(ts) as date), cast(max(ts) as date))+1 as int) stay_days
        from visitor_record where ts >= {MONTH_LO} and ts < {MONTH_HI}
        group by user_id, prov
        having date_diff('day', cast(min(ts) as date), cast(max(ts) as date))+1 between 3 and 15""",
    # Spot stops of the whole input, and those of the month joined to the visitors.
    "spot_stop": """select s.*, c.scenic_id spot from visitor_stop s join scenic_spot c using(cell_id)
        where dur_h >= 1 and hour(ts) between 7 and 20""",
    "spot_visit": f"""select s.*, v.prov, v.stay_days from spot_stop s join visitor v using(user_id)
        where "day" >= {MONTH_LO} and "day" < {MONTH_HI}""",
    "month_stop": f"select * from visitor_stop where ts >= {MONTH_LO} and ts < {MONTH_HI} and dur_h >= 1",
    "local_user": "select distinct user_id from local_record",
}


def register(**ctes: str) -> None:
    """Add CTEs that other statements build on."""
    CTES.update(ctes)


def with_tables(sql: str) -> str:
    """``sql`` with every CTE it mentions, directly or through other CTEs, in order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    parts = [f"{name} as ({body})" for name, body in CTES.items() if name in needed]
    return f"with recursive {', '.join(parts)} {sql}" if parts else sql


def spread_provinces(count: str = "count(*)") -> str:
    listed = ",".join(map(str, PROVINCES))
    columns = [f"{count} filter (where prov={p}) as p_{p}" for p in PROVINCES]
    return ", ".join([*columns, f"{count} filter (where prov not in ({listed})) as p_else"])
