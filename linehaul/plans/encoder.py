"""Encoder, facet and similarity queries on the derived timetable."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from linehaul.functions import scalars as S
from linehaul.operators import encoder as E
from linehaul.operators import facets as FA
from linehaul.operators import graph as G
from linehaul.operators import inference as I
from linehaul.operators import network as N
from linehaul.operators import search as R
from linehaul.plans.network import _GAPS, _HAVERSINE, _PEAK, calls
from linehaul.scratch import Scratch
from linehaul.sources import arrays as AR
from linehaul.sources import timetable as T
from linehaul.sources.timetable import with_sql

QUERIES, ORACLES = {}, {}
#: Vector width, rounds of messages and facet widths of the registered queries.
WIDTH, LAYERS, FACET = 8, 2, 6
FACETS = ("base", "general", "role", "service", "geometry", "resilience")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def graph(spark, sf_dir, scratch):
    """The graph of the timetable, its parts written once; trips are put together once, whole, and all parts come from them."""
    keep = lambda df, name: scratch.table(df, name)
    trips, st, walks = keep(N.whole_trips(calls(spark, sf_dir)), "trips"), T.stations(spark, sf_dir), T.transfers(spark, sf_dir)
    c, s, signed = N.trip_calls(trips), N.trip_segments(trips), N.trip_signatures(trips)
    pats, edges, serves = N.numbered_patterns(signed, scratch), keep(N.transit_edges(s), "edges"), keep(G.serves(c), "serves")
    modes = serves.select("line").distinct().withColumn("bucket", F.substring("line", 1, 1).cast("int") - 1)
    platforms = T.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("station")).agg(F.count(F.lit(1)).alias("platform_count"))
    return {
        "station_features": keep(G.station_features(st, c, signed, modes, walks, platforms, pats), "station_features"),
        "line_features": keep(G.line_features(G.line_statistics(c, st, modes, signed, pats, edges, serves)), "line_features"),
        "edge_features": keep(G.edge_features(edges, N.pattern_edge_positions(pats), st), "edge_features"),
        "station_channels": keep(E.temporal_channels(c, "station"), "station_channels"),
        "line_channels": keep(E.temporal_channels(c, "line"), "line_channels"),
        "serves": serves,
        "transfers": walks,
        "interchanges": keep(N.interchanges(serves), "interchanges"),
        "line_patterns": E.pattern_stops(pats),
    }


def vectors_sql(width: int, f: str) -> str:
    return "[" + ", ".join(f.format(i=i) for i in range(1, width + 1)) + "]"


def _projected(seed: int) -> str:
    return f"list_transform(range({WIDTH}), lambda o: tanh(list_sum(list_transform(range(len(x)), lambda i: x[i + 1] * sin((i + {seed + 1}) * (o + 1) * 0.017::DOUBLE) * 0.05::DOUBLE))))"


def _channels(key: str, c0: str, c1: str, c2: str, gap_rows: str) -> str:
    return f"""(SELECT s.{key}, [list(coalesce(a.c0, 0) ORDER BY b.bin), list(coalesce(d.c1, 0) ORDER BY b.bin), list(coalesce(a.c2, 0) ORDER BY b.bin), list(coalesce(g.c3, 0) ORDER BY b.bin)]::DOUBLE[][] AS ch
 FROM (SELECT DISTINCT {key} FROM calls) s CROSS JOIN (SELECT unnest(range(128)) AS bin) b
 LEFT JOIN (SELECT {key}, least(departure // 900, 127) AS bin, {c0} AS c0, {c2} AS c2 FROM {gap_rows} GROUP BY 1, 2) a ON a.{key} = s.{key} AND a.bin = b.bin
 LEFT JOIN (SELECT {key}, least({'arrival' if key == 'station' else 'departure'} // 900, 127) AS bin, {c1} AS c1 FROM {gap_rows} GROUP BY 1, 2) d ON d.{key} = s.{key} AND d.bin = b.bin
 LEFT JOIN (SELECT {key}, bin, list_sort(list(gap))[count(*) // 2 + 1] AS c3 FROM (SELECT {key}, least(departure // 900, 127) AS bin, departure - lag(departure) OVER (PARTITION BY {key}, least(departure // 900, 127) ORDER BY departure) AS gap FROM {gap_rows})
  WHERE gap IS NOT NULL GROUP BY 1, 2) g ON g.{key} = s.{key} AND g.bin = b.bin GROUP BY s.{key})"""


_BEARING = "atan2(sin(radians(y.lon - x.lon)) * cos(radians(y.lat)), cos(radians(x.lat)) * sin(radians(y.lat)) - sin(radians(x.lat)) * cos(radians(y.lat)) * cos(radians(y.lon - x.lon)))"
_UNIT = "CASE WHEN s.lat = 0 AND s.lon = 0 THEN 0 ELSE least(greatest((s.{0} - {0}0) / greatest({0}1 - {0}0, 2.220446049250313e-16), 0), 1) END"

#: Features of stations (stf), lines (lnf) and edges (ef), each with a list f, and channels (sch, lch) with lists ch.
FEATURES_SQL = f"""
box AS (SELECT min(lat) AS lat0, max(lat) AS lat1, min(lon) AS lon0, max(lon) AS lon1 FROM st WHERE NOT (lat = 0 AND lon = 0)),
sst AS (SELECT station, count(DISTINCT line) AS lines, count(*) AS n, min(departure) AS first, max(arrival) AS last, {', '.join(f"count(DISTINCT line) FILTER (line LIKE '{k + 1}%') AS m{k}" for k in range(5))} FROM calls GROUP BY station),
spt AS (SELECT c.station, count(DISTINCT pattern) AS n FROM calls c JOIN pat p ON c.trip_id = p.trip_id GROUP BY c.station),
sdg AS (SELECT from_station AS station, count(DISTINCT to_station) AS n FROM (SELECT from_station, to_station FROM tf UNION ALL SELECT to_station, from_station FROM tf) GROUP BY 1),
sen AS (SELECT DISTINCT CAST(unnest([split_part(stops, ',', 1), split_part(stops, ',', -1)]) AS INT) AS station FROM sig),
spl AS (SELECT CAST(s_nationkey AS INT) AS station, count(*) AS n FROM supplier GROUP BY 1),
stf AS (SELECT s.station, [{_UNIT.format('lon')}, {_UNIT.format('lat')}, coalesce(p.n, 0), coalesce(a.lines, 0), coalesce(t.n, 0), {', '.join(f'coalesce(m{k}, 0)' for k in range(5))}, coalesce(first, 0) / 115200.0::DOUBLE, coalesce(last, 0) / 115200.0::DOUBLE,
        ln(coalesce(a.n, 0) + 1), ln(coalesce(a.n, 0) + 1), coalesce(d.n, 0), CASE WHEN e.station IS NULL THEN 0 ELSE 1 END]::DOUBLE[] AS f
        FROM st s CROSS JOIN box LEFT JOIN spl p ON p.station = s.station LEFT JOIN sst a ON a.station = s.station LEFT JOIN spt t ON t.station = s.station LEFT JOIN sdg d ON d.station = s.station LEFT JOIN sen e ON e.station = s.station),
lns AS (SELECT line, count(*) AS stations, avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END::DOUBLE) AS uq, sum(CASE WHEN k = 1 THEN 0 ELSE 1 END) AS tr FROM (SELECT line, station, count(*) OVER (PARTITION BY station) AS k FROM (SELECT DISTINCT line, station FROM calls)) GROUP BY line),
lnt AS (SELECT line, greatest(max(arrival) - min(departure), 0) AS span FROM calls GROUP BY line),
lnp AS (SELECT line, count(DISTINCT pattern) AS patterns, count(*) AS trips FROM pat GROUP BY line),
lnb AS (SELECT line, avg(CASE WHEN split_part(stops, ',', 1) <> split_part(stops, ',', -1) THEN 1.0 ELSE 0.0 END::DOUBLE) AS br FROM (SELECT DISTINCT line, pattern, stops FROM pat) GROUP BY line),
lnh AS (SELECT line, avg(CASE WHEN k > 1 THEN 1.0 ELSE 0.0 END::DOUBLE) AS sh FROM (SELECT a, b, line, count(*) OVER (PARTITION BY a, b) AS k FROM (SELECT DISTINCT a, b, line FROM seg)) GROUP BY line),
lnm AS (SELECT line, sum({_HAVERSINE.format('x.lat', 'y.lat', 'x.lon', 'y.lon')}) AS metres FROM (SELECT DISTINCT a, b, line FROM seg) s JOIN st x ON x.station = a JOIN st y ON y.station = b GROUP BY line),
lne AS (SELECT line, max({_HAVERSINE.format('x.lat', 'y.lat', 'x.lon', 'y.lon')}) AS reach FROM (SELECT DISTINCT line, CAST(split_part(stops, ',', 1) AS INT) AS a, CAST(split_part(stops, ',', -1) AS INT) AS b FROM sig) p JOIN st x ON x.station = a JOIN st y ON y.station = b GROUP BY line),
lnf AS (SELECT s.line, [{', '.join(f"CASE WHEN s.line LIKE '{k + 1}%' THEN 1 ELSE 0 END" for k in range(5))}, ln(stations + 1), ln(patterns + 1), coalesce(metres, 0) / 10000, coalesce(reach, 0) / 10000, br, span / 115200.0::DOUBLE, ln(trips + 1),
        coalesce(g.h, 0) / 3600.0::DOUBLE, coalesce(q.h, 0) / 3600.0::DOUBLE, coalesce(o.h, 0) / 3600.0::DOUBLE, ln(tr + 1), uq, coalesce(sh, 0)]::DOUBLE[] AS f
        FROM lns s JOIN lnt t ON t.line = s.line JOIN lnp p ON p.line = s.line JOIN lnb b ON b.line = s.line LEFT JOIN lnh h ON h.line = s.line LEFT JOIN lnm m ON m.line = s.line LEFT JOIN lne e ON e.line = s.line
        LEFT JOIN {_GAPS.format('true')} g ON g.line = s.line LEFT JOIN {_GAPS.format(_PEAK)} q ON q.line = s.line LEFT JOIN {_GAPS.format('NOT ' + _PEAK)} o ON o.line = s.line),
rkd AS (SELECT trip_id, pattern, row_number() OVER (PARTITION BY pattern ORDER BY first_departure, trip_id) AS trip_rank FROM pat),
epo AS (SELECT a, b, s.line, arg_min(pos / CAST(greatest(s.n - 1, 1) AS DOUBLE), (pattern, trip_rank, pos)) AS place FROM seg s JOIN rkd r ON r.trip_id = s.trip_id GROUP BY 1, 2, 3),
ef AS (SELECT e.a, e.b, e.line, [{_HAVERSINE.format('x.lat', 'y.lat', 'x.lon', 'y.lon')} / 10000, median / 3600.0::DOUBLE, least / 3600.0::DOUBLE, ln(trips + 1), place, sin({_BEARING}), cos({_BEARING})]::DOUBLE[] AS f
       FROM edge e JOIN epo o ON o.a = e.a AND o.b = e.b AND o.line = e.line JOIN st x ON x.station = e.a JOIN st y ON y.station = e.b),
sch AS {_channels('station', 'count(*)', 'count(*)', 'count(DISTINCT line)', 'calls')},
lch AS {_channels('line', 'count(*)', 'count(*)', 'count(*)', '(SELECT * FROM calls WHERE pos = 0)')}"""

_MEANS = lambda v: vectors_sql(WIDTH, f"avg({v}[{{i}}])")
_AT = "coalesce({0}[i + 1], 0)"


def _round_sql(k: int) -> str:
    s, t = f"sv{k}", f"lv{k}"
    wave = lambda layer: f"sin(i * 0.0001::DOUBLE + {layer} * 0.01::DOUBLE) * 0.001::DOUBLE"
    return f""",
tol{k} AS (SELECT a.line, {_MEANS('v.v')} AS v FROM srv a JOIN {s} v ON v.station = a.station GROUP BY a.line),
tos{k} AS (SELECT a.station, {_MEANS('v.v')} AS v FROM srv a JOIN {t} v ON v.line = a.line GROUP BY a.station),
wlk{k} AS (SELECT a.to_station AS station, {_MEANS('v.v')} AS v FROM tf a JOIN {s} v ON v.station = a.from_station GROUP BY 1),
rid{k} AS (SELECT e.b AS station, {vectors_sql(WIDTH, "avg(v.v[{i}] * 0.5::DOUBLE + w.v[{i}] * 0.25::DOUBLE + e.f[({i} - 1) % 7 + 1] * 0.001::DOUBLE)")} AS v FROM ef e JOIN {s} v ON v.station = e.a JOIN {t} w ON w.line = e.line GROUP BY 1),
chg{k} AS (SELECT a.other AS line, {_MEANS('v.v')} AS v FROM ich a JOIN {t} v ON v.line = a.line GROUP BY 1),
sv{k + 1} AS MATERIALIZED (SELECT s.station, list_transform(range({WIDTH}), lambda i: tanh(s.v[i + 1] * 0.58::DOUBLE + {_AT.format('a.v')} * 0.14::DOUBLE + {_AT.format('b.v')} * 0.12::DOUBLE + {_AT.format('c.v')} * 0.16::DOUBLE + {wave(k)})) AS v
  FROM {s} s LEFT JOIN tos{k} a ON a.station = s.station LEFT JOIN wlk{k} b ON b.station = s.station LEFT JOIN rid{k} c ON c.station = s.station),
lv{k + 1} AS MATERIALIZED (SELECT l.line, list_transform(range({WIDTH}), lambda i: tanh(l.v[i + 1] * 0.58::DOUBLE + {_AT.format('a.v')} * 0.2::DOUBLE + {_AT.format('b.v')} * 0.14::DOUBLE + {wave(f'{k}.5')})) AS v
  FROM {t} l LEFT JOIN tol{k} a ON a.line = l.line LEFT JOIN chg{k} b ON b.line = l.line)"""


_SUMMED = "list_concat(f, coalesce(flatten(list_transform(ch, lambda c: [list_avg(c), greatest(list_max(c), 0)])), [0, 0, 0, 0, 0, 0, 0, 0]::DOUBLE[])) AS x"
#: Projected vectors (sp, lp), contexts (ctx) and the vectors after the last round (svN, lvN).
ENCODER_SQL = FEATURES_SQL + f""",
sv0 AS MATERIALIZED (SELECT station, {_projected(E.STATION_SEED)} AS v FROM (SELECT s.station, {_SUMMED} FROM stf s LEFT JOIN sch c ON c.station = s.station)),
lp AS MATERIALIZED (SELECT line, {_projected(E.LINE_SEED)} AS v FROM (SELECT s.line, {_SUMMED} FROM lnf s LEFT JOIN lch c ON c.line = s.line)),
pq AS (SELECT row_number() OVER () AS p, line, CAST(string_split(stops, ',') AS INT[]) AS sl, CAST(string_split(pu, ',') AS INT[]) AS ul, CAST(string_split(dr, ',') AS INT[]) AS dl, trips FROM (SELECT line, stops, pu, dr, count(*) AS trips FROM sig GROUP BY 1, 2, 3, 4)),
pe AS (SELECT *, unnest(range(len(sl))) AS pos FROM pq),
px AS (SELECT p, e.line, trips, pos, list_transform(range({WIDTH}), lambda i: coalesce(s.v[i + 1], 0) * 0.34::DOUBLE + coalesce(g.f[i % 7 + 1], 0) * 0.08::DOUBLE + l.v[i + 1] * 0.05::DOUBLE + pos / CAST(greatest(len(sl) - 1, 1) AS DOUBLE) * 0.002::DOUBLE
         + (ul[pos + 1] / 3.0::DOUBLE * sin((i + 1) * 0.37::DOUBLE) + dl[pos + 1] / 3.0::DOUBLE * sin((i + 1) * 0.74::DOUBLE) + pos / CAST(greatest(len(sl) - 1, 1) AS DOUBLE) * sin((i + 1) * 1.11::DOUBLE)) * 0.03::DOUBLE) AS x
       FROM pe e LEFT JOIN sv0 s ON s.station = sl[pos + 1] LEFT JOIN ef g ON g.a = sl[pos + 1] AND g.b = sl[pos + 2] AND g.line = e.line JOIN lp l ON l.line = e.line),
pf AS (SELECT line, trips, list_reduce(list(x ORDER BY pos), lambda s, x: list_transform(range({WIDTH}), lambda i: tanh(s[i + 1] * 0.58::DOUBLE + x[i + 1])), {vectors_sql(WIDTH, '0::DOUBLE')}) AS v FROM px GROUP BY p, line, trips),
ctx AS (SELECT line, {vectors_sql(WIDTH, 'sum(v[{i}] * trips) / sum(trips)')} AS v FROM pf GROUP BY line),
lv0 AS MATERIALIZED (SELECT l.line, list_transform(range({WIDTH}), lambda i: tanh(l.v[i + 1] + {_AT.format('c.v')} * 0.22::DOUBLE)) AS v FROM lp l LEFT JOIN ctx c ON c.line = l.line),
srv AS (SELECT DISTINCT station, line FROM calls),
ich AS (SELECT DISTINCT x.line, y.line AS other FROM srv x JOIN srv y ON x.station = y.station AND x.line <> y.line)""" + "".join(_round_sql(k) for k in range(LAYERS))  # fmt: skip

_NAMED = "SELECT {key}, unnest([{names}]) AS feature, round(unnest(f), 6) AS value FROM {view}"


def _long(vector: str, keys: str, view: str) -> str:
    return f"SELECT {keys}, CAST(unnest(range(len({vector}))) AS INT) AS place, round(unnest({vector}), 6) AS value FROM {view}"


def features_sql(view: str, key: str, names) -> str:
    return with_sql("SELECT 1").replace("\nSELECT 1", "," + FEATURES_SQL + "\n" + _NAMED.format(key=key, view=view, names=", ".join(f"'{n}'" for n in names)))


def encoder_sql(query: str) -> str:
    return with_sql("SELECT 1").replace("\nSELECT 1", "," + ENCODER_SQL + "\n" + query)


def _rows(df, keys, vector):
    return df.select(*keys, F.posexplode(vector).alias("place", "value")).select(*keys, "place", F.round("value", 6).alias("value"))


def _channel_rows(df, key):
    long = df.select(key, F.posexplode("channels").alias("channel", "c")).select(key, "channel", F.posexplode("c").alias("bin", "value"))
    return long.where("value <> 0")


_CHANNEL = "SELECT {0}, channel, CAST(bin - 1 AS INT) AS bin, c[bin] AS value FROM (SELECT {0}, channel, c, unnest(range(1, 129)) AS bin FROM (SELECT {0}, CAST(unnest(range(4)) AS INT) AS channel, unnest(ch) AS c FROM {1})) WHERE c[bin] <> 0"


@query("station_channels", encoder_sql(_CHANNEL.format("station", "sch")))
def station_channels(spark, sf_dir):
    return _channel_rows(E.temporal_channels(calls(spark, sf_dir), "station"), "station")


@query("line_channels", encoder_sql(_CHANNEL.format("line", "lch")))
def line_channels(spark, sf_dir):
    return _channel_rows(E.temporal_channels(calls(spark, sf_dir), "line"), "line")


@query("pattern_fold", encoder_sql(_long("v", "line", "ctx")))
def pattern_fold(spark, sf_dir):
    scratch = Scratch(spark, "encoder")
    g = graph(spark, sf_dir, scratch)
    rows = lambda kind: g[f"{kind}_features"].join(g[f"{kind}_channels"], kind, "left").select(kind, F.concat("features", E.channel_summary(F.col("channels"))).alias("x"))
    stations = rows("station").select("station", E.feature_projection(WIDTH, E.STATION_SEED)("x").alias("v"))
    lines = rows("line").select("line", E.feature_projection(WIDTH, E.LINE_SEED)("x").alias("v"))
    return _rows(E.fold_patterns(g["line_patterns"], stations, lines, g["edge_features"], WIDTH), ["line"], "context")


@query("encoded_lines", encoder_sql(_long("v", "line", f"lv{LAYERS}")))
def encoded_lines(spark, sf_dir):
    scratch = Scratch(spark, "encoder")
    return _rows(E.encode(graph(spark, sf_dir, scratch), WIDTH, LAYERS, scratch)["lines"], ["line"], "v")


@query("encoded_stations", encoder_sql(_long("v", "station", f"sv{LAYERS}")))
def encoded_stations(spark, sf_dir):
    scratch = Scratch(spark, "encoder")
    return _rows(E.encode(graph(spark, sf_dir, scratch), WIDTH, LAYERS, scratch)["stations"], ["station"], "v")


_SUMMARY = "[list_avg({0}), list_max({0}), list_min({0}), sqrt(list_avg(list_transform({0}, lambda q: (q - list_avg({0})) * (q - list_avg({0})))))]"


def _facet_sql(name: str, x: str, width: int = FACET) -> str:
    step = (FA.SEED + FA.SEEDS[name]) * 0.001 + 0.017
    raw = f"list_transform(range({width}), lambda o: tanh(list_sum(list_transform(range(len({x})), lambda i: {x}[i + 1] / (1 + abs({x}[i + 1])) * (sin((i + 1) * (o + 1) * {step!r}::DOUBLE) + 0.5::DOUBLE * cos((i + 1) * (o + 1) * {step!r}::DOUBLE * 0.61::DOUBLE)))) / sqrt(len({x}))))"
    return raw


def _unit(v: str) -> str:
    return f"CASE WHEN sqrt(list_dot_product({v}, {v})) > 1.1920928955078125e-07 THEN list_transform({v}, lambda q: q / sqrt(list_dot_product({v}, {v}))) ELSE {v} END"


_POOL = lambda v: "[" + ", ".join([*(f"avg({v}[{i}])" for i in range(1, WIDTH + 1)), *(f"greatest(max({v}[{i}]), 0)" for i in range(1, WIDTH + 1))]) + "]"
_S, _L = f"sv{LAYERS}", f"lv{LAYERS}"
_PICKED = "[" + ", ".join(f"t.f[{i + 1}]" for i in FA.STATION_PICKS) + "]"
FACETS_SQL = f""",
pls AS (SELECT a.line, {_POOL('v.v')} AS v FROM srv a JOIN {_S} v ON v.station = a.station GROUP BY a.line),
pll AS (SELECT a.line, {_POOL('v.v')} AS v, count(*)::DOUBLE AS n FROM ich a JOIN {_L} v ON v.line = a.other GROUP BY a.line),
con AS (SELECT line, [avg(x), max(x), min(x), stddev_pop(x)] AS v FROM (SELECT a.line, unnest({_PICKED}) AS x FROM srv a JOIN stf t ON t.station = a.station) GROUP BY line),
ebn AS (SELECT line, CAST(least(floor(f[5] * 16), 15) AS INT) AS bin, {vectors_sql(7, 'avg(f[{i}])')} AS v FROM ef GROUP BY 1, 2),
shp AS (SELECT l.line, list_concat(flatten(list(coalesce(e.v, [0, 0, 0, 0, 0, 0, 0]::DOUBLE[]) ORDER BY b.bin)), [{', '.join(f'any_value(l.f)[{i + 1}]' for i in FA.GEOMETRY_PICKS)}]) AS v FROM lnf l CROSS JOIN (SELECT unnest(range(16)) AS bin) b LEFT JOIN ebn e ON e.line = l.line AND e.bin = b.bin GROUP BY l.line),
cty AS (SELECT list_transform(range({WIDTH}), lambda i: (s.v[i + 1] + s.v[i + {WIDTH + 1}] + l.v[i + 1] + l.v[i + {WIDTH + 1}]) / 4) AS v FROM (SELECT {_POOL('v')} AS v FROM {_S}) s CROSS JOIN (SELECT {_POOL('v')} AS v FROM {_L}) l),
fr0 AS (SELECT l.line, v.v AS lv, l.f AS own, list_concat(list_concat(l.f, flatten(c.ch)), flatten(list_transform(c.ch, lambda y: {_SUMMARY.format('y')}))) AS service, list_concat(h.v, {_SUMMARY.format('h.v')}) AS geometry,
         list_concat(list_concat(p.v, coalesce(q.v, {vectors_sql(2 * WIDTH, '0::DOUBLE')})), list_concat(o.v, [coalesce(q.n, 0), coalesce(q.n, 0)])) AS role
         FROM lnf l JOIN {_L} v ON v.line = l.line JOIN lch c ON c.line = l.line JOIN shp h ON h.line = l.line JOIN pls p ON p.line = l.line LEFT JOIN pll q ON q.line = l.line JOIN con o ON o.line = l.line),
fr1 AS (SELECT *, list_concat(list_concat(own, {_SUMMARY.format('role')}), {_SUMMARY.format('service')}) AS resilience FROM fr0),
fr2 AS (SELECT f.*, list_concat(list_concat(list_concat(lv, c.v), list_concat(service, geometry)), list_concat(role, resilience)) AS base FROM fr1 f CROSS JOIN cty c),
fp0 AS (SELECT line, role, resilience, {_facet_sql('base', 'base')} AS b, {_facet_sql('service', 'service')} AS s, {_facet_sql('geometry', 'geometry')} AS g FROM fr2),
fp1 AS (SELECT line, role, resilience, {_unit('b')} AS b, {_unit('s')} AS s, {_unit('g')} AS g FROM fp0),
fp2 AS (SELECT line, b, s, g, list_concat(b, role) AS ro, list_concat(resilience, b) AS re FROM fp1),
fp3 AS (SELECT line, b, s, g, {_facet_sql('role', 'ro')} AS o, {_facet_sql('resilience', 're')} AS r FROM fp2),
fp4 AS (SELECT line, b, s, g, {_unit('o')} AS o, {_unit('r')} AS r FROM fp3),
fp5 AS (SELECT *, list_concat(list_concat(list_concat(b, o), list_concat(s, g)), r) AS a FROM fp4),
fp6 AS (SELECT *, {_facet_sql('general', 'a')} AS n FROM fp5),
fac AS MATERIALIZED (SELECT line, b AS base, {_unit('n')} AS general, o AS role, s AS service, g AS geometry, r AS resilience FROM fp6)
"""


def facets_sql(query: str) -> str:
    return encoder_sql("SELECT 1").replace("\nSELECT 1", FACETS_SQL + query)


def line_facets(spark, sf_dir):
    scratch = Scratch(spark, "facets")
    g = graph(spark, sf_dir, scratch)
    e = E.encode(g, WIDTH, LAYERS, scratch)
    e = {k: scratch.table(v, k) for k, v in e.items()}
    raw = scratch.table(FA.raw_facets(g, e, WIDTH), "raw")
    return scratch.table(FA.project_facets(raw, dict.fromkeys(FA.WIDTHS, FACET)), "facets")


@query("line_facets", facets_sql(" UNION ALL ".join(_long(c, f"line, '{c}' AS facet", "fac") for c in FACETS)))
def line_facet_rows(spark, sf_dir):
    f = line_facets(spark, sf_dir)
    long = f.select("line", F.explode(F.create_map(*[x for c in FACETS for x in (F.lit(c), F.col(c))])).alias("facet", "v"))
    return _rows(long, ["line", "facet"], "v")


_COSINE = "list_dot_product(x.{0}, y.{0}) / (sqrt(list_dot_product(x.{0}, x.{0})) * sqrt(list_dot_product(y.{0}, y.{0})))"


@query("similar_lines", facets_sql(f"""
SELECT q_id, id, round(similarity, 6) AS similarity, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, id) AS k FROM
(SELECT x.line AS q_id, y.line AS id, {' + '.join(f'{w!r}::DOUBLE * {_COSINE.format(n)}' for n, w in S.profile_weights('default').items())} AS similarity FROM fac x JOIN fac y ON x.line <> y.line)) WHERE k <= 3"""))
def similar_lines(spark, sf_dir):
    f = line_facets(spark, sf_dir)
    names = list(S.profile_weights("default"))
    q = f.select(F.col("line").alias("q_id"), *[F.col(c).alias(f"{c}_q") for c in names])
    c = f.select(F.col("line").alias("id"), F.col("line").alias("name"), *[F.col(c).alias(f"{c}_c") for c in names])
    out = R.top_similar(q, c, 3, R.facet_similarity(S.profile_weights("default")), F.col("q_id") == F.col("id"))
    return out.select("q_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


_HEAD = lambda k, i: 0.02 * np.sin((k + 1) * (i + 1) * 0.013)
_INPUTS = 2 * WIDTH + FA.LINE_WIDTH
_PREDICTED = f"""
SELECT p.line, metric, round(value, 6) AS value, round(percentile, 6) AS percentile, round(uniqueness, 6) AS uniqueness FROM (
SELECT *, cume_dist() OVER (PARTITION BY metric ORDER BY round(value, 12)) AS percentile FROM (SELECT line, unnest([{', '.join(f"'{m}'" for m in I.METRICS)}]) AS metric, unnest(m) AS value FROM (
SELECT line, list_transform(range(6), lambda k: greatest(list_value(1, 1, 3600, 3600, 1, 1)[k + 1] * list_sum(list_transform(range({_INPUTS}), lambda i: x[i + 1] * 0.02::DOUBLE * sin((k + 1) * (i + 1) * 0.013::DOUBLE))), 0)) AS m
FROM (SELECT v.line, list_concat(list_concat(v.v, c.v), f.f) AS x FROM {_L} v JOIN lnf f ON f.line = v.line CROSS JOIN cty c)))) p
JOIN (SELECT v.line, list_sum(list_transform(range({FA.LINE_WIDTH}), lambda o: abs(f.f[o + 1] - list_sum(list_transform(range({WIDTH}), lambda i: v.v[i + 1] * cos((i + 1) * (o + {I.LINE_DECODER_SEED + 1}) * 0.013::DOUBLE) * 0.1::DOUBLE))))) / {FA.LINE_WIDTH} AS uniqueness
FROM {_L} v JOIN lnf f ON f.line = v.line) u ON u.line = p.line"""


@query("predicted_lines", facets_sql(_PREDICTED))
def predicted_lines(spark, sf_dir):
    scratch = Scratch(spark, "predict")
    g = graph(spark, sf_dir, scratch)
    e = {k: scratch.table(v, k) for k, v in E.encode(g, WIDTH, LAYERS, scratch).items()}
    inputs = I.head_inputs(e["lines"], e["city"], g["line_features"])
    ranked = I.metric_percentiles(scratch.table(I.predict(inputs, *I.rule_head(_HEAD, _INPUTS)), "predictions"))
    odd = I.uniqueness(e["lines"], g["line_features"], FA.LINE_WIDTH)
    return ranked.join(odd, "line").select("line", "metric", *[F.round(c, 6).alias(c) for c in ("value", "percentile", "uniqueness")])


@query("stored_graph_edges", encoder_sql("""
SELECT CAST(x.row AS BIGINT) AS source, CAST(y.row AS BIGINT) AS target, CAST(l.row AS BIGINT) AS line, CAST(unnest(range(7)) AS INT) AS place, round(CAST(CAST(unnest(f) AS FLOAT) AS DOUBLE), 4) AS value FROM ef e
JOIN (SELECT station, row_number() OVER (ORDER BY station) - 1 AS row FROM st) x ON x.station = e.a JOIN (SELECT station, row_number() OVER (ORDER BY station) - 1 AS row FROM st) y ON y.station = e.b
JOIN (SELECT line, row_number() OVER (ORDER BY line) - 1 AS row FROM lnf) l ON l.line = e.line"""))
def stored_graph_edges(spark, sf_dir):
    """Edges and their features from the arrays that the graph was saved to; a graph with issues is an error."""
    scratch = Scratch(spark, "store")
    folder = scratch.path("graph")
    AR.save_graph(graph(spark, sf_dir, scratch), folder, scratch)
    if AR.graph_issues(spark, folder).limit(1).count():
        raise ValueError("the stored graph is not valid")
    ends = AR.load_relation(spark, folder, "transit")
    cells = AR.read_array(spark, f"{folder}/transit_features.f32").select(F.floor(F.col("place") / 7).alias("row"), (F.col("place") % 7).cast("int").alias("place"), F.round("value", 4).alias("value"))
    return ends.join(cells, "row").select(F.col("from_station").alias("source"), F.col("to_station").alias("target"), "line", "place", "value")
