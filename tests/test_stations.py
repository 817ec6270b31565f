"""Pairs of stops by name, through classes of one name and place, against all pairs."""

import math
import random

from linehaul.operators import stations as ST

SCHEMA = "stop_id long, name string, lat double, lon double, location_type int"


def _stops():
    draw = random.Random(3)
    names = ["Haupt strasse nord", "Hauptstrasse-Nord", "hauptstrassenord", "hauptstrassenort", "Marktplatz am Dom", "Marktplatz am Tom", "", None, "!"]
    rows = [(i, draw.choice(names), 48.0 + draw.randrange(3) / 2000, 16.0 + draw.randrange(3) / 1500, i % 2) for i in range(60)]
    # one id at two places, and one that has no place
    return [*rows, (7, "Marktplatz am Dom", 48.0, 16.0, 1), (7, "Marktplatz am Tom", 48.0, 16.0, 1), (90, "Marktplatz am Dom", 0.0, 0.0, 1)]


def _key(name):
    return None if name is None else "".join(c for c in name.lower() if c.isalnum())


def _metres(a, b):
    (y1, x1), (y2, x2) = ((math.radians(s[2]), math.radians(s[3])) for s in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(math.sqrt(h), 1.0))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        ahead, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            ahead, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, ahead + (x != y))
    return row[-1]


def _all_pairs(stops):
    some = [s for s in stops if _key(s[1]) and (s[2], s[3]) != (0.0, 0.0)]
    exact, fuzzy = [], []
    for a in some:
        for b in some:
            x, y = _key(a[1]), _key(b[1])
            if a[0] > b[0] and x == y and _metres(a, b) <= ST.NEAR_M:
                exact.append((a[0], b[0], 0.98))
            if a[0] > b[0] and x != y and _metres(a, b) <= ST.FUZZY_M and (like := 1 - _distance(x, y) / max(len(x), len(y))) >= ST.ALIKE:
                fuzzy.append((a[0], b[0], round(0.9 * like, 9)))
    return sorted(exact), sorted(fuzzy)


def test_name_pairs_are_all_pairs(spark):
    stops = spark.createDataFrame(_stops(), SCHEMA)
    exact, fuzzy = _all_pairs(_stops())
    got = lambda df: sorted((r["a"], r["b"], round(r["confidence"], 9)) for r in df.collect())
    assert exact and fuzzy
    assert got(ST.exact_name_pairs(stops)) == exact and got(ST.fuzzy_name_pairs(stops)) == fuzzy


def test_name_links_hold_the_components_and_confidences_of_all_pairs(spark):
    def merged(links):
        root, least = {s[0]: s[0] for s in _stops()}, {}
        for _ in root:
            for a, b, _c in links:
                root[a] = root[b] = min(root[a], root[b])
        for a, _b, c in links:
            least[root[a]] = min(c, least.get(root[a], 1.0))
        return root, least

    links = [(r["a"], r["b"], round(r["confidence"], 9)) for r in ST.name_links(spark.createDataFrame(_stops(), SCHEMA)).collect()]
    exact, fuzzy = _all_pairs(_stops())
    assert merged(links) == merged(exact + fuzzy) and len(links) < len(exact)


def test_name_links_grow_with_the_stops(spark):
    copies = lambda n: spark.range(n).selectExpr("id stop_id", "'Hauptplatz' name", "48.0 + id % 4 / 2000 lat", "16.0D lon", "0 location_type")
    assert ST.name_links(copies(4000)).count() < 5000


def test_no_side_of_the_name_join_is_broadcast(spark):
    copies = spark.range(100).selectExpr("id stop_id", "'Hauptplatz' name", "48.0D lat", "16.0D lon", "0 location_type")
    for df in (ST.exact_name_pairs(copies), ST.fuzzy_name_pairs(copies)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
