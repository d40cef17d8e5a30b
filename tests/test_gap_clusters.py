"""Groups of orphan trail cells against a plain search over the tables' rows."""

import math

from placekit.plans import catalogue
from placekit.plans.adapter import view

SF = "/root/testdata/sf0.01"


def test_clusters_of_orphan_cells(spark):
    size = 0.0015
    places = view(spark, SF, "P").select("lat", "lng", "acres").collect()
    towns = view(spark, SF, "M").collect()

    def orphan(c):
        lat, lng = (c[0] + 0.5) * size, (c[1] + 0.5) * size
        if not any(m.x0 < lng < m.x1 and m.y0 < lat < m.y1 for m in towns):
            return False
        for p in places:
            if abs(p.lat - lat) * 111000 <= 2600:
                r = min(2200.0, max(90.0, math.sqrt(p.acres * 4047 / math.pi))) if p.acres else 120.0
                if math.hypot((p.lat - lat) * 111000, (p.lng - lng) * 111000 * math.cos(math.radians(lat))) <= r + 300:
                    return False
        return True

    cells = {(math.floor(r.lat / size), math.floor(r.lng / size)) for r in view(spark, SF, "O").select("lat", "lng").collect()}
    left = {c for c in cells if orphan(c)}
    seen, want = set(), []
    for c in left:
        todo, members = [c], []
        while todo:
            x = todo.pop()
            if x in seen or x not in left:
                continue
            seen.add(x)
            members.append(x)
            todo += [(x[0] + i, x[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        if len(members) >= 4:
            want.append((len(members), *(math.floor(sum(m[k] for m in members) / len(members)) for k in (0, 1))))
    assert 0 < len(left) < len(cells)
    got = [(r["size"], r.ci_mean, r.cj_mean) for r in catalogue.queries()["gap_clusters_in_towns"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and want
