"""SQL of the clustering by transfers: one step of the chain for each round."""

from __future__ import annotations

from haulcost.operators import kmeans
from haulcost.operators.energy import FUEL_PAIR, SCALED, TYPE

_WIDTH = range(len(SCALED))
_X = ", ".join(f"x{d}" for d in _WIDTH)
_SQUARE = " + ".join(f"(x{d} - c{d}) * (x{d} - c{d})" for d in _WIDTH)


def _nearest(members: str, states: str, cost: str) -> str:
    """Each point's cluster of least cost; at a tie its own, then the first."""
    return f"""select k, id, (min({{'cost': {cost}, 'other': b <> own, 'b': b}})).b as own from (
    select m.k, m.id, m.own, s.b, s.n, {_SQUARE} as square
    from {members} m join points p on p.id = m.id join {states} s on s.k = m.k) group by k, id"""


def clusters(stats: str, numbers: list[int], seed: int = 123, rounds: int = kmeans.ROUNDS) -> str:
    """A chain of WITH items after ``stats``: ``points``, and ``fitted`` with k, id, own and within."""
    scaled = ", ".join(
        f"coalesce(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 0) as z{d}"
        for d, c in enumerate(SCALED)
    )
    whole = ", ".join(f"cast(round(z{d} * {kmeans.UNIT}) as bigint) as x{d}" for d in _WIDTH)
    pair = ", ".join(f"'{name}'" for name in FUEL_PAIR)
    sums = ", ".join(f"sum(x{d})::double / count(*) as c{d}" for d in _WIDTH)
    explained = " + ".join(f"sum(x{d})::double * sum(x{d})::double" for d in _WIDTH)
    squares = " + ".join(f"x{d}::hugeint * x{d}" for d in _WIDTH)
    steps = [
        f"zs as materialized (select *, {scaled} from stats)",
        f"points as materialized (select *, row_number() over () as id, {whole} from zs "
        f"where {TYPE} in ({pair}))",
        f"total as materialized (select sum({squares})::double as t from points)",
        f"""starts as materialized (select *, row_number() over (order by
  md5(concat_ws('|', {seed}, {_X})), {_X}) - 1 as b from (select distinct {_X} from points))""",
        "s0 as materialized (select k, b, 1.0::double as n, "
        + ", ".join(f"x{d}::double as c{d}" for d in _WIDTH)
        + f" from starts, (select unnest({numbers}) as k) where b < k)",
        f"none as materialized (select k, id, -1 as own from points, (select unnest({numbers}) as k))",
        f"m0 as materialized ({_nearest('none', 's0', 'square')})",
    ]
    leaving = (
        "case when b = own then case when n > 1 then square * n / (n - 1) else 0 end "
        "else square * n / (n + 1) end"
    )
    for t in range(rounds + 1):
        if t:
            steps.append(f"m{t} as materialized ({_nearest(f'm{t - 1}', f't{t - 1}', leaving)})")
        steps.append(
            f"""t{t} as materialized (select k, own as b, count(*)::double as n, {sums},
  ({explained}) / count(*) as explained from m{t} join points using (id) group by k, own)"""
        )
        steps.append(
            f"""w{t} as materialized (select k, {t} as round,
  (select t from total) - list_sum(list(explained order by b)) as within from t{t} group by k)"""
        )
    every = " union all ".join(f"select * from w{t}" for t in range(rounds + 1))
    members = " union all ".join(f"select *, {t} as round from m{t}" for t in range(rounds + 1))
    steps += [
        f"""course as materialized (select *, lag(within) over (partition by k order by round) <= within
  as worse from ({every}))""",
        f"""ends as materialized (select k, coalesce(min(case when worse then round end) - 1, {rounds})
  as round from course group by k)""",
        f"""fitted as materialized (select m.k, m.id, m.own, c.within / {kmeans.UNIT**2}::double as within
  from ({members}) m join ends using (k, round) join course c using (k, round))""",
    ]
    return ",\n".join([stats, *steps])


#: Squarings of a covariance until only its first component is left of it.
SQUARINGS = 30


def _component(name: str, source: str) -> list[str]:
    """The first eigenvector of ``source`` (i, j, v), whose largest part is positive."""
    steps = [
        f"{name}0 as materialized (select i, j, v / (select sum(v) from {source} where i = j) as v from {source})"
    ]
    for t in range(SQUARINGS):
        steps += [
            f"""{name}s{t} as materialized (select a.i, b.j, sum(a.v * b.v) as v
  from {name}{t} a join {name}{t} b on a.j = b.i group by a.i, b.j)""",
            f"""{name}{t + 1} as materialized (select i, j, v / (select sum(v) from {name}s{t} where i = j) as v
  from {name}s{t})""",
        ]
    last = f"{name}{SQUARINGS}"
    steps.append(
        f"""{name} as materialized (select p.i as d, p.v / sqrt(best.v) as w from {last} p
  join (select j, v from {last} where i = j order by v desc limit 1) best on p.j = best.j)"""
    )
    return steps


def places() -> str:
    """WITH items after those of ``clusters``: ``places`` with id, pc1 and pc2."""
    numbers = ", ".join(str(d) for d in _WIDTH)
    return ",\n".join(
        [
            f"parts as materialized (select id, unnest([{_X}]) as x, unnest([{numbers}]) as d from points)",
            "totals as materialized (select d, count(*) as n, sum(x)::hugeint as s from parts group by d)",
            """products as materialized (select a.d as i, b.d as j, sum(a.x::hugeint * b.x) as p
  from parts a join parts b using (id) group by a.d, b.d)""",
            """cov as materialized (select i, j,
    (a.n * p::hugeint - a.s * b.s)::double / (a.n * (a.n - 1))::double as v
  from products join totals a on a.d = i join totals b on b.d = j)""",
            *_component("one", "cov"),
            """rest as materialized (select i, j, v - (select sum(a.w * c.v * b.w) from cov c join one a on a.d = c.i
    join one b on b.d = c.j) * x.w * y.w as v from cov join one x on x.d = i join one y on y.d = j)""",
            *_component("two", "rest"),
            f"""places as materialized (select id, sum((x - s / n) * one.w) / {kmeans.UNIT} as pc1,
    sum((x - s / n) * two.w) / {kmeans.UNIT} as pc2
  from parts join totals using (d) join one using (d) join two using (d) group by id)""",
        ]
    )
