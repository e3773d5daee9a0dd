"""SQL that says what the hulls, filters, fronts and mixtures must give, written out for DuckDB from their parameters.

Each function returns common tables; `cells` names a table (z, y, x, v) of every cell of a volume, `mask` one of (z, y, x).
"""

from __future__ import annotations

import math

SIDES = {"z": "y, x", "y": "z, x", "x": "z, y"}


def dense(shape: tuple[int, int, int], table: str, name: str = "cells") -> str:
    """Every cell of a volume with its value in a table, else 0."""
    nz, ny, nx = shape
    return f"{name} as (select cast(a.z as int) as z, cast(b.y as int) as y, cast(c.x as int) as x, cast(coalesce(t.v, 0) as double) as v from range(0, {nz}) a(z) cross join range(0, {ny}) b(y) cross join range(0, {nx}) c(x) left join {table} t on t.z = a.z and t.y = b.y and t.x = c.x)"


def hull(mask: str, ny: int, nx: int, name: str = "hull") -> str:
    """Cells on the inner side of every line through two of a slice's points that has all of its points on one side."""
    return f"""{name}_corner as (select z, py, min(px) as lo, max(px) as hi from (select z, y - 0.5 as py, x as px from {mask} union all select z, y + 0.5, x from {mask} union all select z, y, x - 0.5 from {mask} union all select z, y, x + 0.5 from {mask}) q group by 1, 2),
    {name}_point as (select z, py, lo as px from {name}_corner union select z, py, hi from {name}_corner),
    {name}_side as (select a.z, a.py as ay, a.px as ax, b.py - a.py as dy, b.px - a.px as dx from {name}_point a join {name}_point b on a.z = b.z and (a.py <> b.py or a.px <> b.px)),
    {name}_edge as (select s.z, ay, ax, dy, dx from {name}_side s join {name}_point p on p.z = s.z group by all having min(dy * (px - ax) - dx * (py - ay)) >= -1e-9),
    {name} as (select cast(s.z as int) as z, cast(b.y as int) as y, cast(c.x as int) as x from (select distinct z from {mask}) s, range(0, {ny}) b(y), range(0, {nx}) c(x)
        where not exists (select 1 from {name}_edge e where e.z = s.z and e.dy * (c.x - e.ax) - e.dx * (b.y - e.ay) < -1e-9))"""


def _taps(sigma: float) -> tuple[int, str]:
    """Rows (o, k0, k1, k2): a normal density, its slope with first moment -1 and its curvature with second moment 2 and sum 0."""
    r = max(1, math.ceil(4 * sigma))
    x = range(-r, r + 1)
    g = [math.exp(-0.5 * (i / sigma) ** 2) for i in x]
    g = [a / sum(g) for a in g]
    one = [-i / sigma**2 * a for i, a in zip(x, g, strict=True)]
    one = [a / -sum(b * i for b, i in zip(one, x, strict=True)) for a in one]
    two = [(i * i / sigma**4 - 1 / sigma**2) * a for i, a in zip(x, g, strict=True)]
    two = [a - sum(two) / len(two) for a in two]
    two = [2 * a / sum(b * i * i for b, i in zip(two, x, strict=True)) for a in two]
    return r, ", ".join(f"({i}, {a!r}::double, {b!r}::double, {c!r}::double)" for i, a, b, c in zip(x, g, one, two, strict=True))


def eigenvalues(cells: str, shape: str, sigma: float, name: str, sides: tuple[int, int, int] | None = None) -> str:
    """(z, y, x, e0, e1, e2): curvatures of the smoothed volume, ascending. Beyond a border the values are mirrored, or the border's
    value goes on where a side is shorter than the kernel. shape: a table of the sides n0, n1, n2; sides: least ones, to choose by."""
    r, taps = _taps(sigma)

    def at(axis: str, n: str, side: int | None) -> str:
        far = f"s.{axis} - o"
        if side is not None and side < r:
            return f"greatest(0, least({n} - 1, {far}))"
        return f"case when {far} < 0 then o - s.{axis} - 1 when {far} >= {n} then 2 * {n} - 1 - ({far}) else {far} end"

    sides = sides or (None, None, None)
    step = lambda out, source, axis, n, side, sums: f"{out} as (select s.z, s.y, s.x, {sums} from (select z, y, x, o, k0, k1, k2, {n}, {at(axis, n, side)} as p from {cells} s, {name}_tap, {shape}) s join {source} a on {' and '.join(f'a.{c} = s.{c}' for c in 'zyx' if c != axis)} and a.{axis} = s.p group by 1, 2, 3)"
    total = lambda pairs: ", ".join(f"sum(k{k} * a.{c}) as {out}" for k, c, out in pairs)
    return ",\n    ".join([
        f"{name}_tap(o, k0, k1, k2) as (values {taps})",
        step(f"{name}_z", cells, "z", "n0", sides[0], total([(0, "v", "g0"), (1, "v", "g1"), (2, "v", "g2")])),
        step(f"{name}_y", f"{name}_z", "y", "n1", sides[1], total([(0, "g0", "g00"), (1, "g0", "g01"), (2, "g0", "g02"), (0, "g1", "g10"), (1, "g1", "g11"), (0, "g2", "g20")])),
        step(f"{name}_h", f"{name}_y", "x", "n2", sides[2], total([(0, "g20", "a"), (0, "g02", "b"), (2, "g00", "c"), (0, "g11", "d"), (1, "g10", "e"), (1, "g01", "f")])),
        f"{name}_q as (select *, (a + b + c) / 3 as q, sqrt((pow(a - (a + b + c) / 3, 2) + pow(b - (a + b + c) / 3, 2) + pow(c - (a + b + c) / 3, 2) + 2 * (d * d + e * e + f * f)) / 6) as p from {name}_h)",
        f"{name}_r as (select *, case when p < 1e-300 then 0 else greatest(-1.0, least(1.0, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p))) end as r from {name}_q)",
        f"{name} as (select z, y, x, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) as e0, 3 * q - (q + 2 * p * cos(acos(r) / 3)) - (q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3)) as e1, q + 2 * p * cos(acos(r) / 3) as e2 from {name}_r)",
    ])


def diffused(cells: str, steps: int, time: float = 0.0625, conductance: float = 3.0) -> str:
    """Tables d0_.. to d<steps>: a step of curvature diffusion each."""
    ways = ", ".join(f"w{a} as (partition by {SIDES[a]} order by {a})" for a in "zyx")
    out = [f"d0 as (select * from {cells})"]
    for i in range(steps):
        slopes = ", ".join(f"coalesce(lead(v) over w{a}, v) - v as f{a}, v - coalesce(lag(v) over w{a}, v) as h{a}" for a in "zyx")
        out.append(f"d{i}_s as (select *, {', '.join(f'(f{a} + h{a}) / 2 as c{a}' for a in 'zyx')} from (select *, {slopes} from d{i} window {ways}) q)")
        out.append(f"d{i}_k as (select avg(cz * cz + cy * cy + cx * cx) * {conductance**2 * 2} as k from d{i}_s)")
        norm = lambda a, first, move: f"1e-10 + {first}{a} * {first}{a} + " + " + ".join(f"pow((c{j} + coalesce({move}(c{j}) over w{a}, c{j})) / 2, 2)" for j in "zyx" if j != a)  # noqa: B023, E731
        norms = ", ".join(f"{norm(a, 'f', 'lead')} as nf{a}, {norm(a, 'h', 'lag')} as nb{a}" for a in "zyx")
        speed = " + ".join(f"f{a} / sqrt(nf{a}) * exp(-nf{a} / k) - h{a} / sqrt(nb{a}) * exp(-nb{a} / k)" for a in "zyx")
        up = " + ".join(f"pow(least(h{a}, 0), 2) + pow(greatest(f{a}, 0), 2)" for a in "zyx")
        down = " + ".join(f"pow(greatest(h{a}, 0), 2) + pow(least(f{a}, 0), 2)" for a in "zyx")
        out.append(f"d{i}_n as (select *, {norms} from d{i}_s window {ways})")
        out.append(f"d{i + 1} as (select z, y, x, case when k = 0 then v else v + {time} * (case when {speed} > 0 then ({speed}) * sqrt({up}) else ({speed}) * sqrt({down}) end) end as v from d{i}_n, d{i}_k)")
    return ",\n    ".join(out)


def front(speed: str, seeds: str, ny: int, nx: int, stop: float, rounds: int) -> str:
    """Table march (z, y, x, v): arrival times by `rounds` updates of all cells from their neighbours. Needs `recursive`."""
    number = f"(z * {ny + 2} + y) * {nx + 2} + x"
    scale = {0: (ny + 2) * (nx + 2), 1: nx + 2, 2: 1}
    near = " union all ".join(f"select {number} as id, {axis} as axis, {number} + {way * scale[axis]} as other from {speed} where v > 0" for axis in scale for way in (1, -1))
    inf = "cast('infinity' as double)"
    least = ", ".join(f"coalesce(min(case when axis = {a} then t end), {inf})" for a in scale)

    def root(m: int) -> str:
        sums, squares = " + ".join(f"a[{i + 1}]" for i in range(m)), " + ".join(f"a[{i + 1}] * a[{i + 1}]" for i in range(m))
        disc = f"pow({sums}, 2) - {m} * ({squares} - slow * slow)"
        return f"case when a[{m}] < {inf} and {disc} >= 0 and u{m - 1} > a[{m}] then least(u{m - 1}, ({sums} + sqrt({disc})) / {m}) else u{m - 1} end as u{m}"

    return f"""march_cell as (select {number} as id, s.z, s.y, s.x, 1.0 / s.v as slow, g.z is not null as seed from {speed} s left join {seeds} g using (z, y, x) where s.v > 0),
    march_near as ({near} union all select id, 3, id from march_cell),
    march_t(r, id, t) as (select 0, id, case when seed then 0.0 else {inf} end from march_cell union all
        select r + 1, id, case when seed then 0.0 when least(own, u3) > {stop} then {inf} else least(own, u3) end from (select *, {root(3)} from (select *, {root(2)} from (select *, a[1] + slow as u1 from (
            select any_value(r) as r, n.id, any_value(slow) as slow, any_value(seed) as seed, list_sort([{least}]) as a, min(case when axis = 3 then t end) as own
            from march_t m join march_near n on n.other = m.id join march_cell c on c.id = n.id where r < {rounds} group by n.id) q1) q2) q3) q4),
    march as (select z, y, x, t as v from march_t join march_cell using (id) where r = {rounds} and t < {inf})"""


def mixed(image: str, k: int = 3, highest: float = 500, rounds: int = 100, tol: float = 1e-3) -> str:
    """Table mix (i, mean, weight, std) of k normal components, by expectation and maximisation from equal parts. Needs `recursive`."""
    ks = range(1, k + 1)
    log = {j: f"ln(w{j}) - 0.5 * ln(2 * pi() * s{j}) - pow(v - m{j}, 2) / (2 * s{j})" for j in ks}
    moments = lambda r: ", ".join(f"sum(n * {r(j)}) as q{j}, sum(n * {r(j)} * v) as f{j}, sum(n * {r(j)} * v * v) as g{j}" for j in ks)
    size, mean = (lambda j: f"(q{j} + 1e-12)"), (lambda j: f"(f{j} / (q{j} + 1e-12))")
    fitted = ", ".join(f"{mean(j)} as m{j}, (g{j} - 2 * {mean(j)} * f{j} + {mean(j)} * {mean(j)} * q{j}) / {size(j)} + 1e-6 as s{j}, {size(j)} / ({' + '.join(size(i) for i in ks)}) as w{j}" for j in ks)
    names = ", ".join(f"m{j}, s{j}, w{j}" for j in ks)
    greatest = f"greatest({', '.join(f'l{j}' for j in ks)})"
    return f"""mix_h as (select cast(v as double) as v, cast(count(*) as double) as n from {image} where v > (select min(v) from {image}) and v <= {highest} group by v),
    mix_p as (select v, n, least(cast(floor((sum(n) over (order by v) - n / 2) / sum(n) over () * {k}) as int), {k - 1}) + 1 as part from mix_h),
    mix_t(t, {names}, now, before) as (
        select 0, {names}, cast(null as double), cast(null as double) from (select {fitted} from (select {moments(lambda j: f'case when part = {j} then 1 else 0 end')} from mix_p) q) q
        union all
        select t + 1, {names}, now, before from (select t, now, before, {fitted} from (
            select any_value(t) as t, any_value(now) as before, sum(n * lt) / sum(n) as now, {moments(lambda j: f'exp(l{j} - lt)')} from (
                select *, {greatest} + ln({' + '.join(f'exp(l{j} - {greatest})' for j in ks)}) as lt from (
                    select t, now, v, n, {', '.join(f'{log[j]} as l{j}' for j in ks)} from mix_t, mix_h where t < {rounds} and not coalesce(abs(now - before) < {tol}, false)) q1) q2 having count(*) > 0) q3) q4),
    mix_c as (select * from mix_t where t = (select max(t) - 1 from mix_t)),
    mix as (select cast(row_number() over (order by mean) - 1 as int) as i, mean, weight, std from ({' union all '.join(f'select m{j} as mean, w{j} as weight, sqrt(s{j}) as std from mix_c' for j in ks)}) q)"""


def crossings(image: str, highest: float = 500, k: int = 3) -> str:
    """Table cut (i, threshold) from table mix: the volume's ends, and where neighbouring components cross."""
    return f"""cut_p as (select *, lead(mean) over (order by i) as mean2, lead(std) over (order by i) as std2 from mix),
    cut_q as (select i, mean as m1, mean2 as m2, std as s1, std2 as s2, 1 / (2 * std * std) - 1 / (2 * std2 * std2) as a, mean2 / (std2 * std2) - mean / (std * std) as b, mean * mean / (2 * std * std) - mean2 * mean2 / (2 * std2 * std2) - ln(std2 / std) as c from cut_p where mean2 is not null),
    cut_r as (select i, case when abs(a) < 1e-12 then -c / b else (-b - sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) end as p, case when abs(a) < 1e-12 then -c / b else (-b + sqrt(greatest(b * b - 4 * a * c, 0))) / (2 * a) end as q from cut_q),
    cut as (select cast(i + 1 as int) as i, case when greatest(p, q) < (select max(v) from {image} where v <= {highest}) then greatest(p, q) else least(p, q) end as threshold from cut_r
        union all select 0, cast(min(v) - 1 as double) from {image} union all select {k}, cast(max(v) + 1 as double) from {image})"""


def splined(cells: str, shape: tuple[int, int, int], spacing: float) -> str:
    """Table spline (z, y, x, v): a cubic spline through the cells, mirrored about its border cells, on a grid of another spacing."""
    pole = math.sqrt(3) - 2
    taps = ", ".join(f"({o}, {-6 * pole / (1 - pole**2) * pole ** abs(o)!r}::double)" for o in range(-24, 25))
    turned = lambda place, n: f"least(abs({place}) % {2 * (n - 1)}, {2 * (n - 1)} - abs({place}) % {2 * (n - 1)})"
    out, last = [f"spline_tap(o, w) as (values {taps})"], cells
    for axis, n in zip("zyx", shape, strict=True):
        others = " and ".join(f"a.{c} = s.{c}" for c in "zyx" if c != axis)
        out.append(f"spline_c{axis} as (select s.z, s.y, s.x, sum(w * a.v) as v from {last} s cross join spline_tap join {last} a on {others} and a.{axis} = {turned(f'(s.{axis} + o)', n)} group by 1, 2, 3)")
        last = f"spline_c{axis}"
    basis = ("pow(1 - f, 3) / 6", "2 / 3.0::double - f * f + pow(f, 3) / 2", "2 / 3.0::double - pow(1 - f, 2) + pow(1 - f, 3) / 2", "pow(f, 3) / 6")
    for axis, n in zip("zyx", shape, strict=True):
        others = ", ".join(f"a.{c}" for c in "zyx" if c != axis)
        spots = " union all ".join(f"select p, {turned(f'(b + {k - 1})', n)} as at, {w} as w, p * {spacing} > {n - 0.5} as off from spline_p{axis}" for k, w in enumerate(basis))
        out.append(f"spline_p{axis} as (select cast(p as int) as p, cast(floor(p * {spacing}) as int) as b, cast(p * {spacing} - floor(p * {spacing}) as double) as f from range(0, cast(round_even({n} / {spacing}, 0) as int)) r(p))")
        out.append(f"spline_{axis} as (select p as {axis}, {others}, case when any_value(off) then 0 else sum(w * a.v) end as v from ({spots}) s join {last} a on a.{axis} = s.at group by 1, 2, 3)")
        last = f"spline_{axis}"
    return ",\n    ".join([*out, f"spline as (select z, y, x, v from {last})"])


def swept(cells: str, centre: tuple[int, int, int]) -> str:
    """Table sweep (z, y, x) of cells (id, z, y, x): blobs of the slices through the centre, and along each axis those that overlap one of
    the slice before which is at least as large. Needs `recursive`."""
    views = " union all ".join(f"select '{a}' as axis, {a} as s, {SIDES[a].split(', ')[0]} as u, {SIDES[a].split(', ')[1]} as w, id, z, y, x from {cells}" for a in "zyx")
    middle = " or ".join(f"(axis = '{a}' and s = {c})" for a, c in zip("zyx", centre, strict=True))
    return f"""sweep_v as ({views}),
    sweep_l as (select a.axis, a.id as a, b.id as b from sweep_v a join sweep_v b on a.axis = b.axis and a.s = b.s and abs(a.u - b.u) <= 1 and abs(a.w - b.w) <= 1 and a.id <> b.id),
    sweep_w(axis, id, l) as (select axis, id, id from sweep_v union select l.axis, l.b, w.l from sweep_w w join sweep_l l on l.axis = w.axis and l.a = w.id where w.l < l.b),
    sweep_b as (select v.*, m.l as blob from sweep_v v join (select axis, id, min(l) as l from sweep_w group by 1, 2) m using (axis, id)),
    sweep_n as (select axis, s, blob, count(*) as n from sweep_b group by 1, 2, 3),
    sweep_o as (select distinct a.axis, a.s, a.blob, b.s as s2, b.blob as blob2 from sweep_b a join sweep_b b on a.axis = b.axis and abs(a.s - b.s) = 1 and a.u = b.u and a.w = b.w
        join sweep_n m on m.axis = a.axis and m.s = a.s and m.blob = a.blob join sweep_n n on n.axis = b.axis and n.s = b.s and n.blob = b.blob where m.n >= n.n),
    sweep_r(axis, s, blob, way) as (select axis, s, blob, way from sweep_n, (values (1), (-1)) d(way) where {middle}
        union select o.axis, o.s2, o.blob2, way from sweep_r r join sweep_o o on o.axis = r.axis and o.s = r.s and o.blob = r.blob and o.s2 = r.s + way),
    sweep as (select distinct z, y, x from sweep_b b join sweep_r r on r.axis = b.axis and r.s = b.s and r.blob = b.blob)"""
