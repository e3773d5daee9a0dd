"""Points, segments, ellipses and frustums: column expressions for predicates, numpy for fits of one branch."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

EPS = 1e-10
Vector = tuple[float, float, float]


# ---- column expressions ---------------------------------------------------------------------------------------------


def _xyz(point: Vector | list[Column]) -> list[Column]:
    return [p if isinstance(p, Column) else F.lit(float(p)) for p in point]


def dot(a, b) -> Column:
    (a0, a1, a2), (b0, b1, b2) = _xyz(a), _xyz(b)
    return a0 * b0 + a1 * b1 + a2 * b2


def difference(a, b) -> list[Column]:
    return [p - q for p, q in zip(_xyz(a), _xyz(b), strict=True)]


def triangle_area(a, b, c) -> Column:
    """Half the length of the cross product of two sides."""
    u, v = difference(b, a), difference(c, a)
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return 0.5 * F.sqrt(dot(cross, cross))


def between_endpoints(point, c1: Vector, c2: Vector, eps: float = EPS) -> Column:
    """Whether a point's projection on the axis from c1 to c2 lies between them, both included."""
    height = math.dist(c1, c2)
    along = dot(difference(point, c1), [(b - a) / (height + eps) for a, b in zip(c1, c2, strict=True)])
    return along.between(0.0, height)


def in_ellipse(point, centre: Vector, major: Vector, minor: Vector, eps: float = EPS) -> Column:
    """Whether a point is within an ellipse of its plane given by half axes; never for an axis shorter than eps."""
    a, b = math.hypot(*major), math.hypot(*minor)
    if a < eps or b < eps:
        return F.lit(False)
    u = difference(point, centre)
    return F.pow(dot(u, [c / a for c in major]) / a, F.lit(2.0)) + F.pow(dot(u, [c / b for c in minor]) / b, F.lit(2.0)) <= 1


def aligned(first: tuple, second: tuple) -> tuple:
    """The second pair of half axes, paired with the first pair and turned its way.

    An ellipse's half axes are known up to their order and signs; between axes that stand across each other the section would
    shrink to a line. So each axis goes with the one that it is nearest to, ahead or behind, and points the same way.
    """
    unit = lambda v: np.asarray(v, float) / max(float(np.linalg.norm(v)), EPS)
    cosine = lambda a, b: abs(float(unit(a) @ unit(b)))
    (p, q), (r, s) = first, second
    if cosine(p, s) + cosine(q, r) > cosine(p, r) + cosine(q, s):
        r, s = s, r
    turned = lambda a, b: np.asarray(b, float) * (1.0 if float(np.dot(a, b)) >= 0 else -1.0)
    return turned(p, r), turned(q, s)


def in_frustum(point, c1: Vector, c2: Vector, major1: Vector, minor1: Vector, major2: Vector, minor2: Vector, eps: float = EPS) -> Column:
    """Whether a point is between two ellipses: half axes change evenly along the axis. Without height it is the first ellipse.

    The second ellipse's axes are first brought in line with the first's (`aligned`). The half axis at a height is a first * (1 - t) +
    second * t, its squared length a polynomial of the height, so that a point costs a few products of generated code.
    """
    height = math.dist(c1, c2)
    if height < eps:
        return in_ellipse(point, c1, major1, minor1, eps)
    major2, minor2 = aligned((major1, minor1), (major2, minor2))
    unit = [(b - a) / height for a, b in zip(c1, c2, strict=True)]
    u = difference(point, c1)
    along = dot(u, unit)
    t = along / height
    plain = lambda a, b: math.fsum(p * q for p, q in zip(a, b, strict=True))
    solid, inside = [], []
    for first, second in ((major1, major2), (minor1, minor2)):
        step = [b - a for a, b in zip(first, second, strict=True)]
        beside = dot(u, first) + t * dot(u, step) - along * (plain(unit, first) + t * plain(unit, step))
        length2 = plain(first, first) + t * (2 * plain(first, step) + t * plain(step, step))
        solid.append(length2 > eps * eps)
        inside.append(beside / length2)
    return along.between(0.0, height) & solid[0] & solid[1] & (inside[0] * inside[0] + inside[1] * inside[1] <= 1)


def gauss_crossings(m1: Column, m2: Column, s1: Column, s2: Column) -> tuple[Column, Column]:
    """The smaller and the greater value where two normal densities cross; equal ones where the spreads are."""
    a = 1 / (2 * s1 * s1) - 1 / (2 * s2 * s2)
    b = m2 / (s2 * s2) - m1 / (s1 * s1)
    c = m1 * m1 / (2 * s1 * s1) - m2 * m2 / (2 * s2 * s2) - F.log(s2 / s1)
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    flat = F.abs(a) < 1e-12
    p, q = F.when(flat, -c / b).otherwise((-b - root) / (2 * a)), F.when(flat, -c / b).otherwise((-b + root) / (2 * a))
    return F.least(p, q), F.greatest(p, q)


# ---- numpy: one branch ----------------------------------------------------------------------------------------------


def collinear(points: np.ndarray, tol: float = 1e-8) -> bool:
    """Whether all points of the plane lie on the line of the first two; fewer than three always do."""
    if len(points) < 3:
        return True
    side, rest = points[1] - points[0], points[2:] - points[0]
    return bool((np.abs(side[0] * rest[:, 1] - side[1] * rest[:, 0]) <= tol).all())


def symmetric(points: np.ndarray, tol: float = 1e-10) -> bool:
    """Whether points of a line mirror one another about its middle."""
    line = points[1] - points[0]
    place = np.sort((points - points[0]) @ (line / np.linalg.norm(line)))
    return bool(np.ptp(place + place[::-1]) <= 2 * tol)


def hull_2d(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points of the plane, in order."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(run: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for q in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def in_hull_2d(points: np.ndarray, corners: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Whether points lie in a convex polygon, its border included."""
    side = np.roll(corners, -1, axis=0) - corners
    rest = points[:, None] - corners
    return (side[:, 0] * rest[:, :, 1] - side[:, 1] * rest[:, :, 0] >= -tol).all(axis=1)


def _ellipse(points: np.ndarray) -> tuple[float, float, float, float, float] | None:
    """Centre, half axes and angle of the least-squares ellipse through points of the plane; None if there is none."""
    if len(points) < 5:
        return None
    mean = points.mean(axis=0)
    scale = max(float(np.abs(points - mean).max()), 1e-12)
    x, y = ((points - mean) / scale).T
    quadratic, linear = np.stack([x * x, x * y, y * y], 1), np.stack([x, y, np.ones_like(x)], 1)
    try:
        tail = -np.linalg.solve(linear.T @ linear, linear.T @ quadratic)
        reduced = quadratic.T @ quadratic + quadratic.T @ linear @ tail
        values, vectors = np.linalg.eig(np.array([reduced[2] / 2, -reduced[1], reduced[0] / 2]))
    except np.linalg.LinAlgError:
        return None
    vectors = np.real(vectors)
    good = np.flatnonzero(4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 0)
    if not len(good):
        return None
    a, b, c = vectors[:, good[0]]
    d, e, f = tail @ vectors[:, good[0]]
    matrix = np.array([[a, b / 2], [b / 2, c]])
    centre = np.linalg.solve(2 * matrix, [-d, -e])
    level = centre @ matrix @ centre - f
    spread, turn = np.linalg.eigh(matrix)
    if (level / spread <= 0).any():
        return None
    axes = np.sqrt(level / spread) * scale
    return float(centre[0] * scale + mean[0]), float(centre[1] * scale + mean[1]), float(axes[0]), float(axes[1]), float(np.arctan2(turn[1, 0], turn[0, 0]))


def _circle(points: np.ndarray) -> tuple[float, float, float] | None:
    """Centre and radius of the algebraic least-squares circle."""
    if len(points) < 3:
        return None
    found, _, rank, _ = np.linalg.lstsq(np.column_stack([2 * points, np.ones(len(points))]), (points**2).sum(axis=1), rcond=None)
    radius2 = found[2] + found[0] ** 2 + found[1] ** 2
    return (float(found[0]), float(found[1]), math.sqrt(radius2)) if rank == 3 and radius2 > 0 else None


def fit_ellipse(points: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and half axes, in space, of the ellipse around points of a cross section; the first coordinate is the height.

    Without points it is a dot at `centre`, with one a dot at it. Two points, and points of a line, give a circle over their extent,
    or on a line without symmetry a flat ellipse. Else an ellipse is fitted to the hull, or a circle if none fits.
    """
    height = float(centre[0])

    def made(p: float, q: float, a: float, b: float, angle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array([height, p, q]), np.array([0, a * math.cos(angle), a * math.sin(angle)]), np.array([0, -b * math.sin(angle), b * math.cos(angle)])

    flat = np.unique(np.asarray(points, float)[:, 1:], axis=0) if len(points) else np.zeros((0, 2))
    if not len(flat):
        return made(float(centre[1]), float(centre[2]), EPS, EPS, 0.0)
    if len(flat) == 1:
        return made(flat[0, 0], flat[0, 1], EPS, EPS, 0.0)
    if collinear(flat):
        ends = flat[0], flat[-1]
        middle, half = (ends[0] + ends[1]) / 2, float(np.linalg.norm(ends[1] - ends[0])) / 2
        even = len(flat) == 2 or symmetric(flat)
        return made(*middle, half, half if even else EPS, math.atan2(*(ends[1] - ends[0])[::-1]))
    corners = hull_2d(flat)
    if (fit := _ellipse(corners)) is not None:
        return made(*fit)
    if (circle := _circle(corners)) is not None:
        return made(circle[0], circle[1], circle[2], circle[2], 0.0)
    return made(*corners[:2].mean(axis=0), *[float(np.linalg.norm(corners[1] - corners[0])) / 2] * 2, 0.0)


def points_in_ellipse(points: np.ndarray, ellipse: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    centre, major, minor = ellipse
    a, b = np.linalg.norm(major), np.linalg.norm(minor)
    if a < EPS or b < EPS:
        return np.zeros(len(points), bool)
    u = points - centre
    return (u @ major / a**2) ** 2 + (u @ minor / b**2) ** 2 <= 1


def points_in_frustum(points: np.ndarray, first: tuple, second: tuple) -> np.ndarray:
    """As `in_frustum`, for ellipses (centre, major, minor)."""
    axis = second[0] - first[0]
    height = float(np.linalg.norm(axis))
    if height < EPS:
        return points_in_ellipse(points, first)
    u = points - first[0]
    along = u @ axis / height
    t = (along / height)[:, None]
    across = u - along[:, None] * axis / height
    inside = np.zeros(len(points))
    for p, q in zip(first[1:], aligned(first[1:], second[1:]), strict=True):
        half = p * (1 - t) + q * t
        length2 = (half**2).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside += np.where(length2 > EPS**2, ((across * half).sum(axis=1) / length2) ** 2, np.inf)
    return (along >= 0) & (along <= height) & (inside <= 1)


def principal_axes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes, as rows by falling variance; the largest part of each axis is positive."""
    mean = points.mean(axis=0)
    _, vectors = np.linalg.eigh(np.cov((points - mean).T)) if len(points) > 1 else (None, np.eye(3))
    axes = vectors.T[::-1]
    sign = np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])
    return mean, axes * np.where(sign == 0, 1, sign)[:, None]


#: Points in space are held to this grid where a hull is sought, so that what lies in one plane does so exactly.
SNAP = 1_000_000


def _line_ends(p: np.ndarray) -> np.ndarray:
    """The points without those between two others on a line along an axis."""
    for axis in range(3):
        a, b = (c for c in range(3) if c != axis)
        p = p[np.lexsort((p[:, axis], p[:, b], p[:, a]))]
        new = (p[1:, a] != p[:-1, a]) | (p[1:, b] != p[:-1, b])
        p = p[np.concatenate([[True], new]) | np.concatenate([new, [True]])]
    return p


def facets(points: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Outward normals and offsets of the planes of the convex hull of points in space; None if they have no volume.

    The hull grows by the point furthest beyond one of its faces. Sides are told apart in whole numbers of any length, and a face
    in whose plane the point lies is replaced, too: so its rim is one ring and no face is flat, however many points share a plane.
    """
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 4 or np.linalg.matrix_rank(p - p.mean(axis=0), tol=1e-5) < 3:
        return None
    whole = _line_ends(np.unique(np.rint((p - np.rint(p[0])) * SNAP).astype(np.int64), axis=0))
    middle = whole.mean(axis=0)
    far = [int(((whole - middle) ** 2).sum(axis=1).argmax())]
    far.append(int(((whole - whole[far[0]]).astype(float) ** 2).sum(axis=1).argmax()))
    line = (whole[far[1]] - whole[far[0]]).astype(float)
    far.append(int((np.cross(whole - whole[far[0]], line) ** 2).sum(axis=1).argmax()))
    normal = np.cross(line, (whole[far[2]] - whole[far[0]]).astype(float))
    far.append(int(np.abs((whole - whole[far[0]]) @ normal).argmax()))
    q = whole.astype(object)

    def plane(a: int, b: int, c: int) -> tuple[list[int], int, tuple[int, int, int]]:
        u, v = q[b] - q[a], q[c] - q[a]
        n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        return n, sum(i * j for i, j in zip(n, q[a], strict=True)), (a, b, c)

    faces = []
    for k in range(4):
        n, d, t = plane(*(far[j] for j in range(4) if j != k))
        side = sum(i * j for i, j in zip(n, q[far[k]], strict=True)) - d
        if side == 0:
            return None
        faces.append((n, d, t) if side < 0 else plane(t[0], t[2], t[1]))
    beyond = {i: q @ np.array(f[0], object) - f[1] for i, f in enumerate(faces)}
    left = np.arange(len(q))
    while True:
        outside = np.array([(v > 0).astype(bool) for v in beyond.values()])
        stays = outside.any(axis=0)
        if not stays.any():
            break
        left, outside, beyond = left[stays], outside[:, stays], {i: v[stays] for i, v in beyond.items()}
        at = list(beyond)[int(outside.any(axis=1).argmax())]
        best = int(np.argmax(beyond[at]))
        seen = [i for i, v in beyond.items() if v[best] >= 0]
        rim = {(t[j], t[(j + 1) % 3]) for t in (faces[i][2] for i in seen) for j in range(3)}
        for i in seen:
            del beyond[i]
        for a, b in sorted(rim):
            if (b, a) not in rim:
                faces.append(plane(a, b, int(left[best])))
                beyond[len(faces) - 1] = q[left] @ np.array(faces[-1][0], object) - faces[-1][1]
    size = [math.sqrt(sum(i * i for i in faces[k][0])) for k in beyond]
    normals = np.array([[i / s for i in faces[k][0]] for k, s in zip(beyond, size, strict=True)])
    return normals, np.max([(p[a : a + 4096] @ normals.T).max(axis=0) for a in range(0, len(p), 4096)], axis=0)  # of the points as they came
