"""Geodesic distance on the WGS-84 ellipsoid with native expressions.

The usual case is Vincenty's inverse iteration (Survey Review 23(176), 1975), unrolled into a
few projections so that it stays inside generated code. Pairs that are nearly antipodal, where
that iteration does not settle, are solved by bisecting the departure azimuth, which brackets
every pair (Karney, Journal of Geodesy 87, 2013). Formulas are kept as SQL text: one parse is
far cheaper on the driver than thousands of Column calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# --- Fixed values: WGS-84, in kilometres. -------------------------------------------------
EQUATOR_RADIUS = 6378.137
POLAR_RADIUS = 6356.752314245
FLATTENING = 1 / 298.257223563

VINCENTY_STEPS = 5
BISECTION_STEPS = 60
SETTLED = "1e-11D"
TINY = "1e-300D"


def _number(value: float) -> str:
    return f"{value!r}D"


def _cos_squared(alpha: str) -> str:
    return f"(1D - {alpha} * {alpha})"


def _longitude_gain(alpha: str, sigma: str, sin_s: str, cos_s: str, mid: str) -> str:
    """Difference between spherical and geodetic longitude along an arc ``sigma``."""
    f = _number(FLATTENING)
    cos_sq = _cos_squared(alpha)
    c = f"({f} / 16D * {cos_sq} * (4D + {f} * (4D - 3D * {cos_sq})))"
    arc = f"({sigma} + {c} * {sin_s} * ({mid} + {c} * {cos_s} * (2D * {mid} * {mid} - 1D)))"
    return f"((1D - {c}) * {f} * {alpha} * {arc})"


def _arc_length(alpha: str, sigma: str, sin_s: str, cos_s: str, mid: str) -> str:
    """Kilometres along an arc ``sigma`` of the geodesic with equatorial azimuth ``alpha``."""
    u2 = f"({_cos_squared(alpha)} * {_number((EQUATOR_RADIUS / POLAR_RADIUS) ** 2 - 1)})"
    a = f"(1D + {u2} / 16384D * (4096D + {u2} * (-768D + {u2} * (320D - 175D * {u2}))))"
    b = f"({u2} / 1024D * (256D + {u2} * (-128D + {u2} * (74D - 47D * {u2}))))"
    first = f"{cos_s} * (2D * {mid} * {mid} - 1D)"
    second = f"{b} / 6D * {mid} * (4D * {sin_s} * {sin_s} - 3D) * (4D * {mid} * {mid} - 3D)"
    return f"({_number(POLAR_RADIUS)} * {a} * ({sigma} - {b} * {sin_s} * ({mid} + {b} / 4D * ({first} - {second}))))"


def _on_great_circle(df: DataFrame, kept: list[str]) -> DataFrame:
    """Add sine, cosine and arc, equatorial azimuth and midpoint for the longitude ``_lam``.

    Two projections, each short, because every reference to an inlined formula repeats it.
    """
    east, north = "(_c2 * sin(_lam))", "(_c1 * _s2 - _s1 * _c2 * cos(_lam))"
    arc = df.selectExpr(
        *kept,
        "_lam",
        f"sqrt({east} * {east} + {north} * {north}) as _sin",
        "_s1 * _s2 + _c1 * _c2 * cos(_lam) as _cos",
    )
    # The floors only matter where the numerator is 0 as well: coincident points, the equator.
    alpha = f"(_c1 * _c2 * sin(_lam) / greatest(_sin, {TINY}))"
    return arc.selectExpr(
        *kept,
        "_lam",
        "_sin",
        "_cos",
        "atan2(_sin, _cos) as _sigma",
        f"{alpha} as _alpha",
        f"_cos - 2D * _s1 * _s2 / greatest({_cos_squared(alpha)}, {TINY}) as _mid",
    )


def _bisected_length(s1: str, c1: str, s2: str, c2: str, span: str) -> str:
    """Arc length for nearly antipodal points.

    The departure point is the one farther from the equator and is mirrored to lie strictly
    south, which keeps the longitude span increasing in the azimuth.
    """
    swap = f"abs({s1}) < abs({s2})"
    ends = (
        f"named_struct('sa', if({swap}, {s2}, {s1}), 'ca', if({swap}, {c2}, {c1}),"
        f" 'sb', if({swap}, {s1}, {s2}), 'cb', if({swap}, {c1}, {c2}))"
    )
    south = "named_struct('s1', least(-abs(e.sa), -1e-15D), 'c1', e.ca, 's2', if(e.sa > 0D, -e.sb, e.sb), 'c2', e.cb)"

    def arc(azimuth: str, name: str, body: str) -> str:
        """``body`` evaluated on the arc that leaves at ``azimuth``, bound to ``name``."""
        raw = (
            f"named_struct('north', cos({azimuth}) * q.c1, 'alpha', sin({azimuth}) * q.c1,"
            f" 'north2', sqrt(greatest(cos({azimuth}) * cos({azimuth}) * q.c1 * q.c1"
            f" + (q.c2 - q.c1) * (q.c2 + q.c1), 0D)))"
        )
        turned = (
            "named_struct('alpha', r.alpha, 'sig1', atan2(q.s1, r.north), 'sig2', atan2(q.s2, r.north2),"
            " 'turn', atan2(r.alpha * q.s2, r.north2) - atan2(r.alpha * q.s1, r.north))"
        )
        flat = (
            "named_struct('alpha', t.alpha, 'sigma', t.sig2 - t.sig1, 'mid', cos(t.sig1 + t.sig2),"
            " 'turn', if(t.turn < 0D, t.turn + 2D * pi(), t.turn))"
        )
        return (
            f"transform(transform(transform(array({raw}), r -> {turned}), t -> {flat}), {name} -> {body})[0]"
        )

    def parts(name: str) -> tuple[str, ...]:
        return f"{name}.alpha", f"{name}.sigma", f"sin({name}.sigma)", f"cos({name}.sigma)", f"{name}.mid"

    middle = "((w.lo + w.hi) / 2D)"
    short = f"g.turn - {_longitude_gain(*parts('g'))} < {span}"
    narrowed = f"if({short}, named_struct('lo', {middle}, 'hi', w.hi), named_struct('lo', w.lo, 'hi', {middle}))"
    bracket = (
        f"aggregate(sequence(1, {BISECTION_STEPS}), named_struct('lo', 0D, 'hi', pi()),"
        f" (w, n) -> {arc(middle, 'g', narrowed)})"
    )
    length = arc("((b.lo + b.hi) / 2D)", "k", _arc_length(*parts("k")))
    solved = f"transform(array({bracket}), b -> {length})[0]"
    return f"transform(transform(array({ends}), e -> {south}), q -> {solved})[0]"


def add_geodesic_km(df: DataFrame, lat1: str, lng1: str, lat2: str, lng2: str, out: str) -> DataFrame:
    """Add kilometres between two points; NULL for missing, non-finite or out-of-range latitudes.

    Row-local: no shuffle, no Python worker.
    """
    kept = [f"`{name}`" for name in df.columns]
    ends = ["_s1", "_c1", "_s2", "_c2"]
    usable = (
        f"{lat1} between -90D and 90D and {lat2} between -90D and 90D"
        f" and abs({lng1}) < double('infinity') and abs({lng2}) < double('infinity')"
    )
    turn = f"(abs({lng1} - {lng2}) % 360D)"

    def reduced(lat: str) -> str:
        return f"atan({_number(1 - FLATTENING)} * tan(radians({lat})))"

    work = df.selectExpr(
        *kept,
        f"if({usable}, {reduced(lat1)}, null) as _u1",
        f"if({usable}, {reduced(lat2)}, null) as _u2",
        f"if({usable}, radians(least({turn}, 360D - {turn})), null) as _span",
    ).selectExpr(
        *kept,
        "sin(_u1) as _s1",
        "cos(_u1) as _c1",
        "sin(_u2) as _s2",
        "cos(_u2) as _c2",
        "_span",
        "_span as _lam",
    )
    carried = [*kept, *ends, "_span"]
    circle = ("_alpha", "_sigma", "_sin", "_cos", "_mid")
    following = f"_span + {_longitude_gain(*circle)} as _lam"
    for _ in range(VINCENTY_STEPS):
        work = _on_great_circle(work, carried).selectExpr(*carried, "_lam as _before", following)
    work = _on_great_circle(work, [*carried, "_before"]).selectExpr(
        *carried,
        f"abs(_lam - _before) < {SETTLED} and _lam <= pi() as _settled",
        f"{_arc_length(*circle)} as _km",
    )
    # The second branch is evaluated only for pairs that did not settle.
    hard = f"if(_settled <=> false, {_bisected_length(*ends, '_span')}, null)"
    length = f"coalesce(if(_settled, _km, null), {hard})"
    # A later filter on the distance must not be pushed into the unrolled steps: the optimizer
    # would substitute each step into the next and grow without bound. A generator stops it.
    return work.selectExpr(*kept, f"explode_outer(array({length})) as `{out}`")
