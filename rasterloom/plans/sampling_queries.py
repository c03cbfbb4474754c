"""Resampling and lookup-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import lut, resample
from rasterloom.plans.catalog import query
from rasterloom.plans.views import IMAGES_SQL, PIXELS_SQL, images, literal, pixels

_WIDTH, _TARGET = 100, (33, 7)
#: Filters in SQL, of d = |distance|.
_KERNEL = {
    "box": "CASE WHEN d <= 0.5 THEN 1.0::DOUBLE ELSE 0 END",
    "triangle": "greatest(0, 1.0::DOUBLE - d)",
    "catmullrom": "CASE WHEN d < 1 THEN 1.5::DOUBLE * d * d * d - 2.5::DOUBLE * d * d + 1 WHEN d < 2 THEN -0.5::DOUBLE * d * d * d + 2.5::DOUBLE * d * d - 4 * d + 2 ELSE 0 END",
    "mitchell": "CASE WHEN d < 1 THEN (7 * d * d * d - 12 * d * d + 16 / 3.0::DOUBLE) / 6 WHEN d < 2 THEN (-7 / 3.0::DOUBLE * d * d * d + 12 * d * d - 20 * d + 32 / 3.0::DOUBLE) / 6 ELSE 0 END",
}
_EDGE = {
    "clamp": "least(greatest(j, 0), n - 1)",
    "reflect": "CASE WHEN ((j % (2 * n - 2)) + 2 * n - 2) % (2 * n - 2) < n THEN ((j % (2 * n - 2)) + 2 * n - 2) % (2 * n - 2) ELSE 2 * n - 2 - ((j % (2 * n - 2)) + 2 * n - 2) % (2 * n - 2) END",
    "wrap": "((j % n) + n) % n",
}


def _axis_sql(name: str, size: str, target: int, kernel: str, mode: str) -> str:
    """``name``(d, s, w): the weights of one axis; ``size`` is an expression over view ``dim``."""
    reach = resample.RADIUS[kernel]
    return (
        f"{name}0 AS (SELECT i.range AS i, {size} AS n, greatest(1.0::DOUBLE, {size} / {target}.0::DOUBLE) AS scale, (i.range + 0.5::DOUBLE) * ({size} / {target}.0::DOUBLE) - 0.5::DOUBLE AS c FROM range({target}) i, dim), "
        f"{name}1 AS (SELECT i, n, scale, c, unnest(range(ceil(c - {reach}::DOUBLE * scale)::BIGINT, greatest(ceil(c - {reach}::DOUBLE * scale), floor(c + {reach}::DOUBLE * scale))::BIGINT + 1)) AS j FROM {name}0), "
        f"{name}2 AS (SELECT i, {_EDGE[mode]} AS s, abs((c - j) / scale) AS d FROM {name}1), {name}3 AS (SELECT i, s, sum({_KERNEL[kernel]}) AS w FROM {name}2 GROUP BY 1, 2), "
        f"{name} AS (SELECT i AS d, s, w / sum(w) OVER (PARTITION BY i) AS w FROM {name}3)"
    )


def _resize_sql(kernel: str, mode: str, values: list[str]) -> str:
    one = ", ".join(f"sum({v} * w) AS {v}" for v in values)
    return (
        f"WITH {IMAGES_SQL}, lifted AS (SELECT image, y, x, value, r * a AS r, g * a AS g, b * a AS b, a FROM im), dim AS (SELECT 10 AS height), "
        f"{_axis_sql('ax', str(_WIDTH), _TARGET[0], kernel, mode)}, {_axis_sql('ay', 'height', _TARGET[1], kernel, mode)}, "
        f"across AS (SELECT image, y, ax.d AS x, {one} FROM lifted JOIN ax ON x = ax.s GROUP BY 1, 2, 3), down AS (SELECT image, ay.d AS y, x, {one} FROM across JOIN ay ON y = ay.s GROUP BY 1, 2, 3) "
    )


for _kernel in resample.FILTERS:
    for _mode in resample.EDGES:

        @query(f"resize_{_kernel}_{_mode}", _resize_sql(_kernel, _mode, ["value"]) + "SELECT image, y, x, round(value, 6) AS value FROM down")
        def _resize(spark, sf_dir, kernel=_kernel, mode=_mode):
            """Every image of ten lines to 33 x 7."""
            small = resample.resize(images(spark, sf_dir), ["value"], (_WIDTH, 10), _TARGET, kernel, mode, ("image",))
            return small.select("image", "y", "x", F.round("value", 6).alias("value"))


@query("resize_alpha_aware", _resize_sql("mitchell", "clamp", ["r", "g", "b", "a"]) + "SELECT image, y, x, " + ", ".join(f"round(CASE WHEN a <> 0 THEN {c} / a ELSE 0 END, 6) AS {c}" for c in "rgb") + ", round(a, 6) AS a FROM down")
def _alpha(spark, sf_dir):
    small = resample.resize_alpha(images(spark, sf_dir), (_WIDTH, 10), _TARGET, keys=("image",))
    return small.select("image", "y", "x", *(F.round(c, 6).alias(c) for c in "rgba"))


@query("resize_columns_whole_image", f"WITH {PIXELS_SQL} SELECT y, x // 4 AS x, round(avg(value), 6) AS value FROM px GROUP BY 1, 2")
def _whole(spark, sf_dir):
    """A fourfold box reduction of every line of the image: means of four pixels."""
    across = resample.weight_table(spark, _WIDTH, _WIDTH // 4, "box", "clamp")
    p = pixels(spark, sf_dir).join(F.broadcast(across), F.col("x") == F.col("s"))
    return p.groupBy("y", F.col("d").alias("x")).agg(F.round(F.sum(F.col("value") * F.col("w")), 6).alias("value"))


_SIZE = 5


def _table(r: float, g: float, b: float) -> tuple[float, float, float]:
    return r * r, g * b, 1 - b


_LATTICE = (
    f"g AS (SELECT y, x, r, g, b, least(floor(gr), {_SIZE - 2})::INT AS ri, least(floor(gg), {_SIZE - 2})::INT AS gi, least(floor(gb), {_SIZE - 2})::INT AS bi, gr, gg, gb FROM "
    f"(SELECT *, least(greatest(r, 0), 1) * {_SIZE - 1} AS gr, least(greatest(g, 0), 1) * {_SIZE - 1} AS gg, least(greatest(b, 0), 1) * {_SIZE - 1} AS gb FROM px)), f AS (SELECT *, gr - ri AS rf, gg - gi AS gf, gb - bi AS bf FROM g)"
)


def _node(i: str, j: str, k: str) -> dict[str, str]:
    r, g, b = (f"(({v}) / {_SIZE - 1}.0::DOUBLE)" for v in (f"ri + {i}", f"gi + {j}", f"bi + {k}"))
    return {"r": f"({r} * {r})", "g": f"({g} * {b})", "b": f"(1 - {b})"}


def _tri_sql(c: str) -> str:
    return " + ".join(f"{_node(i, j, k)[c]} * {'rf' if i == '1' else '(1 - rf)'} * {'gf' if j == '1' else '(1 - gf)'} * {'bf' if k == '1' else '(1 - bf)'}" for i in "01" for j in "01" for k in "01")


def _tetra_sql(c: str) -> str:
    def walk(order: str) -> str:
        at, out = {"r": "0", "g": "0", "b": "0"}, _node("0", "0", "0")[c]
        for axis in order:
            to = at | {axis: "1"}
            out += f" + {axis}f * ({_node(*to.values())[c]} - {_node(*at.values())[c]})"
            at = to
        return out

    return f"CASE WHEN rf >= gf AND gf >= bf THEN {walk('rgb')} WHEN rf >= bf AND bf >= gf THEN {walk('rbg')} WHEN bf >= rf AND rf >= gf THEN {walk('brg')} WHEN gf >= rf AND rf >= bf THEN {walk('grb')} WHEN gf >= bf AND bf >= rf THEN {walk('gbr')} ELSE {walk('bgr')} END"


for _name, _expr in (("trilinear", _tri_sql), ("tetrahedral", _tetra_sql)):

    @query(f"lut3d_{_name}", f"WITH {PIXELS_SQL}, {_LATTICE} SELECT y, x, " + ", ".join(f"round({_expr(c)}, 6) AS {c}" for c in "rgb") + " FROM f")
    def _lut(spark, sf_dir, tetrahedral=_name == "tetrahedral"):
        cube = lut.from_function(_SIZE, _table)
        out = lut.apply(pixels(spark, sf_dir).select("y", "x", *"rgb"), cube, tetrahedral=tetrahedral)
        return out.select("y", "x", *(F.round(c, 6).alias(c) for c in "rgb"))


_CUBE = 'TITLE "small"  # a name\nLUT_3D_SIZE 2\nDOMAIN_MIN 0 0 0\nDOMAIN_MAX 2 2 2\n# red varies fastest\n' + "\n".join(f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1))


@query("lut_cube_text", f"WITH {PIXELS_SQL} SELECT y, x, round(least(greatest(r / 2, 0), 1), 6) AS r, round(g / 2, 6) AS g, round(b / 2, 6) AS b FROM px")
def _cube_text(spark, sf_dir):
    """An identity table read from .cube text, over the domain 0 to 2."""
    out = lut.apply(pixels(spark, sf_dir).select("y", "x", *"rgb"), lut.parse_cube(_CUBE))
    return out.select("y", "x", *(F.round(c, 6).alias(c) for c in "rgb"))


@query("lut_cube_parse", "SELECT i::BIGINT AS i, ((i % 24) // 3 >> (i % 3) & 1)::DOUBLE AS value FROM range(24) t(i)")
def _cube_rows(spark, sf_dir):
    cube = lut.parse_cube(_CUBE)
    return literal(spark, list(enumerate(cube.data)), "i long, value double")
