"""Geometry as Column expressions: rotations, projections, angles. Vectors and row-major 3x3 matrices are arrays of doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Camera optical axes to link axes, used where a recording's transforms state none.
OPTICAL_TO_LINK = (0.0, 0.0, 1.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0)


def vec(*parts) -> Column:
    return F.array(*[p if isinstance(p, Column) else F.lit(float(p)) for p in parts])


def at(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def dot(a: Column, b: Column, n: int = 3) -> Column:
    out = at(a, 0) * at(b, 0)
    for i in range(1, n):
        out = out + at(a, i) * at(b, i)
    return out


def sub(a: Column, b: Column) -> Column:
    return vec(*[at(a, i) - at(b, i) for i in range(3)])


def add(a: Column, b: Column) -> Column:
    return vec(*[at(a, i) + at(b, i) for i in range(3)])


def times(a: Column, k) -> Column:
    return vec(*[at(a, i) * k for i in range(3)])


def cross(a: Column, b: Column) -> Column:
    return vec(*[at(a, (i + 1) % 3) * at(b, (i + 2) % 3) - at(a, (i + 2) % 3) * at(b, (i + 1) % 3) for i in range(3)])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mat_vec(m: Column, v: Column) -> Column:
    return vec(*[sum((at(m, 3 * i + j) * at(v, j) for j in range(1, 3)), at(m, 3 * i) * at(v, 0)) for i in range(3)])


def transpose(m: Column) -> Column:
    return vec(*[at(m, 3 * j + i) for i in range(3) for j in range(3)])


def quat_to_rot(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Rotation matrix of a quaternion, normalised first. A zero quaternion gives nulls."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    n = F.when(n > 0, n)
    x, y, z, w = x / n, y / n, z / n, w / n
    return vec(
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    )


def rot_to_quat(m: Column) -> Column:
    """Quaternion (x, y, z, w) by the numerically largest of four branches."""
    r = lambda i, j: at(m, 3 * i + j)
    trace = r(0, 0) + r(1, 1) + r(2, 2)

    def branch(i: int) -> Column:
        j, k = (i + 1) % 3, (i + 2) % 3
        s = 2 * F.sqrt(F.greatest(F.lit(0.0), 1 + r(i, i) - r(j, j) - r(k, k)))
        part = {i: s / 4, j: (r(i, j) + r(j, i)) / s, k: (r(i, k) + r(k, i)) / s}
        return vec(part[0], part[1], part[2], (r(k, j) - r(j, k)) / s)

    s = 2 * F.sqrt(F.greatest(F.lit(0.0), trace + 1))
    first = vec((r(2, 1) - r(1, 2)) / s, (r(0, 2) - r(2, 0)) / s, (r(1, 0) - r(0, 1)) / s, s / 4)
    return F.when(trace > 0, first).when((r(0, 0) > r(1, 1)) & (r(0, 0) > r(2, 2)), branch(0)).when(r(1, 1) > r(2, 2), branch(1)).otherwise(branch(2))


def optical_to_world(p: Column, rot: Column, t: Column, link: Column | None = None) -> Column:
    link = vec(*OPTICAL_TO_LINK) if link is None else link
    return add(mat_vec(rot, mat_vec(link, p)), t)


def world_to_optical(p: Column, rot: Column, t: Column, link: Column | None = None) -> Column:
    link = vec(*OPTICAL_TO_LINK) if link is None else link
    return mat_vec(transpose(link), mat_vec(transpose(rot), sub(p, t)))


def project(p: Column, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Pixel (u, v) of a point in optical axes; null where it lies in the camera plane."""
    z = F.when(at(p, 2) != 0, at(p, 2))
    return at(p, 0) * fx / z + cx, at(p, 1) * fy / z + cy


def project_extrinsic(p: Column, rot: Column, t: Column, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Pixel of a point where the pose maps world to camera."""
    return project(add(mat_vec(rot, p), t), fx, fy, cx, cy)


def back_project(u: Column, v: Column, mm: Column, fx, fy, cx, cy) -> Column:
    z = mm / 1000.0
    return vec((u - cx) * z / fx, (v - cy) * z / fy, z)


def euler_zyx(m: Column) -> Column:
    """(yaw, pitch, roll) in radians; near the poles roll is 0."""
    sy = -at(m, 6)
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sy)))
    pole = F.abs(sy) > 0.9999
    yaw = F.when(pole, F.atan2(-at(m, 1), at(m, 4))).otherwise(F.atan2(at(m, 3), at(m, 0)))
    return vec(yaw, pitch, F.when(pole, F.lit(0.0)).otherwise(F.atan2(at(m, 7), at(m, 8))))


def wrapped_step(now: Column, before: Column, turn: float = 2 * math.pi) -> Column:
    """Difference of two angles after unwrapping: in [-half, half], a half turn keeps the step's sign."""
    d, half = now - before, turn / 2
    w = F.pmod(d + half, F.lit(turn)) - half
    return F.when(F.abs(d) < half, d).when((w == -half) & (d > 0), half).otherwise(w)


def pose_matrix(rot: Column, t: Column) -> Column:
    """Row-major 4x4 matrix."""
    rows = [x for i in range(3) for x in (at(rot, 3 * i), at(rot, 3 * i + 1), at(rot, 3 * i + 2), at(t, i))]
    return vec(*rows, 0.0, 0.0, 0.0, 1.0)


def matrix_pose(m: Column) -> tuple[Column, Column]:
    return vec(*[at(m, 4 * i + j) for i in range(3) for j in range(3)]), vec(*[at(m, 4 * i + 3) for i in range(3)])


def field_of_view(pixels: Column, focal: Column) -> Column:
    return F.when(focal != 0, F.degrees(2 * F.atan(pixels / (2 * focal))))


def angle_between(a: Column, b: Column) -> Column:
    """Degrees; null where a side has no length."""
    na, nb = norm(a), norm(b)
    c = F.when((na > 1e-6) & (nb > 1e-6), dot(a, b) / (na * nb))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def plane_basis(eq: Column) -> tuple[Column, Column, Column, Column]:
    """(origin, u, v, normal) of a plane (a, b, c, d): origin is its point nearest to zero. Nulls within where a, b and c are 0."""
    size = F.nullif(F.sqrt(dot(eq, eq)), F.lit(0.0))
    n = vec(*[at(eq, i) / size for i in range(3)])
    origin = times(n, -at(eq, 3) / size)
    helper = F.when(F.abs(at(n, 0)) < 0.9, vec(1, 0, 0)).otherwise(vec(0, 1, 0))
    u = cross(n, helper)
    u = times(u, 1 / norm(u))
    return origin, u, cross(n, u), n


def with_elbow(df: DataFrame, upper: float = 0.33, fore: float = 0.27, down: Column | None = None) -> DataFrame:
    """df (shoulder, wrist) with elbow of a two-bone arm: straight where the wrist is out of reach, else by the law of cosines.

    The arm bends in the plane of its direction and down; where those agree, in that of its direction and x.
    Steps are columns of their own, so that no expression holds another many times. Without a wrist there is no elbow.
    """
    down = vec(0, -1, 0) if down is None else down
    d = df.withColumn("_arm", sub(F.col("wrist"), F.col("shoulder"))).withColumn("_reach", norm(F.col("_arm")))
    d = d.withColumn("_along", times(F.col("_arm"), 1 / F.when(F.col("_reach") > 1e-6, F.col("_reach")))).withColumn("_side", cross(F.col("_along"), down))
    d = d.withColumn("_side", F.when(norm(F.col("_side")) > 1e-6, F.col("_side")).otherwise(cross(F.col("_along"), vec(1, 0, 0))))
    d = d.withColumn("_width", norm(F.col("_side"))).withColumn("_axis", times(F.col("_side"), 1 / F.when(F.col("_width") > 0, F.col("_width"))))
    reach = F.col("_reach")
    cos = (upper**2 + reach * reach - fore**2) / (2 * upper * F.when(reach > 1e-6, reach))
    d = d.withColumn("_cos", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))).withColumn("_bend", cross(F.col("_axis"), F.col("_along")))
    bent = add(times(F.col("_along"), upper * F.col("_cos")), times(F.col("_bend"), upper * F.sqrt(1 - F.col("_cos") * F.col("_cos"))))
    offset = F.when(reach < 1e-6, times(down, upper)).when(reach >= 0.99 * (upper + fore), times(F.col("_along"), upper)).otherwise(bent)
    return d.withColumn("_offset", offset).withColumn("elbow", add(F.col("shoulder"), F.col("_offset"))).select(*df.columns, "elbow")


def brighten(c: Column) -> Column:
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(60.0), c * 1.4))).cast("int")


def speed_settings(quality: Column) -> tuple[Column, Column, Column]:
    """Quality dial 0..1 to (take every n-th frame, frame cap, occlusion test); outside it raises."""
    q = F.when((quality >= 0) & (quality <= 1), quality).otherwise(F.raise_error(F.lit("quality must be in 0..1")).cast("double"))
    return F.greatest(F.lit(1), F.bround(F.pow(F.lit(30.0), 1 - q)).cast("int")), F.when(q < 0.15, 400), q >= 0.5


def inflate_box(x1, y1, x2, y2, factor: float, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """A box scaled about its centre, rounded half to even and clipped to the image."""
    cx, cy, hw, hh = (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) / 2 * factor, (y2 - y1) / 2 * factor
    clip = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), F.bround(c).cast("int")))
    return clip(cx - hw, width), clip(cy - hh, height), clip(cx + hw, width), clip(cy + hh, height)


def hms(seconds: Column) -> Column:
    s = F.greatest(F.bround(seconds).cast("long"), F.lit(0).cast("long"))
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def iso(seconds: Column) -> Column:
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss"))


def weekday(seconds: Column) -> Column:
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "").otherwise(F.date_format(F.timestamp_seconds(seconds), "EEEE"))


def tone(value: Column, good: float, ok: float) -> Column:
    return F.when(value.isNull(), None).when(value >= good, "good").when(value >= ok, "warn").otherwise("bad")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def pct(a: Column, b: Column) -> Column:
    return F.when(b > 0, 100.0 * a / b).otherwise(0.0)


def weak_perspective(scale: Column, tx: Column, ty: Column, box_x: Column, box_y: Column, width: int, height: int, focal: float = 5000.0, crop: int = 256) -> Column:
    """Camera translation in the whole image, of a scaled-orthographic camera that was fitted to a square crop."""
    longest = max(width, height)
    z = 2.0 * (focal / crop * longest) / (crop * scale + 1e-9)
    shift = lambda t, centre, size: t + 2.0 * (centre - size / 2.0) / longest * z
    return vec(shift(tx, box_x, width), shift(ty, box_y, height), z)


def crop_to_image(u: Column, v: Column, left: Column, box_x: Column, box_y: Column, size: Column) -> tuple[Column, Column]:
    """Pixel of a crop's point in -0.5..0.5; crops of left hands were mirrored."""
    u = F.when(left, -u).otherwise(u)
    return box_x + u * size, box_y + v * size


def turned_against(width: Column, height: Column, depth_width: Column, depth_height: Column) -> Column:
    """Whether one of both images is upright and the other is not; false without a depth image."""
    return F.coalesce((width > height) != (depth_width > depth_height), F.lit(False))


def frustum(width, height, fx, fy, cx, cy, depth: float) -> list[Column]:
    """Corners of the image at a depth, in optical axes, around the border."""
    x = [(F.lit(float(u)) - cx) / fx * depth for u in (0, width)]
    y = [(F.lit(float(v)) - cy) / fy * depth for v in (0, height)]
    return [vec(x[i], y[j], depth) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]


def hand_at(joints: Column, anchor: Column, left: Column, turned: Column) -> Column:
    """Joints (array of points) moved so that the first lies on anchor; left hands mirrored, turned ones set upright."""
    wrist = at(joints, 0)

    def one(j: Column) -> Column:
        x, y, z = (at(j, i) - at(wrist, i) for i in range(3))
        x = F.when(left, -x).otherwise(x)
        return vec(F.when(turned, -y).otherwise(x) + at(anchor, 0), F.when(turned, x).otherwise(y) + at(anchor, 1), z + at(anchor, 2))

    return F.transform(joints, one)
