"""Column functions of the trajectory model: rounding, geometry, directions, behaviour, labels."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vehicle classes by id.
CLASS_NAMES = {0: "Car", 1: "Bus", 2: "Truck", 3: "Auto", 4: "2W", 5: "LCV", 6: "Bicycle", 7: "Pedestrian"}


@dataclass(frozen=True)
class Parameters:
    """Thresholds of a run. ppm (pixels a metre) is None where the view is not calibrated."""

    min_observations: int = 5
    step: float = 0.5
    frame_height: float = 1080.0
    ppm: float | None = None
    cap_uncalibrated: float = 2000.0
    cap_metres: float = 70.0
    stopped: float = 0.5
    braking: float = -8.0
    tailgating: float = 1.2
    weaving: float = 2.0
    erratic: float = 1.0
    neighbour_seconds: float = 1.0
    headway_cap: float = 120.0

    @property
    def speed_cap(self) -> float:
        return self.cap_metres * self.ppm if self.ppm else self.cap_uncalibrated


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: str | Column, digits: int = 2) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: the same bits in Spark and in SQL engines, unlike round()."""
    scale = float(10**digits)
    return F.floor(c(x) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def formatted(x: str | Column, digits: int = 2) -> Column:
    """The presentation string of a measure, as "%.2f" prints it in C and Python: the exact binary value is rounded, an exact tie to the even digit.

    Spark's format_string rounds the shortest decimal half up, which differs where that decimal is a tie: 1.005
    lies below it. Here x * 10^d is taken as a rounded product and its exact error, so that ties are seen as they are.

    An expression has no names for its parts: each mention of a part is a copy, and so are those of x. So parts are mentioned sparingly.
    """
    x, scale = c(x), F.lit(float(10**digits))
    size = F.abs(x)
    product = size * scale
    # The halves of x times the scale are exact (it has 26 significant bits at most, up to 11 digits), so this is what the product lost.
    high = size * F.lit(134217729.0) - (size * F.lit(134217729.0) - size)
    error = (high * scale - product) + (size - high) * scale
    whole = F.floor(product)
    over = (product - whole - F.lit(0.5)) + error
    number = whole + F.when(F.signum(over) * 2 + whole % 2 > 0, 1).otherwise(0)
    text = (number.cast("decimal(16,0)") * F.lit(Decimal(1).scaleb(-digits))).cast("string")
    # The sign of the double, a negative zero's too.
    sign = F.when((x < 0) | (x.cast("string") == "-0.0"), "-").otherwise("")
    return F.when(product < 2.0**52, F.concat(sign, text)).otherwise(F.format_string(f"%.{digits}f", x))


def class_name(class_id: str | Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in CLASS_NAMES.items() for v in pair])
    return F.coalesce(F.try_element_at(names, c(class_id).cast("int")), F.concat(F.lit("cls"), c(class_id).cast("string")))


def hop(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def rate(amount: Column, dt: Column) -> Column:
    """amount / dt, 0 where no time passes."""
    return F.when(dt > 0, amount / dt).otherwise(F.lit(0.0))


def middle_of_three(a: Column, b: Column, d: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), d))


def degrees_of(dy: Column, dx: Column) -> Column:
    # Adding a positive zero takes the sign off a negative one.
    return F.degrees(F.atan2(dy + F.lit(0.0), dx + F.lit(0.0)))


def wrapped(angle: Column) -> Column:
    """A difference of two headings, brought into [-180, 180]."""
    return F.when(angle > 180, angle - 360).when(angle < -180, angle + 360).otherwise(angle)


def quadrant(angle: Column, up: str, down: str) -> Column:
    return (
        F.when((angle >= -45) & (angle < 45), F.lit("Eastbound"))
        .when((angle >= 45) & (angle < 135), F.lit(up))
        .when((angle >= -135) & (angle < -45), F.lit(down))
        .otherwise(F.lit("Westbound"))
    )


def direction_of_displacement(dx: Column, dy: Column) -> Column:
    """Direction from first to last observation; y grows downwards."""
    still = (F.abs(dx) < 1) & (F.abs(dy) < 1)
    return F.when(still, F.lit("Stationary")).otherwise(quadrant(degrees_of(-dy, dx), "Northbound", "Southbound"))


def direction_of_resampled(dx: Column, dy: Column, rows: Column) -> Column:
    """Direction of a resampled track: stationary only if it has a single row."""
    return F.when(rows < 2, F.lit("Stationary")).otherwise(quadrant(degrees_of(dy, dx), "Southbound", "Northbound"))


def behaviour(p: Parameters, speed: Column, cv: Column, median: Column, q1: Column, q3: Column, lateral: Column, braking: Column, headway: Column) -> Column:
    """The rule cascade; the first rule that holds names the behaviour."""
    iqr = q3 - q1
    high, low = q3 + 1.5 * iqr, q1 - 1.5 * iqr
    return (
        F.when((speed < p.stopped) & (median > 0), F.lit("Stopped/Idling"))
        .when(median <= 0, F.lit("Disciplined"))
        .when((speed > high) & (high > 0), F.lit("Speeding"))
        .when(braking < p.braking, F.lit("Aggressive Braking"))
        .when((headway > 0) & (headway < p.tailgating), F.lit("Tailgating"))
        .when(F.abs(lateral) > p.weaving, F.lit("Lane Weaving"))
        .when((speed < low) & (low > 0), F.lit("Slow"))
        .when(cv > p.erratic, F.lit("Erratic"))
        .otherwise(F.lit("Disciplined"))
    )


def iou(a: str, b: str) -> Column:
    """Intersection over union of boxes held as columns {a}x1.. and {b}x1..; 0 where the union is empty."""
    ax1, ay1, ax2, ay2 = (F.col(f"{a}{k}") for k in ("x1", "y1", "x2", "y2"))
    bx1, by1, bx2, by2 = (F.col(f"{b}{k}") for k in ("x1", "y1", "x2", "y2"))
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd test of the truncated point; fewer than three corners mean no filter."""
    if len(polygon) < 3:
        return F.lit(True)
    px, py = F.floor(x).cast("double"), F.floor(y).cast("double")
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if y1 == y2:
            continue
        at = F.lit(float(x1)) + (py - F.lit(float(y1))) * F.lit(float(x2 - x1)) / F.lit(float(y2 - y1))
        crossings = crossings + (((py < y1) != (py < y2)) & (px < at)).cast("int")
    return crossings % 2 == 1


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def unit(x: Column) -> Column:
    return clamp(x, 0, 1)


def lerp(a: Column, b: Column, ratio: Column) -> Column:
    return a + (b - a) * unit(ratio)


def parsed(x: str | Column, kind: str, default: object) -> Column:
    """A number out of a string, default where there is none."""
    return F.coalesce(c(x).try_cast(kind), F.lit(default).cast(kind))


def label_middle(label: str | Column) -> Column:
    """The middle of a bin from its label "a-b"; null where it is no such label."""
    ends = F.split(c(label), "-")
    return F.when(F.size(ends) == 2, (F.get(ends, 0).try_cast("double") + F.get(ends, 1).try_cast("double")) / 2)


def share_done(done: str | Column, total: str | Column) -> Column:
    """Progress from 0 to 1; 0 where nothing is to do."""
    return F.when(c(total) > 0, F.least(c(done) / c(total), F.lit(1.0))).otherwise(F.lit(0.0))


def point_list(x: str | Column) -> Column:
    """[[x, y], ...] out of JSON; an empty list where it is no such list."""
    return F.coalesce(F.from_json(c(x), "array<array<double>>"), F.array().cast("array<array<double>>"))


def confidence_band(confidence: str | Column, high: float = 0.6, low: float = 0.1) -> Column:
    x = c(confidence)
    return F.when(x >= high, F.lit("high")).when(x >= low, F.lit("low")).otherwise(F.lit("discarded"))


def box_to_centre(prefix: str = "") -> list[Column]:
    x1, y1, x2, y2 = (F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2"))
    return [(x1 + (x2 - x1) / 2).alias("box_cx"), (y1 + (y2 - y1) / 2).alias("box_cy"), (x2 - x1).alias("box_w"), (y2 - y1).alias("box_h")]


def centre_to_box(cx: str, cy: str, w: str, h: str) -> list[Column]:
    """Corners of a box of at least one pixel a side."""
    w, h = F.greatest(c(w), F.lit(1.0)), F.greatest(c(h), F.lit(1.0))
    return [(c(cx) - w / 2).alias("x1"), (c(cy) - h / 2).alias("y1"), (c(cx) + w / 2).alias("x2"), (c(cy) + h / 2).alias("y2")]


def perspective(x: Column, y: Column, m: list[list[float]] | Column) -> tuple[Column, Column]:
    """A point through a homography: a 3 x 3 matrix of numbers, or a column with its nine numbers row by row."""
    if isinstance(m, Column):
        rows = [m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2] for i in range(3)]
    else:
        rows = [F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) for r in m]
    return F.when(rows[2] != 0, rows[0] / rows[2]), F.when(rows[2] != 0, rows[1] / rows[2])


def ordered_quad(points: Column) -> Column:
    """The first four points of an array of [x, y] as an array: top left (least x + y), top right (least y - x), bottom right (greatest x + y), bottom left (greatest y - x).

    Of points that tie the first is taken; null where there are fewer than four points.
    """
    four = F.slice(points, 1, 4)
    numbered = F.transform(four, lambda p, i: F.struct((p[0] + p[1]).alias("sum"), (p[1] - p[0]).alias("diff"), i.alias("i"), p.alias("p")))
    least = lambda key: F.array_min(F.transform(numbered, lambda q: F.struct(q[key].alias("k"), q["i"].alias("i"), q["p"].alias("p"))))["p"]
    most = lambda key: F.array_min(F.transform(numbered, lambda q: F.struct((-q[key]).alias("k"), q["i"].alias("i"), q["p"].alias("p"))))["p"]
    return F.when(F.size(points) >= 4, F.array(least("sum"), least("diff"), most("sum"), most("diff")))


def homography(source: Column, target: list[tuple[float, float]]) -> Column:
    """The nine numbers (row by row, the last 1) of the map that takes four points to four given ones; null where none does.

    The eight unknowns solve eight linear equations, two for each point. They are eliminated in column
    functions, a row of the system being an array, with the largest pivot of each column.
    """
    x = lambda i: source[i][0].cast("double")
    y = lambda i: source[i][1].cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)
    system = []
    for i, (u, v) in enumerate(target):
        u, v = F.lit(float(u)), F.lit(float(v))
        system.append(F.array(x(i), y(i), one, zero, zero, zero, -u * x(i), -u * y(i), u))
        system.append(F.array(zero, zero, zero, x(i), y(i), one, -v * x(i), -v * y(i), v))

    def eliminated(held: Column, k: Column) -> Column:
        """Column k out of all rows but the pivot's, which is scaled to 1 and put at place k; null where no pivot is left."""
        place = F.array_max(F.transform(held, lambda r, i: F.named_struct(F.lit("size"), F.when(i >= k, F.abs(r[k])).otherwise(-1.0), F.lit("i"), -i)))
        at = -place["i"]
        pivot = F.transform(F.element_at(held, (at + 1).cast("int")), lambda c: c / F.element_at(F.element_at(held, (at + 1).cast("int")), (k + 1).cast("int")))
        swapped = F.transform(held, lambda r, i: F.when(i == k, pivot).when(i == at, F.element_at(held, (k + 1).cast("int"))).otherwise(r))
        rows = F.transform(swapped, lambda r, i: F.when(i == k, r).otherwise(F.zip_with(r, pivot, lambda a, b: a - r[k] * b)))
        return F.when(place["size"] > 1e-12, rows)

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.array(*system), eliminated)
    return F.when(solved.isNotNull(), F.concat(F.transform(solved, lambda r: r[8]), F.array(one)))


def track_colour(track: str | Column) -> Column:
    """[blue, green, red] of a track: hues spread by the golden ratio, fixed saturation and brightness."""
    # The ratio, half-degrees of hue, saturation and brightness.
    ratio, half_turn, saturation, brightness = 0.618033988749895, 180, 220, 230
    spread = c(track).cast("double") * ratio
    hue = F.floor((spread - F.floor(spread)) * half_turn) * 2.0 / 60.0  # in sixths of a turn
    chroma = brightness * saturation / 255.0
    wave = lambda shift: (hue + shift) % 6
    level = lambda shift: F.round(brightness - chroma * F.greatest(F.lit(0.0), F.least(F.least(wave(shift), 4 - wave(shift)), F.lit(1.0)))).cast("int")
    return F.array(level(1), level(3), level(5))


def pixels_per_metre(p: tuple[float, float], q: tuple[float, float], metres: float) -> float | None:
    """Calibration from two points whose distance on the road is known."""
    return ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5 / metres if metres > 0 else None
