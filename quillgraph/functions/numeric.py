"""Column functions over dates and numbers: sizes, association measures, evidence verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import js_trim

# fixed values: the first year that counts; base, factor, smallest and largest size of each kind of node
VALID_YEAR_MIN = 1990
APPLICANT_SIZE, CONCEPT_SIZE, INSTITUTION_SIZE = (18, 5, 18, 52), (10, 10, 10, 72), (18, 5, 0, 52)
# fixed values: opacity of an edge without support and what is added at most, strokes of edges: base, factor, most
OPACITY, PAIR_WIDTH, INSTITUTION_WIDTH = (0.30, 0.70), (1, 7, 8.0), (1, 1.4, 8.0)


def excel_serial_to_date(serial: Column) -> Column:
    """ISO date of a spreadsheet serial number; null at or below 0 and where it is no number."""
    x = serial.cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < 3_000_000), F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), F.floor(x + 0.5).cast("int")), "yyyy-MM-dd"))


def coerce_date(text: Column) -> Column:
    """A numeric string as a serial number, any other string as it is."""
    t = js_trim(text)
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), excel_serial_to_date(F.try_to_number(t, F.lit("9999999999.999999")).cast("double"))).otherwise(F.nullif(t, F.lit("")))


def date_sort_key(date: Column) -> Column:
    p = r"^(\d{4})\D+(\d{1,2})\D+(\d{1,2})"
    t = js_trim(date)
    return F.when(t.rlike(p), F.concat(F.regexp_extract(t, p, 1), F.lpad(F.regexp_extract(t, p, 2), 2, "0"), F.lpad(F.regexp_extract(t, p, 3), 2, "0")))


def filing_year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit("")).cast("int")


def is_valid_year(year: Column, max_year: int) -> Column:
    """max_year stands for the current year + 1, and is a parameter so that results do not move with the clock."""
    return F.coalesce(year.between(VALID_YEAR_MIN, max_year), F.lit(False))


def clamped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def _size(n: Column, base: float, factor: float, least: float, most: float) -> Column:
    return clamped(base + factor * F.sqrt(n), least, most)


def applicant_size(n: Column) -> Column:
    return _size(n, *APPLICANT_SIZE)


def concept_size(n: Column) -> Column:
    return _size(n, *CONCEPT_SIZE)


def institution_size(n: Column) -> Column:
    return _size(n, *INSTITUTION_SIZE)


def npmi(pxy: Column, px: Column, py: Column) -> Column:
    """ln(pxy / (px py)) / -ln pxy within -1..1; null where a probability is not positive or pxy is 1."""
    ok = (pxy > 0) & (px > 0) & (py > 0) & (pxy < 1 - 1e-12)
    return F.when(ok, clamped(F.ln(pxy / (px * py)) / -F.ln(pxy), -1, 1))


def association(total_support: Column, cij: Column, ci: Column, cj: Column) -> Column:
    """2 m c_ij / (c_i c_j), where m is half the sum of all edges' support; null where one is not positive."""
    return F.when((total_support > 0) & (cij > 0) & (ci > 0) & (cj > 0), total_support * cij / (ci * cj))


def jaccard(both: Column, a: Column, b: Column) -> Column:
    union = a + b - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def support_opacity(support: Column, tau: float = 5.0) -> Column:
    return OPACITY[0] + OPACITY[1] * (1 - F.exp(-F.greatest(support, F.lit(0)) / tau))


def cooccurrence_width(measure: Column) -> Column:
    """Stroke width of a share or of an NPMI (floored at 0)."""
    base, factor, most = PAIR_WIDTH
    return F.least(F.lit(most), base + factor * F.greatest(F.coalesce(measure, F.lit(0.0)), F.lit(0.0)))


def institution_width(support: Column) -> Column:
    base, factor, most = INSTITUTION_WIDTH
    return F.least(F.lit(most), base + factor * F.sqrt(support))


def citation_net(forward: Column, reverse: Column) -> Column:
    return F.abs(F.greatest(forward, F.lit(0)) - F.greatest(reverse, F.lit(0)))


def citation_state(forward: Column, reverse: Column) -> Column:
    """absent, insufficient, aligned or conflicting; supported if the larger side leads by 2 and is twice the smaller."""
    f, r = F.greatest(forward, F.lit(0)), F.greatest(reverse, F.lit(0))
    win, lose = F.greatest(f, r), F.least(f, r)
    supported = (win - lose >= 2) & ((lose == 0) | (win >= 2 * lose))
    return F.when((f == 0) & (r == 0), F.lit("absent")).when(~supported, F.lit("insufficient")).when(f > r, F.lit("aligned")).otherwise(F.lit("conflicting"))


def orientation(median_a: Column, median_b: Column) -> Column:
    """a: from a to b; b: from b to a; null: equal or unknown medians give no direction."""
    return F.when(median_a < median_b, F.lit("a")).when(median_a > median_b, F.lit("b"))


# ---------------------------------------------------------------- publication sizes

# fixed values: column widths in mm and the values that belong to them
NARROW_MM, WIDE_MM = 85.0, 180.0


def between_widths(mm: Column, at_narrow: float, at_wide: float) -> Column:
    """Linear between the two column widths and beyond."""
    return at_narrow + (mm - NARROW_MM) / (WIDE_MM - NARROW_MM) * (at_wide - at_narrow)


# ---------------------------------------------------------------- colours

# fixed values: the rainbow of first years, and the colour of an unknown one
RAINBOW = ["#EF4444", "#F97316", "#EAB308", "#22C55E", "#3B82F6", "#4F46E5", "#8B5CF6"]
UNKNOWN_YEAR = "#BAB0AC"
# fixed values: OKLab matrices (Ottosson), RGB to cone response, cone response to Lab, and back
TO_LMS = [[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]]
TO_LAB = [[0.2104542553, 0.793617785, -0.0040720468], [1.9779984951, -2.428592205, 0.4505937099], [0.0259040371, 0.7827717662, -0.808675766]]
FROM_LAB = [[1.0, 0.3963377774, 0.2158037573], [1.0, -0.1055613458, -0.0638541728], [1.0, -0.0894841775, -1.291485548]]
TO_RGB = [[4.0767416621, -3.3077115913, 0.2309699292], [-1.2684380046, 2.6097574011, -0.3413193965], [-0.0041960863, -0.7034186147, 1.707614701]]


def _times(m: list[list[float]], v: list) -> list:
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in m]


def oklab(colour: str) -> list[float]:
    """OKLab of #RRGGBB; used while a plan is made, for the anchors only."""
    channels = [int(colour[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    linear = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in channels]
    return _times(TO_LAB, [math.cbrt(x) for x in _times(TO_LMS, linear)])


def _channel(linear: Column) -> Column:
    curve = lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    return F.lpad(F.hex(F.floor(255 * F.transform(F.array(clamped(linear, 0, 1)), curve)[0] + 0.5)), 2, "0")


def gradient_colour(first_year: Column, window_from: Column, window_to: Column) -> Column:
    """Colour of a year's place in the window, interpolated between anchors in OKLab."""
    span = (window_to - window_from).cast("double")
    t = F.when(span > 0, clamped((first_year - window_from) / span, 0, 1)).otherwise(F.lit(0.0))
    at = t * (len(RAINBOW) - 1)
    low = F.floor(at).cast("int")
    share = at - low
    anchors = [oklab(c) for c in RAINBOW]
    lab = []
    for k in range(3):
        values = F.array(*[F.lit(a[k]) for a in [*anchors, anchors[-1]]])
        lab.append(F.get(values, low) + (F.get(values, low + 1) - F.get(values, low)) * share)
    # each step is bound once: written out, every channel would repeat all steps before it
    lms = _bound(lab, lambda v: [x * x * x for x in _times(FROM_LAB, v)])
    colour = lms(lambda v: F.concat(F.lit("#"), *[_channel(c) for c in _times(TO_RGB, v)]))
    return F.when(first_year.isNull() | window_from.isNull(), F.lit(UNKNOWN_YEAR)).otherwise(colour)


def _bound(values: list[Column], step):
    """A function that applies `last` to step(values), with the values and step's results evaluated once each."""

    def apply(last) -> Column:
        def inner(v: Column) -> Column:
            done = F.array(*step([v[k] for k in range(len(values))]))
            return F.transform(F.array(done), lambda w: last([w[k] for k in range(len(values))]))[0]

        return F.transform(F.array(F.array(*values)), inner)[0]

    return apply
