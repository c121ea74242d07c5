"""Surface displacement of a rectangular fault in a half-space, Okada (1985), as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: mu / (lambda + mu).
ALPHA = 0.5
#: The corners of the fault: whether the length and the width are taken off, and the sign.
CORNERS = ((0, 0, 1), (0, 1, -1), (1, 0, -1), (1, 1, 1))
TINY = 1e-12


def with_dislocation(rows: DataFrame, names: tuple[str, str, str], x: Column, y: Column, depth: Column, length: Column, width: Column, dip: Column, strike_slip: Column, dip_slip: Column, alpha: float = ALPHA) -> DataFrame:
    """rows with three columns more: along strike, across it and up, in the unit of the slips.

    x, y: from the fault's centre, along strike and across; depth: of its centre; dip in degrees. Each step is a projection
    of its own, so that nothing is computed twice and all of it is generated code."""
    kept = rows.columns
    sine, cosine = F.sin(F.radians(dip)), F.cos(F.radians(dip))
    rows = rows.withColumns({"o_sd": sine, "o_cd": F.when(F.abs(cosine) < 1e-9, 0.0).otherwise(cosine), "o_x": x, "o_y": y, "o_c": depth, "o_l": length, "o_w": width, "o_ss": strike_slip, "o_ds": dip_slip})
    sd, cd = F.col("o_sd"), F.col("o_cd")
    rows = rows.withColumns({"o_x": F.col("o_x") + F.col("o_l") / 2, "o_y": F.col("o_y") + F.col("o_w") / 2 * cd, "o_c": F.col("o_c") + F.col("o_w") / 2 * sd})
    rows = rows.withColumns({"o_p": F.col("o_y") * cd + F.col("o_c") * sd, "o_q": F.col("o_y") * sd - F.col("o_c") * cd})
    q, upright = F.col("o_q"), cd == 0
    at = lambda n: lambda name: F.col(f"o{n}_{name}")
    steps = [
        lambda c, k: {"xi": F.col("o_x") - CORNERS[k][0] * F.col("o_l"), "eta": F.col("o_p") - CORNERS[k][1] * F.col("o_w")},
        lambda c, k: {"r": F.sqrt(c("xi") * c("xi") + c("eta") * c("eta") + q * q), "y": c("eta") * cd + q * sd, "d": c("eta") * sd - q * cd, "xq": F.sqrt(c("xi") * c("xi") + q * q)},
        lambda c, k: {"re": F.greatest(c("r") + c("eta"), F.lit(TINY)), "rx": F.greatest(c("r") + c("xi"), F.lit(TINY)), "rd": c("r") + c("d"), "th": F.when(F.abs(q) < 1e-9, 0.0).otherwise(F.atan(c("xi") * c("eta") / (q * c("r"))))},
        lambda c, k: {"ln": F.log(c("re"))},
        lambda c, k: {
            "i5": F.when(upright, -alpha * c("xi") * sd / c("rd")).when(F.abs(c("xi")) < 1e-9, 0.0).otherwise(alpha * 2 / cd * F.atan((c("eta") * (c("xq") + q * cd) + c("xq") * (c("r") + c("xq")) * sd) / (c("xi") * (c("r") + c("xq")) * cd))),
            "i4": F.when(upright, -alpha * q / c("rd")).otherwise(alpha / cd * (F.log(c("rd")) - sd * c("ln"))),
        },
        lambda c, k: {
            "i3": F.when(upright, alpha / 2 * (c("eta") / c("rd") + c("y") * q / (c("rd") * c("rd")) - c("ln"))).otherwise(alpha * (c("y") / (cd * c("rd")) - c("ln")) + sd / cd * c("i4")),
            "i1": F.when(upright, -alpha / 2 * c("xi") * q / (c("rd") * c("rd"))).otherwise(-alpha * c("xi") / (cd * c("rd")) - sd / cd * c("i5")),
        },
        lambda c, k: {"i2": -alpha * c("ln") - c("i3")},
        lambda c, k: {
            "s1": c("xi") * q / (c("r") * c("re")) + c("th") + c("i1") * sd, "s2": c("y") * q / (c("r") * c("re")) + q * cd / c("re") + c("i2") * sd, "s3": c("d") * q / (c("r") * c("re")) + q * sd / c("re") + c("i4") * sd,
            "d1": q / c("r") - c("i3") * sd * cd, "d2": c("y") * q / (c("r") * c("rx")) + cd * c("th") - c("i1") * sd * cd, "d3": c("d") * q / (c("r") * c("rx")) + sd * c("th") - c("i5") * sd * cd,
        },
    ]
    for step in steps:
        rows = rows.withColumns({f"o{k}_{name}": value for k in range(4) for name, value in step(at(k), k).items()})
    total = lambda part: sum((sign * at(k)(part) for k, (_, _, sign) in enumerate(CORNERS)), F.lit(0.0))
    moved = {name: -(F.col("o_ss") * total(f"s{i}") + F.col("o_ds") * total(f"d{i}")) / (2 * math.pi) for i, name in enumerate(names, 1)}
    return rows.withColumns(moved).select(*kept, *names)
