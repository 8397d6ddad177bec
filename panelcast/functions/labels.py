"""Quality and risk labels.

The cut points are fixed values; three R2 scales exist and are kept by name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .isoweek import Col, _c

# Lower bounds per label, best label first.
R2_SCALES = {
    "validation": ((0.80, "Excellent"), (0.65, "Bon"), (0.45, "Moyen")),
    "guide": ((0.85, "Excellent"), (0.70, "Bon"), (0.50, "Moyen")),
}
MAE_PCT_SCALE = ((15.0, "Excellent"), (30.0, "Bon"), (50.0, "Moyen"))
RMSE_PCT_SCALE = ((20.0, "Excellent"), (40.0, "Bon"), (70.0, "Moyen"))


def r2_label(value: Col, scale: str = "validation") -> Column:
    value = _c(value)
    out = F.when(value.isNull(), "—")
    for bound, label in R2_SCALES[scale]:
        out = out.when(value >= bound, label)
    return out.otherwise("Faible")


def _share_label(error: Col, mean: Col, scale, worst: str) -> Column:
    share = F.try_divide(_c(error), _c(mean)) * 100
    out = F.when(_c(mean).isNull() | (_c(mean) <= 0), "—")
    for bound, label in scale:
        out = out.when(share <= bound, label)
    return out.otherwise(worst)


def mae_label(mae: Col, mean_observed: Col) -> Column:
    return _share_label(mae, mean_observed, MAE_PCT_SCALE, "Élevé")


def rmse_label(rmse: Col, mean_observed: Col) -> Column:
    return _share_label(rmse, mean_observed, RMSE_PCT_SCALE, "Élevé")


def bias_label(bias: Col) -> Column:
    bias = _c(bias)
    return (F.when(F.abs(bias) < 2, "Bien centré")
            .when(bias > 0, "Sur-estimation")
            .when(bias.isNotNull(), "Sous-estimation"))


def coefficient_label(coefficient: Col) -> Column:
    value = _c(coefficient)
    return (F.when(value > 1.2, "Risque élevé").when(value < 0.8, "Risque faible")
            .when(value.isNotNull(), "Risque moyen"))


def model_verdict(cv_r2: Col, mae_pct: Col) -> Column:
    r2, pct = _c(cv_r2), _c(mae_pct)
    return (F.when(r2.isNull(), "Validation impossible")
            .when((r2 >= 0.70) & (pct <= 30), "Bon")
            .when(r2 >= 0.45, "Moyen")
            .otherwise("Faible"))
