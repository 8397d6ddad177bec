"""Area-by-week surveillance analytics on PySpark."""

from .functions.isoweek import iso_week_index, iso_week_to_date, week_index_to_iso
from .functions.scalars import skill_score
from .operators.baselines import check_no_leakage, naive_baselines, temporal_cv_splits
from .operators.climate import aggregate_climate_by_week_and_area
from .operators.features import (DesignBuilder, add_climate_features, add_population_features, add_seasonality,
                                 add_spatial_features, add_static_features, add_temporal_features, build_design_matrix,
                                 describe_feature_dynamics, invariant_climate_variables, select_features)
from .operators.kpi import describe_coverage, merge_static_tables
from .operators.matching import build_auto_health_area_mapping, match_areas
from .operators.metrics import compute_peak_detection_metrics, detect_peaks, metrics_summary
from .operators.panel import build_panel, panel_summary
from .operators.risk import generate_alerts
from .operators.spatial import build_neighbour_weights, distance_to_lines, zonal_statistics
from .plans.forecast import (feature_importance, fit_pipeline, perform_pca_analysis, predict_quantiles,
                             recursive_forecast)
from .plans.models import ModelFactory, available_models, make_model
from .plans.pipelines import prepare_malaria, prepare_measles, run_modelling
from .plans.validation import backtest, temporal_validation
from .session import build_session

__all__ = [name for name in dir() if not name.startswith("_")]
