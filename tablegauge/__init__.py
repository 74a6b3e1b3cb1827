"""tablegauge: how fit is a table, or a set of related tables, for analytics and model training?"""

from tablegauge.operators.checks import check_table
from tablegauge.operators.learn import baseline_eval, meta_dataset, meta_train, predict_risk
from tablegauge.operators.meta import meta_features
from tablegauge.operators.profile import column_profile, profile_table, table_overview
from tablegauge.plans.analyze import analyze
from tablegauge.plans.compare import analyze_path, compare
from tablegauge.sources.readers import scan_archive, scan_by_extension, scan_catalog, scan_csv, scan_json

__all__ = [
    "analyze", "analyze_path", "baseline_eval", "check_table", "column_profile", "compare",
    "meta_dataset", "meta_features", "meta_train", "predict_risk", "profile_table",
    "scan_archive", "scan_by_extension", "scan_catalog", "scan_csv", "scan_json", "table_overview",
]
