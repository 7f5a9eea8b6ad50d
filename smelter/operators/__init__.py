from .audit import (AUDIT_SCHEMAS, access_policy, audit_frame, conformance_summary, contract_rows, governance_report,
                    governance_verdict, inherit, lineage_outputs, lineage_roots, model_rows, pii_disposition,
                    pii_register, quality_scoreboard, report_rows)
from .bronze import attach_pii_flags, catalog_rows, cast_bronze, wide_integer_types
from .gold import (build_daily_fact, conform_dimension, reconcile, reconcile_rows, write_fact)
from .learn import (LinearModel, build_features, build_schema, category_vocabulary, evaluate, fit_ridge, gram_cells,
                    holdout, input_violations, regression_metrics, score, train, with_row_index)
from .panels import (DEFAULT_ROLES, breakdown_panels, kpi_panels, mask_pii, panel_catalog, panels_for_role,
                     refresh_panels, visible_to)
from .profiling import (candidate_keys, classify_columns, column_samples, confirm_keys, detect_pii, dim_candidates,
                        first_values, infer_types, profile_columns, quality_checks, to_classification)
from .query import (answer_questions, dim_values, metric_query, receipts, route_questions, value_rows)
from .rollup import distinct_rollup, rollup_metric
from .silver import clean_silver, dedupe_all, dedupe_first, dedupe_receipt
from .versions import version_diff
from .wide_ridge import WideModel, fit_wide_ridge, score_wide

__all__ = [name for name in dir() if not name.startswith("_")]
