from .contract import Classification, GoldContract, contracts_frame
from .metric import (GuardError, Metric, aggregation_class, auto_questions, conformance, dimension_dictionary,
                     metric_column, metrics_frame, propose_metrics, reaggregation_verdict, validate_metric, version_metrics)

__all__ = [
    "Classification", "GoldContract", "GuardError", "Metric", "aggregation_class", "auto_questions", "conformance",
    "contracts_frame", "dimension_dictionary", "metric_column", "metrics_frame", "propose_metrics",
    "reaggregation_verdict", "validate_metric", "version_metrics",
]
