from .casts import coerce, numeric_or_zero
from .dates import is_date, is_datetime, norm_date, parse_date, parse_datetime
from .names import data_columns, label_from_id, quoted, table_ident
from .numbers import format_metric, null_safe_ratio, round_metric, rounded_total
from .predicates import (is_email, is_id_like, is_integer_text, is_phone, is_real_text, pii_class_of_name)
from .text import blank_to_null, content_hash, flatten_nested, is_blank, list_to_json, stringify, strip

__all__ = [
    "blank_to_null", "coerce", "content_hash", "data_columns", "flatten_nested", "format_metric", "is_blank",
    "is_date", "is_datetime", "is_email", "is_id_like", "is_integer_text", "is_phone", "is_real_text",
    "label_from_id", "list_to_json", "norm_date", "null_safe_ratio", "numeric_or_zero", "parse_date",
    "parse_datetime", "pii_class_of_name", "quoted", "round_metric", "rounded_total", "stringify", "strip",
    "table_ident",
]
