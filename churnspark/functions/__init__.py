"""Column expressions shared by the operators."""

from churnspark.functions.exprs import (  # noqa: F401
    clean_name,
    clean_names,
    bool_map_expr,
    lenient_target,
    numeric_string,
    strict_target,
    summary_target,
)
