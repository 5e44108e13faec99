from sqlscore.sources.evalsets import (  # noqa: F401
    EVAL_SCHEMA, append_merge, is_three_part, read_eval_csv, read_eval_json, read_eval_parquet, read_eval_table,
    read_table, to_rows, write_table,
)
from sqlscore.sources.tables import TABLES, load, register_views  # noqa: F401
