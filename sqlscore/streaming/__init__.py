from sqlscore.streaming.logs import LOG_SCHEMA, log_levels, log_rows  # noqa: F401
from sqlscore.streaming.means import dedup_stream, running_means  # noqa: F401
