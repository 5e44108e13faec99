from sqlscore.functions.sqltext import (  # noqa: F401
    LEXICON, interleave, is_three_part_name, keyword_count_map, map_difference, message_id,
    metric_rename, render, sql_keywords, sql_tokens, strip_heading,
)
