"""From query text to a DataFrame: dialect, analyzer, planner, explanation."""
