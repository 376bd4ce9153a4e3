"""DataFrame to DataFrame operators: gates, joins, scoring, masks, learning, reports."""
