"""From a validated request to a plan: schema, validation, compilation, joins on demand, paging."""
